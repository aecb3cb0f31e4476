"""Scalar functions on Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a job name that tell nothing about which job it is.
GENERIC_WORDS = (
    "the", "and", "phase", "project", "job", "street", "road", "station",
    "plant", "bridge", "building", "center", "centre", "school", "library",
    "garage", "tower", "clinic", "annex", "substation", "retrofit",
)


def ratio(a, b) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a.cast("double") / b)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ramp(x: Column, floor: float, full: float) -> Column:
    """0 up to `floor`, 1 from `full`, straight between."""
    return clamp((x - F.lit(floor)) / (F.lit(full) - F.lit(floor)))


def norm_id(x) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def norm_name(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def name_similarity(a, b) -> Column:
    """0.65 edit similarity + 0.35 shared words, of normalised names; 0 if either is blank."""
    a, b = norm_name(a), norm_name(b)
    edit = 1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b))
    words = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(*words)).cast("double") / F.greatest(F.size(F.array_union(*words)), F.lit(1))
    score = F.lit(0.65).cast("double") * edit + F.lit(0.35).cast("double") * shared
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), score))


def actual_name(job_id: Column, name: Column, label: Column) -> Column:
    """The name; the label only where there is no id (it may repeat the id)."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).when(F.coalesce(job_id, F.lit("")) != "", F.lit("")).otherwise(F.coalesce(label, F.lit("")))


def identity_score(id_a: Column, name_a: Column, label_a: Column, id_b: Column, name_b: Column, label_b: Column) -> Column:
    """How surely two observations are one job: equal ids 1 (0.78 if their names conflict), different ids weaken a name match, equal names make 0.96 (0.78 against different ids)."""
    i, j = norm_id(id_a), norm_id(id_b)
    alike = name_similarity(actual_name(id_a, name_a, label_a), actual_name(id_b, name_b, label_b))
    both = (i != "") & (j != "")
    named = (norm_name(name_a) != "") & (norm_name(name_b) != "")
    by_id = F.when(both & (i == j), F.when(named & (alike < 0.35), F.lit(0.78)).otherwise(F.lit(1.0))).when(both, alike * F.lit(0.92)).otherwise(alike)
    same = (norm_name(name_a) != "") & (norm_name(name_a) == norm_name(name_b))
    return F.when(same, F.greatest(by_id, F.when(both & (i != j), F.lit(0.78)).otherwise(F.lit(0.96)))).otherwise(by_id)


def plausible(id_a: Column, name_a: Column, label_a: Column, id_b: Column, name_b: Column, label_b: Column) -> Column:
    """Score of 0.60 or more, and equal ids, equal names, or similar names that share a telling word."""
    i, j = norm_id(id_a), norm_id(id_b)
    a, b = norm_name(actual_name(id_a, name_a, label_a)), norm_name(actual_name(id_b, name_b, label_b))
    telling = F.filter(F.split(a, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))
    candidate = ((i != "") & (i == j)) | ((a != "") & (a == b)) | ((name_similarity(a, b) >= 0.64) & F.arrays_overlap(telling, F.split(b, " ")))
    return (identity_score(id_a, name_a, label_a, id_b, name_b, label_b) >= 0.60) & F.coalesce(candidate, F.lit(False))


def shown(x: Column) -> Column:
    """Digits of a number as displayed: whole, or with up to four decimals, without trailing zeros."""
    whole = F.abs(x - F.rint(x)) < 1e-6
    return F.when(whole, F.format_number(F.rint(x), 0)).otherwise(F.regexp_replace(F.format_number(x, 4), r"\.?0+$", ""))


def classify_error(observed: Column, proposed: Column) -> Column:
    """Kind of reading error that turns the proposed value into the observed one, the more specific first."""
    o, p = observed.cast("double"), proposed.cast("double")
    d, e = (F.regexp_replace(shown(F.abs(x)), "[^0-9]", "") for x in (o, p))
    both = (o != 0) & (p != 0)
    one_less = lambda longer, shorter: (F.length(longer) == F.length(shorter) + 1) & F.exists(F.sequence(F.lit(1), F.length(longer)), lambda i: F.concat(F.substring(longer, F.lit(1), i - 1), F.substring(longer, i + 1, F.length(longer))) == shorter)
    sign = both & (F.abs(F.abs(o) - F.abs(p)) <= F.greatest(F.lit(0.51), F.abs(p) * F.lit(1e-9))) & ((o < 0) != (p < 0))
    scale = F.abs(ratio(o, p))
    powers = F.array(*[F.lit(float(10**k)) for k in range(1, 9)], *[F.lit(10.0**-k) for k in range(1, 9)])
    magnitude = both & F.exists(powers, lambda r: F.abs(scale - r) < r * F.lit(0.005))
    edits = F.levenshtein(d, e)
    near = (edits <= 2) & (F.abs(F.length(d) - F.length(e)) <= 1)
    digits = [F.array_join(F.array_sort(F.split(x, "")), "") for x in (d, e)]
    return (
        F.when(sign, "sign_error").when(one_less(d, e), "extra_character").when(one_less(e, d), "dropped_character").when(magnitude, "separator_or_magnitude_error")
        .when(edits == 0, "formatting_only").when(near & (digits[0] == digits[1]), "digit_transposition").when(near, "ocr_character_misread").otherwise("unexplained_substitution")
    )
