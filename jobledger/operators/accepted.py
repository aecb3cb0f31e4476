"""The accepted state of a book: decisions on corrections, totals and KPIs over what is accepted, canonical variables of a job, and what is emitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobledger.functions.registry import derive
from jobledger.operators.portfolio import KEYS

#: Variables printed as magnitudes whatever their sign, and roles of a completed contract as variables of a job.
MAGNITUDES = ("U", "O")
CC_AS_JOB = {"RT": ("V", "E", "B"), "KT": ("C", "D"), "GT": ("G",)}


def with_decisions(corrections: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """corrections with `accepted`: the newest decision (seq) on each, and true where none was taken."""
    newest = decisions.groupBy(key).agg(F.max_by("accept", "seq").alias("__accept"))
    return corrections.join(newest, key, "left").withColumn("accepted", F.coalesce("__accept", F.lit(True))).drop("__accept")


def reconciled_totals(cells: DataFrame, stated: DataFrame, corrections: DataFrame, keys: list[str] = list(KEYS)) -> DataFrame:
    """Stated totals of every additive column against its jobs: keys, variable, computed, corrected (with accepted corrections), stated, status.

    cells: keys, job_id, variable, value; stated: keys, variable, stated; corrections:
    keys, job_id, variable, proposed (null: unresolved), accepted.  U and O count by
    magnitude.  A column with a missing value, an unresolved cell or no stated total is
    unassessed; else the status is pass, pass_after_corrections, conflicts (it passes
    as printed but not corrected) or total_row_error, within max(1, a cent a row, 1e-9
    of the total).
    """
    job = [*keys, "job_id", "variable"]
    c = cells.join(corrections.select(*job, "proposed", "accepted", F.lit(True).alias("__found")), job, "left")
    size = lambda x: F.when(F.col("variable").isin(*MAGNITUDES), F.abs(x)).otherwise(x).cast("double")
    taken = F.col("__found") & F.col("accepted")
    open_ = F.count_if(F.col("value").isNull() | taken & F.col("proposed").isNull())
    s = c.groupBy(*keys, "variable").agg(
        F.sum(size(F.col("value"))).alias("computed"), F.sum(size(F.coalesce(F.when(taken, F.col("proposed")), F.col("value")))).alias("corrected"),
        F.count(F.lit(1)).alias("n"), F.count_if(taken).alias("fixes"), open_.alias("open"),
    ).join(stated, [*keys, "variable"], "left")
    goal = size(F.col("stated"))
    limit = F.greatest(F.lit(1.0), F.col("n") * F.lit(0.01), F.greatest(F.abs("computed"), F.abs(goal)) * F.lit(1e-9))
    near = lambda x: F.abs(F.col(x) - goal) <= limit
    status = (
        F.when((F.col("open") > 0) | F.col("stated").isNull(), "unassessed").when(near("corrected"), F.when(F.col("fixes") > 0, "pass_after_corrections").otherwise("pass"))
        .when((F.col("fixes") > 0) & near("computed"), "conflicts").otherwise("total_row_error")
    )
    return s.select(*keys, "variable", "computed", "corrected", "stated", status.alias("status"))


def accepted_jobs(jobs: DataFrame, corrections: DataFrame, keys: tuple[str, ...] = ("job_id", "period")) -> DataFrame:
    """jobs with accepted proposals (column, proposed, accepted) in place of printed values; KPIs are computed over these."""
    names = [c for c in ("V", "C", "G", "D", "Q", "E", "B") if c in jobs.columns]
    taken = corrections.where(F.col("accepted") & F.col("proposed").isNotNull())
    wide = taken.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("proposed"))).alias(f"__{c}") for c in names])
    return jobs.join(wide, list(keys), "left").withColumns({c: F.coalesce(F.col(f"__{c}").cast(jobs.schema[c].dataType), F.col(c)) for c in names}).drop(*[f"__{c}" for c in names])


def canonical_jobs(cells: DataFrame, keys: list[str], corrections: DataFrame | None = None) -> DataFrame:
    """One row a job with all sixteen variables: accepted corrections before mapped cells (keys, variable, value), roles of completed contracts as a job's, the rest derived."""
    named = cells.select(*keys, "variable", F.col("value").cast("double").alias("value"), F.lit(0).alias("rank"))
    if corrections is not None:
        named = named.unionByName(corrections.where("accepted").select(*keys, "variable", F.col("proposed").cast("double").alias("value"), F.lit(1).alias("rank")))
    roles = F.create_map(*[x for k, v in CC_AS_JOB.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = named.select(*keys, "value", "rank", F.explode(F.coalesce(roles[F.col("variable")], F.array("variable"))).alias("variable"))
    variables = ("V", "C", "G", "M", "D", "Q", "P", "E", "B", "H", "N", "U", "O", "R", "RB", "PB")
    wide = each.where(F.col("value").isNotNull()).groupBy(*keys).agg(*[F.max_by(F.when(F.col("variable") == v, F.col("value")), F.when(F.col("variable") == v, F.col("rank"))).alias(v) for v in variables])
    return derive(wide)


def label_identity(label: Column) -> Column:
    """struct(id, name) of a row's label: a leading run of letters, digits and dashes that holds a digit is the id, what follows the name; else all of it is the name."""
    text = F.trim(label)
    head = F.regexp_extract(text, r"^([A-Za-z]{0,4}[-#]?\d[\dA-Za-z-]*)(?:[\s:.]|$)", 1)
    rest = F.trim(F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), r"^[\s:.-]+", ""))
    return F.when(head != "", F.struct(head.alias("id"), F.nullif(rest, F.lit("")).alias("name"))).otherwise(F.struct(F.lit(None).cast("string").alias("id"), F.nullif(text, F.lit("")).alias("name")))


def family_consensus(implied: DataFrame, keys: list[str]) -> DataFrame:
    """One value from what several identities imply for a cell (keys, family, kind, value, tolerance): keys, value, families (that agree), consistent.

    Each family has one vote, the median of its implications in money, else of its
    percentages; the centre is the median of money votes, if there are any.  A vote
    agrees within its own tolerance, 2 at least; all pairs of implications agreeing
    likewise is consistent (two at least).
    """
    money = F.col("kind") == "money"
    by = implied.groupBy(*keys, "family").agg(F.median(F.when(money, F.col("value"))).alias("m"), F.median("value").alias("any"), F.max(F.when(money, F.col("tolerance"))).alias("tm"), F.max("tolerance").alias("ta"))
    votes = by.select(*keys, "family", F.coalesce("m", "any").alias("v"), F.coalesce("tm", "ta").alias("t"), F.col("m").isNotNull().alias("money"))
    centre = votes.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("money"), F.col("v"))), F.median("v")).alias("value"))
    agreeing = votes.join(centre, keys).groupBy(*keys).agg(F.first("value").alias("value"), F.count_if(F.abs(F.col("v") - F.col("value")) <= F.greatest(F.lit(2.0), F.col("t"))).alias("families"))
    all_ = F.sort_array(F.collect_list(F.struct("value", "tolerance")))
    near = lambda a, b: F.abs(a["value"] - b["value"]) <= F.greatest(F.lit(2.0), a["tolerance"], b["tolerance"])
    pairs = implied.groupBy(*keys).agg(all_.alias("x")).select(*keys, ((F.size("x") > 1) & F.forall("x", lambda a: F.forall("x", lambda b: near(a, b)))).alias("consistent"))  # few identities imply one cell
    return agreeing.join(pairs, keys)


def emitted(mapping: DataFrame, witnesses: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """For each mapped column (keys, col, variable) what is emitted: status (failing: a finding names it; confirmed: a witnessed rule holds it on every row; mapped: neither), rules that hold it, findings.

    witnesses: keys, variable, checked, held (one row a rule and variable); findings: keys, variable.
    """
    w = witnesses.groupBy(*keys, "variable").agg(F.count_if((F.col("checked") > 0) & (F.col("checked") == F.col("held"))).alias("rules"))
    f = findings.groupBy(*keys, "variable").agg(F.count(F.lit(1)).alias("findings"))
    out = mapping.join(w, [*keys, "variable"], "left").join(f, [*keys, "variable"], "left").fillna(0, ["rules", "findings"])
    status = F.when(F.col("findings") > 0, "failing").when(F.col("rules") > 0, "confirmed").otherwise("mapped")
    return out.select(*keys, "col", "variable", status.alias("status"), "rules", "findings")
