"""Parsing of printed schedules: cells, columns, labels, percentages, dates, headers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.operators.reading import CURRENCY, DASHES, DIGITS, LETTERS, PERCENT_WORDS, TOTAL_WORDS, find_totals, table_reader

#: Month names as dates are printed.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
#: Words before a fiscal year that ends with the calendar's.
YEAR_ENDS, FISCAL = ("end", "ended", "ending"), ("fye", "fyend", "fyended", "fyending")


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with value worked out once, where Catalyst would write it out wherever it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def clean(raw: Column) -> Column:
    """Trimmed, with plain spaces.  Texts outside ASCII should pass nfkc() first; it changes no others."""
    return F.trim(F.regexp_replace(raw, "[\\u00a0\\s]+", " "))


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """Compatibility-normalises a column; only rows with a character outside ASCII reach Python."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    odd = F.col(column).rlike("[^\\x00-\\x7F]")
    return df.where(odd).withColumn(column, normal(F.col(column))).unionByName(df.where(~odd | F.col(column).isNull()))


#: Plain forms of numbers, as most cells print them: digits, with thousands parted by commas, and with a fraction besides.  What they match needs no general reading.
_WHOLE, _PARTED = r"^(\$ ?)?[0-9]{1,300}%?\z", r"^(\$ ?)?[0-9]{1,3}(,[0-9]{3}){1,99}(\.[0-9]{1,300})?%?\z"
_PLAIN = r"^(\$ ?)?([0-9]{1,300}|[0-9]{1,3}(,[0-9]{3}){1,99})(\.[0-9]{1,300})?%?\z"


def _filled(raw: Column) -> Column:
    return F.when(raw.rlike("[!-~]"), F.lit(True)).otherwise(clean(F.coalesce(raw, F.lit(""))) != "")


def _digits(text: Column) -> Column:
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def _grouped(text: Column, separator: str, point: str) -> Column:
    """Whether a number is printed with a separator between its thousands, and perhaps a fraction behind `point`."""
    halves = F.split(text, F.lit("[" + point + "]"))
    groups = F.split(halves[0], F.lit("[" + separator + "]"))
    rest = F.slice(groups, F.lit(2), F.greatest(F.size(groups) - 1, F.lit(0)))
    whole = (F.size(groups) > 1) & _digits(groups[0]) & (F.length(groups[0]) <= 3) & F.forall(rest, lambda g: _digits(g) & (F.length(g) == 3))
    return whole & ((F.size(halves) == 1) | (F.size(halves) == 2) & _digits(F.get(halves, F.lit(1))))


def _halves(text: Column, point: str, most: int) -> Column:
    """Whether a number is digits, or digits on both sides of one `point` with `most` behind it at most."""
    halves = F.split(text, F.lit("[" + point + "]"))
    behind = F.get(halves, F.lit(1))
    return _digits(halves[0]) & ((F.size(halves) == 1) | (F.size(halves) == 2) & _digits(behind) & (F.length(behind) <= most))


def is_us(text: Column) -> Column:
    """Printed as only the US do: thousands parted by commas."""
    return _grouped(text, ",", ".")


def is_european(text: Column) -> Column:
    """Printed as only Europeans do: thousands parted by points, or a comma before one or two decimals."""
    return _grouped(text, ".", ",") | F.contains(text, F.lit(",")) & _halves(text, ",", 2)


def _number(text: Column, eu: Column) -> Column:
    plain = _halves(text, ".", 400)
    ahead = F.split(text, ",")
    loose = (F.size(ahead) == 2) & _digits(ahead[0]) & _halves(F.get(ahead, F.lit(1)), ".", 400) & (F.length(F.substring_index(F.get(ahead, F.lit(1)), ".", 1)) == 3)
    us_form = F.when(is_us(text) | loose, F.replace(text, F.lit(","), F.lit(""))).when(plain, text)
    eu_form = F.when(is_european(text), F.translate(text, ",.", ".")).when(plain, text)
    return F.when(_digits(text), text).when(eu, eu_form).otherwise(us_form).try_cast("double")


def parse_cell(raw: Column, eu: Column | None = None, repair: bool = True) -> Column:
    """struct(value, repaired, percent): blanks and dashes are 0, parentheses and a minus negate, % is noted, letters read for digits are repaired after a strict reading fails; unreadable is null."""
    eu = F.lit(False) if eu is None else eu
    plain = lambda x: F.when(eu, x.rlike(_WHOLE)).otherwise(x.rlike(_PLAIN))
    easy = lambda x, repaired: F.struct(F.translate(x, "$ ,%", "").try_cast("double").alias("value"), F.lit(repaired).alias("repaired"), F.contains(x, F.lit("%")).alias("percent"))
    short = F.when(plain(raw), easy(raw, False))
    if repair:
        mended = F.translate(raw, LETTERS, DIGITS)
        short = short.when(plain(mended), easy(mended, True))
    else:
        short = short.when(raw.rlike("[A-Za-z]"), F.struct(F.lit(None).cast("double").alias("value"), F.lit(False).alias("repaired"), F.contains(raw, F.lit("%")).alias("percent")))
    return short.otherwise(_general_cell(raw, eu, repair))


def _general_cell(raw: Column, eu: Column, repair: bool) -> Column:
    without_sign = lambda x: F.trim(F.ltrim(x, F.lit(CURRENCY + " ")))
    s = clean(F.coalesce(raw, F.lit("")))
    bare = without_sign(s)
    wrapped = bare.startswith("(") & bare.endswith(")") & (F.length(bare) > 1)
    inner = F.rtrim(F.ltrim(F.when(wrapped, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), F.lit(CURRENCY + " ")), F.lit(" "))

    def of_inner(x: Column) -> Column:
        zero = x["i"].isin("", *DASHES)
        digits = F.replace(F.rtrim(F.ltrim(x["i"], F.lit("-" + CURRENCY + " ")), F.lit("% ")), F.lit(" "), F.lit(""))

        def of_strict(n: Column) -> Column:
            mended = F.when(n["a"].isNull(), let(F.translate(n["d"], LETTERS, DIGITS), lambda m: _number(m, eu))) if repair else F.lit(None).cast("double")
            return let(mended, lambda m: of_values(F.coalesce(n["a"], m), n["a"].isNull() & m.isNotNull()))

        def of_values(value: Column, repaired: Column) -> Column:
            signed = F.when(x["w"] != x["i"].startswith("-"), -value).otherwise(value)
            return F.struct(signed.alias("value"), repaired.alias("repaired"), F.contains(x["i"], F.lit("%")).alias("percent"))

        found = let(let(digits, lambda d: F.struct(d.alias("d"), _number(d, eu).alias("a"))), of_strict)
        nothing = F.struct(F.lit(0.0).alias("value"), F.lit(False).alias("repaired"), F.lit(False).alias("percent"))
        return F.when(zero, nothing).otherwise(found)

    return let(F.struct(wrapped.alias("w"), inner.alias("i")), of_inner)


def decimal_votes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """For each document: cells that can only be US, only European, and the convention (European if more)."""
    s = F.regexp_replace(clean(F.col(column)), f"^[{CURRENCY} ()%]+|[{CURRENCY} ()%]+$", "")
    raw = F.col(column)
    parted, bare = raw.rlike(_PARTED), ~raw.rlike("[,.]")
    us = F.when(parted, F.lit(True)).when(bare, F.lit(False)).otherwise(let(s, is_us))
    eu = F.when(parted | bare, F.lit(False)).otherwise(let(s, lambda x: ~is_us(x) & is_european(x)))
    votes = df.groupBy(*keys).agg(F.count_if(us).alias("us"), F.count_if(eu).alias("eu"))
    return votes.withColumn("convention", F.when(F.col("eu") > F.col("us"), "eu").otherwise("us"))


def numeric_columns(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """For each column: non-blank cells, those that read strictly, and whether these are 60 % or more."""
    p = parse_cell(F.col(column), repair=False)["value"].isNotNull()
    filled = _filled(F.col(column))
    n = df.groupBy(*keys).agg(F.count_if(filled).alias("filled"), F.count_if(filled & p).alias("strict"))
    return n.withColumn("numeric", (F.col("filled") > 0) & (F.col("strict") * 100 >= F.col("filled") * 60))


def label_columns(df: DataFrame, keys: list[str], position: str, column: str) -> DataFrame:
    """The leftmost column that is not numeric and of whose non-blank cells half or more differ."""
    filled = F.when(_filled(F.col(column)), F.col(column))
    strict = F.count_if(filled.isNotNull() & parse_cell(F.col(column), repair=False)["value"].isNotNull())
    n = df.groupBy(*keys, position).agg(F.count(filled).alias("filled"), F.count_distinct(filled).alias("different"), strict.alias("strict"))
    good = n.where((F.col("filled") > 0) & (F.col("strict") * 100 < F.col("filled") * 60) & (F.col("different") * 2 >= F.col("filled")))
    return good.groupBy(*keys).agg(F.min(position).alias("label_column"))


def percent_scale(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Columns printed as percent (median over 1.5, all between -5 and 130): true where they are to be divided by 100."""
    s = df.groupBy(*keys).agg(F.median(column).alias("median"), F.min(column).alias("low"), F.max(column).alias("high"))
    return s.withColumn("scaled", (F.col("median") > 1.5) & (F.col("low") > -5) & (F.col("high") < 130))


def is_total(label: Column) -> Column:
    """Whether a word of the label says total or subtotal."""
    return F.coalesce(F.exists(F.split(F.lower(label), "[^a-z0-9_]+"), lambda w: w.isin(*TOTAL_WORDS)), F.lit(False))


def is_percent(header: Column) -> Column:
    """Whether a header names a percentage."""
    return F.coalesce(reduce(Column.__or__, [F.contains(F.lower(header), F.lit(w)) for w in PERCENT_WORDS]), F.lit(False))


def _dates(text: Column) -> Column:
    """Dates printed in a text, as yyyy-M-d strings: numbers parted by dashes or slashes, month names with day and year, and fiscal years."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9/-]+", " ")), " ")
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    is_year = lambda y: _digits(y) & (F.length(y) == 4) & F.substring(y, 1, 2).isin("19", "20")
    month = F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item])

    def at(i: Column) -> Column:
        w = word(i)
        iso, us = F.split(w, "[-/]"), F.split(w, "/")
        short = F.get(us, F.lit(2))
        year = F.when(F.length(short) == 2, F.concat(F.lit("20"), short)).otherwise(short)
        day = F.regexp_replace(word(i + 1), "(st|nd|rd|th)$", "")
        before = F.when(word(i - 1) == "on", i - 2).otherwise(i - 1)
        fiscal = word(before).isin(*FISCAL) | word(before).isin(*YEAR_ENDS) & word(before - 1).isin("fy", "year")
        return (
            F.when((F.size(iso) == 3) & is_year(iso[0]), F.concat_ws("-", iso))
            .when((F.size(us) == 3) & is_year(year), F.concat_ws("-", year, us[0], F.get(us, F.lit(1))))
            .when(F.element_at(month, w).isNotNull() & is_year(word(i + 2)), F.concat_ws("-", word(i + 2), F.element_at(month, w).cast("string"), day))
            .when(is_year(w) & fiscal, F.concat(w, F.lit("-12-31")))
        )

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), at), lambda d: d.isNotNull())


def period_ends(df: DataFrame, key: str, text: str) -> DataFrame:
    """For each document its reporting date, if exactly one valid date is printed; else an error."""
    dates = df.select(key, F.explode_outer(_dates(F.col(text))).alias("d")).select(key, F.try_to_date("d", "yyyy-M-d").alias("d"))
    n = dates.groupBy(key).agg(F.count_distinct("d").alias("n"), F.min("d").alias("d"))
    return n.select(key, F.when(F.col("n") == 1, F.col("d")).alias("reporting_date"), F.when(F.col("n") > 1, "multiple_reporting_dates").when(F.col("n") == 0, "reporting_date_not_found").alias("reporting_date_error"))


def norm_header(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9%]+", " "))


def match_headers(headers: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """headers with `variable` where the normalised header is a synonym, and no other header of the table claims it as well; the dictionary is small and fixed."""
    named = headers.withColumn("__h", norm_header(F.col(column))).join(F.broadcast(synonyms.select(norm_header(F.col("header")).alias("__h"), "variable")), "__h", "left").drop("__h")
    claims = F.count("variable").over(Window.partitionBy("table_id", "variable"))
    return named.withColumn("variable", F.when(claims == 1, F.col("variable")))


def sniff(name: Column, head: Column) -> Column:
    """File type by its first bytes, then by its name."""
    starts = lambda hexa: F.substring(F.hex(head), F.lit(1), F.lit(len(hexa))) == hexa
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(starts("25504446"), "pdf").when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpeg").when(starts("47494638"), "gif")
        .when(starts("52494646") & (F.substring(F.hex(head), 17, 8) == "57454250"), "webp").when(starts("504B0304"), "xlsx").when(ending.isin("csv", "tsv", "txt"), "csv").otherwise("unknown")
    )


def cell_text(value: Column, percent: Column) -> Column:
    """A number as a cell prints it: percent with up to two decimals, whole numbers without, others with two."""
    share = F.concat(F.regexp_replace(F.format_string("%.2f", value * 100), r"\.?0+$", ""), F.lit("%"))
    whole = F.format_string("%d", F.rint(value).cast("long"))
    return F.when(value.isNull(), "").when(percent, share).when(value == F.rint(value), whole).otherwise(F.format_string("%.2f", value))


def image_strips(df: DataFrame, height: str, size: int = 1600, overlap: int = 240, least: int = 300) -> DataFrame:
    """Top and bottom of each strip of a tall image: strips overlap, and a tail shorter than `least` joins the strip before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.col(height) - overlap) / step)).cast("int")
    tail = F.col(height) - (n - 1) * step
    n = F.when((n > 1) & (tail < least + overlap), n - 1).otherwise(n)
    tops = F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * step)
    strips = F.transform(tops, lambda a, k: F.struct(k.alias("strip"), a.alias("top"), F.when(k == n - 1, F.col(height)).otherwise(F.least(a + size, F.col(height))).alias("bottom")))
    return df.select(*df.columns, F.explode(strips).alias("s")).select(*df.columns, "s.*")


def tolerant_json(text: Column) -> Column:
    """The outermost object of a text, with fences and trailing commas removed, if it parses; else null."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.to_json(F.try_parse_json(body))


def identity_columns(df: DataFrame, keys: list[str], position: str, column: str) -> DataFrame:
    """Columns of which 70 % or more of the cells look like job ids: digits and dashes or letters, no blanks."""
    looks = F.col(column).rlike(r"^[A-Za-z]{0,4}[-# ]?\d[\d-]*$")
    s = df.groupBy(*keys, position).agg(F.count_if(looks).alias("k"), F.count(column).alias("n"))
    return s.where("n > 0 and k * 10 >= n * 7").groupBy(*keys).agg(F.min(position).alias("id_column"))


def offset_alignment(headers: DataFrame, words: DataFrame) -> DataFrame:
    """Offset (-1, 0 or 1) at which a table's headers name its columns' variables best: a shift needs four matches and three more than none."""
    named = headers.join(F.broadcast(words.select(norm_header(F.col("header")).alias("__h"), F.col("variable").alias("__v"))), norm_header(F.col("header")) == F.col("__h"), "left")
    w = Window.partitionBy("table_id").orderBy("pos")
    marked = named.withColumns({"before": F.lag("__v").over(w), "after": F.lead("__v").over(w)})
    s = marked.groupBy("table_id").agg(*[F.count_if(F.coalesce(F.col(c) == F.col("variable"), F.lit(False))).alias(n) for c, n in (("__v", "zero"), ("before", "left"), ("after", "right"))])
    good = lambda c: (F.col(c) >= 4) & (F.col(c) >= F.col("zero") + 3)
    return s.select("table_id", F.when(good("left") & (F.col("left") >= F.col("right")), -1).when(good("right"), 1).otherwise(0).alias("offset"))


def fuzzy_headers(df: DataFrame, column: str, synonyms: dict[str, str], least: float = 0.90, gap: float = 0.08) -> DataFrame:
    """df with the variable of the most similar synonym, if it is similar enough and clearly ahead of other variables' synonyms; short headers must match exactly."""
    from difflib import SequenceMatcher

    @F.pandas_udf("string")
    def best(names: pd.Series) -> pd.Series:
        def one(name: str | None) -> str | None:
            name = " ".join((name or "").lower().split())
            if name in synonyms or len(name) < 6:
                return synonyms.get(name)
            top: dict[str, float] = {}
            for s, v in synonyms.items():
                top[v] = max(top.get(v, 0.0), SequenceMatcher(None, name, s).ratio())
            (a, v), *rest = sorted(((r, v) for v, r in top.items()), reverse=True)
            return v if a >= least and (not rest or a - rest[0][0] >= gap) else None

        return names.map(one)

    return df.withColumn("variable", best(F.col(column)))


def total_rows(df: DataFrame, keys: list[str], order: str, columns: list[str], label: str | None = None, rtol: float = 0.005) -> DataFrame:
    """Rows that are totals: keys, order and reason.

    A row is one if its label says so, or if all its informative columns (three at
    least, where the sum is above 1) equal, within 1 and `rtol`, the sums since the
    last total, of all rows before, or of these with the totals found (two rows
    before at least).  A schedule's sums begin anew behind each total, so it is one
    fold over its rows in order, in one task.
    """
    names = [*keys, order]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        values, said = np.nan_to_num(part[columns].to_numpy(float)), part["__total"].to_numpy(bool)
        part["reason"] = find_totals(values, said, rtol, min(3, len(columns)))
        return part.loc[part["reason"].notna(), [*names, "reason"]]

    said = is_total(F.col(label)) if label else F.lit(False)
    shape = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)
    money = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*names, *money, said.alias("__total")).groupBy(*keys).applyInPandas(run, f"{shape}, reason string")


def without_subtotals(df: DataFrame, keys: list[str], order: str, columns: list[str], rtol: float = 0.005) -> DataFrame:
    """Rows that are no total."""
    return df.join(total_rows(df, keys, order, columns, rtol=rtol), [*keys, order], "left_anti")


def row_labels(df: DataFrame, keys: list[str], row: str, position: str, column: str) -> DataFrame:
    """A label for each row (numbered from 0): the cell of the label column, or "Row n" where there is none or it is blank."""
    chosen = df.join(label_columns(df, keys, position, column), keys, "left")
    named = chosen.groupBy(*keys, row).agg(F.max(F.when(F.col(position) == F.col("label_column"), clean(F.col(column)))).alias("label"))
    return named.withColumn("label", F.when(F.coalesce("label", F.lit("")) == "", F.concat(F.lit("Row "), (F.col(row) + 1).cast("string"))).otherwise(F.col("label")))


def finite(x: Column) -> Column:
    """A number, or null where it is none or not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def parsed_lines(cells: DataFrame, keys: list[str], row: str = "row", position: str = "col", column: str = "raw", header: str = "header", width: int = 16, rtol: float = 0.005) -> DataFrame:
    """Tables from their printed cells, a line for each row: keys, row, label, total, last (of the totals), cells (those of numeric columns: position, value, flag, filled).

    A table's decimal convention is voted; columns count as numeric by what reads
    strictly, and only their other cells are repaired; percentages (by sign or
    header) are scaled; total rows are found by label and by the sums of the first
    `width` amounts of a row, and marked.  All this needs the whole table, so each
    is read at once, by whole columns, in one task; the cells are read nowhere else.
    """
    kind = lambda c: cells.schema[c].dataType.simpleString()
    shape = ", ".join(f"`{c}` {kind(c)}" for c in (*keys, row))
    shape += f", label string, total string, last boolean, cells array<struct<`{position}`: {kind(position)}, value: double, flag: string, filled: boolean>>"
    told = cells.select(*keys, row, position, column, is_percent(F.col(header)).alias("__named"))
    return told.groupBy(*keys).applyInArrow(table_reader(keys, row, position, column, "__named", width, rtol), shape)


def parsed_tables(cells: DataFrame, keys: list[str], row: str = "row", position: str = "col", column: str = "raw", header: str = "header") -> tuple[DataFrame, DataFrame]:
    """(values: keys, row, col, value, flag, filled; rows: keys, row, label, total) of parsed_lines, which whoever needs both should read in one pass."""
    lines = parsed_lines(cells, keys, row, position, column, header)
    return lines.select(*keys, row, F.inline("cells")), lines.select(*keys, row, "label", "total")


def checked_totals(values: DataFrame, rows: DataFrame, keys: list[str], row: str = "row", position: str = "col") -> DataFrame:
    """Each column's stated total (of the last total row) against the sum of the body, plain or with the other total rows: stated, computed, matches, includes_subtotals; within max(1, 0.51 a row + 1, 1e-9 of the sum)."""
    v = values.join(rows.select(*keys, row, "total"), [*keys, row])
    last = rows.where("total is not null").groupBy(*keys).agg(F.max(row).alias("last"))
    return _checked(v.join(last, keys).withColumn("last", F.col(row) == F.col("last")), keys, position)


def checked_lines(lines: DataFrame, keys: list[str], position: str = "col") -> DataFrame:
    """checked_totals of parsed_lines, in the same pass."""
    return _checked(lines.select(*keys, "total", "last", F.inline("cells")), keys, position)


def _checked(v: DataFrame, keys: list[str], position: str) -> DataFrame:
    number = F.coalesce("value", F.lit(0.0))
    s = v.groupBy(*keys, position).agg(
        F.max(F.when(F.col("last") & F.col("filled"), F.col("value"))).alias("stated"), F.sum(F.when(F.col("total").isNull(), number).otherwise(0.0)).alias("computed"),
        F.sum(F.when(F.col("total").isNotNull() & ~F.col("last"), number).otherwise(0.0)).alias("subtotals"), F.count_if(F.col("total").isNull()).alias("n"),
    ).where("stated is not null")
    limit = F.greatest(F.lit(1.0), F.col("n") * F.lit(0.51) + 1.0, F.abs("computed") * F.lit(1e-9))
    plain = F.abs(F.col("stated") - F.col("computed")) <= limit
    more = F.abs(F.col("stated") - F.col("computed") - F.col("subtotals")) <= limit
    return s.select(*keys, position, "stated", "computed", (plain | more).alias("matches"), (more & ~plain).alias("includes_subtotals"))


def column_shapes(values: DataFrame, keys: list[str], position: str = "col", row: str = "row") -> DataFrame:
    """Whether all columns of a table have as many rows as its first: keys, columns, rows, and an error that names the first column that differs, else null.  A table may enter the role search without an error only."""
    each = values.groupBy(*keys, position).agg(F.count(row).alias("n"))
    first = F.min_by("n", position)
    shapes = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("columns"), first.alias("rows"), F.sort_array(F.collect_list(F.struct(position, "n"))).alias("all"))
    odd = F.get(F.filter("all", lambda c: c["n"] != F.col("rows")), F.lit(0))
    error = F.when(odd.isNotNull(), F.format_string("column %d has %d rows, the first has %d", odd[position], odd["n"], F.col("rows")))
    return shapes.select(*keys, "columns", "rows", error.alias("error"))
