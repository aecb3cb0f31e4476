"""Review of a schedule: partial certification, audits of unused columns, checklists, routing, mappings, views of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions.registry import CELL, RULES, Rule, usable
from jobledger.functions.scalars import ratio
from jobledger.operators.certify import failures
from jobledger.operators.portfolio import KEYS, billing

#: How far a value is from print, the weakest last.
PROVENANCE = ("printed", "confirmed", "corrected", "derived", "assumed", "missing")
#: Columns that a signal marks in the table.
MARKS = {"trapped_cash": ("U", "E"), "job_borrow": ("O", "Q"), "loss_jobs": ("G", "V"), "cost_overrun": ("D", "C"), "margin_outlier": ("G",)}


def partial_certification(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each row how many identities could be checked and hold, and why it is incomplete: the columns that are null."""
    rules = usable(df.columns)
    off = [F.abs(F.col(r.output).cast("double") - r.value()) - r.tolerance() for r in rules]
    checked = sum((o.isNotNull().cast("int") for o in off[1:]), off[0].isNotNull().cast("int"))
    held = sum((F.coalesce((o <= 0).cast("int"), F.lit(0)) for o in off[1:]), F.coalesce((off[0] <= 0).cast("int"), F.lit(0)))
    columns = sorted({c for r in rules for c in (r.output, *r.inputs)})
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull()), ",")
    out = df.select(*keys, "job_id", checked.alias("checked"), held.alias("held"), missing.alias("missing"))
    return out.withColumn("status", F.when(F.col("held") < F.col("checked"), "failed").when(F.col("missing") != "", "incomplete").otherwise("certified"))


def shadow_audit(df: DataFrame, column: str, derived, least: float = 0.8) -> DataFrame:
    """Sections whose unused column follows a derived value on `least` or more of the rows where both are there, but not on all: how many rows and how many differ."""
    there = F.col(column).isNotNull() & derived.isNotNull()
    same = F.abs(F.col(column) - derived) <= 2 * CELL
    s = df.groupBy(*KEYS).agg(F.count_if(there).alias("rows"), F.count_if(there & ~same).alias("differ"))
    return s.where((F.col("differ") > 0) & ((F.col("rows") - F.col("differ")).cast("double") >= F.col("rows") * F.lit(least)))


#: Variables that some schedules print with either sign.
_EITHER_SIGN = ("U", "O")


def _realizes(column: str, rule: Rule) -> tuple:
    """(informative, differs, residual) of an unused column against the derived variable: rows where both are next to zero tell nothing."""
    x = F.col(column).cast("double")
    x = F.abs(x) if rule.output in _EITHER_SIGN else x
    limit = rule.tolerance() + F.lit(CELL)
    telling = F.coalesce((F.abs(rule.value()) > limit) | (F.abs(x) > limit), F.lit(False)) & x.isNotNull() & rule.value().isNotNull()
    return telling, telling & (F.abs(x - rule.value()) > limit), x - rule.value()


def _derivable(columns: list[str]) -> dict[str, Rule]:
    """The money variables that no column of the schedule prints, each by its first identity."""
    out: dict[str, Rule] = {}
    for r in RULES:
        if r.kind == "money" and r.output not in columns and set(r.inputs) <= set(columns):
            out.setdefault(r.output, r)
    return out


def audited(df: DataFrame, unused: list[str], keys: tuple[str, ...] = KEYS, least_rows: int = 2, least: float = 0.8) -> DataFrame:
    """Which derived variable an unused column prints: keys, column, variable, rows, differ.

    It must hold on `least` of the telling rows (and `least_rows`), and not on all;
    of several variables the best counts, and equally good ones none.  All pairs of
    columns and variables are counted in one pass; null cells tell nothing.
    """
    tests = [(c, r) for c in unused for r in _derivable([x for x in df.columns if x not in unused]).values()]
    counts = []
    for k, (c, r) in enumerate(tests):
        telling, differs, _ = _realizes(c, r)
        counts += [F.count_if(telling).alias(f"n{k}"), F.count_if(differs).alias(f"d{k}")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r.output).alias("variable"), F.col(f"n{k}").alias("rows"), F.col(f"d{k}").alias("differ")) for k, (c, r) in enumerate(tests)]))
    fit = F.col("rows") - F.col("differ")
    met = df.groupBy(*keys).agg(*counts).select(*keys, rows.alias("t")).select(*keys, "t.*").where((F.col("differ") > 0) & (fit >= F.greatest(F.lit(least_rows).cast("long"), F.ceil(F.col("rows") * F.lit(least)))))
    ranked = met.groupBy(*keys, "column").agg(F.sort_array(F.collect_list(F.struct(ratio(fit, F.col("rows")).alias("share"), fit.alias("fit"), "variable", "rows", "differ")), False).alias("a"))
    first, second = F.col("a")[0], F.get("a", F.lit(1))
    tied = F.coalesce((first["share"] == second["share"]) & (first["fit"] == second["fit"]), F.lit(False))
    return ranked.where(~tied).select(*keys, "column", first["variable"].alias("variable"), first["rows"].alias("rows"), first["differ"].alias("differ"))


def full_certification(df: DataFrame, unused: list[str], keys: tuple[str, ...] = KEYS, row: str = "job_id") -> DataFrame:
    """What does not hold on a row: broken identities of the mapped columns, and cells of audited unused columns that differ from the variable they print: keys, row, finding, residual."""
    mapped = df.drop(*unused)
    broken = failures(mapped).select(*keys, row, F.col("rule").alias("finding"), "residual")
    made = _derivable(mapped.columns)
    cells = []
    for c in unused:
        for r in made.values():
            _, differs, residual = _realizes(c, r)
            cells.append(F.when((F.col(f"__{c}") == r.output) & differs, F.struct(F.lit(f"{c} is {r.output}").alias("finding"), residual.alias("residual"))))
    chosen = audited(df, unused, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("variable"))).alias(f"__{c}") for c in unused])
    told = df.join(chosen, list(keys)).select(*keys, row, F.explode(F.array_compact(F.array(*cells))).alias("t")).select(*keys, row, "t.*")
    return broken.unionByName(told)


def with_audited(df: DataFrame, unused: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with a column for each variable that an audited column prints, in place of the unused ones, so that a repair sees these cells too; the first of several columns of one variable counts, and a section without such a column has null."""
    made = _derivable([c for c in df.columns if c not in unused])
    chosen = audited(df, unused, keys).groupBy(*keys).agg(*[F.min(F.when(F.col("variable") == v, F.col("column"))).alias(f"__{v}") for v in made])
    printed = {v: F.coalesce(*[F.when(F.col(f"__{v}") == c, F.col(c)) for c in unused]) for v in made}
    return df.join(chosen, list(keys), "left").withColumns(printed).drop(*unused, *[f"__{v}" for v in made])


def corroborating_columns(cells: DataFrame, derived: DataFrame) -> DataFrame:
    """Unassigned columns that equal one derived variable on all rows but a twentieth, and no other: mcol, variable.  Both sides are long forms, joined on the row."""
    near = F.abs(F.col("value") - F.col("expected")) <= F.greatest(F.lit(2.05), F.abs("expected") * F.lit(2e-5))
    met = cells.join(derived, [*KEYS, "job_id"]).groupBy(*KEYS, "mcol", "variable").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("k")).where("k * 20 >= n * 19 and n >= 3")
    one = met.groupBy(*KEYS, "mcol").agg(F.count(F.lit(1)).alias("c"), F.min("variable").alias("variable")).where("c = 1")
    return one.select(*KEYS, "mcol", "variable")


def readiness(mappings: DataFrame) -> DataFrame:
    """Whether a mapping (variables array) has two of the profit side, one of progress and one of billing."""
    has = lambda names: F.size(F.array_intersect("variables", F.array(*[F.lit(n) for n in names])))
    parts = [(has(("V", "C", "G")) >= 2).alias("profit"), (has(("D", "Q", "E", "H")) >= 1).alias("progress"), (has(("B", "U", "O", "N", "RB")) >= 1).alias("billing")]
    return mappings.select("mapping_id", *parts).withColumn("ready", F.col("profit") & F.col("progress") & F.col("billing"))


def weakest(provenance: DataFrame, inputs: DataFrame) -> DataFrame:
    """Provenance of a KPI: the weakest of its inputs; both tables are small dictionaries by section and KPI."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PROVENANCE]), F.col("provenance"))
    worst = provenance.join(F.broadcast(inputs), "variable").groupBy(*KEYS, "kpi").agg(F.max(rank).cast("int").alias("r"))
    return worst.select(*KEYS, "kpi", F.element_at(F.array(*[F.lit(p) for p in PROVENANCE]), F.col("r")).alias("provenance"))


def checklist(witness: DataFrame, fixed: DataFrame) -> DataFrame:
    """For each section: rules that hold, that hold after corrections, that fail on a few rows (a tenth) and on more."""
    joined = witness.join(fixed, [*KEYS, "rule"], "left").withColumn("left", F.col("checked") - F.col("held") - F.coalesce("fixed", F.lit(0)))
    state = F.when(F.col("checked") == F.col("held"), "ok").when(F.col("left") <= 0, "fixed").when(F.col("left") * 10 <= F.col("checked"), "warn").otherwise("bad")
    return joined.groupBy(*KEYS).agg(*[F.count_if(state == s).alias(s) for s in ("ok", "fixed", "warn", "bad")])


def route(sections: DataFrame) -> DataFrame:
    """Next step of a section by its status, whether readings look wrong, a rival mapping and retries."""
    again = (F.col("status") == "failed") & F.col("misread") & (F.col("retries") < 1)
    step = F.when(again, "re_extract").when(F.col("status") == "insufficient", F.when(F.col("rival"), "disambiguate").otherwise("fallback")).otherwise("analyze")
    return sections.withColumn("route", step)


def correction_status(corrections: DataFrame, accepted: DataFrame) -> DataFrame:
    """applied, reverted or review for each proposal, by the last decision on it."""
    last = accepted.groupBy("correction_id").agg(F.max_by("accept", "seq").alias("accept"))
    return corrections.join(last, "correction_id", "left").withColumn("status", F.when(F.col("accept"), "applied").when(~F.col("accept"), "reverted").otherwise("review")).drop("accept")


def corroborated(corrections: DataFrame, totals: DataFrame) -> DataFrame:
    """Corrections that alone explain the gap of their column's stated total: an equi-join with a range."""
    gap = F.abs((F.col("proposed") - F.col("observed")) - (F.col("stated") - F.col("computed"))) <= F.greatest(F.lit(1.0), F.abs("stated") * F.lit(1e-9))
    return corrections.join(totals, list(KEYS)).where(gap).select(*KEYS, "job_id")


def snapshots(jobs: DataFrame) -> DataFrame:
    """P, net position, its side and margin of each report."""
    net = F.col("B") - F.col("E")
    return jobs.select("job_id", "period", ratio("D", "C").alias("P"), net.alias("net"), F.when(net > 0, "over").when(net < 0, "under").otherwise("even").alias("position"), ratio(F.col("V") - F.col("C"), "V").alias("margin"))


def job_rows(jobs: DataFrame) -> DataFrame:
    return billing(jobs).select("job_id", "period", "V", "C", "D", ratio("D", "C").alias("P"), ratio(F.col("V") - F.col("C"), "V").alias("margin"), "E", "B", (F.col("B") - F.col("E")).alias("net"), "U", "O")


def job_facts(jobs: DataFrame) -> DataFrame:
    """Last report of each job: profit, left to bill, number of reports."""
    last = F.struct("V", "C", "B", "period")
    t = jobs.groupBy("job_id").agg(F.max_by(last, "period").alias("x"), F.count(F.lit(1)).alias("reports"))
    return t.select("job_id", "x.period", (F.col("x.V") - F.col("x.C")).alias("profit"), (F.col("x.V") - F.col("x.B")).alias("left_to_bill"), "reports")


def schedule_types(jobs: DataFrame) -> DataFrame:
    """Type of each document: wip, cc or mixed."""
    kinds = F.collect_set(F.when(F.col("D") == F.col("C"), "cc").otherwise("wip"))
    return jobs.groupBy(*KEYS).agg(kinds.alias("k")).select(*KEYS, F.when(F.size("k") == 1, F.col("k")[0]).otherwise("mixed").alias("type"))


def apply_mapping(cells: DataFrame, user: DataFrame, inferred: DataFrame, variables: list[str]) -> DataFrame:
    """Wide rows under the effective mapping: the user's variable of a column, else the inferred one."""
    mapping = user.join(inferred, "mcol", "full").select("mcol", F.coalesce(user["variable"], inferred["variable"]).alias("variable"))
    named = cells.join(F.broadcast(mapping), "mcol")  # as many rows as a table has columns
    return named.groupBy(*KEYS, "job_id").agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])


def final_groups(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups after the log of decisions (merge into, new, undo): the last one on an observation counts."""
    last = decisions.groupBy("obs_id").agg(F.max_by(F.struct("action", "target"), "seq").alias("d"))
    out = groups.join(last, "obs_id", "left")
    group = F.when(F.col("d.action") == "merge", F.col("d.target")).when(F.col("d.action") == "new", F.concat(F.lit("own:"), F.col("obs_id"))).otherwise(F.col("group_id"))
    return out.select("obs_id", group.alias("group_id"))


def row_marks(signals: DataFrame) -> DataFrame:
    """Cells that a signal marks, with a colour by severity."""
    names = F.create_map(*[x for k, v in MARKS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return signals.select(*KEYS, "job_id", "signal", F.explode(names[F.col("signal")]).alias("column"), F.when(F.col("severity") >= 0.6, "red").otherwise("amber").alias("color"))


def cc_kpis(cc: DataFrame) -> DataFrame:
    s = cc.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("RT", "KT", "GT", "RC", "GC")], F.count(F.lit(1)).alias("jobs"))
    return s.withColumn("margin", ratio("GT", "RT"))


def billed_column(cc: DataFrame, candidates: list[str]) -> DataFrame:
    """The one candidate column that equals RT on all rows but a tenth, if there is exactly one."""
    off = [F.count_if(F.abs(F.col(c) - F.col("RT")) > F.greatest(F.lit(1.0), F.abs("RT") * F.lit(0.005)) + 1).alias(f"o{k}") for k, c in enumerate(candidates)]
    s = cc.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *off)
    fits = F.filter(F.array(*[F.when(F.col(f"o{k}") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.lit(c)) for k, c in enumerate(candidates)]), lambda x: x.isNotNull())
    return s.where(F.size(fits) == 1).select(*KEYS, fits[0].alias("billed"))


def same_period_duplicates(observations: DataFrame, keys: list[str]) -> DataFrame:
    return observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def trailing_totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sections whose last row is the sum of the others in half of the columns or more (of four at least, or all there are), within what rounding of every row may add up to: a share of the sum would let any error pass in a long section."""
    last = rows.groupBy(*KEYS).agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(last, list(KEYS))
    sums = [F.sum(F.when(F.col("row") < F.col("last"), F.col(c))).alias(f"s_{c}") for c in columns]
    tail = [F.max(F.when(F.col("row") == F.col("last"), F.col(c))).alias(f"t_{c}") for c in columns]
    s = joined.groupBy(*KEYS).agg(*sums, *tail, F.count(F.lit(1)).alias("n"))
    limit = lambda c: F.greatest(F.col("n") * F.lit(0.51), F.abs(f"t_{c}") * F.lit(1e-9)) + 1.0
    equal = [F.coalesce(F.abs(F.col(f"s_{c}") - F.col(f"t_{c}")) <= limit(c), F.lit(False)).cast("int") for c in columns]
    n = sum(equal[1:], equal[0])
    return s.select(*KEYS, n.alias("matching")).where(F.col("matching") >= min(len(columns), max(4, (len(columns) + 1) // 2)))


#: Variables that would tell two readings apart, the most telling first.
TELLING = ("P", "E", "Q", "U", "O", "N", "PB", "H", "M", "R", "RB")


def disambiguators(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variable: the first of TELLING that neither reading has printed and whose values differ by more than 5 % in the median.

    `readings` has keys, variable, a and b (the values of either reading) and printed; sections without such a variable give no row.
    """
    size = F.greatest(F.lit(1.0), F.abs("a"), F.abs("b"))
    apart = readings.where(~F.col("printed")).groupBy(*keys, "variable").agg(F.median(F.abs(F.col("a") - F.col("b")) / size).alias("m")).where("m > 0.05")
    place = F.array_position(F.array(*map(F.lit, TELLING)), F.col("variable"))
    return apart.withColumn("place", place).where("place > 0").groupBy(*keys).agg(F.min_by("variable", "place").alias("variable"))


def promoted(audits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, variable for audited columns that stand for one variable only; a column claimed by several is dropped."""
    return audits.groupBy(*keys, "column").agg(F.count_distinct("variable").alias("n"), F.min("variable").alias("variable")).where("n = 1").drop("n")


def edited_value(raw, percent):
    """The number that an editor typed: "$1,200", "(45)" for -45, "12.5%"; percents become fractions, a lone sign 0, blanks and other text null."""
    text = F.trim(raw)
    bare = F.regexp_replace(text, r"[,$%()\s]", "")
    number = F.when(bare == "", 0.0).when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    number = F.when(text.rlike(r"^\(.*\)$"), -F.abs(number)).otherwise(number)
    return F.when(text != "", F.when(percent, number / 100).otherwise(number))
