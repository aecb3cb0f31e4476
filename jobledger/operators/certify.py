"""Certification: every identity on every row, fixed-mapping audit, diagnosis aids, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions.registry import CC_SUMS, CELL, RULES, Rule, usable
from jobledger.functions.scalars import classify_error, ratio
from jobledger.operators.portfolio import KEYS


def _test(r: Rule) -> tuple:
    """(residual, tolerance) of a rule on a row."""
    return F.col(r.output).cast("double") - r.value(), r.tolerance()


def failures(df: DataFrame) -> DataFrame:
    """Rows that break an identity by more than rounding can explain, once for each: rule, family, residual, tolerance.  Rules that hold leave the row before anything is multiplied."""
    tests = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.family).alias("family"), a.alias("residual"), b.alias("tolerance")) for r in usable(df.columns) for a, b in [_test(r)]]
    if not tests:
        return df.where(F.lit(False)).select(*df.columns, F.lit("").alias("rule"), F.lit("").alias("family"), F.lit(0.0).alias("residual"), F.lit(0.0).alias("tolerance"))
    bad = F.filter(F.array(*tests), lambda t: F.abs(t["residual"]) > t["tolerance"])
    return df.where(breaks(df.columns)).withColumn("__t", F.explode(bad)).select(*df.columns, "__t.*")


def breaks(columns: list[str]) -> Column:
    """Whether a row breaks an identity of these columns; an expression in generated code, so no join finds such rows."""
    return reduce(Column.__or__, [F.coalesce(F.abs(a) > b, F.lit(False)) for r in usable(columns) for a, b in [_test(r)]], F.lit(False))


def witnesses(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each section and rule: rows checked and rows that hold, in one aggregation without a row for each rule."""
    rules = usable(df.columns)
    counts = []
    for k, r in enumerate(rules):
        residual, tolerance = _test(r)
        counts += [F.count(residual).alias(f"n{k}"), F.count_if(F.abs(residual) <= tolerance).alias(f"h{k}")]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{k}").alias("checked"), F.col(f"h{k}").alias("held")) for k, r in enumerate(rules)]))
    return df.groupBy(*keys).agg(*counts).select(*keys, each.alias("t")).select(*keys, "t.*").where("checked > 0")


def audit_fixed_mapping(df: DataFrame, keys: tuple[str, ...] = KEYS, least_rows: int = 3) -> DataFrame:
    """Checks of a mapping that the user fixed, with tolerances of 2.05 or 2e-5 of the output (0.002 for percentages): names failing rules, never a culprit."""
    rules = [r for r in usable(df.columns) if r.name not in ("C=V-G", "H=G*D/C")]
    tests = []
    for r in rules:
        tolerance = F.lit(0.002) if r.kind == "pct" else F.greatest(F.lit(2.05), F.abs(F.col(r.output)).cast("double") * F.lit(2e-5))
        tests.append(F.struct(F.lit(r.name).alias("rule"), (F.abs(F.col(r.output).cast("double") - r.value()) > tolerance).alias("bad")))
    found = df.select(*keys, F.explode(F.array(*tests)).alias("t")).select(*keys, "t.*").where("bad is not null")
    return found.groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("checked"), F.sum(F.col("bad").cast("long")).alias("failed")).where(F.col("checked") >= least_rows)


def culprits(df: DataFrame) -> DataFrame:
    """For each failing row the inputs common to all its failed rules, without those that some rule with independent support clears."""
    inputs = {r.name: [r.output, *r.inputs] for r in RULES}
    rules = usable(df.columns)
    held = {r.name: (F.abs(a) <= b) for r in rules for a, b in [_test(r)]}
    names = {r.name: F.array(*[F.lit(c) for c in inputs[r.name]]) for r in rules}
    some = lambda good: F.filter(F.array(*[F.when(held[r.name] if good else ~held[r.name], names[r.name]) for r in rules]), lambda x: x.isNotNull())
    rows = df.where(breaks(df.columns)).select(*KEYS, "job_id", some(False).alias("b"), F.flatten(some(True)).alias("clear")).where(F.size("b") > 0)
    shared = F.aggregate(F.slice("b", F.lit(2), F.greatest(F.size("b"), F.lit(1))), F.get("b", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    return rows.select(*KEYS, "job_id", F.array_sort(F.array_except(shared, "clear")).alias("culprits"), F.size("b").alias("failed"))


def classified(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("kind", classify_error(F.col("observed"), F.col("proposed")))


def transplants(df: DataFrame, wrong: str, right: str) -> DataFrame:
    """Cells whose wrong value is the one beside it: of another column of the row, or of the row before or after."""
    w = Window.partitionBy(*KEYS).orderBy("job_id")
    near = lambda c: F.coalesce(F.abs(c - F.col(wrong)) <= CELL, F.lit(False))
    others = [c for c in ("V", "C", "Q", "E", "B") if c in df.columns]
    beside = F.filter(F.array(*[F.when(near(F.col(c)), F.lit(c)) for c in others]), lambda x: x.isNotNull())
    marked = df.withColumns({"above": F.lag(right).over(w), "below": F.lead(right).over(w)})
    source = F.when(F.size(beside) > 0, beside[0]).when(near(F.col("above")), "above").when(near(F.col("below")), "below")
    return marked.where(F.abs(F.col(wrong) - F.col(right)) > CELL).withColumn("source", source).where("source is not null").select(*KEYS, "job_id", "source")


def apply_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """df with accepted corrections (job_id, period, column, value) laid over it, and P, margin, U and O recomputed; the source stays as it was."""
    columns = ("V", "C", "D", "E", "B")
    wide = corrections.groupBy("job_id", "period").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"__{c}") for c in columns])
    out = df.join(wide, ["job_id", "period"], "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns})
    zero = F.lit(0).cast("long")
    return out.select("job_id", "period", *columns, ratio("D", "C").alias("P"), ratio(F.col("V") - F.col("C"), "V").alias("margin"), F.greatest(F.col("E") - F.col("B"), zero).alias("U"), F.greatest(F.col("B") - F.col("E"), zero).alias("O"))


def assess_totals(df: DataFrame, stated: DataFrame, corrections: DataFrame, column: str) -> DataFrame:
    """Stated totals against sums: pass, pass_after_corrections, conflicts or total_row_error, within max(1, 0.51 n + 1, 1e-9 of the sum)."""
    fixed = corrections.where(F.col("column") == column).select("job_id", "period", F.col("value").alias("__fixed"))
    sums = df.join(fixed, ["job_id", "period"], "left").groupBy(*KEYS).agg(F.sum(column).alias("computed"), F.sum(F.coalesce("__fixed", column)).alias("corrected"), F.count(F.lit(1)).alias("n"), F.count("__fixed").alias("fixes"))
    limit = F.greatest(F.lit(1.0), F.col("n") * F.lit(0.51) + F.lit(1.0), F.abs("computed") * F.lit(1e-9))
    near = lambda c: F.abs(F.col(c) - F.col("stated")) <= limit
    status = F.when(F.col("fixes") == 0, F.when(near("computed"), "pass").otherwise("total_row_error")).when(near("corrected"), "pass_after_corrections").when(near("computed"), "conflicts").otherwise("total_row_error")
    return sums.join(stated, list(KEYS)).select(*KEYS, "computed", "corrected", "stated", status.alias("status"))


def cc_checks(cc: DataFrame) -> DataFrame:
    """Completed contracts: rows for each sum of the lattice, and those beyond 3 * 0.51 + 0.75."""
    tests = [F.struct(F.lit(f"{a}+{b}={s}").alias("rule"), F.abs(F.col(a) + F.col(b) - F.col(s)).alias("off")) for a, b, s in CC_SUMS]
    found = cc.select(*KEYS, F.explode(F.array(*tests)).alias("t")).select(*KEYS, "t.*")
    return found.groupBy(*KEYS, "rule").agg(F.count(F.lit(1)).alias("checked"), F.sum((F.col("off") > 3 * CELL + 0.75).cast("long")).alias("failed"))


def shared_unconfirmed(failed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows with two or more failed rules whose one common input is not confirmed: job_id, variable."""
    inputs = F.create_map(*[x for r in RULES for x in (F.lit(r.name), F.array(*[F.lit(c) for c in (r.output, *r.inputs)]))])
    each = failed.select("job_id", "period", "rule", F.explode(inputs[F.col("rule")]).alias("variable"))
    n = failed.groupBy("job_id", "period").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    common = each.groupBy("job_id", "period", "variable").agg(F.count(F.lit(1)).alias("k")).join(n, ["job_id", "period"]).where("k = n").join(confirmed, "variable", "left_anti")
    return common.groupBy("job_id", "period").agg(F.min("variable").alias("variable"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
