"""Sinks: section reports as JSON, corrected schedules as CSV with their log, text certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The variables of a printed schedule from left to right, and those that are shares.
PRINTED_ORDER = ("V", "C", "G", "D", "P", "E", "B", "U", "O", "Q", "R", "RB", "M", "PB", "H", "N")
SHARES = ("P", "M", "PB")


def json_reports(sections: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document for each section with its findings, in the order of rows."""
    listed = findings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "column", "observed", "proposed"))).alias("findings"))
    joined = sections.join(listed, keys, "left")
    return joined.select(*keys, F.to_json(F.struct(*[F.col(c) for c in joined.columns])).alias("report"))


def write_json(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").text(path)


def write_csv(schedule: DataFrame, log: DataFrame, path: str) -> None:
    schedule.write.mode("overwrite").option("header", True).csv(f"{path}/schedule")
    log.write.mode("overwrite").option("header", True).csv(f"{path}/corrections")


def certificate(witness: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each section: a line for each identity, how many rows were checked and how many hold."""
    line = F.format_string("%s: %d of %d rows hold", "rule", "held", "checked")
    return witness.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("certificate"))


def _as_printed(value: Column, share: bool) -> Column:
    """A cell of a printed schedule: whole amounts with thousands, negative ones in parentheses, shares as percent with one decimal, a dash where there is none."""
    v = value.cast("double")
    if share:
        text = F.concat(F.format_string("%.1f", v * 100), F.lit("%"))
    else:
        amount = F.format_number(F.abs(v), 0)
        text = F.when(v < 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), "\u2014").otherwise(text)


def printed_schedule(jobs: DataFrame, keys: list[str], order: str, label: Column) -> DataFrame:
    """Lines of a printed schedule: keys, line, label and a text for each variable that is there; the last line has the sums, and nothing for shares.

    Null and not finite cells print as a dash and count as nothing in the sums.
    """
    shown = [v for v in PRINTED_ORDER if v in jobs.columns]
    body = jobs.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("line"), label.alias("label"), *[_as_printed(F.col(v), v in SHARES).alias(v) for v in shown])
    number = lambda v: F.coalesce(F.when(F.abs(F.col(v).cast("double")) < F.lit(float("inf")), F.col(v)), F.lit(0))
    sums = jobs.groupBy(*keys).agg((F.count(F.lit(1)) + 1).cast("int").alias("line"), *[F.sum(number(v)).alias(v) for v in shown if v not in SHARES])
    foot = sums.select(*keys, "line", F.lit("Total").alias("label"), *[F.lit("").alias(v) if v in SHARES else _as_printed(F.col(v), False).alias(v) for v in shown])
    return body.unionByName(foot)
