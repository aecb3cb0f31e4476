"""Portfolio measures: KPIs, rollups, rankings, similar jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions.scalars import ratio

KEYS = ("portfolio_id", "period")


def billing(jobs: DataFrame) -> DataFrame:
    """jobs with under- and overbillings, U and O."""
    zero = F.lit(0).cast("long")
    return jobs.withColumns({"U": F.greatest(F.col("E") - F.col("B"), zero), "O": F.greatest(F.col("B") - F.col("E"), zero)})


def top(df: DataFrame, keys: tuple[str, ...], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits groups before the shuffle as well, so a hot key moves k rows a task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def kpis(jobs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    s = lambda e, n: F.sum(F.expr(e)).alias(n)
    sums = billing(jobs).groupBy(*keys).agg(
        s("V", "total_contract_value"), s("V - C", "estimated_gross_profit"), s("C - D", "cost_to_complete"), s("E", "earned_revenue"),
        s("(V - C) - (E - D)", "uegp"), s("B - E", "net_billing_position"), s("V - E", "backlog_revenue"), s("V - B", "unbilled_contract"),
        s("U", "underbillings_total"), s("O", "overbillings_total"), F.count(F.lit(1)).alias("job_count"), F.max("V").alias("largest"),
    )
    five = top(jobs, keys, [F.desc("V"), "job_id"], 5).groupBy(*keys).agg(F.sum("V").alias("five"))
    tcv = F.col("total_contract_value")
    return sums.join(five, list(keys)).withColumns({"gp_pct": ratio("estimated_gross_profit", tcv), "largest_job_share": ratio("largest", tcv), "top5_share": ratio("five", tcv)}).drop("largest", "five")


def largest_job(jobs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.min_by("job_id", F.struct(-F.col("V"), "job_id")).alias("job_id"), F.max("V").alias("V"))


def totals_by_type(jobs: DataFrame) -> DataFrame:
    """Total lines of open (wip) and complete (cc) jobs and of both (all), for each period."""
    typed = jobs.withColumn("type", F.when(F.col("D") == F.col("C"), "cc").otherwise("wip"))
    return typed.groupingSets([["period", "type"], ["period"]], "period", "type").agg(*[F.sum(c).alias(c) for c in ("V", "C", "D", "E", "B")], F.count(F.lit(1)).alias("jobs")).withColumn("type", F.coalesce("type", F.lit("all")))


def merge_duplicates(observations: DataFrame) -> DataFrame:
    """One row a job and period from several observations: of each variable the value of a completed-contracts source, else of the lowest item; `conflict` where values differ by more than 1; complete jobs have no billing position."""
    order = F.struct((~F.col("is_cc")).cast("int"), "item")
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("V", "C", "D", "E", "B")]
    differ = F.greatest(*[F.max(c) - F.min(c) for c in ("V", "C", "D", "E", "B")]) > 1
    merged = observations.groupBy("job_id", "period").agg(*pick, differ.alias("conflict"), F.max("is_cc").alias("is_cc"))
    zero = F.lit(0).cast("long")
    return merged.withColumns({"U": F.when(F.col("is_cc"), zero).otherwise(F.greatest(F.col("E") - F.col("B"), zero)), "O": F.when(F.col("is_cc"), zero).otherwise(F.greatest(F.col("B") - F.col("E"), zero))})


def similar_completed(jobs: DataFrame, k: int = 3) -> DataFrame:
    """For each open job the k complete jobs of its portfolio and period nearest in size (V within 0.35 to 3 times).

    Only the k sizes below and the k above can be nearest.  Complete jobs are
    numbered by size within bands of powers of three (each also in the two bands
    beside its own), an open job learns by a running count between which numbers it
    lies, and an equi-join on 2k numbers fetches them: no pair of sizes is tried.
    """
    band = lambda v: F.floor(F.log(v.cast("double")) / F.log(F.lit(3.0)))
    group = ["portfolio_id", "period", "band"]
    done = jobs.where("D = C and V > 0").select("portfolio_id", "period", F.col("job_id").alias("similar_id"), F.col("V").alias("SV"), F.explode(F.array(*[band(F.col("V")) + d for d in (-1, 0, 1)])).alias("band"))
    open_ = jobs.where("D < C and V > 0").select("portfolio_id", "period", "job_id", "V", band(F.col("V")).alias("band"))
    # of equal sizes the smallest ids are nearest: so they are last among those below and first among those above
    numbered = done.select(*group, "similar_id", "SV", F.explode(F.array(F.lit(0), F.lit(1))).alias("above"))
    order = Window.partitionBy(*group, "above").orderBy("SV", F.when(F.col("above") == 1, F.col("similar_id")).otherwise(-F.col("similar_id")))
    numbered = numbered.withColumn("place", F.row_number().over(order))
    both = open_.withColumn("done", F.lit(0)).unionByName(done.select("portfolio_id", "period", F.lit(None).cast("long").alias("job_id"), F.col("SV").alias("V"), "band", F.lit(1).alias("done")))
    running = Window.partitionBy(*group).orderBy("V", F.desc("done")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("below", F.sum("done").over(running)).where("done = 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(0).alias("above"), (F.col("below") - d).cast("int").alias("place")) for d in range(k)], *[F.struct(F.lit(1).alias("above"), (F.col("below") + 1 + d).cast("int").alias("place")) for d in range(k)]))
    near = placed.select(*group, "job_id", "V", wanted.alias("w")).select(*group, "job_id", "V", "w.*").join(numbered, [*group, "above", "place"])
    near = near.where("SV * 100 >= V * 35 and SV <= V * 3")
    distance = F.greatest("V", "SV").cast("double") / F.least("V", "SV")
    return top(near, ("portfolio_id", "period", "job_id"), [distance, "similar_id"], k).select("portfolio_id", "period", "job_id", "similar_id", "rank")


def book_shape(jobs: DataFrame) -> DataFrame:
    """Started jobs (P of 0.15 or more) of books with four or more of them, with the larger side of their billing position as a share of V, and the book's largest."""
    started = billing(jobs).where("D * 100 >= C * 15 and V > 0").withColumns({"side": F.when(F.col("U") > F.col("O"), "under").when(F.col("O") > 0, "over").otherwise("even"), "share": ratio(F.greatest("U", "O"), "V")})
    book = started.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("book_max")).where("n >= 4")
    return started.join(book, list(KEYS)).select("portfolio_id", "period", "job_id", "side", "share", "book_max")


def job_status(jobs: DataFrame) -> DataFrame:
    """Flags of a job and a colour by their number: loss, overrun, underbilled or overbilled by a tenth of V."""
    flags = [(F.col("V") < F.col("C")), (F.col("D") > F.col("C")), (F.col("U") * 10 >= F.col("V")), (F.col("O") * 10 >= F.col("V"))]
    n = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return billing(jobs).select("job_id", "period", n.alias("flags"), F.when(n == 0, "green").when(n == 1, "amber").otherwise("red").alias("color"))


def column_sums(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("V", "C", "G", "D", "Q", "E", "B")])


def call_metrics(calls: DataFrame, key: str, value: str) -> DataFrame:
    """Calls and value (in whole cents, so that sums don't depend on order) for each key and overall."""
    cents = F.floor(F.col(value) * 100).cast("long")
    return calls.groupingSets([[key], []], key).agg(F.count(F.lit(1)).alias("calls"), F.sum(cents).alias("cents"), F.max(cents).alias("largest")).withColumn(key, F.coalesce(key, F.lit("all")))
