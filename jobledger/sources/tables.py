"""Tables of the star schema and the schedules derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reporting dates of the derived schedules.
PERIODS = ("1996-12-31", "1997-12-31", "1998-12-31")
MONEY = ("V", "C", "G", "D", "Q", "E", "B")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wip_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each job, contractor and reporting date, in whole dollars: V contract, C estimated cost, G profit, D cost to date, Q cost to complete, E earned, B billed.

    Line items are aggregated once, with a conditional sum for each date; only
    the aggregates are multiplied by the dates.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", F.col("l_shipdate").cast("date").alias("shipped"))
    quantity = F.col("l_quantity").cast("int")
    done = [F.sum(F.when(F.col("shipped") <= F.lit(p).cast("date"), quantity).otherwise(0)).cast("long").alias(f"d{k}") for k, p in enumerate(PERIODS)]
    base = F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("base")
    jobs = items.groupBy(F.col("l_orderkey").alias("job_id")).agg(base, F.sum(quantity).cast("long").alias("q_all"), *done)
    dated = F.explode(F.array(*[F.struct(F.lit(p).cast("date").alias("period"), F.col(f"d{k}").alias("q_done")) for k, p in enumerate(PERIODS)]))
    jobs = jobs.select("job_id", "base", "q_all", dated.alias("x")).select("job_id", "base", "q_all", "x.period", "x.q_done").where("q_done > 0")
    rate = F.when(F.col("job_id") % 23 == 0, 104).otherwise(80 + F.col("job_id") % 5 * 3)
    jobs = jobs.select("job_id", "period", "q_all", "q_done", (F.col("base") * 100).alias("V"), (F.col("base") * rate).alias("C"))
    jobs = jobs.withColumn("D", F.floor(F.col("C").cast("double") * F.col("q_done") / F.col("q_all")).cast("long"))
    jobs = jobs.withColumn("E", F.floor(F.col("V").cast("double") * F.col("D") / F.col("C")).cast("long"))
    drift = (F.col("V") * (F.col("job_id") % 11 - 5) * (10 * F.col("q_all") - 7 * F.col("q_done"))).cast("double") / (1000 * F.col("q_all"))
    jobs = jobs.withColumn("B0", F.col("E") + F.floor(drift).cast("long"))
    owner = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    billed = F.greatest(F.lit(0).cast("long"), F.least("B0", "V"))
    return jobs.join(owner, F.col("job_id") == F.col("o_orderkey")).select("job_id", "period", F.col("c_nationkey").alias("portfolio_id"), "V", "C", (F.col("V") - F.col("C")).alias("G"), "D", (F.col("C") - F.col("D")).alias("Q"), "E", billed.alias("B"))


def with_errors(jobs: DataFrame, every: int = 97) -> DataFrame:
    """The schedules with one kind of misreading: cost to date ten times too high on every `every`-th job."""
    return jobs.withColumn("D", F.when(F.col("job_id") % every == 0, F.col("D") * 10).otherwise(F.col("D")))


def printed(jobs: DataFrame, column: str = "V") -> DataFrame:
    """job_id, period, portfolio_id, value and `raw`, the value as schedules print it: plain, with currency, in parentheses, as dash, blank or with letters for digits."""
    text = F.format_number(F.col(column), 0)
    kind = F.col("job_id") % 6
    raw = F.when(kind == 0, F.concat(F.lit("$"), text)).when(kind == 1, text).when(kind == 2, F.concat(F.lit("("), text, F.lit(")"))).when(kind == 3, "-").when(kind == 4, "").otherwise(F.translate(text, "0", "O"))
    return jobs.select("job_id", "period", "portfolio_id", F.col(column).alias("value"), raw.alias("raw"))


def cells(jobs: DataFrame, columns: tuple[str, ...] = MONEY) -> DataFrame:
    """Long form: section (portfolio_id, period), row (job_id), mcol (position) and value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("mcol"), F.col(c).alias("value")) for k, c in enumerate(columns)]))
    return jobs.select("portfolio_id", "period", "job_id", pairs.alias("x")).select("portfolio_id", "period", "job_id", "x.mcol", "x.value")


def cc_jobs(jobs: DataFrame) -> DataFrame:
    """Completed contracts: totals (RT, KT, GT), prior periods (RP, KP, GP; the last reporting date before, else 0) and the current one (RC, KC, GC)."""
    before = jobs.select("job_id", F.add_months("period", 12).alias("period"), F.col("E").alias("RP"), F.col("D").alias("KP"))
    done = jobs.where("D = C").select("job_id", "period", "portfolio_id", F.col("E").alias("RT"), F.col("D").alias("KT"), F.col("B").alias("BC"))
    joined = done.join(before, ["job_id", "period"], "left").fillna(0, ["RP", "KP"])
    return joined.select(
        "job_id", "period", "portfolio_id", "RP", (F.col("RT") - F.col("RP")).alias("RC"), "RT", "KP", (F.col("KT") - F.col("KP")).alias("KC"), "KT",
        (F.col("RP") - F.col("KP")).alias("GP"), (F.col("RT") - F.col("RP") - F.col("KT") + F.col("KP")).alias("GC"), (F.col("RT") - F.col("KT")).alias("GT"), "BC",
    )
