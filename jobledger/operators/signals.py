"""Underwriting signals: a severity from 0 to 1 for each job or book, kept above a floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions.scalars import clamp, ramp, ratio
from jobledger.operators.portfolio import KEYS, billing, top

#: Floors and full marks of the severities, shares, and the least dollars that flag.
LEAST_SEVERITY, LEAST_DOLLARS = 0.12, 10_000
UNDERBILLED, OVERBILLED, EARLY, OUTLIER, THIN, BIG = (0.50, 1.00), (0.15, 0.75), (0.25, 0.70), (2.0, 5.0), (0.20, 0.60), (0.20, 0.50)
LOSS_FULL, OVERRUN_FULL, EARLY_P, THIN_MARGIN, FADE_FULL, FADE_P = 0.05, 0.10, 0.15, 0.05, 0.08, 0.35

_JOB = [*KEYS, "job_id", "severity", "dollars"]


def with_shape(jobs: DataFrame) -> DataFrame:
    """jobs with U, O, P (cost progress) and m (estimated margin), 0 where they can't be told."""
    return billing(jobs).withColumns({"P": F.coalesce(F.when(F.col("C") > 0, ratio("D", "C")), F.lit(0.0)), "m": F.coalesce(F.when(F.col("V") > 0, (F.col("V") - F.col("C")).cast("double") / F.col("V")), F.lit(0.0))})


def _kept(df: DataFrame, severity, dollars) -> DataFrame:
    return df.withColumns({"severity": severity, "dollars": dollars}).where(F.col("severity") > LEAST_SEVERITY).select(*_JOB)


def trapped_cash(jobs: DataFrame) -> DataFrame:
    left = F.col("V") - F.col("E")
    some = with_shape(jobs).where((F.col("U") >= LEAST_DOLLARS) & (F.col("P") < 0.995) & (left > F.greatest(F.lit(1.0), F.abs(F.col("V")).cast("double") * F.lit(0.005))))
    return _kept(some, ramp(ratio("U", left), *UNDERBILLED), F.col("U"))


def trapped_no_runway(jobs: DataFrame) -> DataFrame:
    """The variant that counts underbilled jobs with next to nothing left to earn as the worst case instead of leaving them out; jobs beyond 102 % don't count."""
    left = F.col("V") - F.col("E")
    some = with_shape(jobs).where((F.col("U") >= LEAST_DOLLARS) & (F.col("P") <= 1.02))
    ended = (F.col("P") >= 0.995) | (left <= F.greatest(F.lit(1.0), F.abs(F.col("V")).cast("double") * F.lit(0.005)))
    return _kept(some, F.when(ended, F.lit(1.0)).otherwise(ramp(ratio("U", left), *UNDERBILLED)), F.col("U"))


def job_borrow(jobs: DataFrame) -> DataFrame:
    some = with_shape(jobs).where(F.col("O") >= LEAST_DOLLARS)
    return _kept(some, F.when(F.col("C") <= F.col("D"), F.lit(1.0)).otherwise(ramp(ratio("O", F.col("C") - F.col("D")), *OVERBILLED)), F.col("O"))


def job_borrow_unbilled(jobs: DataFrame) -> DataFrame:
    """The variant by cost that the unbilled contract can't pay: max(cost to complete - (V - B), 0) / cost to complete."""
    ctc = F.col("C") - F.col("D")
    short = F.greatest(ctc - (F.col("V") - F.col("B")), F.lit(0).cast("long"))
    some = with_shape(jobs).where((ctc > 0) & (short >= LEAST_DOLLARS))
    return _kept(some, ramp(ratio(short, ctc), *OVERBILLED), short)


def loss_jobs(jobs: DataFrame) -> DataFrame:
    return _kept(with_shape(jobs).where("m < 0"), clamp(-F.col("m") / F.lit(LOSS_FULL)), F.col("C") - F.col("V"))


def cost_overrun(jobs: DataFrame) -> DataFrame:
    over = (F.col("D") - F.col("C")).cast("double") / F.greatest(F.col("C"), F.lit(1).cast("long"))
    return _kept(with_shape(jobs).where("D > C"), clamp(over / F.lit(OVERRUN_FULL)), F.col("D") - F.col("C"))


def _book(jobs: DataFrame, part, whole, marks: tuple[float, float], of: str) -> DataFrame:
    sums = jobs.groupBy(*KEYS).agg(F.sum(part).alias("dollars"), F.sum(whole).alias("whole"))
    return sums.where("whole > 0 and dollars > 0").withColumn("share", ratio("dollars", "whole")).withColumn("severity", ramp(F.col("share"), *marks)).where(F.col("severity") > LEAST_SEVERITY).select(*KEYS, "severity", "dollars", "share")


def early_concentration(jobs: DataFrame) -> DataFrame:
    return _book(with_shape(jobs), F.when(F.col("P") < EARLY_P, F.col("V")).otherwise(0), F.col("V"), EARLY, "V")


def thin_margin_backlog(jobs: DataFrame) -> DataFrame:
    ctc = F.greatest(F.col("C") - F.col("D"), F.lit(0).cast("long"))
    return _book(with_shape(jobs), F.when((F.col("m") >= 0) & (F.col("m") < THIN_MARGIN), ctc).otherwise(0), ctc, THIN, "ctc")


def job_concentration(jobs: DataFrame) -> DataFrame:
    sums = jobs.groupBy(*KEYS).agg(F.max("V").alias("dollars"), F.sum("V").alias("whole"), F.count(F.lit(1)).alias("n"))
    return sums.where("whole > 0 and n >= 2").withColumn("share", ratio("dollars", "whole")).withColumn("severity", ramp(F.col("share"), *BIG)).where(F.col("severity") > LEAST_SEVERITY).select(*KEYS, "severity", "dollars", "share")


def margin_outlier(jobs: DataFrame) -> DataFrame:
    """Margins far above the book's own median, by its interquartile range; books of six jobs or more."""
    shaped = with_shape(jobs)
    book = shaped.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.percentile("m", [0.25, 0.5, 0.75]).alias("quart")).where("n >= 6")
    spread = F.col("quart")[2] - F.col("quart")[0]
    joined = shaped.join(book, list(KEYS)).withColumns({"med": F.col("quart")[1], "iqr": F.when(spread == 0, F.lit(0.01)).otherwise(spread)})
    return _kept(joined.where("m > med"), ramp(F.abs(F.col("m") - F.col("med")) / F.col("iqr"), *OUTLIER), F.col("V") - F.col("C"))


def unrecognized_fade(jobs: DataFrame, earned: str = "E") -> DataFrame:
    """Jobs that earn less so far than their final margin claims; `earned` must be a printed column, not one derived from V*D/C."""
    e = F.col(earned).cast("double")
    gap = F.col("m") - (e - F.col("D")) / e
    some = with_shape(jobs).where((F.col("P") >= FADE_P) & (e > 0))
    found = some.withColumn("gap", gap).where(F.col("gap") * e >= LEAST_DOLLARS)
    return _kept(found, clamp(F.col("P")) * clamp(F.col("gap") / F.lit(FADE_FULL)), F.floor(F.col("gap") * e).cast("long"))


def numeric_fade(jobs: DataFrame) -> DataFrame:
    """unrecognized_fade for books whose earned revenue says more than V*D/C does: on some job the two differ by more than 1 and half a percent of the contract.  The numbers decide, whatever column E came from."""
    implied = F.when(F.col("C") > 0, F.col("V").cast("double") * F.col("D") / F.col("C")).otherwise(0.0)
    differs = F.abs(F.col("E") - implied) > F.greatest(F.lit(1.0), F.col("V").cast("double") * F.lit(0.005))
    telling = jobs.groupBy(*KEYS).agg(F.max(differs).alias("differs")).where("differs").select(*KEYS)
    return unrecognized_fade(jobs.join(telling, list(KEYS), "left_semi"))


def cc_losses(cc: DataFrame) -> DataFrame:
    return cc.where("GT < 0").select(*KEYS, "job_id", F.lit(0.9).alias("severity"), (-F.col("GT")).alias("dollars"))


def cc_fade(cc: DataFrame) -> DataFrame:
    fade = -F.col("GC").cast("double") / (F.abs("GT") + 1)
    return cc.where("GC < 0").withColumns({"severity": clamp(fade), "dollars": -F.col("GC")}).where(fade >= LEAST_SEVERITY).select(*_JOB)


#: Signals of single jobs, by name.
BY_JOB = {"trapped_cash": trapped_cash, "job_borrow": job_borrow, "loss_jobs": loss_jobs, "cost_overrun": cost_overrun, "margin_outlier": margin_outlier}


def all_jobs(jobs: DataFrame) -> DataFrame:
    frames = [f(jobs).withColumn("signal", F.lit(name)) for name, f in BY_JOB.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summary(jobs: DataFrame) -> DataFrame:
    """For each book and signal: highest severity, dollars and number of jobs."""
    return all_jobs(jobs).groupBy(*KEYS, "signal").agg(F.max("severity").alias("severity"), F.sum("dollars").alias("dollars"), F.count(F.lit(1)).alias("jobs"))


def ranked(jobs: DataFrame) -> DataFrame:
    """A book's signals in reading order: by severity to three decimals, then by dollars."""
    s = summary(jobs).withColumn("severity", F.round("severity", 3))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("severity"), F.desc("dollars"), "signal")
    return s.select(*KEYS, "signal", "severity", "dollars", F.row_number().over(w).alias("rank"))


def top_jobs(jobs: DataFrame, k: int = 5) -> DataFrame:
    """The k most severe jobs of each book and signal (a top-k report)."""
    return top(all_jobs(jobs), (*KEYS, "signal"), [F.desc("severity"), F.desc("job_id")], k).select(*KEYS, "signal", "job_id", "rank")
