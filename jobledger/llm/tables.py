"""Reading tables, cutting lineage and dealing groups out to tasks."""

from __future__ import annotations

import gc
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.runtime import bound_batches

#: Used only where the session names no spark.checkpoint.dir and runs on this machine alone, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/jobledger"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; on one machine without such a setting a folder of its own, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    bound_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what a checkpoint has replaced: it does so once the driver's garbage is collected, which may else take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_units(members: DataFrame, key: str, order: list[str], most: int, unit: str = "unit") -> DataFrame:
    """Deals the rows of each `key` to tasks so that any two rows with one key meet in some unit of about `most` rows.

    A key of up to `most` rows is one unit.  The rows of a larger key are split
    by hash into blocks of about most/2, and every pair of blocks is a unit: all
    pairs of rows still meet, no task holds more, and nothing is dropped.
    Adds `unit` and `part`: 0 where all rows of the unit are to be compared, else
    1 or 2, and only rows of different parts are (so each pair meets once).
    Rows come sorted by unit within partitions.
    """
    spark = members.sparkSession
    hot = checkpoint(members.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most))
    tag = F.xxhash64(F.col(key))
    if hot.isEmpty():
        dealt = members.withColumns({unit: tag, "part": F.lit(0)})
    else:
        blocks = F.ceil(F.col("__n") * 2 / F.lit(most)).cast("long")
        own = F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit(7)), F.col("__b"))
        part = F.when(F.col("__i") == F.col("__j"), 0).when(F.col("__i") < F.col("__j"), 1).otherwise(2)
        dealt = (
            members.join(hot, key, "left")
            .withColumn("__b", F.coalesce(blocks, F.lit(1).cast("long")))
            .withColumn("__i", own)
            .withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)))
            .withColumns({unit: F.when(F.col("__b") == 1, tag).otherwise(F.xxhash64(F.col(key), F.least("__i", "__j"), F.greatest("__i", "__j"))), "part": part})
            .drop("__n", "__b", "__i", "__j")
        )
    return dealt.repartition(partitions(spark), unit).sortWithinPartitions(unit, key, *order)


#: Rows of one key beyond which its partner in a join is broadcast instead of shuffling the rows to one task; of n rows at most n / HOT_ROWS keys have so many, and the limit grows where that would be more than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 500, 20_000


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left join right on `key`, which is unique in `right` and not null in `left`; both are read twice, so they should be checkpoints or cheap.

    Rows of keys that are hot on the left meet a broadcast row where they are; HOT_KEYS
    bounds how many rows are broadcast, whatever the data.  All other rows are shuffled.
    """
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    limit = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = checkpoint(sizes.where(F.col("__n") > limit).select(key))
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    apart = left.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key, how).unionByName(apart)


#: A sieve has 8 to 16 bits for each counted key, and 2**MOST_BITS (32 MB) at most.
LEAST_BITS, MOST_BITS = 16, 28


def sieve(keys: DataFrame, *columns: str) -> bytes | None:
    """A bitmap (a Bloom filter with two probes) of the keys' hashes, sized by their number; a single long column must be well mixed itself.

    It lets every key pass that is there, and a few others.  None, which lets all
    pass, where the keys are too many for the largest bitmap: the caller's join
    with the exact keys then does what the sieve would have spared it.
    """
    import numpy as np

    n = keys.count()
    bits = max(LEAST_BITS, (8 * n).bit_length())
    if bits > MOST_BITS:
        return None
    key = F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)
    probes = F.array(F.shiftrightunsigned(key, 64 - bits), F.shiftrightunsigned(F.shiftleft(key, bits), 64 - bits))
    each = keys.select(F.explode(probes).alias("b"))
    rows = each.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    got = rows.toPandas()  # 2**MOST_BITS / 64 rows at most
    out = np.zeros((1 << bits) // 64, np.int64)
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out.tobytes()


def passes(table: bytes | None, keys) -> object:
    """Which unsigned 64-bit keys the sieve lets pass."""
    import numpy as np

    out = np.ones(len(keys), bool)
    if table is None:
        return out
    words = np.frombuffer(table, np.uint64)
    bits = (len(words) * 64).bit_length() - 1
    away = np.uint64(64 - bits)
    for b in (keys >> away, (keys << np.uint64(bits)) >> away):
        out &= (words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
