"""Line dedup by site-relative frequency.

A line is boilerplate of a site if more than `ratio` of the site's pages, and at
least `min_pages` of them, contain it.  Such lines go from every page of that site.

Counting runs over hashes of lines; the few that pass are counted again by their
text, so a collision changes nothing.  A page with n lines counts n at most, so a
site has at most (mean lines a page) / ratio boilerplate lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.tables import checkpoint, partitions

#: Rows and bytes of boilerplate up to which it is broadcast; beyond, sites and documents are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def _lines(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(site_col).alias("__site"), F.array_distinct(F.split(F.col(text_col), "\n")).alias("__all"))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 10) -> DataFrame:
    """site, line, pages (with the line), site_pages, for lines above the ratio.  Blank lines never count.  A null site is a site of its own; a null text is a page without lines."""
    pages = docs.groupBy(F.col(site_col).alias("__site")).agg(F.count(F.lit(1)).alias("site_pages"))
    per = _lines(docs, site_col, text_col)
    hashed = per.select("__site", F.explode(F.transform(F.filter("__all", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))).alias("h"))
    often = hashed.groupBy("__site", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    o, p = often.alias("o"), pages.alias("p")
    often = checkpoint(o.join(p, F.col("o.__site").eqNullSafe(F.col("p.__site"))).where(F.col("n") > F.col("site_pages") * F.lit(ratio)).select("o.__site", "h", "site_pages"))
    size = often.count()
    texts = per.select("__site", F.explode("__all").alias("line")).withColumn("h", F.xxhash64("line"))
    often = F.broadcast(often) if size <= BROADCAST_ROWS else often
    t, o = texts.alias("t"), often.alias("o")
    same = F.col("t.__site").eqNullSafe(F.col("o.__site")) & (F.col("t.h") == F.col("o.h"))
    exact = t.join(o, same).groupBy(F.col("t.__site").alias("site"), "line").agg(F.count(F.lit(1)).alias("pages"), F.first("site_pages").alias("site_pages"))
    return exact.where((F.col("pages") >= min_pages) & (F.col("pages") > F.col("site_pages") * F.lit(ratio)) & (F.trim("line") != ""))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 10, dropped_col: str | None = None) -> DataFrame:
    """docs without their site's boilerplate lines; the other lines keep their order.

    Null texts stay null; a text of boilerplate alone becomes empty and stays a
    row, as do repeated rows.  With `dropped_col`, also the number of lines dropped.
    """
    lines = checkpoint(boilerplate(docs, site_col, text_col, ratio, min_pages).select("site", "line"))
    spark = docs.sparkSession
    rows, size = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("line")), F.lit(0))).first()
    by_site = lines.groupBy(F.col("site").alias("__site")).agg(F.collect_set("line").alias("__drop"))
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        d, b = docs.alias("d"), F.broadcast(by_site).alias("b")
        joined = d.join(b, F.col(f"d.{site_col}").eqNullSafe(F.col("b.__site")), "left")
    else:
        salts = partitions(spark)
        by_site = by_site.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn("__s", F.pmod(F.xxhash64(F.col(text_col)), F.lit(salts)).cast("int"))
        d, b = salted.alias("d"), by_site.alias("b")
        joined = d.join(b, F.col(f"d.{site_col}").eqNullSafe(F.col("b.__site")) & (F.col("__s") == F.col("__salt")), "left")
    parts = F.split(F.col(f"d.{text_col}"), "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains(F.col("__drop"), x))
    text = F.when(F.col("__drop").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    if dropped_col:
        out.append(F.when(F.col("__drop").isNull() | F.col(f"d.{text_col}").isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(kept)).cast("long").alias(dropped_col))
    return joined.select(*out)
