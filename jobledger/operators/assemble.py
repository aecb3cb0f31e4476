"""Putting schedules together: sections, runs of degenerate rows, adjacent pages, overlays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.operators.layout import repeats_header
from jobledger.operators.portfolio import KEYS


def degenerate(jobs: DataFrame) -> DataFrame:
    """jobs with `degenerate`: nothing is left to do or earn (D = C and E = V)."""
    return jobs.withColumn("degenerate", (F.col("D") == F.col("C")) & (F.col("E") == F.col("V")))


def terminal_block(jobs: DataFrame, order: str = "job_id", least: int = 2) -> DataFrame:
    """Rows of the run of degenerate rows that ends a section, if it has `least` rows or more.

    The run begins behind the last row that is not degenerate, so one aggregate
    per section and a join tell it; no section is sorted.
    """
    marked = degenerate(jobs)
    last = marked.groupBy(*KEYS).agg(F.max(F.when(~F.col("degenerate"), F.col(order))).alias("last"))
    tail = marked.join(last, list(KEYS)).where(F.col("last").isNull() | (F.col(order) > F.col("last")))
    n = tail.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return tail.join(n, list(KEYS), "left_semi").select(*KEYS, order)


def combined_sections(sections: DataFrame) -> DataFrame:
    """Adjacent sections (doc_id, idx, signature) with one signature get one run number."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    new = F.when(F.lag("signature").over(w) == F.col("signature"), 0).otherwise(1)
    return sections.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new")


def adjacent_pages(fragments: DataFrame) -> DataFrame:
    """fragments (doc_id, chunk_id, first_page, last_page) with `joins`: it begins on the page behind the fragment before."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    return fragments.withColumn("joins", F.coalesce(F.lag("last_page").over(w) + 1 == F.col("first_page"), F.lit(False)))


def with_provenance(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """findings with the pages of their rows; an equi-join."""
    return findings.join(rows, ["table_id", "row"])


def assemble(fragments: DataFrame) -> DataFrame:
    """Logical tables of each document from its page grids (doc_id, chunk_id, headers, rows): equal headers continue a table and repeated header rows go; a grid of as many rows, with other headers, widens it; else a new table begins.

    Pages of one chunk_id follow each other by content.  A document's grids travel as one row in page order, so Python folds batches of documents instead of a group for each.
    """

    def fold(pages) -> list[tuple[list, list]]:
        tables: list[tuple[list, list]] = []
        for page in pages:
            headers, rows = list(page["headers"]), [list(x) for x in page["rows"]]
            if tables:
                old, body = tables[-1]
                if len(old) == len(headers) and (old == headers or not any(headers)):
                    named = tuple(h or "" for h in old)
                    body += [x for x in rows if x != old and not repeats_header(tuple(c or "" for c in x), named)]
                    continue
                if len(body) == len(rows) and rows and not set(old) & set(headers):
                    tables[-1] = (old + headers, [a + b for a, b in zip(body, rows, strict=True)])
                    continue
            tables.append((headers, rows))
        return tables

    def run(batches):
        for batch in batches:
            docs = zip(batch.column("doc_id").to_pylist(), batch.column("pages").to_pylist(), strict=True)
            found = [(doc, k, headers, rows) for doc, pages in docs for k, (headers, rows) in enumerate(fold(pages))]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "table_id", "headers", "rows"])

    pages = F.sort_array(F.collect_list(F.struct("chunk_id", "headers", "rows"))).alias("pages")
    return fragments.groupBy("doc_id").agg(pages).mapInArrow(run, "doc_id long, table_id int, headers array<string>, rows array<array<string>>")


def overlay(base: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with the newest edit (seq) of each key laid over `value`; an edit of null resets to what was printed."""
    newest = edits.groupBy(*keys).agg(F.max_by(value, "seq").alias("__new"))
    return base.join(newest, keys, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def schema_vote(tables: DataFrame, words: dict[str, str]) -> DataFrame:
    """Schedule type told by texts (table_id, place, text) that hold a word of the fixed dictionary (word -> type): titles before headers; two types at once are unresolved."""
    known = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(kind).alias("type")) for w, kind in words.items()])
    hits = tables.select("table_id", "place", F.explode(F.filter(known, lambda w: F.contains(F.lower(F.col("text")), w["word"]))["type"]).alias("type"))
    by = hits.groupBy("table_id", "place").agg(F.min("type").alias("lo"), F.max("type").alias("hi"))
    one = by.groupBy("table_id").agg(F.min_by(F.struct("lo", "hi"), F.when(F.col("place") == "title", 0).otherwise(1)).alias("t"))
    return one.select("table_id", F.when(F.col("t.lo") == F.col("t.hi"), F.col("t.lo")).otherwise("unresolved").alias("type"))
