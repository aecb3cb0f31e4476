"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are normalised, turned by one seeded rotation and split into blocks.  A
cosine of c means a squared distance of 2 - 2c, so two such vectors are within
their block's proportional part of that budget in one block at least.  Each block
is joined by range: vectors are sorted by its leading coordinate, and those no
farther apart there than the block's radius are compared by their distance within
the block.  The union of the survivors, a small part of all pairs, is verified
exactly, in double precision.

Each distinct vector of a label travels to one task; only labels of more than UNIT
distinct vectors are dealt to several.  A pair counts in the first block that lets
it pass only, so links are counted without being written out; tasks return sums
and spanning links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.components import components, label_components
from jobledger.llm.simhash import whole_units
from jobledger.llm.tables import checkpoint, in_units, join_unique

BLOCKS, SEED = 4, 42
#: Distinct vectors that one task compares with each other at once.
UNIT = 16384
#: Allowance for rounding of block distances, in double precision and in the single precision of the range join.
_SLACK, _SINGLE = 1e-9, 1e-5
#: Distances of a range join that are held at once.
TILE = 1 << 22


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def edges(d: int) -> np.ndarray:
    m = min(BLOCKS, d)
    return np.array([round(i * d / m) for i in range(m + 1)])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def survivors(x: np.ndarray, cuts: np.ndarray, limit: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rotated unit vectors within the limit of some block, each in the first such block only; of different parts where they have parts (part above 0)."""
    for own, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        order = np.argsort(x[:, a], kind="stable")
        y = np.ascontiguousarray(x[order, a:z], np.float32)
        sq = (y * y).sum(axis=1)
        lead = x[order, a]
        reach = np.searchsorted(lead, lead + np.sqrt(limit[own]) + _SINGLE, "right")
        at = 0
        while at < len(y):
            to = min(len(y), at + max(1, TILE // max(1, int(reach[min(len(y) - 1, at + 511)]) - at)), at + 512)
            end = int(reach[to - 1])
            far = sq[at:to, None] + sq[None, at:end] - 2 * (y[at:to] @ y[at:end].T)
            i, j = np.nonzero(far <= limit[own] + _SINGLE)
            later = i < j
            p, q = order[at + i[later]], order[at + j[later]]
            good = (part[p] == 0) | (part[p] != part[q])
            p, q = p[good], q[good]
            for k in range(0, len(p), 1 << 16):
                u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                passed = np.add.reduceat((x[u] - x[v]) ** 2, cuts[:-1], axis=1) <= limit
                first = passed[:, own] & ~passed[:, :own].any(axis=1)
                yield u[first], v[first]
            at = to


def _joined(threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(parts):
            unit = t["unit"].to_numpy()
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            for a, z in zip(starts, np.r_[starts[1:], len(unit)], strict=True):
                if z - a > 1:
                    yield from _unit(t.slice(a, z - a), threshold)

    return run


def _unit(t: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    raw = _matrix(t["v"])
    d = raw.shape[1]
    norm = np.linalg.norm(raw, axis=1)
    x = raw / norm[:, None] @ rotation(d)
    cuts = edges(d)
    limit = (2 - 2 * threshold) * np.diff(cuts) / d + _SLACK
    part, size, vec = t["part"].to_numpy(), t["size"].to_numpy(), t["vec"].to_numpy()
    links, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
    for p, q in survivors(x, cuts, limit, part):
        same = (raw[p] * raw[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
        p, q = p[same], q[same]
        np.add.at(links, p, size[q])
        np.add.at(links, q, size[p])
        label = label_components(len(raw), p, q, label)
    used = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(vec[used]), pa.array(links[used]), pa.array(vec[label[used]])], names=["vec", "n", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared only within a label and with vectors as long as they are.
    Null, zero or empty vectors, those with null or non-finite components and those
    with a null label link with nothing.  Equal vectors are compared once and
    counted as many times as they occur; repeated rows link with each other, and
    so do rows of one id with different vectors if these are near.  A vector with a
    null id links like any other, never names a component that has an id, and is
    not kept.  No rows in, none out.
    """
    v, n = F.col(vector_col), F.col(label_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    length = F.aggregate(v, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    sound = F.coalesce(n.isNotNull() & v.isNotNull() & ~odd & (length > 0), F.lit(False))
    # 128 bits of hash name a label's vector, so that vectors travel once
    name = F.when(sound, F.struct(F.xxhash64(n, v).alias("x"), F.xxhash64(F.reverse(v), n).alias("y")))
    base = vectors.select(F.col(id_col).alias("id"), n.alias("label"), v.alias("v"), name.alias("name"))
    rows = checkpoint(base.select("id", "name"))
    classes = base.where("name is not null").groupBy("name").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = checkpoint(classes.withColumn("vec", F.monotonically_increasing_id()))
    members = classes.select(F.xxhash64("label", F.size("v")).alias("key"), "vec", "size", "v")
    dealt = in_units(members, "key", ["vec"], UNIT).select("unit", "part", "vec", "size", "v")
    found = checkpoint(dealt.mapInArrow(_joined(threshold), "vec long, n long, root long"))
    roots = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("vec").agg(F.sum("n").alias("n"))
    rooted = classes.select("name", "vec", "least", "size").join(sums, "vec", "left").join(roots, F.col("vec") == F.col("node"), "left")
    rooted = checkpoint(rooted.select("name", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("root", "vec").alias("root")))
    smallest = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = checkpoint(join_unique(rooted.select("name", "links", "root"), smallest, "root").select("name", "links", "component"))
    linked = join_unique(rows.where("name is not null"), named, "name").select("id", "links", "component")
    alone = rows.where("name is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
