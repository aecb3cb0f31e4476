"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning takes a bounded, documented sample of labelled rows (`max_rows`, the
smallest hashes of their ids, as far as their whole texts fit in `max_bytes`); L1 sparsity leaves few non-zero weights, which are
all that scoring is sent.  Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.textkit import batches, column_bytes, mix, words


#: Inflected words share a stem: their first so many bytes count as words of their own.
STEMS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Settings:
    bits: int = 20  #: 2**bits coordinates, so the weights are bounded whatever the data
    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    epochs: int = 6
    max_rows: int = 8192  #: labelled rows learned from
    max_bytes: int = 64 << 20  #: and bytes of their texts together, which bounds what the driver holds
    seed: int = 42


@dataclass(frozen=True)
class Model:
    index: np.ndarray  #: coordinates with a weight
    weight: np.ndarray
    bias: float
    bits: int


def gram_features(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of each word, word stem, pair of neighbours and pair with one word between; unsorted, repeats kept."""
    stems: dict[int, list[np.ndarray]] = {k: [] for k in STEMS}
    _, _, h, first = words(buf, offs, stems=stems)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    parts, owner = [h], [text]
    for found in stems.values():
        stem = np.concatenate(found) if found else h
        parts.append(stem[stem != 0])
        owner.append(text[stem != 0])
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        parts.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
        owner.append(text[gap:][same])
    return np.concatenate(owner), (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


class FTRL:
    """Per-coordinate FTRL-proximal for logistic loss; coordinate 2**bits is the bias."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        l1 = np.where(at == 1 << s.bits, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        w = self.weights(np.arange(len(self.z)))
        used = np.flatnonzero(w[:-1])
        return Model(used.astype(np.int32), w[used].astype(np.float32), float(w[-1]), self.s.bits)


def held_out(id_col: str = "doc_id"):
    """True for ids whose CRC-32, as text, leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most s.max_rows labelled documents outside the held-out fold, whose texts have s.max_bytes together at most.

    A text that no longer fits is passed over whole; texts are never cut.
    Null ids or labels are left out; a document labelled twice counts as toxic if
    either says so, and of several texts of one id the one with the least hash is
    learned.  Without a toxic row nothing is known to be toxic, and every score is near 0.
    """
    order = F.xxhash64(F.col(id_col), F.lit(s.seed))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    sample = known.orderBy(order, id_col).limit(s.max_rows)
    texts = docs.select(id_col, F.col(text_col).alias("__text"))
    sizes = texts.select(id_col, F.coalesce(F.octet_length("__text"), F.lit(0)).alias("n")).join(F.broadcast(sample), id_col)  # at most max_rows ids
    known_sizes = {r[0]: (r["n"], r["__y"]) for r in sizes.groupBy(id_col).agg(F.max("n").alias("n"), F.max("__y").alias("__y")).collect()}
    left, chosen = s.max_bytes, []
    for key in sorted(known_sizes, key=lambda key: hash_order(key, s.seed)):
        n, y = known_sizes[key]
        if n <= left:
            left -= n
            chosen.append((key, y))
    shape = T.StructType([texts.schema[0], T.StructField("__y", T.IntegerType())])
    few = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, shape)), id_col)
    bits = s.bits

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "__text"):
                buf, offs = column_bytes(part.column(1))
                owner, at = gram_features(buf, offs, bits)
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                at = at[order]
                rows = [np.append(np.unique(at[cut[k] : cut[k + 1]]), 1 << bits).astype("<i4").tobytes() for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], names=["id", "y", "at"])

    kind = few.schema[0].dataType.simpleString()
    got = few.mapInArrow(run, f"id {kind}, y int, at binary").groupBy("id").agg(F.max("y").alias("y"), F.min_by("at", F.xxhash64("at")).alias("at")).toArrow()
    ids, y = got["id"].to_pylist(), got["y"].to_pylist()
    at_of = [c.as_buffer() for c in got["at"]]  # views, no copies
    rows = [(np.frombuffer(at_of[k], "<i4"), y[k]) for k in sorted(range(len(ids)), key=lambda k: hash_order(ids[k], s.seed))]
    if not any(y):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -30.0, s.bits)
    learner = FTRL(s)
    for epoch in range(s.epochs):
        for k in np.random.default_rng(s.seed + epoch).permutation(len(rows)):
            learner.learn(*rows[k])
    del got, at_of, rows  # the driver keeps the weights only
    pa.default_memory_pool().release_unused()
    return learner.model()


def hash_order(value: object, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(value), seed)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text, higher if toxic is likelier; null and empty texts get the bias's score.  A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(out_col)
    columns = base.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = np.zeros(1 << m.bits, np.float32)
        table[m.index] = m.weight
        for whole in parts:
            for part in batches(whole, text_col):
                buf, offs = column_bytes(part.column(part.schema.get_field_index(text_col)))
                owner, at = gram_features(buf, offs, m.bits)
                used = table[at] != 0
                once = np.unique(owner[used] << np.int64(m.bits) | at[used])
                total = np.bincount(once >> m.bits, table[once & ((1 << m.bits) - 1)], part.num_rows) + m.bias
                p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*columns, out_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out_col, T.DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """Documents whose score stays below the threshold; columns as given, whatever their names.

    Null and empty texts have the bias's score; repeated rows share their fate; no rows give none.
    """
    model = fit(docs, labels, s)
    mark = "__score"
    while mark in docs.columns:
        mark += "_"
    return score(docs, model, out_col=mark).where(F.col(mark) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
