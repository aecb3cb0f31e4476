"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64 bits: each 4-word shingle's XXH64 (seed 42) votes on every
bit, a bit is 1 if set in over half the shingles.  Documents link if theirs
differ in at most `radius` bits.

Search is exact: cut the bits into m blocks, then two fingerprints within the
radius agree wholly on at least m - radius blocks, so they meet under some choice
of that many.  m grows with the number of distinct fingerprints, which keeps
buckets small.  In a bucket, fingerprints are stored as vertical bit planes of
64 lanes; each plane's difference is added to carry-save counters held as words,
and a block of lanes is abandoned once all its distances exceed the radius.

A task returns only spanning links of what it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.components import components, label_components
from jobledger.llm.tables import checkpoint, in_units, join_unique

SHINGLE, SEED, BITS = 4, 42, 64
#: Distinct fingerprints that one task compares with each other at once.
UNIT = 8192
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    """XXH64 of each run of n words (ASCII white space parts them, A-Z lower-cased); fewer words: the whole sequence; none: nothing."""
    parts = text.lower().split()
    if not parts:
        return []
    if len(parts) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - n] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return [digest(joined[a:z], seed) for a, z in zip(starts, ends[n - 1 :].tolist(), strict=True)]


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(column: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index(column)
            texts = part.column(at)
            found = np.empty(len(texts), np.uint64)
            for k in range(len(texts)):
                value = texts[k]
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                h = shingle_hashes(raw)
                found[k] = fingerprint(np.fromiter(h, np.uint64, len(h)))
            kept = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [n for i, n in enumerate(part.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=[*names, "__fp"])

    return run


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and __fp (long); null text counts as empty, fingerprint 0."""
    few = docs.select(*keep, F.col(text_col).alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields[:-1])
    return few.mapInArrow(_fingerprints("__text"), f"{shape}, __fp long")


def _bounds(m: int) -> list[tuple[int, int]]:
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return list(zip(edges, edges[1:], strict=False))


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks, above the radius, at which a bucket of evenly spread fingerprints holds at most 512."""
    for m in range(radius + 1, 2 * radius + 1):
        if n / 2 ** (BITS * (m - radius) / m) <= 512:
            return m
    return 2 * radius


def keyed(distinct: DataFrame, m: int, radius: int) -> DataFrame:
    """One row for each fingerprint and choice of m - radius blocks: key, __fp."""
    bounds, keys = _bounds(m), []
    for at, chosen in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << (z - a)) - 1) << a for a, z in (bounds[c] for c in chosen))
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(at).alias("c"), F.col("__fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return distinct.select("__fp", F.explode(F.array(*keys)).alias("k")).select("__fp", F.xxhash64("k.c", "k.bits").alias("key"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit L of word p is bit p of lane L."""
    lanes = np.zeros((len(fps) + 63) // 64 * 64, np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def near_lanes(query: np.ndarray, block: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query fingerprint, block of lanes): indexes of pairs that are left, and the lanes within the radius as a word."""
    width = max(1, int(radius).bit_length())
    live = np.arange(len(query))
    over = np.zeros(len(query), np.uint64)
    counters = [np.zeros(len(query), np.uint64) for _ in range(width)]
    limit = radius + 1
    for p in range(BITS):
        carry = planes[block, p] ^ (np.uint64(0) - ((query >> np.uint64(p)) & _ONE))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p >= radius and (p % 4 == 3 or p == BITS - 1):
            # counters hold distances below 2**width; those of radius+1 or more are over
            high = np.zeros_like(over)
            equal = np.full_like(over, _ALL)
            for k in reversed(range(width)):
                bit = _ALL if (limit - 1) >> k & 1 else np.uint64(0)
                high |= equal & counters[k] & ~bit
                equal &= ~(counters[k] ^ bit)
            over |= high
            left = over != _ALL
            if not left.all():
                live, query, block, over = live[left], query[left], block[left], over[left]
                counters = [c[left] for c in counters]
                if not len(live):
                    break
    return live, ~over


def _links_of(unit: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smaller index's fingerprint) inside runs of equal `unit` values."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, len(unit)])
    n_blocks = (sizes + 63) // 64
    first = np.cumsum(n_blocks) - n_blocks
    lanes = np.zeros(int(n_blocks.sum()) * 64, np.uint64)
    where = np.full(len(lanes), -1, np.int64)
    slot = np.arange(len(unit)) - np.repeat(starts, sizes) + np.repeat(first * 64, sizes)
    lanes[slot], where[slot] = fps, np.arange(len(unit))
    planes = planes_of(lanes)
    label = np.arange(len(unit))
    per_row = np.repeat(n_blocks, sizes)
    ends = np.cumsum(per_row)
    at = 0
    while at < len(unit):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
        rows = np.repeat(np.arange(at, to), per_row[at:to])
        step = np.arange(len(rows)) - np.repeat(np.cumsum(per_row[at:to]) - per_row[at:to], per_row[at:to])
        block = np.repeat(np.repeat(first, sizes)[at:to], per_row[at:to]) + step
        live, word = near_lanes(fps[rows], block, planes, radius)
        for a in range(0, len(live), 1 << 14):
            hits = np.unpackbits(word[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(hits)
            i, j = rows[live[a : a + (1 << 14)]][pair], where[block[live[a : a + (1 << 14)]][pair] * 64 + lane]
            good = (j >= 0) & (j < i)
            label = label_components(len(unit), i[good], j[good], label)
        at = to
    linked = np.flatnonzero(label != np.arange(len(unit)))
    return fps[linked], fps[label[linked]]


def whole_units(parts: Iterator[pa.RecordBatch], least: int = 0) -> Iterator[pa.Table]:
    """Tables in which no unit is cut; rows come sorted by the column unit."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        if not part.num_rows:
            continue
        unit = part.column(part.schema.get_field_index("unit")).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])[-1])
        if held and cut == 0 and held[-1].column(part.schema.get_field_index("unit"))[-1].as_py() != unit[0]:
            if rows >= least:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        elif cut:
            held.append(part.slice(0, cut))
            if rows + cut >= least:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            else:
                rows += cut
            part = part.slice(cut)
        held.append(part)
        rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _compare(radius: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(parts):
            unit, fps = t["unit"].to_numpy(), t["__fp"].to_numpy().view(np.uint64)
            a, b = _links_of(unit, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def fingerprint_roots(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(node, root) over distinct fingerprints (__fp) that link with another."""
    m = blocks_for(distinct.count(), radius)
    dealt = in_units(keyed(distinct, m, radius), "key", ["__fp"], UNIT)
    return components(dealt.select("unit", "__fp").mapInArrow(_compare(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and white-space-only texts have fingerprint 0 and link like any other.
    Repeated rows give repeated rows.  A null id keeps its row and never names a
    component unless all ids of it are null.  No rows in, none out.
    """
    found = checkpoint(with_fingerprints(docs, [id_col], text_col))
    classes = checkpoint(found.groupBy("__fp").agg(F.min(id_col).alias("__least")))
    roots = fingerprint_roots(classes.select("__fp"), radius)
    rooted = checkpoint(classes.join(roots, classes["__fp"] == roots["node"], "left").select("__fp", "__least", F.coalesce("root", "__fp").alias("root")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("__least").alias("component_id")))
    named = checkpoint(join_unique(rooted.select("__fp", "root"), least, "root").select("__fp", "component_id"))
    return join_unique(found, named, "__fp").select(id_col, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Documents without near duplicates: of each component the row with the smallest id (null last, then by hashes of text and row).

    Columns as given.  Rows that are wholly equal count once; null and blank texts
    have fingerprint 0 and are one group.  No rows in, none out.
    """
    marks = {"__th": F.xxhash64(F.col(text_col)), "__rh": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    found = checkpoint(with_fingerprints(docs.withColumns(marks), [id_col, "__th", "__rh"], text_col))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__th").alias("th"), F.col("__rh").alias("rh"))
    classes = checkpoint(found.groupBy("__fp").agg(F.min(order).alias("__first")))
    roots = fingerprint_roots(classes.select("__fp"), radius)
    rooted = classes.join(roots, classes["__fp"] == roots["node"], "left").select(F.coalesce("root", "__fp").alias("root"), "__first")
    chosen = rooted.groupBy("root").agg(F.min("__first").alias("f")).select(F.col("f.id").alias("__id"), F.col("f.th").alias("__th"), F.col("f.rh").alias("__rh"))
    times = found.groupBy(F.col(id_col).alias("__id"), "__th", "__rh").agg(F.count(F.lit(1)).alias("__times"))
    c, t = chosen.alias("c"), times.alias("t")
    same = F.col("c.__id").eqNullSafe(F.col("t.__id")) & (F.col("c.__th") == F.col("t.__th")) & (F.col("c.__rh") == F.col("t.__rh"))
    chosen = checkpoint(c.join(t, same).select("c.*", "t.__times"))
    d, c = docs.withColumns(marks).alias("d"), chosen.alias("c")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("c.__id")) & (F.col("d.__th") == F.col("c.__th")) & (F.col("d.__rh") == F.col("c.__rh"))
    joined = d.join(c, same).select("d.*", "c.__times")
    once, more = joined.where("__times = 1"), joined.where("__times > 1").dropDuplicates([id_col, "__th", "__rh"])
    out = once if chosen.where("__times > 1").isEmpty() else once.unionByName(more)
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])
