"""Paragraph near-dedup: MinHash banding, exact verification, removal by components.

Paragraphs are cut by content, not by line breaks: a cut lies before a word whose
pair with the next has the least hash among its REACH neighbours on either side,
and a paragraph runs from one cut to the first other cut LEAST_WORDS or more behind
it.  So paragraphs overlap, every word is in one, and a passage that texts share
has the same paragraphs in each, wherever it stands and however it is wrapped.
Lines are compared beside them, by equality of their words.

Equal paragraphs (after normalisation) are one from the start.  Signatures of
ROWS x BANDS minima over 5-word shingles put a pair of similarity 0.8 into one
bucket of some band with probability 0.991; paragraphs that share a bucket are
verified by the exact Jaccard similarity of their shingles, and verified links give
components.  The first paragraph of a component stays; the others go.

Bucket keys travel packed, KEY + OWNER bytes for a band, to find the buckets in which
different paragraphs meet; only paragraphs of these travel with their shingles.
Buckets too large for a task are verified in pairs of blocks, so that every
colliding pair is compared whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.components import components
from jobledger.llm.simhash import whole_units
from jobledger.llm.tables import checkpoint, in_units, join_unique, partitions, passes, release, sieve
from jobledger.llm.textkit import _INV, _POW, batches, column_bytes, mix, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 9, 4, 42
#: Neighbours that a cut's hash is held against, and words that a paragraph has at least.
REACH, LEAST_WORDS = 5, 20
#: Words without a cut beyond which cuts are made every STRIDE words.
MOST_WORDS, STRIDE = 32, 16
RUN, LINE = 0, 1
#: Distinct paragraphs that one task compares with each other at once.
UNIT = 4096
#: Paragraphs whose keys a task packs at once.
PACKED = 1 << 17
#: Bytes of a bucket key behind the bits of its unit, of a name beside it (which tells names of one bucket apart), and of a shingle.
KEY, OWNER, GRAM = 5, 4, 5


def cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of words before which a paragraph may begin or end: texts' first words, content-defined cuts, and the number of words."""
    n = len(h)
    if not n:
        return np.zeros(1, np.int64)
    g = mix(h * np.uint64(0x9E3779B97F4A7C55) + np.r_[h[1:], h[:1]] * np.uint64(0xC2B2AE3D27D4EB4F))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    k = np.arange(n)
    # a cut's neighbours and their pairs lie within its text, so that the surroundings decide alone
    inner = (k - first[text] > REACH) & (first[text + 1] - k > REACH + 1)
    least = np.full(n + 1, np.uint64(0xFFFFFFFFFFFFFFFF))  # of REACH words from here
    least[:n] = g
    for j in range(1, REACH):
        least[: n - j] = np.minimum(least[: n - j], g[j:])
    k = k[inner]
    found = k[(g[k] < least[k - REACH]) & (g[k] <= least[k + 1])]
    found = np.unique(np.r_[found, first])
    gap = np.diff(found)
    more = np.where(gap > MOST_WORDS, gap // STRIDE - 1, 0)
    extra = np.repeat(found[:-1], more) + STRIDE * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.sort(np.r_[found, extra])


def runs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of content-defined paragraphs; a text of fewer words than a paragraph is one."""
    edge = cuts(h, first)
    begin = edge[:-1] if len(edge) > 1 else edge[:0]
    text = np.searchsorted(first, begin, "right") - 1
    end = np.minimum(np.r_[edge, len(h)][np.searchsorted(edge, begin + LEAST_WORDS)], first[text + 1])
    good = (end - begin >= LEAST_WORDS) | ((begin == first[text]) & (end == first[text + 1]))
    text, begin, end = text[good], begin[good], end[good]
    if not len(end):
        return text, begin, end
    # of those with one end the shortest that leaves no word behind the one before, so that no two of a text are alike by their overlap
    lead = np.r_[True, end[1:] != end[:-1]]
    last = np.r_[lead[1:], True]
    earliest, latest, text, end = begin[lead], begin[last], text[last], end[last]
    before = np.where(np.r_[False, text[1:] == text[:-1]], np.r_[0, end[:-1]], first[text])
    return text, np.clip(before, earliest, latest), end


def lines(buf: np.ndarray, offs: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word, index among the text's lines) of lines with a word."""
    breaks = np.flatnonzero(buf == 10) + 1
    begins = np.unique(np.r_[offs[:-1], breaks])
    begins = begins[begins < offs[-1]]
    at = np.searchsorted(s, np.r_[begins, offs[-1]])
    text = np.searchsorted(offs, begins, "right") - 1
    index = np.arange(len(begins)) - np.searchsorted(begins, offs[:-1])[text] if len(begins) else text
    used = at[1:] > at[:-1]
    return text[used], at[:-1][used], at[1:][used], index[used]


class Paragraphs:
    """Paragraphs and lines of all texts of a batch: text, kind, index within the text and kind, begin and end in words, name (a hash of kind and words)."""

    def __init__(self, column: pa.Array):
        self.buf, self.offs = column_bytes(column)
        self.s, self.e, self.h, self.first = words(self.buf, self.offs)
        t, a, z = runs(self.h, self.first)
        order = np.arange(len(t)) - np.searchsorted(t, np.arange(len(self.offs)))[t] if len(t) else t
        lt, la, lz, li = lines(self.buf, self.offs, self.s)
        self.text, self.begin, self.end, self.index = (np.concatenate(x).astype(np.int64) for x in ((t, lt), (a, la), (z, lz), (order, li)))
        self.kind = np.repeat(np.array([RUN, LINE], np.int8), [len(t), len(lt)])
        n = len(self.h)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.h * _POW.upto(n), out=total[1:])
        self.size = self.end - self.begin
        salt = self.size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + self.kind.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        self.name = mix((total[self.end] - total[self.begin]) * _INV.upto(n + 1)[self.begin] + salt)
        shingle = np.zeros(n + 1, np.uint64)
        if n >= SHINGLE:
            shingle[: n - SHINGLE + 1] = mix((total[SHINGLE:] - total[: n - SHINGLE + 1]) * _INV.upto(n + 1)[: n - SHINGLE + 1])
        self.shingle = shingle

    def banded(self) -> np.ndarray:
        """Paragraphs (not lines) with a shingle, one of each name, in order."""
        some = np.flatnonzero((self.kind == RUN) & (self.size >= SHINGLE))
        return some[np.sort(np.unique(self.name[some], return_index=True)[1])]

    def keys(self, pick: np.ndarray) -> np.ndarray:
        """(paragraphs, BANDS) bucket keys; `pick` in order."""
        out = np.zeros((len(pick), BANDS), np.uint64)
        if not len(pick):
            return out
        ranges = np.stack([self.begin[pick], self.end[pick] - SHINGLE + 1], axis=1).reshape(-1)
        rng = np.random.default_rng(SEED)
        for b in range(BANDS):
            key = np.full(len(pick), b, np.uint64)
            for _ in range(ROWS):
                odd, c = rng.integers(1, 1 << 63, 2, np.uint64)
                x = (self.shingle ^ c) * (odd | np.uint64(1))
                key = mix(key + np.minimum.reduceat(x ^ (x >> np.uint64(32)), ranges)[::2])
            out[:, b] = key
        return out

    def sets(self, pick: np.ndarray) -> pa.Array:
        """Sorted distinct shingles of paragraphs, GRAM bytes each."""
        size = self.end[pick] - self.begin[pick] - SHINGLE + 1
        owner = np.repeat(np.arange(len(pick)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[pick], size)
        value = self.shingle[at] >> np.uint64(64 - 8 * GRAM)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        once = np.ones(len(value), bool)
        once[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        offsets = np.searchsorted(owner[once], np.arange(len(pick) + 1)).astype(np.int32) * np.int32(GRAM)
        data = _bytes(value[once], GRAM).tobytes()
        return pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def span(self, k: int) -> tuple[int, int]:
        """Bytes of a paragraph, or of a line with its break, within its text."""
        at = int(self.offs[self.text[k]])
        a, z = int(self.s[self.begin[k]]), int(self.e[self.end[k] - 1])
        return a - at, z - at


def _each(make: Callable[[pa.RecordBatch, Paragraphs], pa.RecordBatch | None], column: str = "__text"):
    """A mapInArrow function that hands parts of about a megabyte of text to make(part, its paragraphs)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, column):
                out = make(part, Paragraphs(part.column(part.schema.get_field_index(column))))
                if out is not None and out.num_rows:
                    yield out

    return run


def _bytes(x: np.ndarray, n: int) -> np.ndarray:
    """(numbers, n): the n low bytes of each unsigned 64-bit number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def _numbers(x: np.ndarray) -> np.ndarray:
    """The numbers of (numbers, n) low bytes."""
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").reshape(-1)


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """Keys of which only what travels is left: the `bits` of the unit and KEY bytes behind them, as high bits."""
    away = np.uint64(max(0, 64 - bits - 8 * KEY))
    return key >> away << away


def _packed(bits: int):
    """(unit, keys, names): bucket keys with parts of names, and names (twice if they occur again), dealt to 2**bits units by their high bits."""

    def flush(name: list[np.ndarray], key: list[np.ndarray], owner: list[np.ndarray]) -> pa.RecordBatch:
        names, times = np.unique(np.concatenate(name), return_counts=True)
        names = np.repeat(names, np.minimum(times, 2))
        k, p = np.concatenate(key), np.concatenate(owner)
        once = np.unique(p, return_index=True)[1]
        k, p = k[once].reshape(-1), np.repeat(p[once], BANDS)
        order = np.argsort(k)
        k, p = k[order], p[order]
        away = np.uint64(64 - bits)
        below = (k << np.uint64(bits)) >> np.uint64(64 - 8 * KEY)
        both = np.concatenate([_bytes(below, KEY), _bytes(p, OWNER)], axis=1)
        grid = np.arange(1 << bits, dtype=np.uint64) << away
        cut, ncut = (np.append(np.searchsorted(x, grid), len(x)) for x in (k, names))
        full = np.flatnonzero((np.diff(cut) > 0) | (np.diff(ncut) > 0))
        packed = [both[cut[i] : cut[i + 1]].tobytes() for i in full.tolist()]
        named = [names[ncut[i] : ncut[i + 1]].astype("<u8").tobytes() for i in full.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(named, pa.binary())], names=["unit", "keys", "names"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        rows = 0
        for whole in parts:
            for part in batches(whole, "__text"):
                p = Paragraphs(part.column(0))
                banded = p.banded()
                for x, y in zip(held, (p.name, p.keys(banded), p.name[banded]), strict=True):
                    x.append(y)
                rows += len(p.name)
                if rows >= PACKED:
                    yield flush(*held)
                    held, rows = ([], [], []), 0
        if rows:
            yield flush(*held)

    return run


def _met(bits: int):
    """(named, k): bucket keys in which different names meet, and names that occur again."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(parts, 64):
            size = [len(x) // (KEY + OWNER) for x in t["keys"].to_pylist()]
            unit = np.repeat(t["unit"].to_numpy().astype(np.uint64), size) << np.uint64(64 - bits)
            raw = np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint8).reshape(-1, KEY + OWNER)
            k = unit | (_numbers(raw[:, :KEY]) << np.uint64(64 - 8 * KEY)) >> np.uint64(bits)
            k, p = _short(k, bits), _numbers(raw[:, KEY:])
            order = np.argsort(k)
            k, p = k[order], p[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
            keys = k[first][np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first)] if len(k) else k
            names = np.sort(np.frombuffer(b"".join(t["names"].to_pylist()), "<u8"))
            names = names[1:][names[1:] == names[:-1]]
            names = names[np.r_[True, names[1:] != names[:-1]][: len(names)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([False, True], [len(keys), len(names)])), pa.array(np.concatenate([keys, names]).view(np.int64))], names=["named", "k"])

    return run


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Component labels of sets linked by Jaccard similarity, breadth first: what is reached is compared with what isn't only."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    label = np.arange(n)
    order = np.argsort(flat, kind="stable")
    values, who = flat[order], owner[order]
    fresh = np.ones(n, bool)
    for seed in range(n):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        front = [seed]
        while front:
            k = front.pop()
            if not fresh.any():
                return label
            # sets that share a shingle with this one, by one search in the sorted shingles
            a, z = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
            reach = np.repeat(a, z - a) + np.arange(int((z - a).sum())) - np.repeat(np.cumsum(z - a) - (z - a), z - a)
            near = who[reach]
            near = near[fresh[near]]
            shared = np.bincount(near, minlength=n)
            m = np.flatnonzero(shared)
            m = m[shared[m] >= similarity * (size[k] + size[m] - shared[m]) - 1e-12]
            fresh[m] = False
            label[m] = seed
            front += m.tolist()
    return label


def _verified(similarity: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(parts, 4000):
            unit, p = t["unit"].to_numpy(), t["p"].to_numpy()
            sets = [_numbers(np.frombuffer(x, np.uint8).reshape(-1, GRAM)) for x in t["s"].to_pylist()]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            a, b = [], []
            for x, z in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
                if z - x == 2:
                    both = len(np.intersect1d(sets[x], sets[x + 1], assume_unique=True))
                    if both >= similarity * (len(sets[x]) + len(sets[x + 1]) - both) - 1e-12:
                        a.append(p[x : x + 1])
                        b.append(p[x + 1 : z])
                elif z - x > 1:
                    label = linked(sets[x:z], similarity)
                    k = np.flatnonzero(label != np.arange(z - x))
                    a.append(p[x + k])
                    b.append(p[x + label[k]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def paragraph_roots(texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(roots: node, root over names of paragraphs that link with a different one, but the roots themselves; again: names that occur more than once, as p)."""
    spark = texts.sparkSession
    n = partitions(spark)
    bits = (4 * n - 1).bit_length()
    packed = texts.mapInArrow(_packed(bits), "unit int, keys binary, names binary")
    met = checkpoint(packed.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(_met(bits), "named boolean, k long"))
    del packed
    release(spark)
    again = met.where("named").select(F.col("k").alias("p"))
    crowded = met.where("not named").select(F.col("k").alias("key"))
    table = sieve(crowded, "key")

    def members(part: pa.RecordBatch, p: Paragraphs) -> pa.RecordBatch:
        pick = p.banded()
        keys = _short(p.keys(pick), bits)
        good = passes(table, keys.reshape(-1)).reshape(keys.shape)
        some = good.any(axis=1)
        pick, keys, good = pick[some], keys[some], good[some]
        offsets = np.r_[0, np.cumsum(good.sum(axis=1))].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(p.name[pick].view(np.int64)), p.sets(pick), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[good].view(np.int64)))], names=["p", "s", "keys"])

    found = texts.mapInArrow(_each(members), "p long, s binary, keys array<long>").groupBy("p").agg(F.first("s").alias("s"), F.first("keys").alias("keys"))
    found = checkpoint(found)
    release(spark)
    dealt = found.select("p", "s", F.explode("keys").alias("key"))
    if table is None:  # else the sieve has let few others pass, which are alone in their buckets
        dealt = checkpoint(dealt.join(crowded, "key", "left_semi"))
    links = in_units(dealt, "key", ["p"], UNIT).select("unit", "part", "p", "s").mapInArrow(_verified(similarity), "a long, b long")
    return components(links), again


def _plan(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(listed: uid, id, th, n_run, n_line, own; plan: uid, kind, i, stays, partner for paragraphs and lines with a partner)."""
    few = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("__text"))
    roots, again = paragraph_roots(few.select("__text").where("__text is not null"), similarity)
    ends = roots.select(F.explode(F.array("node", "root")).alias("p"))
    table = sieve(checkpoint(again.unionByName(ends).distinct()), "p")

    def own(part: pa.RecordBatch, p: Paragraphs) -> pa.RecordBatch:
        n = part.num_rows
        counts = [pa.array(np.bincount(p.text[p.kind == k], minlength=n)) for k in (RUN, LINE)]
        pick = np.flatnonzero(passes(table, p.name))
        pick = pick[np.argsort(p.text[pick], kind="stable")]
        cut = np.searchsorted(p.text[pick], np.arange(n + 1)).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(p.name[pick].view(np.int64)), pa.array(p.kind[pick]), pa.array(p.index[pick].astype(np.int32))], names=["p", "k", "i"])
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts, pa.ListArray.from_arrays(pa.array(cut), rows)], names=["id", "th", "n_run", "n_line", "own"])

    kind = few.schema[0].dataType.simpleString()
    listed = few.mapInArrow(_each(own), f"id {kind}, th long, n_run long, n_line long, own array<struct<p: long, k: byte, i: int>>")
    listed = checkpoint(listed.withColumn("uid", F.monotonically_increasing_id()))
    each = listed.select("uid", "id", F.explode("own").alias("o")).select("uid", "id", "o.p", "o.k", "o.i")
    # names are few beside their occurrences, so classes are found over names
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "i")
    names = each.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    names = checkpoint(names.join(roots, names["p"] == roots["node"], "left").select("p", "n", "first", F.coalesce("root", "p").alias("root")))
    classes = checkpoint(names.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").select("root", "first"))
    known = checkpoint(join_unique(names.select("p", "root"), classes, "root").select("p", F.col("first.uid").alias("f_uid"), F.col("first.i").alias("f_i"), F.col("first.id").alias("f_id")))
    plan = join_unique(each, known, "p").select("uid", "k", "i", ((F.col("uid") == F.col("f_uid")) & (F.col("i") == F.col("f_i"))).alias("stays"), F.col("f_id").alias("partner"))
    return listed, checkpoint(plan)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, n_paragraphs, n_linked (with an equal or similar paragraph anywhere else), n_removed (not the first of their component), first_with (smallest id that holds the first of any of them), and the same counts of lines with a word: n_lines, n_lines_linked, n_lines_removed.

    A text of fewer than LEAST_WORDS words is one paragraph; paragraphs of fewer
    words than a shingle, and all lines, are compared by equality.  Null and empty texts, and
    those without words, have none.  Of repeated rows the first keeps its paragraphs.
    """
    listed, plan = _plan(docs, id_col, text_col, similarity)
    sums = plan.groupBy("uid").agg(
        *(F.count_if((F.col("k") == k) & some).alias(f"{name}{k}") for k in (RUN, LINE) for name, some in (("linked", F.lit(True)), ("gone", ~F.col("stays")))),
        F.min(F.when(F.col("k") == RUN, F.col("partner"))).alias("first_with"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return listed.join(sums, "uid", "left").select(
        F.col("id").alias(id_col), F.col("n_run").alias("n_paragraphs"), zero("linked0").alias("n_linked"), zero("gone0").alias("n_removed"), "first_with",
        F.col("n_line").alias("n_lines"), zero("linked1").alias("n_lines_linked"), zero("gone1").alias("n_lines_removed"),
    )


def _without(part: pa.RecordBatch, p: Paragraphs, text_at: int, gone_at: int) -> pa.Array:
    """The part's texts without the paragraphs and lines that its column of (kind, index) lists."""
    texts = part.column(text_at).to_pylist()
    wanted = part.column(gone_at).to_pylist()
    where: dict[tuple[int, int, int], int] = {}
    some = np.isin(p.text, np.array([k for k, w in enumerate(wanted) if w], np.int64))
    for k in np.flatnonzero(some).tolist():
        where[int(p.text[k]), int(p.kind[k]), int(p.index[k])] = k
    for t, w in enumerate(wanted):
        if not w:
            continue
        raw = texts[t].encode()
        drop = np.zeros(len(raw) + 1, np.int32)
        for x in w:
            a, z = p.span(where[t, x["k"], x["i"]])
            if x["k"] == LINE:
                a, z = raw.rfind(b"\n", 0, a) + 1, raw.find(b"\n", z) + 1
                if not z:  # the last line takes the break before it
                    a, z = max(a - 1, 0), len(raw)
            drop[a] += 1
            drop[z] -= 1
        keep = np.cumsum(drop[:-1]) == 0
        texts[t] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "replace")
    return pa.array(texts, part.column(text_at).type)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the paragraphs and lines that are not the first of their component; columns as given.

    A word goes if a paragraph that goes covers it, from its first byte to its last
    word's last; so a passage loses its paragraphs, and up to its edges a few words
    beyond them stay.  Repeated rows are treated alike, as the first of them.
    """
    listed, plan = _plan(docs, id_col, text_col, similarity)
    gone = plan.where("not stays").groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("k", "i"))).alias("g"))
    # of rows with one id and text the one that loses least stands for all
    rows = listed.join(gone, "uid", "left").groupBy("id", "th").agg(F.min(F.struct(F.coalesce(F.size("g"), F.lit(0)).alias("n"), "g")).alias("x"))
    gone = checkpoint(rows.where("x.n > 0").select("id", "th", F.col("x.g").alias("__gone")))
    found = sieve(gone, "th")
    marked = docs.withColumn("__th", F.xxhash64(F.col(text_col)))
    columns = docs.columns
    at = len(columns)

    def split(wanted: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield part.filter(pa.array(passes(found, part.column(at).to_numpy().view(np.uint64)) == wanted))

        return run

    d, g = marked.mapInArrow(split(True), marked.schema).alias("d"), gone.alias("g")
    joined = d.join(g, F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (F.col("d.__th") == F.col("g.th")), "left").select(*[F.col(f"d.`{c}`") for c in columns], F.col("g.__gone"))

    def cut(part: pa.RecordBatch, p: Paragraphs) -> pa.RecordBatch:
        k = part.schema.get_field_index(text_col)
        new = _without(part, p, k, at)
        return pa.RecordBatch.from_arrays([new if i == k else part.column(i) for i in range(at)], names=columns)

    return joined.mapInArrow(_each(cut, text_col), docs.schema).unionByName(marked.mapInArrow(split(False), marked.schema).select(*columns))
