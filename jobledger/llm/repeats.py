"""Exact removal of long repeated substrings by a hash-compared suffix sort.

A byte goes if a `length`-byte string that covers it also starts anywhere else.

Sorting every suffix of a corpus would move many times its size.  Instead each
window of `length` bytes picks one anchor, its least-hashed run of `gram` bytes:
equal windows pick anchors at equal places, so only suffixes at anchors are
needed, about one in seventy.  Anchors of one content meet by a shuffled count, and
those that occur again move with the bytes around them to a task for each content.
There suffixes are merge-sorted, compared by prefix polynomial hashes and binary
search for their common extension, the common prefixes of neighbours are verified
byte by byte, and a window occurs again if neighbours share its right part and its
left part hashes alike (verified against the bytes as well).  Equal surroundings are
compared as bytes before they count as one.

Contents with more than HOT surroundings are split by further bytes: windows that
begin b0 to b1 bytes before the anchor all hold the b0 bytes before it and the
bytes behind it up to where the last of them ends, so surroundings go to one task
for each such range of windows and those bytes, and are sorted there alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.simhash import whole_units
from jobledger.llm.tables import checkpoint, join_unique, partitions, passes, release, sieve
from jobledger.llm.textkit import _INV, _POW, column_bytes, mix

LENGTH, GRAM = 200, 64
#: Positions that are anchored at once; their numbers fill the low bits of the least hash.
_PLACES = 18
#: Surroundings of one anchor content that one task resolves, and windows of one range where there are more.
HOT, RANGE = 4_000, 17
_CLASH = "two different strings have one 64-bit hash; change the base in textkit"


def _prefix(buf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _POW.upto(len(buf)), out=total[1:])
    return total


def _hash(total: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (total[z] - total[a]) * _INV.upto(len(total))[a]


def _pieces(offs: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first byte, end byte, first text, end text, bytes of the first text skipped): neighbouring texts together, long ones cut with windows overlapping."""
    most, k = 1 << _PLACES, 0
    while k < len(offs) - 1:
        if offs[k + 1] - offs[k] > most:
            a = int(offs[k])
            while True:
                z = min(a + most, int(offs[k + 1]))
                yield a, z, k, k + 1, a - int(offs[k])
                if z == offs[k + 1]:
                    break
                a = z - length + 1
            k += 1
            continue
        to = max(k + 1, int(np.searchsorted(offs, offs[k] + most, "right")) - 1)
        yield int(offs[k]), int(offs[to]), k, to, 0
        k = to


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[dict[str, np.ndarray]]:
    """Anchors with the windows that chose them: text, start (first window, in the text), at (anchor behind start), more (windows besides the first), gram hash h, hash of the whole stretch full."""
    width = length - gram + 1
    for a, z, k, to, skipped in _pieces(offs, length):
        n = z - a
        if n < length:
            continue
        piece = buf[a:z]
        total = _prefix(piece)
        inv = _INV.upto(n + 1)
        g = mix((total[gram:] - total[: n - gram + 1]) * inv[: n - gram + 1])
        low = np.uint64((1 << _PLACES) - 1)
        least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(g) - width + 1], least[width - size :])
        place = (least & low).astype(np.int64)
        begins = np.maximum(offs[k:to] - a, 0)
        ends = np.minimum(offs[k + 1 : to + 1] - a, n)
        windows = np.zeros(len(place) + 1, np.int32)
        long_ = ends - begins >= length
        np.add.at(windows, begins[long_], 1)
        np.add.at(windows, ends[long_] - length + 1, -1)
        valid = np.flatnonzero(np.cumsum(windows[:-1]) > 0)
        if not len(valid):
            continue
        at = place[valid]
        text = np.searchsorted(begins, valid, "right") - 1
        new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
        s = valid[new]
        e = valid[np.r_[np.flatnonzero(new)[1:], len(valid)] - 1]
        at, text = at[new], text[new]
        full = mix(_hash(total, s, e + length) + (at - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        yield {"text": text + k, "start": s - begins[text] + skipped, "at": at - s, "more": e - s, "h": g[at], "full": full, "byte": s + a}


def _each(column: str, keep: list[str], length: int, gram: int, make):
    """A mapInArrow function that hands every piece's anchors to make(anchors, kept columns, bytes)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index
            buf, offs = column_bytes(part.column(at(column)))
            for found in anchors(buf, offs, length, gram):
                out = make(found, {c: part.column(at(c)) for c in keep}, buf)
                if out is not None and out.num_rows:
                    yield out

    return run


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(found: dict, kept: dict, buf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_long(found["h"]), _long(found["full"])], names=["h", "full"])


def _surroundings(table: bytes | None, other: bytes | None, length: int):
    """Anchors that `table` lets pass and `other` (if there is one) does not, equal ones of a piece once, with their bytes where the task has not sent them before."""
    seen: dict[int, bytes] = {}

    def make(found: dict, kept: dict, buf: np.ndarray) -> pa.RecordBatch:
        good = passes(table, found["h"])
        if other is not None:
            good &= ~passes(other, found["h"])
        pick = np.flatnonzero(good)
        key = mix(found["h"][pick] ^ found["full"][pick])
        _, one, times = np.unique(key, return_index=True, return_counts=True)
        a = found["byte"][pick]
        z = a + found["more"][pick] + length
        sent: dict[int, bytes | None] = {}
        for k, x, y in zip(key.tolist(), a.tolist(), z.tolist(), strict=True):
            own = buf[x:y].tobytes()
            known = seen.get(k)
            if known is None:
                if len(seen) > 50_000:
                    seen.clear()
                seen[k] = sent[k] = own
            elif known != own:
                raise ArithmeticError(_CLASH)
        pick = pick[one]
        kinds = {"h": _long(found["h"][pick]), "full": _long(found["full"][pick]), "times": pa.array(times.astype(np.int64)), "at": pa.array(found["at"][pick].astype(np.int32)), "more": pa.array(found["more"][pick].astype(np.int32))}
        return pa.RecordBatch.from_arrays([*kinds.values(), pa.array([sent.get(k) for k in key[one].tolist()], pa.binary())], names=[*kinds, "bytes"])

    return make


def _placed(table: bytes):
    def make(found: dict, kept: dict, buf: np.ndarray) -> pa.RecordBatch:
        pick = np.flatnonzero(passes(table, found["h"]))
        text = pa.array(found["text"][pick])
        return pa.RecordBatch.from_arrays([_long(found["h"][pick]), _long(found["full"][pick]), *(c.take(text) for c in kept.values()), pa.array(found["start"][pick]), pa.array(found["more"][pick].astype(np.int32))], names=["h", "full", *kept, "start", "more"])

    return make


class Suffixes:
    """Suffixes from given places of a byte array: compared by prefix hashes and binary search, merge-sorted within runs."""

    def __init__(self, buf: np.ndarray, place: np.ndarray, end: np.ndarray):
        self.buf, self.place, self.end, self.total = buf, place, end, _prefix(buf)
        _INV.upto(len(self.total))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j: the longest with equal hashes."""
        p, q = self.place[i], self.place[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.end[i] - p, self.end[j] - q)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = _hash(self.total, p, p + mid) == _hash(self.total, q, q + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j; equal ones as `ties` says."""
        n = self.common(i, j)
        p, q = self.place[i] + n, self.place[j] + n
        i_ends, j_ends = p == self.end[i], q == self.end[j]
        top = len(self.buf) - 1
        less = self.buf[np.minimum(p, top)] < self.buf[np.minimum(q, top)]
        return np.where(i_ends & j_ends, ties, np.where(i_ends, True, np.where(j_ends, False, less)))

    def sort(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of all suffixes, sorted within each run (first, size): bottom-up mergesort of all runs at once."""
        order = np.arange(len(self.place))
        run = np.repeat(np.arange(len(first)), size)
        inside = order - first[run]
        begin, n = first[run], size[run]
        width = 1
        while width < (size.max() if len(size) else 0):
            block = inside // width
            left = block % 2 == 0
            other = np.where(left, block + 1, block - 1) * width
            low = np.minimum(other, n)
            start, high = low.copy(), np.minimum(other + width, n)
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) >> 1
                # the sibling's element comes before ours if it is less, or equal and from the left half
                less = self.before(order[begin[k] + mid], order[k], ~left[k])
                low[k], high[k] = np.where(less, mid + 1, low[k]), np.where(less, high[k], mid)
            goal = begin + (block // 2) * 2 * width + (inside - block * width) + (low - start)
            new = np.empty_like(order)
            new[goal] = order
            order = new
            width *= 2
        return order


def recurring(run: np.ndarray, times: np.ndarray, at: np.ndarray, more: np.ndarray, offs: np.ndarray, buf: np.ndarray, length: int) -> np.ndarray:
    """For each stretch (bytes offs[k]:offs[k+1], anchor at `at`, more+1 windows) and window: whether the window occurs more than once among the stretches of its run, each counted `times`."""
    n = len(run)
    place, end = offs[:-1] + at, offs[1:]
    suffixes = Suffixes(buf, place, end)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    order = suffixes.sort(first, np.diff(np.r_[first, n]))
    i, j = order[:-1], order[1:]
    shared = np.where(run[i] == run[j], suffixes.common(i, j), 0)
    # verification: the bytes of neighbours' common prefixes
    steps = np.arange(length)
    for a in range(0, n - 1, 1 << 12):
        x, y, m = place[i[a : a + (1 << 12)]], place[j[a : a + (1 << 12)]], shared[a : a + (1 << 12)]
        top = len(buf) - 1
        differ = (buf[np.minimum(x[:, None] + steps, top)] != buf[np.minimum(y[:, None] + steps, top)]) & (steps < m[:, None])
        shared[a : a + (1 << 12)] = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
    at, more, times, place = at[order], more[order], times[order], place[order]
    shared = np.r_[0, shared]
    found = np.zeros((n, int(more.max()) + 1 if n else 0), bool)
    deepest, leader = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for back in range(int(at.max()) + 1 if n else 0):
        use = np.flatnonzero((at >= back) & (at - back <= more))
        if not len(use):
            continue
        group = np.cumsum(shared < length - back)[use].astype(np.uint64)
        key = mix(_hash(suffixes.total, place[use] - back, place[use]) ^ mix(group))
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        again = np.bincount(inverse, times[use])[inverse] > 1
        hit = use[again]
        found[hit, at[hit] - back] = True
        deepest[hit], leader[hit] = back, use[one[inverse[again]]]
    # verification: the deepest left parts against their leaders' bytes
    reach = np.arange(int(at.max()) if n else 0)
    hit = np.flatnonzero(deepest > 0)
    for a in range(0, len(hit), 1 << 12):
        k = hit[a : a + (1 << 12)]
        m = reach < deepest[k][:, None]
        x, y = np.maximum(place[k][:, None] - 1 - reach, 0), np.maximum(place[leader[k]][:, None] - 1 - reach, 0)
        if ((buf[x] != buf[y]) & m).any():
            raise ArithmeticError(_CLASH)
    out = np.empty_like(found)
    out[order] = found
    return out


def _ranges(found: np.ndarray) -> list[list[int]]:
    """Rows' true runs as first, last, first, last, ..."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    up_row, up = np.nonzero(edge == 1)
    _, down = np.nonzero(edge == -1)
    out: list[list[int]] = [[] for _ in range(len(found))]
    for r, a, z in zip(up_row.tolist(), up.tolist(), down.tolist(), strict=True):
        out[r] += [a, z - 1]
    return out


def _resolved(length: int):
    """(h, full, ranges) from rows sorted by unit and surroundings: windows that occur again in their unit as first, last, first, last, ... (null: all)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(parts, least=1000):
            unit, h, full, weight = (t[c].to_numpy() for c in ("unit", "h", "full", "times"))
            # rows with bytes sort first among those of one stretch; the others are counted
            first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (full[1:] != full[:-1])])
            times = np.add.reduceat(weight, first)
            given = np.flatnonzero(np.asarray(t["bytes"].is_valid()))
            of = first[np.searchsorted(first, given, "right") - 1]
            twins = of != given
            if twins.any() and not pc.all(pc.equal(t["bytes"].take(pa.array(given[twins])), t["bytes"].take(pa.array(of[twins])))).as_py():
                raise ArithmeticError(_CLASH)
            unit, h, full = unit[first], h[first], full[first]
            n_of = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[n_of, len(unit)])
            several = np.repeat(sizes, sizes) > 1
            alone = ~several & (times > 1)  # all surroundings of the content are equal: each window occurs again
            if alone.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[alone]), pa.array(full[alone]), pa.nulls(int(alone.sum()), pa.list_(pa.int32()))], names=["h", "full", "ranges"])
            if not several.any():
                continue
            one = t.take(pa.array(first[several]))
            unit, h, full, times = unit[several], h[several], full[several], times[several]
            buf, offs = column_bytes(one["bytes"])
            found = recurring(unit, times, one["at"].to_numpy(), one["more"].to_numpy(), offs, buf, length)
            some = found.any(axis=1)
            skip = one["skip"].to_numpy()[some]
            rows = [None if n > 1 else [x + k for x in r] for n, k, r in zip(times[some].tolist(), skip.tolist(), _ranges(found[some]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(full[some]), pa.array(rows, pa.list_(pa.int32()))], names=["h", "full", "ranges"])

    return run


def _split(width: int, length: int, gram: int):
    """Surroundings once for each range of `width` windows, cut to what these cover, in units by the bytes that all windows of the range hold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            rows: dict[str, list] = {c: [] for c in ("unit", "h", "full", "times", "at", "more", "skip", "bytes")}
            get = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            for h, full, times, at, more, skip, own in zip(*(get(c) for c in rows if c != "unit"), strict=True):
                for b0 in range(max(0, at - more) // width * width, at + 1, width):
                    b1 = min(b0 + width - 1, length - gram)
                    a, z = at - min(b1, at), at - max(b0, at - more)  # windows of the range
                    shared = own[at - b0 : at + length - b1]
                    rows["unit"].append(xxhash.xxh64_intdigest(shared, b0) ^ (h & (1 << 64) - 1))
                    for c, x in zip(list(rows)[1:], (h, full, times, at - a, z - a, skip + a, own[a : z + length]), strict=True):
                        rows[c].append(x)
            kinds = {"unit": pa.uint64(), "at": pa.int32(), "more": pa.int32(), "skip": pa.int32(), "bytes": pa.binary()}
            arrays = [pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()]
            yield pa.RecordBatch.from_arrays([arrays[0].view(pa.int64()), *arrays[1:]], names=list(rows))

    return run


_SHAPE = "unit long, h long, full long, times long, at int, more int, skip int, bytes binary"


def _dealt(rows: DataFrame, length: int) -> DataFrame:
    dealt = rows.repartition(partitions(rows.sparkSession), "unit").sortWithinPartitions(F.col("unit"), F.col("full"), F.col("bytes").isNull())
    return dealt.mapInArrow(_resolved(length), "h long, full long, ranges array<int>")


def _of_hot(met: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, full, ranges) for contents with more than HOT surroundings."""
    classes = met.groupBy("h", "full").agg(F.sum("times").alias("times"), F.first("at").alias("at"), F.first("more").alias("more"), F.first("bytes", ignorenulls=True).alias("bytes"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    sure = F.when(F.col("lo") == F.col("hi"), F.col("bytes")).otherwise(F.raise_error(F.lit(_CLASH)).cast("binary"))
    classes = checkpoint(classes.select("h", "full", "times", "at", "more", F.lit(0).alias("skip"), sure.alias("bytes")))
    again = classes.where("times > 1").select("h", "full", F.lit(None).cast("array<int>").alias("ranges"))
    ranges = checkpoint(classes.mapInArrow(_split(RANGE, length, gram), _SHAPE))
    large = checkpoint(ranges.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("unit"))
    out = again.unionByName(_dealt(ranges.join(large, "unit", "left_anti"), length))
    if large.isEmpty():
        return out
    # still as many in a range: by single windows, which need a count only
    single = checkpoint(ranges.join(large, "unit", "left_semi").drop("unit").mapInArrow(_split(1, length, gram), _SHAPE))
    twice = single.groupBy("unit").agg(F.sum("times").alias("n"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("n > 1")
    twice = checkpoint(twice.select("unit", F.when(F.col("lo") == F.col("hi"), True).otherwise(F.raise_error(F.lit(_CLASH)).cast("boolean")).alias("same")))
    return out.unionByName(join_unique(single, twice, "unit").select("h", "full", F.array("skip", "skip").alias("ranges")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, __th (text hash), __spans: byte ranges covered by windows that occur again, unmerged; only for texts that have any.

    Rows of one id and text share a row.
    """
    keep = [id_col, "__th"]
    few = docs.select(id_col, F.xxhash64(F.col(text_col)).alias("__th"), F.col(text_col).alias("__text")).where(F.octet_length("__text") >= length)
    kind = few.schema[0].dataType.simpleString()
    spark = docs.sparkSession
    counted = few.mapInArrow(_each("__text", keep, length, gram, _counted), "h long, full long")
    often = checkpoint(counted.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("full") != F.max("full")).alias("mixed")).where("n > 1"))
    release(spark)
    many = checkpoint(often.where("mixed").where(F.col("n") > HOT).select("h"))
    twice = sieve(often, "h")
    crowded = None if many.isEmpty() else sieve(many, "h")
    shape = "h long, full long, times long, at int, more int, bytes binary"
    usual = few.mapInArrow(_each("__text", keep, length, gram, _surroundings(twice, crowded, length)), shape)
    result = _dealt(usual.select(F.col("h").alias("unit"), "h", "full", "times", "at", "more", F.lit(0).alias("skip"), "bytes"), length)
    if not many.isEmpty():
        # what the sieve lets pass besides belongs to contents with fewer, which the tasks of a range resolve as well
        met = few.mapInArrow(_each("__text", keep, length, gram, _surroundings(crowded, None, length)), shape)
        result = result.unionByName(_of_hot(met, length, gram))
    result = checkpoint(result)
    release(spark)
    placed = few.mapInArrow(_each("__text", keep, length, gram, _placed(twice)), f"h long, full long, `{id_col}` {kind}, __th long, start long, more int")
    joined = placed.join(result, ["h", "full"])
    pairs = F.transform(F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(2)), lambda k: F.struct((F.col("start") + F.get("ranges", k)).alias("a"), (F.col("start") + F.get("ranges", k + 1) + length).alias("z")))
    spans = F.when(F.col("ranges").isNull(), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("more") + length).alias("z")))).otherwise(pairs)
    return joined.select(id_col, "__th", spans.alias("s")).groupBy(id_col, "__th").agg(F.flatten(F.collect_set("s")).alias("__spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((s["a"], s["z"]) for s in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def with_kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, spans (maximal removed byte ranges), kept (remaining bytes).

    Null texts count as empty; texts shorter than `length` lose nothing.  Every
    row gives a row; equal texts of that length lose all their bytes.
    """
    d = docs.select(id_col, F.xxhash64(F.col(text_col)).alias("__h"), F.col(text_col).alias("__text"))
    s = checkpoint(repeated_spans(docs, id_col, text_col, length))
    release(docs.sparkSession)
    # texts without a span need not move: a sieve of the others' hashes tells most of them
    found = sieve(s, "__th")

    def split(wanted: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield part.filter(pa.array(passes(found, part.column(1).to_numpy().view(np.uint64)) == wanted))

        return run

    moved = d.mapInArrow(split(True), d.schema).alias("d")
    s = s.alias("s")
    joined = moved.join(s, F.col(f"d.{id_col}").eqNullSafe(F.col(f"s.{id_col}")) & (F.col("d.__h") == F.col("s.__th")), "left").select(f"d.{id_col}", "__text", "__spans")
    stayed = d.mapInArrow(split(False), d.schema).select(id_col, "__text", F.lit(None).cast(s.schema["__spans"].dataType).alias("__spans"))
    joined = joined.unionByName(stayed)
    kind = joined.schema[0].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            buf, offs = column_bytes(part.column(1))
            spans = [_merged(x) for x in part.column(2).to_pylist()]
            kept = []
            for k, own in enumerate(spans):
                now, bits = int(offs[k]), []
                for a, z in own:
                    bits.append(buf[now : offs[k] + a].tobytes())
                    now = int(offs[k]) + z
                bits.append(buf[now : offs[k + 1]].tobytes())
                kept.append(b"".join(bits))
            shape = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array([[{"a": a, "z": z} for a, z in x] for x in spans], shape), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, spans array<struct<a: long, z: long>>, kept binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["z"] - x["a"])
    return with_kept_bytes(docs, id_col, text_col, length).select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
