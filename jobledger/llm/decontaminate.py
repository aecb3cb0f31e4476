"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Items' words become integers and each item is fed to one automaton.  Training
tokens are streamed through it; at each word the automaton tells the longest
suffix that occurs in some item.  Where that reaches a window (`length` words, or
a whole shorter item) the window's words are hit.  A bigram table first rules out
stretches in which no window can lie, so that only short chains are walked.

The automaton is built once for each block of items, on the driver, and sent as
sorted arrays; a task walks all its stretches through it in lockstep.  Benchmark
text is measured before anything is collected: at most BLOCK_BYTES of it make one
automaton, and a larger benchmark is taken in blocks of items, one pass each, of
which MOST_BLOCKS at most are alive at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.tables import checkpoint
from jobledger.llm.textkit import batches, column_bytes, words

#: Item text of which one automaton is built and sent to executors, and passes between two checkpoints.
BLOCK_BYTES, MOST_BLOCKS = 2 << 20, 8


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences (words below `n_words`), as sorted arrays, with the items in which each window occurs."""

    def __init__(self, items: list[list[int]], length: int, n_words: int):
        self.n_words = max(1, n_words)
        nxt: list[dict[int, int]] = [{}]
        link, depth = [-1], [0]

        def split(p: int, q: int, c: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            depth.append(depth[p] + 1)
            link.append(link[q])
            link[q] = clone
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            return clone

        def extend(last: int, c: int) -> int:
            q = nxt[last].get(c)
            if q is not None:
                return q if depth[q] == depth[last] + 1 else split(last, q, c)
            cur = len(nxt)
            nxt.append({})
            depth.append(depth[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if depth[q] == depth[p] + 1 else split(p, q, c)
            return cur

        for item in items:
            last = 0
            for word in item:
                last = extend(last, word)
        size = np.fromiter(map(len, nxt), np.int64, len(nxt))
        state = np.repeat(np.arange(len(nxt)), size)
        word = np.fromiter((c for d in nxt for c in d), np.int64, int(size.sum()))
        goal = np.fromiter((q for d in nxt for q in d.values()), np.int64, int(size.sum()))
        order = np.argsort(state * self.n_words + word)
        #: Transitions by state * n_words + word.
        self.edge, self.goal = (state * self.n_words + word)[order], goal[order].astype(np.int32)
        self.link, self.depth = np.array(link, np.int32), np.array(depth, np.int32)
        windows = [min(length, len(i)) for i in items]
        self.sizes = sorted({n for n in windows if n})
        #: For each window size the state that holds a state's last so many words.
        self.holder = {n: self._holders(n) for n in self.sizes}
        # items of each (window size, state)
        flat = np.array([w for i in items for w in i], np.int64)
        first = np.cumsum([0, *map(len, items)])
        found = {n: ([], []) for n in self.sizes}
        for n in self.sizes:
            of = [k for k, w in enumerate(windows) if w == n]
            tokens = np.concatenate([flat[first[k] : first[k + 1]] for k in of])
            starts = np.cumsum([0, *(len(items[k]) for k in of)])
            chain, _, states, _ = self.walk(tokens, starts[:-1], starts[1:], {n})
            found[n] = np.unique(np.stack([states, np.array(of)[chain]], axis=1), axis=0).T
        #: Sorted states with a window of each size, and the items of each.
        self.states = {n: np.unique(found[n][0]) for n in self.sizes}
        self.of = {n: (found[n][1], np.searchsorted(found[n][0], np.append(self.states[n], len(nxt)))) for n in self.sizes}

    def _holders(self, n: int) -> np.ndarray:
        out = np.arange(len(self.link))
        for s in np.argsort(self.depth, kind="stable").tolist():
            up = self.link[s]
            if up >= 0 and self.depth[up] >= n:
                out[s] = out[up]
        return out

    def walk(self, tokens: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: set[int]) -> tuple[np.ndarray, ...]:
        """Streams tokens[start:end] of every chain through the automaton at once; unknown tokens (below 0) match nothing.

        Wherever the longest matching length reaches one of `sizes`: (chain, end of
        the window in tokens, state that holds the window, its size), one entry each.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        live = np.argsort(start - end, kind="stable")
        span = (end - start)[live]
        state, n = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(int(span[0]) if len(span) else 0):
            k = int(np.searchsorted(-span, -step, "left"))  # the chains still longer than this
            live, span, state, n = live[:k], span[:k], state[:k], n[:k]
            c = tokens[start[live] + step]
            open_ = np.arange(k)
            while len(open_):
                key = state[open_] * self.n_words + c[open_]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                found = (self.edge[at] == key) & (c[open_] >= 0)
                hit = open_[found]
                state[hit] = self.goal[at[found]]
                n[hit] += 1
                open_, root = open_[~found], state[open_[~found]] == 0
                n[open_[root]] = 0
                open_ = open_[~root]
                state[open_] = self.link[state[open_]]
                n[open_] = self.depth[state[open_]]
            for want in sizes:
                reached = np.flatnonzero(n >= want)
                if len(reached):
                    out.append((live[reached], start[live[reached]] + step + 1, self.holder[want][state[reached]], want))
        if not out:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing, nothing
        return (*(np.concatenate([o[i] for o in out]) for i in range(3)), np.repeat([o[3] for o in out], [len(o[0]) for o in out]))

    def hits(self, tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(chain, start, end, items) of every window occurrence."""
        chain, stop, state, size = self.walk(tokens, start, end, set(self.sizes))
        for n in self.sizes:
            some = np.flatnonzero(size == n)
            at = np.searchsorted(self.states[n], state[some])
            at[at == len(self.states[n])] = 0
            good = self.states[n][at] == state[some]
            items, first = self.of[n]
            for k, x in zip(some[good].tolist(), at[good].tolist(), strict=True):
                yield int(chain[k]), int(stop[k]) - n, int(stop[k]), items[first[x] : first[x + 1]]


class Matcher:
    """Items as word numbers with their automaton; finds hit words of whole texts."""

    def __init__(self, rows: list[tuple[str | None, str]], length: int):
        texts = pa.array([t or "" for _, t in rows], pa.large_string())
        buf, offs = column_bytes(texts)
        s, e, h, first = words(buf, offs)
        self.names = [n for n, _ in rows]
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h)
        items = [ids[first[k] : first[k + 1]].tolist() for k in range(len(rows))]
        self.automaton = SuffixAutomaton(items, length, len(self.vocabulary))
        self.least = min((min(length, len(i)) for i in items if i), default=0)
        self.n = np.uint64(len(self.vocabulary) + 1)
        pairs = [ids[first[k] : first[k + 1]] for k in range(len(rows))]
        codes = [p[:-1].astype(np.uint64) * self.n + p[1:].astype(np.uint64) for p in pairs if len(p) > 1]
        self.bigrams = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        low = lambda a, z: bytes(buf[a:z]).lower()
        self.spelling = {int(k): low(a, z) for k, a, z in zip(ids.tolist(), s.tolist(), e.tolist(), strict=True)}

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at, -1)

    def chains(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of word ranges that may hold a window: all adjacent pairs occur in items, long enough for the least window."""
        if not self.least or not len(ids):
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing
        known = ids >= 0
        tied = np.zeros(len(ids), bool)
        code = np.where(known[:-1] & known[1:], ids[:-1] * int(self.n) + ids[1:], -1).astype(np.int64)
        if len(self.bigrams):
            big = self.bigrams.astype(np.int64)
            at = np.searchsorted(big, code)
            at[at == len(big)] = 0
            tied[1:] = big[at] == code
        begins = first[:-1]
        tied[begins[begins < len(ids)]] = False
        cut = np.flatnonzero(~tied)
        ends = np.r_[cut[1:], len(ids)]
        good = known[cut] & (ends - cut >= self.least)
        return np.searchsorted(first, cut[good], "right") - 1, cut[good], ends[good]

    def scan(self, texts: pa.Array) -> tuple[list[list[tuple[int, int]]], list[set[int]], np.ndarray, tuple]:
        """For each text: merged hit ranges in words and items found; numbers of words; (starts, ends, first) of all words."""
        buf, offs = column_bytes(texts)
        s, e, h, first = words(buf, offs)
        ids = self.ids(h)
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        items: list[set[int]] = [set() for _ in range(len(texts))]
        of, start, end = self.chains(ids, first)
        for a, z in zip(start.tolist(), end.tolist(), strict=True):  # hashes are held against the words themselves
            for k in range(a, z):
                if bytes(buf[s[k] : e[k]]).lower() != self.spelling[int(ids[k])]:
                    ids[k] = -1
        for chain, x, y, found in self.automaton.hits(ids, start, end):
            k = int(of[chain])
            items[k].update(found.tolist())
            ranges[k].append((x - int(first[k]), y - int(first[k])))
        return [merged(r) for r in ranges], items, np.diff(first), (s, e, first)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks whose text stays under BLOCK_BYTES or so; null texts left out, null ids kept."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = int(size // BLOCK_BYTES) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield sorted(((r.i, r.t) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def find_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length: int = 10, item_col: str = "item_id", item_text: str = "text", finish=None) -> DataFrame:
    """docs with __n_words, __spans (hit ranges in words, merged), __items (names of items with occurring windows, sorted, null last).

    `finish` makes something else of a batch, its merged spans and its words in
    the last pass; the result then has the columns of docs.
    """
    spark, columns = docs.sparkSession, docs.columns
    out = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__spans": F.expr("cast(array() as array<struct<a: long, z: long>>)"), "__items": F.expr("cast(array() as array<string>)")})
    shape = out.schema
    blocks = blocks_of(benchmark, item_col, item_text)
    following = next(blocks)
    alive = []
    while following is not None:
        sent = spark.sparkContext.broadcast(Matcher(following, length))
        alive.append(sent)
        following = next(blocks, None)
        last = finish if following is None else None

        def run(parts: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for whole in parts:
                for part in batches(whole, text_col):
                    at = part.schema.get_field_index
                    spans, items, n, found = matcher.scan(part.column(at(text_col)))
                    old_spans, old_items = part.column(at("__spans")).to_pylist(), part.column(at("__items")).to_pylist()
                    spans = [merged([(x["a"], x["z"]) for x in o] + s) if o else s for o, s in zip(old_spans, spans, strict=True)]
                    if last:
                        yield last(part, spans, n, found)
                        continue
                    names = [sorted({*o, *(matcher.names[i] for i in s)}, key=lambda x: (x is None, x or "")) if s else o for o, s in zip(old_items, items, strict=True)]
                    kept = [part.column(at(c)) for c in columns]
                    kind = part.schema.field(at("__spans")).type
                    new = [pa.array(n, pa.int64()), pa.array([[{"a": a, "z": z} for a, z in s] for s in spans], kind), pa.array(names, part.schema.field(at("__items")).type)]
                    yield pa.RecordBatch.from_arrays([*kept, *new], names=[*columns, "__n_words", "__spans", "__items"])

        out = out.mapInArrow(run, docs.schema if last else shape)
        if len(alive) == MOST_BLOCKS and following is not None:
            out = checkpoint(out)
            for done in alive:
                done.destroy()
            alive = []
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 10) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and no hits.  Equal items count each; an
    item without words never occurs; items without an id hit as others do, count
    as one in n_items and have no name in items_sha256.  Repeated rows give repeated rows; an empty
    benchmark hits nothing.
    """
    found = find_spans(docs.select(id_col, text_col), benchmark, text_col, length)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, x: acc + x["z"] - x["a"])
    return found.select(
        id_col,
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without benchmark passages; columns as given.

    Hit words go, from the first byte of a span to the last, with the rest of the
    text as it was; a document of which more than `max_coverage` of the words is
    hit goes wholly.  Documents without a hit, null and empty texts stay as they are.
    """
    columns = docs.columns

    def finish(part: pa.RecordBatch, spans: list, n: np.ndarray, found: tuple) -> pa.RecordBatch:
        at = part.schema.get_field_index
        texts = part.column(at(text_col))
        keep = [sum(z - a for a, z in own) <= max_coverage * k for own, k in zip(spans, n.tolist(), strict=True)]
        if any(spans):
            buf, offs = column_bytes(texts)
            s, e, first = found
            new = texts.to_pylist()
            for k, own in enumerate(spans):
                if own and keep[k]:
                    bits, now = [], int(offs[k])
                    for a, z in own:
                        bits.append(bytes(buf[now : int(s[first[k] + a])]))
                        now = int(e[first[k] + z - 1])
                    bits.append(bytes(buf[now : offs[k + 1]]))
                    new[k] = b"".join(bits).decode("utf-8", "replace")
            texts = pa.array(new, texts.type)
        out = pa.RecordBatch.from_arrays([texts if c == text_col else part.column(at(c)) for c in columns], names=columns)
        return out.filter(pa.array(keep))

    return find_spans(docs, benchmark, text_col, length, finish=finish)
