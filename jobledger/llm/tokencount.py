"""Exact token counts at every prefix, by dynamic programming over a BPE vocabulary with byte fallback.

A token sequence is the encoding of a text exactly if each adjacent pair of its
tokens encodes to itself.  So the last token of each prefix follows from those of
shorter prefixes: prefix[:k] ends in the one token t whose predecessor, the last
token of prefix[:k-len(t)], forms such a pair with it.  One pass stores the count
at every prefix; truncation and budget questions read it and encode nothing.

Words are the program's units: no piece of the vocabulary holds a space mark behind
another character, so merges never cross into a new word, and counts of words,
cached by word, add up.  That and whatever else the program takes for granted is
checked when a model is loaded; the library is asked in the tests only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words of up to this many characters are cached in two generations of up to so many words each, so that frequent ones stay.
CACHED_CHARS, CACHED_WORDS = 48, 700_000


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback and the identity normaliser.

    ValueError for a model on which the program would not be exact: other kinds of
    models or normalisers, user-defined or unused pieces, bytes without a piece,
    pieces with a character that is none, and pieces that cross into a new word.
    """

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("this counter needs the identity normaliser, a dummy prefix and kept white space")
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this counter needs a BPE model with space marks before words")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("this counter knows no user-defined or unused pieces")
        if {p.piece for p in proto.pieces if p.type == kinds.BYTE} != {f"<0x{k:02X}>" for k in range(256)}:
            raise ValueError("this counter needs a piece for every byte")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses into a new word")
        if any(c not in self.score for p in self.score for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.breaks_line = not any("\n" in p for p in self.score)
        self.cache: dict[str, int] = {}  # words behind one space
        self.older: dict[str, int] = {}  # the words before the last CACHED_WORDS new ones
        self.parts: dict[str, int] = {}  # parts with their space marks
        #: For each piece the pieces (or nothing) known to stand before it, and whether they may.
        self._before: dict[str, dict[str, bool]] = {p: {} for p in self.score}
        self._known = 0
        lengths: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        #: Lengths of pieces by their last three characters, longest first.
        self._lengths = {k: (*sorted(v, reverse=True), 2) for k, v in lengths.items()}

    def _merge(self, text: str) -> list[str]:
        """Plain BPE of a short text of known characters: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: str, b: str) -> bool:
        """Whether two pieces side by side, or b alone behind nothing, are their own encoding."""
        if self._known > 2_000_000:
            self._before, self._known = {p: {} for p in self.score}, 0
        good = self._before[b][a] = self._merge(a + b) == ([a, b] if a else [b])
        self._known += 1
        return good

    def dp(self, word: str, count: list[int] | None = None, last: list[str] | None = None) -> list[int]:
        """Token counts of word[:0], word[:1], ..., where `word` holds its space marks.

        `count` and `last` may hold what is known for a prefix; they are continued.
        """
        score, lengths, short = self.score, self._lengths, (2,)
        if count is None or last is None:
            count, last = [0], [""]
        for k in range(len(count), len(word) + 1):
            one = word[k - 1]
            if one not in score:  # no piece holds it: its bytes, and nothing merges with them
                count.append(count[-1] + len(one.encode("utf-8", "surrogatepass")))
                last.append("")
                continue
            for n in lengths.get(word[k - 3 : k], short) if k > 2 else short[: k - 1]:
                if n > k:
                    continue
                t = word[k - n : k]
                known = self._before.get(t)
                if known is not None:
                    before = last[k - n]
                    good = known.get(before)
                    if good is None:
                        good = self._fits(before, t)
                    if good:
                        count.append(count[k - n] + 1)
                        last.append(t)
                        break
            else:
                count.append(count[-1] + 1)
                last.append(one)
        return count

    def learn(self, texts: list[str]) -> None:
        """Counts the texts' new words beforehand in order, so that each continues what is known of the prefix it shares with the one before."""
        new = {w for t in texts for w in t.split(" ")}
        count, last, before = [0], [""], ""
        for word in sorted(w for w in new if w and len(w) <= CACHED_CHARS and w not in self.cache):
            if MARK in word or self.breaks_line and "\n" in word:
                continue
            n = self.older.get(word)
            if n is None:
                marked = MARK + word
                k = 0
                for x, y in zip(before, marked, strict=False):
                    if x != y:
                        break
                    k += 1
                del count[k + 1 :], last[k + 1 :]
                n = self.dp(marked, count, last)[-1]
                before = marked
            self._keep(word, n)

    def _keep(self, word: str, n: int) -> None:
        if len(self.cache) >= CACHED_WORDS:
            self.older, self.cache = self.cache, {}
        self.cache[word] = n

    def _parts(self, text: str) -> Iterator[str]:
        """The text with space marks, cut before each run of them and at line ends; concatenated they are the marked text."""
        if not text:
            return
        run = ""
        for k, word in enumerate(text.replace(MARK, " ").split(" ")):
            if word == "":
                run += MARK
                continue
            marked = run + MARK + word
            run = ""
            if self.breaks_line and "\n" in marked:
                lines = marked.split("\n")
                for i, line in enumerate(lines):
                    if line:
                        yield line
                    if i < len(lines) - 1:
                        yield "\n"
            else:
                yield marked
        if run:
            yield run

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text[:len(text)]; of the empty text 0."""
        out = [np.zeros(1, np.int64)]
        total = 0
        for part in self._parts(text):
            c = np.asarray(self.dp(part)[1:], np.int64) + total
            total = int(c[-1])
            out.append(c)
        counts = np.concatenate(out)
        if len(counts) == 1:
            return counts
        counts = counts[1:].copy()  # the dummy prefix is a mark of its own: marked text is one character longer
        counts[0] = 0
        return counts

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        fits = np.flatnonzero(self.prefix_counts(text) <= budget)
        return text[: int(fits[-1])] if len(fits) else ""

    def _small(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            n = self.dp(part)[-1]
            if len(part) <= CACHED_CHARS:
                if len(self.parts) >= CACHED_WORDS:
                    self.parts.clear()
                self.parts[part] = n
        return n

    def _word(self, word: str) -> int:
        """Tokens of a word behind one space, which isn't in the cache."""
        n = self.older.get(word)
        if n is None:
            n = sum(map(self._small, self._parts(word))) if self.breaks_line and "\n" in word else self.dp(MARK + word)[-1]
        if len(word) <= CACHED_CHARS:
            self._keep(word, n)
        return n

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last of its prefix counts."""
        if not text:
            return 0
        words = text.split(" ")
        if "" in words or MARK in text:
            return sum(map(self._small, self._parts(text)))
        counts = list(map(self.cache.get, words))
        return sum(self._word(words[at]) if n is None else n for at, n in enumerate(counts))


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    """One counter, with its cache, for each worker and model."""
    return PrefixCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens (no begin, end or added special tokens), over_limit.

    A null or empty text has 0 of each.  Repeated rows and null ids are counted like any other row; no rows give none.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(model_file)
        for part in parts:
            texts = part.column(1).to_pylist()
            for at in range(0, len(texts), 1024):
                by.learn([t for t in texts[at : at + 1024] if t])
            n = pa.array([by.count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], names=[id_col, "n_bytes", "n_tokens"])

    few = docs.select(id_col, F.col(text_col).alias("__text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = few.schema[0].dataType.simpleString()
    return few.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def truncate_to_budget(docs: DataFrame, model_file: str, budget: int, text_col: str = "text") -> DataFrame:
    """Every text cut to its longest prefix of at most `budget` tokens; null stays null."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        by = counter(model_file)
        return texts.map(lambda t: None if t is None else t if by.count(t) <= budget else by.truncate(t, budget))

    return docs.withColumn(text_col, cut(F.col(text_col)))
