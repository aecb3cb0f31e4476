"""Whole printed tables read at once: the same readings as in parse.py, over the columns of a table instead of cell by cell."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Currency signs, dashes that mean zero, letters read for digits, words of a total's label.
CURRENCY, DASHES, LETTERS, DIGITS = "$€£¥", ("-", "--", "–", "—", "−", "‒", "‐"), "OolI|SsBZz", "0011155822"
TOTAL_WORDS = ("total", "totals", "subtotal", "subtotals")
PERCENT_WORDS = ("%", "percent", "pct")

#: Forms that most cells have; all others are read one by one.
_WHOLE, _PARTED = r"^(\$ ?)?[0-9]{1,40}%?\z", r"^(\$ ?)?[0-9]{1,3}(,[0-9]{3}){1,12}(\.[0-9]{1,40})?%?\z"
_PLAIN = r"^(\$ ?)?([0-9]{1,40}|[0-9]{1,3}(,[0-9]{3}){1,12})(\.[0-9]{1,40})?%?\z"
_MENDED, _SPACES, _EDGES = str.maketrans(LETTERS, DIGITS), re.compile("[\u00a0 \t\n\x0b\f\r]+"), re.compile(f"^[{CURRENCY} ()%]+|[{CURRENCY} ()%]+(?=[\u0085\u2028\u2029]?\\Z)")


def clean(raw: str) -> str:
    return _SPACES.sub(" ", raw).strip(" ")


def _digits(text: str) -> bool:
    return text != "" and not text.strip("0123456789")


def _grouped(text: str, separator: str, point: str) -> bool:
    whole, *behind = text.split(point)
    first, *rest = whole.split(separator)
    return bool(rest) and len(first) <= 3 and _digits(first) and all(len(g) == 3 and _digits(g) for g in rest) and (not behind or len(behind) == 1 and _digits(behind[0]))


def _halves(text: str, point: str, most: int) -> bool:
    whole, *behind = text.split(point)
    return _digits(whole) and (not behind or len(behind) == 1 and len(behind[0]) <= most and _digits(behind[0]))


def is_us(text: str) -> bool:
    return _grouped(text, ",", ".")


def is_european(text: str) -> bool:
    return _grouped(text, ".", ",") or "," in text and _halves(text, ",", 2)


def _number(text: str, eu: bool) -> float | None:
    if _digits(text):
        return float(text)
    if eu:
        if is_european(text):
            return float(text.replace(".", "").replace(",", "."))
    else:
        ahead = text.split(",")
        if is_us(text) or len(ahead) == 2 and _digits(ahead[0]) and _halves(ahead[1], ".", 400) and len(ahead[1].split(".")[0]) == 3:
            return float(text.replace(",", ""))
    return float(text) if _halves(text, ".", 400) else None


def read_cell(raw: str, eu: bool, repair: bool) -> tuple[float | None, bool]:
    """Value and whether letters were read for digits, as parse.parse_cell has them."""
    inner = clean(raw).lstrip(CURRENCY + " ").strip(" ")
    wrapped = len(inner) > 1 and inner[0] == "(" and inner[-1] == ")"
    inner = (inner[1:-1] if wrapped else inner).lstrip(CURRENCY + " ").rstrip(" ")
    if inner == "" or inner in DASHES:
        return 0.0, False
    digits = inner.lstrip("-" + CURRENCY + " ").rstrip("% ").replace(" ", "")
    value, repaired = _number(digits, eu), False
    if value is None and repair:
        value = _number(digits.translate(_MENDED), eu)
        repaired = value is not None
    return (-value if value is not None and wrapped != (inner[0] == "-") else value), repaired


def _texts(strings: pa.Array) -> list[str]:
    return [x.decode("utf-8", "surrogateescape") for x in strings.cast(pa.large_binary()).to_pylist()]


def _strings(texts: list[str]) -> pa.Array:
    return pa.array([x.encode("utf-8", "surrogateescape") for x in texts], pa.large_binary()).view(pa.large_string())


def _match(raw: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(raw, pattern).to_numpy(zero_copy_only=False)


def _distinct(raw: pa.Array, where: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different texts at some places, and which of them each place has."""
    codes = raw.take(pa.array(np.flatnonzero(where))).dictionary_encode()
    return _texts(codes.dictionary), codes.indices.to_numpy()


def filled_cells(raw: pa.Array) -> np.ndarray:
    filled = _match(raw, "[!-~]")
    texts, which = _distinct(raw, ~filled)
    filled[~filled] = np.array([clean(x) != "" for x in texts], bool)[which]
    return filled


def read_cells(raw: pa.Array, eu: bool, repair: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values, NaN where a cell is unreadable, and whether letters were read for digits."""
    values, repaired = np.full(len(raw), np.nan), np.zeros(len(raw), bool)
    plain = _match(raw, _WHOLE if eu else _PLAIN)
    values[plain] = pc.replace_substring_regex(raw.take(pa.array(np.flatnonzero(plain))), "[$ ,%]", "").cast(pa.float64()).to_numpy()
    hard = ~plain if repair else ~plain & ~_match(raw, "[A-Za-z]")
    texts, which = _distinct(raw, hard)
    found = [read_cell(x, eu, repair) for x in texts]
    values[hard] = np.array([np.nan if v is None else v for v, _ in found], float)[which]
    repaired[hard] = np.array([r for _, r in found], bool)[which]
    return values, repaired


def is_european_table(raw: pa.Array) -> bool:
    """Whether more cells can only be European than only US."""
    parted = _match(raw, _PARTED)
    texts, which = _distinct(raw, ~parted & _match(raw, "[,.]"))
    bare = [_EDGES.sub("", clean(x)) for x in texts]
    counts = np.bincount(which, minlength=len(texts))
    us = np.array([is_us(x) for x in bare], bool)
    eu = np.array([is_european(x) for x in bare], bool) & ~us
    return bool(counts[eu].sum() > counts[us].sum() + parted.sum())


def is_total(labels: pa.Array) -> np.ndarray:
    said = _match(labels, "(?i)total")
    texts, which = _distinct(labels, said)
    said[said] = np.array([not set(TOTAL_WORDS).isdisjoint(re.split("[^a-z0-9_]+", x.lower())) for x in texts], bool)[which]
    return said


def find_totals(values: np.ndarray, said: np.ndarray, rtol: float, least: int) -> np.ndarray:
    """Reasons for which rows, in order, are totals (see parse.total_rows), else None; `least` informative columns are needed."""
    reasons = np.where(said, "label", None)
    section, body, totals = (np.zeros(values.shape[1]) for _ in range(3))
    n_section, n_body, at, ahead = 0, 0, 0, 64
    while at < len(values):  # the sums of the rows to come, as if none of them were a total, up to the first that is
        rows, free = values[at : at + ahead], ~said[at : at + ahead]
        counts = np.cumsum(free) - free
        added = np.where(free[:, None], rows, 0.0)
        running = [np.add.accumulate(np.vstack([start, added]), axis=0) for start in (section, body)]
        found = None
        for name, n, sums in (("section", n_section, running[0][:-1]), ("body", n_body, running[1][:-1]), ("body and totals", n_body, running[1][:-1] + totals)):
            told = abs(sums) > 1
            equal = (abs(rows - sums) <= 1 + rtol * abs(sums)) | ~told
            hits = np.flatnonzero(free & (n + counts >= 2) & (told.sum(1) >= least) & equal.all(1))
            if len(hits) and (found is None or hits[0] < found[0]):
                found = hits[0], name
        k = len(rows) if found is None else found[0]
        section, body, n_section, n_body = running[0][k], running[1][k], n_section + free[:k].sum(), n_body + free[:k].sum()
        at, ahead = at + k, min(2 * ahead, 8192)
        if found is not None:
            reasons[at] = found[1]
            totals, section, n_section, at, ahead = totals + values[at], section * 0, 0, at + 1, 64
    return reasons


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, bool]:
    """Different values in order with a null last if there is one, which of them each cell has, and whether there is one."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(codes.dictionary, null_placement="at_end")
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return codes.dictionary.take(order), place[codes.indices.to_numpy()], codes.dictionary.null_count > 0


def _places(rows: np.ndarray, values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which cell of its row each one is, `count` being those before, which then has these too; of several cells in one row the smaller values come first."""
    n = np.bincount(rows, minlength=len(count)).astype(np.int32)
    places = count[rows]
    if len(n) and n.max() > 1:
        by = np.lexsort((values, rows))
        places[by] += (np.arange(len(by)) - np.searchsorted(rows[by], rows[by])).astype(np.int32)
    count += n
    return places


def _row_labels(chosen: tuple[pa.Array, np.ndarray] | None, rows: pa.Array) -> pa.Array:
    """A label for each row: the cell of the label column, or "Row n" where there is none or it is blank."""
    plain = pc.binary_join_element_wise(pa.scalar("Row ", pa.large_string()), pc.add(rows, pa.scalar(1, rows.type)).cast(pa.large_string()), pa.scalar("", pa.large_string()))
    if chosen is None:
        return plain
    texts, at = chosen[0].cast(pa.large_string()), chosen[1]
    spaced = _match(texts, "[\u00a0\t\n\v\f\r]|  |^ | \\z")
    if spaced.any():
        different, which = _distinct(texts, spaced)
        texts = pc.replace_with_mask(texts, pa.array(spaced), _strings([clean(x) for x in different]).take(pa.array(which)))
    order = np.arange(len(at))
    if len(np.unique(at)) < len(at):  # more cells than one: the greatest counts
        order = pc.sort_indices(texts.cast(pa.large_binary())).to_numpy()
    source = np.full(len(rows), -1)
    source[at[order]] = order
    labels = texts.take(pa.array(source, mask=source < 0))
    return pc.if_else(pc.fill_null(pc.equal(labels, ""), True), plain, labels)


def table_reader(keys: list[str], row: str, position: str, column: str, named: str, width: int, rtol: float) -> Callable[[pa.Table], pa.Table]:
    """Makes of a table's cells a line for each row: keys, row, label, total, last, cells (of numeric columns: position, value, flag, filled).  `named`: whether the header names a percentage."""

    def read(table: pa.Table) -> pa.Table:
        raw = table[column].combine_chunks() if table[column].nbytes < 1 << 30 else table[column].cast(pa.large_string()).combine_chunks()
        raw = pc.fill_null(raw, "")
        rows, row_of, null_row = _numbered(table[row])
        positions, column_of, null_position = _numbered(table[position])
        percent = table[named].to_numpy()
        eu = is_european_table(raw)
        order = np.argsort(column_of, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(column_of, minlength=len(positions)))
        chosen, parts, wide = None, [], []
        amounts, cells = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for p in range(len(positions) - null_position):
            at = order[ends[p - 1] if p else 0 : ends[p]]
            texts, r = raw.take(pa.array(at)), row_of[at]
            filled = filled_cells(texts)
            values, repaired = read_cells(texts, eu, False)
            good, n = ~np.isnan(values), int(filled.sum())
            if chosen is None and n:
                plain = good if not eu else ~np.isnan(read_cells(texts, False, False)[0])
                if (filled & plain).sum() * 100 < n * 60 and pc.count_distinct(texts.filter(pa.array(filled))).as_py() * 2 >= n:
                    chosen = texts, r
            if n == 0 or (filled & good).sum() * 100 < n * 60:
                continue
            signs = pc.sum(pc.match_substring(texts, "%")).as_py()
            told = values[good]
            small, large = told[told <= 1.5], told[told > 1.5]
            middle = len(large) > len(small) or len(large) == len(small) and (small.max() + large.min()) / 2 > 1.5
            scaled = (signs * 2 > n or percent[at].any()) and middle and told.min() > -5 and told.max() < 130
            if not good.all():
                values[~good], repaired[~good] = read_cells(texts.take(pa.array(np.flatnonzero(~good))), eu, True)
            flags = np.where(repaired, 1, np.where(np.isnan(values), 2, 0)).astype(np.int8)
            values = np.where(np.isfinite(values), values, np.nan) / (100.0 if scaled else 1.0)
            parts.append((r, _places(r, values, cells), p, values, flags, filled))
            if not scaled:
                places = _places(r, np.nan_to_num(values), amounts)
                while len(wide) < min(width, amounts.max()):
                    wide.append(np.zeros(len(rows)))
                for k in np.unique(places[places < width]):
                    wide[k][r[places == k]] = np.nan_to_num(values[places == k])
        del raw, row_of, column_of, order, percent
        labels = _row_labels(chosen, rows)
        reasons, there = np.full(len(rows), None, object), amounts > 0
        there[len(rows) - null_row :] = False
        if there.any():
            reasons[there] = find_totals(np.stack(wide, axis=1)[there], is_total(labels.filter(pa.array(there))), rtol, min(3, width))
        del wide
        found = np.flatnonzero(np.not_equal(reasons, None))
        last = np.zeros(len(rows), bool)
        last[found[-1:]] = True
        ends = np.concatenate([[0], np.cumsum(cells)])
        numbers, values, flags, filled = np.zeros(ends[-1], np.int32), np.zeros(ends[-1]), np.zeros(ends[-1], np.int8), np.zeros(ends[-1], bool)
        for r, places, *of in parts:
            to = ends[r] + places
            for all_of, these in zip((numbers, values, flags, filled), of):
                all_of[to] = these
        del parts
        shown = pa.array(["", "repaired", "unreadable"]).take(pa.array(flags, mask=flags == 0))
        structs = pa.StructArray.from_arrays([positions.take(pa.array(numbers)), pa.array(values, mask=np.isnan(values)), shown, pa.array(filled)], [position, "value", "flag", "filled"])
        columns = {k: pa.repeat(table[k][0], len(rows)) for k in keys}
        columns |= {row: rows, "label": labels.cast(pa.string()), "total": pa.array(reasons.tolist(), pa.string()), "last": pa.array(last), "cells": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)}
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(pa.table(columns).to_batches(max_chunksize=10_000))

    return read
