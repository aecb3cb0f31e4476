"""Unique smallest repair of a failing row: one cell, else two, by the identities alone."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Linear identities as coefficients that sum to zero, and the products.
_SUMS = ({"G": 1, "V": -1, "C": 1}, {"Q": 1, "C": -1, "D": 1}, {"N": 1, "E": -1, "B": 1}, {"R": 1, "V": -1, "E": 1}, {"RB": 1, "V": -1, "B": 1}, {"H": 1, "E": -1, "D": 1})
_CELL = 1.6


def _holds(row: dict[str, float]) -> bool:
    if any(abs(sum(k * row[c] for c, k in s.items())) > _CELL for s in _SUMS if s.keys() <= row.keys()):
        return False
    if {"E", "V", "D", "C"} <= row.keys() and row["C"]:
        return abs(row["E"] - row["V"] * row["D"] / row["C"]) <= _CELL + 0.51 * abs(row["V"] / row["C"])
    return True


def _implied(row: dict[str, float], cell: str, without: set[str]) -> list[float]:
    """Values that identities give a cell from cells outside `without`."""
    out = []
    for s in _SUMS:
        others = s.keys() - {cell}
        if cell in s and others <= row.keys() and not others & without:
            out.append(-sum(s[c] * row[c] for c in others) / s[cell])
    four = {"E", "V", "D", "C"}  # the product rounds, so it speaks only where no sum does
    if not out and cell in four and four <= row.keys() and not (four - {cell}) & without:
        v, c, d, e = row["V"], row["C"], row["D"], row["E"]
        made = {"E": v * d / c if c else None, "D": e * c / v if v else None, "V": e * c / d if d else None, "C": v * d / e if e else None}[cell]
        if made is not None:
            out.append(float(np.rint(made)))
    return out


def repair(row: dict[str, float]) -> dict[str, float] | None:
    """The one smallest set of changed cells with which every identity holds; None if there is none or more than one, or nothing to repair."""
    if _holds(row):
        return None
    for size in (1, 2):
        found: dict[tuple[str, ...], dict[str, float]] = {}
        for cells in combinations(row, size):
            for order in (cells, cells[::-1]) if size == 2 else (cells,):
                trial, without = dict(row), set(cells)
                for c in order:
                    values = _implied(trial, c, without)
                    if not values:
                        break
                    trial[c] = float(np.median(values))
                    without.discard(c)
                else:
                    if _holds(trial) and all(abs(trial[c] - row[c]) > 0.51 for c in cells):
                        found.setdefault(cells, {c: trial[c] for c in cells})
        if len(found) == 1:
            return next(iter(found.values()))
        if found:
            return None
    return None


def repairs(failing: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Proposed corrections for failing rows: key, column, observed, proposed.  Rows are independent, so they go to Python in batches and nothing is shuffled."""

    def run(parts):
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                fixed = repair({c: float(r[c]) for c in columns if r[c] is not None and r[c] == r[c]})
                out += [(*[r[k] for k in key], c, float(r[c]), v) for c, v in (fixed or {}).items()]
            yield pd.DataFrame(out, columns=[*key, "column", "observed", "proposed"])

    shape = ", ".join(f"{k} {failing.schema[k].dataType.simpleString()}" for k in key)
    return failing.select(*key, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(run, f"{shape}, column string, observed double, proposed double")
