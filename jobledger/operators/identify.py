"""Which column plays which role: grids, shortlists, column sums, and the search over one section."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions.scalars import ratio

SECTION = ["portfolio_id", "period"]
#: Display grids, coarsest first.
GRIDS = (1_000_000.0, 100_000.0, 10_000.0, 1_000.0, 500.0, 100.0, 50.0, 10.0, 5.0, 1.0, 0.5, 0.1, 0.05, 0.01)


def display_grid(cells: DataFrame) -> DataFrame:
    """Coarsest grid on which all values of a column lie."""
    v = F.col("value").cast("double")
    on = [F.min((F.abs(v - F.rint(v / g) * g) <= F.abs(v) * F.lit(1e-9) + F.lit(1e-9)).cast("int")).alias(f"g{k}") for k, g in enumerate(GRIDS)]
    pick = F.coalesce(*[F.when(F.col(f"g{k}") == 1, F.lit(g)) for k, g in enumerate(GRIDS)])
    return cells.groupBy(*SECTION, "mcol").agg(*on).select(*SECTION, "mcol", pick.alias("grid"))


def value_shortlist(cells: DataFrame, k: int = 3) -> DataFrame:
    """Columns that may be the contract value: by how often they hold a row's largest value, then by sum; the first k."""
    row_max = cells.groupBy(*SECTION, "job_id").agg(F.max("value").alias("top"))
    won = cells.join(row_max, [*SECTION, "job_id"]).groupBy(*SECTION, "mcol").agg(F.count_if(F.col("value") == F.col("top")).alias("wins"), F.sum("value").alias("total"), F.median("value").alias("median"))
    w = Window.partitionBy(*SECTION).orderBy(F.desc("wins"), F.desc("total"), "mcol")
    return won.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(cells: DataFrame) -> DataFrame:
    """Columns of a row side by side: an equi-join on the row, columns being few."""
    a = cells.select(*SECTION, "job_id", F.col("mcol").alias("a"), F.col("value").alias("x"))
    b = cells.select(*SECTION, "job_id", F.col("mcol").alias("b"), F.col("value").alias("y"))
    return a.join(b, [*SECTION, "job_id"]).where("a <> b")


def estimate_orientation(cells: DataFrame) -> DataFrame:
    """Column pairs (v, x) in which x is like an estimated cost (median share of v 0.45 to 1.02) or profit (0.02 to 0.45) with an interquartile range of 0.25 or less."""
    r = _pairs(cells).withColumn("r", ratio("y", "x")).groupBy(*SECTION, "a", "b").agg(F.percentile("r", [0.25, 0.5, 0.75]).alias("q"))
    r = r.where(F.col("q")[2] - F.col("q")[0] <= 0.25)
    kind = F.when((F.col("q")[1] >= 0.45) & (F.col("q")[1] <= 1.02), "cost").when((F.col("q")[1] >= 0.02) & (F.col("q")[1] < 0.45), "profit")
    return r.withColumn("kind", kind).where("kind is not null").select(*SECTION, F.col("a").alias("v"), F.col("b").alias("x"), "kind")


def anchor_candidates(cells: DataFrame, whole: int, factor: float) -> DataFrame:
    """Columns that may accumulate towards column `whole`: never negative, at most `factor` of it, median share 0.02 or more."""
    r = _pairs(cells).where(F.col("a") == whole).withColumn("bad", (F.col("y") < 0) | (F.col("y").cast("double") > F.col("x").cast("double") * F.lit(factor)))
    s = r.groupBy(*SECTION, "b").agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.median(ratio("y", "x")).alias("m"))
    return s.where((F.col("bad") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))) & (F.col("m") >= 0.02)).select(*SECTION, F.col("b").alias("mcol"))


#: Tests of one aggregate.
TESTS = 84


def column_sums(wide: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """All (a, b, s) with a + b = s on all rows but a tenth (one at least): all triples are tested in one pass over the rows."""
    tests = [(a, b, s) for s in columns for i, a in enumerate(columns) for b in columns[i + 1 :] if s not in (a, b)]
    off = [F.count_if(F.abs(F.col(a) + F.col(b) - F.col(s)) > F.greatest(F.lit(1.0), F.abs(F.col(s)) * F.lit(0.005)) + F.lit(1.0)).alias(f"t{k}") for k, (a, b, s) in enumerate(tests)]
    # in aggregates of so many tests that each stays within generated code; sections are few
    counted = None
    for at in range(0, len(off), TESTS):
        some = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *off[at : at + TESTS])
        counted = some if counted is None else counted.join(some.drop("n"), keys)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s"), F.col(f"t{k}").alias("off")) for k, (a, b, s) in enumerate(tests)]))
    return counted.where("n >= 3").select(*keys, "n", rows.alias("t")).select(*keys, "t.a", "t.b", "t.s", "n", "t.off").where(F.col("off") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))).select(*keys, "a", "b", "s")


#: Money identities that the search uses: output, inputs, formula, family.
_FORMS = (
    ("G", "VC", lambda v, c: v - c, "est_comp"), ("Q", "CD", lambda c, d: c - d, "cost_complete"), ("E", "VDC", lambda v, d, c: v * d / c, "earned"),
    ("H", "ED", lambda e, d: e - d, "earned_profit"), ("N", "EB", lambda e, b: e - b, "billing_pos"), ("U", "EB", lambda e, b: np.maximum(e - b, 0), "billing_pos"),
    ("O", "EB", lambda e, b: np.maximum(b - e, 0), "billing_pos"), ("R", "VE", lambda v, e: v - e, "backlog"), ("RB", "VB", lambda v, b: v - b, "rem_billing"),
)
_D, _B = {"earned", "earned_profit", "cost_complete"}, {"billing_pos", "rem_billing"}


def search(matrix: np.ndarray) -> tuple[dict[int, str], float, bool]:
    """Best mapping of columns to roles, its score and whether a rival comes within a fifth.

    Hypotheses choose V, C, D and B; every identity then predicts a column.  A
    mapping counts if both the cost side and the billing side are confirmed by a
    column of their own; its score is the number of families confirmed.
    """
    n, m = matrix.shape
    bad = max(1, n // 10)
    near = lambda p, q: np.sum(np.abs(p - q) > np.maximum(2.05, 2e-5 * np.abs(q))) <= bad
    found: list[tuple[float, dict[int, str]]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        median = np.median(matrix, axis=0)
        for v, c in permutations(range(m), 2):
            valued = matrix[:, v] != 0
            if not valued.any() or not 0.45 <= np.median(matrix[valued, c] / matrix[valued, v]) <= 1.05:
                continue
            for d in range(m):
                if d in (v, c) or np.sum((matrix[:, d] < 0) | (matrix[:, d] > 1.1 * matrix[:, c])) > bad or median[d] < 0.02 * median[c]:
                    continue
                for b in range(m):
                    if b in (v, c, d) or np.sum((matrix[:, b] < 0) | (matrix[:, b] > 1.25 * matrix[:, v])) > bad:
                        continue
                    roles = {"V": v, "C": c, "D": d, "B": b}
                    values = {k: matrix[:, i] for k, i in roles.items()}
                    families: set[str] = set()
                    for out, inputs, formula, family in _FORMS:
                        if not all(i in values for i in inputs):
                            continue
                        predicted = formula(*[values[i] for i in inputs])
                        match = [k for k in range(m) if k not in roles.values() and near(matrix[:, k], predicted)]
                        if len(match) == 1:
                            roles[out] = match[0]
                            families.add(family)
                        values[out] = matrix[:, match[0]] if len(match) == 1 else predicted
                    if families & _D and families & _B:
                        found.append((len(families) + 0.05 * len(roles), {i: k for k, i in roles.items()}))
    if not found:
        return {}, 0.0, False
    found.sort(key=lambda x: -x[0])
    best = found[0]
    rival = any(s >= 0.8 * best[0] and not set(x.items()) <= set(best[1].items()) for s, x in found[1:])
    return best[1], best[0], rival


def identify(wide: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Mapping of every section: status success, ambiguous or insufficient, and column -> role.

    Medians and allowed bad rows are those of all rows of a section with finite
    values, in whatever order.  One section is one task's, which holds its columns.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        matrix = part[columns].to_numpy(float)
        matrix = matrix[np.isfinite(matrix).all(axis=1)]
        mapping, score, rival = search(matrix) if len(matrix) >= 3 else ({}, 0.0, False)
        status = "insufficient" if not mapping else "ambiguous" if rival else "success"
        return pd.DataFrame([[*key, status, float(score), ", ".join(f"{columns[k]}={v}" for k, v in sorted(mapping.items()))]], columns=[*keys, "status", "score", "mapping"])

    shape = ", ".join(f"{k} {wide.schema[k].dataType.simpleString()}" for k in keys)
    return wide.select(*keys, *columns).groupBy(*keys).applyInPandas(run, f"{shape}, status string, score double, mapping string")
