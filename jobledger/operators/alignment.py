"""Bands of rows whose cells were moved sideways on the way in: found by the identities that hold once they are moved back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobledger.functions.registry import RULES, Rule

#: Places that a band is moved by, to the right if positive, in order of preference.
SHIFTS = (1, 2, -1, -2)
#: Fewest rows of a band, share of them that must fail, and most failing rows of a section that may lie in other bands.
LEAST_ROWS, FAILING, ELSEWHERE = 3, 0.5, 0.2
#: Pass rate from which a band counts as sound as printed, and the one that a move must reach.
SOUND, REPAIRED = 0.9, 0.95


def _rules(roles: list[str | None]) -> list[Rule]:
    return [r for r in RULES if not r.clipped and {r.output, *r.inputs} <= set(roles)]


def _cell(place: int, width: int, shift: Column | int, start: Column | int) -> Column:
    """The printed cell that stands at `place` once all from `start` on are moved by `shift`; null where it left the frame."""
    shift, start, at = F.lit(shift), F.lit(start), F.lit(place)
    back = at - shift
    source = F.when(at < start, at).when(shift > 0, F.when(back >= start, back)).when(back < width, back)
    return F.get("cells", source)


def _counts(roles: list[str | None], shift: Column | int, start: Column | int) -> tuple[Column, Column]:
    """(identities that can be checked on a row, those that hold) under a move."""

    def of(name: str) -> Column:
        return _cell(roles.index(name), len(roles), shift, start)

    checked, held = F.lit(0), F.lit(0)
    for rule in _rules(roles):
        off = F.abs(of(rule.output) - rule.value(of))
        limit = F.lit(0.006) if rule.kind == "pct" else F.greatest(F.lit(2.0), F.abs(rule.value(of)) * F.lit(1e-6))
        checked = checked + off.isNotNull().cast("int")
        held = held + F.coalesce(off <= limit, F.lit(False)).cast("int")
    return checked, held


def shifted_bands(rows: DataFrame, roles: list[str | None], keys: list[str]) -> DataFrame:
    """keys, band, status (shifted, ambiguous or unresolved), shift, from_column, pass_rate of bands whose failures have the shape of a band.

    `rows` has the keys, band and cells (array of double, percents as fractions);
    `roles` names the variable at each place.  Failing rows choose the bands, and
    only these are tried: every move of every row is counted where the row is, so
    one line for each band and move is shuffled.  The move with most checks, then
    the best rate, wins; two shifts that tie are ambiguous.  Null cells are not
    checked; sections without failures, or none at all, give no rows.
    """
    if not _rules(roles):
        raise ValueError("no identity holds among these columns")
    checked, held = _counts(roles, 0, 0)
    seen = rows.select(*keys, "band", checked.alias("c"), held.alias("h"))
    bands = seen.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") < F.col("c")).alias("bad"), F.sum("c").alias("c"), F.sum("h").alias("h"))
    section = bands.groupBy(*keys).agg(F.sum("bad").alias("all_bad"))
    shaped = (F.col("bad") >= F.col("n") * F.lit(FAILING)) & (F.col("all_bad") - F.col("bad") <= F.col("all_bad") * F.lit(ELSEWHERE))
    tried = bands.join(section, keys).where((F.col("n") >= LEAST_ROWS) & (F.col("bad") > 0) & shaped & (F.col("h") < F.col("c") * F.lit(SOUND))).select(*keys, "band")

    moves = F.array(*[F.struct(F.lit(k).alias("preference"), F.lit(s).alias("shift"), F.lit(a).alias("start")) for k, (s, a) in enumerate((s, a) for s in SHIFTS for a in range(len(roles) - 1))])
    moved = rows.join(tried, [*keys, "band"], "left_semi").select(*keys, "band", "cells", F.explode(moves).alias("m")).select(*keys, "band", "cells", "m.*")
    checked, held = _counts(roles, F.col("shift"), F.col("start"))
    counted = moved.groupBy(*keys, "band", "preference", "shift", "start").agg(F.sum(checked).alias("c"), F.sum(held).alias("h"))
    won = counted.where((F.col("c") >= LEAST_ROWS) & (F.col("h") >= F.col("c") * F.lit(REPAIRED)))
    # at most len(SHIFTS) * len(roles) moves a band
    best = won.groupBy(*keys, "band").agg(F.max(F.struct("c", "h")).alias("top"), F.collect_list(F.struct("preference", "shift", "start", "c", "h")).alias("moves"))
    ties = F.array_sort(F.filter("moves", lambda x: (x["c"] == F.col("top.c")) & (x["h"] == F.col("top.h"))))
    best = best.withColumn("ties", ties).select(*keys, "band", F.col("ties")[0].alias("first"), (F.size(F.array_distinct(F.transform("ties", lambda x: x["shift"]))) > 1).alias("several"))
    out = tried.join(best, [*keys, "band"], "left")
    sure = F.col("several") == F.lit(False)
    status = F.when(F.col("several").isNull(), "unresolved").when(F.col("several"), "ambiguous").otherwise("shifted")
    rate = F.col("first.h").cast("double") / F.col("first.c")
    return out.select(*keys, "band", status.alias("status"), F.when(sure, F.col("first.shift")).alias("shift"), F.when(sure, F.col("first.start")).alias("from_column"), F.when(sure, rate).alias("pass_rate"))


def realigned(rows: DataFrame, found: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """rows with the cells of shifted bands moved back; cells that left the frame are null.  Other bands stay as they are."""
    moves = found.where("status = 'shifted'").select(*keys, "band", F.col("shift").alias("__shift"), F.col("from_column").alias("__start"))
    joined = rows.join(moves, [*keys, "band"], "left")
    back = F.array(*[_cell(k, width, F.col("__shift"), F.col("__start")) for k in range(width)])
    cells = F.when(F.col("__shift").isNull(), F.col("cells")).otherwise(back)
    return joined.select(*[cells.alias(c) if c == "cells" else F.col(c) for c in rows.columns])
