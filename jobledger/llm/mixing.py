"""Mixing sources to target weights by hierarchical budgets.

A tree of weights (domain, language, source) is given.  A token budget flows from
the root by weight; what a leaf cannot use (its tokens times `max_epochs` are
fewer) is offered to its siblings first, and only what these cannot use to the
siblings of its parent, and so on.  Each leaf's budget is met by whole seeded
epochs and the token-prefix of one more: every epoch has its own pseudo-random
order of the leaf's documents, and the document at the cut counts with the tokens
that are left.

Leaves' totals are all the driver sees, one short row for each (a tree of names, not
of rows).  The prefix is found without sorting a leaf in one task: totals by hash
range place the cut in one range, two times over, and only what lies in the last
range is ordered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.tables import checkpoint

#: Leaves up to which the table of budgets is broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 100_000


@dataclass
class Node:
    """A tree node: weight among its siblings, tokens it can supply, and the budget it gets."""

    weight: float = 1.0
    supply: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: int = 0


def share(budget: int, nodes: list[Node]) -> None:
    """Splits a budget by weight, never above a node's supply; shortages go to the siblings, by weight, until all is given or all are full.  Whole tokens, the remainder to the first with room."""
    for n in nodes:
        n.budget = 0
    open_ = [n for n in nodes if n.weight > 0 and n.supply > 0]
    left = min(budget, sum(n.supply for n in open_))
    while left > 0 and open_:
        total = sum(n.weight for n in open_)
        full = [n for n in open_ if left * n.weight / total >= n.supply]
        if not full:
            given = [int(left * n.weight / total) for n in open_]
            for n, g in zip(open_, given, strict=True):
                n.budget = g
            rest = left - sum(given)
            for n in open_:
                take = min(rest, n.supply - n.budget)
                n.budget += take
                rest -= take
            return
        for n in full:
            n.budget = n.supply
            left -= n.supply
        done = {id(n) for n in full}
        open_ = [n for n in open_ if id(n) not in done]


def plan(root: Node, budget: int) -> None:
    """Sets budgets throughout the tree.  A node's supply is the sum of its children's, so a shortage is met among siblings before an ancestor sees it."""

    def fill(n: Node) -> int:
        if n.children:
            n.supply = sum(fill(c) for c in n.children.values() if c.weight > 0)
        return n.supply

    def give(n: Node) -> None:
        kids = [n.children[k] for k in sorted(n.children)]
        share(n.budget, kids)
        for k in kids:
            give(k)

    fill(root)
    root.budget = min(budget, root.supply)
    give(root)


def token_estimate(text_col: str = "text"):
    """Words parted by white space, as a token count that needs no tokenizer; null and blank texts have 0."""
    return F.coalesce(F.when(F.trim(text_col) == "", 0).otherwise(F.size(F.split(F.trim(text_col), r"\s+"))), F.lit(0)).cast("long")


def leaf_budgets(leaves: list[tuple[tuple[str, ...], int]], weights: dict, budget: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Budget of every leaf path.  `weights` maps a path prefix (a tuple) to its weight among siblings; others weigh 1."""
    root = Node()
    for path, tokens in leaves:
        at = root
        for k, name in enumerate(path):
            at = at.children.setdefault(name, Node(weight=weights.get(path[: k + 1], 1.0)))
        at.supply = tokens * max_epochs
    plan(root, budget)

    out = {}
    for path, _ in leaves:
        at = root
        for name in path:
            at = at.children[name]
        out[path] = at.budget
    return out


def mix_sources(
    docs: DataFrame, levels: list, weights: dict, budget_share: float = 0.6, max_epochs: int = 3, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", tokens=None, copies_col: str = "copies", tokens_col: str | None = None, ranges: int = 1024,
) -> DataFrame:
    """docs that the mix takes, with `copies`, the number of epochs in which each is taken, and with `tokens_col` the tokens taken of it in all.

    `levels` are the tree's columns or expressions from the root down; null names
    are a leaf "" of their own.  The budget is `budget_share` of all tokens.  The
    document at a leaf's cut is taken for the tokens up to it; the others whole, so
    the tokens of a leaf are its budget.  Documents without tokens follow the epochs
    that are whole for their leaf.  Repeated rows (one id and text) share their
    fate, and the tokens of the cut in proportion, rounded down; rows with a null id
    are ordered by their text.  Columns of these names are replaced; no rows give none.
    """
    base = docs.drop(copies_col, *([tokens_col] if tokens_col else []))
    n = tokens if tokens is not None else token_estimate(text_col)
    names = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in levels]
    work = base.withColumns({"__leaf": F.array(*names), "__n": n, "__key": F.xxhash64(F.col(id_col), F.col(text_col))})
    totals = checkpoint(work.groupBy("__leaf").agg(F.sum("__n").alias("n")))
    leaves = [(tuple(r["__leaf"]), int(r["n"])) for r in totals.collect()]
    budget = int(sum(t for _, t in leaves) * budget_share)
    given = leaf_budgets(leaves, weights, budget, max_epochs)
    rows = [(list(p), min(given[p] // t, max_epochs) if t else 0, given[p] - (given[p] // t) * t if t else 0) for p, t in leaves]
    few = len(rows) <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)  # one row a leaf, or a range of one
    table = checkpoint(docs.sparkSession.createDataFrame(rows, "__path array<string>, __whole int, __rest long"))
    work = work.join(small(table), F.col("__leaf") == F.col("__path"))
    place = F.xxhash64("__key", F.lit(seed), F.col("__whole"))  # the order of the epoch that is cut
    bits = (ranges - 1).bit_length()
    work = work.withColumns({"__place": place, "__coarse": F.shiftright(place, 64 - bits), "__fine": F.shiftright(place, 64 - 2 * bits)})
    open_ = work.where("__rest > 0").select(F.col("__path").alias("leaf"), F.col("__rest").alias("rest"), F.col("__n").alias("n"), F.col("__coarse").alias("coarse"), F.col("__fine").alias("fine"), F.col("__place").alias("place"), F.col("__key").alias("key"))
    # the cut lies in the first range at which the sum reaches the rest; then in the first of that range's own ranges
    coarse = _cut_range(open_.groupBy("leaf", "rest", "coarse").agg(F.sum("n").alias("t")).withColumn("b", F.lit(0).cast("long")), "coarse")
    within = open_.select("leaf", "rest", "coarse", "fine", "n").join(small(coarse), ["leaf", "coarse"])
    fine = _cut_range(within.groupBy("leaf", "rest", "b", "fine").agg(F.sum("n").alias("t")), "fine")
    inside = open_.select("leaf", "rest", "fine", "place", "key", "n").join(small(fine), ["leaf", "fine"])
    inside = inside.groupBy("leaf", "rest", "b", "place", "key").agg(F.sum("n").alias("t"))
    ordered = Window.partitionBy("leaf").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("s", F.col("b") + F.coalesce(F.sum("t").over(ordered), F.lit(0)))
    last = checkpoint(inside.where("s < rest").groupBy("leaf").agg(F.max(F.struct("place", "key", "t", (F.col("rest") - F.col("s")).alias("left"))).alias("last")))
    taken = work.join(small(last.select(F.col("leaf").alias("__l"), F.col("last").alias("__last"))), F.col("__leaf") == F.col("__l"), "left")
    at, end = F.struct(F.col("__place").alias("p"), F.col("__key").alias("k")), F.struct(F.col("__last.place").alias("p"), F.col("__last.key").alias("k"))
    more = F.col("__last").isNotNull() & (at <= end)
    of_cut = F.when(at == end, F.floor(F.col("__last.left") * F.col("__n") / F.greatest(F.col("__last.t"), F.lit(1)))).otherwise(F.col("__n"))
    out = {copies_col: (F.col("__whole") + more.cast("int")).cast("int")}
    if tokens_col:
        out[tokens_col] = (F.col("__whole") * F.col("__n") + F.when(more, of_cut).otherwise(0)).cast("long")
    return taken.withColumns(out).where(F.col(copies_col) > 0).select(*[F.col(f"`{c}`") for c in (*base.columns, *out)])


def _cut_range(sums: DataFrame, column: str) -> DataFrame:
    """(leaf, range, b: tokens before it) of the range in which each leaf's sum b + t + ... reaches its rest; `sums` has as many rows a leaf as there are ranges."""
    before = Window.partitionBy("leaf").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("b", F.col("b") + F.coalesce(F.sum("t").over(before), F.lit(0)))
    return checkpoint(placed.where("b < rest and b + t >= rest").select("leaf", column, "b"))
