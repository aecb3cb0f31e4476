"""Across reporting periods: changes, anomalies, monotony, trajectories, evidence, matching."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions.scalars import GENERIC_WORDS, identity_score, norm_id, norm_name, plausible, ratio
from jobledger.operators.portfolio import billing

_ONE = ["portfolio_id", "job_id"]
#: The least score that can stand against an automatic link (0.9 less the lead of 0.08), and the share of words that it takes.
RIVAL = 0.82
SHARED = (RIVAL - 0.65) / 0.35 - 1e-9


def changes(jobs: DataFrame) -> DataFrame:
    """First and last report of every job seen twice or more: changes of contract, cost, profit and margin, and whether it stalled."""
    first = {f"{c}0": F.min_by(c, "period") for c in ("V", "C", "D", "B")}
    last = {f"{c}1": F.max_by(c, "period") for c in ("V", "C", "D", "B")}
    s = jobs.groupBy(*_ONE).agg(F.count_distinct("period").alias("n"), F.min("period").alias("first"), F.max("period").alias("last"), *[v.alias(k) for k, v in (first | last).items()]).where("n > 1")
    fade = (F.col("V1") - F.col("C1")) - (F.col("V0") - F.col("C0"))
    cost = F.col("C1") - F.col("C0")
    gate = lambda x: F.greatest(F.lit(10000.0), F.abs(x).cast("double") * F.lit(0.03))
    margin = ratio(F.col("V1") - F.col("C1"), "V1") - ratio(F.col("V0") - F.col("C0"), "V0")
    return s.select(
        *_ONE, "first", "last", (F.col("V1") - F.col("V0")).alias("contract_change"), cost.alias("cost_change"), fade.alias("profit_change"), margin.alias("margin_change"),
        (cost > gate(F.col("C0"))).alias("material_cost"), (fade < -gate(F.col("V0") - F.col("C0"))).alias("material_fade"),
        ((F.abs(F.col("D1") - F.col("D0")) <= 1) & (F.abs(F.col("B1") - F.col("B0")) <= 1)).alias("stalled"),
        F.greatest(F.abs("V0"), F.abs("V1"), F.lit(1).cast("long")).alias("scale"), (F.col("V0") - F.col("C0")).alias("prior_profit"),
    )


def robust_anomalies(df: DataFrame, keys: list[str], value: str, least: int = 5, least_mad: float = 0.002) -> DataFrame:
    """df with z = 0.6745 |x - median| / MAD of its group; null for small groups or a tiny MAD."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"), F.count(value).alias("n"))
    off = df.join(med, keys).withColumn("off", F.abs(F.col(value) - F.col("med")))
    mad = off.groupBy(*keys).agg(F.median("off").alias("mad"))
    ready = (F.col("n") >= least) & (F.col("mad") > least_mad)
    return off.join(mad, keys).withColumn("z", F.when(ready, F.col("off") * F.lit(0.6745) / F.col("mad"))).drop("off", "n")


def estimate_anomalies(jobs: DataFrame) -> DataFrame:
    """Jobs whose profit estimate swung by a fixed gate, by a multiple of the prior profit, or by four robust deviations of the portfolio."""
    z = robust_anomalies(changes(jobs), ["portfolio_id"], "margin_change")
    swing, margin = F.abs("profit_change"), F.abs("margin_change")
    least = lambda share: F.greatest(F.lit(50000.0), F.col("scale") * F.lit(share))
    fixed = swing >= least(0.05)
    multiple = swing / F.greatest(F.abs("prior_profit").cast("double"), F.col("scale") * F.lit(0.01))
    odd = (fixed & (margin >= 0.10)) | (fixed & (multiple >= 5)) | (F.coalesce(F.col("z") >= 4, F.lit(False)) & (swing >= least(0.03)) & (margin >= 0.05))
    return z.where(F.coalesce(odd, F.lit(False))).select(*_ONE, "profit_change", F.when(F.col("profit_change") >= 0, "profit gain").otherwise("profit loss").alias("direction"))


def monotony_breaks(jobs: DataFrame, tolerance: int = 1) -> DataFrame:
    """Reports whose cost or billing to date fell below the report before."""
    w = Window.partitionBy(*_ONE).orderBy("period")
    before = jobs.withColumns({"D0": F.lag("D").over(w), "B0": F.lag("B").over(w)})
    return before.where((F.col("D") < F.col("D0") - tolerance) | (F.col("B") < F.col("B0") - tolerance)).select(*_ONE, "period", "D0", "D", "B0", "B")


def trajectories(jobs: DataFrame) -> DataFrame:
    """Net billing position (B - E) of each job, in order of periods, with its change over all of them."""
    points = F.sort_array(F.collect_list(F.struct("period", (F.col("B") - F.col("E")).alias("net"))))
    t = jobs.groupBy(*_ONE).agg(points.alias("p"))
    return t.select(*_ONE, F.size("p").alias("reports"), F.array_join(F.transform("p", lambda x: x["net"].cast("string")), ",").alias("net"), (F.element_at("p", -1)["net"] - F.col("p")[0]["net"]).alias("change"))


def priority_trajectories(jobs: DataFrame, flags: DataFrame, k: int = 5, least: float = 0.15) -> DataFrame:
    """The k flagged jobs of a portfolio to look at first (a top-k report): by the worst severity among their flags (portfolio_id, job_id, severity), then by how complete they are and how far from even, as last reported.

    Reports of jobs less than `least` or more than fully complete give no point; a job without a point is left out.
    """
    points = jobs.select(*_ONE, "period", ratio("D", "C").alias("P"), ratio(F.col("B") - F.col("E"), "V").alias("position")).where((F.col("P") >= least) & (F.col("P") <= 1.000001) & F.col("position").isNotNull())
    last = points.groupBy(*_ONE).agg(F.max_by(F.struct("P", "position"), "period").alias("x"), F.count(F.lit(1)).alias("points"))
    worst = flags.groupBy(*_ONE).agg(F.max("severity").alias("score"))
    w = Window.partitionBy("portfolio_id").orderBy(F.desc("score"), F.desc("x.P"), F.desc(F.abs("x.position")), "job_id")
    return last.join(worst, list(_ONE)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*_ONE, "rank", "score", "points")


def strip(jobs: DataFrame) -> DataFrame:
    """Counts and sums over all linked jobs of a portfolio."""
    c = changes(jobs)
    return c.groupBy("portfolio_id").agg(
        F.sum(F.when(F.col("material_cost"), F.col("cost_change")).otherwise(0)).alias("cost_increase"), F.count_if("material_cost").alias("cost_jobs"),
        F.sum(F.when(F.col("material_fade"), -F.col("profit_change")).otherwise(0)).alias("fade"), F.count_if("material_fade").alias("fade_jobs"), F.count_if("stalled").alias("stalled_jobs"),
    )


def early_underbilling(jobs: DataFrame, least: int = 3) -> DataFrame:
    """For each portfolio: jobs underbilled by 5 % of V before half completion, how many of them earned less margin in their last report, with `least` cases or more."""
    shaped = billing(jobs).withColumn("early", (F.col("D") * 2 < F.col("C")) & (F.col("U") * 20 >= F.col("V")))
    margin = F.struct((F.col("E") - F.col("D")).alias("h"), F.col("E").alias("e"))
    s = _early(shaped, margin)
    faded = F.col("z.h") * F.col("a.e") < F.col("a.h") * F.col("z.e")
    return s.where("p0 is not null and p1 > p0").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if(faded).alias("faded")).where(F.col("cases") >= least)


def _early(shaped: DataFrame, margin) -> DataFrame:
    at = F.when(F.col("early"), F.col("period"))
    return shaped.groupBy(*_ONE).agg(F.min_by(margin, at).alias("a"), F.min(at).alias("p0"), F.max_by(margin, "period").alias("z"), F.max("period").alias("p1"))


def matching_candidates(observations: DataFrame) -> DataFrame:
    """All plausible partners of each observation (obs_id, period, block, job_id, name) in other periods, best first.

    Observations meet if they share a block (a portfolio) and an id, the whole
    name, or a telling word of their names: plausible() asks for one of these, so
    no pair is lost and no cross join is needed.
    """
    name = norm_name(F.col("name"))
    words = F.filter(F.split(name, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))
    keys = F.concat(words, F.array(F.concat(F.lit("id:"), norm_id(F.col("job_id"))), F.concat(F.lit("name:"), name)))
    keyed = observations.withColumn("k", F.explode(F.array_distinct(keys))).where(~F.col("k").isin("id:", "name:"))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.period") != F.col("b.period"))).select("a.block", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("obs_id", "job_id", "name")]).distinct()
    args = [F.col(f"{s}_{c}") for s in "ab" for c in ("job_id", "name", "name")]
    good = pairs.where(plausible(*args)).withColumn("score", identity_score(*args))
    w = Window.partitionBy("a_obs_id").orderBy(F.desc("score"), "b_obs_id")
    return good.withColumn("rank", F.row_number().over(w)).select(F.col("a_obs_id").alias("obs_id"), F.col("b_obs_id").alias("match_id"), "score", "rank")


def _prefix_keys(words):
    """Keys of which two names share one if half their words or so are the same (Jaccard SHARED or more).

    For each number of words that the other name may have, the rarest of one's own
    words suffice: all but as many as must be shared, and one.  A key is the two
    numbers and the word, `k` with one's own number first and `met` with the other's.
    """
    n = F.size(words)
    other = F.sequence(F.ceil(n * F.lit(SHARED)).cast("int"), F.floor(n / F.lit(SHARED)).cast("int"))
    least = lambda m: F.ceil((n + m) * F.lit(SHARED / (1 + SHARED)) - F.lit(1e-9)).cast("int")
    return F.flatten(F.transform(other, lambda m: F.transform(F.slice(words, F.lit(1), F.greatest(n - least(m) + 1, F.lit(0))), lambda w: F.struct(F.concat_ws(":", n.cast("string"), m.cast("string"), w).alias("k"), F.concat_ws(":", m.cast("string"), n.cast("string"), w).alias("met")))))


def scored_pairs(observations: DataFrame) -> DataFrame:
    """block, a, b, score: pairs of observations of different periods that score RIVAL or more.

    Without equal ids or names, such a score takes name words of Jaccard SHARED or
    more, as the edit part gives 0.65 at most.  Ids or words that many share make as many pairs.
    """
    o = observations.select("block", "obs_id", "period", "job_id", "name", norm_name(F.col("name")).alias("norm"))
    each = o.select("block", "obs_id", F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).where("w <> ''")
    rarity = each.groupBy("block", "w").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x["w"])
    prefix = each.join(rarity, ["block", "w"]).groupBy("block", "obs_id").agg(ordered.alias("words")).select("block", "obs_id", F.explode(_prefix_keys(F.col("words"))).alias("x")).select("block", "obs_id", "x.k", "x.met")
    whole = F.explode(F.array(F.concat(F.lit("id:"), norm_id(F.col("job_id"))), F.concat(F.lit("name:"), F.col("norm")))).alias("k")
    keys = o.select("block", "obs_id", whole).where(~F.col("k").isin("id:", "name:")).withColumn("met", F.col("k")).unionByName(prefix)
    keyed = keys.join(o.drop("norm"), ["block", "obs_id"])
    x, y = keyed.alias("a"), keyed.alias("b")
    met = x.join(y, (F.col("a.block") == F.col("b.block")) & (F.col("a.k") == F.col("b.met")) & (F.col("a.period") > F.col("b.period")))
    met = met.select(F.col("a.block").alias("block"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("obs_id", "job_id", "name")]).distinct()
    score = identity_score(*[F.col(f"{s}_{c}") for s in "ab" for c in ("job_id", "name", "name")])
    return met.select("block", F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), score.alias("score")).where(F.col("score") >= RIVAL)


def _settled(df: DataFrame) -> DataFrame:
    """df worked out once: in the folder that spark.checkpoint.dir names, or, in local mode without it, on this machine."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None and context.master.split("[")[0] == "local":
        return df.localCheckpoint()
    return df.checkpoint()


def _near_names(names: DataFrame, broadcast_rows: int = 1 << 20) -> DataFrame:
    """block, norm: all names of which another of the block may have a word Jaccard of SHARED or more.

    What two names share are words that occur twice.  Names with too few of these for
    any length of name that occurs are near no other; keys tell the rest (_prefix_keys).
    """
    words = F.array_distinct(F.split("norm", " "))
    names = names.select("block", "norm", words.alias("words"), F.size(words).alias("n"), F.xxhash64("block", "norm").alias("name"))
    lengths = sorted(r.n for r in names.select("n").distinct().collect())  # few, as names are short
    if not lengths:
        return names.select("block", "norm")
    least = lambda a, b: math.ceil((a + b) * SHARED / (1 + SHARED) - 1e-9)
    needed = {a: min(least(a, b) for b in lengths if math.ceil(a * SHARED) <= b <= math.floor(a / SHARED)) for a in lengths}
    each = names.select("block", "norm", "name", "n", F.explode("words").alias("w")).withColumn("h", F.xxhash64("block", "w"))
    common = _settled(each.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    common = F.broadcast(common) if common.count() <= broadcast_rows else common
    need = F.element_at(F.create_map(*[F.lit(x) for item in needed.items() for x in item]), F.col("n"))
    enough = each.select("name", "n", "h").join(common, "h").groupBy("name").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= need)
    counted = each.join(_settled(enough.select("name")), "name", "left_semi").join(common, "h", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(1).cast("long")).alias("times"), "w"))), lambda x: x["w"])
    keys = counted.groupBy("block", "norm").agg(ordered.alias("words")).select("block", "norm", F.explode(_prefix_keys(F.col("words"))).alias("x")).select("block", "norm", "x.k", "x.met")
    others = keys.groupBy("block", F.col("met").alias("k")).agg(F.count(F.lit(1)).alias("others"))
    return keys.join(others, ["block", "k"]).where(F.col("others") > (F.col("k") == F.col("met")).cast("int")).select("block", "norm").distinct()


def _tangled_names(o: DataFrame, automatic: float) -> DataFrame:
    """block, norm: names whose reports aren't one group as they stand, or may link with those of another name; blank ones among them."""
    ident = F.when(norm_id(F.col("job_id")) != "", F.xxhash64(norm_id(F.col("job_id"))))
    own = F.when(F.col("norm") == "", F.col("obs_id"))
    groups = o.groupBy("block", "norm", own.alias("own")).agg(F.sort_array(F.collect_list(F.struct("period", "D", "B"))).alias("p"), F.collect_set(ident).alias("ids"))
    later = lambda a, b: F.coalesce(a["period"] < b["period"], F.lit(False)) & ~F.coalesce((b["D"] + 1 < a["D"]) | (b["B"] + 1 < a["B"]), F.lit(False))
    steady = F.when(F.size("p") > 1, F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: later(F.get("p", i - 1), F.get("p", i)))).otherwise(True)
    whole = steady & (F.size("ids") < 2) & (F.col("norm") != "") & F.col("block").isNotNull() & F.lit(automatic <= 1.0)
    names = _settled(groups.select("block", "norm", "ids", (~whole).alias("loose")))
    seen = names.select("block", "norm", F.explode("ids").alias("id"))
    shared = seen.groupBy("block", "id").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("block", "id")
    found = names.where("loose").select("block", "norm").unionByName(seen.join(shared, ["block", "id"]).select("block", "norm"))
    return _settled(found.unionByName(_near_names(names.where("norm <> '' and block is not null"))).distinct())


def match_groups(observations: DataFrame, automatic: float = 0.9, lead: float = 0.08) -> DataFrame:
    """Greedy linking of a block's observations (obs_id, period, block, job_id, name and, if known, D and B) over periods, oldest first.

    A group scores as its best pair, by identity_score, with a report whose cost
    and billing to date don't fall towards the later one.  Each observation joins
    the best group without a report of its period if that scores `automatic` or
    more, `lead` before the next; else it begins its own.  One block is one contractor.

    The reports of a name with one id at most, which no other name has, that no
    other name is near, one a period and none falling, score 1 and are one group;
    only the others are scored and linked one by one.  Groups are numbered by
    their first reports.
    """
    if automatic - lead < RIVAL - 1e-9:
        raise ValueError(f"pairs below {RIVAL} aren't scored")
    known = [F.col(c).cast("double").alias(c) if c in observations.columns else F.lit(None).cast("double").alias(c) for c in ("D", "B")]

    def run(part: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["period", "obs_id"])
        partners: dict[str, list[tuple[str, float]]] = {}
        for a, b, s in zip(pairs["a"], pairs["b"], pairs["score"], strict=True):
            partners.setdefault(a, []).append((b, s))
        held: list[set] = []
        first: list[tuple] = []
        seen: dict[str, tuple[int, float, float]] = {}
        out = []
        for r in part.itertuples():
            scores: dict[int, float] = {}
            for other, s in partners.get(r.obs_id, []):
                g, d, b = seen[other]
                if not (r.D + 1 < d or r.B + 1 < b) and r.period not in held[g]:
                    scores[g] = max(s, scores.get(g, -1.0))
            ranked = sorted((-s, g) for g, s in scores.items())
            sure = ranked and -ranked[0][0] >= automatic and (len(ranked) < 2 or ranked[1][0] - ranked[0][0] >= lead)
            g = ranked[0][1] if sure else len(held)
            if g == len(held):
                held.append(set())
                first.append((r.period, r.obs_id))
            held[g].add(r.period)
            seen[r.obs_id] = (g, r.D, r.B)
            out.append((r.block, g, *first[g], r.obs_id))
        return pd.DataFrame(out, columns=["block", "g", "period", "first", "obs_id"])

    o = observations.select("block", "obs_id", "period", "job_id", "name", *known, norm_name(F.col("name")).alias("norm"))
    tangled = _tangled_names(o, automatic)
    alike = lambda a, b: a["block"].eqNullSafe(b["block"]) & (a["norm"] == b["norm"])
    loose = not tangled.isEmpty()
    plain = o.select("block", "norm", "period", "obs_id")
    plain = plain.join(tangled, alike(plain, tangled), "left_anti") if loose else plain
    groups = plain.groupBy("block", "norm").agg(F.sort_array(F.collect_list(F.struct("period", "obs_id"))).alias("x"))
    groups = groups.select("block", F.get("x", F.lit(0))["period"].alias("period"), F.get("x", F.lit(0))["obs_id"].alias("first"), F.lit(0).cast("long").alias("g"), F.transform("x", lambda r: r["obs_id"]).alias("all"))
    if loose:
        shape = ", ".join(f"{c} {observations.schema[n].dataType.simpleString()}" for c, n in (("period", "period"), ("first", "obs_id"), ("obs_id", "obs_id")))
        others = _settled(o.join(tangled, alike(o, tangled), "left_semi").drop("norm"))
        linked = others.select("block", "obs_id", "period", "D", "B").groupBy("block").cogroup(scored_pairs(others).groupBy("block"))
        linked = linked.applyInPandas(run, f"block {observations.schema['block'].dataType.simpleString()}, g long, {shape}")
        groups = groups.unionByName(linked.groupBy("block", "g", "period", "first").agg(F.collect_list("obs_id").alias("all")))
    number = F.row_number().over(Window.partitionBy("block").orderBy(F.asc_nulls_last("period"), F.asc_nulls_last("first"), "g")) - 1
    return groups.select("block", number.cast("long").alias("group_id"), "all").select("block", F.explode("all").alias("obs_id"), "group_id")
