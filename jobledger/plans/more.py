"""Further queries: review, mappings, views, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.functions import registry
from jobledger.operators import alignment, certify, parse, periods, portfolio, repair, review, signals
from jobledger.plans.catalog import KEYS, _observations, _on_jobs, _wide, query
from jobledger.sources import tables as t

_on_jobs("cc_kpis", lambda j: review.cc_kpis(t.cc_jobs(j)))
_on_jobs("cc_billed_column", lambda j: review.billed_column(t.cc_jobs(j).withColumn("XC", F.col("RT") - 5000), ["BC", "XC"]))
_on_jobs("snapshot_points", review.snapshots)
_on_jobs("job_rows", review.job_rows)
_on_jobs("job_facts", review.job_facts)
_on_jobs("schedule_types", review.schedule_types)
_on_jobs("partial_certification", lambda j: review.partial_certification(j.withColumn("E", F.when(F.col("job_id") % 4 == 0, None).otherwise(F.col("E"))).select(*KEYS, "job_id", "V", "C", "G", "D", "Q", "E")))
_on_jobs("shadow_audit", lambda j: review.shadow_audit(j.withColumn("X", F.when(F.col("job_id") % 50 == 0, F.col("G") + 500).otherwise(F.col("G"))), "X", F.col("V") - F.col("C")))
_on_jobs("row_marks", lambda j: review.row_marks(signals.all_jobs(j)))
_on_jobs("coverage_counts", lambda j: j.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("job_id").alias("jobs"), F.count_distinct("period").alias("periods")))


@query
def corroborate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    made = {"G": F.col("V") - F.col("C"), "Q": F.col("C") - F.col("D"), "RB": F.col("V") - F.col("B")}
    derived = j.select(*KEYS, "job_id", F.explode(F.array(*[F.struct(F.lit(k).alias("variable"), v.cast("double").alias("expected")) for k, v in made.items()])).alias("x")).select(*KEYS, "job_id", "x.*")
    return review.corroborating_columns(t.cells(j, ("G", "Q", "E")), derived)


@query
def mapping_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["V", "C", "D", "B"]), (2, ["V", "G", "E", "U"]), (3, ["V", "D", "B"]), (4, ["V", "C", "D"]), (5, ["V", "C", "B"])]
    return review.readiness(spark.createDataFrame(rows, "mapping_id int, variables array<string>"))


@query
def kpi_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir).groupBy(*KEYS).agg(F.max((F.col("job_id") % 97 == 0).cast("int")).alias("fixed"))
    state = F.explode(F.array(F.struct(F.lit("V").alias("variable"), F.lit("printed").alias("provenance")), F.struct(F.lit("C").alias("variable"), F.lit("confirmed").alias("provenance")), F.struct(F.lit("D").alias("variable"), F.when(F.col("fixed") == 1, "corrected").otherwise("printed").alias("provenance")), F.struct(F.lit("E").alias("variable"), F.lit("derived").alias("provenance"))))
    inputs = spark.createDataFrame([("contract_value", "V"), ("cost_to_complete", "C"), ("cost_to_complete", "D"), ("backlog", "V"), ("backlog", "E")], "kpi string, variable string")
    return review.weakest(j.select(*KEYS, state.alias("x")).select(*KEYS, "x.variable", "x.provenance"), inputs)


@query
def validation_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(t.with_errors(t.wip_jobs(spark, sf_dir)))
    fixed = certify.failures(wide).where("rule = 'Q=C-D' and job_id % 2 = 0").groupBy(*KEYS, "rule").agg(F.count(F.lit(1)).alias("fixed"))
    return review.checklist(certify.witnesses(wide), fixed)


@query
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each contractor: reports, failing rows and sections with any."""
    wide = _wide(t.with_errors(t.wip_jobs(spark, sf_dir)))
    bad = certify.failures(wide).select(*KEYS, "job_id").distinct().groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("failing"), F.count_distinct("period").alias("sections"))
    return wide.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("reports")).join(bad, "portfolio_id", "left").fillna(0)


@query
def section_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "success", False, False, 0), (2, "failed", True, False, 0), (3, "failed", True, False, 1), (4, "failed", False, False, 0), (5, "insufficient", False, True, 0), (6, "insufficient", False, False, 0)]
    return review.route(spark.createDataFrame(rows, "section int, status string, misread boolean, rival boolean, retries int")).select("section", "route")


@query
def correction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders")
    decided = o.where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("correction_id"), (F.col("o_custkey") % 2 == 0).alias("accept"), F.lit(1).alias("seq"))
    decided = decided.unionByName(o.where("o_custkey % 6 = 1").select(F.col("o_orderkey").alias("correction_id"), F.lit(True).alias("accept"), F.lit(2).alias("seq")))
    return review.correction_status(o.select(F.col("o_orderkey").alias("correction_id")), decided)


@query
def totals_corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of the first wrong job of a section against totals printed with the right value of it alone."""
    j = t.wip_jobs(spark, sf_dir)
    wrong = t.with_errors(j)
    fixes = j.where("job_id % 97 = 0").select(*KEYS, "job_id", (F.col("D") * 10).alias("observed"), F.col("D").alias("proposed"))
    first = fixes.groupBy(*KEYS).agg(F.min_by(F.col("observed") - F.col("proposed"), "job_id").alias("gap"))
    totals = wrong.groupBy(*KEYS).agg(F.sum("D").alias("computed")).join(first, KEYS).withColumn("stated", F.col("computed") - F.col("gap"))
    return review.corroborated(fixes, totals)


@query
def effective_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user swaps two columns; the other five keep what was inferred."""
    user = spark.createDataFrame([(0, "C"), (1, "V")], "mcol int, variable string")
    inferred = spark.createDataFrame(list(enumerate(t.MONEY)), "mcol int, variable string")
    return review.apply_mapping(t.cells(t.wip_jobs(spark, sf_dir)), user, inferred, list(t.MONEY))


@query
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _observations(t.wip_jobs(spark, sf_dir)).select("obs_id", F.col("job_id").alias("group_id"))
    n = F.col("group_id").cast("long") % 10
    log = groups.where(n < 4).select("obs_id", F.lit("merge").alias("action"), F.lit("7").alias("target"), F.lit(1).alias("seq"))
    log = log.unionByName(groups.where(n < 2).select("obs_id", F.when(n == 0, "new").otherwise("undo").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(2).alias("seq")))
    return review.final_groups(groups, log)


@query
def period_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.same_period_duplicates(t.table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate"])


@query
def trailing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    rows = j.select(*KEYS, F.col("job_id").alias("row"), *t.MONEY)
    total = j.groupBy(*KEYS).agg(F.lit(1 << 40).alias("row"), *[(F.sum(c) + F.when((F.col("portfolio_id") % 3 == 0) & F.lit(c in "VCGDQ"), 10**9).otherwise(0)).alias(c) for c in t.MONEY])
    return review.trailing_totals(rows.unionByName(total), list(t.MONEY))


@query
def subtotals_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subtotal of V, C and D in the middle of every schedule, and a total at its end (in each second portfolio one that counts the subtotal as well), go again."""
    j = t.wip_jobs(spark, sf_dir).select(*KEYS, (F.col("job_id") * 2).alias("row"), "V", "C", "D")
    middle = j.groupBy(*KEYS).agg(F.floor(F.avg("row")).alias("cut"))
    upper = j.join(middle, KEYS).where("row <= cut").groupBy(*KEYS).agg((F.max("row") + 1).alias("row"), *[F.sum(c).alias(c) for c in "VCD"], F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    total = j.groupBy(*KEYS).agg(F.lit(1 << 40).alias("row"), *[F.sum(c).alias(c) for c in "VCD"], F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    again = F.col("portfolio_id") % 2 == 0
    half = upper.select(*KEYS, *[F.col(c).alias(f"half_{c}") for c in "VCD"])
    total = total.join(half, KEYS, "left").select(*KEYS, "row", *[(F.col(c) + F.when(again, F.coalesce(f"half_{c}", F.lit(0))).otherwise(0)).alias(c) for c in "VCD"])
    return parse.without_subtotals(j.unionByName(upper).unionByName(total), KEYS, "row", ["V", "C", "D"])


@query
def job_id_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    cells = F.array(F.struct(F.lit(0).alias("col"), F.lit("Bridge north").alias("raw")), F.struct(F.lit(1).alias("col"), F.concat(F.lit("J-"), F.col("job_id").cast("string")).alias("raw")))
    return parse.identity_columns(j.select(*KEYS, F.explode(cells).alias("x")).select(*KEYS, "x.col", "x.raw"), KEYS, "col", "raw")


@query
def cell_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 0.125, True), (2, 0.5, True), (3, 1200.0, False), (4, 12.345, False), (5, None, False), (6, -3.0, False)]
    return spark.createDataFrame(rows, "k int, v double, p boolean").select("k", parse.cell_text(F.col("v"), F.col("p")).alias("text"))


@query
def image_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.image_strips(spark.createDataFrame([(1, 1000), (2, 1600), (3, 3000), (4, 3200)], "image int, height int"), "height")


@query
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 'text ```json\n{"a": 1, "b": [1, 2,],}\n``` end'), (2, "nothing"), (3, '{"x": {"y": null}}'), (4, "{broken")]
    return spark.createDataFrame(rows, "k int, text string").select("k", parse.tolerant_json(F.col("text")).alias("json"))


@query
def header_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["contract", "cost", "profit", "to date", "earned", "billed"]
    variables = ["V", "C", "G", "D", "E", "B"]
    rows = [(1, k, names[k], variables[k]) for k in range(6)] + [(2, k, names[k], variables[k - 1]) for k in range(1, 6)] + [(3, k, names[k], variables[k + 1]) for k in range(5)]
    words = spark.createDataFrame(list(zip(names, variables, strict=True)), "header string, variable string")
    return parse.offset_alignment(spark.createDataFrame(rows, "table_id int, pos int, header string, variable string"), words)


@query
def header_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = {"contract price": "V", "estimated total cost": "C", "cost to date": "D", "cost to complete": "Q"}
    rows = [(1, "Contract Pric"), (2, "estimated total costs"), (3, "cost"), (4, "Cost to date"), (5, "completely else")]
    return parse.fuzzy_headers(spark.createDataFrame(rows, "k int, header string"), "header", synonyms).select("k", "variable")


@query
def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five jobs of each contractor whose cost changed most (a top-k report)."""
    from jobledger.plans.catalog import _revised

    c = periods.changes(_revised(t.wip_jobs(spark, sf_dir)))
    return portfolio.top(c, ("portfolio_id",), [F.desc("cost_change"), "job_id"], 5).select("portfolio_id", "job_id", "cost_change", "rank")


ROLES = ["V", "C", "G", "D", "Q", "E", "B"]


def _displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules in bands of rows; in each third portfolio one band lost its third cell and the others moved up."""
    j = t.wip_jobs(spark, sf_dir)
    whole = [F.col(c).cast("double") for c in ROLES]
    hit = (F.col("portfolio_id") % 3 == 0) & (F.col("job_id") % 6 == 2)
    cells = F.when(hit, F.array(*whole[:2], *whole[3:], F.lit(None).cast("double"))).otherwise(F.array(*whole))
    return j.select(*KEYS, "job_id", (F.col("job_id") % 6).cast("int").alias("band"), cells.alias("cells"))


@query
def band_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.shifted_bands(_displaced(spark, sf_dir), ROLES, KEYS)


@query
def band_realignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _displaced(spark, sf_dir)
    found = alignment.shifted_bands(rows, ROLES, KEYS)
    back = alignment.realigned(rows, found, len(ROLES), KEYS)
    return back.groupBy("portfolio_id").agg(F.count("cells").alias("rows"), *[F.count(F.get("cells", F.lit(k))).alias(f"n_{c}") for k, c in enumerate(ROLES)], F.sum(F.get("cells", F.lit(3)).cast("long")).alias("sum_D"), F.sum(F.get("cells", F.lit(6)).cast("long")).alias("sum_B"))


@query
def reading_disambiguators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs and billings to date exchanged: which column would tell the two readings apart."""
    j = t.wip_jobs(spark, sf_dir)
    V, C, D, B = (F.col(c).cast("double") for c in "VCDB")
    made = [("P", D / C, B / C, True), ("Q", C - D, C - B, False), ("PB", B / V, D / V, False)]
    readings = F.array(*[F.struct(F.lit(v).alias("variable"), a.alias("a"), b.alias("b"), F.lit(p).alias("printed")) for v, a, b, p in made])
    return review.disambiguators(j.where("C > 0 and V > 0").select(*KEYS, F.explode(readings).alias("x")).select(*KEYS, "x.*"), KEYS)


@query
def audited_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 4, "G"), (1, 4, "G"), (1, 5, "Q"), (1, 5, "R"), (2, 4, "R"), (2, 6, None)]
    return review.promoted(spark.createDataFrame(rows, "section int, column int, variable string"), ["section"])


@query
def edited_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "($1,000)", False), (2, " 12.5% ", True), (3, "12.5%", False), (4, "", False), (5, "n/a", False), (6, "-3", False), (7, "(-3)", False), (8, None, True), (9, "$", False)]
    return spark.createDataFrame(rows, "k int, raw string, p boolean").select("k", review.edited_value(F.col("raw"), F.col("p")).alias("value"))


def _unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules that print G in a column without a name, wrong by 500 on every fiftieth job, and another that means nothing."""
    j = t.wip_jobs(spark, sf_dir)
    return j.withColumns({"x1": F.when(F.col("job_id") % 50 == 0, F.col("G") + 500).otherwise(F.col("G")), "x2": F.col("job_id") * 3}).drop("G")


@query
def full_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.full_certification(t.with_errors(_unmapped(spark, sf_dir)), ["x1", "x2"]).select(*KEYS, "job_id", "finding")


@query
def audited_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of cells that only the audit of unused columns makes visible."""
    wide = review.with_audited(_unmapped(spark, sf_dir), ["x1", "x2"])
    return repair.repairs(wide.where(certify.breaks(wide.columns)), ["V", "C", "G", "D", "Q", "E", "B"], ["job_id", "period"])


@query
def failures_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken identities by the variables' names, with how many rows break them."""
    found = certify.failures(_wide(t.with_errors(t.wip_jobs(spark, sf_dir)))).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
    words = F.create_map(*[x for r in registry.RULES for x in (F.lit(r.name), F.lit(r.business))])
    return found.select(F.element_at(words, F.col("rule")).alias("identity"), "rows")
