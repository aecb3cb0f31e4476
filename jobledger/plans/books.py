"""Queries over whole printed books: the parse chain, totals, completed contracts, layouts, and the accepted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobledger.operators import accepted, certify, contracts, identify, layout, parse, portfolio
from jobledger.plans import reports
from jobledger.plans.catalog import KEYS, query
from jobledger.sources import tables as t

PRINTED = ("V", "C", "D")


def _shown(value: Column, kind: Column) -> Column:
    text = F.format_number(value, 0)
    return F.when(kind == 0, F.concat(F.lit("$ "), text)).when(kind == 1, F.concat(text, F.lit(".00"))).when(kind == 3, F.translate(text, "0", "O")).otherwise(text)


def _book(spark: SparkSession, sf_dir: str, extra: int = 0) -> DataFrame:
    """Cells of printed schedules: a label, three amounts in changing forms and a percentage for each job, and a total row; `extra` is added to each fifth portfolio's total of V."""
    table = Window.partitionBy(*KEYS)
    sums = [F.sum(c).over(table).alias(f"sum_{c}") for c in PRINTED]
    j = t.wip_jobs(spark, sf_dir).select(*KEYS, "job_id", *PRINTED, (F.row_number().over(table.orderBy("job_id")) - 1).alias("place"), F.count(F.lit(1)).over(table).cast("int").alias("n"), *sums)
    kind = F.col("job_id") % 8
    more = F.when((F.col("portfolio_id") % 5 == 0) & F.lit(extra > 0), F.lit(extra)).otherwise(0)
    job = F.struct(F.col("place").alias("row"), F.concat(F.lit("BOSS "), F.col("job_id").cast("string")).alias("label"), *[_shown(F.col(c), kind).alias(c) for c in PRINTED], F.concat(F.floor(F.col("D") * 100 / F.col("C")).cast("string"), F.lit("%")).alias("P"))
    total = F.struct(F.col("n").alias("row"), F.lit("Total").alias("label"), *[F.format_number(F.col(f"sum_{c}") + (more if c == "V" else 0), 0).alias(c) for c in PRINTED], F.lit("").alias("P"))
    lines = j.select(*KEYS, F.explode(F.when(F.col("place") == F.col("n") - 1, F.array(job, total)).otherwise(F.array(job))).alias("line")).select(*KEYS, "line.*")
    cells = [F.struct(F.lit(k).alias("col"), F.lit(h).alias("header"), F.col(c).alias("raw")) for k, (c, h) in enumerate((("label", "Job"), ("V", "Contract"), ("C", "Cost"), ("D", "To date"), ("P", "% complete")))]
    return lines.select(*KEYS, "row", F.explode(F.array(*cells)).alias("x")).select(*KEYS, "row", "x.*")


@query
def parsed_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parse chain reads from printed books: jobs, totals found, sums of what was read, repairs."""
    lines = parse.parsed_lines(_book(spark, sf_dir), KEYS)
    each = lines.select(*KEYS, "label", "total", F.posexplode_outer("cells").alias("at", "x")).select(*KEYS, "label", "total", "at", "x.*")
    body, once = F.col("total").isNull(), F.coalesce("at", F.lit(0)) == 0
    sums = [F.sum(F.when(body & (F.col("col") == k), F.col("value"))).cast("long").alias(f"sum_{c}") for k, c in enumerate(PRINTED, 1)]
    counts = [F.count_if(once & body).alias("jobs"), F.count_if(once & ~body).alias("totals"), F.min("label").alias("first_label"), F.count_if(body & F.col("col").isNotNull()).alias("read")]
    found = each.groupBy(*KEYS).agg(*sums, F.count_if(body & (F.col("flag") == "repaired")).alias("repaired"), F.max(F.when(body & (F.col("col") == 4), F.col("value"))).alias("most_complete"), *counts)
    return found.where("read > 0").drop("read")


@query
def printed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that books print against what their rows add up to; each fifth portfolio's total is wrong by 10,000."""
    c = parse.checked_lines(parse.parsed_lines(_book(spark, sf_dir, 10_000), KEYS), KEYS)
    return c.where("col < 4").select(*KEYS, "col", F.col("stated").cast("long").alias("stated"), F.col("computed").cast("long").alias("computed"), "matches", "includes_subtotals")


@query
def cc_identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the columns of completed-contracts schedules, told by the numbers alone."""
    roles = ["RT", "KT", "GT", "RP", "KP", "GP", "RC", "KC", "GC"]
    cc = t.cc_jobs(t.wip_jobs(spark, sf_dir)).withColumns({f"c{k}": F.col(r).cast("double") for k, r in enumerate(roles)})
    return contracts.identify_cc(cc, [f"c{k}" for k in range(9)], KEYS)


def _cc_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = t.cc_jobs(t.wip_jobs(spark, sf_dir))
    return cc.withColumns({"KT": F.when(F.col("job_id") % 31 == 0, F.col("KT") + 100).otherwise(F.col("KT")), "RC": F.when(F.col("job_id") % 37 == 1, F.col("RC") * 10).otherwise(F.col("RC"))})


@query
def cc_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cell of a completed contract is wrong: total costs of some jobs and current revenues of others are."""
    found = contracts.cc_findings(_cc_wrong(spark, sf_dir).drop("BC"), [*KEYS, "job_id"])
    return found.where("culprit is not null").select(*KEYS, "job_id", "culprit", F.col("observed").cast("long").alias("observed"), F.col("proposed").cast("long").alias("proposed"), F.col("failed").cast("long").alias("failed"))


def _sides(wide: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    mapped = lambda: F.when(F.col("mapping") == "", 0).otherwise(F.size(F.split("mapping", ", ")))
    wip = identify.identify(wide, columns, KEYS).select(*KEYS, "status", F.lit(len(columns)).alias("columns"), mapped().alias("mapped"), F.col("score").alias("weight"), mapped().alias("witnesses"), F.lit(False).alias("all_complete"))
    cc = contracts.identify_cc(wide, columns, KEYS).select(*KEYS, "status", F.lit(len(columns)).alias("columns"), mapped().alias("mapped"), F.col("witnesses").cast("double").alias("weight"), "witnesses")
    return wip, cc


@query
def schedule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema race over work-in-progress tables, and over completed contracts of ten jobs or more."""
    j = t.wip_jobs(spark, sf_dir)
    one = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(("V", "C", "D", "E", "B", "U"))]
    cc = t.cc_jobs(j)
    enough = cc.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select(*KEYS)
    two = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(("RT", "KT", "GT"))]
    found = contracts.schema_race(*_sides(portfolio.billing(j).select(*KEYS, *one), [f"c{k}" for k in range(6)]), KEYS).withColumn("table", F.lit("wip"))
    words = enough.withColumn("type", F.when(F.col("portfolio_id") % 2 == 0, "cc"))
    triangle = contracts.schema_race(*_sides(cc.join(enough, KEYS).select(*KEYS, *two), ["c0", "c1", "c2"]), KEYS, words).withColumn("table", F.lit("cc"))
    return found.unionByName(triangle)


@query
def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules printed over three pages, the header on the first or on all, put together again."""
    j = portfolio.billing(t.wip_jobs(spark, sf_dir))
    w = Window.partitionBy(*KEYS).orderBy("job_id")
    names = ["Job", "Contract", "Cost", "To date", "Earned", "Billed", "Underbilled"]
    row = F.array(F.concat(F.lit("J-"), F.col("job_id").cast("string")), *[F.format_number(c, 0) for c in "VCDEBU"])
    paged = j.select(F.concat_ws("/", *[F.col(k).cast("string") for k in KEYS]).alias("doc_id"), (F.ntile(3).over(w)).alias("page"), "portfolio_id", F.struct("job_id", row.alias("r")).alias("x"))
    pages = paged.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("rows"), F.first("portfolio_id").alias("p"))
    head = F.array(*map(F.lit, names))
    repeated = (F.col("page") > 1) & (F.col("p") % 2 == 0)
    headers = F.when((F.col("page") == 1) | (F.col("p") % 2 == 0), head).otherwise(F.array(*[F.lit("")] * 7))
    shown = pages.select("doc_id", "page", F.lit(0).alias("position"), headers.alias("headers"), F.when(repeated, F.concat(F.array(head), "rows")).otherwise(F.col("rows")).alias("rows"), F.lit(False).alias("overlaps"))
    found = layout.assemble_layouts(shown)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables"), F.sum(F.size("rows")).alias("rows"), F.max(F.size("pages")).alias("pages"))


def _proposals(j: DataFrame) -> DataFrame:
    return j.where("job_id % 97 = 0").select(*KEYS, "job_id", F.lit("D").alias("variable"), F.col("D").alias("proposed"), F.concat_ws("/", "job_id", "period").alias("id"))


def _decided(j: DataFrame) -> DataFrame:
    """Proposals with decisions: each third job's is taken back, every other stays accepted."""
    p = _proposals(j)
    log = p.where("job_id % 3 = 0").select("id", F.lit(False).alias("accept"), F.lit(1).alias("seq"))
    return accepted.with_decisions(p, log, "id")


@query
def decided_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(t.wip_jobs(spark, sf_dir)).select("id", "proposed", "accepted")


@query
def accepted_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    fixes = _decided(j).select("job_id", "period", F.col("variable").alias("column"), "proposed", "accepted")
    k = portfolio.kpis(accepted.accepted_jobs(t.with_errors(j), fixes))
    return k.select(*KEYS, "total_contract_value", "cost_to_complete", "uegp", "job_count", "top5_share")


@query
def accepted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated totals of D and of signed underbillings against jobs with the accepted corrections."""
    j = t.wip_jobs(spark, sf_dir)
    part = lambda name, c: F.struct(F.lit(name).alias("variable"), c.alias("value"))
    short = -F.greatest(F.col("E") - F.col("B"), F.lit(0).cast("long"))
    wrong = t.with_errors(j).select(*KEYS, "job_id", F.explode(F.array(part("D", F.col("D")), part("U", short))).alias("x")).select(*KEYS, "job_id", "x.*")
    stated = j.groupBy(*KEYS).agg(F.sum("D").alias("D"), F.sum(-short).alias("U")).select(*KEYS, F.explode(F.array(F.struct(F.lit("D").alias("variable"), F.col("D").alias("stated")), F.struct(F.lit("U").alias("variable"), F.col("U").alias("stated")))).alias("x")).select(*KEYS, "x.*")
    found = accepted.reconciled_totals(wrong, stated, _decided(j).select(*KEYS, "job_id", "variable", "proposed", "accepted"))
    return found.select(*KEYS, "variable", F.col("computed").cast("long").alias("computed"), F.col("corrected").cast("long").alias("corrected"), "stated", "status")


@query
def canonical_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variables of a job from four mapped cells and accepted corrections."""
    j = t.wip_jobs(spark, sf_dir)
    cells = t.cells(t.with_errors(j), ("V", "C", "D", "B"))
    name = F.array(*map(F.lit, "VCDB"))[F.col("mcol")]
    found = accepted.canonical_jobs(cells.select("job_id", "period", name.alias("variable"), "value"), ["job_id", "period"], _decided(j).select("job_id", "period", "variable", "proposed", "accepted"))
    return found.select("job_id", "period", *[F.col(c).cast("long").alias(c) for c in ("V", "C", "G", "D", "Q", "B", "RB")])


@query
def label_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, F.concat(F.lit("J-"), F.col("p_partkey").cast("string"), F.lit(" - "), F.col("p_name"))).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_name")))
    return part.select("p_partkey", accepted.label_identity(label).alias("x")).select("p_partkey", "x.id", "x.name")


@query
def implied_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three identities imply for the cost to date of jobs: by the cost to complete, the earned profit, and the printed percentage."""
    j = t.wip_jobs(spark, sf_dir)
    off = F.when(F.col("job_id") % 10 == 0, 500).otherwise(0)
    made = [("cost_complete", "money", F.col("C") - F.col("Q")), ("earned_profit", "money", F.col("E") - (F.col("E") - F.col("D")) + off), ("pct_complete", "pct", F.floor(F.col("D") * 100 / F.col("C")) * F.col("C") / 100)]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("kind"), v.cast("double").alias("value"), (F.col("C") / 100 if k == "pct" else F.lit(2.0)).cast("double").alias("tolerance")) for f, k, v in made]))
    return accepted.family_consensus(j.select("job_id", "period", each.alias("x")).select("job_id", "period", "x.*"), ["job_id", "period"])


@query
def emitted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every mapped column: D has findings where a job is wrong, the others are confirmed by the rules that hold."""
    wide = portfolio.billing(t.with_errors(t.wip_jobs(spark, sf_dir)))
    mapping = wide.select(*KEYS).distinct().select(*KEYS, F.posexplode(F.array(*map(F.lit, t.MONEY))).alias("col", "variable"))
    inputs = F.create_map(*[x for r in certify.RULES for x in (F.lit(r.name), F.array(*map(F.lit, (r.output, *r.inputs))))])
    held = certify.witnesses(wide).select(*KEYS, "checked", "held", F.explode(inputs[F.col("rule")]).alias("variable"))
    findings = certify.culprits(wide).select(*KEYS, F.explode("culprits").alias("variable"))
    return accepted.emitted(mapping, held, findings, KEYS).select(*KEYS, "col", "variable", "status")


@query
def printed_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schedule as it prints, with its line of totals."""
    j = portfolio.billing(t.wip_jobs(spark, sf_dir)).withColumns({"N": F.col("B") - F.col("E"), "P": F.when(F.col("C") != 0, F.floor(F.col("D") * 1000 / F.col("C")) / 1000)})
    return reports.printed_schedule(j.drop("Q"), KEYS, "job_id", F.concat(F.lit("Job "), F.col("job_id").cast("string")))


@query
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of which some are infinite or no number: these become null."""
    odd = F.when(F.col("job_id") % 5 == 0, "Infinity").when(F.col("job_id") % 5 == 1, "-Infinity").when(F.col("job_id") % 5 == 2, "NaN").otherwise(F.col("V").cast("string"))
    return t.wip_jobs(spark, sf_dir).select("job_id", "period", parse.finite(odd.cast("double")).alias("value"))


@query
def column_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose columns have unequal numbers of rows; the fourth and sixth column of each fifth portfolio lose the rows of every third job."""
    cells = t.cells(t.wip_jobs(spark, sf_dir))
    lost = (F.col("portfolio_id") % 5 == 0) & F.col("mcol").isin(3, 5) & (F.col("job_id") % 3 == 0)
    return parse.column_shapes(cells.where(~lost), KEYS, "mcol", "job_id")
