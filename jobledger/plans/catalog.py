"""Queries over the derived schedules, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.functions import registry, scalars
from jobledger.operators import assemble, certify, identify, parse, periods, portfolio, repair, signals
from jobledger.plans import reports
from jobledger.plans.oracle import ORACLE
from jobledger.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
KEYS = list(portfolio.KEYS)


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _on_jobs(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: f(t.wip_jobs(spark, sf_dir))


def _wide(jobs: DataFrame) -> DataFrame:
    """jobs with every money variable."""
    return portfolio.billing(jobs).withColumns({"N": F.col("E") - F.col("B"), "R": F.col("V") - F.col("E"), "RB": F.col("V") - F.col("B"), "H": F.col("E") - F.col("D")})


_on_jobs("wip_jobs", lambda j: j)
_on_jobs("kpi_by_portfolio_period", portfolio.kpis)
_on_jobs("kpi_largest_job", portfolio.largest_job)
_on_jobs("kpi_top5_jobs", lambda j: portfolio.top(j, portfolio.KEYS, [F.desc("V"), "job_id"], 5).select(*KEYS, "job_id", "V", "rank"))
_on_jobs("consolidate_rollup", portfolio.totals_by_type)
_on_jobs("similar_completed", portfolio.similar_completed)
_on_jobs("book_shape", portfolio.book_shape)
_on_jobs("job_status", portfolio.job_status)
_on_jobs("column_sums", portfolio.column_sums)
_on_jobs("signal_trapped_cash", signals.trapped_cash)
_on_jobs("signal_job_borrow", signals.job_borrow)
_on_jobs("signal_job_borrow_unbilled", signals.job_borrow_unbilled)
_on_jobs("signal_loss_jobs", signals.loss_jobs)
_on_jobs("signal_cost_overrun", lambda j: signals.cost_overrun(t.with_errors(j)))
_on_jobs("signal_early_concentration", signals.early_concentration)
_on_jobs("signal_margin_outlier", signals.margin_outlier)
_on_jobs("signal_thin_backlog", signals.thin_margin_backlog)
_on_jobs("signal_job_concentration", signals.job_concentration)
_on_jobs("signal_trapped_no_runway", signals.trapped_no_runway)
_on_jobs("signal_numeric_fade", lambda j: signals.numeric_fade(j.withColumn("E", F.when((F.col("job_id") % 7 == 0) & (F.col("portfolio_id") % 2 == 0), F.floor(F.col("E") * 9 / 10).cast("long")).otherwise(F.col("E")))))
_on_jobs("signal_ranking", signals.ranked)
_on_jobs("signal_unrecognized_fade", lambda j: signals.unrecognized_fade(j.withColumn("E", F.when(F.col("job_id") % 7 == 0, F.floor(F.col("E") * 9 / 10).cast("long")).otherwise(F.col("E")))))
_on_jobs("signal_summary", signals.summary)
_on_jobs("signal_top_jobs", signals.top_jobs)
_on_jobs("cc_losses", lambda j: signals.cc_losses(t.cc_jobs(j)))
_on_jobs("cc_fade", lambda j: signals.cc_fade(t.cc_jobs(j)))
_on_jobs("cc_jobs", t.cc_jobs)
_on_jobs("cc_certify", lambda j: certify.cc_checks(t.cc_jobs(j).withColumn("KT", F.when(F.col("job_id") % 31 == 0, F.col("KT") + 100).otherwise(F.col("KT")))))
_on_jobs("cc_triples", lambda j: identify.column_sums(t.cc_jobs(j), ["RP", "RC", "RT", "KP", "KC", "KT", "GP", "GC", "GT"], KEYS))
_on_jobs("certify_failures", lambda j: certify.failures(_wide(t.with_errors(j))).select(*KEYS, "job_id", "rule"))
_on_jobs("witness_summary", lambda j: certify.witnesses(_wide(t.with_errors(j))))
_on_jobs("fixed_mapping_audit", lambda j: certify.audit_fixed_mapping(_wide(t.with_errors(j))))
_on_jobs("culprits", lambda j: certify.culprits(t.with_errors(_wide(j))).where("failed > 1"))
_on_jobs("display_grid", lambda j: identify.display_grid(t.cells(j)))
_on_jobs("value_axis_shortlist", lambda j: identify.value_shortlist(t.cells(j)))
_on_jobs("estimate_orientation", lambda j: identify.estimate_orientation(t.cells(j)))
_on_jobs("anchor_candidates", lambda j: identify.anchor_candidates(t.cells(j), 1, 1.10))
_on_jobs("degenerate_rows", lambda j: assemble.degenerate(j).where("degenerate").select(*KEYS, "job_id"))
_on_jobs("terminal_cc_block", assemble.terminal_block)
_on_jobs("first_last_change", lambda j: periods.changes(j).drop("scale", "prior_profit"))
_on_jobs("stalled_jobs", lambda j: periods.changes(j).where("stalled").select("portfolio_id", "job_id", "first", "last"))
_on_jobs("monotone_check", lambda j: periods.monotony_breaks(t.with_errors(j)))
_on_jobs("billing_trajectory", periods.trajectories)
_on_jobs("priority_trajectories", lambda j: periods.priority_trajectories(j, signals.all_jobs(j)))
_on_jobs("kpi_strip", lambda j: periods.strip(_revised(j)))
_on_jobs("estimate_anomalies", lambda j: periods.estimate_anomalies(_revised(j)))
_on_jobs("robust_anomaly", lambda j: periods.robust_anomalies(j.select(*KEYS, "job_id", scalars.ratio("B", "V").alias("x")), KEYS, "x", least_mad=0.002).select(*KEYS, "job_id", "z"))
_on_jobs("early_underbilling_evidence", periods.early_underbilling)
_on_jobs("identify_mapping", lambda j: identify.identify(portfolio.billing(j).select(*KEYS, *[F.col(c).alias(f"c{k}") for k, c in enumerate((*t.MONEY, "U", "O"))]), [f"c{k}" for k in range(9)], KEYS))
_on_jobs("match_groups", lambda j: periods.match_groups(_named(j)))
_on_jobs("certificate", lambda j: reports.certificate(certify.witnesses(_wide(j)), KEYS))


def _revised(j: DataFrame) -> DataFrame:
    """Estimates that were raised by the last period, on every thirteenth job by half."""
    more = F.when((F.col("period") == F.lit("1998-12-31").cast("date")) & (F.col("job_id") % 13 == 0), F.col("C") + F.floor(F.col("C") / 2).cast("long")).otherwise(F.col("C"))
    return j.withColumn("C", more)


def _observations(j: DataFrame) -> DataFrame:
    return j.select(F.col("portfolio_id").alias("block"), F.concat_ws("/", F.col("job_id").cast("string"), F.col("period").cast("string")).alias("obs_id"), F.col("period").cast("string").alias("period"), F.col("job_id").cast("string").alias("job_id"), F.lit("").alias("name"))


def _named(j: DataFrame) -> DataFrame:
    """Observations with figures and a name of each job's own; a third of the reports show no id, another third write the name in capitals."""
    kind = (F.col("job_id") + F.year("period")) % 3
    name = F.concat_ws(" ", F.lit("Works"), F.substring(F.md5(F.col("job_id").cast("string")), 1, 12), F.lit("Section"), F.col("job_id").cast("string"))
    obs_id = F.concat_ws("/", F.col("job_id").cast("string"), F.col("period").cast("string"))
    job_id = F.when(kind != 0, F.col("job_id").cast("string"))
    return j.select(F.col("portfolio_id").alias("block"), obs_id.alias("obs_id"), F.col("period").cast("string").alias("period"), job_id.alias("job_id"), F.when(kind == 1, F.upper(name)).otherwise(name).alias("name"), "D", "B")


@query
def derive_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the jobs each from V C D B, from V G D B and from C G Q B."""
    k = F.col("job_id") % 3
    j = t.wip_jobs(spark, sf_dir)
    given = {"V": k != 2, "C": k != 1, "D": k != 2, "B": F.lit(True), "G": k != 0, "Q": k == 2}
    shown = j.select("job_id", "period", *[F.when(on, F.col(c)).alias(c) for c, on in given.items()])
    return registry.derive(shown).select("job_id", "period", "V", "C", "G", "D", "Q", "E", "P", "M", "PB", "RB")


@query
def reconstruct_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir).select("job_id", "period", "V", "G", "Q", "E", "B")
    return registry.derive(j).select("job_id", "period", "C", "G", "D", "E", "B", "U", "O")


@query
def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir).where("D >= 1000")
    k, d = F.col("job_id") % 7, F.col("D")
    s = d.cast("string")
    observed = (
        F.when(k == 0, -d).when(k == 1, F.concat(s, F.lit("7")).cast("long")).when(k == 2, F.substring(s, F.lit(1), F.length(s) - 1).cast("long")).when(k == 3, d * 1000)
        .when(k == 4, F.concat(F.substring(s, F.lit(1), F.length(s) - 2), F.reverse(F.substring(s, F.length(s) - 1, F.lit(2)))).cast("long")).when(k == 5, d + 3).otherwise(d)
    )
    return certify.classified(j.select("job_id", "period", observed.alias("observed"), d.alias("proposed")))


@query
def transplant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    wrong = j.withColumn("W", F.when(F.col("job_id") % 97 == 0, F.col("E")).when(F.col("job_id") % 89 == 0, F.col("D") * 10).otherwise(F.col("D")))
    return certify.transplants(wrong, "W", "D")


@query
def totals_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    wrong = t.with_errors(j)
    fixes = j.where("job_id % 97 = 0 and portfolio_id % 4 <> 0").select("job_id", "period", F.lit("D").alias("column"), F.col("D").alias("value"))
    stated = j.groupBy(*KEYS).agg((F.sum("D") + F.when(F.col("portfolio_id") % 5 == 0, 1_000_000).otherwise(0)).alias("stated"))
    return certify.assess_totals(wrong, stated, fixes, "D")


@query
def corrections_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    fixes = j.where("job_id % 97 = 0").select("job_id", "period", F.lit("D").alias("column"), F.col("D").alias("value"))
    return certify.apply_corrections(t.with_errors(j), fixes)


@query
def shared_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = certify.failures(_wide(t.with_errors(t.wip_jobs(spark, sf_dir)))).select("job_id", "period", "rule")
    confirmed = spark.createDataFrame([("V",), ("C",), ("B",)], "variable string")
    return certify.shared_unconfirmed(failed, confirmed)


@query
def minimal_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(t.with_errors(t.wip_jobs(spark, sf_dir)))
    return repair.repairs(wide.where(certify.breaks(wide.columns)), ["V", "C", "G", "D", "Q", "E", "B"], ["job_id", "period"])


@query
def cell_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.printed(t.wip_jobs(spark, sf_dir))
    return p.select("job_id", "period", parse.parse_cell(F.col("raw")).alias("x")).select("job_id", "period", F.floor("x.value").cast("long").alias("value"), "x.repaired")


@query
def cell_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed forms as they occur, one by one."""
    raws = ["1,234.56", "(45,000)", "$2,000", "-", "", "1,2O4", "garbage!!", "45.2%", "$(171,759.47)", "$-", "–", "(1,000)", "-5"]
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    return df.select("k", parse.parse_cell(F.col("raw")).alias("x")).select("k", "x.value", "x.repaired", "x.percent")


@query
def numeric_column_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.numeric_columns(t.printed(t.wip_jobs(spark, sf_dir)), KEYS, "raw")


@query
def decimal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.printed(t.wip_jobs(spark, sf_dir))
    european = F.when(F.col("portfolio_id") % 2 == 0, F.translate("raw", ",", ".")).otherwise(F.col("raw"))
    return parse.decimal_votes(p.withColumn("raw", european), KEYS, "raw")


@query
def percent_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    shown = F.floor(F.col("D") * F.when(F.col("portfolio_id") % 2 == 0, 100).otherwise(1) / F.col("C")).cast("long")
    return parse.percent_scale(j.select(*KEYS, shown.alias("x")), KEYS, "x")


@query
def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir)
    cells = F.explode(F.array(F.struct(F.lit(0).alias("col"), F.lit("x").alias("raw")), F.struct(F.lit(1).alias("col"), F.concat(F.lit("J-"), F.col("job_id").cast("string")).alias("raw")), F.struct(F.lit(2).alias("col"), F.col("V").cast("string").alias("raw"))))
    return parse.label_columns(j.select(*KEYS, cells.alias("x")).select(*KEYS, "x.col", "x.raw"), KEYS, "col", "raw")


@query
def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["TOTAL", "Sub total", "Subtotals", "grand  total", "Total Wine Store", "Totally new", "Job 5", "Sub-station"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, label string")
    return df.select("k", parse.is_total(F.col("label")).alias("total"))


PERIOD_TEXTS = (
    "for the year ended December 31, 2025", "FYE 2024", "no date here", "as of 2024-06-30", "printed 6/30/24", "Jan 5 2024 and Feb 6 2024",
    "Sept. 30th, 2023", "2023-02-30", "fiscal year ending 2022", "12/31/2025 and December 31, 2025",
)


@query
def period_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.period_ends(spark.createDataFrame(list(enumerate(PERIOD_TEXTS)), "k int, text string"), "k", "text")


@query
def file_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [("a.bin", b"%PDF-1.7"), ("b", b"\x89PNG\r\n"), ("c", b"\xff\xd8\xff\xe0"), ("d", b"RIFF\x00\x00\x00\x00WEBP"), ("e.xlsx", b"PK\x03\x04"), ("f.CSV", b"Job,V"), ("g", b"???"), ("h", b"GIF89a")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in heads], "name string, head binary")
    return df.select("name", parse.sniff(F.col("name"), F.col("head")).alias("type"))


@query
def header_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = spark.createDataFrame([("Contract Price", "V"), ("Contract Amount", "V"), ("Est. Total Cost", "C"), ("Costs to Date", "D"), ("Billed to Date", "B"), ("% Complete", "P")], "header string, variable string")
    headers = spark.createDataFrame([(1, 0, "CONTRACT  PRICE"), (1, 1, "est total cost"), (1, 2, "Costs to date"), (1, 3, "Notes"), (2, 0, "Contract Price"), (2, 1, "Contract Amount"), (2, 2, "% complete")], "table_id int, pos int, header string")
    return parse.match_headers(headers, "header", synonyms)


@query
def schema_text_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"work in progress": "wip", "in process": "wip", "completed": "cc"}
    texts = spark.createDataFrame([(1, "title", "Work in Progress Schedule"), (1, "header", "Completed to date"), (2, "header", "Completed Contracts"), (3, "title", "Completed and Contracts in Process"), (4, "title", "Misc")], "table_id int, place string, text string")
    return assemble.schema_vote(texts, words)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers' and parts' names of one key, as names of jobs."""
    a = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.col("p_type").alias("ta"))
    b = t.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("k"), F.col("p_name").alias("b"), F.col("p_type").alias("tb"))
    return a.join(b, "k")


@query
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _names(spark, sf_dir)
    return p.select("k", scalars.name_similarity(F.concat_ws(" ", "a", "ta"), F.concat_ws(" ", "b", "tb")).alias("score"))


@query
def identity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (1, "24-003", "Willow Transit Center", "25-088", "Willow Transit Center - Phase II"), (2, "23-011", "Maple Street Fire Station", "24-006", "Granite Substation"),
        (3, "24-128", "Oak Hall", "24 128", "Oak Hall"), (4, "Job 123", "", "Job 124", ""), (5, "", "Pine Ridge", "", "pine ridge"), (6, "7", "Alpha Works", "7", "Zulu Kiosk"),
    ]
    df = spark.createDataFrame(rows, "k int, ia string, na string, ib string, nb string")
    args = [F.col(c) for c in ("ia", "na", "na", "ib", "nb", "nb")]
    return df.select("k", scalars.identity_score(*args).alias("score"), scalars.plausible(*args).alias("plausible"))


@query
def matching_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.matching_candidates(_observations(t.wip_jobs(spark, sf_dir)))


@query
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report twice: as open job (item 0, E of every eleventh job off by 10) and, if complete, as completed contract (item 1)."""
    j = t.wip_jobs(spark, sf_dir).select("job_id", "period", "V", "C", "D", "E", "B")
    first = j.withColumns({"E": F.when(F.col("job_id") % 11 == 0, F.col("E") + 10).otherwise(F.col("E")), "is_cc": F.lit(False), "item": F.lit(0)})
    return portfolio.merge_duplicates(first.unionByName(j.where("D = C").withColumns({"is_cc": F.lit(True), "item": F.lit(1)})))


@query
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.call_metrics(t.table(spark, sf_dir, "events"), "event_type", "value")


@query
def combined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders")
    return assemble.combined_sections(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("signature")))


@query
def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id")).agg(F.max("l_quantity").cast("int").alias("q"))
    return assemble.adjacent_pages(items.select("doc_id", "chunk_id", F.col("chunk_id").alias("first_page"), (F.col("chunk_id") + F.when(F.col("q") % 3 == 0, 1).otherwise(0)).alias("last_page")))


@query
def page_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = certify.failures(_wide(t.with_errors(t.wip_jobs(spark, sf_dir)))).select(F.col("job_id").alias("table_id"), F.col("portfolio_id").alias("row"), "rule")
    pages = t.table(spark, sf_dir, "orders").join(t.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("table_id"), F.col("c_nationkey").alias("row"), (F.col("o_custkey") % 10).alias("page"))
    return assemble.with_provenance(failed, pages)


@query
def overlay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t.wip_jobs(spark, sf_dir).select("job_id", "period", "B")
    edits = j.where("job_id % 10 = 0").select("job_id", "period", (F.col("B") + 5).alias("B"), F.lit(1).alias("seq"))
    edits = edits.unionByName(j.where("job_id % 20 = 0").select("job_id", "period", F.lit(None).cast("long").alias("B"), F.lit(2).alias("seq")))
    return assemble.overlay(j, edits, ["job_id", "period"], "B")


@query
def assemble_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.table(spark, sf_dir, "lineitem")
    rows = F.array(F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")))
    fragments = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.array(F.lit("Part"), F.lit("Quantity")).alias("headers"), rows.alias("rows"))
    tables = assemble.assemble(fragments)
    texts = F.transform("rows", lambda r: F.concat_ws("|", r))
    return tables.select("doc_id", "table_id", F.concat_ws("|", "headers").alias("headers"), F.concat_ws(";", texts).alias("rows"))


def queries() -> dict[str, Query]:
    from jobledger.plans import books, more  # noqa: F401  they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in queries()}
