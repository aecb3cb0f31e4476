"""Published example values of each operator, and planted errors that must be recovered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobledger.functions import registry, scalars
from jobledger.operators import assemble, certify, identify, parse, periods, portfolio, repair, signals
from jobledger.plans import catalog, reports
from jobledger.sources import files, tables
from jobledger.streaming.ingest import process_arrivals

SMALL = "/root/testdata/sf0.001"
JOBS = [
    ("J-101", 500000, 400000, 0.10, 60000), ("J-102", 800000, 600000, 0.20, 150000), ("J-103", 1200000, 1000000, 0.25, 300000), ("J-104", 400000, 300000, 0.40, 170000),
    ("J-105", 2000000, 1600000, 0.50, 1000000), ("J-106", 900000, 700000, 0.60, 500000), ("J-107", 600000, 480000, 0.75, 450000), ("J-108", 1500000, 1200000, 0.80, 1250000),
]


def schedule(spark, change=None):
    rows = []
    for k, (_, v, c, p, b) in enumerate(JOBS):
        d, e = round(c * p), round(v * p)
        row = dict(portfolio_id=1, period="2025-12-31", job_id=k, V=v, C=c, G=v - c, D=d, Q=c - d, E=e, B=b, U=max(e - b, 0), O=max(b - e, 0))
        rows.append(row | (change or {}).get(k, {}))
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'string' if k == 'period' else 'int' if k in ('portfolio_id', 'job_id') else 'long'}" for k in rows[0]))


def test_canonical_derivation(spark):
    df = registry.derive(spark.createDataFrame([(1e6, 8e5, 4e5, 5e5, 4.5e5)], "V double, C double, D double, E double, B double"))
    r = df.first()
    expected = dict(G=2e5, P=0.5, Q=4e5, R=5e5, RB=5.5e5, M=0.2, PB=0.45, H=1e5, U=5e4, O=0, N=-5e4)
    assert {k: pytest.approx(r[k]) for k in expected} == expected


def test_derivation_never_overwrites_nor_uses_percentages(spark):
    r = registry.derive(spark.createDataFrame([(1e6, 0.5, 7.0)], "V double, P double, G double")).first()
    assert (r.G, r.C, r.D, r.E) == (7.0, 999993.0, None, None)


@pytest.mark.parametrize(
    ("raw", "value", "repaired"),
    [("1,234.56", 1234.56, False), ("(45,000)", -45000, False), ("$2,000", 2000, False), ("-", 0, False), ("", 0, False), ("1,2O4", 1204, True), ("garbage!!", None, False), ("45.2%", 45.2, False), ("$(171,759.47)", -171759.47, False), ("$-", 0, False), (None, 0, False)],
)
def test_cells(spark, raw, value, repaired):
    r = spark.createDataFrame([(raw,)], "raw string").select(parse.parse_cell(F.col("raw")).alias("x")).first().x
    assert (r.value, r.repaired) == (value, repaired)


def test_european_cells(spark):
    df = spark.createDataFrame([("1.234.567,89",), ("1234,5",)], "raw string")
    assert [r.x for r in df.select(parse.parse_cell(F.col("raw"), F.lit(True))["value"].alias("x")).collect()] == [1234567.89, 1234.5]


def test_compatibility_forms_are_normalised(spark):
    df = parse.nfkc(spark.createDataFrame([(1, "１２３"), (2, "plain"), (3, None)], "k int, raw string"), "raw")
    assert {r.k: r.raw for r in df.collect()} == {1: "123", 2: "plain", 3: None}


def test_identity_scores(spark):
    got = {r.k: r for r in catalog.queries()["identity_score"](spark, SMALL).collect()}
    assert got[1].plausible and 0.60 <= got[1].score < 0.90
    assert not got[2].plausible
    assert got[3].score == 1.0 and got[4].score == 0.0 and got[5].score == 1.0 and got[6].score == 0.78


@pytest.mark.parametrize(
    ("observed", "proposed", "kind"),
    [(-500, 500, "sign_error"), (12345, 1234, "extra_character"), (1234, 12345, "dropped_character"), (1234000, 1234, "separator_or_magnitude_error"), (1324, 1234, "digit_transposition"), (1239, 1234, "ocr_character_misread"), (987654, 1234, "unexplained_substitution"), (5, 5, "formatting_only")],
)
def test_error_kinds(spark, observed, proposed, kind):
    df = spark.createDataFrame([(float(observed), float(proposed))], "o double, p double")
    got = df.select(scalars.classify_error(F.col("o"), F.col("p")).alias("k")).first().k
    assert got == kind


def test_clean_schedule_has_no_failures_and_identifies(spark):
    df = schedule(spark)
    assert certify.failures(df).count() == 0
    columns = ["V", "C", "G", "D", "Q", "E", "B", "U", "O"]
    r = identify.identify(df, columns, ["portfolio_id"]).first()
    assert r.status == "success" and r.mapping == ", ".join(f"{c}={c}" for c in sorted(columns, key=columns.index))


def test_identification_follows_permuted_columns(spark):
    df = schedule(spark).select("portfolio_id", F.col("B").alias("a"), F.col("E").alias("b"), F.col("Q").alias("c"), F.col("V").alias("d"), F.col("D").alias("e"), F.col("C").alias("f"), F.col("G").alias("g"), F.col("O").alias("h"), F.col("U").alias("i"))
    r = identify.identify(df, list("abcdefghi"), ["portfolio_id"]).first()
    assert r.mapping == "a=B, b=E, c=Q, d=V, e=D, f=C, g=G, h=O, i=U"
    scaled = identify.identify(df.select("portfolio_id", *[(F.col(c) * 10).alias(c) for c in "abcdefghi"]).orderBy(F.desc("d")), list("abcdefghi"), ["portfolio_id"]).first()
    assert scaled.mapping == r.mapping
    one_sided = identify.identify(df.drop("h", "i"), list("abcdefg"), ["portfolio_id"]).first()
    assert one_sided.status == "insufficient"


def test_search_needs_both_sides():
    rng = np.random.default_rng(1)
    assert identify.search(rng.uniform(1, 1e6, (12, 5)))[0] == {}


def test_identification_takes_all_rows_of_a_section(spark):
    columns = ["V", "C", "G", "D", "Q", "E", "B", "U", "O"]
    many = [list(map(float, [r[c] for c in columns])) for r in schedule(spark).collect()] * 75
    wrong = [[x[k] * (3 if k in (4, 5) else 1) for k in range(9)] for x in many]
    blank = [[0.0] * 9] * 20
    found = {}
    for name, rows in {"few": many[:-40] + wrong[:40] + blank, "late": many[:400] + wrong[:200], "early": wrong[:200] + many[:400]}.items():
        df = spark.createDataFrame([(1, *x) for x in rows], "portfolio_id int, " + ", ".join(f"{c} double" for c in columns)).coalesce(1)
        found[name] = identify.identify(df, columns, ["portfolio_id"]).first()
    assert found["few"].status == "success" and found["few"].mapping == ", ".join(f"{c}={c}" for c in columns)
    assert "E=E" not in found["late"].mapping and "Q=Q" not in found["late"].mapping
    assert found["late"] == found["early"]


@pytest.mark.parametrize(("column", "factor"), [("D", 10), ("C", 10), ("Q", 10), ("E", 10), ("G", -1), ("V", 10)])
def test_planted_errors_are_recovered(spark, column, factor):
    df = schedule(spark)
    right = df.where("job_id = 5").first()[column]
    wrong = df.withColumn(column, F.when(F.col("job_id") == 5, F.col(column) * factor).otherwise(F.col(column)))
    failing = wrong.join(certify.failures(wrong).select("job_id").distinct(), "job_id", "left_semi")
    got = repair.repairs(failing, ["V", "C", "G", "D", "Q", "E", "B"], ["job_id"]).collect()
    assert [(r.job_id, r.column, r.observed, r.proposed) for r in got] == [(5, column, right * factor, right)]


def test_two_wrong_cells_or_none():
    row = dict(V=900.0, C=700.0, G=200.0, D=420.0, Q=280.0, E=540.0, B=500.0)
    assert repair.repair(row) is None or not repair.repair(row)
    assert repair.repair(row | {"G": 2000.0}) == {"G": 200.0}


def test_totals_statuses(spark):
    got = {r.status for r in catalog.queries()["totals_assess"](spark, SMALL).collect()}
    assert got <= {"pass", "pass_after_corrections", "conflicts", "total_row_error"} and "pass_after_corrections" in got


def one_job(spark, **v):
    row = dict(portfolio_id=1, period="2025-12-31", job_id=1, V=1_000_000, C=800_000, D=400_000, E=500_000, B=500_000) | v
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'period' else 'long'}" for k in row))


def test_signal_examples(spark):
    done = one_job(spark, D=800_000, E=1_000_000, B=400_000)
    assert signals.trapped_cash(done).count() == 0
    near = one_job(spark, D=760_000, E=950_000, B=880_000)
    assert signals.trapped_cash(near).first().severity == 1.0
    loss = one_job(spark, C=1_050_000, D=1_050_000, E=1_000_000, B=1_000_000)
    assert signals.loss_jobs(loss).first().dollars == 50_000 and signals.cost_overrun(loss).count() == 0
    assert signals.job_borrow(one_job(spark, B=900_000)).first().severity == 1.0


def test_complete_jobs_are_a_terminal_block(spark):
    rows = [(1, "p", k, d, 10, e, 20) for k, (d, e) in enumerate([(10, 20), (3, 4), (10, 20), (10, 20)])]
    df = spark.createDataFrame(rows, "portfolio_id int, period string, job_id int, D int, C int, E int, V int")
    assert sorted(r.job_id for r in assemble.terminal_block(df).collect()) == [2, 3]


def test_assembly_joins_pages_and_widens(spark):
    pages = [
        (1, 0, ["a", "b"], [["1", "2"]]), (1, 1, ["a", "b"], [["a", "b"], ["3", "4"]]), (1, 2, ["c"], [["5"], ["6"]]), (2, 0, ["x"], [["1"]]),
    ]
    df = spark.createDataFrame(pages, "doc_id long, chunk_id int, headers array<string>, rows array<array<string>>")
    got = {(r.doc_id, r.table_id): (r.headers, r.rows) for r in assemble.assemble(df).collect()}
    assert got == {(1, 0): (["a", "b", "c"], [["1", "2", "5"], ["3", "4", "6"]]), (2, 0): (["x"], [["1"]])}


def test_csv_source_end_to_end(spark, tmp_path):
    lines = ["Work in Progress for the year ended December 31, 2025", "", "Job ID;Job Name;Contract Price;Est. Total Cost;Costs to Date;Billed to Date"]
    lines += [f"{n};Job {n};{v:,};{c:,};{round(c * p):,};{b:,}" for n, v, c, p, b in JOBS] + ["TOTAL;;7,900,000;6,280,000;1;2"]
    (tmp_path / "wip.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "x.bin").write_bytes(b"%PDF-1.4")
    read = files.read_binary(spark, str(tmp_path))
    assert sorted(r.type for r in read.collect()) == ["csv", "pdf"]
    r = files.tables(files.grids(read)).first()
    assert r.headers[2] == "Contract Price" and len(r.rows) == 9 and r.rows[0][2] == "500,000"
    dated = parse.period_ends(spark.createDataFrame([(1, " ".join(r.preamble))], "k int, text string"), "k", "text").first()
    assert str(dated.reporting_date) == "2025-12-31"


def test_groups_link_by_id_over_periods(spark):
    rows = [("c", "1", "2023", "24-1", "A"), ("c", "2", "2024", "24 1", "A"), ("c", "3", "2024", "24-2", "B"), ("c", "4", "2025", "24-1", "A")]
    got = {r.obs_id: r.group_id for r in periods.match_groups(spark.createDataFrame(rows, "block string, obs_id string, period string, job_id string, name string")).collect()}
    assert got["1"] == got["2"] == got["4"] != got["3"]


def test_groups_link_by_score(spark):
    rows = [
        ("c", "a1", "2023", None, "Willow Transit Center North", 10.0, 10.0), ("c", "a2", "2024", None, "Willow Transit Centre North", 20.0, 20.0),  # nearly equal names: 0.86, too little
        ("c", "b1", "2023", "", "Maple Street Fire Station Annexes", 10.0, 10.0), ("c", "b2", "2024", "", "Maple Street Fire Station Annexes.", 20.0, 20.0),
        ("c", "n1", "2023", None, "Great Northern Interceptor Sewer Rehabilitation Stage Two Contract Nine East", 1.0, 1.0), ("c", "n2", "2024", None, "Great Northern Interceptor Sewer Rehabilitation Stage Two Contract Nine Eastt", 2.0, 2.0),
        ("c", "e1", "2023", None, "Oak Hall", 10.0, 10.0), ("c", "e2", "2024", "24-7", "OAK HALL", 20.0, 20.0),  # an id, the earlier report has none
        ("c", "f1", "2023", "7", "Alpha Works", 10.0, 10.0), ("c", "f2", "2024", "7", "Zulu Kiosk", 20.0, 20.0),  # names conflict: 0.78
        ("c", "g1", "2023", "8", "", 10.0, 10.0), ("c", "g2", "2024", "8", "", 5.0, 20.0), ("c", "g3", "2025", "8", "", 11.0, 21.0),  # cost to date falls, then two groups score alike
        ("c", "h1", "2023", "9", "Ash Rd", 10.0, 10.0), ("c", "h2", "2023", "10", "Ash Rd", 10.0, 10.0), ("c", "h3", "2024", None, "Ash Rd", 20.0, 20.0),  # no lead
        ("d", "h4", "2024", "9", "Ash Rd", 20.0, None),
    ]
    got = {r.obs_id: (r.block, r.group_id) for r in periods.match_groups(spark.createDataFrame(rows, "block string, obs_id string, period string, job_id string, name string, D double, B double")).collect()}
    same = {(x, y) for x in got for y in got if x < y and got[x] == got[y]}
    assert same == {("b1", "b2"), ("n1", "n2"), ("e1", "e2")}


def test_groups_of_clear_names_need_no_pairs(spark, monkeypatch):
    shape = "block string, obs_id string, period string, job_id string, name string, D double, B double"
    clear = [("c", f"{k}/{y}", str(y), f"24-{k}" if (k + y) % 3 else None, f"Works w{k}x Section {k}", float(y), None) for k in range(40) for y in (2021, 2022, 2023)]
    odd = [("c", "z1", "2021", "24-5", "", 1.0, 1.0), ("c", "z2", "2022", "77", "Works w9x Section 9", 9e9, 1.0), ("c", "y1", "2021", None, "Ash Road", 5.0, 5.0), ("c", "y2", "2022", None, "Ash Road", 1.0, 5.0)]
    scored, given = periods.scored_pairs, []
    monkeypatch.setattr(periods, "scored_pairs", lambda o: given.append({r.obs_id for r in o.select("obs_id").collect()}) or scored(o))

    def groups(rows):
        return {r.obs_id: r.group_id for r in periods.match_groups(spark.createDataFrame(rows, shape)).collect()}

    got = groups(clear)
    assert given == [] and len(set(got.values())) == 40 and all(len({got[f"{k}/{y}"] for y in (2021, 2022, 2023)}) == 1 for k in range(40))
    assert sorted(set(got.values())) == list(range(40)) and [got[f"{k}/2021"] for k in sorted(range(40), key=lambda k: f"{k}/2021")] == list(range(40))
    got = groups(clear + odd)
    assert given == [{"z1", "z2", "y1", "y2", *[f"{k}/{y}" for k in (5, 9) for y in (2021, 2022, 2023)]}]
    assert got["y1"] != got["y2"] and sorted(set(got.values())) == list(range(max(got.values()) + 1))


def test_groups_equal_linking_of_all(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = ["oak", "elm", "north", "south", "hall", "school", "95", "bridge", "lot", *[f"u{k}" for k in range(60)]]
    rows = [(rng.choice(["c", "d"]), f"o{k}", str(rng.integers(2020, 2024)), rng.choice([None, "", *map(str, range(60))]), " ".join(rng.choice(vocabulary, rng.integers(0, 5))), float(rng.integers(0, 9)), float(k % 7)) for k in range(300)]
    df = spark.createDataFrame([tuple(x if x is None or isinstance(x, float) else str(x) for x in r) for r in rows], "block string, obs_id string, period string, job_id string, name string, D double, B double")
    got = sorted(tuple(r) for r in periods.match_groups(df).collect())
    everything = df.select("block", periods.norm_name(F.col("name")).alias("norm")).distinct()
    monkeypatch.setattr(periods, "_tangled_names", lambda o, automatic: everything)
    assert got == sorted(tuple(r) for r in periods.match_groups(df).collect())


def test_prefix_keys_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["oak", "elm", "north", "south", "hall", "school", "i", "95", "hov", "bridge", "lot"]
    rows = [("c", str(k), str(2020 + k % 2), rng.choice([None, "1", "2", "3"]), " ".join(rng.choice(vocabulary, rng.integers(1, 6)))) for k in range(120)]
    df = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], "block string, obs_id string, period string, job_id string, name string")
    args = [F.col(f"{s}.{c}") for s in "ab" for c in ("job_id", "name", "name")]
    plain = df.alias("a").crossJoin(df.alias("b")).where("a.period > b.period").select(F.col("a.obs_id").alias("a"), F.col("b.obs_id").alias("b"), scalars.identity_score(*args).alias("s")).where(F.col("s") >= periods.RIVAL)
    assert {tuple(r) for r in periods.scored_pairs(df).select("a", "b", "score").collect()} == {tuple(r) for r in plain.collect()} != set()


def test_all_plausible_partners_are_candidates(spark):
    rows = [("c", str(y), str(y), "24-1", "") for y in range(2019, 2025)]
    rows += [("c", "a", "2019", "", "Ash Rd"), ("c", "b", "2020", None, "ASH  RD."), ("c", "d", "2021", "9", "ash rd"), ("c", "e", "2021", "7", "Elm Rd"), ("c", "g", "2019", "", "Road Station"), ("c", "h", "2020", "", "Station Road"), ("d", "f", "2020", "", "Ash Rd")]
    got = {}
    for r in periods.matching_candidates(spark.createDataFrame(rows, "block string, obs_id string, period string, job_id string, name string")).collect():
        got.setdefault(r.obs_id, {})[r.match_id] = (round(r.score, 2), r.rank)
    assert got["2019"] == {str(y): (1.0, y - 2019) for y in range(2020, 2025)}
    assert got["a"] == {"b": (1.0, 1), "d": (1.0, 2)} and got["d"].keys() == {"a", "b"}
    assert not {"e", "f", "g", "h"} & got.keys()


def test_reports_and_sinks(spark, tmp_path):
    df = schedule(spark)
    text = reports.certificate(certify.witnesses(df), ["portfolio_id"]).first().certificate
    assert "G=V-C: 8 of 8 rows hold" in text
    findings = spark.createDataFrame([(1, 0, "D", 1.0, 2.0)], "portfolio_id int, row int, column string, observed double, proposed double")
    out = reports.json_reports(portfolio.kpis(df), findings, ["portfolio_id"])
    reports.write_json(out, str(tmp_path / "json"))
    reports.write_csv(df, findings, str(tmp_path / "csv"))
    assert '"proposed":2.0' in spark.read.text(str(tmp_path / "json")).first().value
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/schedule")).count() == 8


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = schedule(spark)
    df.write.parquet(str(tmp_path / "in"))
    kpis = lambda x: portfolio.kpis(x)
    process_arrivals(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "), kpis, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == 1 and got.select(*sorted(got.columns)).first() == kpis(df).select(*sorted(got.columns)).first()


def test_cc_lattice(spark):
    rows = [(1, "p", k, rp, rt - rp, rt, kp, kt - kp, kt, rp - kp, rt - rp - kt + kp, rt - kt) for k, (rp, rt, kp, kt) in enumerate([(10, 100, 8, 90), (20, 300, 15, 250), (0, 50, 0, 60), (7, 77, 5, 70)])]
    cols = ["RP", "RC", "RT", "KP", "KC", "KT", "GP", "GC", "GT"]
    df = spark.createDataFrame(rows, "portfolio_id int, period string, job_id int, " + ", ".join(f"{c} long" for c in cols))
    got = {(r.a, r.b, r.s) for r in identify.column_sums(df, cols, ["portfolio_id"]).collect()}
    assert {("RP", "RC", "RT"), ("KP", "KC", "KT"), ("GP", "GC", "GT")} <= got


def test_derived_table_has_a_row_for_each_job_and_date(spark):
    j = tables.wip_jobs(spark, SMALL)
    assert j.count() == 3606 == j.select("job_id", "period").distinct().count()
