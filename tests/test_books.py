"""Parse chain, totals, completed contracts, layouts, workbooks and the accepted state, by planted cases."""

import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobledger.operators import accepted, assemble, contracts, layout, parse, reading, review, signals
from jobledger.plans import books, reports
from jobledger.sources import files

SMALL = "/root/testdata/sf0.001"


def cells_of(rows, headers):
    return [(1, i, j, h, r[j]) for i, r in enumerate(rows) for j, h in enumerate(headers)]


def test_parse_chain_repairs_numeric_columns_only_and_finds_totals(spark):
    rows = [["BOSS", "1,000", "800", "10%", "x"], ["SOIL 5", "2,OOO", "1,500", "40%", "x"], ["", "3,000", "2,500", "50%", "x"], ["", "6,000", "4,800", "", ""], ["Lodge", "500", "n/a", "7%", "x"], ["Grand total", "6,500", "4,800", "", ""]]
    df = spark.createDataFrame(cells_of(rows, ["Job", "Contract", "Cost", "% done", "Note"]), "t int, row int, col int, header string, raw string")
    values, found = parse.parsed_tables(df, ["t"])
    got = {(r.row, r.col): (r.value, r.flag) for r in values.collect()}
    assert {c for _, c in got} == {1, 2, 3}  # labels and notes never become numbers
    assert got[1, 1] == (2000.0, "repaired") and got[4, 2] == (None, "unreadable") and got[0, 3] == (0.1, None) and got[2, 3][0] == 0.5
    assert {r.row: (r.label, r.total) for r in found.collect()} == {0: ("BOSS", None), 1: ("SOIL 5", None), 2: ("Row 3", None), 3: ("Row 4", None), 4: ("Lodge", None), 5: ("Grand total", "label")}
    checked = {r.col: (r.stated, r.computed, r.matches) for r in parse.checked_totals(values, found, ["t"]).collect()}
    assert checked[1] == (6500.0, 12500.0, False)  # two money columns are too few for sums to tell a total
    three = [[str(v) for v in (k * 1000, k * 700, k * 300)] for k in (1, 2, 5)]
    body = [["a", *three[0]], ["b", *three[1]], ["", "3000", "2100", "900"], ["c", *three[2]], ["d", "10", "20", "30"], ["", "11010", "7720", "3330"]]
    df = spark.createDataFrame(cells_of(body, ["Job", "V", "C", "G"]), "t int, row int, col int, header string, raw string")
    values, found = parse.parsed_tables(df, ["t"])
    assert {r.row: r.total for r in found.collect() if r.total} == {2: "section", 5: "body and totals"}
    assert {r.col: (r.matches, r.includes_subtotals) for r in parse.checked_totals(values, found, ["t"]).collect()} == {k: (True, True) for k in (1, 2, 3)}


def test_trailing_totals_of_long_sections_allow_for_rounding_only(spark):
    rows = [(k, "1997-12-31", i, 10**10, 10**9, 10**8, 10**7) for k in (1, 2, 3) for i in range(60)]
    sums = [60 * 10**10, 60 * 10**9, 60 * 10**8, 60 * 10**7]
    rows += [(1, "1997-12-31", 99, *sums), (2, "1997-12-31", 99, *[x + 10**9 for x in sums]), (3, "1997-12-31", 99, *[x + 30 for x in sums])]
    df = spark.createDataFrame(rows, "portfolio_id int, period string, row int, V long, C long, G long, D long")
    assert sorted((r.portfolio_id, r.matching) for r in review.trailing_totals(df, ["V", "C", "G", "D"]).collect()) == [(1, 4), (3, 4)]
    two = [(4, "1997-12-31", i, 10**11, 10**11, 10**11, 10**11) for i in range(3)] + [(4, "1997-12-31", 3, *[3 * 10**11 + 10**9] * 4)]
    assert review.trailing_totals(spark.createDataFrame(two, df.schema), ["V", "C", "G", "D"]).count() == 0  # a third of a percent off


def test_short_readings_equal_the_general_one(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("0123456789,,..$ %-()OBSl|x"), rng.integers(1, 9))) for _ in range(3000)]
    texts += ["$ 1,234", "1,234.00", "1.234", "1,23", "45%", "1,2O4", "$ 1,2O4.5%", "BOSS 12", "12\n", "$", "", None, "1,234,567.5", "1.234.567,8", "\u00a05", "0", "007"]
    df = spark.createDataFrame([(x, e) for x in texts for e in (False, True)], "raw string, eu boolean")
    pairs = [(parse.parse_cell(F.col("raw"), F.col("eu"), r), parse._general_cell(F.col("raw"), F.col("eu"), r)) for r in (False, True)]
    assert df.select("raw", "eu", *[c.alias(f"{s}{k}") for k, p in enumerate(pairs) for s, c in zip("ab", p)]).where("not (a0 <=> b0 and a1 <=> b1)").collect() == []
    votes = df.where("eu and raw is not null").select(F.monotonically_increasing_id().alias("k"), "raw")
    s = F.regexp_replace(parse.clean(F.col("raw")), f"^[{parse.CURRENCY} ()%]+|[{parse.CURRENCY} ()%]+$", "")
    plain = votes.select("k", parse.is_us(s).cast("int").alias("us"), (~parse.is_us(s) & parse.is_european(s)).cast("int").alias("eu"))
    assert sorted(map(tuple, parse.decimal_votes(votes, ["k"], "raw").select("k", "us", "eu").collect())) == sorted(map(tuple, plain.collect()))


def test_whole_columns_read_as_single_cells_do(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("0123456789,,..$ %-()OBSl|x"), rng.integers(1, 9))) for _ in range(3000)]
    texts += ["$ 1,234", "1,234.00", "1.234", "1,23", "45%", "1,2O4", "$ 1,2O4.5%", "(1,000)", "(-5)", "-$7", "\u2014", "\u20ac 1.000", "12\n", "$", "", None, "1.234.567,8", "\u00a05", "007", "9" * 320, "1." + "3" * 320, "1." + "3" * 450, "1" + ",000" * 101]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, raw string")
    forms = [(e, r) for e in (False, True) for r in (False, True)]
    native = df.select("k", parse._filled(F.col("raw")).alias("f"), *[parse.parse_cell(F.col("raw"), F.lit(e), r).alias(f"x{n}") for n, (e, r) in enumerate(forms)]).orderBy("k").collect()
    raw = pa.array([x or "" for x in texts])
    assert reading.filled_cells(raw).tolist() == [r.f for r in native]
    for n, (e, r) in enumerate(forms):
        values, repaired = reading.read_cells(raw, e, r)
        assert [(None if np.isnan(v) else v, bool(w)) for v, w in zip(values, repaired)] == [(x[f"x{n}"].value, x[f"x{n}"].repaired) for x in native]
    tables = df.select((F.col("k") % 150).alias("t"), "raw")
    voted = {r.t: r.convention == "eu" for r in parse.decimal_votes(tables, ["t"], "raw").collect()}
    assert {t: reading.is_european_table(pa.array([x or "" for x in texts[t::150]])) for t in voted} == voted and len(set(voted.values())) == 2


def test_tables_with_gaps_repeats_and_european_numbers(spark):
    rows = [(1, 0, 0, "Job", "a"), (1, 0, 1, "V", "1.000"), (1, 0, 2, "Pct", "50"), (1, 2, 0, "Job", " b  c "), (1, 2, 0, "Job", "b"), (1, 2, 1, "V", "2.500,50"), (1, 2, 2, "Pct", "100"), (1, 5, 1, None, "n/a"), (1, 5, 3, "Note", None), (1, 2, 1, "V", "7,5")]
    rows += [(2, r, 0, "V", str(r)) for r in (3, 1)] + [(3, 9, None, None, "x")]
    df = spark.createDataFrame(rows, "t int, row int, col int, header string, raw string")
    values, found = parse.parsed_tables(df, ["t"])
    assert sorted((r.t, r.row, r.col, r.value, r.flag) for r in values.where("value is not null").collect()) == [(1, 0, 1, 1000.0, None), (1, 0, 2, 0.5, None), (1, 2, 1, 7.5, None), (1, 2, 1, 2500.5, None), (1, 2, 2, 1.0, None), (2, 1, 0, 1.0, None), (2, 3, 0, 3.0, None)]
    assert [tuple(r) for r in values.where("value is null").select("t", "row", "col", "flag").collect()] == [(1, 5, 1, "unreadable")]
    assert {(r.t, r.row): r.label for r in found.collect()} == {(1, 0): "a", (1, 2): "b c", (1, 5): "Row 6", (2, 1): "Row 2", (2, 3): "Row 4", (3, 9): "Row 10"}
    native = parse.row_labels(df, ["t"], "row", "col", "raw")
    assert {tuple(r) for r in native.collect()} == {tuple(r) for r in found.select("t", "row", "label").collect()}


@pytest.mark.parametrize("name", ["printed_totals", "parsed_schedules"])
def test_printed_books_are_made_and_read_once(spark, name):
    plan = getattr(books, name)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1  # was scanned anew for the vote, the kinds of columns, the labels, the values and the totals
    assert plan.count("FlatMapGroupsIn") == 1


def test_lines_give_the_totals_that_values_and_rows_give(spark):
    rows = [["a", "100", "70", "30"], ["b", "200", "140", "60"], ["Subtotal", "300", "210", "90"], ["c", "50", "40", "10"], ["Total", "351", "251", "100"]]
    df = spark.createDataFrame(cells_of(rows, ["Job", "V", "C", "G"]), "t int, row int, col int, header string, raw string")
    lines = parse.parsed_lines(df, ["t"])
    assert [(r.row, r.total, r.last) for r in lines.orderBy("row").collect()] == [(0, None, False), (1, None, False), (2, "label", False), (3, None, False), (4, "label", True)]
    once = sorted(map(tuple, parse.checked_lines(lines, ["t"]).collect()))
    assert once == sorted(map(tuple, parse.checked_totals(*parse.parsed_tables(df, ["t"]), ["t"]).collect()))
    assert once == [(1, 1, 351.0, 350.0, True, False), (1, 2, 251.0, 250.0, True, False), (1, 3, 100.0, 100.0, True, False)]


def test_totals_by_blocks_equal_a_fold_over_rows(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], set()
    for t in range(6):
        section, body, totals, ns, nb = np.zeros(3), np.zeros(3), np.zeros(3), 0, 0
        for k in range(400):
            choice = rng.random()
            v = section.copy() if choice < 0.03 * (t % 3) else body + totals if choice > 0.99 else body.copy() if choice > 0.98 else rng.integers(0, 900, 3).astype(float)
            said = rng.random() < 0.01
            rows.append((t, k, *map(float, v), "Total" if said else "x"))
            reason = "label" if said else None
            for name, n, sums in (("section", ns, section), ("body", nb, body), ("body and totals", nb, body + totals)):
                told = abs(sums) > 1
                if reason is None and n >= 2 and told.sum() >= 3 and (abs(v - sums) <= 1 + 0.005 * abs(sums))[told].all():
                    reason = name
            if reason is None:
                section, body, ns, nb = section + v, body + v, ns + 1, nb + 1
            elif reason != "label":
                totals, section, ns = totals + v, section * 0, 0
            if reason:
                expected.add((t, k, reason))
    df = spark.createDataFrame(rows, "t int, row int, V double, C double, G double, label string")
    assert {tuple(r) for r in parse.total_rows(df, ["t"], "row", ["V", "C", "G"], "label").collect()} == expected and len({x[2] for x in expected}) == 4


def test_non_finite_numbers_are_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(parse.finite(F.col("x"))).collect()] == [None, None, None, 2.0, None]


def book_of_contracts(n=12, seed=1):
    rng = np.random.default_rng(seed)
    rt = rng.integers(200_000, 900_000, n).astype(float)
    kt = np.round(rt * rng.uniform(0.78, 0.88, n))
    rp = np.round(rt * rng.uniform(0.1, 0.9, n))
    kp = np.round(kt * rng.uniform(0.1, 0.9, n))
    return {"RT": rt, "KT": kt, "GT": rt - kt, "RP": rp, "KP": kp, "GP": rp - kp, "RC": rt - rp, "KC": kt - kp, "GC": rt - rp - kt + kp}


def test_completed_contracts_are_read_by_their_sums():
    b = book_of_contracts()
    roles, open_ = contracts.lattice(np.stack([b[k] for k in ("RT", "KT", "GT")], axis=1))
    assert (roles, open_) == ({"RT": 0, "KT": 1, "GT": 2}, False)
    order = ["GC", "RT", "KP", "GT", "RP", "KT", "GP", "KC", "RC"]
    roles, open_ = contracts.lattice(np.stack([b[k] for k in order], axis=1))
    assert open_ and [order[roles[r]] for r in ("RT", "KT", "GT")] == ["RT", "KT", "GT"]
    named = {r: order[i] for r, i in roles.items()}
    swap = {"P": "C", "C": "P", "T": "T"}
    exact = {r: r for r in roles}
    assert len(roles) == 9 and named in (exact, {r: r[0] + swap[r[1]] for r in roles})  # prior and current can't be told apart
    assert contracts.lattice(np.random.default_rng(2).uniform(1, 9, (9, 4))) == ({}, False)


def test_cc_status_culprits_and_race(spark):
    b = book_of_contracts()
    rows = pd.DataFrame(b).astype(int).assign(s=1, job=range(12))
    rows.loc[3, "KT"] += 4000
    rows.loc[5, "RC"] *= 10
    rows["BC"] = rows["RT"]
    rows.loc[7, "BC"] -= 900
    rows.loc[9, ["RT", "KP"]] += 777
    df = spark.createDataFrame(rows)
    got = {r.job: (r.culprit, r.proposed) for r in contracts.cc_findings(df, ["s", "job"]).collect()}
    assert got == {3: ("KT", b["KT"][3]), 5: ("RC", b["RC"][5]), 7: ("BC", b["RT"][7]), 9: (None, None)}
    r = contracts.identify_cc(spark.createDataFrame(pd.DataFrame({k: b[k] for k in ("RT", "KT", "GT")}).assign(s=1)), ["RT", "KT", "GT"], ["s"]).first()
    assert (r.status, r.mapping, r.witnesses, r.failed) == ("success", "RT=RT, KT=KT, GT=GT", 1, 0)
    shape = "s int, status string, columns int, mapped int, weight double, witnesses int"
    wip = spark.createDataFrame([(1, "success", 8, 7, 5.0, 5, False), (2, "x", 8, 2, 1.0, 1, False), (3, "x", 3, 1, 1.0, 1, False), (4, "success", 7, 7, 4.0, 4, True), (5, "x", 3, 0, 0.0, 0, False)], shape + ", all_complete boolean")
    cc = spark.createDataFrame([(1, "success", 8, 8, 9.0, 9), (2, "success", 8, 6, 3.0, 3), (3, "success", 3, 3, 1.0, 1), (4, "success", 7, 7, 6.0, 6), (5, "success", 3, 3, 1.0, 1)], shape)
    text = spark.createDataFrame([(3, "wip"), (5, None)], "s int, type string")
    race = {r.s: (r.chosen, r.resolution) for r in contracts.schema_race(wip, cc, ["s"], text).collect()}
    assert race == {1: ("wip", "wip_certified"), 2: ("cc", "math"), 3: ("wip", "text"), 4: ("cc", "math_all_complete_overlap"), 5: ("cc", "unresolved_sparse_triangle")}


def wip_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = int(rng.integers(100, 900)) * 1000
        c = int(v * rng.uniform(0.7, 0.9))
        d = int(c * rng.uniform(0.1, 0.9))
        e = round(v * d / c)
        b = int(e * rng.uniform(0.8, 1.2))
        out.append([f"Job {k}", *(f"{x:,}" for x in (v, c, v - c, d, e, b, max(e - b, 0)))])
    return out


HEADERS = ["Job", "Contract", "Cost", "Profit", "To date", "Earned", "Billed", "Under"]


def test_layouts_are_chosen_by_their_numbers():
    rows = wip_rows(18)
    first = layout.normalised(HEADERS, rows[:9], 1)
    repeated = layout.normalised([""] * 8, [HEADERS, *rows[9:]], 2, 1)
    (one,) = layout.assembled([first, repeated])
    assert [list(r) for r in one.rows] == rows and one.pages == (1, 2) and one.joins == ("below",)
    promoted = layout.normalised(rows[9], rows[10:], 2, 1)
    (one,) = layout.assembled([first, promoted])
    assert [list(r) for r in one.rows] == rows and one.joins == ("below", "recovered") and one.origin[9] == (2, -1) and "promoted" in one.issues[0]
    left = layout.normalised(HEADERS[:4], [r[:4] for r in rows], 1)
    right = layout.normalised([HEADERS[0], *HEADERS[4:]], [[r[0], *r[4:]] for r in rows], 2, 1)
    (one,) = layout.assembled([left, right])
    assert list(one.headers) == HEADERS and [list(r) for r in one.rows] == rows and one.joins == ("beside",)
    far = layout.normalised(HEADERS, rows[9:], 4, 1)
    assert len(layout.assembled([first, far])) == 2  # not on the next page
    other = layout.normalised(["a", "b"], [["x", "y"]], 2, 1)
    assert len(layout.assembled([first, other])) == 2 and layout.assembled([]) == []


def test_fragments_and_overlapping_strips(spark):
    g = layout.normalised(["a", None], [["1"], None, ["1", "2", "3"]], None)
    assert (g.headers, g.rows, g.pages) == (("a", "", ""), (("1", "", ""), ("", "", ""), ("1", "2", "3")), (1,))
    rows = wip_rows(10)
    again = [rows[4], [rows[5][0], "1", *rows[5][2:]], *rows[6:]]
    a, b = layout.normalised(HEADERS, rows[:6], 1), layout.normalised(HEADERS, again, 2, 1, True)
    one = layout.below(a, b)
    assert [list(r) for r in one.rows] == rows and one.issues == ("overlap_mismatch Job 5: [1]",)
    assert layout.overlap_of(a.rows, tuple(map(tuple, rows[6:]))) == (0, [])
    pages = [(7, 2, 0, HEADERS, rows[5:], False), (7, 1, 0, HEADERS, rows[:5], False)]
    got = layout.assemble_layouts(spark.createDataFrame(pages, "doc_id long, page int, position int, headers array<string>, rows array<array<string>>, overlaps boolean")).collect()
    assert [(r.doc_id, r.table_id, r.rows, r.pages) for r in got] == [(7, 0, rows, [1, 2])]


def workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Job</t></si><si><r><t>Con</t></r><r><t>tract</t></r></si></sst>")
        for k, rows in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")


def test_workbooks_are_read_by_their_best_sheet(spark, tmp_path):
    number = lambda ref, v, s=0: f'<c r="{ref}" s="{s}"><v>{v}</v></c>'
    notes = [['<c r="A1" t="inlineStr"><is><t>only notes</t></is></c>']]
    table = [['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="C1" t="inlineStr"><is><t>Cost</t></is></c>']]
    table += [[number(f"A{k}", k), number(f"B{k}", 1000.5 * k), number(f"C{k}", 700 * k), number(f"D{k}", 0.5, 1), number(f"F{k}", 0.125, 2)] for k in (2, 3)]
    workbook(tmp_path / "book.xlsx", [notes, table])
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04nothing")
    (tmp_path / "x.csv").write_text("Job,V\n1,2\n")
    grid = files.grids(files.read_binary(spark, str(tmp_path)))
    got = {(r.path.rpartition("/")[2], r.row): r.cells for r in grid.collect()}
    assert got["book.xlsx", 0] == ["Job", "Contract", "Cost"] and got["book.xlsx", 1] == ["2", "2001", "1400", "50%", "", "12.5%"] and got["book.xlsx", 2][1] == "3001.50"
    assert not any(n == "broken.xlsx" for n, _ in got) and got["x.csv", 1] == ["1", "2"]
    found = files.tables(grid).where("path like '%book%'").first()
    assert found.headers == ["Job", "Contract", "Cost"] and len(found.rows) == 2


def test_consensus_and_identity(spark):
    rows = [(1, "a", "money", 100.0, 1.0), (1, "a", "pct", 90.0, 5.0), (1, "b", "money", 101.0, 1.0), (1, "c", "pct", 130.0, 40.0), (2, "a", "money", 5.0, 1.0), (2, "b", "money", 50.0, 1.0), (3, "a", "pct", 7.0, 1.0)]
    got = {r.cell: (r.value, r.families, r.consistent) for r in accepted.family_consensus(spark.createDataFrame(rows, "cell int, family string, kind string, value double, tolerance double"), ["cell"]).collect()}
    assert got == {1: (100.5, 3, False), 2: (27.5, 0, False), 3: (7.0, 1, False)}
    labels = spark.createDataFrame([(0, "J-12 Main St"), (1, "2024-07: Bridge"), (2, "Main St 5"), (3, "  "), (4, None), (5, "A101")], "k int, label string")
    named = {r.k: tuple(r.x) for r in labels.select("k", accepted.label_identity(F.col("label")).alias("x")).collect()}
    assert named == {0: ("J-12", "Main St"), 1: ("2024-07", "Bridge"), 2: (None, "Main St 5"), 3: (None, None), 4: (None, None), 5: ("A101", None)}


@pytest.mark.parametrize("name", ["cc_identified", "schedule_kinds", "page_layouts", "emitted_columns"])
def test_book_queries_find_what_was_printed(spark, name):
    rows = getattr(books, name)(spark, SMALL).collect()
    assert rows
    if name == "cc_identified":
        assert np.mean(["c0=RT" in r.mapping or "c6=RT" in r.mapping for r in rows if r.witnesses]) > 0.9  # without prior periods the current is the total
    if name == "schedule_kinds":
        assert np.mean([r.chosen == "wip" for r in rows if r.table == "wip"]) > 0.9 and all(r.chosen == "cc" for r in rows if r.table == "cc")
    if name == "page_layouts":
        jobs = {f"{r.portfolio_id}/{r.period}": r["count"] for r in books.t.wip_jobs(spark, SMALL).groupBy("portfolio_id", "period").count().collect()}
        large = [r for r in rows if jobs[r.doc_id] >= 12]
        assert all(r.rows == jobs[r.doc_id] for r in rows if r.tables == 1) and np.mean([r.tables == 1 for r in large]) > 0.9
    if name == "emitted_columns":
        wrong = {(r.portfolio_id, r.period) for r in books.t.wip_jobs(spark, SMALL).where("job_id % 97 = 0 and D * 9 > 100 and G <> 0").collect()}
        assert {(r.portfolio_id, r.period) for r in rows if r.status == "failing"} == wrong and {r.variable for r in rows if r.status == "failing"} <= {"D"}


def test_printed_schedule_totals_and_dashes(spark):
    rows = [(1, 1000, -2500, 0.125), (2, None, 500, None), (3, 234, 0, float("inf"))]
    df = spark.createDataFrame([(7, *r) for r in rows], "s int, job_id int, V long, N long, P double")
    got = [tuple(r) for r in reports.printed_schedule(df, ["s"], "job_id", F.col("job_id").cast("string")).orderBy("line").collect()]
    assert got == [(7, 1, "1", "1,000", "12.5%", "(2,500)"), (7, 2, "2", "—", "—", "500"), (7, 3, "3", "234", "—", "0"), (7, 4, "Total", "1,234", "", "(2,000)")]
    assert reports.printed_schedule(df.where("false"), ["s"], "job_id", F.lit("x")).count() == 0


def test_column_shapes_name_the_first_column_that_differs(spark):
    cells = [(1, c, r) for c in range(3) for r in range(4 if c != 1 else 2)] + [(2, 0, 0), (2, 1, 0)]
    got = {r.t: (r.columns, r.rows, r.error) for r in parse.column_shapes(spark.createDataFrame(cells, "t int, col int, row int"), ["t"]).collect()}
    assert got == {1: (3, 4, "column 1 has 2 rows, the first has 4"), 2: (2, 1, None)}


def _wip(spark, rows):
    return spark.createDataFrame(rows, "portfolio_id int, period string, job_id int, V long, C long, D long, E long, B long")


def test_signal_variants(spark):
    ended = (1, "a", 1, 1_000_000, 800_000, 800_000, 1_000_000, 900_000)
    early = (1, "a", 2, 1_000_000, 800_000, 400_000, 500_000, 400_000)
    beyond = (1, "a", 3, 1_000_000, 800_000, 880_000, 1_000_000, 900_000)
    jobs = _wip(spark, [ended, early, beyond])
    assert {(r.job_id, r.severity, r.dollars) for r in signals.trapped_no_runway(jobs).collect()} == {(1, 1.0, 100_000)}
    fading = _wip(spark, [(1, "a", 1, 1_000_000, 800_000, 600_000, 650_000, 0), (2, "a", 2, 1_000_000, 800_000, 600_000, 750_000, 0)])
    assert {r.job_id for r in signals.numeric_fade(fading).collect()} == {1}  # the other book's E is V*D/C
    short = _wip(spark, [(1, "a", 1, 1_000_000, 800_000, 400_000, 700_000, 690_000), (1, "a", 2, 30_000, 20_000, 8_000, 10_000, 27_000)])
    assert {r.job_id for r in signals.job_borrow_unbilled(short).collect()} == {1}  # the second is short of 9,000 only


def test_audits_of_unused_columns(spark):
    rows = [(1, "a", k, 1000 * k, 700 * k, 300 * k + k % 3, 300 * k + (400 if k == 9 else 0), None if k == 2 else 7) for k in range(1, 11)]
    df = spark.createDataFrame(rows, "portfolio_id int, period string, job_id int, V long, C long, D long, x long, y long")
    assert [(r.column, r.variable, r.rows, r.differ) for r in review.audited(df, ["x", "y"]).collect()] == [("x", "G", 10, 1)]
    assert [(r.job_id, r.finding, r.residual) for r in review.full_certification(df, ["x", "y"]).collect()] == [(9, "x is G", 400.0)]
    wide = review.with_audited(df, ["x", "y"])
    assert {r.job_id: r.G for r in wide.collect()}[9] == 3100 and "x" not in wide.columns
    same = df.withColumn("z", F.col("C") - F.col("D")).withColumn("D", F.lit(0).cast("long")).withColumn("C", F.lit(0).cast("long"))
    assert review.audited(same.drop("x", "y"), ["z"]).count() == 0  # fits nothing
    assert review.audited(df.where("false"), ["x", "y"]).count() == 0


def test_pages_of_one_number_follow_by_content(spark):
    pages = [(1, 1, ["a"], [["2"]]), (1, 1, ["a"], [["1"], [None]]), (1, 0, ["a"], [["0"]]), (2, 0, ["b"], [])]
    got = {(r.doc_id, r.table_id): (r.headers, r.rows) for r in assemble.assemble(spark.createDataFrame(pages, "doc_id long, chunk_id int, headers array<string>, rows array<array<string>>")).collect()}
    assert got == {(1, 0): (["a"], [["0"], ["1"], [None], ["2"]]), (2, 0): (["b"], [])}
