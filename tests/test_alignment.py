"""Bands of displaced cells: moves that are found, that tie, that no move explains, and nothing at all."""

from jobledger.operators import alignment, review

ROLES = ["V", "C", "G", "D", "Q", "E", "B"]
SHAPE = "section int, band int, row int, cells array<double>"


def book(section, band, change, n=6):
    out = []
    for k in range(n):
        v, c, d = 1000.0 * (k + 3) + 137 * k * k, 700.0 * (k + 3) + 71 * k, 210.0 * (k + 1) + 13 * k
        out.append((section, band, k, change([v, c, v - c, d, c - d, v * d / c, 90.0 * k * k + 55])))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SHAPE)
    return df, {(r["section"], r["band"]): (r["status"], r["shift"], r["from_column"]) for r in alignment.shifted_bands(df, ROLES, ["section"]).collect()}


def test_moves_are_found_and_undone(spark):
    same = lambda x: x
    rows = book(1, 0, same) + book(1, 1, lambda x: [None, *x[:6]]) + book(2, 0, same) + book(2, 1, lambda x: [*x[:2], *x[3:], None]) + book(3, 0, same)
    df, got = found(spark, rows)
    assert got == {(1, 1): ("shifted", -1, 0), (2, 1): ("shifted", 1, 2)}
    back = alignment.realigned(df, alignment.shifted_bands(df, ROLES, ["section"]), len(ROLES), ["section"]).collect()
    want = {(s, b, k): c for s, b, k, c in book(1, 1, lambda x: [*x[:6], None]) + book(2, 1, lambda x: [*x[:2], None, *x[3:]]) + book(3, 0, same)}
    assert len(back) == len(rows)
    for r in back:
        key = (r["section"], r["band"], r["row"])
        assert key not in want or r["cells"] == want[key]


def test_unexplained_scattered_and_short_bands(spark):
    wrong = lambda x: [x[0] * 7, x[1], x[2] + 99, x[3] * 3, x[4], x[5] + 61, x[6]]
    _, got = found(spark, book(1, 0, lambda x: x) + book(1, 1, wrong) + book(2, 0, wrong) + book(2, 1, wrong) + book(3, 0, wrong, 2) + book(4, 0, lambda x: [None] * 7))
    assert got == {(1, 1): ("unresolved", None, None)}


def test_without_rows(spark):
    df, got = found(spark, [])
    assert got == {} and alignment.realigned(df, alignment.shifted_bands(df, ROLES, ["section"]), len(ROLES), ["section"]).count() == 0


def test_promoted_columns_have_one_variable(spark):
    rows = [(1, 4, "G"), (1, 4, "G"), (1, 5, "Q"), (1, 5, "R"), (2, None, "E"), (2, 6, None)]
    got = review.promoted(spark.createDataFrame(rows, "s int, column int, variable string"), ["s"]).collect()
    assert {(r["s"], r["column"], r["variable"]) for r in got} == {(1, 4, "G"), (2, None, "E")}
