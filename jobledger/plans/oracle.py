"""The same queries as SQL for another engine, written from the definitions."""

from __future__ import annotations

WIP = """
WITH p AS (SELECT DATE '1996-12-31' AS period UNION ALL SELECT DATE '1997-12-31' UNION ALL SELECT DATE '1998-12-31'),
a AS (
  SELECT l.l_orderkey AS job_id, p.period,
         CAST(FLOOR(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS base,
         CAST(SUM(CAST(l.l_quantity AS INT)) AS BIGINT) AS q_all,
         CAST(SUM(CASE WHEN CAST(l.l_shipdate AS DATE) <= p.period THEN CAST(l.l_quantity AS INT) ELSE 0 END) AS BIGINT) AS q_done
  FROM lineitem l CROSS JOIN p GROUP BY l.l_orderkey, p.period),
b AS (
  SELECT job_id, period, q_all, q_done, base * 100 AS V,
         base * (CASE WHEN job_id % 23 = 0 THEN 104 ELSE 80 + (job_id % 5) * 3 END) AS C
  FROM a WHERE q_done > 0),
c AS (SELECT *, CAST(FLOOR(CAST(C AS DOUBLE) * q_done / q_all) AS BIGINT) AS D FROM b),
d AS (SELECT *, CAST(FLOOR(CAST(V AS DOUBLE) * D / C) AS BIGINT) AS E FROM c),
e AS (
  SELECT *, E + CAST(FLOOR(CAST(V * (job_id % 11 - 5) * (10 * q_all - 7 * q_done) AS DOUBLE) / (1000 * q_all)) AS BIGINT) AS B0 FROM d),
wip AS (SELECT e.job_id, e.period, cu.c_nationkey AS portfolio_id, V, C, V - C AS G, D, C - D AS Q, E,
       CASE WHEN B0 < 0 THEN CAST(0 AS BIGINT) WHEN B0 > V THEN V ELSE B0 END AS B
FROM e JOIN orders o ON o.o_orderkey = e.job_id JOIN customer cu ON cu.c_custkey = o.o_custkey),
bad AS (SELECT * REPLACE (CASE WHEN job_id % 97 = 0 THEN D * 10 ELSE D END AS D) FROM wip),
shape AS (SELECT *, greatest(E - B, 0) AS U, greatest(B - E, 0) AS O, CASE WHEN C > 0 THEN CAST(D AS DOUBLE) / C ELSE 0 END AS P,
          CASE WHEN V > 0 THEN CAST(V - C AS DOUBLE) / V ELSE 0 END AS m FROM wip),
cells AS (SELECT portfolio_id, period, job_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS mcol, unnest([V, C, G, D, Q, E, B]) AS value FROM wip),
cc AS (SELECT j.job_id, j.period, j.portfolio_id, coalesce(k.E, 0) AS RP, j.E - coalesce(k.E, 0) AS RC, j.E AS RT, coalesce(k.D, 0) AS KP, j.D - coalesce(k.D, 0) AS KC, j.D AS KT,
       coalesce(k.E, 0) - coalesce(k.D, 0) AS GP, j.E - coalesce(k.E, 0) - j.D + coalesce(k.D, 0) AS GC, j.E - j.D AS GT, j.B AS BC
       FROM wip j LEFT JOIN wip k ON k.job_id = j.job_id AND year(k.period) = year(j.period) - 1 WHERE j.D = j.C)
"""
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, more: str = "") -> None:
    ORACLE[name] = f"{WIP}{', ' + more if more else ''} {sql}"


_D = "CAST({} AS DOUBLE)".format


def _ramp(x: str, floor: float, full: float) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {floor}::DOUBLE) / ({full}::DOUBLE - {floor}::DOUBLE)))"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _signal(name: str, severity: str, dollars: str, where: str, source: str = "shape") -> None:
    _add(name, f"SELECT * FROM (SELECT portfolio_id, period, job_id, {severity} AS severity, {dollars} AS dollars FROM {source} WHERE {where}) WHERE severity > 0.12")


_add("wip_jobs", "SELECT * FROM wip")
_add("kpi_by_portfolio_period", """
SELECT portfolio_id, period, sum(V)::BIGINT AS total_contract_value, sum(V - C)::BIGINT AS estimated_gross_profit, sum(C - D)::BIGINT AS cost_to_complete, sum(E)::BIGINT AS earned_revenue,
       sum((V - C) - (E - D))::BIGINT AS uegp, sum(B - E)::BIGINT AS net_billing_position, sum(V - E)::BIGINT AS backlog_revenue, sum(V - B)::BIGINT AS unbilled_contract,
       sum(U)::BIGINT AS underbillings_total, sum(O)::BIGINT AS overbillings_total, count(*) AS job_count,
       CAST(sum(V - C)::BIGINT AS DOUBLE) / sum(V)::BIGINT AS gp_pct, CAST(max(V) AS DOUBLE) / sum(V)::BIGINT AS largest_job_share,
       CAST((sum(V) FILTER (r <= 5))::BIGINT AS DOUBLE) / sum(V)::BIGINT AS top5_share
FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY V DESC, job_id) AS r FROM shape) GROUP BY portfolio_id, period""")
_add("kpi_largest_job", "SELECT portfolio_id, period, job_id, V FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY V DESC, job_id) AS r FROM wip) WHERE r = 1")
_add("kpi_top5_jobs", "SELECT portfolio_id, period, job_id, V, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY V DESC, job_id) AS r FROM wip) WHERE r <= 5")
_sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in "VCDEB")
_add("consolidate_rollup", f"SELECT period, CASE WHEN D = C THEN 'cc' ELSE 'wip' END AS type, {_sums.replace('AS D', 'AS D')}, count(*) AS jobs FROM wip GROUP BY period, CASE WHEN D = C THEN 'cc' ELSE 'wip' END UNION ALL SELECT period, 'all', {_sums}, count(*) FROM wip GROUP BY period")
_add("column_sums", f"SELECT portfolio_id, period, {', '.join(f'sum({c})::BIGINT AS {c}' for c in 'VCGDQEB')} FROM wip GROUP BY portfolio_id, period")
_add("similar_completed", """
SELECT portfolio_id, period, job_id, similar_id, r AS rank FROM (
  SELECT o.portfolio_id, o.period, o.job_id, s.job_id AS similar_id,
         row_number() OVER (PARTITION BY o.portfolio_id, o.period, o.job_id ORDER BY CAST(greatest(o.V, s.V) AS DOUBLE) / least(o.V, s.V), s.job_id) AS r
  FROM wip o JOIN wip s ON s.portfolio_id = o.portfolio_id AND s.period = o.period AND s.D = s.C AND s.V > 0 AND s.V * 100 >= o.V * 35 AND s.V <= o.V * 3
  WHERE o.D < o.C AND o.V > 0) WHERE r <= 3""")
_add("book_shape", """
SELECT portfolio_id, period, job_id, CASE WHEN U > O THEN 'under' WHEN O > 0 THEN 'over' ELSE 'even' END AS side, share, book_max FROM (
  SELECT *, count(*) OVER w AS n, max(share) OVER w AS book_max FROM (SELECT *, CAST(greatest(U, O) AS DOUBLE) / V AS share FROM shape WHERE D * 100 >= C * 15 AND V > 0) WINDOW w AS (PARTITION BY portfolio_id, period)) WHERE n >= 4""")
_add("job_status", """
SELECT job_id, period, n AS flags, CASE WHEN n = 0 THEN 'green' WHEN n = 1 THEN 'amber' ELSE 'red' END AS color FROM (
  SELECT job_id, period, (V < C)::INT + (D > C)::INT + (U * 10 >= V)::INT + (O * 10 >= V)::INT AS n FROM shape)""")

_signal("signal_trapped_cash", _ramp(f"{_D('U')} / (V - E)", 0.5, 1.0), "U", "U >= 10000 AND P < 0.995 AND V - E > greatest(1.0, abs(V)::DOUBLE * 0.005::DOUBLE)")
_signal("signal_job_borrow", f"CASE WHEN C <= D THEN 1.0::DOUBLE ELSE {_ramp(_D('O') + ' / (C - D)', 0.15, 0.75)} END", "O", "O >= 10000")
_signal("signal_job_borrow_unbilled", _ramp(f"{_D('greatest((C - D) - (V - B), 0)')} / (C - D)", 0.15, 0.75), "greatest((C - D) - (V - B), 0)", "C > D AND greatest((C - D) - (V - B), 0) >= 10000")
_signal("signal_trapped_no_runway", f"CASE WHEN P >= 0.995 OR V - E <= greatest(1.0, abs(V)::DOUBLE * 0.005::DOUBLE) THEN 1.0::DOUBLE ELSE {_ramp(_D('U') + ' / (V - E)', 0.5, 1.0)} END", "U", "U >= 10000 AND P <= 1.02")
_signal("signal_loss_jobs", _clamp("-m / 0.05::DOUBLE"), "C - V", "m < 0")
_signal("signal_cost_overrun", _clamp(f"({_D('D - C')} / greatest(C, 1)) / 0.1::DOUBLE"), "D - C", "D > C", "bad")


def _book(name: str, part: str, whole: str, floor: float, full: float) -> None:
    _add(name, f"""SELECT portfolio_id, period, severity, dollars, share FROM (SELECT *, {_ramp('share', floor, full)} AS severity FROM (
      SELECT portfolio_id, period, sum({part})::BIGINT AS dollars, CAST(sum({part})::BIGINT AS DOUBLE) / sum({whole})::BIGINT AS share FROM shape GROUP BY portfolio_id, period HAVING sum({whole}) > 0 AND sum({part}) > 0)) WHERE severity > 0.12""")


_book("signal_early_concentration", "CASE WHEN P < 0.15 THEN V ELSE 0 END", "V", 0.25, 0.70)
_book("signal_thin_backlog", "CASE WHEN m >= 0 AND m < 0.05 THEN greatest(C - D, 0) ELSE 0 END", "greatest(C - D, 0)", 0.20, 0.60)
_add("signal_job_concentration", f"""SELECT portfolio_id, period, severity, dollars, share FROM (SELECT *, {_ramp('share', 0.2, 0.5)} AS severity FROM (
  SELECT portfolio_id, period, max(V) AS dollars, CAST(max(V) AS DOUBLE) / sum(V)::BIGINT AS share FROM shape GROUP BY portfolio_id, period HAVING sum(V) > 0 AND count(*) >= 2)) WHERE severity > 0.12""")
_book_q = "bk AS (SELECT portfolio_id, period, quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.5) AS med, quantile_cont(m, 0.75) AS z FROM shape GROUP BY portfolio_id, period HAVING count(*) >= 6), mo AS (SELECT * FROM shape JOIN bk USING (portfolio_id, period) WHERE m > med)"
_outlier = _ramp("abs(m - med) / (CASE WHEN z - a = 0 THEN 0.01::DOUBLE ELSE z - a END)", 2.0, 5.0)
_add("signal_margin_outlier", f"SELECT * FROM (SELECT portfolio_id, period, job_id, {_outlier} AS severity, V - C AS dollars FROM mo) WHERE severity > 0.12", _book_q)
_gap = "(m - (CAST(F AS DOUBLE) - D) / CAST(F AS DOUBLE))"
_add("signal_unrecognized_fade", f"""SELECT * FROM (SELECT portfolio_id, period, job_id, {_clamp('P')} * {_clamp(_gap + ' / 0.08::DOUBLE')} AS severity, CAST(floor({_gap} * CAST(F AS DOUBLE)) AS BIGINT) AS dollars
  FROM (SELECT *, CASE WHEN job_id % 7 = 0 THEN CAST(floor(E * 9 / 10) AS BIGINT) ELSE E END AS F FROM shape) WHERE P >= 0.35 AND F > 0 AND {_gap} * CAST(F AS DOUBLE) >= 10000) WHERE severity > 0.12""")
_add("signal_numeric_fade", f"""SELECT * FROM (SELECT portfolio_id, period, job_id, {_clamp('P')} * {_clamp(_gap + ' / 0.08::DOUBLE')} AS severity, CAST(floor({_gap} * CAST(F AS DOUBLE)) AS BIGINT) AS dollars
  FROM (SELECT *, bool_or(abs(F - CASE WHEN C > 0 THEN CAST(V AS DOUBLE) * D / C ELSE 0 END) > greatest(1.0, V::DOUBLE * 0.005::DOUBLE)) OVER (PARTITION BY portfolio_id, period) AS told
        FROM (SELECT *, CASE WHEN job_id % 7 = 0 AND portfolio_id % 2 = 0 THEN CAST(floor(E * 9 / 10) AS BIGINT) ELSE E END AS F FROM shape))
  WHERE told AND P >= 0.35 AND F > 0 AND {_gap} * CAST(F AS DOUBLE) >= 10000) WHERE severity > 0.12""")
_union = " UNION ALL ".join(f"SELECT '{n}' AS signal, portfolio_id, period, job_id, {s} AS severity, {d} AS dollars FROM {f} WHERE {w}" for n, s, d, f, w in (
    ("trapped_cash", _ramp(f"{_D('U')} / (V - E)", 0.5, 1.0), "U", "shape", "U >= 10000 AND P < 0.995 AND V - E > greatest(1.0, abs(V)::DOUBLE * 0.005::DOUBLE)"),
    ("job_borrow", f"CASE WHEN C <= D THEN 1.0::DOUBLE ELSE {_ramp(_D('O') + ' / (C - D)', 0.15, 0.75)} END", "O", "shape", "O >= 10000"),
    ("loss_jobs", _clamp("-m / 0.05::DOUBLE"), "C - V", "shape", "m < 0"),
    ("cost_overrun", _clamp(f"({_D('D - C')} / greatest(C, 1)) / 0.1::DOUBLE"), "D - C", "shape", "D > C"),
    ("margin_outlier", _outlier, "V - C", "mo", "true"),
))
_add("signal_summary", f"SELECT portfolio_id, period, signal, max(severity) AS severity, sum(dollars)::BIGINT AS dollars, count(*) AS jobs FROM ({_union}) WHERE severity > 0.12 GROUP BY portfolio_id, period, signal", _book_q)
_add("signal_ranking", f"""SELECT *, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY severity DESC, dollars DESC, signal) AS rank FROM (
  SELECT portfolio_id, period, signal, round(max(severity), 3) AS severity, sum(dollars)::BIGINT AS dollars FROM ({_union}) WHERE severity > 0.12 GROUP BY portfolio_id, period, signal)""", _book_q)
_add("signal_top_jobs", f"SELECT portfolio_id, period, signal, job_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, period, signal ORDER BY severity DESC, job_id DESC) AS r FROM ({_union}) WHERE severity > 0.12) WHERE r <= 5", _book_q)

_add("cc_jobs", "SELECT * FROM cc")
_add("cc_losses", "SELECT portfolio_id, period, job_id, 0.9::DOUBLE AS severity, -GT AS dollars FROM cc WHERE GT < 0")
_add("cc_fade", f"SELECT portfolio_id, period, job_id, {_clamp('-GC::DOUBLE / (abs(GT) + 1)')} AS severity, -GC AS dollars FROM cc WHERE GC < 0 AND -GC::DOUBLE / (abs(GT) + 1) >= 0.12")
_lattice = (("KT", "GT", "RT"), ("KP", "GP", "RP"), ("KC", "GC", "RC"), ("RP", "RC", "RT"), ("KP", "KC", "KT"), ("GP", "GC", "GT"))
_add("cc_certify", " UNION ALL ".join(f"SELECT portfolio_id, period, '{a}+{b}={s}' AS rule, count(*) AS checked, sum((abs({a} + {b} - {s}) > 2.28)::INT)::BIGINT AS failed FROM x GROUP BY portfolio_id, period" for a, b, s in _lattice), "x AS (SELECT * REPLACE (CASE WHEN job_id % 31 = 0 THEN KT + 100 ELSE KT END AS KT) FROM cc)")
_add("cc_triples", """SELECT a.portfolio_id, a.period, a.v AS a, b.v AS b, s.v AS s FROM u a JOIN u b ON a.job_id = b.job_id AND a.period = b.period AND a.k < b.k JOIN u s ON s.job_id = a.job_id AND s.period = a.period AND s.k NOT IN (a.k, b.k)
GROUP BY a.portfolio_id, a.period, a.v, b.v, s.v HAVING count(*) >= 3 AND count(*) FILTER (abs(a.x + b.x - s.x) > greatest(1.0, abs(s.x) * 0.005) + 1.0) <= greatest(1, floor(count(*) / 10))""",
     "u AS (SELECT job_id, period, portfolio_id, unnest([0,1,2,3,4,5,6,7,8]) AS k, unnest(['RP','RC','RT','KP','KC','KT','GP','GC','GT']) AS v, unnest([RP,RC,RT,KP,KC,KT,GP,GC,GT]) AS x FROM cc)")

_WIDE = "w AS (SELECT *, greatest(E - B, 0) AS U, greatest(B - E, 0) AS O, E - B AS N, V - E AS R, V - B AS RB, E - D AS H FROM bad)"
_FORMS = (
    ("G=V-C", "G", "VC", "{V} - {C}"), ("C=V-G", "C", "VG", "{V} - {G}"), ("E=V*D/C", "E", "VDC", "{V} * {D} / {C}"), ("Q=C-D", "Q", "CD", "{C} - {D}"), ("H=E-D", "H", "ED", "{E} - {D}"),
    ("H=G*D/C", "H", "GDC", "{G} * {D} / {C}"), ("N=E-B", "N", "EB", "{E} - {B}"), ("U=max(E-B,0)", "U", "EB", "greatest({E} - {B}, 0.0::DOUBLE)"), ("O=max(B-E,0)", "O", "EB", "greatest({B} - {E}, 0.0::DOUBLE)"),
    ("R=V-E", "R", "VE", "{V} - {E}"), ("RB=V-B", "RB", "VB", "{V} - {B}"),
)


def _values(form: str, moved: str = "") -> str:
    return "(" + form.format(**{c: f"({_D(c)} + 0.51::DOUBLE)" if c == moved else _D(c) for c in "VCGDEB"}) + ")"


_ALL = " UNION ALL ".join(
    f"SELECT portfolio_id, period, job_id, '{n}' AS rule, {_D(o)} - {_values(f)} AS residual, 0.51::DOUBLE + " + " + ".join(f"abs({_values(f, i)} - {_values(f)})" for i in ins) + " AS tolerance FROM w" for n, o, ins, f in _FORMS
)
_TESTS = f"{_WIDE}, x AS ({_ALL})"
_add("certify_failures", "SELECT portfolio_id, period, job_id, rule FROM x WHERE abs(residual) > tolerance", _TESTS)
_add("witness_summary", "SELECT portfolio_id, period, rule, count(*) AS checked, sum((abs(residual) <= tolerance)::INT)::BIGINT AS held FROM x GROUP BY portfolio_id, period, rule", _TESTS)
_AUDIT = " UNION ALL ".join(f"SELECT portfolio_id, period, '{n}' AS rule, count(*) AS checked, sum((abs({_D(o)} - {_values(f)}) > greatest(2.05::DOUBLE, abs({o})::DOUBLE * 2e-5::DOUBLE))::INT)::BIGINT AS failed FROM w GROUP BY portfolio_id, period HAVING count(*) >= 3" for n, o, ins, f in _FORMS if n not in ("C=V-G", "H=G*D/C"))
_add("fixed_mapping_audit", _AUDIT, _WIDE)
_INPUTS = "n AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {[o, *ins]})" for n, o, ins, f in _FORMS) + ") AS t(rule, names))"
_add("shared_unconfirmed", """SELECT job_id, period, min(variable) AS variable FROM (
  SELECT f.job_id, f.period, variable, count(*) AS k, any_value(f.nf) AS nf FROM (SELECT *, count(*) OVER (PARTITION BY job_id, period) AS nf FROM x WHERE abs(residual) > tolerance) f
  JOIN (SELECT rule, unnest(names) AS variable FROM n) i ON i.rule = f.rule WHERE nf >= 2 GROUP BY f.job_id, f.period, variable) WHERE k = nf AND variable NOT IN ('V', 'C', 'B') GROUP BY job_id, period HAVING count(*) = 1""", f"{_TESTS}, {_INPUTS}")
_add("page_provenance", "SELECT x.job_id AS table_id, x.portfolio_id AS row, x.rule, o.o_custkey % 10 AS page FROM x JOIN orders o ON o.o_orderkey = x.job_id WHERE abs(x.residual) > x.tolerance", _TESTS)

_grids = (1_000_000, 100_000, 10_000, 1_000, 500, 100, 50, 10, 5, 1, 0.5, 0.1, 0.05, 0.01)
_add("display_grid", "SELECT portfolio_id, period, mcol, coalesce(" + ", ".join(f"CASE WHEN bool_and(abs(value - round_even(value / {g}::DOUBLE, 0) * {g}::DOUBLE) <= abs(value) * 1e-9 + 1e-9) THEN {g}::DOUBLE END" for g in _grids) + ") AS grid FROM cells GROUP BY portfolio_id, period, mcol")
_add("value_axis_shortlist", """SELECT portfolio_id, period, mcol, wins, total, median, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY wins DESC, total DESC, mcol) AS r FROM (
  SELECT portfolio_id, period, mcol, count(*) FILTER (value = top) AS wins, sum(value)::BIGINT AS total, median(value) AS median FROM (SELECT *, max(value) OVER (PARTITION BY portfolio_id, period, job_id) AS top FROM cells) GROUP BY portfolio_id, period, mcol)) WHERE r <= 3""")
_pairs = "pr AS (SELECT a.portfolio_id, a.period, a.mcol AS a, b.mcol AS b, a.value AS x, b.value AS y, CASE WHEN a.value <> 0 THEN b.value::DOUBLE / a.value END AS r FROM cells a JOIN cells b ON a.portfolio_id = b.portfolio_id AND a.period = b.period AND a.job_id = b.job_id AND a.mcol <> b.mcol)"
_add("estimate_orientation", """SELECT portfolio_id, period, a AS v, b AS x, CASE WHEN m BETWEEN 0.45 AND 1.02 THEN 'cost' ELSE 'profit' END AS kind FROM (
  SELECT portfolio_id, period, a, b, median(r) AS m, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS q FROM pr GROUP BY portfolio_id, period, a, b) WHERE q <= 0.25 AND m >= 0.02 AND m <= 1.02""", _pairs)
_add("anchor_candidates", "SELECT portfolio_id, period, b AS mcol FROM pr WHERE a = 1 GROUP BY portfolio_id, period, b HAVING count(*) FILTER (y < 0 OR y::DOUBLE > x::DOUBLE * 1.1::DOUBLE) <= greatest(1, floor(count(*) / 10)) AND median(r) >= 0.02", _pairs)

_add("degenerate_rows", "SELECT portfolio_id, period, job_id FROM wip WHERE D = C AND E = V")
_add("terminal_cc_block", """SELECT portfolio_id, period, job_id FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id, period) AS n FROM (
  SELECT portfolio_id, period, job_id, min((D = C AND E = V)::INT) OVER (PARTITION BY portfolio_id, period ORDER BY job_id DESC) AS tail FROM wip) WHERE tail = 1) WHERE n >= 2""")

_CHANGE = """ch AS (SELECT portfolio_id, job_id, min(period) AS first, max(period) AS last, arg_min(V, period) AS V0, arg_max(V, period) AS V1, arg_min(C, period) AS C0, arg_max(C, period) AS C1,
  arg_min(D, period) AS D0, arg_max(D, period) AS D1, arg_min(B, period) AS B0, arg_max(B, period) AS B1 FROM {src} GROUP BY portfolio_id, job_id HAVING count(DISTINCT period) > 1),
cg AS (SELECT portfolio_id, job_id, first, last, V1 - V0 AS contract_change, C1 - C0 AS cost_change, (V1 - C1) - (V0 - C0) AS profit_change, CAST(V1 - C1 AS DOUBLE) / V1 - CAST(V0 - C0 AS DOUBLE) / V0 AS margin_change,
  C1 - C0 > greatest(10000.0, abs(C0)::DOUBLE * 0.03::DOUBLE) AS material_cost, (V1 - C1) - (V0 - C0) < -greatest(10000.0, abs(V0 - C0)::DOUBLE * 0.03::DOUBLE) AS material_fade,
  abs(D1 - D0) <= 1 AND abs(B1 - B0) <= 1 AS stalled, greatest(abs(V0), abs(V1), 1) AS scale, V0 - C0 AS prior FROM ch)"""
_REV = "rv AS (SELECT * REPLACE (CASE WHEN period = DATE '1998-12-31' AND job_id % 13 = 0 THEN C + CAST(floor(C / 2) AS BIGINT) ELSE C END AS C) FROM wip), " + _CHANGE.format(src="rv")
_add("first_last_change", "SELECT * EXCLUDE (scale, prior) FROM cg", _CHANGE.format(src="wip"))
_add("stalled_jobs", "SELECT portfolio_id, job_id, first, last FROM cg WHERE stalled", _CHANGE.format(src="wip"))
_add("kpi_strip", "SELECT portfolio_id, sum(CASE WHEN material_cost THEN cost_change ELSE 0 END)::BIGINT AS cost_increase, count(*) FILTER (material_cost) AS cost_jobs, sum(CASE WHEN material_fade THEN -profit_change ELSE 0 END)::BIGINT AS fade, count(*) FILTER (material_fade) AS fade_jobs, count(*) FILTER (stalled) AS stalled_jobs FROM cg GROUP BY portfolio_id", _REV)
_add("estimate_anomalies", """SELECT portfolio_id, job_id, profit_change, CASE WHEN profit_change >= 0 THEN 'profit gain' ELSE 'profit loss' END AS direction FROM cg JOIN md USING (portfolio_id) JOIN ma USING (portfolio_id)
WHERE (abs(profit_change) >= greatest(50000.0, scale * 0.05) AND (abs(margin_change) >= 0.10 OR abs(profit_change) / greatest(abs(prior)::DOUBLE, scale * 0.01) >= 5))
   OR (n >= 5 AND mad > 0.002 AND abs(margin_change - med) * 0.6745 / mad >= 4 AND abs(profit_change) >= greatest(50000.0, scale * 0.03) AND abs(margin_change) >= 0.05)""",
     _REV + ", md AS (SELECT portfolio_id, median(margin_change) AS med, count(margin_change) AS n FROM cg GROUP BY portfolio_id), ma AS (SELECT portfolio_id, median(abs(margin_change - med)) AS mad FROM cg JOIN md USING (portfolio_id) GROUP BY portfolio_id)")
_add("monotone_check", "SELECT * FROM (SELECT portfolio_id, job_id, period, lag(D) OVER w AS D0, D, lag(B) OVER w AS B0, B FROM bad WINDOW w AS (PARTITION BY portfolio_id, job_id ORDER BY period)) WHERE D < D0 - 1 OR B < B0 - 1")
_add("billing_trajectory", "SELECT portfolio_id, job_id, count(*)::INT AS reports, string_agg((B - E)::VARCHAR, ',' ORDER BY period) AS net, arg_max(B - E, period) - arg_min(B - E, period) AS change FROM wip GROUP BY portfolio_id, job_id")
_add("robust_anomaly", "SELECT portfolio_id, period, job_id, CASE WHEN n >= 5 AND mad > 0.002 THEN abs(x - med) * 0.6745::DOUBLE / mad END AS z FROM v JOIN md USING (portfolio_id, period) JOIN ma USING (portfolio_id, period)",
     "v AS (SELECT portfolio_id, period, job_id, CASE WHEN V <> 0 THEN B::DOUBLE / V END AS x FROM wip), md AS (SELECT portfolio_id, period, median(x) AS med, count(x) AS n FROM v GROUP BY portfolio_id, period), ma AS (SELECT portfolio_id, period, median(abs(x - med)) AS mad FROM v JOIN md USING (portfolio_id, period) GROUP BY portfolio_id, period)")
_add("early_underbilling_evidence", """SELECT portfolio_id, count(*) AS cases, count(*) FILTER (zh * ae < ah * ze) AS faded FROM (
  SELECT portfolio_id, job_id, arg_min(E - D, period) FILTER (early) AS ah, arg_min(E, period) FILTER (early) AS ae, min(period) FILTER (early) AS p0, arg_max(E - D, period) AS zh, arg_max(E, period) AS ze, max(period) AS p1
  FROM (SELECT *, D * 2 < C AND U * 20 >= V AS early FROM shape) GROUP BY portfolio_id, job_id) WHERE p0 IS NOT NULL AND p1 > p0 GROUP BY portfolio_id HAVING count(*) >= 3""")
_add("matching_candidates", """SELECT obs_id, match_id, 1.0::DOUBLE AS score, r AS rank FROM (SELECT a.job_id || '/' || a.period AS obs_id, b.job_id || '/' || b.period AS match_id, row_number() OVER (PARTITION BY a.job_id, a.period ORDER BY b.period) AS r
  FROM wip a JOIN wip b ON a.portfolio_id = b.portfolio_id AND a.job_id = b.job_id AND a.period <> b.period) WHERE r <= 3""")

_add("derive_canonical", """SELECT job_id, period, V::DOUBLE AS V, C::DOUBLE AS C, (V - C)::DOUBLE AS G, D::DOUBLE AS D, (C - D)::DOUBLE AS Q, D::DOUBLE / C * V AS E, D::DOUBLE / C AS P, (V - C)::DOUBLE / V AS M, B::DOUBLE / V AS PB, (V - B)::DOUBLE AS RB FROM wip""")
_add("reconstruct_core", "SELECT job_id, period, C::DOUBLE AS C, G::DOUBLE AS G, D::DOUBLE AS D, E::DOUBLE AS E, B::DOUBLE AS B, greatest(E - B, 0)::DOUBLE AS U, greatest(B - E, 0)::DOUBLE AS O FROM wip")
_add("transplant_sources", """SELECT portfolio_id, period, job_id, source FROM (SELECT *, CASE WHEN W = V THEN 'V' WHEN W = C THEN 'C' WHEN W = Q THEN 'Q' WHEN W = E THEN 'E' WHEN W = B THEN 'B' WHEN W = up THEN 'above' WHEN W = down THEN 'below' END AS source FROM (
  SELECT *, CASE WHEN job_id % 97 = 0 THEN E WHEN job_id % 89 = 0 THEN D * 10 ELSE D END AS W, lag(D) OVER w AS up, lead(D) OVER w AS down FROM wip WINDOW w AS (PARTITION BY portfolio_id, period ORDER BY job_id))) WHERE W <> D AND source IS NOT NULL""")
_add("totals_assess", """SELECT portfolio_id, period, computed, corrected, stated, CASE WHEN fixes = 0 THEN CASE WHEN abs(computed - stated) <= lim THEN 'pass' ELSE 'total_row_error' END WHEN abs(corrected - stated) <= lim THEN 'pass_after_corrections'
  WHEN abs(computed - stated) <= lim THEN 'conflicts' ELSE 'total_row_error' END AS status FROM (
  SELECT w.portfolio_id, w.period, sum(b.D)::BIGINT AS computed, sum(CASE WHEN w.job_id % 97 = 0 AND w.portfolio_id % 4 <> 0 THEN w.D ELSE b.D END)::BIGINT AS corrected,
         sum(w.D)::BIGINT + CASE WHEN w.portfolio_id % 5 = 0 THEN 1000000 ELSE 0 END AS stated, count(*) FILTER (w.job_id % 97 = 0 AND w.portfolio_id % 4 <> 0) AS fixes, greatest(1.0, count(*) * 0.51 + 1.0, abs(sum(b.D)) * 1e-9) AS lim
  FROM wip w JOIN bad b ON b.job_id = w.job_id AND b.period = w.period GROUP BY w.portfolio_id, w.period)""")
_add("corrections_apply", "SELECT job_id, period, V, C, D, E, B, D::DOUBLE / C AS P, (V - C)::DOUBLE / V AS margin, U, O FROM shape")
_FMT = "format('{:,}', V)"
_add("cell_parse", f"SELECT job_id, period, CASE job_id % 6 WHEN 2 THEN -V WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE V END AS value, job_id % 6 = 5 AND contains(V::VARCHAR, '0') AS repaired FROM wip")
_PRINTED = f"pt AS (SELECT portfolio_id, period, CASE job_id % 6 WHEN 0 THEN '$' || {_FMT} WHEN 1 THEN {_FMT} WHEN 2 THEN '(' || {_FMT} || ')' WHEN 3 THEN '-' WHEN 4 THEN '' ELSE replace({_FMT}, '0', 'O') END AS raw FROM wip)"
_add("numeric_column_classify", "SELECT portfolio_id, period, count(*) FILTER (raw <> '') AS filled, count(*) FILTER (raw <> '' AND NOT contains(raw, 'O')) AS strict, count(*) FILTER (raw <> '' AND NOT contains(raw, 'O')) * 100 >= count(*) FILTER (raw <> '') * 60 AS numeric FROM pt GROUP BY portfolio_id, period", _PRINTED)
_add("decimal_vote", """SELECT portfolio_id, period, us, eu, CASE WHEN eu > us THEN 'eu' ELSE 'us' END AS convention FROM (
  SELECT portfolio_id, period, count(*) FILTER (regexp_full_match(s, '\\d{1,3}(,\\d{3})+(\\.\\d+)?')) AS us, count(*) FILTER (regexp_full_match(s, '\\d{1,3}(\\.\\d{3})+(,\\d+)?') OR regexp_full_match(s, '\\d+,\\d{1,2}')) AS eu
  FROM (SELECT portfolio_id, period, trim(CASE WHEN portfolio_id % 2 = 0 THEN replace(raw, ',', '.') ELSE raw END, '$ ()%') AS s FROM pt) GROUP BY portfolio_id, period)""", _PRINTED)
_add("percent_scale", "SELECT portfolio_id, period, median(x) AS median, min(x) AS low, max(x) AS high, median(x) > 1.5 AND min(x) > -5 AND max(x) < 130 AS scaled FROM (SELECT portfolio_id, period, CAST(floor(D * (CASE WHEN portfolio_id % 2 = 0 THEN 100 ELSE 1 END) / C) AS BIGINT) AS x FROM wip) GROUP BY portfolio_id, period")
_add("label_column", "SELECT portfolio_id, period, 1 AS label_column FROM wip GROUP BY portfolio_id, period HAVING count(*) > 2 UNION ALL SELECT portfolio_id, period, 0 FROM wip GROUP BY portfolio_id, period HAVING count(*) <= 2")
_add("classify_errors", """SELECT job_id, period, observed, D AS proposed, CASE WHEN k = 0 THEN 'sign_error' WHEN k = 1 THEN 'extra_character' WHEN k = 2 THEN 'dropped_character' WHEN k = 3 THEN 'separator_or_magnitude_error' WHEN k = 6 OR observed = D THEN 'formatting_only'
  WHEN lev <= 2 AND list_sort(string_split(observed::VARCHAR, '')) = list_sort(string_split(D::VARCHAR, '')) THEN 'digit_transposition' WHEN lev <= 2 AND abs(length(observed::VARCHAR) - length(D::VARCHAR)) <= 1 AND NOT extra THEN 'ocr_character_misread' WHEN extra THEN 'extra_character' ELSE 'unexplained_substitution' END AS kind
FROM (SELECT *, levenshtein(observed::VARCHAR, D::VARCHAR) AS lev, length(observed::VARCHAR) = length(D::VARCHAR) + 1 AND len(list_filter(range(1, length(observed::VARCHAR) + 1), lambda i: substr(observed::VARCHAR, 1, i - 1) || substr(observed::VARCHAR, i + 1) = D::VARCHAR)) > 0 AS extra FROM (
  SELECT job_id, period, D, job_id % 7 AS k, CASE job_id % 7 WHEN 0 THEN -D WHEN 1 THEN CAST(D::VARCHAR || '7' AS BIGINT) WHEN 2 THEN CAST(substr(D::VARCHAR, 1, length(D::VARCHAR) - 1) AS BIGINT) WHEN 3 THEN D * 1000
    WHEN 4 THEN CAST(substr(D::VARCHAR, 1, length(D::VARCHAR) - 2) || reverse(substr(D::VARCHAR, -2)) AS BIGINT) WHEN 5 THEN D + 3 ELSE D END AS observed FROM wip WHERE D >= 1000))""")
_add("merge_duplicates", """SELECT job_id, period, V, C, D, CASE WHEN done THEN E ELSE E1 END AS E, B, done AND abs(E1 - E) > 1 AS conflict, done AS is_cc, CASE WHEN done THEN 0 ELSE greatest(E1 - B, 0) END AS U, CASE WHEN done THEN 0 ELSE greatest(B - E1, 0) END AS O
FROM (SELECT *, D = C AS done, CASE WHEN job_id % 11 = 0 THEN E + 10 ELSE E END AS E1 FROM wip)""")
_add("overlay_edits", "SELECT job_id, period, CASE WHEN job_id % 20 = 0 THEN B WHEN job_id % 10 = 0 THEN B + 5 ELSE B END AS B FROM wip")

ORACLE["call_metrics"] = "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS calls, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS cents, max(CAST(floor(value * 100) AS BIGINT)) AS largest FROM events GROUP BY GROUPING SETS ((event_type), ())"
ORACLE["combined_sections"] = "SELECT doc_id, idx, signature, sum(new) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS run FROM (SELECT o_custkey AS doc_id, o_orderkey AS idx, o_orderpriority AS signature, CASE WHEN lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_orderpriority THEN 0 ELSE 1 END AS new FROM orders)"
ORACLE["adjacent_pages"] = "SELECT doc_id, chunk_id, first_page, last_page, coalesce(lag(last_page) OVER (PARTITION BY doc_id ORDER BY chunk_id) + 1 = first_page, false) AS joins FROM (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_id, l_linenumber AS first_page, l_linenumber + CASE WHEN max(l_quantity)::INT % 3 = 0 THEN 1 ELSE 0 END AS last_page FROM lineitem GROUP BY l_orderkey, l_linenumber)"
ORACLE["total_rows"] = "SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, true), (4, true), (5, false), (6, false), (7, false)) AS t(k, total)"
ORACLE["period_extract"] = "SELECT k, CAST(d AS DATE) AS reporting_date, e AS reporting_date_error FROM (VALUES (0, '2025-12-31', NULL), (1, '2024-12-31', NULL), (2, NULL, 'reporting_date_not_found'), (3, '2024-06-30', NULL), (4, '2024-06-30', NULL), (5, NULL, 'multiple_reporting_dates'), (6, '2023-09-30', NULL), (7, NULL, 'reporting_date_not_found'), (8, '2022-12-31', NULL), (9, '2025-12-31', NULL)) AS t(k, d, e)"
ORACLE["file_sniff"] = "SELECT * FROM (VALUES ('a.bin', 'pdf'), ('b', 'png'), ('c', 'jpeg'), ('d', 'webp'), ('e.xlsx', 'xlsx'), ('f.CSV', 'csv'), ('g', 'unknown'), ('h', 'gif')) AS t(name, type)"
ORACLE["header_match"] = "SELECT * FROM (VALUES (1, 0, 'CONTRACT  PRICE', 'V'), (1, 1, 'est total cost', 'C'), (1, 2, 'Costs to date', 'D'), (1, 3, 'Notes', NULL), (2, 0, 'Contract Price', NULL), (2, 1, 'Contract Amount', NULL), (2, 2, '% complete', 'P')) AS t(table_id, pos, header, variable)"
ORACLE["schema_text_vote"] = "SELECT * FROM (VALUES (1, 'wip'), (2, 'cc'), (3, 'unresolved')) AS t(table_id, type)"
ORACLE["cell_literals"] = "SELECT k, value::DOUBLE AS value, repaired, percent FROM (VALUES (0, 1234.56, false, false), (1, -45000, false, false), (2, 2000, false, false), (3, 0, false, false), (4, 0, false, false), (5, 1204, true, false), (6, NULL, false, false), (7, 45.2, false, true), (8, -171759.47, false, false), (9, 0, false, false), (10, 0, false, false), (11, -1000, false, false), (12, -5, false, false)) AS t(k, value, repaired, percent)"
ORACLE["name_similarity"] = """WITH n AS (SELECT b.p_partkey + 1 AS k, trim(regexp_replace(lower(concat_ws(' ', a.p_name, a.p_type)), '[^a-z0-9]+', ' ', 'g')) AS x, trim(regexp_replace(lower(concat_ws(' ', b.p_name, b.p_type)), '[^a-z0-9]+', ' ', 'g')) AS y FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1),
w AS (SELECT *, list_distinct(string_split(x, ' ')) AS xs, list_distinct(string_split(y, ' ')) AS ys FROM n)
SELECT k, CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 ELSE greatest(0.0::DOUBLE, 0.65::DOUBLE * (1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y))) + 0.35::DOUBLE * (len(list_intersect(xs, ys))::DOUBLE / greatest(len(list_distinct(list_concat(xs, ys))), 1))) END AS score FROM w"""

_add("cc_kpis", "SELECT portfolio_id, period, sum(RT)::BIGINT AS RT, sum(KT)::BIGINT AS KT, sum(GT)::BIGINT AS GT, sum(RC)::BIGINT AS RC, sum(GC)::BIGINT AS GC, count(*) AS jobs, CASE WHEN sum(RT) <> 0 THEN CAST(sum(GT)::BIGINT AS DOUBLE) / sum(RT)::BIGINT END AS margin FROM cc GROUP BY portfolio_id, period")
_add("cc_billed_column", "SELECT portfolio_id, period, 'BC' AS billed FROM cc GROUP BY portfolio_id, period HAVING count(*) FILTER (abs(BC - RT) > greatest(1.0, abs(RT) * 0.005) + 1) <= greatest(1, floor(count(*) / 10)) AND NOT count(*) FILTER (5000 > greatest(1.0, abs(RT) * 0.005) + 1) <= greatest(1, floor(count(*) / 10)) UNION ALL SELECT portfolio_id, period, 'XC' FROM cc GROUP BY portfolio_id, period HAVING NOT count(*) FILTER (abs(BC - RT) > greatest(1.0, abs(RT) * 0.005) + 1) <= greatest(1, floor(count(*) / 10)) AND count(*) FILTER (5000 > greatest(1.0, abs(RT) * 0.005) + 1) <= greatest(1, floor(count(*) / 10))")
_add("snapshot_points", "SELECT job_id, period, D::DOUBLE / C AS P, B - E AS net, CASE WHEN B > E THEN 'over' WHEN B < E THEN 'under' ELSE 'even' END AS position, (V - C)::DOUBLE / V AS margin FROM wip")
_add("job_rows", "SELECT job_id, period, V, C, D, D::DOUBLE / C AS P, (V - C)::DOUBLE / V AS margin, E, B, B - E AS net, U, O FROM shape")
_add("job_facts", "SELECT job_id, max(period) AS period, arg_max(V - C, period) AS profit, arg_max(V - B, period) AS left_to_bill, count(*) AS reports FROM wip GROUP BY job_id")
_add("schedule_types", "SELECT portfolio_id, period, CASE WHEN bool_and(D = C) THEN 'cc' WHEN bool_or(D = C) THEN 'mixed' ELSE 'wip' END AS type FROM wip GROUP BY portfolio_id, period")
_add("partial_certification", "SELECT portfolio_id, period, job_id, CASE WHEN job_id % 4 = 0 THEN 3 ELSE 4 END AS checked, CASE WHEN job_id % 4 = 0 THEN 3 ELSE 4 END AS held, CASE WHEN job_id % 4 = 0 THEN 'E' ELSE '' END AS missing, CASE WHEN job_id % 4 = 0 THEN 'incomplete' ELSE 'certified' END AS status FROM wip")
_add("shadow_audit", "SELECT portfolio_id, period, count(*) AS rows, count(*) FILTER (job_id % 50 = 0) AS differ FROM wip GROUP BY portfolio_id, period HAVING count(*) FILTER (job_id % 50 = 0) > 0 AND count(*) FILTER (job_id % 50 <> 0) >= count(*) * 0.8")
_add("row_marks", f"SELECT s.portfolio_id, s.period, s.job_id, s.signal, k.col AS \"column\", CASE WHEN s.severity >= 0.6 THEN 'red' ELSE 'amber' END AS color FROM (SELECT * FROM ({_union}) WHERE severity > 0.12) s JOIN (VALUES ('trapped_cash', 'U'), ('trapped_cash', 'E'), ('job_borrow', 'O'), ('job_borrow', 'Q'), ('loss_jobs', 'G'), ('loss_jobs', 'V'), ('cost_overrun', 'D'), ('cost_overrun', 'C'), ('margin_outlier', 'G')) AS k(signal, col) ON k.signal = s.signal", _book_q)
_add("coverage_counts", "SELECT portfolio_id, count(*) AS reports, count(DISTINCT job_id) AS jobs, count(DISTINCT period) AS periods FROM wip GROUP BY portfolio_id")
ORACLE["corroborate_columns"] = f"""{WIP}, ce AS (SELECT portfolio_id, period, job_id, unnest([0, 1, 2]) AS mcol, unnest([G, Q, E]) AS value FROM wip), de AS (SELECT portfolio_id, period, job_id, unnest(['G', 'Q', 'RB']) AS variable, unnest([G, Q, V - B])::DOUBLE AS expected FROM wip)
SELECT portfolio_id, period, mcol, min(variable) AS variable FROM (SELECT ce.portfolio_id, ce.period, mcol, variable FROM ce JOIN de ON ce.portfolio_id = de.portfolio_id AND ce.period = de.period AND ce.job_id = de.job_id
  GROUP BY ce.portfolio_id, ce.period, mcol, variable HAVING count(*) >= 3 AND count(*) FILTER (abs(value - expected) <= greatest(2.05::DOUBLE, abs(expected) * 2e-5::DOUBLE)) * 20 >= count(*) * 19) GROUP BY portfolio_id, period, mcol HAVING count(*) = 1"""
_add("kpi_provenance", "SELECT portfolio_id, period, kpi, CASE kpi WHEN 'contract_value' THEN 'printed' WHEN 'backlog' THEN 'derived' ELSE CASE WHEN bool_or(job_id % 97 = 0) THEN 'corrected' ELSE 'confirmed' END END AS provenance FROM wip CROSS JOIN (VALUES ('contract_value'), ('cost_to_complete'), ('backlog')) AS k(kpi) GROUP BY portfolio_id, period, kpi")
_add("validation_checklist", """SELECT portfolio_id, period, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'fixed') AS fixed, count(*) FILTER (s = 'warn') AS warn, count(*) FILTER (s = 'bad') AS bad FROM (
  SELECT portfolio_id, period, rule, CASE WHEN f = 0 THEN 'ok' WHEN f - g <= 0 THEN 'fixed' WHEN (f - g) * 10 <= n THEN 'warn' ELSE 'bad' END AS s FROM (
    SELECT portfolio_id, period, rule, count(*) AS n, count(*) FILTER (abs(residual) > tolerance) AS f, count(*) FILTER (abs(residual) > tolerance AND rule = 'Q=C-D' AND job_id % 2 = 0) AS g FROM x GROUP BY portfolio_id, period, rule)) GROUP BY portfolio_id, period""", _TESTS)
_add("batch_summary", "SELECT w.portfolio_id, count(*) AS reports, coalesce(any_value(b.failing), 0) AS failing, coalesce(any_value(b.sections), 0) AS sections FROM wip w LEFT JOIN (SELECT portfolio_id, count(*) AS failing, count(DISTINCT period) AS sections FROM (SELECT DISTINCT portfolio_id, period, job_id FROM x WHERE abs(residual) > tolerance) GROUP BY portfolio_id) b ON b.portfolio_id = w.portfolio_id GROUP BY w.portfolio_id", _TESTS)
_add("totals_corroborate", "SELECT portfolio_id, period, job_id FROM (SELECT *, first_value(D) OVER (PARTITION BY portfolio_id, period ORDER BY job_id) AS d0, t.total FROM wip JOIN (SELECT portfolio_id AS tp, period AS tq, sum(D) AS total FROM bad GROUP BY ALL) t ON tp = portfolio_id AND tq = period WHERE job_id % 97 = 0) WHERE abs(9 * d0 - 9 * D) <= greatest(1.0, abs(total - 9 * d0) * 1e-9)")
_add("effective_mapping", "SELECT portfolio_id, period, job_id, C AS V, V AS C, G, D, Q, E, B FROM wip")
_add("match_decisions", "SELECT job_id || '/' || period AS obs_id, CASE job_id % 10 WHEN 0 THEN 'own:' || job_id || '/' || period WHEN 1 THEN job_id::VARCHAR WHEN 2 THEN '7' WHEN 3 THEN '7' ELSE job_id::VARCHAR END AS group_id FROM wip")
_add("trailing_totals", "SELECT portfolio_id, period, 7 AS matching FROM wip WHERE portfolio_id % 3 <> 0 GROUP BY portfolio_id, period")
_add("subtotals_stripped", "SELECT portfolio_id, period, job_id * 2 AS row, V, C, D FROM wip")
_add("job_id_column", "SELECT portfolio_id, period, 1 AS id_column FROM wip GROUP BY portfolio_id, period")
_add("largest_changes", "SELECT portfolio_id, job_id, cost_change, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY cost_change DESC, job_id) AS r FROM cg) WHERE r <= 5", _REV)
ORACLE["mapping_readiness"] = "SELECT * FROM (VALUES (1, true, true, true, true), (2, true, true, true, true), (3, false, true, true, false), (4, true, true, false, false), (5, true, false, true, false)) AS t(mapping_id, profit, progress, billing, ready)"
ORACLE["section_routes"] = "SELECT * FROM (VALUES (1, 'analyze'), (2, 're_extract'), (3, 'analyze'), (4, 'analyze'), (5, 'disambiguate'), (6, 'fallback')) AS t(section, route)"
ORACLE["correction_status"] = "SELECT o_orderkey AS correction_id, CASE WHEN o_custkey % 6 = 1 THEN 'applied' WHEN o_custkey % 3 = 0 THEN 'review' WHEN o_custkey % 2 = 0 THEN 'applied' ELSE 'reverted' END AS status FROM orders"
ORACLE["period_duplicates"] = "SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1"
ORACLE["cell_strings"] = "SELECT * FROM (VALUES (1, '12.5%'), (2, '50%'), (3, '1200'), (4, '12.35'), (5, ''), (6, '-3')) AS t(k, text)"
ORACLE["image_strips"] = "SELECT * FROM (VALUES (1, 1000, 0, 0, 1000), (2, 1600, 0, 0, 1600), (3, 3000, 0, 0, 1600), (3, 3000, 1, 1360, 3000), (4, 3200, 0, 0, 1600), (4, 3200, 1, 1360, 3200)) AS t(image, height, strip, top, bottom)"
ORACLE["json_extract"] = """SELECT * FROM (VALUES (1, '{"a":1,"b":[1,2]}'), (2, NULL), (3, '{"x":{"y":null}}'), (4, NULL)) AS t(k, json)"""
ORACLE["header_offsets"] = "SELECT * FROM (VALUES (1, 0), (2, -1), (3, 1)) AS t(table_id, \"offset\")"
_add("culprits", "SELECT portfolio_id, period, job_id, ['D'] AS culprits, 4 AS failed FROM wip WHERE job_id % 97 = 0 AND D * 9 > 100 AND G <> 0")
_add("minimal_repair", "SELECT job_id, period, 'D' AS \"column\", CAST(D * 10 AS DOUBLE) AS observed, CAST(D AS DOUBLE) AS proposed FROM wip WHERE job_id % 97 = 0 AND D * 9 > 100")
_add("identify_mapping", "SELECT DISTINCT portfolio_id, period, 'success' AS status, 4.45::DOUBLE AS score, 'c0=V, c1=C, c2=G, c3=D, c4=Q, c5=E, c6=B, c7=U, c8=O' AS mapping FROM wip")
_add("match_groups", "SELECT portfolio_id AS block, job_id || '/' || period AS obs_id, dense_rank() OVER (PARTITION BY portfolio_id ORDER BY p0, job_id::VARCHAR || '/' || p0) - 1 AS group_id FROM (SELECT *, min(period) OVER (PARTITION BY job_id) AS p0 FROM wip)")
ORACLE["header_fuzzy"] = "SELECT * FROM (VALUES (1, 'V'), (2, 'C'), (3, NULL), (4, 'D'), (5, NULL)) AS t(k, variable)"
_add("band_shifts", "SELECT portfolio_id, period, CAST(job_id % 6 AS INT) AS band, 'shifted' AS status, 1 AS shift, 2 AS from_column, CAST(1 AS DOUBLE) AS pass_rate FROM wip WHERE portfolio_id % 3 = 0 AND job_id % 6 = 2 GROUP BY portfolio_id, period, job_id % 6 HAVING count(*) >= 3")
ORACLE["band_realignment"] = f"""{WIP}, s AS (SELECT *, portfolio_id % 3 = 0 AND job_id % 6 = 2 AS hit, count(*) OVER (PARTITION BY portfolio_id, period, job_id % 6) >= 3 AS found FROM wip),
r AS (SELECT portfolio_id, V, C, CASE WHEN NOT hit THEN G WHEN NOT found THEN D END AS G, CASE WHEN hit AND NOT found THEN Q ELSE D END AS D, CASE WHEN hit AND NOT found THEN E ELSE Q END AS Q,
      CASE WHEN hit AND NOT found THEN B ELSE E END AS E, CASE WHEN hit AND NOT found THEN NULL ELSE B END AS B FROM s)
SELECT portfolio_id, count(*) AS rows, count(V) AS "n_V", count(C) AS "n_C", count(G) AS "n_G", count(D) AS "n_D", count(Q) AS "n_Q", count(E) AS "n_E", count(B) AS "n_B", CAST(sum(D) AS BIGINT) AS "sum_D", CAST(sum(B) AS BIGINT) AS "sum_B" FROM r GROUP BY portfolio_id"""
ORACLE["reading_disambiguators"] = f"""{WIP}, m AS (SELECT portfolio_id, period, median(abs((C - D) - (C - B))::DOUBLE / greatest(1, abs(C - D), abs(C - B))) AS q, median(abs(B::DOUBLE / V - D::DOUBLE / V) / greatest(1, abs(B::DOUBLE / V), abs(D::DOUBLE / V))) AS pb
  FROM wip WHERE C > 0 AND V > 0 GROUP BY portfolio_id, period)
SELECT portfolio_id, period, CASE WHEN q > 0.05 THEN 'Q' ELSE 'PB' END AS variable FROM m WHERE q > 0.05 OR pb > 0.05"""
ORACLE["audited_columns"] = "SELECT * FROM (VALUES (1, 4, 'G'), (2, 4, 'R')) AS t(section, \"column\", variable)"
ORACLE["edited_values"] = "SELECT k, value::DOUBLE AS value FROM (VALUES (1, -1000), (2, 0.125), (3, 12.5), (4, NULL), (5, NULL), (6, -3), (7, -3), (8, NULL), (9, 0)) AS t(k, value)"

_add("parsed_schedules", """SELECT portfolio_id, period, sum(V)::BIGINT AS "sum_V", sum(C)::BIGINT AS "sum_C", sum(D)::BIGINT AS "sum_D",
       sum(CASE WHEN job_id % 8 = 3 THEN contains(V::VARCHAR, '0')::INT + contains(C::VARCHAR, '0')::INT + contains(D::VARCHAR, '0')::INT ELSE 0 END)::BIGINT AS repaired,
       max(floor(D * 100 / C)) / 100 AS most_complete, count(*) AS jobs, 1 AS totals, min('BOSS ' || job_id) AS first_label FROM wip GROUP BY portfolio_id, period""")
_add("printed_totals", """SELECT portfolio_id, period, k AS col, (s + CASE WHEN k = 1 AND portfolio_id % 5 = 0 THEN 10000 ELSE 0 END)::BIGINT AS stated, s::BIGINT AS computed,
       NOT (k = 1 AND portfolio_id % 5 = 0 AND 10000 > greatest(1, 0.51 * n + 1, 1e-9 * s)) AS matches, false AS includes_subtotals
FROM (SELECT portfolio_id, period, count(*) AS n, unnest([1, 2, 3]) AS k, unnest([sum(V), sum(C), sum(D)]) AS s FROM wip GROUP BY portfolio_id, period)""")
_add("cc_culprits", """SELECT portfolio_id, period, job_id, 'KT' AS culprit, KT + 100 AS observed, KT AS proposed, 2::BIGINT AS failed FROM cc WHERE job_id % 31 = 0 AND NOT (job_id % 37 = 1 AND RC <> 0)
UNION ALL SELECT portfolio_id, period, job_id, 'RC', RC * 10, RC, 2 FROM cc WHERE job_id % 37 = 1 AND job_id % 31 <> 0 AND abs(RC) * 9 > 1.53""")
_add("decided_corrections", "SELECT job_id || '/' || period AS id, D AS proposed, job_id % 3 <> 0 AS accepted FROM wip WHERE job_id % 97 = 0")
_add("accepted_kpis", """SELECT portfolio_id, period, sum(V)::BIGINT AS total_contract_value, sum(C - D)::BIGINT AS cost_to_complete, sum((V - C) - (E - D))::BIGINT AS uegp, count(*) AS job_count,
       CAST(sum(V) FILTER (r <= 5)::BIGINT AS DOUBLE) / sum(V)::BIGINT AS top5_share
FROM (SELECT * REPLACE (CASE WHEN job_id % 97 = 0 AND job_id % 3 = 0 THEN D * 10 ELSE D END AS D), row_number() OVER (PARTITION BY portfolio_id, period ORDER BY V DESC, job_id) AS r FROM wip) GROUP BY portfolio_id, period""")
_add("accepted_totals", """SELECT portfolio_id, period, variable, a::BIGINT AS computed, b::BIGINT AS corrected, s::BIGINT AS stated,
       CASE WHEN abs(b - s) <= greatest(1, 0.01 * n, 1e-9 * greatest(abs(a), abs(s))) THEN CASE WHEN fixes > 0 THEN 'pass_after_corrections' ELSE 'pass' END
            WHEN fixes > 0 AND abs(a - s) <= greatest(1, 0.01 * n, 1e-9 * greatest(abs(a), abs(s))) THEN 'conflicts' ELSE 'total_row_error' END AS status
FROM (SELECT portfolio_id, period, 'D' AS variable, sum(CASE WHEN job_id % 97 = 0 THEN D * 10 ELSE D END) AS a, sum(CASE WHEN job_id % 97 = 0 AND job_id % 3 = 0 THEN D * 10 ELSE D END) AS b, sum(D) AS s, count(*) AS n,
             count(*) FILTER (job_id % 97 = 0 AND job_id % 3 <> 0) AS fixes FROM wip GROUP BY portfolio_id, period
      UNION ALL SELECT portfolio_id, period, 'U', sum(greatest(E - B, 0)), sum(greatest(E - B, 0)), sum(greatest(E - B, 0)), count(*), 0 FROM wip GROUP BY portfolio_id, period)""")
_add("canonical_jobs", """SELECT job_id, period, V, C, V - C AS G, d AS "D", C - d AS Q, B, V - B AS "RB" FROM (SELECT * EXCLUDE (D), CASE WHEN job_id % 97 = 0 AND job_id % 3 = 0 THEN D * 10 ELSE D END AS d FROM wip)""")
ORACLE["label_identities"] = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'J-' || p_partkey WHEN 2 THEN p_partkey::VARCHAR END AS id, trim(p_name) AS name FROM part"
_add("implied_consensus", """SELECT job_id, period, D + CASE WHEN job_id % 10 = 0 THEN 250 ELSE 0 END::DOUBLE AS value,
       (2 * (job_id % 10 <> 0)::INT + (abs(floor(D * 100 / C) * C / 100 - (D + CASE WHEN job_id % 10 = 0 THEN 250 ELSE 0 END)) <= greatest(2, C / 100))::INT)::BIGINT AS families,
       (job_id % 10 <> 0 OR 500 <= 2) AND (abs(floor(D * 100 / C) * C / 100 - D) <= greatest(2, C / 100)) AS consistent FROM wip""")
_shown = lambda x: f"CASE WHEN {x} < 0 THEN format('({{:,}})', abs({x})::BIGINT) ELSE format('{{:,}}', {x}::BIGINT) END"
_lines = {"V": "V", "C": "C", "G": "G", "D": "D", "E": "E", "B": "B", "U": "greatest(E - B, 0)", "O": "greatest(B - E, 0)", "N": "B - E"}
_add("printed_schedule", f"""SELECT portfolio_id, period, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY job_id) AS line, 'Job ' || job_id AS label, {', '.join(f'{_shown(x)} AS "{v}"' for v, x in _lines.items())},
       CASE WHEN C <> 0 THEN printf('%.1f', floor(D * 1000 / C) / 1000 * 100) || '%' ELSE chr(8212) END AS "P" FROM wip
UNION ALL SELECT portfolio_id, period, count(*) + 1, 'Total', {', '.join(_shown(f'sum({x})') for x in _lines.values())}, '' FROM wip GROUP BY portfolio_id, period""")
_add("finite_values", "SELECT job_id, period, CASE WHEN job_id % 5 >= 3 THEN V::DOUBLE END AS value FROM wip")
_add("column_shapes", """SELECT portfolio_id, period, 7 AS columns, n AS rows, CASE WHEN lost > 0 THEN 'column 3 has ' || (n - lost) || ' rows, the first has ' || n END AS error
FROM (SELECT portfolio_id, period, count(*) AS n, count(*) FILTER (portfolio_id % 5 = 0 AND job_id % 3 = 0) AS lost FROM wip GROUP BY portfolio_id, period)""")
ORACLE["assemble_tables"] = "SELECT l_orderkey AS doc_id, 0 AS table_id, 'Part|Quantity' AS headers, string_agg(l_partkey || '|' || l_quantity, ';' ORDER BY l_linenumber, l_partkey::VARCHAR, l_quantity::VARCHAR) AS rows FROM lineitem GROUP BY l_orderkey"
_add("full_certification", """SELECT portfolio_id, period, job_id, rule AS finding FROM x WHERE abs(residual) > tolerance AND rule IN ('E=V*D/C', 'Q=C-D')
UNION ALL SELECT portfolio_id, period, job_id, 'x1 is G' FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (job_id % 50 = 0) OVER w AS wrong FROM wip WINDOW w AS (PARTITION BY portfolio_id, period)) WHERE job_id % 50 = 0 AND n - wrong >= greatest(2, ceil(0.8 * n))""", _TESTS)
_add("audited_repair", """SELECT job_id, period, 'G' AS "column", (G + 500)::DOUBLE AS observed, G::DOUBLE AS proposed FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (job_id % 50 = 0) OVER w AS wrong FROM wip WINDOW w AS (PARTITION BY portfolio_id, period))
WHERE job_id % 50 = 0 AND n - wrong >= greatest(2, ceil(0.8 * n))""")
_add("priority_trajectories", f"""SELECT portfolio_id, job_id, rank, score, points FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY score DESC, lp DESC, abs(pos) DESC, job_id) AS rank FROM (
    SELECT portfolio_id, job_id, arg_max(D::DOUBLE / C, period) AS lp, arg_max((B - E)::DOUBLE / V, period) AS pos, count(*) AS points FROM wip WHERE C <> 0 AND V <> 0 AND D::DOUBLE / C BETWEEN 0.15::DOUBLE AND 1.000001::DOUBLE GROUP BY portfolio_id, job_id)
  JOIN (SELECT portfolio_id, job_id, max(severity) AS score FROM ({_union}) WHERE severity > 0.12 GROUP BY portfolio_id, job_id) USING (portfolio_id, job_id)) WHERE rank <= 5""", _book_q)
_add("failures_in_words", """SELECT CASE rule WHEN 'E=V*D/C' THEN 'Earned Revenue = Contract Value * Cost to Date / Estimated Total Cost' WHEN 'Q=C-D' THEN 'Cost to Complete = Estimated Total Cost - Cost to Date'
  WHEN 'H=G*D/C' THEN 'Earned Gross Profit to Date = Estimated Gross Profit * Cost to Date / Estimated Total Cost' ELSE rule END AS identity, count(*) AS rows FROM x WHERE abs(residual) > tolerance GROUP BY rule""", _TESTS)
