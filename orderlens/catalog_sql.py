"""SQL over the test tables that gives what the catalog's queries give."""

from __future__ import annotations

import datetime as dt

from . import samples
from .operators import holidays
from .plans.order_lines import AS_OF, HORIZON, WEEKS

DAY = f"DATE '{AS_OF}'"
LINES = "lines AS (SELECT strftime(l_shipdate, '%y') || 'H' || CASE WHEN month(l_shipdate) <= 6 THEN '1' ELSE '2' END AS sheet, CAST(l_shipdate AS DATE) AS date, l_quantity AS net_pounds, c_mktsegment AS customer, p_type AS material_group, p_brand AS material_no, CAST(l_suppkey AS VARCHAR) AS plant, l_orderkey AS order_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"
MIXED = LINES + ", mixed AS (SELECT sheet, date, net_pounds, customer, CASE WHEN customer = 'BUILDING' THEN material_group ELSE material_no END AS material_no FROM lines)"
K, M = "customer, material_group", "customer, material_no"


def _on(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def _pre(a: str, keys: str) -> str:
    return ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))


def _daily(keys: str, source: str = "lines", name: str = "daily") -> str:
    return f"{name} AS (SELECT {keys}, date, sum(net_pounds) AS y FROM {source} GROUP BY ALL)"


def _dense(keys: str) -> str:
    return f"{_daily(keys)}, spans AS (SELECT {keys}, min(date) AS lo, max(date) AS hi FROM daily GROUP BY ALL), days AS (SELECT {keys}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM spans), dense AS (SELECT {_pre('d', keys)}, d.date, x.y FROM days d LEFT JOIN daily x ON {_on('d', 'x', keys)} AND d.date = x.date)"


def _linear(keys: str, source: str, name: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""marked_{name} AS (SELECT {keys}, date, y, last_value(y IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0, last_value(CASE WHEN y IS NOT NULL THEN date END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
first_value(y IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1, first_value(CASE WHEN y IS NOT NULL THEN date END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1 FROM {source}),
{name} AS (SELECT {keys}, date, coalesce(y, y0 + (y1 - y0) * (date - d0) / nullif(d1 - d0, 0), y0, y1) AS y FROM marked_{name})"""


def _history(keys: str = K) -> str:
    return f"""{LINES}, {_daily(keys)}, spans AS (SELECT {keys}, min(date) AS lo, least(max(date), {DAY}) AS hi FROM daily GROUP BY ALL), days AS (SELECT {keys}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM spans WHERE lo <= hi),
gaps AS (SELECT {_pre('d', keys)}, d.date, x.y FROM days d LEFT JOIN daily x ON {_on('d', 'x', keys)} AND d.date = x.date), {_linear(keys, 'gaps', 'filled')},
hist AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM filled)"""


def _zero(keys: str, source: str = "lines", cut: str = DAY, tag: str = "") -> str:
    return f"""{_daily(keys, source, 'zd' + tag)}, zs{tag} AS (SELECT {keys}, min(date) AS lo, greatest(max(date), {cut}) AS hi FROM zd{tag} GROUP BY ALL HAVING min(date) <= {cut}), zdays{tag} AS (SELECT {keys}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM zs{tag}),
zero{tag} AS (SELECT {_pre('d', keys)}, d.date, coalesce(x.y, 0.0) AS y, d.date > {cut} AS is_backlog FROM zdays{tag} d LEFT JOIN zd{tag} x ON {_on('d', 'x', keys)} AND d.date = x.date)"""


def _naive(keys: str, source: str, horizon: int, name: str = "naive") -> str:
    return f"""dif_{name} AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY {keys} ORDER BY date) AS dy FROM {source} WHERE n >= 7), spread_{name} AS (SELECT {keys}, coalesce(stddev_pop(dy), 0) AS sd, max(date) AS last FROM dif_{name} GROUP BY ALL), steps_{name} AS (SELECT *, unnest(range(1, {horizon + 1})) AS step FROM spread_{name}),
{name} AS (SELECT {_pre('s', keys)}, s.last + CAST(s.step AS INTEGER) AS date, s.step, w.y AS yhat, greatest(0.0, w.y - 1.28 * s.sd) AS lower, w.y + 1.28 * s.sd AS upper FROM steps_{name} s JOIN {source} w ON {_on('s', 'w', keys)} AND w.i = w.n - 6 + (s.step - 1) % 7)"""


TESTS = f"""sizes AS (SELECT {K}, max(n) AS n FROM hist GROUP BY ALL), counted AS (SELECT *, CASE WHEN n >= 60 + {HORIZON} THEN greatest(1, least(8, (n - 60) // {HORIZON})) ELSE 0 END AS windows FROM sizes),
origins AS (SELECT {K}, n, windows, unnest(range(1, windows + 1)) AS "window" FROM counted WHERE windows > 0), org AS (SELECT *, n - (windows - "window" + 1) * {HORIZON} AS train_days FROM origins),
lagged AS (SELECT *, lag(y, 7) OVER w AS l7, lag(y, 14) OVER w AS l14, lag(y, 21) OVER w AS l21, lag(y, 28) OVER w AS l28, lag(y, 35) OVER w AS l35, avg(y) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS m28 FROM hist WINDOW w AS (PARTITION BY {K} ORDER BY date)),
flats AS (SELECT {_pre('o', K)}, o."window", o.train_days, h.m28 AS flat FROM org o JOIN lagged h ON {_on('o', 'h', K)} AND h.i = o.train_days),
wide AS (SELECT {_pre('o', K)}, o."window", h.date, h.y, CASE WHEN h.i - o.train_days <= 7 THEN l7 ELSE l14 END AS naive, CASE WHEN h.i - o.train_days <= 7 THEN (l7 + l14 + l21 + l28) / 4 ELSE (l14 + l21 + l28 + l35) / 4 END AS weekday, o.flat FROM flats o JOIN lagged h ON {_on('o', 'h', K)} AND h.i > o.train_days AND h.i <= o.train_days + {HORIZON}),
bt AS (SELECT {K}, "window", date, y, 'Seasonal Naive' AS model, naive AS yhat FROM wide UNION ALL SELECT {K}, "window", date, y, 'Weekday Mean', weekday FROM wide UNION ALL SELECT {K}, "window", date, y, 'Trailing Mean', flat FROM wide)"""
SCALE = f"scales AS (SELECT {K}, avg(d) AS scale FROM (SELECT {K}, abs(y - lag(y, 7) OVER (PARTITION BY {K} ORDER BY date)) AS d FROM hist) GROUP BY ALL)"
MEASURE = f"""{_history()}, {TESTS}, {SCALE}, ms AS (SELECT {_pre('b', K)}, model, 100 * sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS wape, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, 100 * avg(CASE WHEN abs(y) + abs(yhat) = 0 THEN 0.0 ELSE 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END) AS smape, avg(abs(y - yhat)) / nullif(any_value(s.scale), 0) AS mase, avg(yhat - y) AS bias, 100 * abs(sum(yhat) - sum(y)) / nullif(abs(sum(y)), 0) AS abs_pct_bias, count(DISTINCT "window") AS n_windows FROM bt b JOIN scales s ON {_on('b', 's', K)} GROUP BY ALL),
board AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY wape NULLS LAST, mae NULLS LAST, abs_pct_bias NULLS LAST, model) AS rank FROM ms), least_wape AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY wape NULLS LAST, model) AS r FROM ms) WHERE r = 1)"""
EVENTS = "ev AS (SELECT date, max(uplift_pct) AS uplift_pct FROM (VALUES " + ", ".join(f"(DATE '{d}', CAST({'NULL' if p is None else p} AS DOUBLE))" for d, p in samples.EVENTS) + ") t(date, uplift_pct) GROUP BY date)"
VARIANCE = f"""{_history()}, {EVENTS}, past AS (SELECT * FROM ev WHERE date <= {DAY}), act AS (SELECT {_pre('h', K)}, h.date AS event_date, h.y AS actual FROM hist h JOIN past p ON h.date = p.date),
vr AS (SELECT {_pre('a', K)}, event_date, actual, avg(h.y) AS baseline, count(h.y) AS n_baseline, (actual - avg(h.y)) / avg(h.y) * 100 AS variance_pct FROM act a JOIN hist h ON {_on('a', 'h', K)} AND (event_date - h.date) % 7 = 0 AND event_date - h.date BETWEEN 7 AND 56 WHERE h.date NOT IN (SELECT date FROM past) GROUP BY {_pre('a', K)}, event_date, actual HAVING count(h.y) >= 3 AND avg(h.y) > 0),
ou AS (SELECT {K}, avg(variance_pct) AS overall_pct, count(*) AS n_dates FROM vr GROUP BY ALL HAVING count(*) >= 2)"""
RESOLVED = f"""{VARIANCE}, fut AS (SELECT * FROM ev WHERE date > {DAY} AND date <= {DAY} + {HORIZON}), want AS (SELECT s.*, f.* FROM (SELECT DISTINCT {K} FROM hist WHERE n >= 7) s CROSS JOIN fut f),
ana AS (SELECT {_pre('w', K)}, w.date, avg(variance_pct) AS analog_pct, count(*) AS n_analogs FROM want w JOIN vr v ON {_on('w', 'v', K)} WHERE least(abs(dayofyear(w.date) - dayofyear(v.event_date)), 365 - abs(dayofyear(w.date) - dayofyear(v.event_date))) <= 7 GROUP BY ALL),
res AS (SELECT {_pre('w', K)}, w.date, coalesce(w.uplift_pct, a.analog_pct, o.overall_pct, 20.0) AS resolved_pct, CASE WHEN w.uplift_pct IS NOT NULL THEN 'explicit' WHEN a.analog_pct IS NOT NULL THEN 'analog_average' WHEN o.overall_pct IS NOT NULL THEN 'overall_average' ELSE 'flat_default' END AS method, CASE WHEN w.uplift_pct IS NULL THEN coalesce(a.n_analogs, 0) ELSE 0 END AS n_analogs FROM want w LEFT JOIN ana a ON {_on('w', 'a', K)} AND w.date = a.date LEFT JOIN ou o ON {_on('w', 'o', K)}),
rp AS (SELECT {K}, date + shift AS date, sum(resolved_pct / 100 * weight) AS share FROM res CROSS JOIN (VALUES (-2, 0.25::DOUBLE), (-1, 0.5), (0, 1.0), (1, 0.5), (2, 0.25)) t(shift, weight) GROUP BY ALL)"""
BACKLOG = f"bl AS (SELECT {K}, date, sum(net_pounds) AS y FROM lines WHERE date > {DAY} GROUP BY ALL)"
PROJECT = f"{_naive(K, 'hist', HORIZON)}, {BACKLOG}, pj AS (SELECT {_pre('f', K)}, f.date, yhat, coalesce(b.y, 0.0) AS backlog, greatest(yhat, coalesce(b.y, 0.0)) AS combined FROM naive f LEFT JOIN bl b ON {_on('f', 'b', K)} AND f.date = b.date)"
ADJUST = f"{RESOLVED}, {PROJECT}, ad AS (SELECT p.*, coalesce(r.share, 0.0) AS share, combined * (1 + coalesce(r.share, 0.0)) AS final_forecast FROM pj p LEFT JOIN rp r ON {_on('p', 'r', K)} AND p.date = r.date)"
PROFILE = f"""{MIXED}, {_zero(M, 'mixed')}, back AS (SELECT *, row_number() OVER (PARTITION BY {M} ORDER BY date DESC) AS b FROM zero WHERE NOT is_backlog),
pf0 AS (SELECT {M}, {DAY} - min(date) + 1 AS span_days, coalesce({DAY} - max(CASE WHEN y > 0 THEN date END), {DAY} - min(date) + 1) AS days_since, avg(CASE WHEN b <= 28 THEN y END) AS recent_avg, min(y) AS y_min, max(y) AS y_max, avg(CASE WHEN b <= 90 THEN CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END END) AS density FROM back GROUP BY ALL),
pf AS (SELECT *, CASE WHEN span_days < 14 OR days_since > 60 THEN 'Dormant' WHEN span_days < 90 THEN 'New' WHEN density >= 0.4 THEN 'Regular' ELSE 'Intermittent' END AS demand_class FROM pf0),
st AS (SELECT {M}, dayofweek(date) AS dow, avg(y) AS mean, coalesce(stddev_samp(y), 0.0) AS std, quantile_cont(y, 0.95) AS cap FROM back WHERE b <= 182 GROUP BY ALL)"""
_WEEK = "date - CAST(dayofweek(date) AS INTEGER)"
def _reconcile(block: str, week: bool) -> str:
    up = "has_model AND demand_class IN ('Regular', 'Intermittent') AND variance > 0" + (" AND total > 0" if week else "")
    down = "has_model AND demand_class IN ('Regular', 'Intermittent', 'New') AND variance > 0 AND total > 0"
    share = "CASE WHEN e.total > 0 THEN r.m / e.total ELSE 0.0 END" if week else "1.0"
    return f"""{_layer('mixed', PROFILE)}, rb AS (SELECT *, {block} AS block FROM sh), tot AS (SELECT {M}, block, demand_class, has_model, sum(m) AS total, sum(std * std) AS variance, sum(cap * greatest(hf, 1.0)) AS capacity FROM rb GROUP BY ALL),
gp AS (SELECT t.block, c.target - t.detail AS gap FROM (SELECT block, sum(total) AS detail FROM tot GROUP BY ALL) t JOIN (SELECT {block} AS block, sum(model) AS target FROM co GROUP BY ALL) c ON t.block = c.block),
ea0 AS (SELECT t.*, g.gap, CASE WHEN g.gap > 0 THEN {up} ELSE {down} END AS able FROM tot t JOIN gp g ON t.block = g.block), ea AS (SELECT *, CASE WHEN able THEN variance ELSE 0.0 END AS weight, CASE WHEN NOT able THEN 0.0 WHEN gap > 0 THEN greatest(0.0, capacity - total) ELSE total * 0.5 END AS room FROM ea0),
lv AS (SELECT block, max(l) AS level FROM (SELECT block, room / weight AS ratio, (abs(gap) - coalesce(sum(room) OVER (PARTITION BY block ORDER BY room / weight, weight, room, {M} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY block ORDER BY room / weight, weight, room, {M} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM ea WHERE weight > 0 AND room > 1e-9) WHERE l <= ratio AND l >= 0 GROUP BY block),
al AS (SELECT e.*, CASE WHEN NOT (weight > 0 AND room > 1e-9) OR abs(gap) <= 1 THEN 0.0 ELSE sign(gap) * CASE WHEN l.level IS NULL THEN room ELSE least(l.level * weight, room) END END AS alloc FROM ea e LEFT JOIN lv l ON e.block = l.block),
rc AS (SELECT {_pre('r', M)}, r.date, r.demand_class, r.has_model, r.hf, r.slot, r.own, e.weight > 0 AS eligible, r.m, e.alloc * {share} AS adj, greatest(r.m + e.alloc * {share}, 0.0) AS model_final, r.backlog, greatest(greatest(r.m + e.alloc * {share}, 0.0), r.backlog) AS final FROM rb r JOIN al e ON {_on('r', 'e', M)} AND r.block = e.block)"""


def _calendar() -> str:
    """Holiday slots from 60 days before the first order to 60 days past the last day ahead; needs `lines`."""
    start, end = "(SELECT min(date) - 60 FROM lines)", f"({DAY} + {WEEKS + holidays.PADDING})"
    rows = ", ".join(f"({y}, {k}, '{n}', DATE '{d}', {b}, {a})" for y, k, n, d, b, a in holidays.holiday_dates(1993, 2002))
    return f"""hd AS (SELECT * FROM (VALUES {rows}) t(year, ord, holiday, day, before, after)), hw AS (SELECT *, unnest(range(-before, after + 1)) AS week FROM hd), hc AS (SELECT *, day - CAST(dayofweek(day) AS INTEGER) + CAST(7 * week + unnest(range(0, 7)) AS INTEGER) AS date FROM hw),
hn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(date - day), year, ord, week) AS r FROM hc WHERE date BETWEEN {start} AND {end}) WHERE r = 1),
cal AS (SELECT date, holiday || CASE WHEN week = 0 THEN ' wk0' WHEN week > 0 THEN ' wk+' || week ELSE ' wk' || week END AS slot, holiday, CAST(week AS BIGINT) AS week, CAST(year AS BIGINT) AS year, holiday || '|' || year || '|' || week AS block, min(date) OVER b AS block_first, max(date) OVER b AS block_last, count(*) OVER b AS block_days FROM hn WINDOW b AS (PARTITION BY holiday, year, week))"""


def _factors(keys: str, source: str, k: float, tag: str, parents: tuple[tuple[str, str], ...] = ()) -> str:
    """Three passes of factor estimation; a slot's parent is the first of the parents (table, its keys) that has one."""
    known = ", ".join([*(f"p{i}.factor" for i in range(len(parents))), "1.0"])
    joins = "".join(f" LEFT JOIN {table} p{i} ON p{i}.slot = c.slot" + "".join(f" AND p{i}.{x.strip()} = z.{x.strip()}" for x in of.split(",") if x.strip()) for i, (table, of) in enumerate(parents))
    base = f"r0{tag} AS (SELECT {_pre('z', keys)}, z.date, z.y, c.slot, c.block, c.block_days, c.block_first >= min(z.date) OVER q AND c.block_last <= max(z.date) OVER q AS whole, coalesce({known}) AS parent FROM {source} z LEFT JOIN cal c ON z.date = c.date{joins} WHERE NOT z.is_backlog WINDOW q AS (PARTITION BY {_pre('z', keys)})), f0{tag} AS (SELECT *, CASE WHEN slot IS NULL THEN 1.0 ELSE parent END AS f FROM r0{tag})"
    out = [base]
    for i in range(3):
        around = f"OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING)"
        out.append(f"""b{i}{tag} AS (SELECT *, coalesce(CASE WHEN count(*) {around} >= 28 THEN avg(y / f) {around} END, 0) AS base FROM f{i}{tag}),
k{i}{tag} AS (SELECT {keys}, block, slot, parent, block_days, sum(y) AS sy, sum(base) AS sb, count(*) FILTER (y > 0) AS nz, count(*) AS cn FROM b{i}{tag} WHERE whole AND base > 0 GROUP BY ALL HAVING count(*) = block_days AND sum(base) > 0),
s{i}{tag} AS (SELECT {keys}, slot, parent, sum(sy) / sum(sb) AS ratio, sum(least(1.0::DOUBLE, nz / 3)) AS n_obs FROM k{i}{tag} GROUP BY ALL),
e{i}{tag} AS (SELECT {keys}, slot, greatest(0.3::DOUBLE, least(3.0::DOUBLE, n_obs / (n_obs + {k}) * ratio + (1 - n_obs / (n_obs + {k})) * parent)) AS factor, n_obs FROM s{i}{tag})""")
        if i < 2:
            out.append(f"f{i + 1}{tag} AS (SELECT x.* EXCLUDE (f), CASE WHEN x.slot IS NULL THEN 1.0 ELSE coalesce(e.factor, x.parent) END AS f FROM f{i}{tag} x LEFT JOIN e{i}{tag} e ON {_on('x', 'e', keys)} AND x.slot = e.slot)")
    return ", ".join(out)


def _layer(source: str, profile: str) -> str:
    """Company and keys over the days ahead: three levels of holiday factors, the seasonal naive of the freed series, weekday shapes."""
    slot = lambda key: f"LEFT JOIN cal c ON {key}.date = c.date LEFT JOIN e2_k fk ON {_on('fk', key, M)} AND fk.slot = c.slot LEFT JOIN e2_m fm ON fm.material_no = {key}.material_no AND fm.slot = c.slot LEFT JOIN e2_a fa ON fa.slot = c.slot"
    factor = "CASE WHEN c.slot IS NULL THEN 1.0 ELSE coalesce(fk.factor, fm.factor, fa.factor, 1.0) END"
    numbered = lambda keys: f"row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i, count(*) OVER (PARTITION BY {keys}) AS n"
    return f"""{profile}, {_calendar()}, allrows AS (SELECT 'all' AS every, date, net_pounds FROM {source}), {_zero('every', 'allrows', DAY, '_c')}, {_factors('every', 'zero_c', 0.5, '_a')},
{_zero('material_no', source, DAY, '_m')}, {_factors('material_no', 'zero_m', 1.5, '_m', (('e2_a', ''),))}, {_factors(M, 'zero', 4.0, '_k', (('e2_m', 'material_no'), ('e2_a', '')))},
fz AS (SELECT {_pre('z', M)}, z.date, z.y / {factor} AS y FROM zero z {slot('z')} JOIN pf p ON {_on('p', 'z', M)} WHERE NOT z.is_backlog AND p.demand_class <> 'Dormant'), zh AS (SELECT *, {numbered(M)} FROM fz), {_naive(M, 'zh', WEEKS)},
mb AS (SELECT {M}, date, sum(net_pounds) AS y FROM {source} WHERE date > {DAY} GROUP BY ALL), ahead AS (SELECT CAST({DAY} + unnest(range(1, {WEEKS + 1}))::INTEGER AS DATE) AS date),
g0 AS (SELECT {M}, demand_class, date FROM pf CROSS JOIN ahead), ly AS (SELECT {_pre('g', M)}, g.date, greatest(coalesce(f.yhat, 0.0), 0.0) AS base, f.yhat IS NOT NULL AS has_model, CASE WHEN f.yhat IS NOT NULL THEN {factor} ELSE 1.0 END AS hf, c.slot, coalesce(fk.n_obs, 0) >= 1 AS own, coalesce(b.y, 0.0) AS backlog, demand_class FROM g0 g LEFT JOIN naive f ON {_on('f', 'g', M)} AND f.date = g.date LEFT JOIN mb b ON {_on('b', 'g', M)} AND b.date = g.date {slot('g')}),
cf AS (SELECT date, slot, CASE WHEN slot IS NULL THEN 1.0 ELSE coalesce(factor, 1.0) END AS hf FROM (SELECT c.date, c.slot, a.factor FROM cal c LEFT JOIN e2_a a ON a.slot = c.slot)),
zhc AS (SELECT *, {numbered('every')} FROM (SELECT every, z.date, z.y / coalesce(f.hf, 1.0) AS y FROM zero_c z LEFT JOIN cf f ON f.date = z.date WHERE NOT is_backlog)), {_naive('every', 'zhc', WEEKS, 'cn')},
co AS (SELECT c.date, greatest(c.yhat, 0.0) * coalesce(f.hf, 1.0) AS model, coalesce(b.y, 0.0) AS backlog, greatest(greatest(c.yhat, 0.0) * coalesce(f.hf, 1.0), coalesce(b.y, 0.0)) AS initial, f.slot, f.hf FROM cn c LEFT JOIN cf f ON f.date = c.date LEFT JOIN (SELECT date, sum(net_pounds) AS y FROM {source} WHERE date > {DAY} GROUP BY ALL) b ON c.date = b.date),
sh0 AS (SELECT l.*, base * hf AS m, {_WEEK.replace('date', 'l.date')} AS week, s.dow, coalesce(s.mean, 0) AS w, coalesce(s.std, 0) AS std, coalesce(s.cap, 0) AS cap FROM ly l LEFT JOIN st s ON {_on('l', 's', M)} AND dayofweek(l.date) = s.dow),
sh AS (SELECT {M}, date, week, base, hf, slot, own, backlog, demand_class, has_model, std, cap, CASE WHEN has_model AND sum(w) OVER p > 0 AND sum(m) OVER p > 0 THEN sum(m) OVER p * w / sum(w) OVER p ELSE m END AS m FROM sh0 WINDOW p AS (PARTITION BY {M}, week))"""


WEEKLY, DAILY = _reconcile(_WEEK, True), _reconcile("date", False)
COMPANY = f"{LINES}, {_calendar()}, everyrow AS (SELECT 'all' AS every, date, net_pounds FROM lines), {_zero('every', 'everyrow', DAY, '_a')}, {_factors('every', 'zero_a', 0.5, '_a')}"
MATERIAL = f"{COMPANY}, {_zero('material_no', 'lines', DAY, '_m')}, {_factors('material_no', 'zero_m', 1.5, '_m', (('e2_a', ''),))}"
COMBO = f"{MATERIAL}, {_zero(M, 'lines', DAY, '_k')}, {_factors(M, 'zero_k', 4.0, '_k', (('e2_m', 'material_no'), ('e2_a', '')))}"
DIRTY = f"""{LINES}, exported AS (SELECT sheet, customer, material_group, material_no, plant, order_no, CASE WHEN order_no % 83 = 0 THEN 'soon' ELSE strftime(date, '%Y-%m-%d') END AS day_text, CASE WHEN order_no % 97 = 0 THEN 'n/a' WHEN order_no % 89 = 0 THEN '1.2.3' WHEN order_no % 2 = 0 THEN CAST(CAST(net_pounds AS INTEGER) AS VARCHAR) || ' lbs' ELSE '0,' || CAST(CAST(net_pounds AS INTEGER) AS VARCHAR) END AS pounds_text FROM lines),
both_sheets AS (SELECT * FROM exported UNION ALL SELECT * REPLACE ('99H2' AS sheet) FROM exported WHERE order_no % 50 = 0), dirty AS (SELECT *, try_cast(day_text AS DATE) AS date, CASE WHEN pounds_text IN ('n/a', '1.2.3') THEN NULL ELSE CAST(regexp_replace(pounds_text, '[^0-9]', '', 'g') AS DOUBLE) END AS v FROM both_sheets)"""
_R = lambda *names, d=6: ", ".join(f"round({n}, {d}) AS {n}" for n in names)
_MEASURES = _R("wape", "mae", "rmse", "smape", "mase", "bias", "abs_pct_bias")
RUNS = f"{MEASURE}, best AS (SELECT {K}, model, round(wape, 6) AS wape FROM least_wape), runs AS (SELECT *, '2001-07-30' AS run_date FROM best WHERE customer <> 'BUILDING' UNION ALL SELECT *, '2001-07-31' FROM best WHERE customer <> 'MACHINERY')"

_BODY = {
    "dq_report": f"WITH {DIRTY} SELECT sheet, count(*) AS rows_loaded, count(*) FILTER (date IS NULL) AS bad_dates, count(*) FILTER (v IS NULL) AS bad_pounds, count(*) FILTER (date IS NOT NULL AND v IS NOT NULL) AS rows_valid, sum(v) FILTER (date IS NOT NULL AND v IS NOT NULL) AS pounds FROM dirty GROUP BY sheet",
    "exact_dedup": f"WITH {DIRTY}, ok AS (SELECT *, row_number() OVER (PARTITION BY customer, material_group, material_no, plant, order_no, day_text, pounds_text ORDER BY sheet) AS r FROM dirty WHERE date IS NOT NULL AND v IS NOT NULL) SELECT sheet, count(*) AS n, sum(v) AS pounds FROM ok WHERE r = 1 GROUP BY sheet",
    "dup_count": f"WITH {DIRTY}, g AS (SELECT count(*) AS n FROM dirty WHERE date IS NOT NULL AND v IS NOT NULL GROUP BY customer, material_group, material_no, plant, order_no, day_text, pounds_text) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g",
    "daily_total": f"WITH {LINES} SELECT date, sum(net_pounds) AS y FROM lines GROUP BY date",
    "daily_by_segment": f"WITH {LINES} SELECT {K}, date, sum(net_pounds) AS y FROM lines GROUP BY ALL",
    "overall_grouping_sets": f"WITH {LINES} SELECT {K}, date, sum(net_pounds) AS y, CAST(0 AS BIGINT) AS overall FROM lines WHERE customer IS NOT NULL AND material_group IS NOT NULL GROUP BY ALL UNION ALL SELECT '__OVERALL__', '__OVERALL__', date, sum(net_pounds), 1 FROM lines GROUP BY date",
    "filtered_daily": f"WITH {LINES} SELECT date, sum(net_pounds) AS y FROM lines WHERE customer = 'BUILDING' GROUP BY date",
    "segment_options": f"WITH {LINES} SELECT customer, string_agg(DISTINCT material_group, ', ' ORDER BY material_group) AS groups, count(DISTINCT material_group) AS n FROM lines GROUP BY customer",
    "segment_list": f"WITH {LINES} SELECT DISTINCT {K} FROM lines ORDER BY ALL LIMIT 10",
    "dense_calendar": f"WITH {LINES}, {_dense(K)} SELECT * FROM dense",
    "gaps_keep": f"WITH {LINES}, {_dense(M)} SELECT * FROM dense WHERE y IS NOT NULL",
    "gaps_zero": f"WITH {LINES}, {_dense(M)} SELECT {M}, date, coalesce(y, 0) AS y FROM dense",
    "gaps_interpolate": f"WITH {LINES}, {_dense(M)}, {_linear(M, 'dense', 'filled')} SELECT {M}, date, {_R('y')} FROM filled",
    "missing_dates": f"WITH {LINES}, {_dense(M)} SELECT {M}, date FROM dense WHERE y IS NULL",
    "asof_split": f"WITH {LINES}, {_daily(K)} SELECT {K}, date > {DAY} AS is_backlog, count(*) AS days, sum(y) AS pounds FROM daily GROUP BY ALL",
    "zero_filled_series": f"WITH {LINES}, {_zero(M)} SELECT * FROM zero",
    "weekly_resample": f"WITH {LINES}, {_daily(K)} SELECT {K}, {_WEEK} + 6 AS week_end, sum(y) AS y FROM daily GROUP BY ALL",
    "rolling_means": f"WITH {_history()} SELECT {K}, date, {_R('y')}, " + ", ".join(f"round(CASE WHEN count(y) OVER (w ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) >= {max(2, w // 2)} THEN avg(y) OVER (w ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END, 6) AS mean_{w}" for w in (7, 14, 28)) + f" FROM hist WINDOW w AS (PARTITION BY {K} ORDER BY date)",
    "feature_matrix": f"WITH {_history()} SELECT {K}, date, {_R('y')}, " + ", ".join(f"round(lag(y, {k}) OVER w, 6) AS lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28)) + ", " + ", ".join(f"round(CASE WHEN count(y) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) >= {max(2, w // 2)} THEN avg(y) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END, 6) AS mean_{w}" for w in (7, 14, 28)) + f", round(CASE WHEN count(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 3 THEN stddev_samp(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END, 6) AS std_7, isodow(date) - 1 AS dow, month(date) AS month, quarter(date) AS quarter, dayofyear(date) AS doy, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END::BIGINT AS weekend, round(sin(2 * pi() * dayofyear(date) / 365.25), 6) AS sin_1, round(cos(2 * pi() * dayofyear(date) / 365.25), 6) AS cos_1, round(sin(4 * pi() * dayofyear(date) / 365.25), 6) AS sin_2, round(cos(4 * pi() * dayofyear(date) / 365.25), 6) AS cos_2, CASE WHEN date IN (DATE '2000-03-14', DATE '2000-10-31') THEN 1 ELSE 0 END::BIGINT AS event FROM hist WINDOW w AS (PARTITION BY {K} ORDER BY date)",
    "weekday_profile": f"WITH {_history()} SELECT {K}, isodow(date) - 1 AS dow, round(avg(y), 6) AS mean FROM hist GROUP BY ALL",
    "centered_baseline": f"WITH {LINES}, {_zero(M)} SELECT {M}, date, round(CASE WHEN count(*) OVER w >= 28 THEN avg(y) OVER w END, 6) AS baseline FROM zero WHERE NOT is_backlog WINDOW w AS (PARTITION BY {M} ORDER BY date ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING)",
    "seasonal_diff_scale": f"WITH {_history()}, {SCALE} SELECT {K}, {_R('scale')} FROM scales",
    "seasonal_naive": f"WITH {_history()}, {_naive(K, 'hist', HORIZON)} SELECT {K}, date, step, {_R('yhat', 'lower', 'upper')} FROM naive",
    "backtest_origins": f"WITH {_history()}, {TESTS} SELECT {K}, n, windows, \"window\", train_days FROM org",
    "backtest_rows": f"WITH {_history()}, {TESTS} SELECT {K}, \"window\", date, {_R('y')}, model, {_R('yhat')} FROM bt",
    "metrics_by_segment": f"WITH {MEASURE} SELECT {K}, model, {_MEASURES}, n_windows, round(CASE WHEN wape IS NOT NULL THEN greatest(0.0, 100 - wape) END, 6) AS accuracy FROM ms",
    "leaderboard": f"WITH {MEASURE} SELECT {K}, model, rank, {_R('wape')} FROM board",
    "recommended_model": f"WITH {MEASURE}, b AS (SELECT * FROM board WHERE rank = 1), nv AS (SELECT {K}, wape FROM ms WHERE model = 'Seasonal Naive') SELECT {_pre('b', K)}, CASE WHEN b.model = 'Seasonal Naive' OR nv.wape IS NULL OR nv.wape - b.wape >= 2 THEN b.model ELSE 'Seasonal Naive' END AS recommended, b.model AS best_model, round(b.wape, 6) AS best_wape, round(nv.wape, 6) AS naive_wape, CASE WHEN b.model = 'Seasonal Naive' THEN 'seasonal naive is best' WHEN nv.wape IS NULL THEN 'seasonal naive was not evaluated' WHEN nv.wape - b.wape >= 2 THEN 'gain is meaningful' ELSE 'gain is too small' END AS reason FROM b LEFT JOIN nv ON {_on('b', 'nv', K)}",
    "best_by_wape": f"WITH {MEASURE} SELECT {K}, model AS best_model_by_wape, {_R('wape')} FROM least_wape",
    "multi_model_wide": f"WITH {_history()}, {TESTS} SELECT {K}, date, round(naive, 6) AS seasonal_naive, round(weekday, 6) AS weekday_mean, round(flat, 6) AS trailing_mean, round((naive + weekday + flat) / 3, 6) AS average FROM wide",
    "ensemble_average": f"WITH {_history()}, {_naive(K, 'hist', HORIZON)}, {BACKLOG}, fl AS (SELECT {K}, avg(y) AS yhat FROM hist WHERE i > n - 28 GROUP BY ALL), u AS (SELECT {K}, date, yhat FROM naive UNION ALL SELECT {_pre('n', K)}, n.date, f.yhat FROM naive n JOIN fl f ON {_on('n', 'f', K)}) SELECT {_pre('u', K)}, u.date, round(avg(greatest(u.yhat, coalesce(b.y, 0))), 6) AS average FROM u LEFT JOIN bl b ON {_on('u', 'b', K)} AND u.date = b.date GROUP BY ALL",
    "event_merge": "SELECT CAST(l_shipdate AS DATE) AS date, max(CASE WHEN l_linenumber > 2 THEN l_discount * 100 END) AS uplift_pct FROM lineitem GROUP BY 1",
    "event_classes": f"WITH {LINES}, {EVENTS}, s AS (SELECT min(date) AS lo, max(date) AS hi FROM lines WHERE date <= {DAY}) SELECT date, uplift_pct, CASE WHEN date BETWEEN lo AND hi THEN 'historical' WHEN date > {DAY} AND date <= {DAY} + {HORIZON} THEN 'future' ELSE 'out_of_range' END AS kind FROM ev CROSS JOIN s",
    "date_variance": f"WITH {VARIANCE} SELECT {K}, event_date, {_R('actual', 'baseline', 'variance_pct')}, n_baseline FROM vr",
    "overall_uplift": f"WITH {VARIANCE} SELECT {K}, {_R('overall_pct')}, n_dates FROM ou",
    "resolved_uplift": f"WITH {RESOLVED} SELECT {K}, date, {_R('resolved_pct')}, method, n_analogs FROM res",
    "uplift_ramp": f"WITH {RESOLVED} SELECT {K}, date, {_R('share')} FROM rp",
    "combined_projection": f"WITH {_history()}, {PROJECT} SELECT {K}, date, {_R('yhat', 'backlog', 'combined')} FROM pj",
    "adjusted_forecast": f"WITH {ADJUST} SELECT {K}, date, {_R('combined', 'share', 'final_forecast')} FROM ad",
    "final_forecast_table": f"WITH {ADJUST} SELECT {K}, date AS forecast_date, 'Seasonal Naive' AS model, round(yhat, 2) AS base_forecast, round(backlog, 2) AS known_backlog, round(combined, 2) AS combined_projection, round(share * 100, 2) AS uplift_pct, round(final_forecast, 2) AS final_forecast, share > 0 AS is_high_production_date, '2001-07-31T00:00:00' AS generated_at FROM ad",
    "actual_vs_forecast": f"WITH {_history()}, {_naive(K, 'hist', HORIZON)} SELECT {K}, date, round(y, 6) AS value, 'actual' AS type FROM hist UNION ALL SELECT {K}, date, round(yhat, 6), 'forecast' FROM naive",
    "segment_profile": f"WITH {PROFILE} SELECT {M}, span_days, {_R('recent_avg')}, y_min, y_max, {_R('density')}, days_since, demand_class FROM pf",
    "weekday_stats": f"WITH {PROFILE} SELECT {M}, dow, {_R('mean', 'std', 'cap')} FROM st",
    "class_counts": f"WITH {PROFILE} SELECT demand_class, count(*) AS n FROM pf GROUP BY ALL",
    "holiday_calendar": f"WITH {LINES}, {_calendar()} SELECT * FROM cal",
    "holiday_profile_company": f"WITH {COMPANY} SELECT slot, {_R('factor', 'n_obs')} FROM e2_a",
    "holiday_profile_material": f"WITH {MATERIAL} SELECT material_no, slot, {_R('factor', 'n_obs')} FROM e2_m",
    "holiday_profile_combo": f"WITH {COMBO} SELECT {M}, slot, {_R('factor', 'n_obs')} FROM e2_k",
    "weekday_shaping": f"WITH {_layer('mixed', PROFILE)} SELECT {M}, date, {_R('m')} FROM sh",
    "reconcile_weekly": f"WITH {WEEKLY} SELECT {M}, date, {_R('m', 'adj', 'model_final', 'final', d=4)} FROM rc",
    "reconcile_daily": f"WITH {DAILY} SELECT {M}, date, {_R('m', 'adj', 'model_final', 'final', d=4)} FROM rc",
    "recon_summary": f"WITH {WEEKLY}, s AS (SELECT date, sum(m) AS before, sum(adj) AS adjustment, sum(model_final) AS after, sum(backlog) AS backlog, sum(greatest(backlog - model_final, 0.0)) AS excess, sum(final) AS detail_total FROM rc GROUP BY date), j AS (SELECT s.date, c.model AS target, before, c.model - before AS gap, CASE WHEN c.model > 1e-6 THEN (c.model - before) / c.model * 100 END AS gap_pct, adjustment, after, c.model - after AS residual, s.backlog, excess, c.initial, detail_total, detail_total - c.initial AS detail_minus_overall FROM s JOIN co c ON s.date = c.date) SELECT date, {_R('target', 'before', 'gap', 'gap_pct', 'adjustment', 'after', 'residual', 'backlog', 'excess', 'initial', 'detail_total', 'detail_minus_overall', d=3)} FROM j",
    "recon_blocks": f"WITH {WEEKLY}, s AS (SELECT {_WEEK} AS week, min(date) AS first_day, max(date) AS last_day, count(DISTINCT date) AS days, sum(m) AS before, sum(adj) AS adjustment, sum(model_final) AS after, sum(backlog) AS backlog, sum(greatest(backlog - model_final, 0.0)) AS excess, sum(final) AS detail_total FROM rc GROUP BY ALL), n AS (SELECT week, count(*) FILTER (e) AS eligible, count(*) FILTER (a > 1e-9) AS adjusted FROM (SELECT {_WEEK} AS week, {M}, bool_or(eligible) AS e, max(abs(adj)) AS a FROM rc GROUP BY ALL) GROUP BY week), t AS (SELECT {_WEEK} AS week, sum(model) AS target, sum(initial) AS initial FROM co GROUP BY ALL), j AS (SELECT s.week, first_day, last_day, days, target, before, target - before AS gap, CASE WHEN target > 1e-6 THEN (target - before) / target * 100 END AS gap_pct, adjustment, target - after AS unresolved, eligible, adjusted, backlog, excess, initial, detail_total, detail_total - initial AS detail_minus_overall FROM s JOIN t ON s.week = t.week JOIN n ON s.week = n.week) SELECT week, first_day, last_day, days, eligible, adjusted, {_R('target', 'before', 'gap', 'gap_pct', 'adjustment', 'unresolved', 'backlog', 'excess', 'initial', 'detail_total', 'detail_minus_overall', d=3)} FROM j",
    "weekly_overall": f"WITH {WEEKLY}, t AS (SELECT {_WEEK} + 6 AS week_end, sum(backlog) AS backlog, sum(greatest(model - backlog, 0.0)) AS additional, sum(initial) AS total, sum(model) AS target FROM co GROUP BY ALL), d AS (SELECT {_WEEK} + 6 AS week_end, sum(final) AS detail, sum(greatest(backlog - model_final, 0.0)) AS excess, sum(model_final) AS after, count(DISTINCT date) AS days FROM rc GROUP BY ALL), x AS (SELECT week_end, string_agg(slot || ' (x' || printf('%.2f', round(hf, 9)) || ')', '; ' ORDER BY day, slot) AS context FROM (SELECT {_WEEK} + 6 AS week_end, slot, min(date) AS day, any_value(hf) AS hf FROM co WHERE slot IS NOT NULL GROUP BY ALL) GROUP BY week_end) SELECT t.week_end, round(backlog, 3) AS backlog, round(additional, 3) AS additional, round(total, 3) AS total, round(CASE WHEN days = 7 THEN detail END, 3) AS detail, round(CASE WHEN days = 7 THEN detail - total END, 3) AS difference, round(CASE WHEN days = 7 THEN excess END, 3) AS excess, round(CASE WHEN days = 7 THEN after - target END, 3) AS unresolved, coalesce(x.context, '') AS holiday_context FROM t LEFT JOIN d ON t.week_end = d.week_end LEFT JOIN x ON t.week_end = x.week_end",
    "reasoning_text": f"WITH {WEEKLY}, s AS (SELECT {M}, demand_class, sum(adj) AS a, bool_or(backlog > model_final) AS o FROM rc GROUP BY ALL) SELECT {M}, CASE WHEN demand_class = 'Dormant' THEN 'dormant: backlog only' ELSE demand_class || ' series' END || '; ' || CASE WHEN a > 1 THEN 'increased to meet the company total' WHEN a < -1 THEN 'decreased to meet the company total' ELSE 'no reconciliation needed' END || CASE WHEN o THEN '; backlog exceeds the model' ELSE '' END AS reason FROM s",
    "holdout_backtest": f"WITH {LINES}, kept AS (SELECT * FROM lines WHERE date <= {DAY}), {_zero(K, 'kept', chr(68) + 'ATE ' + chr(39) + '2001-07-10' + chr(39))}, zh AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY date) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM zero WHERE NOT is_backlog), {_naive(K, 'zh', WEEKS)}, {_daily(K, 'kept')}, j AS (SELECT {_pre('f', K)}, yhat, coalesce(d.y, 0.0) AS y FROM naive f LEFT JOIN daily d ON {_on('f', 'd', K)} AND f.date = d.date) SELECT {K}, round(sum(abs(yhat - y)) / nullif(sum(abs(y)), 0), 6) AS wape, round(sum(yhat - y) / nullif(sum(abs(y)), 0), 6) AS bias, round(abs(sum(yhat) - sum(y)) / nullif(sum(y), 0), 6) AS horizon_wape FROM j GROUP BY ALL",
    "latest_run": f"WITH {RUNS} SELECT * FROM runs r WHERE run_date = (SELECT max(run_date) FROM runs q WHERE {_on('q', 'r', K)})",
    "skip_done": f"WITH {RUNS} SELECT DISTINCT {K} FROM lines l WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_date = '2001-07-31' AND {_on('r', 'l', K)})",
    "dq_numeric": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_extendedprice * 1000 WHEN l_linenumber = 2 THEN l_discount / 1000 WHEN l_linenumber IN (4, 5) THEN -l_quantity END AS value,
  CASE WHEN l_linenumber = 3 OR l_linenumber > 5 THEN 'missing' END AS reason, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_partkey * 1000000 AS VARCHAR) ELSE l_partkey || '.5' END AS id FROM lineitem""",
    "committed_runs": f"WITH {RUNS} SELECT * REPLACE (CASE WHEN run_date = '2001-07-31' AND customer = 'BUILDING' THEN 'override' ELSE model END AS model) FROM runs",
    "upsert_run": f"WITH {RUNS} SELECT * REPLACE (CASE WHEN run_date = '2001-07-31' AND customer = 'BUILDING' THEN 'override' ELSE model END AS model) FROM runs",
}
_WIDE = ", ".join(f"round(round(max(CASE WHEN date = {DAY} + {k} THEN final END), 6), 1) AS \"{dt.date.fromisoformat(AS_OF) + dt.timedelta(k)}\"" for k in range(1, WEEKS + 1))
_INT = lambda x: f"CAST(CAST(round(round({x}, 6)) AS BIGINT) AS VARCHAR)"
_SLOTS = [f"{n} wk{'+' if w > 0 else ''}{w}" for n, _, before, after in holidays.HOLIDAYS for w in range(-before, after + 1)]
_OFF = "abs(round(factor - 1, 9))"
_EFFECTS = ", ".join(f"coalesce(max(CASE WHEN slot = '{x}' THEN v END), CASE WHEN level = 'company evidence' THEN 0.0 ELSE 1.0 END) AS \"{x}\"" for x in _SLOTS)
_BODY |= {
    "wide_forecast": f"WITH {WEEKLY} SELECT {M}, {_WIDE} FROM rc GROUP BY {M}",
    "reasoning_daily": f"""WITH {WEEKLY}, md AS (SELECT *, CASE demand_class WHEN 'Regular' THEN 'AutoETS' WHEN 'Intermittent' THEN 'AutoARIMA' WHEN 'New' THEN 'Seasonal Naive' END AS model FROM rc)
SELECT {M}, date, {_INT('backlog')} || ' + ' || {_INT('final - backlog')} || ' = ' || {_INT('final')} AS parts, round(round(adj, 6), 1) AS adj, round(round(final, 6), 1) AS final,
concat_ws('; ', CASE WHEN demand_class = 'Dormant' THEN 'dormant: backlog only' WHEN NOT has_model THEN model || ' fit failed: backlog only' ELSE demand_class || ' series by ' || model END, CASE WHEN has_model AND slot IS NOT NULL AND abs(round(hf - 1, 9)) > 0.05 THEN slot || ' x' || printf('%.2f', round(hf, 9)) || CASE WHEN own THEN ' (own history)' ELSE ' (borrowed)' END END, CASE WHEN backlog > 0 THEN 'booked ' || {_INT('backlog')} || ' lb' END, CASE WHEN adj > 1 THEN 'increased by ' || {_INT('adj')} || ' lb' WHEN adj < -1 THEN 'decreased by ' || {_INT('-adj')} || ' lb' END,
CASE WHEN has_model AND backlog - model_final > 1 THEN 'backlog exceeds the model by ' || {_INT('backlog - model_final')} || ' lb' END, CASE WHEN abs(adj) <= 1 THEN 'no reconciliation needed' END) AS reason FROM md""",
    "holiday_model_layer": f"WITH {_layer('lines', PROFILE.replace(' FROM mixed', ' FROM lines'))} SELECT {M}, date, round(base, 6) AS base, round(hf, 6) AS factor, round(base * hf, 6) AS model FROM ly",
    "holiday_text": f"""WITH {_layer('lines', PROFILE.replace(' FROM mixed', ' FROM lines'))}, rk AS (SELECT *, row_number() OVER (PARTITION BY {M} ORDER BY {_OFF} DESC, slot) AS r FROM e2_k WHERE {_OFF} >= 0.1),
tx AS (SELECT {M}, string_agg(slot || ' x' || printf('%.2f', round(factor, 9)) || CASE WHEN n_obs >= 1 THEN ' (own)' ELSE ' (borrowed)' END, '; ' ORDER BY r) AS t FROM rk WHERE r <= 6 GROUP BY ALL)
SELECT {_pre('p', M)}, CASE WHEN p.demand_class = 'Dormant' THEN 'n/a (no model)' ELSE coalesce(t.t, 'No material holiday effects (all within +/-10%)') END AS holidays FROM pf p LEFT JOIN tx t ON {_on('p', 't', M)}""",
    "holiday_effects_wide": f"""WITH {MATERIAL}, ms AS (SELECT DISTINCT material_no FROM e2_m), sl AS (SELECT DISTINCT slot FROM cal),
v AS (SELECT 'company factor' AS level, '' AS material_no, slot, round(factor, 3) AS v FROM e2_a UNION ALL SELECT 'company evidence', '', slot, round(n_obs, 2) FROM e2_a UNION ALL SELECT 'material factor', m.material_no, s.slot, round(coalesce(e.factor, a.factor, 1.0), 3) FROM ms m CROSS JOIN sl s LEFT JOIN e2_m e ON e.material_no = m.material_no AND e.slot = s.slot LEFT JOIN e2_a a ON a.slot = s.slot) SELECT level, material_no, {_EFFECTS} FROM v GROUP BY level, material_no""",
    "segment_list": f"WITH {LINES}, s AS (SELECT DISTINCT {K} FROM lines) SELECT '__OVERALL__' AS customer, '__OVERALL__' AS material_group, 0::BIGINT AS place UNION ALL (SELECT {K}, row_number() OVER (ORDER BY {K}) FROM s ORDER BY {K} LIMIT 10)",
    "actual_matrix": f"WITH {LINES}, {_daily(K)}, grid AS (SELECT {K}, CAST(DATE '2001-07-10' + unnest(range(1, {WEEKS + 1}))::INTEGER AS DATE) AS date FROM (SELECT DISTINCT {K} FROM lines)) SELECT {_pre('g', K)}, g.date, coalesce(d.y, 0.0) AS y FROM grid g LEFT JOIN daily d ON {_on('g', 'd', K)} AND g.date = d.date",
    "actual_forecast_wide": f"""WITH {ADJUST}, u AS (SELECT {K}, date, 'Forecast' AS type, NULL::DOUBLE AS actual, final_forecast AS seasonal_naive FROM ad UNION ALL SELECT {K}, date, 'Actual', y, NULL FROM hist WHERE n - i < 30)
SELECT {K}, date, type, round(actual, 6) AS actual, round(seasonal_naive, 6) AS seasonal_naive, round(seasonal_naive, 6) AS average, row_number() OVER (PARTITION BY {K} ORDER BY type DESC, date DESC) AS place FROM u""",
    "final_forecast_models": f"""WITH {ADJUST}, fl AS (SELECT {K}, avg(y) AS yhat FROM hist WHERE i > n - 28 GROUP BY ALL), u AS (SELECT {K}, date, yhat, 'Seasonal Naive' AS model FROM naive UNION ALL SELECT {_pre('n', K)}, n.date, f.yhat, 'Trailing Mean' FROM naive n JOIN fl f ON {_on('n', 'f', K)}),
w AS (SELECT u.*, coalesce(b.y, 0.0) AS backlog, coalesce(r.share, 0.0) AS share FROM u LEFT JOIN bl b ON {_on('u', 'b', K)} AND u.date = b.date LEFT JOIN rp r ON {_on('u', 'r', K)} AND u.date = r.date)
SELECT {K}, date AS forecast_date, model, round(yhat, 2) AS base_forecast, round(backlog, 2) AS known_backlog, round(greatest(yhat, backlog), 2) AS combined_projection, round(share * 100, 2) AS uplift_pct, round(greatest(yhat, backlog) * (1 + share), 2) AS final_forecast, share > 0 AS is_high_production_date FROM w""",
}


def _texts(kind: str) -> str:
    forms, mark, value = samples.TEXTS[kind]
    held = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in forms)
    return f"t AS (SELECT l_orderkey * 10 + l_linenumber AS id, replace(list_extract([{held}], CAST((l_orderkey * 10 + l_linenumber) % {len(forms)} + 1 AS INTEGER)), '{mark}', {value}) AS raw FROM lineitem)"


_TOKEN = "regexp_replace(lower(raw), '[^a-z0-9]', '', 'g')"
_TRIM = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
_BODY |= {
    "header_tokens": f"WITH {_texts('headers')} SELECT id, {_TOKEN} AS token FROM t",
    "half_year_sheets": f"WITH {_texts('sheets')}, k AS (SELECT id, regexp_matches({_TOKEN}, '^[0-9]{{2}}hy?[12]$') AS accepted, {_TOKEN} AS token FROM t) SELECT id, accepted, CASE WHEN accepted THEN left(token, 2)::BIGINT ELSE 99 END AS year, CASE WHEN accepted THEN right(token, 1)::BIGINT ELSE 9 END AS half FROM k",
    "id_clean": f"WITH {_texts('ids')}, k AS (SELECT id, regexp_replace({_TRIM}, '\\s+', ' ', 'g') AS x FROM t) SELECT id, CASE WHEN lower(x) IN ('', 'nan', 'none', '<na>', 'nat') THEN NULL WHEN regexp_matches(x, '^-?[0-9]+\\.0+$') THEN split_part(x, '.', 1) ELSE x END AS clean FROM k",
    "number_parse": f"""WITH {_texts('numbers')}, k AS (SELECT id, raw, {_TRIM} AS x FROM t), b AS (SELECT *, lower(x) IN ('', 'nan', 'none', 'n/a', 'na', '-') AS blank, regexp_matches(x, '^\\(.*\\)$') AS negative, regexp_replace(x, '[^0-9.-]', '', 'g') AS bare FROM k),
v AS (SELECT *, CASE WHEN NOT blank AND regexp_matches(bare, '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN (CASE WHEN negative THEN -1 ELSE 1 END) * CAST(bare AS DOUBLE) END AS value FROM b) SELECT id, value, CASE WHEN raw IS NULL THEN 'missing' WHEN blank THEN 'blank' WHEN value IS NULL THEN 'unparseable' END AS reason FROM v""",
    "event_text": f"WITH {_texts('events')} SELECT id, date FROM (SELECT id, try_cast(trim(unnest(string_split(raw, ','))) AS DATE) AS date FROM t) WHERE date IS NOT NULL",
    "day_parse": "SELECT id, CASE list_extract([" + ", ".join(f"'{k}'" for _, k in samples.DAY_TEXTS) + f"], CAST(id % {len(samples.DAY_TEXTS)} + 1 AS INTEGER)) WHEN 'day' THEN day WHEN 'short' THEN make_date(2000 + year(day) % 100, month(day), day(day)) END AS date FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS day FROM lineitem)",
    "ets_recursion": f"""WITH RECURSIVE {_history()}, starts AS (SELECT {K}, avg(y) AS level, list(y ORDER BY i) AS first FROM hist WHERE i <= 7 GROUP BY {K} HAVING count(*) = 7),
r AS ( SELECT {K}, CAST(0 AS BIGINT) AS i, level, 0.0::DOUBLE AS slope, list_transform(first, lambda v: v - level) AS season, 0.0::DOUBLE AS squares FROM starts
UNION ALL SELECT {K}, i, q + 0.2 * e, 0.9 * slope + 0.05 * e, list_append(season[2:], season[1] + 0.1 * e), squares + e * e FROM (SELECT {_pre('r', K)}, h.i, r.slope, r.season, r.squares, r.level + 0.9 * r.slope AS q, h.y - r.level - 0.9 * r.slope - r.season[1] AS e FROM r JOIN hist h ON {_on('r', 'h', K)} AND h.i = r.i + 1))
SELECT {_pre('r', K)}, round(level, 4) AS level, round(slope, 4) AS slope, round(season[1], 4) AS season, round(sqrt(squares / r.i), 4) AS deviation FROM r JOIN (SELECT {K}, max(n) AS n FROM hist GROUP BY {K}) s ON {_on('r', 's', K)} AND r.i = s.n""",
}
_BODY["naive_backtest"] = f"WITH {_history()}, {TESTS} SELECT {K}, \"window\", date, {_R('y')}, model, {_R('yhat')} FROM bt WHERE model = 'Seasonal Naive'"


def _held_out(cut: str, holidays_used: bool) -> str:
    """Rows of a run made at the cut with orders up to the as-of day, by key and of the company (null keys); without holidays the calendar is empty."""
    text = WEEKLY.replace(DAY, f"DATE '{cut}'").replace("END AS material_no FROM lines)", f"END AS material_no FROM lines WHERE date <= {DAY})")
    text = text if holidays_used else text.replace("FROM hn WINDOW b", "FROM hn WHERE false WINDOW b")
    return f"(WITH {text} SELECT {M}, date, m, model_final FROM rc UNION ALL SELECT NULL, NULL, date, model, NULL FROM co)"


_ERROR = lambda p, k="abs": f"sum({k}({p} - y)) / nullif(sum(abs(y)), 0)"
_BOTH = "sum(y) AS y, sum(m) AS m"
_BODY["holdout_variants"] = f"""WITH {MIXED}, known AS (SELECT * FROM mixed WHERE date <= {DAY}), {_daily(M, 'known', 'own_days')}, all_days AS (SELECT date, sum(net_pounds) AS y FROM known GROUP BY date),
found AS (SELECT 'With holiday effects' AS variant, * FROM {_held_out('2001-07-10', True)} UNION ALL SELECT 'Without holiday effects', * FROM {_held_out('2001-07-10', False)}),
company AS (SELECT variant, f.date, m, coalesce(d.y, 0.0) AS y FROM found f LEFT JOIN all_days d ON f.date = d.date WHERE f.material_no IS NULL),
own AS (SELECT variant, {_pre('f', M)}, f.date, m, model_final, coalesce(d.y, 0.0) AS y FROM found f LEFT JOIN own_days d ON {_on('f', 'd', M)} AND f.date = d.date WHERE f.material_no IS NOT NULL),
weeks AS (SELECT variant, {_WEEK} AS week, {_BOTH} FROM company GROUP BY ALL), covered AS (SELECT variant, date, {_BOTH} FROM own GROUP BY ALL), covered_weeks AS (SELECT variant, {_WEEK} AS week, {_BOTH} FROM covered GROUP BY ALL),
horizon AS (SELECT variant, {M}, {_BOTH}, sum(model_final) AS model_final FROM own GROUP BY ALL),
told AS (SELECT 'company daily WAPE' AS metric, variant, {_ERROR('m')} AS v FROM company GROUP BY ALL UNION ALL SELECT 'company bias', variant, {_ERROR('m', '')} FROM company GROUP BY ALL UNION ALL SELECT 'company weekly WAPE', variant, {_ERROR('m')} FROM weeks GROUP BY ALL
UNION ALL SELECT 'covered keys daily WAPE before reconciliation', variant, {_ERROR('m')} FROM covered GROUP BY ALL UNION ALL SELECT 'covered keys weekly WAPE before reconciliation', variant, {_ERROR('m')} FROM covered_weeks GROUP BY ALL UNION ALL SELECT 'key daily WAPE reconciled', variant, {_ERROR('model_final')} FROM own GROUP BY ALL
UNION ALL SELECT 'key horizon WAPE reconciled', variant, {_ERROR('model_final')} FROM horizon GROUP BY ALL UNION ALL SELECT 'key horizon WAPE before reconciliation', variant, {_ERROR('m')} FROM horizon GROUP BY ALL)
SELECT metric, round(max(v) FILTER (variant = 'With holiday effects'), 6) AS "With holiday effects", round(max(v) FILTER (variant = 'Without holiday effects'), 6) AS "Without holiday effects" FROM told GROUP BY metric"""
# The batch's segments: those of all lines together, and each with both keys.
_EVERY = f"every AS (SELECT '__OVERALL__' AS customer, '__OVERALL__' AS material_group, date, net_pounds FROM lines UNION ALL SELECT {K}, date, net_pounds FROM lines WHERE customer IS NOT NULL AND material_group IS NOT NULL)"
_BATCH = MEASURE.replace(LINES, f"{LINES}, {_EVERY}", 1).replace("FROM lines GROUP BY ALL", "FROM every GROUP BY ALL", 1)
_BATCH += f", wanted AS (SELECT '__OVERALL__' AS customer, '__OVERALL__' AS material_group UNION ALL SELECT DISTINCT {K} FROM lines WHERE customer IS NOT NULL AND material_group IS NOT NULL), booked AS (SELECT {K}, date, y AS known_backlog FROM daily WHERE date > {DAY})"
_SHORT, _NONE = "'needs 21 observations'", "'not enough history for the horizon'"
_BODY |= {
    "batch_naive_summary": f"""WITH {_BATCH}, b AS (SELECT {K}, count(*) AS d FROM booked GROUP BY ALL), j AS (SELECT w.*, coalesce(c.n, 0) AS days, coalesce(b.d, 0) AS booked_days, c.windows FROM wanted w LEFT JOIN counted c ON {_on('c', 'w', K)} LEFT JOIN b ON {_on('b', 'w', K)})
SELECT {K}, days::INTEGER AS historical_days, booked_days::INTEGER AS backlog_days, CASE WHEN windows > 0 THEN 'Seasonal Naive' END AS best_model_by_wape, CASE WHEN days = 0 THEN 'skipped' WHEN days < 21 THEN 'error' ELSE 'ok' END AS status, CASE WHEN days = 0 THEN 'no historical data' WHEN days < 21 THEN {_SHORT} END AS error_message FROM j""",
    "batch_naive_metrics": f"""WITH {_BATCH}, nv AS (SELECT * FROM ms WHERE model = 'Seasonal Naive') SELECT {_pre('c', K)}, 'Seasonal Naive' AS model, {_MEASURES}, round(greatest(0.0, 100 - wape), 6) AS accuracy_score, windows::BIGINT AS n_success_windows, 0::BIGINT AS n_failed_windows, windows = 0 AS skipped, CASE WHEN windows = 0 THEN {_NONE} END AS skip_reason
FROM counted c LEFT JOIN nv m ON {_on('m', 'c', K)}""",
    "batch_naive_forecasts": f"""WITH {_BATCH}, {_naive(K, 'hist', HORIZON)}, f AS (SELECT {_pre('n', K)}, n.date, greatest(n.yhat, coalesce(b.known_backlog, 0.0)) AS v, coalesce(b.known_backlog, 0.0) AS known_backlog FROM naive n JOIN counted c ON {_on('c', 'n', K)} LEFT JOIN booked b ON {_on('b', 'n', K)} AND b.date = n.date WHERE c.n >= 21)
SELECT {K}, date AS forecast_date, round(v, 6) AS seasonal_naive, NULL::DOUBLE AS autoarima, NULL::DOUBLE AS autoets, NULL::DOUBLE AS hgb, round(v, 6) AS average, round(known_backlog, 6) AS known_backlog FROM f""",
}
# Every step of a query is evaluated once.
SQL = {name: text.replace(" AS (SELECT", " AS MATERIALIZED (SELECT") for name, text in _BODY.items()}
