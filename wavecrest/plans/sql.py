"""DuckDB SQL of the same results, written relationally and independently of the operators.

Windows are rows (id, w, t, v); convolutions and transforms are joins with banks given
as lists, so that both engines see the same bits.
"""

from __future__ import annotations

import numpy as np

from wavecrest.functions.banks import battery_banks, fourier_projections, gaussian_windows, random_kernels, statistic_nets, window_banks
from wavecrest.operators.dictionary import kernels as rocket_kernels
from wavecrest.operators.dictionary import dilations_for, golden
from wavecrest.operators.families import WIDTHS, ricker_kernels

EPS = "1e-8"
LINES = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"
#: Series sources: (id, x).
S1 = "SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings"
S2 = "SELECT user_id AS id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id"
S3 = f"SELECT l_suppkey AS id, list(l_extendedprice ORDER BY {LINES}) AS x FROM lineitem GROUP BY l_suppkey"
S4 = "SELECT o_custkey AS id, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS x FROM orders GROUP BY o_custkey"
S3_CHANNELS = " UNION ALL ".join(f"SELECT 4 * l_suppkey + {i} AS id, list({c}::DOUBLE ORDER BY {LINES}) AS x FROM lineitem GROUP BY l_suppkey" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")))


def numbers(values) -> str:
    return "[" + ",".join(f"{float(v):.17e}" for v in np.asarray(values, float).ravel()) + "]"


def bank(name: str, values) -> str:
    """A table (r, wt) of the values in C order."""
    n = np.asarray(values).size
    return f"{name} AS (SELECT unnest(range({n}))::INT AS r, unnest({numbers(values)}) AS wt)"


def clean(inner: str, keys: str = "series_id", digits: int = 6) -> str:
    return f"SELECT {keys}, col::INT AS col, CASE WHEN round(val, {digits}) = 0 THEN 0.0 ELSE round(val, {digits}) END AS val FROM ({inner})"


def rows(source: str) -> str:
    return f"s AS ({source}), r AS (SELECT id, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS t FROM s)"


def znormed(source: str) -> str:
    return f"{rows(source)}, z AS (SELECT id, n, t, (v - avg(v) OVER p) / (stddev_pop(v) OVER p + {EPS}) AS v FROM r WINDOW p AS (PARTITION BY id))"


def windows(source: str) -> str:
    """CTEs up to win (id, w, start, t, v) and b, which adds centred values and differences."""
    return f"""{znormed(source)},
    e AS (SELECT id, n, t, v FROM z WHERE n >= 64 UNION ALL
      SELECT q.id, 64, i, a.v + (c.v - a.v) * (i * (q.n - 1) / 63e0 - a.t) FROM (SELECT DISTINCT id, n FROM z WHERE n BETWEEN 2 AND 63) q CROSS JOIN range(64) g(i)
        JOIN z a ON a.id = q.id AND a.t = least(floor(i * (q.n - 1) / 63e0), q.n - 2) JOIN z c ON c.id = q.id AND c.t = a.t + 1 UNION ALL
      SELECT id, 64, i, v FROM z CROSS JOIN range(64) g(i) WHERE n = 1),
    st AS (SELECT DISTINCT id, unnest(list_concat(range(0, n - 63, 16), [n - 64])) AS start FROM (SELECT DISTINCT id, n FROM e)),
    sw AS (SELECT id, start, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS w FROM st),
    win AS (SELECT e.id, sw.w::INT AS w, sw.start::INT AS start, (e.t - sw.start)::INT AS t, e.v FROM e JOIN sw ON e.id = sw.id AND e.t BETWEEN sw.start AND sw.start + 63),
    b0 AS (SELECT id, w, t, v, v - avg(v) OVER (PARTITION BY id, w) AS c FROM win),
    b AS (SELECT *, v - lag(v) OVER o AS d, v - 2 * lag(v) OVER o + lag(v, 2) OVER o AS dd, lag(v) OVER o AS v1, lag(v, 2) OVER o AS v2, lead(c) OVER o AS n1, lead(c, 2) OVER o AS n2,
      lag(c) OVER o AS c1, lag(c, 2) OVER o AS c2, lag(c, 3) OVER o AS c3 FROM b0 WINDOW o AS (PARTITION BY id, w ORDER BY t))"""


def _list(columns: list[str], source: str = "b", group: str = "GROUP BY id, w") -> str:
    return f"SELECT id, w, unnest(range({len(columns)})) AS col, unnest([{', '.join(columns)}]) AS val FROM {source} {group}"


STATS = f"""st12 AS (SELECT id, w, avg(v) AS m, greatest(stddev_samp(v), {EPS}) AS s, avg(c*c*c) AS m3, avg(c*c*c*c) AS m4, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3,
  sum(c * n1) / (sqrt(sum(c*c) FILTER (t < 63)) * sqrt(sum(c*c) FILTER (t > 0)) + {EPS}) AS ac, avg(abs(d)) AS ad, min(v) AS lo, max(v) AS hi FROM b GROUP BY id, w),
stats AS (SELECT id, w, unnest(range(12)) AS col, unnest([m, s, m3 / (s*s*s + {EPS}), m4 / (s*s*s*s + {EPS}) - 3, q1, q2, q3, q3 - q1, ac, ad, lo, hi]) AS val FROM st12)"""


def _conv(name: str, kernel: str, taps: int, dilation: int, source: str = "b", value: str = "v", size: int = 64, start: int = 0) -> str:
    """name(id, w, k, t, r): responses of the kernels in a bank, zero padded."""
    at = f"t - {start} - (kr.r % {taps} - {taps // 2}) * {dilation}"
    return f"{name} AS (SELECT id, w, kr.r // {taps} AS k, {at} AS t, sum({value} * wt) AS r FROM {source} JOIN {kernel} kr ON {at} BETWEEN 0 AND {size - 1} WHERE {value} IS NOT NULL GROUP BY ALL)"


_DFT = "f AS (SELECT id, w, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, -sum(v * sin(2 * pi() * k * t / 64)) AS im FROM b CROSS JOIN range({first}, 33) g(k) GROUP BY id, w, k)"


def family(name: str) -> tuple[str, str]:
    """(further CTEs, query for (id, w, col, val))."""
    banks = window_banks()
    crf = bank("kb", banks["crf_w"])
    near, far = _conv("near", "kb", 9, 2), _conv("far", "kb", 9, 4)
    both = f"{crf}, {near}, {far}, resp AS (SELECT *, 0 AS o FROM near UNION ALL SELECT *, 16 AS o FROM far)"
    updown = lambda x: f"ln((sum(greatest({x}, 0)**2) + 1e-6) / (sum(least({x}, 0)**2) + 1e-6))"
    if name == "stats":
        return STATS, "SELECT * FROM stats"
    if name == "srf_mlp":
        nets = f"{STATS}, {bank('bw', banks['srf_W'])}, {bank('bb', banks['srf_b'])}, {bank('bu', banks['srf_u'])}"
        hidden = "h AS (SELECT id, w, bw.r // 12 AS u, sum(val * wt) AS h FROM stats JOIN bw ON bw.r % 12 = col GROUP BY ALL)"
        return f"{nets}, {hidden}", "SELECT id, w, u // 6 AS col, sum(greatest(h + bb.wt, 0) * bu.wt) AS val FROM h JOIN bb ON bb.r = u JOIN bu ON bu.r = u GROUP BY ALL"
    if name == "autocorr":
        return "", _list([f"sum(c * n1) / (sum(c*c) FILTER (t < 63) + {EPS})", f"sum(c * n2) / (sum(c*c) FILTER (t < 62) + {EPS})"])
    if name == "spectral":
        share = f"p AS (SELECT id, w, k, sqrt(re*re + im*im) / (sum(sqrt(re*re + im*im)) OVER (PARTITION BY id, w) + {EPS}) AS p FROM f)"
        return f"{_DFT.format(first=1)}, {share}", _list(["sum((k - 1) * p)", "-sum(p * ln(p + 1e-12))"], "p")
    if name == "turning":
        return "", _list(["sum(CASE WHEN d * (v1 - v2) < 0 THEN 1 ELSE 0 END) / 62e0", "sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) / 63e0"])
    if name == "trf_gausswin":
        g = f"{bank('mu', banks['trf_mu'])}, {bank('sg', banks['trf_sig'])}, gw AS (SELECT mu.r AS k, t, exp(-((t / 64e0 - mu.wt)**2) / (2 * sg.wt**2 + {EPS})) AS g FROM mu JOIN sg USING (r) CROSS JOIN range(64) x(t)), gn AS (SELECT k, t, g / (sum(g) OVER (PARTITION BY k) + {EPS}) AS g FROM gw)"
        return g, "SELECT id, w, k AS col, sum(v * g) AS val FROM b JOIN gn USING (t) GROUP BY ALL"
    if name == "crf_ppv":
        return both, "SELECT id, w, k + o AS col, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / 64e0 AS val FROM resp GROUP BY ALL"
    if name == "crf_max":
        return both, "SELECT id, w, k + o AS col, max(r) AS val FROM resp GROUP BY ALL"
    if name == "conv_position":
        place = "pl AS (SELECT id, w, k, t / 64e0 AS p FROM near QUALIFY row_number() OVER (PARTITION BY id, w, k ORDER BY r DESC, t) = 1)"
        return f"{crf}, {near}, {place}", _list(["avg(p)", "stddev_samp(p)", "max(p) - min(p)"], "pl")
    if name == "hilbert_env":
        back = "a AS (SELECT id, w, t, sum(h * (re * cos(2*pi()*k*t/64) - im * sin(2*pi()*k*t/64))) / 64 AS re, sum(h * (re * sin(2*pi()*k*t/64) + im * cos(2*pi()*k*t/64))) / 64 AS im FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS h FROM f) CROSS JOIN range(64) x(t) GROUP BY id, w, t)"
        env = "e1 AS (SELECT id, w, t, sqrt(re*re + im*im) AS e FROM a), e2 AS (SELECT *, e - lag(e) OVER (PARTITION BY id, w ORDER BY t) AS de FROM e1)"
        return f"{_DFT.format(first=0)}, {back}, {env}", _list([f"stddev_samp(e) / (avg(e) + {EPS})", f"avg(abs(de)) / (avg(e) + {EPS})"], "e2")
    if name == "morphology_updown":
        return "", _list(["max(greatest(d, 0))", "max(greatest(-d, 0))", "ln((max(greatest(d, 0)) + 1e-6) / (max(greatest(-d, 0)) + 1e-6))", updown("d")])
    if name == "fftbands":
        share = f"p AS (SELECT id, w, k, (re*re + im*im) / (sum(re*re + im*im) OVER (PARTITION BY id, w) + {EPS}) AS p FROM f)"
        return f"{_DFT.format(first=1)}, {share}", "SELECT id, w, (k - 1) // 6 AS col, ln(greatest(sum(p), 1e-8)) AS val FROM p GROUP BY ALL"
    if name == "perm_entropy":
        code = "k AS (SELECT id, w, 4 * (v2 < v1)::INT + 2 * (v1 < v)::INT + (v2 < v)::INT AS k, count(*) / 62e0 AS h FROM b WHERE t >= 2 GROUP BY ALL), en AS (SELECT id, w, -sum(h * ln(h + 1e-12)) / ln(6) AS en FROM k GROUP BY id, w)"
        hj = f"hj AS (SELECT id, w, sqrt((var_samp(d) + {EPS}) / (var_samp(v) + {EPS})) AS mob, sqrt((var_samp(dd) + {EPS}) / (var_samp(d) + {EPS})) AS r FROM b GROUP BY id, w)"
        return f"{code}, {hj}", _list(["en", "mob", f"r / (mob + {EPS})"], "en JOIN hj USING (id, w)", "")
    if name == "curvature":
        return "", _list(["avg(abs(dd))", "max(abs(dd))", updown("dd")])
    if name == "ar_residual":
        two = "g2 AS (SELECT id, w, sum(c1*c1) + 1e-3 AS a, sum(c1*c2) AS b, sum(c2*c2) + 1e-3 AS e, sum(c*c1) AS y1, sum(c*c2) AS y2 FROM b WHERE t >= 2 GROUP BY id, w), s2 AS (SELECT id, w, (y1*e - y2*b) / (a*e - b*b) AS p1, (a*y2 - b*y1) / (a*e - b*b) AS p2 FROM g2)"
        three = "g3 AS (SELECT id, w, sum(c1*c1) + 1e-3 AS a, sum(c1*c2) AS b, sum(c1*c3) AS e, sum(c2*c2) + 1e-3 AS f, sum(c2*c3) AS g, sum(c3*c3) + 1e-3 AS h, sum(c*c1) AS y1, sum(c*c2) AS y2, sum(c*c3) AS y3 FROM b WHERE t >= 3 GROUP BY id, w)"
        three += ", d3 AS (SELECT *, a*(f*h - g*g) - b*(b*h - g*e) + e*(b*g - f*e) AS det FROM g3), s3 AS (SELECT id, w, (y1*(f*h - g*g) - b*(y2*h - g*y3) + e*(y2*g - f*y3)) / det AS p1, (a*(y2*h - g*y3) - y1*(b*h - g*e) + e*(b*y3 - y2*e)) / det AS p2, (a*(f*y3 - y2*g) - b*(b*y3 - y2*e) + y1*(b*g - f*e)) / det AS p3 FROM d3)"
        rest = f"r2 AS (SELECT id, w, ln(var_samp(c - p1*c1 - p2*c2) + {EPS}) AS v, ln(greatest(any_value(p1*p1 + p2*p2), {EPS})) AS n FROM b JOIN s2 USING (id, w) WHERE t >= 2 GROUP BY id, w), r3 AS (SELECT id, w, ln(var_samp(c - p1*c1 - p2*c2 - p3*c3) + {EPS}) AS v, ln(greatest(any_value(p1*p1 + p2*p2 + p3*p3), {EPS})) AS n FROM b JOIN s3 USING (id, w) WHERE t >= 3 GROUP BY id, w)"
        return f"{two}, {three}, {rest}", _list(["r2.v", "r2.n", "r3.v", "r3.n"], "r2 JOIN r3 USING (id, w)", "")
    if name == "acf_first_min":
        acf = f"a0 AS (SELECT x.id, x.w, y.t - x.t AS k, sum(x.c * y.c) AS s FROM b0 x JOIN b0 y ON x.id = y.id AND x.w = y.w AND y.t - x.t BETWEEN 1 AND 32 GROUP BY ALL), en AS (SELECT id, w, sum(c*c) + {EPS} AS en FROM b0 GROUP BY id, w), a1 AS (SELECT id, w, k, s / en AS a FROM a0 JOIN en USING (id, w)), a2 AS (SELECT *, lag(a) OVER o AS l, lead(a) OVER o AS h FROM a1 WINDOW o AS (PARTITION BY id, w ORDER BY k))"
        first = "fm AS (SELECT id, w, min(k) FILTER (l IS NOT NULL AND h IS NOT NULL AND a < l AND a <= h) AS km, coalesce(min(k) FILTER (a < 0), 1) - 1 AS kn FROM a2 GROUP BY id, w)"
        return f"{acf}, {first}", _list(["coalesce(km, 32) / 64e0", "kn / 64e0", "a"], "fm JOIN a1 USING (id, w) WHERE k = coalesce(km, 2)", "")
    if name == "histogram_mode":
        z = "zz AS (SELECT id, w, t, c / greatest(stddev_samp(v) OVER (PARTITION BY id, w), 1e-6) AS z FROM b), ms AS (SELECT id, w, -2.5e0 + i * 5e0 / 9 AS m, 4 * sum(exp(-0.5 * ((-2.5e0 + i * 5e0 / 9 - z) / (5e0 / 9))**2)) AS g FROM zz CROSS JOIN range(10) x(i) GROUP BY id, w, i), sm AS (SELECT id, w, m, exp(g - max(g) OVER (PARTITION BY id, w)) AS e FROM ms), mo AS (SELECT id, w, sum(e * m) / sum(e) AS mode FROM sm GROUP BY id, w), md AS (SELECT id, w, list_sort(list(z))[32] AS med, sum(CASE WHEN abs(z) < 0.5 THEN 1 ELSE 0 END) / 64e0 AS mid FROM zz GROUP BY id, w)"
        return z, _list(["mode", "mode - med", "mid"], "mo JOIN md USING (id, w)", "")
    if name == "ricker_wavelet":
        return f"{bank('rk', ricker_kernels())}, {_conv('rr', 'rk', 15, 1)}", "SELECT id, w, k AS col, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / 64e0 AS val FROM rr GROUP BY ALL"
    if name == "hydra_compete":
        parts, order = [bank("hk", banks["hydra_w"])], 0
        for value, size, start in (("v", 64, 0), ("d", 63, 1)):
            for dilation in (2, 4):
                parts.append(_conv(f"h{order}", "hk", 9, dilation, "b", value, size, start))
                order += 1
        every = " UNION ALL ".join(f"SELECT {o} AS o, * FROM h{o}" for o in range(order))
        won = "won AS (SELECT o, id, w, k // 4 AS g, k % 4 AS k, greatest(r, 0) AS r FROM al QUALIFY row_number() OVER (PARTITION BY o, id, w, k // 4, t ORDER BY r DESC, k) = 1), sh AS (SELECT o, id, w, g, k, sum(r) AS r FROM won GROUP BY ALL), grid AS (SELECT DISTINCT o, id, w, g, kk FROM won CROSS JOIN range(4) x(kk))"
        parts += [f"al AS ({every})", won, "ft AS (SELECT q.o, q.id, q.w, q.g, q.kk, coalesce(sh.r, 0) AS r FROM grid q LEFT JOIN sh ON sh.o = q.o AND sh.id = q.id AND sh.w = q.w AND sh.g = q.g AND sh.k = q.kk)"]
        return ", ".join(parts), "SELECT id, w, o * 8 + g * 4 + kk AS col, sqrt(r / (sum(r) OVER (PARTITION BY o, id, w, g) + 1e-8)) AS val FROM ft"
    raise KeyError(name)


def family_query(name: str, source: str) -> str:
    more, query = family(name)
    return f"WITH {windows(source)}{', ' + more if more else ''} " + clean(f"SELECT id AS series_id, w, col, val FROM ({query})", "series_id, w")


def pooled_query(name: str, source: str, operations: tuple[str, ...] = ("mean", "std", "max"), bag: str = "id") -> str:
    more, query = family(name)
    function = {"mean": "avg(val)", "std": "stddev_pop(val)", "max": "max(val)"}
    rows = " UNION ALL ".join(f"SELECT {bag} AS series_id, '{o}' AS op, col, {function[o]} AS val FROM ph GROUP BY ALL" for o in operations)
    return f"WITH {windows(source)}{', ' + more if more else ''}, ph AS ({query}) " + clean(rows, "series_id, op")


def embedding_query(source: str, bag: str = "id") -> str:
    """All 519 columns from the windows of every series: mean, std and max of each family."""
    parts, at, width = [], 0, sum(WIDTHS.values())
    for name, own in WIDTHS.items():
        more, inner = family(name)
        cols = ", ".join(f"{k * width + at} + col" for k in range(3))
        parts.append(f"SELECT {bag} AS series_id, unnest([{cols}]) AS col, unnest([avg(val), stddev_pop(val), max(val)]) AS val FROM (WITH _d AS (SELECT 1){', ' + more if more else ''} {inner}) GROUP BY {bag}, col")
        at += own
    return f"WITH {windows(source)} " + clean(" UNION ALL ".join(parts))


# battery, over columns of S1 scaled by mean and population std

BATTERY_BASE = f"""WITH {rows(S1)}, zs AS (SELECT id, t::INT AS t, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS z FROM r WINDOW p AS (PARTITION BY t)),
x AS (SELECT *, ((row_number() OVER (PARTITION BY id ORDER BY z, t) - 1) / 63e0 - 0.5) * sqrt(12e0) AS xr, sign(z) * sqrt(abs(z)) AS ssq, sign(z) * ln(1 + abs(z)) AS slg FROM zs)"""
_CHANNEL = {"z": "z", "ssq": "ssq", "slg": "slg", "ssqrank": "ssq * xr", "rank": "xr"}
_FUNCTION = {
    "tanh": "tanh(q)", "tanh_ssq": "tanh(q)", "tanh_slg": "tanh(q)", "tanh_ssqrank": "tanh(q)", "cos": "cos(q + ph.wt)", "cos_rank3": "cos(q / 3 + ph.wt)", "cos_w6041": "cos(q)", "cos_w6042": "cos(q / 3)",
    "relu_rank": "greatest(q, 0)", "sq_rank": "q * q", "relu_rank24": "greatest(q, 0)", "sigmoid_rank": "1 / (1 + exp(-8 * q))", "log1p": "ln(1 + abs(q))",
}


def battery_query(name: str, channel: str | None, bank_name: str | None) -> str:
    banks = battery_banks(64)
    if name == "rankhist":
        return f"{BATTERY_BASE} " + clean("SELECT id AS series_id, i AS col, avg(exp(-((xr - (-2 + i * 4e0 / 7))**2))) AS val FROM x CROSS JOIN range(8) g(i) GROUP BY ALL")
    if name == "rankquant":
        return f"{BATTERY_BASE} " + clean("SELECT id AS series_id, unnest(range(9)) AS col, unnest(quantile_cont(xr, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])) AS val FROM x GROUP BY id")
    weights = banks[bank_name]
    if name.startswith("landmark"):
        return f"{BATTERY_BASE}, {bank('bk', weights)} " + clean("SELECT id AS series_id, bk.r // 64 AS col, exp(-avg((z - wt)**2)) AS val FROM x JOIN bk ON bk.r % 64 = t GROUP BY ALL")
    wide = weights.shape[1]
    phase = {"cos": "b202", "cos_rank3": "b4012"}.get(name)
    product = f"pr AS (SELECT id, bk.r % {wide} AS col, sum(({_CHANNEL[channel]}) * wt) / 8 AS q FROM x JOIN bk ON bk.r // {wide} = t GROUP BY ALL)"
    extra = f", {bank('ph', banks[phase])}" if phase else ""
    join = "JOIN ph ON ph.r = col" if phase else ""
    return f"{BATTERY_BASE}, {bank('bk', weights)}{extra}, {product} " + clean(f"SELECT id AS series_id, col, {_FUNCTION[name]} AS val FROM pr {join}")


RANK_CHANNEL = f"{BATTERY_BASE} " + clean("SELECT id AS series_id, t AS col, xr AS val FROM x")


# four-space


def temporal_query(count: int = 12) -> str:
    return f"WITH {rows(S1)}, {bank('g', gaussian_windows(64, count))} " + clean("SELECT id AS series_id, g.r // 64 AS col, sum(v * wt) AS val FROM r JOIN g ON g.r % 64 = t GROUP BY ALL")


def fourier_query(projections: int = 2, dims: int = 16) -> str:
    banks = fourier_projections(64, projections, dims)
    ctes = ", ".join(f"{bank(f'w{i}', w)}, {bank(f'b{i}', b)}" for i, (w, b) in enumerate(banks))
    parts = " UNION ALL ".join(f"SELECT id, {i} AS p, cos(q + b{i}.wt) AS c FROM (SELECT id, w{i}.r % {dims} AS d, sum(v * wt) AS q FROM r JOIN w{i} ON w{i}.r // {dims} = t GROUP BY ALL) JOIN b{i} ON b{i}.r = d" for i in range(projections))
    return f"WITH {rows(S1)}, {ctes}, cs AS ({parts}) " + clean("SELECT id AS series_id, unnest([2 * p, 2 * p + 1]) AS col, unnest([avg(c), stddev_samp(c)]) AS val FROM cs GROUP BY id, p")


RAW_STATS = """rb AS (SELECT *, v - avg(v) OVER (PARTITION BY id) AS c, v - lag(v) OVER (PARTITION BY id ORDER BY t) AS d FROM r),
rn AS (SELECT *, lead(c) OVER (PARTITION BY id ORDER BY t) AS n1 FROM rb),
rs AS (SELECT id, n, avg(v) AS m, greatest(stddev_samp(v), 1e-12) AS s, avg(c*c*c) AS m3, avg(c*c*c*c) AS m4, list_sort(list(v)) AS o, sum(c * n1) / greatest(sqrt(sum(c*c) FILTER (t < n - 1)) * sqrt(sum(c*c) FILTER (t > 0)), 1e-12) AS ac, avg(abs(d)) AS ad FROM rn GROUP BY id, n),
st AS (SELECT id, unnest(range(12)) AS col, unnest([m, s, m3 / (s*s*s + 1e-12), m4 / (s*s*s*s + 1e-12) - 3, o[1 + n // 4], o[1 + n // 2], o[1 + 3 * n // 4], o[1 + 3 * n // 4] - o[1 + n // 4], ac, ad, o[1], o[n]]) AS val FROM rs)"""
STATISTICS_QUERY = f"WITH {rows(S1)}, {RAW_STATS} " + clean("SELECT id AS series_id, col, val FROM st")


def nets_query(count: int = 10) -> str:
    w, b, u = statistic_nets(count)
    return f"WITH {rows(S1)}, {RAW_STATS}, {bank('bw', w)}, {bank('bb', b)}, {bank('bu', u)}, h AS (SELECT id, bw.r // 12 AS u, sum(val * wt) AS h FROM st JOIN bw ON bw.r % 12 = col GROUP BY ALL) " + clean(
        "SELECT id AS series_id, u // 8 AS col, sum(greatest(h + bb.wt, 0) * bu.wt) AS val FROM h JOIN bb ON bb.r = u JOIN bu ON bu.r = u GROUP BY ALL"
    )


def kernel_query(pooling: str, transform: str = "identity", count: int = 6) -> str:
    weights, dilations = random_kernels(64, count)
    order = [k for d in np.unique(dilations) for k in np.flatnonzero(dilations == d)]
    source = {
        "identity": "y AS (SELECT id, t, v FROM r)",
        "diff": "y AS (SELECT id, t, coalesce(lead(v) OVER (PARTITION BY id ORDER BY t) - v, 0) AS v FROM r)",
        "hilbert": "f AS (SELECT id, k, sum(v * cos(2*pi()*k*t/64)) AS re, -sum(v * sin(2*pi()*k*t/64)) AS im FROM r CROSS JOIN range(33) g(k) GROUP BY id, k), y AS (SELECT id, t, sqrt(sum(h * (re * cos(2*pi()*k*t/64) - im * sin(2*pi()*k*t/64)))**2 + sum(h * (re * sin(2*pi()*k*t/64) + im * cos(2*pi()*k*t/64)))**2) / 64 AS v FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS h FROM f) CROSS JOIN range(64) x(t) GROUP BY id, t)",
    }[transform]
    dl = f"dl AS (SELECT unnest(range({count})) AS k, unnest({list(map(int, dilations))}) AS dil, unnest({[order.index(k) for k in range(count)]}) AS place)"
    at = "t - (kb.r % 9 - 4) * dil"
    conv = f"cv AS (SELECT id, place, k, dil, {at} AS t, sum(v * wt) AS r FROM y JOIN (kb JOIN dl ON dl.k = kb.r // 9) ON {at} BETWEEN 0 AND 63 GROUP BY ALL), cw AS (SELECT *, lag(r) OVER (PARTITION BY id, k ORDER BY t) AS pr FROM cv)"
    taps = "tp AS (SELECT k, sum(greatest(c, 1)) AS taps FROM (SELECT k, t, count(*) FILTER (t + (j - 4) * dil BETWEEN 0 AND 63) AS c FROM dl CROSS JOIN range(64) x(t) CROSS JOIN range(9) q(j) GROUP BY k, t) GROUP BY k), ps AS (SELECT r // 9 AS k, sum(greatest(wt, 0)) AS pos FROM kb GROUP BY ALL)"
    value = {
        "ppv": "sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / any_value(taps)::DOUBLE",
        "max": "max(r)",
        "mpv": "sum(greatest(r, 0)) / (any_value(pos) + 1e-8)",
        "mipv": "sum(CASE WHEN r > 0 THEN t ELSE 0 END) / greatest(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END), 1)::DOUBLE / 64",
        "zcr": "sum(CASE WHEN sign(r) * sign(pr) < 0 THEN 1 ELSE 0 END) / 64e0",
        "stretch": "max(CASE WHEN pr IS NULL THEN NULL ELSE (CASE WHEN r > 0 THEN t ELSE 0 END) - (CASE WHEN pr > 0 THEN t - 1 ELSE 0 END) END) / 64e0",
    }[pooling]
    return f"WITH {rows(S1)}, {bank('kb', weights)}, {source}, {dl}, {conv}, {taps} " + clean(f"SELECT id AS series_id, place AS col, least(greatest({value}, 1e-8), 1e6) AS val FROM cw JOIN tp USING (k) JOIN ps USING (k) GROUP BY id, place", digits=10 if pooling == "mipv" else 6)


def rocket_query(dilations: tuple[int, ...] = (1, 2)) -> str:
    parts = " UNION ALL ".join(f"SELECT id, {i} * 84 + kb.r // 9 AS col, t - (kb.r % 9 - 4) * {d} AS p, sum(v * wt) AS r FROM r JOIN kb ON t - (kb.r % 9 - 4) * {d} BETWEEN 0 AND 63 GROUP BY ALL" for i, d in enumerate(dilations))
    return f"WITH {rows(S1)}, {bank('kb', rocket_kernels())}, cv AS ({parts}) " + clean("SELECT id AS series_id, col, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / 64e0 AS val FROM cv GROUP BY ALL")


def fitted_rocket_query(features: int = 168) -> str:
    """The dictionary with one feature for each kernel and dilation, fitted on the training vectors in SQL."""
    dilations, share = dilations_for(64, features // 84)
    assert (share == 1).all()
    train = f"tr AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS place FROM s WHERE id % 5 <> 0 QUALIFY place < {84 * len(dilations)}), nt AS (SELECT count(*) AS nt FROM tr)"
    parts = " UNION ALL ".join(f"SELECT id, {j} AS j, {d} AS dil, kb.r // 9 AS k, t - (kb.r % 9 - 4) * {d} AS p, sum(v * wt) AS r FROM r JOIN kb ON t - (kb.r % 9 - 4) * {d} BETWEEN 0 AND 63 GROUP BY ALL" for j, d in enumerate(dilations))
    levels = f"lv AS (SELECT unnest(range({84 * len(dilations)})) AS f, unnest({numbers(golden(84 * len(dilations)))}) AS level)"
    bias = "sr AS (SELECT j, k, list_sort(list(r)) AS o FROM cv JOIN tr USING (id), nt WHERE tr.place = (k + 84 * j) % nt.nt GROUP BY j, k), bi AS (SELECT j, k, o[floor(63 * level)::INT + 1] + (o[least(floor(63 * level)::INT + 2, 64)] - o[floor(63 * level)::INT + 1]) * (63 * level - floor(63 * level)) AS bias FROM sr JOIN lv ON lv.f = j * 84 + k)"
    inner = "(k + j) % 2 = 0 OR 8 * dil >= 64 OR p BETWEEN 4 * dil AND 63 - 4 * dil"
    return f"WITH {rows(S1)}, {bank('kb', rocket_kernels())}, cv AS MATERIALIZED ({parts}), {train}, {levels}, {bias} " + clean(f"SELECT id AS series_id, j * 84 + k AS col, avg(CASE WHEN r > bias THEN 1e0 ELSE 0e0 END) AS val FROM cv JOIN bi USING (j, k) WHERE {inner} GROUP BY ALL")


def four_space_query(windows_: int = 200, projections: int = 5, dims: int = 256, nets: int = 200, kernels: int = 500, seed: int = 42) -> str:
    """The default transform as one table: windows, projections, nets, then the kernels of each dilation by pooling."""
    fp = fourier_projections(64, projections, dims, seed + 100)
    w, b, u = statistic_nets(nets, seed=seed + 200)
    weights, dilations = random_kernels(64, kernels, seed=seed + 300)
    place, at = {}, windows_ + 2 * projections + nets
    for d in np.unique(dilations):
        own = np.flatnonzero(dilations == d)
        for i, k in enumerate(own):
            place[int(k)] = (at + i, at + len(own) + i)
        at += 2 * len(own)
    ctes = ", ".join(f"{bank(f'w{i}', x)}, {bank(f'b{i}', y)}" for i, (x, y) in enumerate(fp))
    waves = " UNION ALL ".join(f"SELECT id, {i} AS p, cos(q + b{i}.wt) AS c FROM (SELECT id, w{i}.r % {dims} AS d, sum(v * wt) AS q FROM r JOIN w{i} ON w{i}.r // {dims} = t GROUP BY ALL) JOIN b{i} ON b{i}.r = d" for i in range(projections))
    shape = "t - (kb.r % 9 - 4) * dil"
    dl = f"dl AS (SELECT unnest(range({kernels})) AS k, unnest({[int(d) for d in dilations]}) AS dil, unnest({[place[k][0] for k in range(kernels)]}) AS c0, unnest({[place[k][1] for k in range(kernels)]}) AS c1)"
    taps = "tp AS (SELECT k, sum(greatest(c, 1)) AS taps FROM (SELECT k, t, count(*) FILTER (t + (j - 4) * dil BETWEEN 0 AND 63) AS c FROM dl CROSS JOIN range(64) x(t) CROSS JOIN range(9) q(j) GROUP BY k, t) GROUP BY k)"
    cv = f"cv AS (SELECT id, k, {shape} AS p, sum(v * wt) AS r FROM r JOIN (kb JOIN dl ON dl.k = kb.r // 9) ON {shape} BETWEEN 0 AND 63 GROUP BY ALL), kv AS (SELECT id, k, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS pos, max(r) AS top FROM cv GROUP BY id, k)"
    clamp = lambda x: f"least(greatest({x}, 1e-8), 1e6)"
    width = w.shape[1] if w.ndim == 3 else 8
    parts = [
        f"SELECT id, g.r // 64 AS col, sum(v * wt) AS val FROM r JOIN g ON g.r % 64 = t GROUP BY ALL",
        f"SELECT id, unnest([{windows_} + 2 * p, {windows_ + 1} + 2 * p]), unnest([avg(c), stddev_samp(c)]) FROM cs GROUP BY id, p",
        f"SELECT id, {windows_ + 2 * projections} + u // {width} AS col, sum(greatest(h + bb.wt, 0) * bu.wt) FROM h JOIN bb ON bb.r = u JOIN bu ON bu.r = u GROUP BY ALL",
        f"SELECT id, unnest([c0, c1]), unnest([{clamp('pos / taps::DOUBLE')}, {clamp('top')}]) FROM kv JOIN dl USING (k) JOIN tp USING (k)",
    ]
    return (
        f"WITH {rows(S1)}, {bank('g', gaussian_windows(64, windows_, seed))}, {ctes}, cs AS ({waves}), {RAW_STATS}, {bank('bw', w)}, {bank('bb', b)}, {bank('bu', u)}, h AS (SELECT id, bw.r // 12 AS u, sum(val * wt) AS h FROM st JOIN bw ON bw.r % 12 = col GROUP BY ALL), "
        f"{bank('kb', weights)}, {dl}, {taps}, {cv} " + clean("SELECT id AS series_id, col, val FROM (" + " UNION ALL ".join(parts) + ")")
    )


def erfc(x: str) -> str:
    """The complementary error function of a positive expression, by the series of erf without cancelling terms."""
    return f"1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln({x}) + 2 * k * ln(2e0) + lgamma(k + 1) - lgamma(2 * k + 2))))"
