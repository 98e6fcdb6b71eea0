"""SQL for the kernels over the derived 48 x 48 grid: convolutions as joins with weights, floods and least costs as
keyed recursion, thinning as recursion over a list of cells."""

from __future__ import annotations

import math

from cuesta.plans.compare import r
from cuesta.plans.rasters import D8, MASK

_SIDE = 48
#: Neighbours by row, then column: the order that breaks ties.
_STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
_RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _weights(sigma: float, degree: int = 0) -> str:
    radius = int(4 * sigma + 0.5)
    bell = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(bell)
    values = ", ".join(f"({k}, {(w / total if degree == 0 else k / sigma**2 * w / total)!r}::DOUBLE)" for k, w in zip(range(-radius, radius + 1), bell, strict=True))
    return f"(VALUES {values}) w(k, w)"


def _mirror(i: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {_SIDE} THEN {2 * _SIDE - 1} - ({i}) ELSE {i} END"


def smooth(source: str, columns: dict[str, str], rows: str, cols: str, name: str) -> str:
    """CTEs that end in name(r, c, columns): source's expressions convolved along rows' and columns' axes."""
    first = ", ".join(f"sum(w.w * ({e})) AS {n}" for n, e in columns.items())
    second = ", ".join(f"sum(w.w * q.{n}) AS {n}" for n in columns)
    return (
        f"{name}_0 AS (SELECT p.r, p.c, {first} FROM {source} p CROSS JOIN {rows} JOIN {source} q ON q.c = p.c AND q.r = {_mirror('p.r + w.k')} GROUP BY p.r, p.c),"
        f" {name} AS (SELECT p.r, p.c, {second} FROM {name}_0 p CROSS JOIN {cols} JOIN {name}_0 q ON q.r = p.r AND q.c = {_mirror('p.c + w.k')} GROUP BY p.r, p.c)"
    )


def nine(source: str, column: str, name: str) -> str:
    """CTEs that end in name: source with m1..m9 around each cell, edges repeated."""
    x = column
    across = f"{name}_0 AS (SELECT *, coalesce(lag({x}) OVER h, {x}) AS w_, coalesce(lead({x}) OVER h, {x}) AS e_ FROM {source} WINDOW h AS (PARTITION BY r ORDER BY c))"
    cells = ", ".join(f"coalesce({f}({y}) OVER v, {y}) AS m{k + i}" for f, k in (("lag", 1), ("lead", 7)) for i, y in enumerate(("w_", x, "e_")))
    return f"{across}, {name} AS (SELECT *, w_ AS m4, {x} AS m5, e_ AS m6, {cells} FROM {name}_0 WINDOW v AS (PARTITION BY c ORDER BY r))"


_BELL, _SLOPE, _WIDE = _weights(1.0), _weights(1.0, 1), _weights(3.0)


def _filled(source: str, band: str, name: str) -> str:
    return f"{name} AS (SELECT r, c, isfinite({band}) AS ok, CASE WHEN isfinite({band}) THEN {band} ELSE (SELECT quantile_cont({band}, 0.5) FROM {source} WHERE isfinite({band})) END AS z FROM {source})"


def gradient(source: str, band: str, name: str) -> str:
    """CTEs that end in name(r, c, ok, gx, gy)."""
    f = f"{name}_f"
    return f"{_filled(source, band, f)}, {smooth(f, {'g': 'q.z'}, _BELL, _SLOPE, name + '_x')}, {smooth(f, {'g': 'q.z'}, _SLOPE, _BELL, name + '_y')}, {name} AS (SELECT {f}.r, {f}.c, ok, {name}_x.g AS gx, {name}_y.g AS gy FROM {f} JOIN {name}_x USING (r, c) JOIN {name}_y USING (r, c))"


E1_GRADIENT = f"WITH {gradient('fx_dem', 'z', 'g')} SELECT r, c, {r('gx', 'gx')}, {r('gy', 'gy')} FROM g"

_TWO = "fx_two AS (SELECT r, c, z, CAST((r*7+c*3)%50 AS DOUBLE) AS other FROM fx_dem)"


def tensor(bands: list[tuple[str, str, float]]) -> str:
    """CTEs that end in t(r, c, ok, l1, l2, coherence): bands are (source, band, weight)."""
    parts = [gradient(s, b, f"g{i}") for i, (s, b, _) in enumerate(bands)]
    joined = "g0" + "".join(f" JOIN g{i} USING (r, c)" for i in range(1, len(bands)))
    sums = ", ".join(f"{'+'.join(f'{w}*g{i}.{a}*g{i}.{b}' for i, (_, _, w) in enumerate(bands))} AS {n}" for n, a, b in (("xx", "gx", "gx"), ("xy", "gx", "gy"), ("yy", "gy", "gy")))
    ok = " AND ".join(f"g{i}.ok" for i in range(len(bands)))
    return (
        ", ".join(parts)
        + f", p AS (SELECT r, c, {ok} AS ok, {sums} FROM {joined}), {smooth('p', {n: f'q.{n}' for n in ('xx', 'xy', 'yy')}, _WIDE, _WIDE, 's')},"
        + " e AS (SELECT r, c, p.ok, (s.xx+s.yy)/2 AS mean, sqrt(pow((s.xx-s.yy)/2, 2) + s.xy*s.xy) AS gap FROM s JOIN p USING (r, c)),"
        + " t AS (SELECT r, c, ok, CASE WHEN ok THEN mean+gap END AS l1, CASE WHEN ok THEN mean-gap END AS l2, CASE WHEN ok THEN 2*gap/(2*mean+1e-12) END AS coherence FROM e)"
    )


_ONE = tensor([("fx_dem", "z", 1.0)])
E5_TENSOR = f"WITH {_ONE} SELECT r, c, {r('l1', 'l1')}, {r('l2', 'l2')}, {r('coherence', 'coherence')} FROM t"
E8_RESPONSES = f"WITH {_ONE} SELECT r, c, {r('l1-l2', 'anisotropy')}, {r('(l1-l2)/(l1+l2+1e-12)', 'coherence')}, {r('l1', 'lambda1')} FROM t"
E9_LINEAR = f"WITH {_TWO}, {tensor([('fx_two', 'z', 2.0), ('fx_two', 'other', 1.0)])} SELECT r, c, {r('l1-l2', 'response')} FROM t"
L6_INCOHERENCE = f"WITH {_ONE} SELECT r, c, {r('CASE WHEN ok THEN greatest(least(1-coherence, 1), 0) ELSE 1 END', 'incoherence')} FROM t"


def _sample(sign: str) -> str:
    x, y = f"(gx {sign} 0)", f"(gy {sign} 0)"
    side = f"CASE WHEN {x} THEN m6 ELSE m4 END"
    along = f"CASE WHEN {y} THEN m8 ELSE m2 END"
    corner = f"CASE WHEN {y} THEN CASE WHEN {x} THEN m9 ELSE m7 END ELSE CASE WHEN {x} THEN m3 ELSE m1 END END"
    return f"((1-a)*((1-b)*m5+b*({side}))+a*((1-b)*({along})+b*({corner})))"


def suppressed(source: str) -> str:
    """CTEs that end in nms(..., nms) of source(r, c, gx, gy, m)."""
    return f"{nine(source, 'm', 'w')}, u AS (SELECT *, abs(gy/(m5+1e-12)) AS a, abs(gx/(m5+1e-12)) AS b FROM w), nms AS (SELECT *, CASE WHEN m5 > 0 AND m5 >= {_sample('>')} AND m5 >= {_sample('<')} THEN m5 ELSE 0 END AS nms FROM u)"


E2_SUPPRESSED = (
    f"WITH {nine('fx_dem', 'z', 'z9')}, g0 AS (SELECT r, c, ((m3+2*m6+m9)-(m1+2*m4+m7))/8 AS gx, ((m7+2*m8+m9)-(m1+2*m2+m3))/8 AS gy, isfinite(m5) AS ok FROM z9),"
    f" g AS (SELECT r, c, gx, gy, CASE WHEN ok AND isfinite(sqrt(gx*gx+gy*gy)) THEN sqrt(gx*gx+gy*gy) ELSE 0 END AS m FROM g0), {suppressed('g')} SELECT r, c, {r('nms', 'nms')} FROM nms"
)
E4_CANNY = (
    f"WITH RECURSIVE {gradient('fx_dem', 'z', 'g1')}, g AS (SELECT r, c, gx, gy, ok, CASE WHEN ok THEN sqrt(gx*gx+gy*gy) ELSE 0 END AS m FROM g1), {suppressed('g')},"
    " q AS (SELECT quantile_cont(m, 0.85) AS lo, quantile_cont(m, 0.95) AS hi FROM g WHERE ok),"
    " k AS (SELECT r*48+c AS v, r, c, nms >= hi AS strong FROM nms, q WHERE ok AND nms > 0 AND nms >= lo),"
    " x(v) AS (SELECT v FROM k WHERE strong UNION SELECT b.v FROM x JOIN k a ON a.v = x.v JOIN k b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1)"
    " SELECT CAST(v//48 AS INTEGER) AS r, CAST(v%48 AS INTEGER) AS c FROM x"
)


def flood(source: str, name: str) -> str:
    """CTEs that end in name(r, c, z): source(r, c, z) raised, from the shores inwards."""
    up = "greatest(b.z, l.z + 1e-4)"
    return (
        f"{name}_f AS (SELECT r, c, z FROM {source} WHERE isfinite(z)), {name}_l(r, c, z) USING KEY (r, c) AS ("
        f"SELECT a.r, a.c, a.z FROM {name}_f a WHERE (SELECT count(*) FROM {name}_f b WHERE abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1) < 9"
        f" UNION SELECT b.r, b.c, min({up}) FROM {name}_l l JOIN {name}_f b ON b.r BETWEEN l.r-1 AND l.r+1 AND b.c BETWEEN l.c-1 AND l.c+1 LEFT JOIN recurring.{name}_l k ON k.r = b.r AND k.c = b.c GROUP BY b.r, b.c, k.z HAVING k.z IS NULL OR min({up}) < k.z),"
        f" {name} AS (SELECT p.r, p.c, coalesce(l.z, p.z) AS z FROM {source} p LEFT JOIN {name}_l l ON l.r = p.r AND l.c = p.c)"
    )


H4_FILLED = f"WITH RECURSIVE {flood('fx_dem', 'x')} SELECT r, c, {r('z', 'z')} FROM x"


def network(source: str) -> str:
    """CTEs that end in net(r, c, accumulation, azimuth) of source(r, c, z)."""
    d8 = D8.replace("fx_dem", source)
    azimuth = "((degrees(atan2(d8.dc, -d8.dr)) % 360) + 360) % 360"
    return (
        f"{d8}, w(r, c) AS (SELECT r, c FROM {source} WHERE isfinite(z) UNION ALL SELECT w.r + d8.dr, w.c + d8.dc FROM w JOIN d8 ON d8.r = w.r AND d8.c = w.c),"
        f" n AS (SELECT r, c, count(*) AS n FROM w GROUP BY r, c), net AS (SELECT p.r, p.c, coalesce(n.n, 0) AS accumulation, {azimuth} AS azimuth FROM {source} p LEFT JOIN n USING (r, c) LEFT JOIN d8 ON d8.r = p.r AND d8.c = p.c)"
    )


H5_NETWORK = (
    "WITH RECURSIVE blocks AS (SELECT CAST(r//3 AS INTEGER) AS r, CAST(c//3 AS INTEGER) AS c, avg(z) FILTER (isfinite(z)) AS z FROM fx_dem GROUP BY 1, 2), "
    f"{flood('blocks', 'x')}, {network('x')} SELECT p.r, p.c, accumulation, {r('azimuth', 'azimuth')} FROM fx_dem p JOIN net ON net.r = p.r//3 AND net.c = p.c//3"
)
H6_CHANNELS = f"WITH RECURSIVE {flood('fx_dem', 'x')}, {network('x')} SELECT r, c, accumulation, {r('azimuth', 'azimuth')} FROM net WHERE accumulation >= 20"
H13_DENSITY = f"WITH RECURSIVE {network('fx_dem')} SELECT {r('quantile_cont(accumulation, 0.85)', 'least')} FROM net WHERE accumulation > 0"
Q18_DENSITIES = (
    f"WITH RECURSIVE {network('fx_dem')}, t AS (SELECT least, count(*) FILTER (accumulation >= least) AS channels, count(*) AS n FROM net, (VALUES (30), (15), (8), (4)) v(least) WHERE accumulation > 0 GROUP BY least)"
    f" SELECT least, channels, {r('channels/n', 'density')}, channels - coalesce(lag(channels) OVER (ORDER BY least DESC), 0) AS gained FROM t"
)


def least_cost(costs: str, seed: tuple[int, int]) -> str:
    """CTEs that end in far(r, c, d) of costs(r, c, cost) from the seed; cells out of reach are absent."""
    step = "l.d + (a.cost + b.cost) / 2 * CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END"
    return (
        f"far(r, c, d) USING KEY (r, c) AS (SELECT r, c, CAST(0 AS DOUBLE) FROM {costs} WHERE r = {seed[0]} AND c = {seed[1]}"
        f" UNION SELECT b.r, b.c, min({step}) FROM far l JOIN {costs} a ON a.r = l.r AND a.c = l.c JOIN {costs} b ON b.r BETWEEN l.r-1 AND l.r+1 AND b.c BETWEEN l.c-1 AND l.c+1 AND (b.r <> l.r OR b.c <> l.c) AND isfinite(b.cost)"
        f" LEFT JOIN recurring.far k ON k.r = b.r AND k.c = b.c GROUP BY b.r, b.c, k.d HAVING k.d IS NULL OR min({step}) < k.d)"
    )


_STRETCHED = "costs AS MATERIALIZED (SELECT r, c, 0.1 + least(greatest((CASE WHEN isfinite(z) THEN z ELSE 0 END - lo) / greatest(hi - lo, 1e-6), 0), 1) AS cost FROM fx_dem, (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM fx_dem WHERE isfinite(z)))"
L11_LEAST_COST = f"WITH RECURSIVE {_STRETCHED}, {least_cost('costs', (24, 24))} SELECT r, c, {r('d', 'distance')} FROM fx_dem LEFT JOIN far USING (r, c)"


def surface(cost_sql: str) -> str:
    """The cost query's text as CTEs that end in surface(r, c, cost), unrounded."""
    head, _, body = cost_sql.partition(" SELECT r, c, (CASE WHEN isfinite(CAST(")
    return f"{head.removeprefix('WITH ')}, surface AS (SELECT r, c, {body.partition(' AS DOUBLE)) THEN')[0]} AS cost FROM p, q)"


def windowed(cost_sql: str) -> str:
    near = "costs AS MATERIALIZED (SELECT * FROM surface WHERE abs(r - 24) <= 2 AND abs(c - 24) <= 2)"
    return f"WITH RECURSIVE {surface(cost_sql)}, {near}, {least_cost('costs', (24, 24))} SELECT r, c, {r('d', 'distance')} FROM costs LEFT JOIN far USING (r, c)"


def path(cost_sql: str) -> str:
    box = "costs AS MATERIALIZED (SELECT * FROM surface WHERE r BETWEEN -3 AND 48 AND c BETWEEN -3 AND 50)"
    order = " ".join(f"WHEN a.r - b.r = {i} AND a.c - b.c = {j} THEN {n}" for n, (i, j) in enumerate(_STEPS))
    back = f"back AS MATERIALIZED (SELECT b.r, b.c, a.r AS ar, a.c AS ac FROM far l JOIN costs a ON a.r = l.r AND a.c = l.c JOIN costs b ON b.r BETWEEN l.r-1 AND l.r+1 AND b.c BETWEEN l.c-1 AND l.c+1 AND (b.r <> l.r OR b.c <> l.c) WHERE NOT (b.r = 5 AND b.c = 5) QUALIFY row_number() OVER (PARTITION BY b.r, b.c ORDER BY l.d + (a.cost + b.cost) / 2 * CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1 END, CASE {order} END) = 1)"
    walk = "way(k, r, c) AS (SELECT 0, 40, 42 UNION ALL SELECT k + 1, ar, ac FROM way JOIN back USING (r, c))"
    return f"WITH RECURSIVE {surface(cost_sql)}, {box}, {least_cost('costs', (5, 5))}, {back}, {walk} SELECT max(k) OVER () - k AS seq, r, c FROM way"


def thin(name: str) -> str:
    """CTEs that end in name(r, c): the mask's skeleton; the list of cells goes through passes until two change nothing."""

    def goes(first: bool) -> str:
        q = [f"CAST(list_contains(img, x + ({64 * i + j})) AS INTEGER)" for i, j in _RING]
        n = "+".join(q)
        rises = "+".join(f"(1 - {q[k]}) * {q[(k + 1) % 8]}" for k in range(8))
        a, b = ((0, 2, 4), (2, 4, 6)) if first else ((0, 2, 6), (0, 4, 6))
        return f"({n}) BETWEEN 2 AND 6 AND ({rises}) = 1 AND {'*'.join(q[k] for k in a)} = 0 AND {'*'.join(q[k] for k in b)} = 0"

    step = f"CASE WHEN i % 2 = 0 THEN list_filter(img, lambda x: NOT ({goes(True)})) ELSE list_filter(img, lambda x: NOT ({goes(False)})) END"
    return (
        f"{MASK}, {name}_t(i, img, size) AS (SELECT 0, list(64 * (r + 1) + c + 1), [1000000, 1000000] FROM m"
        f" UNION ALL SELECT i + 1, nxt, [len(nxt), size[1]] FROM (SELECT i, size, {step} AS nxt FROM {name}_t WHERE i < 2 OR size[1] < size[2] OR i % 2 = 1 OR size[2] > len(img))),"
        f" {name} AS (SELECT CAST(v // 64 - 1 AS INTEGER) AS r, CAST(v % 64 - 1 AS INTEGER) AS c FROM (SELECT unnest(img) AS v FROM {name}_t WHERE i = (SELECT max(i) FROM {name}_t)))"
    )


C4_THINNING = f"WITH RECURSIVE {thin('s')} SELECT r, c FROM s"
C6_CHAINS = (
    f"WITH RECURSIVE {thin('s')}, k AS (SELECT r*48+c AS v, r, c FROM s), e AS (SELECT a.v AS u, b.v FROM k a JOIN k b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND a.v <> b.v), d AS (SELECT u AS v, count(*) AS n FROM e GROUP BY u),"
    " w(chain, seq, u, v) AS (SELECT [e.u, e.v], 1, e.u, e.v FROM e JOIN d ON d.v = e.u WHERE d.n <> 2 UNION ALL SELECT chain, seq + 1, w.v, e.v FROM w JOIN d ON d.v = w.v AND d.n = 2 JOIN e ON e.u = w.v AND e.v <> w.u),"
    " ends AS (SELECT chain, arg_max([v, u], seq) AS last FROM w GROUP BY chain),"
    " o AS (SELECT w.* FROM w JOIN ends USING (chain) WHERE chain < last),"
    " x(start, v) AS (SELECT v, v FROM d WHERE n = 2 AND v NOT IN (SELECT v FROM w UNION SELECT u FROM w) UNION SELECT start, e.v FROM x JOIN e ON e.u = x.v),"
    " least AS (SELECT min(v) AS m FROM x GROUP BY start),"
    " z(chain, seq, u, v) AS (SELECT [m, min(e.v)], 1, m, min(e.v) FROM (SELECT DISTINCT m FROM least) JOIN e ON e.u = m GROUP BY m UNION ALL SELECT chain, seq + 1, z.v, e.v FROM z JOIN e ON e.u = z.v AND e.v <> z.u WHERE z.v <> z.chain[1] OR seq = 1),"
    " every AS (SELECT * FROM o UNION ALL SELECT * FROM z), points AS (SELECT chain, seq, v FROM every UNION ALL SELECT chain, 0, chain[1] FROM (SELECT DISTINCT chain FROM every))"
    " SELECT 'g0:' || chain[1]//48 || ':' || chain[1]%48 || '/' || chain[2]//48 || ':' || chain[2]%48 AS chain, CAST(seq AS INTEGER) AS seq, CAST(v//48 AS INTEGER) AS r, CAST(v%48 AS INTEGER) AS c, count(*) OVER (PARTITION BY chain) AS n FROM points"
)
A5_SIMPLIFIED = (
    "WITH RECURSIVE ends AS (SELECT trace_id, min(seq) AS a, max(seq) AS b FROM fx_vert GROUP BY trace_id), iv(trace_id, a, b) AS (SELECT * FROM ends UNION ALL SELECT trace_id, unnest([a, CAST(-best.s AS INTEGER)]), unnest([CAST(-best.s AS INTEGER), b]) FROM ("
    "SELECT i.trace_id, i.a, i.b, max({'g': CASE WHEN q.x = p.x AND q.y = p.y THEN sqrt(pow(v.x-p.x, 2) + pow(v.y-p.y, 2)) ELSE abs((q.x-p.x)*(v.y-p.y) - (q.y-p.y)*(v.x-p.x)) / sqrt(pow(q.x-p.x, 2) + pow(q.y-p.y, 2)) END, 's': -v.seq}) AS best"
    " FROM iv i JOIN fx_vert p ON p.trace_id = i.trace_id AND p.seq = i.a JOIN fx_vert q ON q.trace_id = i.trace_id AND q.seq = i.b JOIN fx_vert v ON v.trace_id = i.trace_id AND v.seq > i.a AND v.seq < i.b GROUP BY i.trace_id, i.a, i.b) WHERE best.g > 50)"
    f" SELECT trace_id, seq, {r('x', 'x')}, {r('y', 'y')} FROM fx_vert JOIN (SELECT trace_id, a AS seq FROM iv UNION SELECT trace_id, b FROM iv) USING (trace_id, seq)"
)
X7_GREAT_CIRCLES = (
    "WITH p AS (SELECT id, k, radians(k) AS t, radians(strike) AS s, radians(dip) AS d FROM fx_att, range(0, 181) g(k)),"
    " v AS (SELECT id, k, cos(t)*sin(s)+sin(t)*cos(d)*cos(s) AS x, cos(t)*cos(s)-sin(t)*cos(d)*sin(s) AS y, -sin(t)*sin(d) AS z FROM p)"
    f" SELECT id, CAST(k AS INTEGER) AS k, {r('x/sqrt(1-z)', 'u')}, {r('y/sqrt(1-z)', 'v')} FROM v"
)


def eigen(source: str, vectors: dict[str, str]) -> str:
    """CTEs that end in v: source(..., xx, yy, zz, xy, xz, yz) with s1 >= s2 >= s3 and a unit vector <n>x, <n>y, <n>z for
    each name and eigenvalue in ``vectors``: the roots by the cosine formula, a vector as the longest cross product of rows."""
    out = (
        f"e0 AS (SELECT *, (xx+yy+zz)/3 AS q FROM {source}), e1 AS (SELECT *, sqrt((pow(xx-q, 2)+pow(yy-q, 2)+pow(zz-q, 2)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM e0),"
        " e2 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(p*p*p)/2)))/3 ELSE 0 END AS f FROM e1),"
        " e3 AS (SELECT *, q+2*p*cos(f) AS s1, q+2*p*cos(f+2*pi()/3) AS s3, 3*q-(q+2*p*cos(f))-(q+2*p*cos(f+2*pi()/3)) AS s2 FROM e2)"
    )
    last = "e3"
    for n, s in vectors.items():
        a, b, c = (f"xx-{s}", "xy", "xz"), ("xy", f"yy-{s}", "yz"), ("xz", "yz", f"zz-{s}")
        crosses = []
        for i, (u, w) in enumerate(((a, b), (a, c), (b, c))):
            x, y, z = (f"(({u[j]})*({w[k]})-({u[k]})*({w[j]}))" for j, k in ((1, 2), (2, 0), (0, 1)))
            crosses.append(f"{{'d': {x}*{x}+{y}*{y}+{z}*{z}, 'i': {-i}, 'x': {x}, 'y': {y}, 'z': {z}}}")
        out += f", {n}0 AS (SELECT *, list_max([{', '.join(crosses)}]) AS {n} FROM {last}), {n}1 AS (SELECT *, {n}.x/sqrt({n}.d) AS {n}x, {n}.y/sqrt({n}.d) AS {n}y, {n}.z/sqrt({n}.d) AS {n}z FROM {n}0)"
        last = f"{n}1"
    return f"{out}, v AS (SELECT * FROM {last})"


def line(n: str) -> tuple[str, str]:
    """(trend, plunge) of the vector's line, turned down."""
    up = f"CASE WHEN {n}z > 0 THEN -1 ELSE 1 END"
    return f"((degrees(atan2({up}*{n}x, {up}*{n}y)) % 360) + 360) % 360", f"degrees(asin(least(1, greatest(-1, -({up}*{n}z)))))"


_SHAPE = ("(ln(greatest(s1, 1e-12))-ln(greatest(s2, 1e-12)))/(ln(greatest(s2, 1e-12))-ln(greatest(s3, 1e-12)))", "ln(greatest(s1, 1e-12))-ln(greatest(s3, 1e-12))")
_TENSOR = "count(*) AS n, " + ", ".join(f"avg({a}*{b}) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))


def fabrics(units: str) -> str:
    """units: CTEs that end in v(label, x, y, z)."""
    body = eigen("t", {"g": "s1", "h": "s3"}).replace(", v AS (", ", w AS (")
    return f"WITH {units}, t AS (SELECT label, {_TENSOR} FROM v GROUP BY label), {body} SELECT label, n, {r('s1', 's1', 4)}, {r('s2', 's2', 4)}, {r('s3', 's3', 4)}, {r(_SHAPE[0], 'k', 4)}, {r(_SHAPE[1], 'c', 4)}, {r(line('g')[0], 'trend1', 4)}, {r(line('g')[1], 'plunge1', 4)}, {r(line('h')[0], 'trend3', 4)}, {r(line('h')[1], 'plunge3', 4)} FROM w"


def axial(units: str) -> str:
    body = eigen("t", {"a": "s1"}).replace(", v AS (", ", w AS (")
    return f"WITH {units}, t AS (SELECT label, {_TENSOR} FROM v GROUP BY label), {body} SELECT label, {r(line('a')[0], 'trend', 4)}, {r(line('a')[1], 'plunge', 4)}, {r('s1', 'concentration', 4)} FROM w"


def fold_axes(where: str = "true", places: int = 4) -> str:
    poles = f"o AS (SELECT region, cos(radians(90-dip))*sin(radians(strike-90)) AS x, cos(radians(90-dip))*cos(radians(strike-90)) AS y, -sin(radians(90-dip)) AS z FROM fx_att WHERE {where})"
    body = eigen("t", {"a": "s3"})
    fabric = f"CASE WHEN {_SHAPE[1]} < 0.3 THEN 'weak' WHEN {_SHAPE[0]} < 1 THEN 'girdle' ELSE 'cluster' END"
    return f"WITH {poles}, t AS (SELECT region, {_TENSOR} FROM o GROUP BY region), {body} SELECT region, n, {r(line('a')[0], 'trend', places)}, {r(line('a')[1], 'plunge', places)}, {r(_SHAPE[0], 'k', places)}, {r(_SHAPE[1], 'c', places)}, {fabric} AS fabric FROM v"


def planes(sampled: str) -> str:
    """Strike, dip and the quality of the fits of samples v(trace_id, x, y, z) that the CTEs end in."""
    body = eigen("t", {"a": "s3"}).replace(", v AS (", ", w AS (")
    sums = ", ".join(f"sum((v.{a}-m.{a})*(v.{b}-m.{b})) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))
    up = "CASE WHEN az < 0 THEN -1 ELSE 1 END"
    way = f"((degrees(atan2({up}*ax, {up}*ay)) % 360) + 360) % 360"
    return (
        f"WITH {sampled}, m AS (SELECT trace_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v GROUP BY trace_id HAVING count(*) >= 8), t AS (SELECT trace_id, count(*) AS n, {sums} FROM v JOIN m USING (trace_id) GROUP BY trace_id), {body}"
        f" SELECT trace_id, n AS n_samples, {r(f'((({way}) - 90) % 360 + 360) % 360', 'strike', 3)}, {r('degrees(acos(least(1, abs(az))))', 'dip', 4)}, {r(way, 'dip_direction', 3)}, {r('s2/s1', 'conditioning', 5)}, {r('greatest(s3, 0)/s2', 'planarity', 5)}, {r('sqrt(greatest(s3, 0)/n)', 'residual_rms', 4)} FROM w"
    )
