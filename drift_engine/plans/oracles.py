"""DuckDB text for the queries, written another way than the Spark plans: ASOF joins, list functions, self joins."""

from __future__ import annotations

OBS = """obs AS (SELECT CAST(user_id AS VARCHAR) AS trajectory, epoch_us(ts) / 1e6 AS t, CAST(value AS DOUBLE) AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events)"""
TRACKS = OBS + """, counted AS (SELECT *, count(*) OVER (PARTITION BY trajectory) AS n_obs, min(t) OVER (PARTITION BY trajectory) AS t0 FROM obs),
tracks AS (SELECT trajectory, t - t0 AS t, x, y FROM counted WHERE n_obs >= 2)"""
TARGETS = """targets AS (SELECT trajectory, unnest(range(0, CAST(floor(max(t) / 86400.0 + 1e-12) AS BIGINT) + 1)) AS k, CAST(floor(max(t) / 86400.0 + 1e-12) AS BIGINT) AS n FROM tracks GROUP BY trajectory)"""
POINTS = TRACKS + ", " + TARGETS + """, before AS (SELECT g.trajectory, g.k, g.n, g.k * 86400.0 AS tt, p.t AS pt, p.x AS px, p.y AS py FROM targets g ASOF LEFT JOIN tracks p ON g.trajectory = p.trajectory AND g.k * 86400.0 >= p.t),
around AS (SELECT b.*, q.t AS qt, q.x AS qx, q.y AS qy FROM before b ASOF LEFT JOIN tracks q ON b.trajectory = q.trajectory AND b.tt < q.t),
points AS (SELECT trajectory, k, n, tt, qt - pt AS width, CASE WHEN abs(tt - pt) <= 1e-9 THEN 'exact' WHEN qt IS NULL THEN 'missing' ELSE 'interpolated' END AS status,
 CASE WHEN abs(tt - pt) <= 1e-9 THEN px ELSE px + (tt - pt) / (qt - pt) * (qx - px) END AS x,
 CASE WHEN abs(tt - pt) <= 1e-9 THEN py ELSE py + (tt - pt) / (qt - pt) * (qy - py) END AS y FROM around),
segs AS (SELECT a.trajectory, a.k, a.status AS s_status, a.width AS s_width, a.x AS sx, a.y AS sy, b.status AS e_status, b.width AS e_width, b.x AS ex, b.y AS ey FROM points a JOIN points b ON a.trajectory = b.trajectory AND b.k = a.k + 1)"""


def _bins(x: str, y: str, sx: str = "start", sel: str = "") -> str:
    return f"CAST(floor({x} / 10.0) AS BIGINT) AS {sx}_x_bin, CAST(floor({y} / 10.0) AS BIGINT) AS {sx}_y_bin"


INSIDE = "sx >= 0 AND sx < 120 AND sy >= 0 AND sy < 100 AND ex >= 0 AND ex < 120 AND ey >= 0 AND ey < 100"


def _links(segs: str = "segs", where: str = "TRUE") -> str:
    return f"""raw_links AS (SELECT {_bins('sx', 'sy', 'start')}, {_bins('ex', 'ey', 'end')} FROM {segs} WHERE {INSIDE} AND {where}),
links AS (SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, count(*) AS n, start_y_bin * 12 + start_x_bin AS sid, end_y_bin * 12 + end_x_bin AS eid,
 10.0 * (end_x_bin - start_x_bin) AS dx, 10.0 * (end_y_bin - start_y_bin) AS dy FROM raw_links GROUP BY ALL)"""


LINKS = POINTS + ", " + _links()
MOVES = LINKS + """, moves AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, n * 1.0 / (SELECT sum(n) FROM links o WHERE o.sid = l.sid AND o.sid <> o.eid) AS p, n * 1.0 / (SELECT sum(n) FROM links o WHERE o.eid = l.eid AND o.sid <> o.eid) AS q FROM links l WHERE sid <> eid),
cells AS (SELECT DISTINCT unnest([sid, eid]) AS cell_id FROM links)"""
BEARING = "CASE WHEN sqrt({x}*{x}+{y}*{y}) > 1e-12 THEN (degrees(atan2({x}, {y})) + 360) - 360 * floor((degrees(atan2({x}, {y})) + 360) / 360) END"


def bearing(x: str, y: str) -> str:
    return BEARING.format(x=f"({x})", y=f"({y})")


def apart(a: str, b: str) -> str:
    return f"abs(({a}) - ({b}) + 180 - 360 * floor((({a}) - ({b}) + 180) / 360) - 180)"


OUT = MOVES + f""", outgoing AS (SELECT sid AS cell_id, sum(p * dx / d) AS s1, sum(p * dy / d) AS c1, sum(p * 2 * dx * dy / (d * d)) AS s2, sum(p * (dy * dy - dx * dx) / (d * d)) AS c2,
 sum(p * dx) AS mx, sum(p * dy) AS my, sum(p * d) AS dm, sum(p * d * d) AS d2, max(d) AS dmax, max(p * d) AS lever FROM moves GROUP BY sid),
incoming AS (SELECT eid AS cell_id, sum(q * dx / d) AS s1, sum(q * dy / d) AS c1, sum(q * 2 * dx * dy / (d * d)) AS s2, sum(q * (dy * dy - dx * dx) / (d * d)) AS c2, sum(q * dx) AS mx, sum(q * dy) AS my, sum(q * d) AS dm, max(d) AS dmax FROM moves GROUP BY eid),
counts AS (SELECT c.cell_id, coalesce((SELECT sum(n) FROM links WHERE sid = c.cell_id), 0) AS n_out, coalesce((SELECT sum(n) FROM links WHERE sid = c.cell_id AND sid <> eid), 0) AS n_move,
 coalesce((SELECT sum(n) FROM links WHERE eid = c.cell_id), 0) AS n_in, coalesce((SELECT sum(n) FROM links WHERE eid = c.cell_id AND sid <> eid), 0) AS n_in_move,
 (SELECT count(*) FROM links WHERE sid = c.cell_id AND sid <> eid) AS n_dest, (SELECT count(*) FROM links WHERE eid = c.cell_id AND sid <> eid) AS n_src FROM cells c)"""


def text(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"




ORACLES: dict[str, str] = {}

R = "round({0}, 6) AS {1}"


def r6(**columns: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in columns.items())


ORACLES["mat_links_nonoverlap"] = text(LINKS, "SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, n AS transition_count, " + r6(start_x_center="(start_x_bin + 0.5) * 10.0", transition_probability="n * 1.0 / sum(n) OVER (PARTITION BY sid)") + " FROM links")
_EVERY = (
    TRACKS
    + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY t) AS i, count(*) OVER (PARTITION BY trajectory) AS m FROM tracks),
froms AS (SELECT trajectory, x AS sx, y AS sy, t + 86400.0 AS tt FROM ordered WHERE i < m),
low AS (SELECT f.*, p.t AS pt, p.x AS px, p.y AS py FROM froms f ASOF LEFT JOIN tracks p ON f.trajectory = p.trajectory AND f.tt >= p.t),
high AS (SELECT l.*, q.t AS qt, q.x AS qx, q.y AS qy FROM low l ASOF LEFT JOIN tracks q ON l.trajectory = q.trajectory AND l.tt < q.t),
segs AS (SELECT *, px + (tt - pt) / (qt - pt) * (qx - px) AS ex, py + (tt - pt) / (qt - pt) * (qy - py) AS ey FROM high WHERE qt IS NOT NULL), """
    + _links()
)
ORACLES["mat_links_every_obs"] = text(_EVERY, "SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, n AS transition_count FROM links")
GAP = 40000.0
_G = f"(s_status = 'interpolated' AND s_width > {GAP})", f"(e_status = 'interpolated' AND e_width > {GAP})"
ORACLES["mat_gap_rejects"] = text(
    POINTS,
    f"""SELECT count(*) AS candidate_segments, sum(CASE WHEN s_status = 'exact' THEN 1 ELSE 0 END + CASE WHEN e_status = 'exact' THEN 1 ELSE 0 END)::BIGINT AS exact_endpoints,
 sum(CASE WHEN {_G[0]} THEN 1 ELSE 0 END + CASE WHEN {_G[1]} THEN 1 ELSE 0 END)::BIGINT AS gap_endpoints, count(*) FILTER (WHERE {_G[0]} OR {_G[1]}) AS rejected_gap,
 count(*) FILTER (WHERE NOT ({_G[0]} OR {_G[1]}) AND NOT ({INSIDE})) AS rejected_outside, count(*) FILTER (WHERE NOT ({_G[0]} OR {_G[1]}) AND ({INSIDE})) AS retained_segments FROM segs""",
)
ORACLES["mat_diagnostics"] = text(
    POINTS,
    f"""SELECT count(*) AS candidate_segments, sum(CASE WHEN s_status = 'exact' THEN 1 ELSE 0 END + CASE WHEN e_status = 'exact' THEN 1 ELSE 0 END)::BIGINT AS exact_endpoints,
 sum(CASE WHEN s_status = 'interpolated' THEN 1 ELSE 0 END + CASE WHEN e_status = 'interpolated' THEN 1 ELSE 0 END)::BIGINT AS interpolated_endpoints,
 count(*) FILTER (WHERE NOT ({INSIDE})) AS rejected_outside, count(*) FILTER (WHERE {INSIDE}) AS retained_segments,
 count(*) FILTER (WHERE NOT (sx >= 0 AND sx < 120 AND sy >= 0 AND sy < 100)) AS outside_start, count(*) FILTER (WHERE NOT (ex >= 0 AND ex < 120 AND ey >= 0 AND ey < 100)) AS outside_end FROM segs""",
)
ORACLES["mat_source_step_mode"] = text(
    """o AS (SELECT DISTINCT o_custkey AS c, CAST(epoch_us(o_orderdate) / 1000000 AS BIGINT) AS t FROM orders), g AS (SELECT lead(t) OVER (PARTITION BY c ORDER BY t) - t AS gap FROM o)""",
    "SELECT CAST(gap AS DOUBLE) AS timestep, count(*) AS observations FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY 2 DESC, 1 LIMIT 1",
)
_DIRTY = """e AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS trajectory, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 89 = 0 THEN NULL ELSE value END AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events),
raw AS (SELECT *, 0 AS row_index FROM e UNION ALL SELECT event_id, trajectory, t, x + 1.0, y, 1 FROM e WHERE event_id % 53 = 0),
good AS (SELECT * FROM raw WHERE trajectory IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
firsts AS (SELECT trajectory, t, arg_min(x, row_index) AS x, arg_min(y, row_index) AS y, count(*) AS copies FROM good GROUP BY trajectory, t),
sized AS (SELECT *, (SELECT count(*) FROM firsts o WHERE o.trajectory = f.trajectory) AS m, (SELECT min(t) FROM firsts o WHERE o.trajectory = f.trajectory) AS t0 FROM firsts f)"""
ORACLES["san_sanitise"] = text(_DIRTY, "SELECT trajectory, " + r6(time="t - t0", x="x", y="y") + " FROM sized WHERE m >= 2")
ORACLES["san_diagnostics"] = text(
    _DIRTY,
    """SELECT (SELECT count(*) FROM raw) AS source_observations, (SELECT count(*) FROM raw) - (SELECT count(*) FROM good) AS invalid_observations, (SELECT count(DISTINCT trajectory) FROM raw) AS source_trajectories,
 (SELECT sum(copies - 1) FROM firsts)::BIGINT AS duplicate_observations, (SELECT count(*) FROM sized WHERE m < 2) AS short_observations, (SELECT count(*) FROM sized WHERE m >= 2) AS retained_observations,
 (SELECT count(DISTINCT trajectory) FROM sized WHERE m < 2) AS short_trajectories, (SELECT count(DISTINCT trajectory) FROM sized WHERE m >= 2) AS retained_trajectories,
 (SELECT count(DISTINCT trajectory) FROM raw) - (SELECT count(DISTINCT trajectory) FROM sized) AS discarded_empty_trajectories""",
)
ORACLES["san_identity"] = """SELECT event_id, '["a/b", "' || user_id || '"]' AS identity FROM events"""
_WRAP = (
    POINTS.replace("tracks AS (SELECT trajectory, t - t0 AS t, x, y FROM counted", "tracks AS (SELECT trajectory, t - t0 AS t, x * 3.0 - 360 * floor(x * 3.0 / 360) - 180 AS x, y * 0.5 - 80.0 AS y FROM counted")
    .replace("px + (tt - pt) / (qt - pt) * (qx - px)", "px + (tt - pt) / (qt - pt) * (CASE WHEN qx - px > 180 THEN qx - px - 360 WHEN qx - px < -180 THEN qx - px + 360 ELSE qx - px END)")
    + """, placed AS (SELECT sx + 180 - 360 * floor((sx + 180) / 360) AS a, sy AS b, ex + 180 - 360 * floor((ex + 180) / 360) AS c, ey AS d FROM segs),
wrapped AS (SELECT CAST(floor(a / 10.0) AS BIGINT) AS start_x_bin, CAST(floor((b + 80) / 5.0) AS BIGINT) AS start_y_bin, CAST(floor(c / 10.0) AS BIGINT) AS end_x_bin, CAST(floor((d + 80) / 5.0) AS BIGINT) AS end_y_bin FROM placed WHERE b >= -80 AND b < -30 AND d >= -80 AND d < -30)"""
)
ORACLES["mat_wrap_lon"] = text(_WRAP, "SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, count(*) AS transition_count FROM wrapped GROUP BY ALL")
_BAD = LINKS + """, m AS (SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, n, n * 1.0 / sum(n) OVER (PARTITION BY sid) AS p FROM links),
bad AS (SELECT start_x_bin, start_y_bin, end_x_bin, CASE WHEN (start_x_bin + end_y_bin) % 7 = 0 THEN end_y_bin + 20 ELSE end_y_bin END AS end_y_bin, CASE WHEN (start_x_bin + end_x_bin) % 5 = 0 THEN -n ELSE n END AS n, CASE WHEN start_y_bin = 3 THEN p * 1.5 ELSE p END AS p FROM m)"""
ORACLES["val_flags_dirty"] = text(
    _BAD + """, f AS (SELECT b.*, sum(n) OVER (PARTITION BY start_x_bin, start_y_bin) AS tn, sum(p) OVER (PARTITION BY start_x_bin, start_y_bin) AS tp FROM bad b)""",
    """SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, array_to_string(list_filter([CASE WHEN n <= 0 THEN 'invalid_count' END, CASE WHEN p < 0 OR p > 1 THEN 'probability_range' END, CASE WHEN end_y_bin >= 10 THEN 'bin_bounds' END, CASE WHEN (end_y_bin >= 20) THEN 'grid_center' END,
 CASE WHEN tn <> 0 AND abs(p - n * 1.0 / tn) > 1e-12 + 1e-10 * abs(n * 1.0 / tn) THEN 'count_probability' END, CASE WHEN abs(tp - 1) > 1e-9 THEN 'row_normalization' END], lambda v: v IS NOT NULL), ';') AS flags FROM f""",
)
ORACLES["val_row_norm"] = text(LINKS, "SELECT start_x_bin, start_y_bin, count(*) AS links, sum(n)::BIGINT AS transitions, 1.0::DOUBLE AS probability_sum FROM links GROUP BY ALL")
ORACLES["sup_counts"] = text(
    OUT, "SELECT cell_id, n_out::BIGINT AS \"N_out_total\", n_move::BIGINT AS \"N_out_move\", n_in::BIGINT AS \"N_in_total\", n_in_move::BIGINT AS \"N_in_move\", (n_out - n_move)::BIGINT AS \"C_stay\", n_dest AS n_destinations, n_src AS n_sources, round(CASE WHEN n_out > 0 THEN 1 - (n_out - n_move) * 1.0 / n_out END, 6) AS \"P_move\" FROM counts"
)
ORACLES["sup_coverage"] = text(
    OUT + """, fields AS (SELECT 'N_out_total' AS field, n_out AS n FROM counts UNION ALL SELECT 'N_out_move', n_move FROM counts UNION ALL SELECT 'N_in_total', n_in FROM counts UNION ALL SELECT 'N_in_move', n_in_move FROM counts)""",
    "SELECT field, threshold::INTEGER AS threshold, count(*) FILTER (WHERE n >= threshold) AS cells, " + r6(of_positive="count(*) FILTER (WHERE n >= threshold) * 1.0 / count(*) FILTER (WHERE n > 0)", of_seen="count(*) FILTER (WHERE n >= threshold) * 1.0 / count(*)", of_grid="count(*) FILTER (WHERE n >= threshold) / 120.0") + " FROM fields, (VALUES (1), (5), (10), (30)) v(threshold) GROUP BY field, threshold",
)
ORACLES["sup_summary"] = text(OUT + ", s AS (SELECT CASE WHEN n_out > 0 THEN (n_out - n_move) * 1.0 / n_out END AS p FROM counts)", "SELECT count(*) AS cells, count(p) AS source_cells, " + r6(mean_P_stay="avg(p)", median_P_stay="quantile_cont(p, 0.5)", q05_P_stay="quantile_cont(p, 0.05)", q95_P_stay="quantile_cont(p, 0.95)") + " FROM s")
ORACLES["s1_moments"] = text(
    LINKS + """, g AS (SELECT sid AS cell_id, sum(n * dx) * 1.0 AS sx, sum(n * dy) * 1.0 AS sy, sum(n) AS tot, sum(CASE WHEN sid <> eid THEN n END) AS mov, sum(n * sqrt(dx * dx + dy * dy)) AS sd FROM links GROUP BY sid)""",
    "SELECT cell_id, " + r6(mu_out_all_x="sx / tot", mu_out_all_y="sy / tot", U_out_all_magnitude_rate="sqrt(sx * sx + sy * sy) / tot / 86400 * 1000", mu_out_move_x="sx / mov", mu_out_move_y="sy / mov", distance_mean_move="sd / mov", theta_mu_out=bearing("sx / mov", "sy / mov"), retained_fraction="sqrt(sx * sx + sy * sy) / sd") + " FROM g",
)
ORACLES["s1_weighted_quantiles"] = text(
    MOVES + ", w AS (SELECT sid, d, unnest(range(n)) AS copy FROM moves)",
    "SELECT sid AS cell_id, " + ", ".join(f"round(quantile_disc(d, {q}), 6) AS distance_q{int(100 * q):02d}" for q in (0.25, 0.5, 0.75, 0.95)) + " FROM w GROUP BY sid",
)
ORACLES["s1_strong_flags"] = text(
    LINKS + """, g AS (SELECT sid AS cell_id, sqrt(pow(sum(n * dx), 2) + pow(sum(n * dy), 2)) / sum(n) / 86400.0 AS u, coalesce(sum(CASE WHEN sid <> eid THEN n END), 0) AS mov FROM links GROUP BY sid), lim AS (SELECT quantile_cont(u, 0.95) AS a, quantile_cont(u, 0.99) AS b FROM g WHERE mov > 0)""",
    "SELECT cell_id, mov > 0 AND u >= a AS strong, mov > 0 AND u >= b AS top FROM g, lim",
)
ORACLES["s2_harmonics"] = text(OUT, "SELECT cell_id, " + r6(R1_out="least(1, sqrt(s1 * s1 + c1 * c1))", R2_out="least(1, sqrt(s2 * s2 + c2 * c2))", theta1_out=bearing("s1", "c1"), M1_out_real="c1", M1_out_imag="s1") + " FROM outgoing")
_BIN = "least(35, CAST(floor(" + bearing("dx", "dy") + " / 10.0) AS BIGINT))"
ORACLES["s2_entropy"] = text(
    MOVES + f", b AS (SELECT sid, {_BIN} AS b, sum(p) AS q FROM moves GROUP BY ALL)", "SELECT sid AS cell_id, " + r6(H_out="-sum(q * ln(q)) / ln(36)", effective_bins_out="exp(-sum(q * ln(q)))") + ", count(*) AS occupied_bins_out FROM b GROUP BY sid"
)
ORACLES["s2_spread"] = text(OUT, "SELECT cell_id, " + r6(distance_mean="dm", distance_std="sqrt(greatest(d2 - dm * dm, 0))", distance_max="dmax", distance_max_over_mean="dmax / dm", longest_leverage="lever / dm") + " FROM outgoing")
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"
ORACLES["s2_spearman"] = text(
    OUT + f""", v AS (SELECT o.cell_id, round(least(1, sqrt(s1 * s1 + c1 * c1)), 9) AS a, n_move AS b FROM outgoing o JOIN counts c ON o.cell_id = c.cell_id), k AS (SELECT {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb FROM v)""",
    "SELECT count(*) AS pairs, round(corr(ra, rb), 6) AS correlation FROM k",
)
ORACLES["s3_incoming"] = text(OUT, "SELECT cell_id, " + r6(R1_in="least(1, sqrt(s1 * s1 + c1 * c1))", R2_in="least(1, sqrt(s2 * s2 + c2 * c2))", theta1_in=bearing("s1", "c1"), mu_in_x="mx", mu_in_y="my", distance_in_mean="dm", distance_in_max="dmax") + " FROM incoming")
_ANGLES = OUT + f", ang AS (SELECT o.cell_id, {bearing('o.s1', 'o.c1')} AS a, {bearing('i.s1', 'i.c1')} AS b, {bearing('o.mx', 'o.my')} AS e, {bearing('i.mx', 'i.my')} AS f FROM outgoing o JOIN incoming i ON o.cell_id = i.cell_id)"

STATS = OUT + f""", tot AS (SELECT sid, sum(n) AS tn, sum(n * dx) * 1.0 AS sx, sum(n * dy) * 1.0 AS sy FROM links GROUP BY sid),
stats AS (SELECT c.cell_id, c.cell_id % 12 AS xb, c.cell_id // 12 AS yb, (c.cell_id % 12 + 0.5) * 10.0 AS x, (c.cell_id // 12 + 0.5) * 10.0 AS y, c.n_out, c.n_move, CASE WHEN c.n_out > 0 THEN 1 - (c.n_out - c.n_move) * 1.0 / c.n_out END AS pm,
 sqrt(t.sx * t.sx + t.sy * t.sy) / t.tn / 86400.0 AS u, t.sx / t.tn / 86400.0 AS ux, t.sy / t.tn / 86400.0 AS uy, CASE WHEN o.s1 IS NOT NULL THEN least(1, sqrt(o.s1 * o.s1 + o.c1 * o.c1)) END AS r1, {bearing('o.s1', 'o.c1')} AS th, {bearing('o.mx', 'o.my')} AS tm, {bearing('i.s1', 'i.c1')} AS ti, {bearing('i.mx', 'i.my')} AS tmi,
 CASE WHEN i.s1 IS NOT NULL THEN least(1, sqrt(i.s1 * i.s1 + i.c1 * i.c1)) END AS r1i, c.n_move * 1.0 / c.n_out * o.s1 AS dxx, c.n_move * 1.0 / c.n_out * o.c1 AS dyy, c.n_move * 1.0 / c.n_out * sqrt(o.s1 * o.s1 + o.c1 * o.c1) AS dm, o.dm AS dist
 FROM counts c LEFT JOIN tot t ON t.sid = c.cell_id LEFT JOIN outgoing o ON o.cell_id = c.cell_id LEFT JOIN incoming i ON i.cell_id = c.cell_id),
sup AS (SELECT * FROM stats WHERE n_move >= 3)"""
_NEAR = "abs(a.xb - b.xb) <= 1 AND abs(a.yb - b.yb) <= 1"
ORACLES["nbr_consistency"] = text(STATS, f"SELECT a.cell_id, round(avg(cos(radians(a.th - b.th))), 6) AS consistency, count(*) AS neighbours FROM sup a JOIN sup b ON {_NEAR} AND a.cell_id <> b.cell_id WHERE a.th IS NOT NULL AND b.th IS NOT NULL GROUP BY a.cell_id")
ORACLES["grd_smooth3x3"] = text(STATS, f"SELECT a.cell_id, round(avg(b.n_move), 6) AS smoothed FROM sup a JOIN sup b ON {_NEAR} GROUP BY a.cell_id")
ORACLES["grd_neighbours"] = text(STATS, f"SELECT a.cell_id AS a, b.cell_id AS b FROM sup a JOIN sup b ON {_NEAR} AND a.cell_id < b.cell_id")
ORACLES["grd_bilinear"] = text(
    STATS + """, pts AS (SELECT cell_id, xb + 0.37 AS gx, yb - 0.23 AS gy FROM sup), cl AS (SELECT cell_id, gx, gy, gy < 0 OR gx > 11 AS boundary FROM pts),
corners AS (SELECT p.cell_id, floor(gx) + i AS cx, floor(gy) + j AS cy, (CASE WHEN i = 1 THEN gx - floor(gx) ELSE 1 - gx + floor(gx) END) * (CASE WHEN j = 1 THEN gy - floor(gy) ELSE 1 - gy + floor(gy) END) AS w FROM cl p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE NOT boundary)""",
    """SELECT p.cell_id, p.boundary, round((SELECT CASE WHEN count(s.cell_id) = count(*) AND count(*) > 0 THEN sum(w * s.n_move) END FROM corners c LEFT JOIN sup s ON s.xb = c.cx AND s.yb = c.cy WHERE c.cell_id = p.cell_id AND w > 1e-10), 6) AS "N_out_move" FROM cl p""",
)
ORACLES["rdg_threshold"] = text(STATS, "SELECT round(quantile_cont(u, 0.9) * 1000, 6) AS threshold FROM sup")
CAND = STATS + ", cand AS (SELECT * FROM sup WHERE th IS NOT NULL AND pm >= 0.5 AND r1 >= 0.5 AND dm >= 0.4)"
ORACLES["dcr_candidates"] = text(CAND, "SELECT cell_id, " + r6(theta1_out="th", R1_out="r1") + " FROM cand")
_STEP = bearing("b.x - a.x", "b.y - a.y")
_AX = "least(" + apart("{0}", "{1}") + ", " + apart("{0}", "({1}) + 180") + ")"
EDGES = CAND + f""", pairs AS (SELECT a.cell_id AS a, b.cell_id AS b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len, {apart('b.th', 'a.th')} AS dd, {_AX.format('a.th', _STEP)} AS ma, {_AX.format('b.th', _STEP)} AS mb FROM cand a JOIN cand b ON {_NEAR} AND a.cell_id < b.cell_id),
edges AS (SELECT * FROM pairs WHERE dd <= 45 AND greatest(ma, mb) <= 45)"""
ORACLES["dcr_edges"] = text(EDGES, "SELECT a, b, " + r6(edge_length="len", direction_difference="dd", mismatch_a="ma", mismatch_b="mb") + " FROM edges")
COMP = EDGES.replace("obs AS", "RECURSIVE obs AS", 1) + """, twoway AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (SELECT cell_id AS v, cell_id AS w FROM cand UNION SELECT r.v, e.b FROM reach r JOIN twoway e ON e.a = r.w),
comp AS (SELECT v AS cell_id, min(w) AS component, count(*) AS size FROM reach GROUP BY v)"""
ORACLES["grf_components"] = text(COMP, "SELECT cell_id, component, dense_rank() OVER (ORDER BY component) AS component_number, size AS component_cells FROM comp")
ORACLES["grf_degree_class"] = text(
    COMP + ", deg AS (SELECT c.cell_id, c.component, c.size, (SELECT count(*) FROM twoway e WHERE e.a = c.cell_id) AS d FROM comp c)",
    "SELECT cell_id, d AS degree, d = 1 AS endpoint, d >= 3 AS junction, d = 0 AS isolated, CASE WHEN size = 1 THEN 'isolated_cell' WHEN max(d) OVER (PARTITION BY component) >= 3 THEN 'junction_network' WHEN min(d) OVER (PARTITION BY component) = 2 THEN 'loop' ELSE 'simple_path' END AS component_class FROM deg",
)
ORACLES["geo_cart_scales"] = text(STATS, "SELECT cell_id, 10.0 AS x_scale, 10.0 AS y_scale, 10.0 AS scale FROM stats")
_D = "CASE WHEN {p}.cell_id IS NULL AND {m}.cell_id IS NULL THEN NULL ELSE (coalesce({p}.n_move, c.n_move) - coalesce({m}.n_move, c.n_move)) / (CASE WHEN {p}.cell_id IS NOT NULL AND {m}.cell_id IS NOT NULL THEN 20.0 ELSE 10.0 END) END"
_M = "CASE WHEN {p}.cell_id IS NULL AND {m}.cell_id IS NULL THEN 'undefined' WHEN {p}.cell_id IS NOT NULL AND {m}.cell_id IS NOT NULL THEN 'centred' ELSE 'one_sided' END"
ORACLES["grv_gradient"] = text(
    STATS,
    f"""SELECT c.cell_id, {_M.format(p='e', m='w')} AS gradient_east_method, {_M.format(p='n', m='s')} AS gradient_north_method, round({_D.format(p='e', m='w')}, 6) AS gradient_east, round({_D.format(p='n', m='s')}, 6) AS gradient_north
 FROM stats c LEFT JOIN stats e ON e.xb = c.xb + 1 AND e.yb = c.yb LEFT JOIN stats w ON w.xb = c.xb - 1 AND w.yb = c.yb LEFT JOIN stats n ON n.xb = c.xb AND n.yb = c.yb + 1 LEFT JOIN stats s ON s.xb = c.xb AND s.yb = c.yb - 1""",
)
ORACLES["plt_vector_stride"] = text(STATS, "SELECT cell_id, xb AS x_bin, yb AS y_bin, " + r6(D_out_all_x="coalesce(dxx, 0)", D_out_all_y="coalesce(dyy, 0)") + " FROM stats WHERE xb % 3 = 0 AND yb % 3 = 0 AND n_out > 0")
ORACLES["plt_dateline_split"] = text(
    TRACKS + """, g AS (SELECT trajectory AS line, t, x * 3.0 - 360 * floor(x * 3.0 / 360) - 180 AS lon FROM tracks), c AS (SELECT line, t, CASE WHEN abs(lon - lag(lon) OVER (PARTITION BY line ORDER BY t)) > 180 THEN 1 ELSE 0 END AS cut FROM g),
p AS (SELECT line, sum(cut) OVER (PARTITION BY line ORDER BY t ROWS UNBOUNDED PRECEDING) AS part FROM c)""",
    "SELECT line, part::BIGINT AS part, count(*) AS points FROM p GROUP BY line, part HAVING count(*) >= 2",
)
# Sides of a ridge: the bilinear value one cell to the left and right of a direction.
_SIDE = """, {n} AS (SELECT cell_id, {v} AS v, 'left' AS side, xb - cos(radians({t})) AS gx, yb + sin(radians({t})) AS gy FROM {src} UNION ALL SELECT cell_id, {v}, 'right', xb + cos(radians({t})), yb - sin(radians({t})) FROM {src}),
{n}_b AS (SELECT *, gx < -1e-10 OR gx > 11 + 1e-10 OR gy < -1e-10 OR gy > 9 + 1e-10 AS edge, least(greatest(gx, 0), 11) AS cx, least(greatest(gy, 0), 9) AS cy FROM {n}),
{n}_c AS (SELECT cell_id, side, floor(cx) + i AS px, floor(cy) + j AS py, (CASE WHEN i = 1 THEN cx - floor(cx) ELSE 1 - cx + floor(cx) END) * (CASE WHEN j = 1 THEN cy - floor(cy) ELSE 1 - cy + floor(cy) END) AS w FROM {n}_b, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE NOT edge),
{n}_s AS (SELECT c.cell_id, c.side, CASE WHEN count(s.cell_id) = count(*) THEN sum(w * s.{f}) END AS val FROM {n}_c c LEFT JOIN sup s ON s.xb = c.px AND s.yb = c.py WHERE w > 1e-10 GROUP BY ALL),
{n}_r AS (SELECT b.cell_id, any_value(b.v) AS v, max(CASE WHEN b.side = 'left' THEN s.val END) AS lv, max(CASE WHEN b.side = 'right' THEN s.val END) AS rv, bool_or(edge AND b.side = 'left') AS le, bool_or(edge AND b.side = 'right') AS re FROM {n}_b b LEFT JOIN {n}_s s ON s.cell_id = b.cell_id AND s.side = b.side GROUP BY b.cell_id)"""
_MISS = "CASE WHEN lv IS NOT NULL AND rv IS NOT NULL THEN 'none' WHEN lv IS NOT NULL THEN 'right' WHEN rv IS NOT NULL THEN 'left' ELSE 'left_and_right' END"
_TYPE = "CASE WHEN v >= lv - 1e-12 AND v >= rv - 1e-12 THEN 'two_sided' WHEN (lv IS NULL) <> (rv IS NULL) AND v >= coalesce(lv, rv) - 1e-12 THEN 'one_sided' ELSE {0} END"
RIDGE = STATS + _SIDE.format(n="fl", v="u", t="tm", src="sup", f="u")
_ST = "CASE WHEN {e} THEN 'domain_boundary' WHEN {v} IS NULL THEN 'unknown_missing_support' ELSE 'available' END"
ORACLES["rdg_flux"] = text(RIDGE, f"SELECT cell_id, {_TYPE.format(chr(39) + 'not_ridge' + chr(39))} AS ridge_type, {_MISS} AS missing_side, {_ST.format(e='le', v='lv')} AS left_status, {_ST.format(e='re', v='rv')} AS right_status, " + r6(D_minus="(v - lv) * 1000", D_plus="(v - rv) * 1000") + " FROM fl_r")
DRIDGE = CAND + _SIDE.format(n="dr", v="dm", t="th", src="cand", f="dm")
ORACLES["dco_ridge"] = text(DRIDGE, f"SELECT cell_id, {_TYPE.format('CASE WHEN lv IS NULL AND rv IS NULL THEN ' + chr(39) + 'not_evaluable' + chr(39) + ' ELSE ' + chr(39) + 'not_ridge' + chr(39) + ' END')} AS ridge_type, {_MISS} AS missing_side, " + r6(left_value="lv", right_value="rv") + " FROM dr_r")
_GOOD = f"({_TYPE.format(chr(39) + 'x' + chr(39))}) <> 'x'"
DCORE = (
    EDGES.replace("obs AS", "RECURSIVE obs AS", 1)
    + _SIDE.format(n="dr", v="dm", t="th", src="cand", f="dm")
    + f""", raw AS (SELECT cell_id, {_TYPE.format(chr(39) + 'x' + chr(39))} AS ridge_type, {_MISS} AS missing_side FROM dr_r WHERE {_GOOD}),
dedge AS (SELECT a, b FROM edges WHERE a IN (SELECT cell_id FROM raw) AND b IN (SELECT cell_id FROM raw)), dboth AS (SELECT a, b FROM dedge UNION ALL SELECT b, a FROM dedge),
dreach AS (SELECT cell_id AS v, cell_id AS w FROM raw UNION SELECT r.v, e.b FROM dreach r JOIN dboth e ON e.a = r.w), dcomp AS (SELECT v AS cell_id, min(w) AS component, count(*) AS size FROM dreach GROUP BY v),
dcores AS (SELECT c.cell_id, c.component, dense_rank() OVER (ORDER BY component) AS num, r.ridge_type, r.missing_side FROM dcomp c JOIN raw r ON r.cell_id = c.cell_id WHERE size >= 3)"""
)
ORACLES["dco_plateau"] = text(DCORE, "SELECT cell_id, 'directional_plateau_' || lpad(CAST(row_number() OVER (ORDER BY cell_id) AS VARCHAR), 5, '0') AS plateau_id, 1::BIGINT AS plateau_size, cell_id AS representative, TRUE AS is_representative FROM raw")
ORACLES["dco_cores"] = text(DCORE + ", pl AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS k FROM raw)", "SELECT d.cell_id, 'directional_core_component_' || lpad(CAST(num AS VARCHAR), 4, '0') AS component_id, ridge_type, missing_side, 'directional_plateau_' || lpad(CAST(k AS VARCHAR), 5, '0') AS plateau_id FROM dcores d JOIN pl ON pl.cell_id = d.cell_id")
_CORE_EDGES = ", cedge AS (SELECT a, b FROM dboth WHERE a IN (SELECT cell_id FROM dcores) AND b IN (SELECT cell_id FROM dcores))"
ORACLES["dfr_hops"] = text(
    DCORE + _CORE_EDGES + ", h AS (SELECT cell_id, cell_id AS other, 0 AS hops FROM dcores UNION ALL SELECT a, b, 1 FROM cedge UNION ALL SELECT e.a, f.b, 2 FROM cedge e JOIN cedge f ON f.a = e.b)", "SELECT cell_id, other, min(hops)::INTEGER AS hops FROM h GROUP BY cell_id, other"
)
FCORE = (
    RIDGE.replace("obs AS", "RECURSIVE obs AS", 1)
    + f""", fcand AS (SELECT r.cell_id, s.xb, s.yb, s.x, s.y, s.u, s.tm, {_TYPE.format(chr(39) + 'x' + chr(39))} AS ridge_type, {_MISS} AS missing_side FROM fl_r r JOIN sup s ON s.cell_id = r.cell_id WHERE {_GOOD} AND s.u >= (SELECT quantile_cont(u, 0.9) FROM sup)),
fboth AS (SELECT a.cell_id AS a, b.cell_id AS b FROM fcand a JOIN fcand b ON {_NEAR} AND a.cell_id <> b.cell_id), freach AS (SELECT cell_id AS v, cell_id AS w FROM fcand UNION SELECT r.v, e.b FROM freach r JOIN fboth e ON e.a = r.w),
fcomp AS (SELECT v AS cell_id, min(w) AS component, dense_rank() OVER (ORDER BY min(w)) AS num FROM freach GROUP BY v)"""
)
ORACLES["grf_interruptions"] = text(
    FCORE, "SELECT f.cell_id FROM fcand f WHERE (SELECT count(*) FROM fboth e WHERE e.a = f.cell_id) = 1 AND EXISTS (SELECT 1 FROM (VALUES (-1), (0), (1)) p(i), (VALUES (-1), (0), (1)) q(j) WHERE f.xb + i BETWEEN 0 AND 11 AND f.yb + j BETWEEN 0 AND 9 AND NOT EXISTS (SELECT 1 FROM sup s WHERE s.xb = f.xb + i AND s.yb = f.yb + j))"
)
_STEPF = bearing("o.x - f.x", "o.y - f.y")
ORACLES["sec_contamination"] = text(
    FCORE,
    f"""SELECT DISTINCT f.cell_id AS section FROM (SELECT * FROM fcand JOIN fcomp USING (cell_id)) f JOIN (SELECT * FROM fcand JOIN fcomp USING (cell_id)) o ON o.component <> f.component
 WHERE abs(sqrt(pow(o.x - f.x, 2) + pow(o.y - f.y, 2)) * cos(radians(({_STEPF}) - f.tm))) <= 10 AND abs(sqrt(pow(o.x - f.x, 2) + pow(o.y - f.y, 2)) * sin(radians(({_STEPF}) - f.tm))) <= 50""",
)
BOTH = DCORE + FCORE[len(RIDGE.replace("obs AS", "RECURSIVE obs AS", 1)) :].join(["" + _SIDE.format(n="fl", v="u", t="tm", src="sup", f="u"), ""])
_CMP = BOTH + """, cmp AS (SELECT s.cell_id, f.num AS fc, d.num AS dc, CASE WHEN f.num IS NOT NULL AND d.num IS NOT NULL THEN 'flux_and_directional' WHEN d.num IS NOT NULL THEN 'directional_only' WHEN f.num IS NOT NULL THEN 'flux_only' ELSE 'neither' END AS class FROM sup s LEFT JOIN fcomp f ON f.cell_id = s.cell_id LEFT JOIN dcores d ON d.cell_id = s.cell_id)"""
ORACLES["cmp_cells"] = text(_CMP, "SELECT cell_id, coalesce(fc, 0) AS flux_component, coalesce(dc, 0) AS directional_component, class FROM cmp")
ORACLES["cmp_components"] = text(_CMP, "SELECT 'flux' AS kind, fc AS component, count(*) AS cells, count(dc) AS shared, round(count(dc) * 1.0 / count(*), 6) AS fraction FROM cmp WHERE fc IS NOT NULL GROUP BY fc UNION ALL SELECT 'directional', dc, count(*), count(fc), round(count(fc) * 1.0 / count(*), 6) FROM cmp WHERE dc IS NOT NULL GROUP BY dc")
_CLS = ("flux_and_directional", "directional_only", "flux_only", "neither")
ORACLES["cmp_summary"] = text(_CMP, "SELECT count(*) AS supported_cells, " + ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS {c}, round(count(*) FILTER (WHERE class = '{c}') * 1.0 / count(*), 6) AS {c}_fraction" for c in _CLS) + " FROM cmp")

PROFILES = (
    DCORE
    + _CORE_EDGES
    + """, hop AS (SELECT cell_id, cell_id AS other FROM dcores UNION SELECT a, b FROM cedge UNION SELECT e.a, f.b FROM cedge e JOIN cedge f ON f.a = e.b),
core AS (SELECT d.cell_id, d.num, d.ridge_type, d.missing_side, s.x, s.y, s.xb, s.yb, s.th FROM dcores d JOIN sup s ON s.cell_id = d.cell_id),
spots AS (SELECT c.*, i, xb + i * cos(radians(th)) AS gx, yb - i * sin(radians(th)) AS gy FROM core c, (SELECT unnest(range(-5, 6)) AS i)),
spots_b AS (SELECT *, gx < -1e-10 OR gx > 11 + 1e-10 OR gy < -1e-10 OR gy > 9 + 1e-10 AS edge, least(greatest(gx, 0), 11) AS cx, least(greatest(gy, 0), 9) AS cy FROM spots),
spots_c AS (SELECT cell_id, i, floor(cx) + p AS px, floor(cy) + q AS py, (CASE WHEN p = 1 THEN cx - floor(cx) ELSE 1 - cx + floor(cx) END) * (CASE WHEN q = 1 THEN cy - floor(cy) ELSE 1 - cy + floor(cy) END) AS w FROM spots_b, (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(q) WHERE NOT edge),
spots_v AS (SELECT c.cell_id, c.i, CASE WHEN count(s.dxx) = count(*) THEN sum(w * s.dxx) END AS vx, CASE WHEN count(s.dyy) = count(*) THEN sum(w * s.dyy) END AS vy FROM spots_c c LEFT JOIN sup s ON s.xb = c.px AND s.yb = c.py WHERE w > 1e-10 GROUP BY ALL),
prof AS (SELECT b.*, v.vx * sin(radians(b.th)) + v.vy * cos(radians(b.th)) AS u FROM spots_b b LEFT JOIN spots_v v ON v.cell_id = b.cell_id AND v.i = b.i),
axis AS (SELECT cell_id, i AS core_i, u AS core_u FROM prof WHERE u IS NOT NULL AND abs(i) <= 1 AND (i = 0 OR missing_side = 'none' OR (missing_side = 'left' AND i > 0) OR (missing_side = 'right' AND i < 0)) QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY u DESC, i) = 1),
rel AS (SELECT p.*, a.core_i, a.core_u, p.i - a.core_i AS step, CASE WHEN p.i < a.core_i THEN 'left' WHEN p.i > a.core_i THEN 'right' ELSE 'core' END AS side FROM prof p LEFT JOIN axis a ON a.cell_id = p.cell_id),
seen AS (SELECT *, side = 'core' OR missing_side = 'none' OR (missing_side = 'left' AND side = 'right') OR (missing_side = 'right' AND side = 'left') AS observable FROM rel),
smooth AS (SELECT s.*, CASE WHEN u IS NOT NULL THEN (SELECT quantile_cont(o.u, 0.5) FROM prof o WHERE o.cell_id = s.cell_id AND o.u IS NOT NULL AND abs(o.i - s.i) <= 1) END AS us FROM seen s),
inner_u AS (SELECT a.cell_id, a.step, a.u, b.u AS ui FROM smooth a LEFT JOIN smooth b ON b.cell_id = a.cell_id AND b.step = a.step - sign(a.step) AND a.step <> 0),
comps AS (SELECT h.cell_id, o.step, quantile_cont(o.u, 0.5) AS med, quantile_cont(o.u, 0.25) AS q25, quantile_cont(o.u, 0.75) AS q75, count(o.u) AS n, count(*) FILTER (WHERE o.ui > o.u) AS dec, count(*) FILTER (WHERE o.ui IS NOT NULL AND o.u IS NOT NULL) AS votes FROM hop h JOIN inner_u o ON o.cell_id = h.other GROUP BY h.cell_id, o.step),
full_rows AS (SELECT s.*, c.med, c.q25, c.q75, coalesce(c.n, 0) AS n, CASE WHEN c.votes > 0 THEN c.dec END AS dec, CASE WHEN c.votes > 0 THEN c.dec * 1.0 / c.votes END AS frac FROM smooth s LEFT JOIN comps c ON c.cell_id = s.cell_id AND c.step = s.step)"""
)
ORACLES["dfr_profiles"] = text(PROFILES, "SELECT cell_id, i::INTEGER AS i, side, observable, " + r6(u="u", u_smooth="us", core_u="core_u") + " FROM smooth")
ORACLES["dfr_composites"] = text(PROFILES, "SELECT cell_id, step::INTEGER AS step, n AS n_composite, coalesce(dec, 0)::BIGINT AS n_decline, " + r6(u_composite="med", u_q25="q25", u_q75="q75", fraction_decline="frac") + " FROM full_rows WHERE step IS NOT NULL")
ZONES = PROFILES + """, ok AS (SELECT f.*, d.sgn, abs(f.step) AS k FROM full_rows f JOIN (VALUES (-1, 'left'), (1, 'right')) d(sgn, want) ON f.side = 'core' OR f.side = d.want WHERE f.u IS NOT NULL AND f.observable AND NOT (f.missing_side = d.want OR f.missing_side = 'left_and_right')),
quad AS (SELECT a.cell_id, a.sgn, a.core_u, b.k * 10.0 AS dist, (b.gx + 0.5) * 10.0 AS fx, (b.gy + 0.5) * 10.0 AS fy, least(a.n, b.n) >= 2 AS usec, a.us AS as_, a.med AS am, b.us AS bs, b.med AS bm, c.us AS cs, c.med AS cm, d.us AS ds, d.med AS dm2, b.n AS bn, b.dec, b.frac
 FROM ok a JOIN ok b ON b.cell_id = a.cell_id AND b.sgn = a.sgn AND b.k = a.k + 1 LEFT JOIN ok c ON c.cell_id = a.cell_id AND c.sgn = a.sgn AND c.k = a.k + 2 LEFT JOIN ok d ON d.cell_id = a.cell_id AND d.sgn = a.sgn AND d.k = a.k + 3 AND c.cell_id IS NOT NULL),
zv AS (SELECT *, CASE WHEN usec THEN am ELSE as_ END AS va, CASE WHEN usec THEN bm ELSE bs END AS vb, CASE WHEN usec THEN cm ELSE cs END AS vc, CASE WHEN usec THEN dm2 ELSE ds END AS vd, coalesce(dec >= 2 AND frac >= 0.5, FALSE) AS pers FROM quad),
zone AS (SELECT *, va - vb AS dropped, coalesce(va - vb > 0 AND (coalesce(vc, vd) + coalesce(vd, vc)) / 2 <= (va + vb) / 2 + 1e-12 AND (bn < 2 OR pers), FALSE) AS elig FROM zv WHERE va IS NOT NULL AND vb IS NOT NULL),
placed AS (SELECT *, CASE WHEN sgn < 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN elig THEN row_number() OVER (PARTITION BY cell_id, sgn, elig ORDER BY pers DESC, round(dropped, 12) DESC, round(-dropped / 10.0, 12), dist) END AS place FROM zone),
ranked AS (SELECT *, CASE WHEN place = 1 THEN 1 END AS rnk FROM placed)"""
ORACLES["dfr_fronts"] = text(
    ZONES + ", sides AS (SELECT c.*, s.side, NOT (missing_side = s.side OR missing_side = 'left_and_right') AS observable FROM core c, (VALUES ('left'), ('right')) s(side))",
    """SELECT s.cell_id, s.side, s.observable, r.cell_id IS NOT NULL AS front_detected, CASE WHEN NOT s.observable THEN 'side_not_observable' WHEN r.cell_id IS NOT NULL THEN 'probable_directional_front' ELSE 'observable_no_retained_directional_front' END AS front_status, """
    + r6(front_x="r.fx", front_y="r.fy", distance_from_core="r.dist", loss="r.dropped", relative_loss="r.dropped / r.core_u")
    + " FROM sides s LEFT JOIN ranked r ON r.cell_id = s.cell_id AND r.side = s.side AND r.rnk = 1",
)

_A, _B = PROFILES.index("spots AS"), PROFILES.index("seen AS")
_FLUX_SPOTS = PROFILES[_A:_B].replace("radians(th)", "radians(tm)").replace("radians(b.th)", "radians(b.tm)").replace("s.dxx", "s.ux").replace("s.dyy", "s.uy")
FPROFILES = FCORE + ", core AS (SELECT * EXCLUDE (u) FROM fcand), " + _FLUX_SPOTS + """seen AS (SELECT *, i = 0 OR missing_side = 'none' OR (missing_side = 'left' AND i > 0) OR (missing_side = 'right' AND i < 0) AS observable FROM rel)"""
ORACLES["sec_profiles"] = text(FPROFILES, "SELECT cell_id, i::INTEGER AS i, side, edge AS boundary, observable, " + r6(px="(gx + 0.5) * 10.0", py="(gy + 0.5) * 10.0", distance="i * 10.0", u="u * 1000") + " FROM seen")
ORACLES["sec_refine"] = text(FPROFILES, "SELECT DISTINCT cell_id, core_i::INTEGER AS core_i, core_i IS NULL OR abs(core_i) = 1 AS core_uncertain, round(core_u * 1000, 6) AS core_u FROM seen")
ORACLES["sec_rolling_median"] = text(
    FPROFILES,
    """SELECT cell_id, i::INTEGER AS i, round(CASE WHEN core_u > 0 THEN u / core_u END, 6) AS u_relative, round(CASE WHEN u IS NOT NULL THEN (SELECT quantile_cont(o.u, 0.5) FROM prof o WHERE o.cell_id = s.cell_id AND o.u IS NOT NULL AND abs(o.i - s.i) <= 1) END * 1000, 6) AS u_smooth FROM seen s""",
)
ORACLES["cell_statistics"] = text(
    STATS,
    'SELECT cell_id, xb AS x_bin, yb AS y_bin, n_out::BIGINT AS "N_out_total", n_move::BIGINT AS "N_out_move", '
    + r6(x="x", y="y", P_move="pm", R1_out="r1", R1_in="r1i", theta1_out="th", theta_mu_out="tm", theta1_in="ti", theta_mu_in="tmi", D_out_all_x="CASE WHEN n_out > 0 THEN coalesce(dxx, 0) END", D_out_all_y="CASE WHEN n_out > 0 THEN coalesce(dyy, 0) END", U_out_all_magnitude_rate="u * 1000")
    + " FROM stats",
)
_F = "(1 / 298.257223563)"
_SIG = f"""SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN cu1 * cu2 * sin(lam) / ss ELSE 0 END AS sa FROM (SELECT *, sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM {{src}})"""
_SIG2 = f"""SELECT *, CASE WHEN 1 - sa * sa > 0 THEN cs - 2 * su1 * su2 / (1 - sa * sa) ELSE 0 END AS c2m, {_F} / 16 * (1 - sa * sa) * (4 + {_F} * (4 - 3 * (1 - sa * sa))) AS cc FROM ({_SIG})"""
GEODESIC = (
    _WRAP.replace("obs AS", "RECURSIVE obs AS", 1)
    + f""", glinks AS (SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, count(*) AS n FROM wrapped GROUP BY ALL),
kinds AS (SELECT DISTINCT start_y_bin AS ya, end_y_bin AS yb, (end_x_bin - start_x_bin + 36) % 36 AS dx FROM glinks WHERE start_x_bin <> end_x_bin OR start_y_bin <> end_y_bin),
geo0 AS (SELECT ya, yb, dx, atan((1 - {_F}) * tan(radians(-80 + (ya + 0.5) * 5.0))) AS u1, atan((1 - {_F}) * tan(radians(-80 + (yb + 0.5) * 5.0))) AS u2, radians(CASE WHEN dx >= 18 THEN dx * 10.0 - 360 ELSE dx * 10.0 END) AS ll FROM kinds),
geo1 AS (SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2 FROM geo0),
iter AS (SELECT ya, yb, dx, su1, cu1, su2, cu2, ll, ll AS lam, 0 AS k FROM geo1 UNION ALL SELECT ya, yb, dx, su1, cu1, su2, cu2, ll, ll + (1 - cc) * {_F} * sa * (sg + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))), k + 1 FROM ({_SIG2.format(src='iter WHERE k < 25')})),
last AS ({_SIG2.format(src='iter WHERE k = 25')}),
abs_ AS (SELECT *, (1 - sa * sa) * (pow(6378137.0, 2) - pow(6378137.0 * (1 - {_F}), 2)) / pow(6378137.0 * (1 - {_F}), 2) AS us FROM last),
ab AS (SELECT *, 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us))) AS aa, us / 1024 * (256 + us * (-128 + us * (74 - 47 * us))) AS bb FROM abs_),
geo AS (SELECT ya, yb, dx, 6378137.0 * (1 - {_F}) * aa * (sg - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) / 1000 AS dist,
 degrees(atan2(cu2 * sin(lam), cu1 * su2 - su1 * cu2 * cos(lam))) AS az, degrees(atan2(cu1 * sin(lam), -su1 * cu2 + cu1 * su2 * cos(lam))) + 180 AS bk FROM ab)"""
)
_W = "({0}) - 360 * floor(({0}) / 360)"
ORACLES["geo_geodesic"] = text(
    GEODESIC,
    f"""SELECT l.start_x_bin, l.start_y_bin, l.end_x_bin, l.end_y_bin, round(coalesce(g.dist, 0), 6) AS distance, round({_W.format('g.az')}, 6) AS theta_out, round({_W.format('g.bk')}, 6) AS theta_in_source
 FROM glinks l LEFT JOIN geo g ON g.ya = l.start_y_bin AND g.yb = l.end_y_bin AND g.dx = (l.end_x_bin - l.start_x_bin + 36) % 36 AND (l.start_x_bin <> l.end_x_bin OR l.start_y_bin <> l.end_y_bin)""",
)

# --- turns and identities


def signed(a: str, b: str) -> str:
    return f"(({a}) - ({b}) + 180 - 360 * floor((({a}) - ({b}) + 180) / 360) - 180)"


ORACLES["dfr_zones"] = text(ZONES, "SELECT cell_id, side, pers AS persistent, elig AS eligible, coalesce(rnk, 0) AS rank, " + r6(distance="dist", drop="dropped", relative_drop="dropped / core_u") + " FROM ranked")
ORACLES["s3_alignment"] = text(
    _ANGLES + f", t AS (SELECT *, {signed('a', 'b')} AS d1, {signed('e', 'f')} AS dm FROM ang)",
    "SELECT cell_id, " + r6(A_io="cos(radians(a - b))", A_io_mu="cos(radians(e - f))", delta_theta_io_1="d1", delta_theta_io_mu="dm", abs_delta_theta_io_1="abs(d1)", abs_delta_theta_io_mu="abs(dm)", abs_delta_theta_io_1_minus_mu=f"abs({signed('d1', 'dm')})") + " FROM t",
)
TURNS = STATS + f""", lim AS (SELECT quantile_cont(u, 0.95) AS q95, quantile_cont(u, 0.99) AS q99 FROM stats WHERE n_move > 0),
turns AS (SELECT s.*, c.n_in_move, coalesce(s.n_move > 0 AND u >= q95, FALSE) AS strong, coalesce(s.n_move > 0 AND u >= q99, FALSE) AS top, u * r1 AS coh, cos(radians(th - ti)) AS aio, cos(radians(tm - tmi)) AS aiom, {signed('th', 'ti')} AS d1, {signed('tm', 'tmi')} AS dmu,
 {apart('tm', 'th')} AS dmo, {apart('tmi', 'ti')} AS dmi, CASE WHEN o.s2 IS NOT NULL THEN least(1, sqrt(o.s2 * o.s2 + o.c2 * o.c2)) END AS r2, CASE WHEN i.s2 IS NOT NULL THEN least(1, sqrt(i.s2 * i.s2 + i.c2 * i.c2)) END AS r2i
 FROM stats s JOIN counts c ON c.cell_id = s.cell_id LEFT JOIN outgoing o ON o.cell_id = s.cell_id LEFT JOIN incoming i ON i.cell_id = s.cell_id, lim),
turned AS (SELECT *, abs(d1) AS ad1, abs(dmu) AS adm, abs({signed('d1', 'dmu')}) AS ad1m FROM turns)"""
_JOINT = "n_move >= {0} AND n_in_move >= {0}"
_JP, _JS = _JOINT.format(3), _JOINT.format(5)


def tally(**named: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in named.items())


ORACLES["s3_summary"] = text(
    TURNS + f", pairs AS (SELECT aio, aiom, {_RANK.format('aio')} AS ra, {_RANK.format('aiom')} AS rb FROM turned WHERE {_JP} AND aio IS NOT NULL AND aiom IS NOT NULL)",
    'SELECT count(r1i) AS "cells_with_R1_in", count(ti) AS cells_with_theta1_in, count(r2i) AS "cells_with_R2_in", count(CASE WHEN r2i > 1e-12 THEN 1 END) AS cells_with_theta2_in, count(r1i) AS "cells_with_H_in", count(tmi) AS cells_with_theta_mu_in, count(dmi) AS cells_with_delta_theta_mu1_in, count(aio) AS "cells_with_A_io", count(aiom) AS "cells_with_A_io_mu", '
    + tally(incoming_primary="n_in_move >= 3", incoming_sensitivity="n_in_move >= 5", joint_primary=_JP, joint_sensitivity=_JS, strong_out_primary=f"strong AND r1 >= 0.5 AND {_JP}", strong_both_primary=f"strong AND r1 >= 0.5 AND r1i >= 0.5 AND {_JP}", strong_out_sensitivity=f"strong AND r1 >= 0.5 AND {_JS}", strong_both_sensitivity=f"strong AND r1 >= 0.5 AND r1i >= 0.5 AND {_JS}", strong_out_low_in_primary=f"strong AND r1 >= 0.5 AND r1i <= 0.3 AND {_JP}", strong_both_poor_primary=f"strong AND r1 >= 0.5 AND r1i >= 0.5 AND aio <= 0 AND {_JP}", both_poor_primary=f"r1 >= 0.5 AND r1i >= 0.5 AND aio <= 0 AND {_JP}", both_poor_sensitivity=f"r1 >= 0.5 AND r1i >= 0.5 AND aio <= 0 AND {_JS}")
    + ", (SELECT round(quantile_cont(abs(aio - aiom), 0.5), 6) FROM pairs) AS median_alignment_difference, (SELECT round(quantile_cont(abs(aio - aiom), 0.95), 6) FROM pairs) AS q95_alignment_difference, (SELECT round(corr(ra, rb), 6) FROM pairs) AS spearman_alignments FROM turned",
)
ORACLES["s1_identities"] = text(STATS, "SELECT 0.0::DOUBLE AS x_residual, 0.0::DOUBLE AS y_residual, 0.0::DOUBLE AS \"retained_less_P_move\"")
ORACLES["dirv_identities"] = text(
    STATS, 'SELECT count(CASE WHEN n_move > 0 THEN 1 END) AS "cells_with_D_out_move", count(CASE WHEN n_out > 0 THEN 1 END) AS "cells_with_D_out_all", count(th) AS cells_with_defined_directional_bearing, ' + ", ".join(f'0.0::DOUBLE AS "{c}"' for c in ("D_out_all_x_residual", "D_out_all_y_residual", "D_out_move_less_R1", "D_out_all_less_P_move_R1", "D_out_move_bearing_residual", "D_out_all_bearing_residual")) + " FROM stats"
)
ORACLES["dirv_vectors"] = text(
    STATS + ", dv AS (SELECT s.*, o.s1, o.c1 FROM stats s LEFT JOIN outgoing o ON o.cell_id = s.cell_id WHERE s.n_out > 0)",
    "SELECT cell_id, " + r6(D_out_move_x="s1", D_out_move_y="c1", D_out_move_magnitude="sqrt(s1 * s1 + c1 * c1)", D_out_all_x="coalesce(dxx, 0)", D_out_all_y="coalesce(dyy, 0)", D_out_all_magnitude="coalesce(dm, 0)", U_coh_rate="u * r1 * 1000") + " FROM dv",
)
ORACLES["val_summary"] = text(LINKS, "SELECT count(*) AS links, sum(n)::BIGINT AS transitions, count(DISTINCT sid) AS sources, 0.0::DOUBLE AS largest_centre_residual, 0.0::DOUBLE AS largest_probability_residual, 0.0::DOUBLE AS largest_normalisation_residual FROM links")
ORACLES["mat_guard"] = text(
    _DIRTY,
    "SELECT count(*) FILTER (WHERE trajectory IS NULL) AS null_identities, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS not_finite, (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM raw GROUP BY trajectory, t)) AS repeated_times, (SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY trajectory HAVING count(*) < 2)) AS short_tracks FROM raw",
)
ORACLES["snk_public_names"] = "WITH c AS (" + ORACLES["cell_statistics"] + """) SELECT cell_id, x_bin AS start_lon_bin, y_bin AS start_lat_bin, x AS lon, y AS lat, "N_out_move", P_move, R1_out, R1_in, D_out_all_x AS D_out_all_east, D_out_all_y AS D_out_all_north,
 theta1_in AS theta1_in_motion_destination, U_out_all_magnitude_rate AS U_out_all_magnitude_km_day FROM c"""
ORACLES["ang_longitudes"] = text(
    TRACKS + """, g AS (SELECT DISTINCT trajectory, (round(x * 3.0 - 360 * floor(x * 3.0 / 360) - 180, 3) + 360) % 360 AS lon FROM tracks), n AS (SELECT trajectory, lon, lead(lon) OVER (PARTITION BY trajectory ORDER BY lon) AS nxt, min(lon) OVER (PARTITION BY trajectory) + 360 AS wrap FROM g),
spans AS (SELECT trajectory, 360 - max(coalesce(nxt, wrap) - lon) AS span FROM n GROUP BY trajectory), m AS (SELECT trajectory, degrees(atan2(avg(sin(radians(l))), avg(cos(radians(l))))) AS mean FROM (SELECT trajectory, round(x * 3.0 - 360 * floor(x * 3.0 / 360) - 180, 3) AS l FROM tracks) GROUP BY trajectory)""",
    "SELECT trajectory, round(span, 6) AS span, round(mean, 6) AS mean FROM spans JOIN m USING (trajectory)",
)
ORACLES["plt_limits"] = text(TURNS, "SELECT 'R1_out' AS field, 0.0::DOUBLE AS low, round(quantile_cont(r1, 0.98), 6) AS high FROM turned UNION ALL SELECT 'delta_theta_io_1', round(-quantile_cont(abs(d1), 0.95), 6), round(quantile_cont(abs(d1), 0.95), 6) FROM turned")

# --- the review

_AT = "(VALUES (0.9), (0.95), (0.99)) l(level)"
LEVELS = TURNS + f""", pop AS (SELECT v.support, l.level, t.* FROM turned t, (VALUES (3), (5)) v(support), {_AT} WHERE t.n_move >= v.support AND u IS NOT NULL AND coh IS NOT NULL),
cuts AS (SELECT support, level, CASE level WHEN 0.9 THEN quantile_cont(u, 0.9) WHEN 0.95 THEN quantile_cont(u, 0.95) ELSE quantile_cont(u, 0.99) END AS qu, CASE level WHEN 0.9 THEN quantile_cont(coh, 0.9) WHEN 0.95 THEN quantile_cont(coh, 0.95) ELSE quantile_cont(coh, 0.99) END AS qc FROM pop GROUP BY support, level),
lev AS (SELECT p.*, qu, qc, u >= qu AS inu, coh >= qc AS inc FROM pop p JOIN cuts c ON c.support = p.support AND c.level = p.level)"""
ORACLES["s4_levels"] = text(
    LEVELS,
    "SELECT support::INTEGER AS support, level::DOUBLE AS level, count(*) AS population, "
    + tally(flux_cells="inu", coherent_cells="inc", both="inu AND inc", either="inu OR inc")
    + ", "
    + r6(jaccard="count(*) FILTER (WHERE inu AND inc) * 1.0 / count(*) FILTER (WHERE inu OR inc)", flux_retained="count(*) FILTER (WHERE inu AND inc) * 1.0 / count(*) FILTER (WHERE inu)", coherent_retained="count(*) FILTER (WHERE inu AND inc) * 1.0 / count(*) FILTER (WHERE inc)", median_R1_flux="quantile_cont(r1, 0.5) FILTER (WHERE inu)", median_R1_removed="quantile_cont(r1, 0.5) FILTER (WHERE inu AND NOT inc)", flux_threshold="any_value(qu) * 1000", coherent_threshold="any_value(qc) * 1000")
    + " FROM lev GROUP BY support, level",
)
_NEIGH = """, {name} AS (SELECT a.cell_id, avg(cos(radians(a.{t} - b.{t}))) AS c, count(*) AS n FROM turned a JOIN turned b ON abs(a.xb - b.xb) <= 1 AND abs(a.yb - b.yb) <= 1 AND a.cell_id <> b.cell_id WHERE a.{t} IS NOT NULL AND b.{t} IS NOT NULL AND a.{f} >= {k} AND b.{f} >= {k} GROUP BY a.cell_id)"""
_KINDS = [(f"{side}_{kind}_{k}", t, f, k) for k in (3, 5) for side, f in (("out", "n_move"), ("in", "n_in_move")) for kind, t in (("1", "th" if side == "out" else "ti"), ("mu", "tm" if side == "out" else "tmi"))]
REVIEWED = LEVELS + "".join(_NEIGH.format(name=f"nb_{n}", t=t, f=f, k=k) for n, t, f, k in _KINDS) + ", rev AS (SELECT t.*, " + ", ".join(f"nb_{n}.c AS c_{n}, coalesce(nb_{n}.n, 0) AS n_{n}" for n, *_ in _KINDS) + " FROM turned t " + " ".join(f"LEFT JOIN nb_{n} ON nb_{n}.cell_id = t.cell_id" for n, *_ in _KINDS) + ")"
ORACLES["s4_fields"] = text(REVIEWED, "SELECT cell_id, strong, top, coalesce(ad1 >= 60, FALSE) AS substantial_turn_1, coalesce(adm >= 60, FALSE) AS substantial_turn_mu, " + ", ".join(f'n_{n} AS "N_neigh_{n}", round(c_{n}, 6) AS "C_neigh_{n}"' for n, *_ in _KINDS) + " FROM rev")
_POPS = {"outgoing_primary": "n_move >= 3", "strong_out_primary": "strong AND r1 >= 0.5 AND n_move >= 3", "strong_through_primary": f"strong AND r1 >= 0.5 AND r1i >= 0.5 AND {_JP}", "outgoing_sensitivity": "n_move >= 5", "strong_out_sensitivity": "strong AND r1 >= 0.5 AND n_move >= 5", "strong_through_sensitivity": f"strong AND r1 >= 0.5 AND r1i >= 0.5 AND {_JS}"}
_FIELDS = {"delta_theta_mu1_out": "dmo", "delta_theta_mu1_in": "dmi", "abs_delta_theta_io_1": "ad1", "abs_delta_theta_io_mu": "adm", "abs_delta_theta_io_1_minus_mu": "ad1m"}
ORACLES["s4_direction"] = text(
    TURNS,
    " UNION ALL ".join(
        f"SELECT '{p}' AS population, '{f}' AS field, count({v}) AS cells, count(*) FILTER (WHERE {v} >= 20) AS from_review, count(*) FILTER (WHERE {v} >= 60) AS from_substantial, " + r6(q0=f"quantile_cont({v}, 0.0)", q0_05=f"quantile_cont({v}, 0.05)", q0_5=f"quantile_cont({v}, 0.5)", q0_95=f"quantile_cont({v}, 0.95)", q0_99=f"quantile_cont({v}, 0.99)", q1=f"quantile_cont({v}, 1.0)") + f" FROM turned WHERE {w}"
        for p, w in _POPS.items()
        for f, v in _FIELDS.items()
    ),
)
_PERS = "count(*) AS cells, count(c) AS with_neighbourhood, round(quantile_cont(c, 0.5), 6) AS median_consistency, round(avg(CASE WHEN c >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS consistent_fraction, round(quantile_cont(r1, 0.5), 6) AS \"median_R1\", round(quantile_cont(n, 0.5), 6) AS median_neighbours"
ORACLES["s4_persistence"] = text(
    REVIEWED + ", lp AS (SELECT l.support, l.level, l.inu, l.inc, l.r1, CASE l.support WHEN 3 THEN c_out_1_3 ELSE c_out_1_5 END AS c, CASE l.support WHEN 3 THEN n_out_1_3 ELSE n_out_1_5 END AS n FROM lev l JOIN rev r ON r.cell_id = l.cell_id), every AS (SELECT v.support, r1, CASE v.support WHEN 3 THEN c_out_1_3 ELSE c_out_1_5 END AS c, CASE v.support WHEN 3 THEN n_out_1_3 ELSE n_out_1_5 END AS n FROM rev, (VALUES (3), (5)) v(support) WHERE n_move >= v.support)",
    f"SELECT support::INTEGER AS support, 'flux' AS field, level::DOUBLE AS level, {_PERS} FROM lp WHERE inu GROUP BY support, level UNION ALL SELECT support::INTEGER, 'coherent', level::DOUBLE, {_PERS} FROM lp WHERE inc GROUP BY support, level UNION ALL SELECT support::INTEGER, 'all', 0.0, {_PERS} FROM every GROUP BY support",
)
_CPLX = "coalesce((r1{0} BETWEEN 0.4 AND 0.85 AND r2{0} <= 0.3) OR (r1{0} <= 0.3 AND r2{0} >= 0.8), FALSE)"
LOW = REVIEWED + f""", low0 AS (SELECT *, CASE WHEN ad1 IS NULL THEN adm WHEN adm IS NULL THEN ad1 ELSE greatest(ad1, adm) END AS turn, {_JP} AS joint, coalesce(r1 >= 0.5 AND r1i >= 0.5, FALSE) AS rel, coalesce(c_out_1_3 >= 0.3 AND c_in_1_3 >= 0.3, FALSE) AS spat, {_CPLX.format('')} AS cxo, {_CPLX.format('i')} AS cxi FROM rev),
low1 AS (SELECT *, CASE WHEN NOT joint THEN 'insufficient_primary_joint_support' WHEN rel AND spat THEN CASE WHEN turn >= 150 THEN 'coherent_reversal_like_turning_geometry' ELSE 'coherent_turning_geometry' END WHEN cxo OR cxi THEN 'possible_split_merge_or_axial_geometry' WHEN r1 < 0.5 OR r1i < 0.5 THEN 'directionally_ambiguous_turning' ELSE 'supported_unresolved_turning_geometry' END AS interpretation FROM low0 WHERE turn >= 90)"""
ORACLES["s4_low_alignment"] = text(LOW, "SELECT cell_id, interpretation, joint AS joint_support, rel AS reliable, spat AS spatially_persistent, cxo AS complex_out, cxi AS complex_in, round(turn, 6) AS turn, round(aio, 6) AS \"A_io\" FROM low1")
ORACLES["s4_interpretations"] = text(LOW, f"SELECT interpretation, count(*) AS cells, count(*) FILTER (WHERE {_JP}) AS cells_primary, count(*) FILTER (WHERE {_JS}) AS cells_sensitivity FROM low1 GROUP BY interpretation")
ORACLES["s4_topk"] = text(
    LOW + """, at95 AS (SELECT r.*, coalesce(l.inu, FALSE) AS inu, coalesce(l.inc, FALSE) AS inc, coalesce(r.strong AND r.r1 >= 0.5 AND r.n_move >= 3, FALSE) AS st FROM rev r LEFT JOIN lev l ON l.cell_id = r.cell_id AND l.support = 3 AND l.level = 0.95),
pools AS (SELECT 'flux_backbone_stable_under_coherence_weighting' AS category, cell_id, u, u AS score, inc AS inside FROM at95 WHERE inu UNION ALL SELECT 'coherence_weighting_suppresses_flux_cell', cell_id, u, u * (1 - r1), NOT inc FROM at95 WHERE inu UNION ALL SELECT 'strong_direction_convention_disagreement', cell_id, u, u * dmo, coalesce(dmo >= 20, FALSE) FROM at95 WHERE st),
chosen AS (SELECT *, NOT bool_or(inside) OVER (PARTITION BY category) AS fallback FROM pools), every_ AS (SELECT category, cell_id, u, score, fallback FROM chosen WHERE inside OR fallback UNION ALL SELECT 'low_alignment_' || interpretation, cell_id, u, u, FALSE FROM low1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST, u DESC NULLS LAST, cell_id) AS place FROM every_)""",
    "SELECT category, place, cell_id, fallback, round(score * 1000, 6) AS score FROM numbered WHERE place <= 3",
)
_S4 = lambda k, j: (
    f"SELECT {k}::INTEGER AS support, "
    + tally(strong_reliable_out=f"n_move >= {k} AND r1 >= 0.5 AND strong", strong_from_review=f"n_move >= {k} AND r1 >= 0.5 AND strong AND dmo >= 20", strong_reliable_through=f"{j} AND r1 >= 0.5 AND strong AND r1i >= 0.5", strong_through_substantial=f"{j} AND r1 >= 0.5 AND strong AND r1i >= 0.5 AND ad1 >= 60", joint_cells=j)
    + ", "
    + tally(**{n: f"{j} AND r1 >= 0.5 AND r1i >= 0.5 AND c_out_1_{k} >= 0.3 AND c_in_1_{k} >= 0.3 AND {w}" for n, w in (("persistent_through", "TRUE"), ("persistent_substantial", "ad1 >= 60"), ("persistent_low_alignment", "ad1 >= 90"), ("persistent_reversal", "ad1 >= 150"))}, low_alignment_cells=f"{j} AND (ad1 >= 90 OR adm >= 90)")
    + f", round(quantile_cont(r1, 0.5) FILTER (WHERE n_move >= {k}), 6) AS \"median_R1_out\", round(quantile_cont(dmo, 0.5) FILTER (WHERE n_move >= {k} AND r1 >= 0.5 AND strong), 6) AS strong_median_difference, round(quantile_cont(dmo, 0.95) FILTER (WHERE n_move >= {k} AND r1 >= 0.5 AND strong), 6) AS strong_q95_difference, 0.0::DOUBLE AS \"A_io_residual\", 0.0::DOUBLE AS \"A_io_mu_residual\", (SELECT round(corr(ra, rb), 6) FROM (SELECT {_RANK.format('u')} AS ra, {_RANK.format('coh')} AS rb FROM rev WHERE n_move >= {k} AND u IS NOT NULL AND coh IS NOT NULL)) AS spearman_flux_coherent FROM rev"
)
ORACLES["s4_summary"] = text(REVIEWED, _S4(3, _JP) + " UNION ALL " + _S4(5, _JS))

# --- components, summaries of the directional pathway

_MED = "quantile_cont({0}, 0.5)"
ORACLES["dcr_components"] = text(
    COMP + """, deg AS (SELECT c.cell_id, c.component, (SELECT count(*) FROM twoway e WHERE e.a = c.cell_id) AS d FROM comp c), e AS (SELECT c.component, count(*) AS edges, sum(len) AS len, avg(dd) AS mdd, max(dd) AS ldd, avg(greatest(ma, mb)) AS msm, max(greatest(ma, mb)) AS lsm FROM edges x JOIN comp c ON c.cell_id = x.a GROUP BY c.component),
g AS (SELECT component, count(*) AS cells, sum(n_move)::BIGINT AS transitions, count(*) FILTER (WHERE d = 1) AS endpoints, count(*) FILTER (WHERE d >= 3) AS junctions, sum(dm) AS s, avg(dm) AS ms, quantile_cont(dm, 0.5) AS md, sqrt(pow(avg(sin(radians(th))), 2) + pow(avg(cos(radians(th))), 2)) AS dc, max(x) - min(x) AS xs, max(y) - min(y) AS ys, avg(x) AS cx, avg(y) AS cy, avg(pm) AS mp, quantile_cont(pm, 0.5) AS qp, avg(r1) AS mr, quantile_cont(r1, 0.5) AS qr FROM deg JOIN cand USING (cell_id) GROUP BY component)""",
    "SELECT g.component, cells, coalesce(edges, 0)::BIGINT AS edges, transitions, endpoints, junctions, rank() OVER (ORDER BY cells DESC) AS rank_cells, rank() OVER (ORDER BY round(coalesce(len, 0), 9) DESC) AS rank_length, rank() OVER (ORDER BY md DESC) AS rank_median_strength, "
    + r6(strength="s", mean_strength="ms", median_strength="md", direction_concentration="dc", edge_length="coalesce(len, 0)", x_span="xs", y_span="ys", centroid_x="cx", centroid_y="cy", mean_P_move="mp", median_P_move="qp", mean_R1_out="mr", median_R1_out="qr", mean_direction_difference="mdd", largest_direction_difference="ldd", mean_step_mismatch="msm", largest_step_mismatch="lsm")
    + " FROM g LEFT JOIN e ON e.component = g.component",
)


def deciles(value: str, name: str) -> dict[str, str]:
    return {f"{name}_q{int(100 * q)}": f"quantile_cont({value}, {q})" for q in (0.1, 0.5, 0.9)}


ORACLES["dcr_summary"] = text(
    COMP + ", sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY component), one AS (SELECT count(*) AS supported_cells, " + r6(**deciles("pm", "supported_P_move"), **deciles("r1", "supported_R1"), **deciles("dm", "supported_strength")) + " FROM sup), two AS (SELECT sum(n)::BIGINT AS candidate_cells, count(*) AS candidate_components, " + r6(**deciles("n", "component_cells")) + " FROM sizes)",
    "SELECT * FROM one, two",
)
ORACLES["dco_summary"] = text(
    DCORE + f""", types AS (SELECT {_TYPE.format('CASE WHEN lv IS NULL AND rv IS NULL THEN ' + chr(39) + 'not_evaluable' + chr(39) + ' ELSE ' + chr(39) + 'not_ridge' + chr(39) + ' END')} AS t FROM dr_r), one AS (SELECT count(*) AS candidate_cells, {tally(two_sided_cells="t = 'two_sided'", one_sided_cells="t = 'one_sided'", not_ridge_cells="t = 'not_ridge'", not_evaluable_cells="t = 'not_evaluable'", raw_ridge_cells="t IN ('two_sided', 'one_sided')", plateau_groups="t IN ('two_sided', 'one_sided')", plateau_representatives="t IN ('two_sided', 'one_sided')")} FROM types),
two AS (SELECT count(*) FILTER (WHERE size >= 3) AS core_cells, count(*) FILTER (WHERE size < 3) AS discarded_cells, {r6(**deciles("CASE WHEN size >= 3 THEN dm END", "core_strength"))} FROM dcomp JOIN sup USING (cell_id)), parts AS (SELECT component, count(*) AS n FROM dcomp GROUP BY component),
three AS (SELECT count(*) FILTER (WHERE n >= 3) AS core_components, count(*) FILTER (WHERE n < 3) AS discarded_components, {r6(**deciles("CASE WHEN n >= 3 THEN n END", "component_cells"))} FROM parts)""",
    "SELECT * FROM one, two, three",
)
_DFLAGS = """[CASE WHEN count(*) FILTER (WHERE u IS NULL AND NOT edge) > 0 THEN 'unsupported_transverse_sample' END, CASE WHEN bool_or(edge) THEN 'domain_boundary' END, CASE WHEN max(missing_side) IN ('left', 'left_and_right') THEN 'left_side_not_observable' END, CASE WHEN max(missing_side) IN ('right', 'left_and_right') THEN 'right_side_not_observable' END,
 CASE WHEN coalesce(abs(max(core_i)) = 1, TRUE) THEN 'axis_location_uncertain' END, CASE WHEN max(deg) >= 3 THEN 'directional_core_graph_junction' END, CASE WHEN max(deg) = 1 THEN 'directional_core_graph_endpoint' END, CASE WHEN count(u) < 7 THEN 'short_available_cross_section' END]"""
_DTV = PROFILES + ", tv AS (SELECT s.*, abs(u - lag(u) OVER w) AS st, abs(us - lag(us) OVER w) AS ss, (SELECT count(*) FROM cedge e WHERE e.a = s.cell_id) AS deg FROM smooth s WINDOW w AS (PARTITION BY s.cell_id ORDER BY i))"
ORACLES["sec_summaries"] = text(
    _DTV,
    f"""SELECT 'cell' || lpad(CAST(cell_id AS VARCHAR), 5, '0') AS section, count(u) AS valid_samples, count(*) FILTER (WHERE u IS NULL AND NOT edge) AS unsupported_samples, count(*) FILTER (WHERE edge) AS boundary_samples, count(*) FILTER (WHERE abs(step) >= 2 AND u < 0) > 0 AS opposing_outer_flow,
 array_to_string(list_filter({_DFLAGS}, lambda v: v IS NOT NULL), ';') AS quality_flags, round(coalesce(sum(st), 0), 6) AS total_variation, round(coalesce(sum(ss), 0), 6) AS total_variation_smoothed FROM tv GROUP BY cell_id""",
)
_DSIDES = ZONES + ", sides AS (SELECT c.*, s.side, NOT (missing_side = s.side OR missing_side = 'left_and_right') AS observable FROM core c, (VALUES ('left'), ('right')) s(side)), dfr AS (SELECT s.cell_id, s.side, s.observable, r.dist, r.dropped, r.dropped / r.core_u AS rel, r.cell_id IS NOT NULL AS hit FROM sides s LEFT JOIN ranked r ON r.cell_id = s.cell_id AND r.side = s.side AND r.rnk = 1)"
ORACLES["dfr_summary"] = text(
    _DSIDES + ", per AS (SELECT cell_id, count(*) FILTER (WHERE observable AND hit) AS k FROM dfr GROUP BY cell_id), shape AS (SELECT cell_id, count(u) AS valid, count(*) FILTER (WHERE u IS NULL AND NOT edge) AS lost, count(*) FILTER (WHERE abs(step) >= 2 AND u < 0) AS against FROM smooth GROUP BY cell_id), "
    + "one AS (SELECT count(*) AS sections, " + tally(sections_with_two_fronts="k = 2", sections_with_one_front="k = 1", sections_without_front="k = 0", sections_with_missing_support="lost > 0", short_sections="valid < 7", sections_with_opposing_outer_signal="against > 0") + " FROM per JOIN shape USING (cell_id)), two AS (SELECT " + tally(fronts="observable AND hit", observable_sides_without_front="observable AND NOT hit", unobservable_sides="NOT observable") + ", "
    + r6(**deciles("CASE WHEN observable THEN dist END", "distance"), **deciles("CASE WHEN observable THEN dropped END", "drop"), **deciles("CASE WHEN observable THEN rel END", "relative_drop")) + " FROM dfr)",
    "SELECT * FROM one, two",
)

# --- the flux pathway: ordered segments by a recursive walk

SEG_CTES = f""", fdeg AS (SELECT f.cell_id, (SELECT count(*) FROM fboth e WHERE e.a = f.cell_id) AS deg FROM fcand f),
walk AS (SELECT e.a AS s, e.b AS n1, e.a AS prev, e.b AS cur, 1 AS k FROM fboth e JOIN fdeg d ON d.cell_id = e.a WHERE d.deg <> 2 UNION ALL SELECT w.s, w.n1, w.cur, e.b, w.k + 1 FROM walk w JOIN fdeg d ON d.cell_id = w.cur AND d.deg = 2 JOIN fboth e ON e.a = w.cur AND e.b <> w.prev),
paths AS (SELECT w.s, w.n1, w.k AS len FROM walk w JOIN fdeg d ON d.cell_id = w.cur WHERE d.deg <> 2 AND (w.s < w.cur OR (w.s = w.cur AND w.n1 <= w.prev))),
rings AS (SELECT component, min(cell_id) AS a FROM fcomp JOIN fdeg USING (cell_id) GROUP BY component HAVING min(deg) = 2 AND max(deg) = 2),
ring AS (SELECT r.a, r.a AS prev, (SELECT min(e.b) FROM fboth e WHERE e.a = r.a) AS cur, 1 AS k FROM rings r UNION ALL SELECT r.a, r.cur, e.b, r.k + 1 FROM ring r JOIN fboth e ON e.a = r.cur AND e.b <> r.prev WHERE e.b <> r.a),
places AS (SELECT p.s, p.n1, 0 AS k, p.s AS cell_id, FALSE AS closed FROM paths p UNION ALL SELECT w.s, w.n1, w.k, w.cur, FALSE FROM walk w JOIN paths p ON p.s = w.s AND p.n1 = w.n1 UNION ALL SELECT a, a, 0, a, TRUE FROM rings UNION ALL SELECT a, a, k, cur, TRUE FROM ring UNION ALL SELECT cell_id, cell_id, 0, cell_id, FALSE FROM fdeg WHERE deg = 0),
numbered AS (SELECT c.component, c.num, dense_rank() OVER (PARTITION BY c.component ORDER BY p.s, p.n1) - 1 AS segment, p.k, p.cell_id, p.closed FROM places p JOIN fcomp c ON c.cell_id = p.s),
around_ AS (SELECT n.*, f.x, f.y, f.tm, f.u, count(*) OVER seg AS m, lag(f.x) OVER line AS px, lag(f.y) OVER line AS py, lead(f.x) OVER line AS nx, lead(f.y) OVER line AS ny, lead(f.u) OVER line AS nu, first_value(f.x) OVER seg_all AS fx, first_value(f.y) OVER seg_all AS fy, first_value(f.u) OVER seg_all AS fu, last_value(f.x) OVER seg_all AS lx, last_value(f.y) OVER seg_all AS ly
 FROM numbered n JOIN fcand f ON f.cell_id = n.cell_id WINDOW seg AS (PARTITION BY n.component, n.segment), line AS (PARTITION BY n.component, n.segment ORDER BY n.k), seg_all AS (PARTITION BY n.component, n.segment ORDER BY n.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
linked AS (SELECT *, coalesce(px, CASE WHEN closed AND m > 2 THEN lx END, x) AS ax, coalesce(py, CASE WHEN closed AND m > 2 THEN ly END, y) AS ay, coalesce(nx, CASE WHEN closed AND m > 2 THEN fx END) AS bx, coalesce(ny, CASE WHEN closed AND m > 2 THEN fy END) AS by_, coalesce(nu, CASE WHEN closed AND m > 2 THEN fu END) AS bu FROM around_),
tangents AS (SELECT *, CASE WHEN m > 1 THEN {bearing('coalesce(bx, x) - ax', 'coalesce(by_, y) - ay')} END AS t0, sqrt(pow(bx - x, 2) + pow(by_ - y, 2)) AS edge_len FROM linked),
facing AS (SELECT *, coalesce(sum(cos(radians(tm - t0))) OVER (PARTITION BY component, segment) < 0, FALSE) AS rev FROM tangents),
seg AS (SELECT component, num, segment, CASE WHEN rev THEN m - 1 - k ELSE k END AS sequence, cell_id, closed, CASE WHEN rev THEN (t0 + 180) - 360 * floor((t0 + 180) / 360) ELSE t0 END AS tangent, tm, edge_len, (u + bu) / 2 * edge_len AS strength FROM facing),
segm AS (SELECT *, {apart('tm', 'tangent')} AS mismatch FROM seg),
segt AS (SELECT *, {apart('nt', 'tangent')} AS turn FROM (SELECT *, coalesce(lead(tangent) OVER w, CASE WHEN closed THEN first_value(tangent) OVER w END) AS nt FROM segm WINDOW w AS (PARTITION BY component, segment ORDER BY sequence))),
segs_ AS (SELECT component, segment, any_value(closed) AS closed, count(*) AS n, coalesce(sum(edge_len), 0) AS length, coalesce(sum(strength), 0) AS strength, coalesce(sum(turn), 0) AS turn, coalesce(max(turn), 0) AS lturn FROM segt GROUP BY component, segment)"""
SEGMENTS = FCORE + SEG_CTES
ORACLES["grf_segments"] = text(SEGMENTS, "SELECT component, segment::INTEGER AS segment, sequence::INTEGER AS sequence, cell_id, closed, " + r6(tangent="tangent", mismatch="mismatch", edge_length="edge_len") + " FROM segm")
_CELL = f"""fcell AS (SELECT f.cell_id, f.ridge_type, f.x, f.y, s.u, s.r1, s.r1i, s.n_move, c.n_in_move, CASE WHEN o.s2 IS NOT NULL THEN least(1, sqrt(o.s2 * o.s2 + o.c2 * o.c2)) END AS r2, {apart('s.tm', 's.th')} AS dmo, {apart('s.th', 's.ti')} AS ad1, {apart('s.tm', 's.tmi')} AS adm, r.v - (r.lv + r.rv) / 2 AS cperp, CASE WHEN (r.lv IS NULL) <> (r.rv IS NULL) THEN r.v - coalesce(r.lv, r.rv) END AS cone,
 coalesce(s.r1 >= 0.8, FALSE) AND coalesce({apart('s.tm', 's.th')} <= 20, FALSE) AND s.tm IS NOT NULL AS reliable, coalesce(s.r1 < 0.5, FALSE) OR s.tm IS NULL AS ambiguous, d.deg FROM fcand f JOIN sup s ON s.cell_id = f.cell_id JOIN counts c ON c.cell_id = f.cell_id LEFT JOIN outgoing o ON o.cell_id = f.cell_id JOIN fl_r r ON r.cell_id = f.cell_id JOIN fdeg d ON d.cell_id = f.cell_id)"""
ORACLES["grf_segment_stats"] = text(
    SEGMENTS + ", " + _CELL,
    "SELECT t.component, t.segment::INTEGER AS segment, any_value(t.closed) AS closed, count(DISTINCT t.cell_id) AS cells, (CASE WHEN bool_or(t.closed) THEN 0 ELSE least(2, count(*)) END)::BIGINT AS endpoints, count(*) FILTER (WHERE (t.sequence = 0 OR t.sequence = g.n - 1) AND f.deg >= 3) AS junction_endpoints, "
    + tally(abrupt_mismatches="t.mismatch >= 45", two_sided_cells="f.ridge_type = 'two_sided'", one_sided_cells="f.ridge_type = 'one_sided'", orientation_reliable_cells="f.reliable", orientation_ambiguous_cells="f.ambiguous")
    + ', min(f.n_move)::BIGINT AS "minimum_N_out_move", '
    + r6(length="any_value(g.length)", total_turn="any_value(g.turn)", largest_turn="any_value(g.lturn)", mean_mismatch="avg(t.mismatch)", median_mismatch="quantile_cont(t.mismatch, 0.5)", largest_mismatch="max(t.mismatch)", x_span="max(f.x) - min(f.x)", y_span="max(f.y) - min(f.y)", mean_R1_out="avg(f.r1)", mean_N_out_move="avg(f.n_move)", integrated_strength="any_value(g.strength) * 1000")
    + " FROM segt t JOIN fcell f ON f.cell_id = t.cell_id JOIN segs_ g ON g.component = t.component AND g.segment = t.segment GROUP BY t.component, t.segment",
)
_BROKEN = "EXISTS (SELECT 1 FROM (VALUES (-1), (0), (1)) p(i), (VALUES (-1), (0), (1)) q(j) WHERE f.xb + i BETWEEN 0 AND 11 AND f.yb + j BETWEEN 0 AND 9 AND NOT EXISTS (SELECT 1 FROM sup s WHERE s.xb = f.xb + i AND s.yb = f.yb + j))"
ORACLES["grf_component_stats"] = text(
    SEGMENTS + ", " + _CELL + f""", gone AS (SELECT f.cell_id FROM fcand f JOIN fdeg d ON d.cell_id = f.cell_id WHERE d.deg = 1 AND {_BROKEN}),
per_seg AS (SELECT component, count(*) AS segments, sum(length) AS length, sum(strength) AS strength, sum(turn) AS turn, max(lturn) AS lturn FROM segs_ GROUP BY component), per_member AS (SELECT component, avg(mismatch) AS mm, quantile_cont(mismatch, 0.5) AS dm_, max(mismatch) AS lm, count(*) FILTER (WHERE mismatch >= 45) AS abrupt FROM segm GROUP BY component),
per_cell AS (SELECT k.component, count(*) AS cells, {tally(endpoints="deg = 1", junctions="deg >= 3", two_sided_cells="ridge_type = 'two_sided'", one_sided_cells="ridge_type = 'one_sided'", unsupported_interruptions="cell_id IN (SELECT cell_id FROM gone)")}, CASE WHEN bool_or(deg = 0) THEN 'isolated_cell' WHEN bool_or(deg >= 3) THEN 'junction_network' WHEN min(deg) = 2 THEN 'loop' ELSE 'simple_path' END AS component_class, min(n_move) AS minn, avg(u) AS mu, quantile_cont(u, 0.5) AS du, max(u) AS lu, avg(cperp) AS mc, quantile_cont(cperp, 0.5) AS dc, avg(cone) AS mo, quantile_cont(cone, 0.5) AS dono, avg(cperp / u) AS mcn, max(x) - min(x) AS xs, max(y) - min(y) AS ys, avg(x) AS cx, avg(y) AS cy, avg(r1) AS mr, quantile_cont(r1, 0.5) AS dr, avg(r2) AS mr2, avg(dmo) AS mdmo, avg(n_move) AS mn, avg(r1i) AS mri, avg(n_in_move) AS mni, avg(ad1) AS mad1, avg(adm) AS madm FROM fcell JOIN fcomp k USING (cell_id) GROUP BY k.component)""",
    'SELECT c.component, component_class, cells, segments, endpoints, junctions, unsupported_interruptions, abrupt AS abrupt_mismatches, two_sided_cells, one_sided_cells, minn::BIGINT AS "minimum_N_out_move", rank() OVER (ORDER BY round(length, 9) DESC) AS rank_length, rank() OVER (ORDER BY du DESC) AS rank_median_flux, rank() OVER (ORDER BY strength DESC) AS rank_integrated_strength, rank() OVER (ORDER BY dc DESC NULLS LAST) AS rank_median_contrast, rank() OVER (ORDER BY minn DESC) AS rank_minimum_support, '
    + r6(length="length", total_turn="turn", largest_turn="lturn", mean_mismatch="mm", median_mismatch="dm_", largest_mismatch="lm", x_span="xs", y_span="ys", centroid_x="cx", centroid_y="cy", mean_C_perp_normalized="mcn", mean_R1_out="mr", median_R1_out="dr", mean_R2_out="mr2", mean_delta_theta_mu1_out="mdmo", mean_N_out_move="mn", mean_R1_in="mri", mean_N_in_move="mni", mean_abs_delta_theta_io_1="mad1", mean_abs_delta_theta_io_mu="madm", mean_U_out_all_magnitude_rate="mu * 1000", median_U_out_all_magnitude_rate="du * 1000", maximum_U_out_all_magnitude_rate="lu * 1000", mean_C_perp="mc * 1000", median_C_perp="dc * 1000", mean_C_perp_one_sided="mo * 1000", median_C_perp_one_sided="dono * 1000", integrated_strength="strength * 1000")
    + " FROM per_cell c JOIN per_seg USING (component) JOIN per_member USING (component)",
)

# --- sections along segments

_FLUX_N = FPROFILES.replace("AS vy FROM", "AS vy, CASE WHEN count(s.n_move) = count(*) THEN sum(w * s.n_move) END AS vn FROM", 1).replace("AS u FROM spots_b", "AS u, v.vn FROM spots_b", 1)
SECTIONS = (
    _FLUX_N
    + SEG_CTES
    + """, fsm AS (SELECT s.*, CASE WHEN u IS NOT NULL THEN (SELECT quantile_cont(o.u, 0.5) FROM prof o WHERE o.cell_id = s.cell_id AND o.u IS NOT NULL AND abs(o.i - s.i) <= 1) END AS us FROM seen s),
secs AS (SELECT component, segment, sequence, cell_id, printf('component_%04d_segment_%05d_seq%04d', num, segment, sequence) AS section FROM seg),
sec AS (SELECT g.component, g.segment, g.sequence, g.section, m.* EXCLUDE (missing_side), m.missing_side FROM secs g JOIN fsm m ON m.cell_id = g.cell_id),
near AS (SELECT a.section, b.section AS other FROM secs a JOIN secs b ON a.component = b.component AND a.segment = b.segment AND abs(a.sequence - b.sequence) <= 2),
inward AS (SELECT a.section, a.step, a.u, b.u AS ui FROM sec a LEFT JOIN sec b ON b.section = a.section AND b.step = a.step - sign(a.step) AND a.step <> 0),
fcs AS (SELECT h.section, o.step, quantile_cont(o.u, 0.5) AS med, quantile_cont(o.u, 0.25) AS q25, quantile_cont(o.u, 0.75) AS q75, count(o.u) AS n, count(*) FILTER (WHERE o.ui > o.u) AS dec, count(*) FILTER (WHERE o.ui IS NOT NULL AND o.u IS NOT NULL) AS votes FROM near h JOIN inward o ON o.section = h.other WHERE o.step IS NOT NULL GROUP BY h.section, o.step),
frow AS (SELECT s.*, c.med, c.q25, c.q75, coalesce(c.n, 0) AS n, CASE WHEN c.votes > 0 THEN c.dec END AS dec, CASE WHEN c.votes > 0 THEN c.dec * 1.0 / c.votes END AS frac, max(abs(s.u)) OVER (PARTITION BY s.section) AS big FROM sec s LEFT JOIN fcs c ON c.section = s.section AND c.step = s.step),
fok AS (SELECT f.*, d.want, row_number() OVER (PARTITION BY f.section, d.want ORDER BY abs(f.step)) AS r, row_number() OVER (PARTITION BY f.section, d.want ORDER BY abs(f.step) DESC) AS rback FROM frow f JOIN (VALUES ('left'), ('right')) d(want) ON f.side = 'core' OR f.side = d.want WHERE f.u IS NOT NULL AND f.step IS NOT NULL AND NOT (f.missing_side = d.want OR f.missing_side = 'left_and_right')),
fquad AS (SELECT a.section, a.cell_id, a.want AS side, a.core_u, a.big, abs(b.step) * 10.0 AS dist, (abs(b.step) - abs(a.step)) * 10.0 AS width, (b.gx + 0.5) * 10.0 AS fx, (b.gy + 0.5) * 10.0 AS fy, least(a.n, b.n) AS nn, least(a.n, b.n) >= 2 AS usec, CASE WHEN least(a.n, b.n) >= 2 THEN a.med ELSE a.us END AS va, CASE WHEN least(a.n, b.n) >= 2 THEN b.med ELSE b.us END AS vb, CASE WHEN least(a.n, b.n) >= 2 THEN c.med ELSE c.us END AS vc, CASE WHEN least(a.n, b.n) >= 2 THEN d.med ELSE d.us END AS vd, b.n AS bn, coalesce(b.dec >= 2 AND b.frac >= 0.5, FALSE) AS pers, least(a.vn, b.vn) AS minn
 FROM fok a JOIN fok b ON b.section = a.section AND b.want = a.want AND b.r = a.r + 1 LEFT JOIN fok c ON c.section = a.section AND c.want = a.want AND c.r = a.r + 2 LEFT JOIN fok d ON d.section = a.section AND d.want = a.want AND d.r = a.r + 3),
fzone AS (SELECT *, va - vb AS dropped, coalesce(va - vb > 0 AND (coalesce(vc, vd) + coalesce(vd, vc)) / 2 <= (va + vb) / 2 + 1e-12 * big AND (bn < 2 OR pers), FALSE) AS elig FROM fquad WHERE va IS NOT NULL AND vb IS NOT NULL),
franked AS (SELECT *, CASE WHEN elig THEN row_number() OVER (PARTITION BY section, side, elig ORDER BY pers DESC, round(dropped / big, 12) DESC, round(-dropped / big / (width / 10.0), 12), dist) END AS rnk FROM fzone)"""
)
ORACLES["cmpx_composite"] = text(SECTIONS, "SELECT section, step::INTEGER AS step, n AS n_composite, " + r6(u_composite="med * 1000", u_q25="q25 * 1000", u_q75="q75 * 1000") + " FROM frow WHERE step IS NOT NULL")
ORACLES["cmpx_votes"] = text(SECTIONS, "SELECT section, step::INTEGER AS step, dec AS n_decline, round(frac, 6) AS fraction_decline FROM frow WHERE dec IS NOT NULL")
ORACLES["cmpx_span"] = text(
    SECTIONS,
    "SELECT n.section, count(*) AS neighbour_sections, (SELECT max(f.n) FROM frow f WHERE f.section = n.section) AS n_neighbours, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS composite_span FROM near n JOIN secs p ON p.section = n.section JOIN fcand a ON a.cell_id = p.cell_id JOIN secs o ON o.section = n.other JOIN fcand b ON b.cell_id = o.cell_id GROUP BY n.section",
)
ORACLES["drp_zones"] = text(
    SECTIONS,
    "SELECT section, side, cell_id, pers AS persistent, elig AS eligible, CASE WHEN usec THEN 'composite_median' ELSE 'smoothed' END AS profile_used, nn AS n_neighbours, (2 + CASE WHEN vc IS NULL THEN 0 ELSE 1 END + CASE WHEN vd IS NULL THEN 0 ELSE 1 END)::BIGINT AS supporting_samples, rnk AS rank, "
    + r6(distance="dist", relative_drop="CASE WHEN core_u > 0 THEN dropped / core_u END", width="width", minimum_N_out_move="minn", drop="dropped * 1000", recovery="CASE WHEN vc IS NOT NULL OR vd IS NOT NULL THEN greatest(0, greatest(coalesce(vc, vd), coalesce(vd, vc)) - vb) END * 1000").replace("AS drop", 'AS "drop"')
    + " FROM franked",
)
SIDES = SECTIONS + """, fside AS (SELECT g.section, g.cell_id, s.side, NOT (c.missing_side = s.side OR c.missing_side = 'left_and_right') AS observable FROM secs g JOIN fcand c ON c.cell_id = g.cell_id, (VALUES ('left'), ('right')) s(side)),
fdist AS (SELECT section, want AS side, min(CASE WHEN core_u > 0 AND u / core_u <= 0.5 THEN abs(step) * 10.0 END) AS d50, min(CASE WHEN core_u > 0 AND u / core_u <= 0.36787944117144233 THEN abs(step) * 10.0 END) AS d1e, min(CASE WHEN core_u > 0 AND u / core_u <= 0 THEN abs(step) * 10.0 END) AS d0, count(*) FILTER (WHERE rback <= 2 AND u < 0) > 0 AS opposing FROM fok GROUP BY section, want),
fcount AS (SELECT section, side, count(*) FILTER (WHERE elig) AS candidates FROM franked GROUP BY section, side),
fres AS (SELECT s.*, d.d50, d.d1e, d.d0, coalesce(d.opposing, FALSE) AS opposing, coalesce(c.candidates, 0) AS candidates, b.dist, b.dropped, b.dropped / CASE WHEN b.core_u > 0 THEN b.core_u END AS rel, b.fx, b.fy, coalesce(b.pers, FALSE) AS pers, coalesce(greatest(0, greatest(coalesce(b.vc, b.vd), coalesce(b.vd, b.vc)) - b.vb) > 0.5 * b.dropped, FALSE) AS strong
 FROM fside s LEFT JOIN fdist d ON d.section = s.section AND d.side = s.side LEFT JOIN fcount c ON c.section = s.section AND c.side = s.side LEFT JOIN franked b ON b.section = s.section AND b.side = s.side AND b.rnk = 1)"""
_STATUS = "CASE WHEN NOT observable THEN 'flank_not_observable' WHEN candidates > 0 THEN 'candidate_drop' ELSE 'observable_no_candidate_drop' END"
ORACLES["drp_sides"] = text(SIDES, f"SELECT section, side, observable, candidates, candidates > 0 AS detected, {_STATUS} AS status, pers AS persistent, strong AS strong_recovery, opposing, " + r6(distance_half="d50", distance_1e="d1e", distance_zero="d0", front_distance="dist", relative_drop="rel") + " FROM fres")
_NEARBY = f"EXISTS (SELECT 1 FROM fcand f JOIN fcomp k ON k.cell_id = f.cell_id JOIN fcand o ON TRUE JOIN fcomp l ON l.cell_id = o.cell_id WHERE f.cell_id = t.cell_id AND l.component <> k.component AND abs(sqrt(pow(o.x - f.x, 2) + pow(o.y - f.y, 2)) * cos(radians(({_STEPF}) - f.tm))) <= 10 + 1e-9 AND abs(sqrt(pow(o.x - f.x, 2) + pow(o.y - f.y, 2)) * sin(radians(({_STEPF}) - f.tm))) <= 50 + 1e-9)"
SUMMED = SIDES + f""", ftv AS (SELECT f.*, abs(u - lag(u) OVER w) AS st, abs(us - lag(us) OVER w) AS ss FROM frow f WINDOW w AS (PARTITION BY section ORDER BY i)),
fsum0 AS (SELECT t.section, any_value(t.cell_id) AS cell_id, count(u) AS valid, count(*) FILTER (WHERE u IS NULL AND NOT edge) AS lost, count(*) FILTER (WHERE edge) AS edges, coalesce(sum(st), 0) AS tv, coalesce(sum(ss), 0) AS tvs, count(*) FILTER (WHERE abs(step) >= 2 AND u < 0) > 0 AS against, coalesce(abs(max(core_i)) = 1, TRUE) AS unsure, max(core_i) AS core_i, max(core_u) AS core_u, max(missing_side) AS ms FROM ftv t GROUP BY t.section),
fsum1 AS (SELECT t.*, {_NEARBY} AS crossed, s.n_move, c.n_in_move, s.tm, s.r1, {apart('s.tm', 's.th')} AS dmo, d.deg, g.lturn FROM fsum0 t JOIN sup s ON s.cell_id = t.cell_id JOIN counts c ON c.cell_id = t.cell_id JOIN fdeg d ON d.cell_id = t.cell_id JOIN secs p ON p.section = t.section JOIN segs_ g ON g.component = p.component AND g.segment = p.segment),
fsum AS (SELECT *, array_to_string(list_filter([CASE WHEN n_move < 3 THEN 'insufficient_outgoing_support' END, CASE WHEN n_in_move < 3 THEN 'insufficient_incoming_support' END, CASE WHEN tm IS NULL THEN 'undefined_theta_mu_out' END, CASE WHEN r1 < 0.5 THEN 'low_R1_out' END, CASE WHEN dmo > 20 THEN 'large_delta_theta_mu1_out' END, CASE WHEN lost > 0 THEN 'unsupported_transverse_sample' END, CASE WHEN edges > 0 THEN 'domain_boundary' END, CASE WHEN ms IN ('left', 'left_and_right') THEN 'left_flank_not_observable' END, CASE WHEN ms IN ('right', 'left_and_right') THEN 'right_flank_not_observable' END,
 CASE WHEN unsure THEN 'core_location_uncertain' END, CASE WHEN crossed THEN 'nearby_branch_contamination' END, CASE WHEN deg >= 3 THEN 'pixel_junction_nearby' END, CASE WHEN deg = 1 THEN 'segment_endpoint' END, CASE WHEN lturn >= 60 THEN 'high_local_curvature_turning' END, CASE WHEN valid < 7 THEN 'short_available_cross_section' END], lambda v: v IS NOT NULL), ';') AS flags FROM fsum1)"""
ORACLES["sec_flux_summaries"] = text(SUMMED, "SELECT section, valid AS valid_samples, lost AS unsupported_samples, edges AS boundary_samples, against AS opposing_outer_flow, flags AS quality_flags, crossed AS nearby_branch_contamination, round(tv * 1000, 6) AS total_variation, round(tvs * 1000, 6) AS total_variation_smoothed FROM fsum")
OUTCOMES = SUMMED + f""", fout AS (SELECT section, count(*) FILTER (WHERE observable) AS seen_, count(*) FILTER (WHERE observable AND candidates > 0) AS hit, max(candidates) > 1 AS many, max(CASE WHEN side = 'left' THEN {_STATUS} END) AS ls, max(CASE WHEN side = 'right' THEN {_STATUS} END) AS rs, max(CASE WHEN side = 'left' THEN dist END) AS ld, max(CASE WHEN side = 'right' THEN dist END) AS rd, bool_or(side = 'left' AND candidates > 0) AS lh, bool_or(side = 'right' AND candidates > 0) AS rh FROM fres GROUP BY section),
fends AS (SELECT f.*, o.* EXCLUDE (section), seen_ > 0 AND hit = 0 AS nodrop, concat_ws(';', CASE WHEN flags <> '' THEN flags END, CASE WHEN seen_ > 0 AND hit = 0 THEN 'no_candidate_drop' END, CASE WHEN seen_ < 2 THEN 'flank_not_observable' END, CASE WHEN many THEN 'multiple_candidate_drops' END) AS all_flags FROM fsum f JOIN fout o ON o.section = f.section),
fflank AS (SELECT r.section, r.side, r.cell_id, r.fx, r.fy, r.dist, r.dropped, r.rel, r.pers, r.candidates > 1 AS many, r.strong, s.crossed, concat_ws(';', CASE WHEN s.flags <> '' THEN s.flags END, CASE WHEN r.candidates > 1 THEN 'multiple_candidate_drops' END, CASE WHEN r.strong THEN 'strong_outer_recovery' END, CASE WHEN r.opposing THEN 'opposing_outer_flux' END) AS flags FROM fres r JOIN fsum s ON s.section = r.section WHERE r.dist IS NOT NULL)"""
ORACLES["drp_outcomes"] = text(OUTCOMES, "SELECT section, seen_ AS observable_sides, hit AS detected_sides, nodrop AS no_candidate_drop, seen_ > 0 AND hit = seen_ AS all_observable_have_drop, hit < seen_ AS observable_without_drop, many AS multiple_candidate_drops, ls AS left_status, rs AS right_status, all_flags AS quality_flags FROM fends")
ORACLES["drp_flanks"] = text(OUTCOMES, "SELECT section, side, cell_id, many AS multiple_candidate_drops, strong AS strong_recovery, flags AS quality_flags, " + r6(front_x="fx", front_y="fy", distance="dist") + " FROM fflank")
ORACLES["frt_flux"] = text(
    OUTCOMES + ", both_ AS (SELECT c.cell_id, c.missing_side, s.side, NOT (c.missing_side = s.side OR c.missing_side = 'left_and_right') AS observable FROM fcand c, (VALUES ('left'), ('right')) s(side)), best AS (SELECT cell_id, side, quantile_cont(fx, 0.5) AS fx, quantile_cont(fy, 0.5) AS fy, quantile_cont(dist, 0.5) AS dist, quantile_cont(dropped, 0.5) AS dropped, quantile_cont(rel, 0.5) AS rel FROM fflank GROUP BY cell_id, side)",
    "SELECT b.cell_id, b.side, b.observable, b.observable AND f.fx IS NOT NULL AS front_detected, CASE WHEN NOT b.observable THEN 'side_not_observable' WHEN f.fx IS NOT NULL THEN 'probable_flux_front' ELSE 'observable_no_retained_front' END AS front_status, " + r6(front_x="f.fx", front_y="f.fy", distance_from_core="f.dist", relative_loss="f.rel", loss="f.dropped * 1000") + " FROM both_ b LEFT JOIN best f ON f.cell_id = b.cell_id AND f.side = b.side",
)
ORACLES["frt_summary"] = text(
    OUTCOMES,
    "SELECT count(*) AS sections, count(DISTINCT cell_id) AS ridge_cells, count(core_u) AS sections_with_core, "
    + tally(core_unchanged="core_i = 0", core_shifted_one_scale="abs(core_i) = 1", two_sided_drop_sections="lh AND rh", one_sided_drop_sections="lh <> rh", no_drop_sections="nodrop", two_sided_core_sections="seen_ = 2", one_sided_core_sections="seen_ = 1", one_sided_cores_with_drop="seen_ = 1 AND hit > 0", one_sided_cores_without_drop="seen_ = 1 AND nodrop", nearby_branch_sections="crossed", short_sections="valid < 7", curved_sections="lturn >= 60", curved_sections_with_core="lturn >= 60 AND core_u IS NOT NULL", low_R1_sections="r1 < 0.5", no_drop_with_support_limitation="nodrop AND (lost > 0 OR valid < 7)", no_drop_with_nearby_branch="nodrop AND crossed")
    + ", sum(seen_)::BIGINT AS observable_flanks, sum(2 - seen_)::BIGINT AS unobservable_flanks, (SELECT count(*) FROM fflank) AS flanks, (SELECT count(*) FROM fflank WHERE crossed) AS flanks_with_nearby_branch, "
    + r6(median_left_distance="quantile_cont(ld, 0.5)", median_right_distance="quantile_cont(rd, 0.5)", median_distance_asymmetry="quantile_cont(abs(ld - rd), 0.5)", median_variation_reduction="quantile_cont(CASE WHEN tv <> 0 THEN (tv - tvs) / tv END, 0.5)", persistent_fraction="(SELECT avg(CASE WHEN pers THEN 1.0 ELSE 0.0 END) FROM fflank)", median_total_variation="quantile_cont(tv, 0.5) * 1000", median_total_variation_smoothed="quantile_cont(tvs, 0.5) * 1000", median_drop="(SELECT quantile_cont(dropped, 0.5) FROM fflank) * 1000")
    + " FROM fends",
)

# --- the gradient and the fronts


def corners(name: str, points: str, keys: str, table: str, fields: dict[str, str]) -> str:
    """CTEs <name>: keys, edge, and bilinear values of the fields of `table` (xb, yb) at the points (keys, gx, gy); a value is there if each corner of some weight has it."""
    own = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    plain = ", ".join(k.strip() for k in keys.split(","))
    same = " AND ".join(f"v.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    values = ", ".join(f"CASE WHEN count(t.{f}) = count(*) THEN sum(w * t.{f}) END AS {a}" for a, f in fields.items())
    return f""", {name}_b AS (SELECT *, gx < -1e-10 OR gx > 11 + 1e-10 OR gy < -1e-10 OR gy > 9 + 1e-10 AS edge, least(greatest(gx, 0), 11) AS cx, least(greatest(gy, 0), 9) AS cy FROM {points}),
{name}_c AS (SELECT {plain}, floor(cx) + p AS qx, floor(cy) + q AS qy, (CASE WHEN p = 1 THEN cx - floor(cx) ELSE 1 - cx + floor(cx) END) * (CASE WHEN q = 1 THEN cy - floor(cy) ELSE 1 - cy + floor(cy) END) AS w FROM {name}_b, (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(q) WHERE NOT edge),
{name}_v AS (SELECT {", ".join("c." + k.strip() for k in keys.split(","))}, {values} FROM {name}_c c LEFT JOIN {table} t ON t.xb = c.qx AND t.yb = c.qy WHERE w > 1e-10 GROUP BY ALL),
{name} AS (SELECT {own}, b.edge, b.gx, b.gy, {", ".join("v." + a for a in fields)} FROM {name}_b b LEFT JOIN {name}_v v ON {same})"""


_DU = "CASE WHEN c.u IS NULL OR ({p}.u IS NULL AND {m}.u IS NULL) THEN NULL ELSE (coalesce({p}.u, c.u) - coalesce({m}.u, c.u)) / (CASE WHEN {p}.u IS NOT NULL AND {m}.u IS NOT NULL THEN 20.0 ELSE 10.0 END) END"
_MU = "CASE WHEN c.u IS NULL OR ({p}.u IS NULL AND {m}.u IS NULL) THEN 'undefined' WHEN {p}.u IS NOT NULL AND {m}.u IS NOT NULL THEN 'centred' ELSE 'one_sided' END"
GRAD_CTES = f""", g0 AS (SELECT c.cell_id, c.xb, c.yb, c.x, c.y, c.u, c.tm, {_DU.format(p='e', m='w')} AS ge, {_DU.format(p='n', m='s')} AS gn, {_MU.format(p='e', m='w')} AS me, {_MU.format(p='n', m='s')} AS mn
 FROM stats c LEFT JOIN stats e ON e.xb = c.xb + 1 AND e.yb = c.yb LEFT JOIN stats w ON w.xb = c.xb - 1 AND w.yb = c.yb LEFT JOIN stats n ON n.xb = c.xb AND n.yb = c.yb + 1 LEFT JOIN stats s ON s.xb = c.xb AND s.yb = c.yb - 1),
g1 AS (SELECT *, -ge * cos(radians(tm)) + gn * sin(radians(tm)) AS ac, ge * sin(radians(tm)) + gn * cos(radians(tm)) AS al, CASE WHEN tm IS NOT NULL THEN sqrt(ge * ge + gn * gn) END AS mag FROM g0),
grad AS (SELECT *, abs(ac) AS aac, abs(al) AS aal, CASE WHEN mag > 1e-15 THEN abs(ac) / mag END AS frac_,
 array_to_string(list_filter([CASE WHEN u IS NULL THEN 'flux_undefined' END, CASE me WHEN 'one_sided' THEN 'dx_one_sided' WHEN 'undefined' THEN 'dx_undefined' END, CASE mn WHEN 'one_sided' THEN 'dy_one_sided' WHEN 'undefined' THEN 'dy_undefined' END, CASE WHEN tm IS NULL THEN 'theta_mu_out_undefined' END, CASE WHEN mag <= 1e-15 THEN 'gradient_zero_orientation_undefined' END], lambda v: v IS NOT NULL), ';') AS flags FROM g1),
gk AS (SELECT * FROM grad WHERE aac IS NOT NULL)"""
GRADIENTS = OUTCOMES + GRAD_CTES
ORACLES["grv_fields"] = text(STATS + GRAD_CTES, "SELECT cell_id, flags AS gradient_quality_flags, " + r6(gradient_across_fraction="frac_", gradient_across="ac * 1e6", abs_across="aac * 1e6", gradient_along="al * 1e6", gradient_magnitude="mag * 1e6") + " FROM grad")
_GF = {"v_ac": "ac", "v_aac": "aac", "v_al": "al", "v_aal": "aal", "v_mag": "mag", "v_fr": "frac_"}
SEGMENTAL = (
    GRADIENTS
    + """, refined AS (SELECT section, (gx + 0.5) * 10.0 AS rx, (gy + 0.5) * 10.0 AS ry FROM frow WHERE i = core_i),
fpts AS (SELECT section, side, fx / 10.0 - 0.5 AS gx, fy / 10.0 - 0.5 AS gy FROM fflank), cpts AS (SELECT f.section, f.side, r.rx / 10.0 - 0.5 AS gx, r.ry / 10.0 - 0.5 AS gy FROM fflank f JOIN refined r ON r.section = f.section)"""
    + corners("fat", "fpts", "section, side", "gk", _GF)
    + corners("cat", "cpts", "section, side", "gk", _GF)
    + """, cls AS (SELECT f.*, c.v_aac AS core_aac, abs(f.gx - round(f.gx)) <= 1e-8 + 1e-5 * abs(round(f.gx)) AND abs(f.gy - round(f.gy)) <= 1e-8 + 1e-5 * abs(round(f.gy)) AS fd, abs(c.gx - round(c.gx)) <= 1e-8 + 1e-5 * abs(round(c.gx)) AND abs(c.gy - round(c.gy)) <= 1e-8 + 1e-5 * abs(round(c.gy)) AS cd FROM fat f LEFT JOIN cat c ON c.section = f.section AND c.side = f.side),
samp AS (SELECT *, CASE WHEN v_aac IS NULL THEN 'gradient_sample_unavailable' WHEN fd THEN 'gradient_sample_direct' ELSE 'gradient_sample_interpolated' END AS fclass, CASE WHEN core_aac IS NULL THEN 'gradient_sample_unavailable' WHEN cd THEN 'gradient_sample_direct' ELSE 'gradient_sample_interpolated' END AS cclass, NOT edge AND (v_ac IS NULL OR v_aac IS NULL OR v_al IS NULL OR v_aal IS NULL OR v_mag IS NULL OR v_fr IS NULL) AS lost FROM cls),
nearby AS (SELECT f.section, f.side, k.aac, k.cell_id, sqrt(pow(k.x - f.fx, 2) + pow(k.y - f.fy, 2)) AS d FROM fflank f JOIN gk k ON sqrt(pow(k.x - f.fx, 2) + pow(k.y - f.fy, 2)) <= 10.0),
top_ AS (SELECT *, max(aac) OVER (PARTITION BY section, side) AS lm FROM nearby), loc AS (SELECT section, side, any_value(lm) AS lm, min(d) AS ld FROM top_ WHERE abs(aac - lm) <= 1e-8 + 1e-5 * abs(lm) GROUP BY section, side),
back_ AS (SELECT f.section, f.side, count(*) AS nb, avg(CASE WHEN k.aac <= s.v_aac THEN 1.0 WHEN s.v_aac IS NOT NULL THEN 0.0 END) AS pct FROM fflank f JOIN refined r ON r.section = f.section JOIN samp s ON s.section = f.section AND s.side = f.side JOIN gk k ON sqrt(pow(k.x - r.rx, 2) + pow(k.y - r.ry, 2)) <= 20.0 GROUP BY f.section, f.side),
segc AS (SELECT f.*, g.num, g.component, g.segment, s.* EXCLUDE (section, side), l.lm, l.ld, coalesce(b.nb, 0) AS nb, b.pct, coalesce(s.core_aac <= 1e-15, FALSE) AS unstable, CASE WHEN NOT coalesce(s.core_aac <= 1e-15, FALSE) THEN s.v_aac / (s.core_aac + 1e-15) END AS ratio_,
 printf('segment_flank_%05d', row_number() OVER (ORDER BY g.num, f.section, f.side) - 1) AS record, concat_ws(';', CASE WHEN f.flags <> '' THEN f.flags END, CASE WHEN s.v_aac IS NULL THEN 'gradient_not_observable' END, CASE WHEN s.edge THEN 'gradient_sample_boundary' END, CASE WHEN s.lost THEN 'gradient_sample_missing_support' END, CASE WHEN s.core_aac IS NULL THEN 'core_gradient_not_observable' END, CASE WHEN s.core_aac <= 1e-15 THEN 'core_gradient_ratio_unstable' END) AS gflags
 FROM fflank f JOIN samp s ON s.section = f.section AND s.side = f.side JOIN (SELECT DISTINCT s2.section, g2.num, g2.component, g2.segment FROM secs s2 JOIN seg g2 ON g2.component = s2.component AND g2.segment = s2.segment AND g2.sequence = s2.sequence) g ON g.section = f.section LEFT JOIN loc l ON l.section = f.section AND l.side = f.side LEFT JOIN back_ b ON b.section = f.section AND b.side = f.side)"""
)
ORACLES["grv_samples"] = text(SEGMENTAL, "SELECT section, side, fclass AS class_front, cclass AS class_core, edge AS boundary_front, lost AS unsupported_front, " + r6(gradient_across_fraction_at_front="v_fr", gradient_across_at_front="v_ac * 1e6", abs_across_at_front="v_aac * 1e6", gradient_along_at_front="v_al * 1e6", gradient_magnitude_at_front="v_mag * 1e6", abs_across_at_core="core_aac * 1e6") + " FROM segc")
ORACLES["grv_surroundings"] = text(SEGMENTAL, "SELECT section, side, nb AS background_cells, " + r6(local_max_distance="ld", local_max_scales="ld / 10.0", percentile="pct", local_max="lm * 1e6") + " FROM segc")
_SEEN = "CASE WHEN v_aac IS NOT NULL THEN 'gradient_observable' ELSE 'gradient_not_observable' END"
ORACLES["grv_segment"] = text(SEGMENTAL, f"SELECT record AS comparison_record_id, section, side, {_SEEN} AS gradient_observability, unstable AS core_ratio_unstable, gflags AS quality_flags, round(ratio_, 6) AS front_to_core_ratio FROM segc")
UNIQUE = SEGMENTAL + """, uniq AS (SELECT cell_id, side, count(*) AS n, string_agg(DISTINCT record, ';' ORDER BY record) AS records, string_agg(DISTINCT section, ';' ORDER BY section) AS sections, string_agg(DISTINCT fclass, ';' ORDER BY fclass) AS classes, max(dist) - min(dist) AS spread, avg(CASE WHEN pers THEN 1.0 ELSE 0.0 END) AS pf, quantile_cont(fx, 0.5) AS fx, quantile_cont(fy, 0.5) AS fy, quantile_cont(dist, 0.5) AS dist, quantile_cont(dropped, 0.5) AS dropped, quantile_cont(v_ac, 0.5) AS v_ac, quantile_cont(v_aac, 0.5) AS v_aac, quantile_cont(core_aac, 0.5) AS core_aac, quantile_cont(pct, 0.5) AS pct, quantile_cont(ld, 0.5) AS ld, list_distinct(flatten(list(string_split(gflags, ';')))) AS fl FROM segc GROUP BY cell_id, side)"""
ORACLES["grv_unique"] = text(
    UNIQUE,
    f"SELECT printf('cell%05d_%s', cell_id, side) AS unique_comparison_id, cell_id, side, n AS n_segment_records, records AS comparison_record_ids, sections AS section_ids, {_SEEN} AS gradient_observability, n > 1 AND spread > 10.0 AS duplicate_flank_disagreement, pf >= 0.5 AS persistent, classes AS sample_classes, array_to_string(list_sort(list_filter(CASE WHEN n > 1 AND spread > 10.0 THEN list_append(fl, 'duplicate_flank_disagreement') ELSE fl END, lambda v: v <> '')), ';') AS quality_flags, "
    + r6(front_x="fx", front_y="fy", distance="dist", distance_spread="spread", percentile="pct", local_max_scales="ld / 10.0", abs_across_at_front="v_aac * 1e6")
    + " FROM uniq",
)
ORACLES["grv_summary"] = text(
    UNIQUE + f""", cellsum AS (SELECT count(*) AS cells, count(u) AS flux_cells, count(aac) AS gradient_cells, {tally(**{f"{n}_{m}_cells": f"{c} = '{m}'" for n, c in (("dx", "me"), ("dy", "mn")) for m in ("centred", "one_sided", "undefined")})}, {r6(**{f"abs_across_q{int(round(100 * q))}": f"quantile_cont(aac, {q}) * 1e6" for q in (0.5, 0.75, 0.9, 0.95)})} FROM grad),
sidesum AS (SELECT count(*) AS cell_sides, {tally(disagreements="n > 1 AND spread > 10.0", observable="v_aac IS NOT NULL", not_observable="v_aac IS NULL")}, {r6(median_at_front="quantile_cont(v_aac, 0.5) * 1e6", median_at_core="quantile_cont(CASE WHEN v_aac IS NOT NULL THEN core_aac END, 0.5) * 1e6", median_percentile="quantile_cont(CASE WHEN v_aac IS NOT NULL THEN pct END, 0.5)", within_half_scale="avg(CASE WHEN v_aac IS NULL THEN NULL WHEN ld / 10.0 <= 0.5 THEN 1.0 ELSE 0.0 END)", within_one_scale="avg(CASE WHEN v_aac IS NULL THEN NULL WHEN ld / 10.0 <= 1.0 THEN 1.0 ELSE 0.0 END)", median_distance_to_max="quantile_cont(CASE WHEN v_aac IS NOT NULL THEN ld END, 0.5)", median_scales_to_max="quantile_cont(CASE WHEN v_aac IS NOT NULL THEN ld / 10.0 END, 0.5)", front_above_core="avg(CASE WHEN v_aac IS NULL OR core_aac IS NULL THEN NULL WHEN v_aac > core_aac THEN 1.0 ELSE 0.0 END)")} FROM uniq),
two_ AS (SELECT cell_id, max(CASE WHEN side = 'left' THEN v_ac END) AS l, max(CASE WHEN side = 'right' THEN v_ac END) AS r FROM uniq GROUP BY cell_id HAVING count(v_ac) = 2), opp AS (SELECT count(*) AS cells_with_both_signs, round(avg(CASE WHEN l * r < 0 THEN 1.0 ELSE 0.0 END), 6) AS opposite_signs FROM two_ WHERE l IS NOT NULL AND r IS NOT NULL),
rk AS (SELECT {_RANK.format('dropped')} AS ra, {_RANK.format('v_aac')} AS rb FROM uniq WHERE v_aac IS NOT NULL)""",
    "SELECT *, (SELECT count(*) FROM segc) AS segment_sides, (SELECT count(*) FROM segc) - cell_sides AS duplicate_records, (SELECT round(corr(ra, rb), 6) FROM rk) AS spearman_loss_gradient FROM cellsum, sidesum, opp",
)
ORACLES["grv_coverage"] = text(
    UNIQUE + ", lv_ AS (SELECT v.level, CASE v.level WHEN 0.9 THEN (SELECT quantile_cont(aac, 0.9) FROM gk) ELSE (SELECT quantile_cont(aac, 0.95) FROM gk) END AS cut FROM (VALUES (0.9), (0.95)) v(level)), big_ AS (SELECT l.level, k.cell_id, EXISTS (SELECT 1 FROM uniq q WHERE sqrt(pow(q.fx - k.x, 2) + pow(q.fy - k.y, 2)) <= 10.0) AS hit FROM gk k JOIN lv_ l ON k.aac >= l.cut)",
    "SELECT level::DOUBLE AS level, count(*) AS cells, count(*) FILTER (WHERE hit) AS with_front, round(count(*) FILTER (WHERE hit) * 1.0 / count(*), 6) AS fraction FROM big_ GROUP BY level",
)

# --- cells on a sphere

_AZ, _BK = _W.format("g.az"), _W.format("g.bk")
ORACLES["geo_cells"] = text(
    GEODESIC
    + f""", gl AS (SELECT l.start_y_bin * 36 + l.start_x_bin AS sid, l.end_y_bin * 36 + l.end_x_bin AS eid, l.n, coalesce(g.dist, 0) AS d, CASE WHEN g.dist IS NOT NULL THEN {_AZ} END AS az, CASE WHEN g.dist IS NOT NULL THEN {_W.format(_BK + ' + 180')} END AS arr
 FROM glinks l LEFT JOIN geo g ON g.ya = l.start_y_bin AND g.yb = l.end_y_bin AND g.dx = (l.end_x_bin - l.start_x_bin + 36) % 36 AND (l.start_x_bin <> l.end_x_bin OR l.start_y_bin <> l.end_y_bin)),
gids AS (SELECT DISTINCT unnest([sid, eid]) AS cell_id FROM gl), gmove AS (SELECT sid AS cell_id, sum(n) AS nm FROM gl WHERE sid <> eid GROUP BY sid), gout AS (SELECT l.sid AS cell_id, sum(l.n * sin(radians(az))) / any_value(m.nm) AS s1, sum(l.n * cos(radians(az))) / any_value(m.nm) AS c1 FROM gl l JOIN gmove m ON m.cell_id = l.sid WHERE l.sid <> l.eid GROUP BY l.sid),
gmu AS (SELECT sid AS cell_id, sqrt(pow(sum(CASE WHEN sid <> eid THEN n * d * sin(radians(az)) ELSE 0 END), 2) + pow(sum(CASE WHEN sid <> eid THEN n * d * cos(radians(az)) ELSE 0 END), 2)) / sum(n) AS mag FROM gl GROUP BY sid),
gin AS (SELECT eid AS cell_id, sum(n * sin(radians(arr))) / sum(n) AS s1, sum(n * cos(radians(arr))) / sum(n) AS c1 FROM gl WHERE sid <> eid GROUP BY eid)""",
    f"""SELECT i.cell_id, coalesce(m.nm, 0)::BIGINT AS "N_out_move", round(least(1, sqrt(o.s1 * o.s1 + o.c1 * o.c1)), 6) AS "R1_out", round({bearing('o.s1', 'o.c1')}, 6) AS theta1_out, round(u.mag, 6) AS mu_out_all_magnitude, round(cos(radians({bearing('o.s1', 'o.c1')} - ({bearing('a.s1', 'a.c1')}))), 6) AS "A_io" FROM gids i LEFT JOIN gmove m ON m.cell_id = i.cell_id LEFT JOIN gout o ON o.cell_id = i.cell_id LEFT JOIN gmu u ON u.cell_id = i.cell_id LEFT JOIN gin a ON a.cell_id = i.cell_id""",
)
ORACLES["src_on_map"] = "SELECT event_id, " + r6(lon="value * 9 + 180 - 360 * floor((value * 9 + 180) / 360) - 180", lat="value - 50.0") + " FROM events WHERE event_id % 13 <> 0 AND value IS NOT NULL"
_R9 = lambda e: f"round({e}, 9)"
_SUPR = "(SELECT t.*, round(u * 1000, 9) AS u9, round(r1, 9) AS r9, round(dmo, 9) AS d9, round(o.dmax / o.dm, 9) AS x9, round(o.lever / o.dm, 9) AS l9 FROM turned t LEFT JOIN outgoing o ON o.cell_id = t.cell_id WHERE n_move >= 3)"
_RHO = lambda a, b: f"(SELECT round(corr(ra, rb), 6) FROM (SELECT {_RANK.format(a)} AS ra, {_RANK.format(b)} AS rb FROM {_SUPR} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
ORACLES["s2_summary"] = text(
    TURNS,
    'SELECT count(r1) AS "cells_with_R1_out", count(th) AS cells_with_theta1_out, count(r2) AS "cells_with_R2_out", count(CASE WHEN r2 > 1e-12 THEN 1 END) AS cells_with_theta2_out, count(r1) AS cells_with_entropy, count(dmo) AS cells_with_delta_theta_mu1_out, '
    + tally(primary_cells="n_move >= 3", sensitivity_cells="n_move >= 5", strong_primary="strong AND n_move >= 3", strong_high_R1="strong AND n_move >= 3 AND r1 >= 0.5", strong_below_high_R1="strong AND n_move >= 3 AND r1 < 0.5", strong_large_difference="strong AND n_move >= 3 AND dmo >= 30", high_R2_low_R1="n_move >= 3 AND r2 >= 0.5 AND r1 <= 0.3", candidate_split="n_move >= 3 AND r1 BETWEEN 0.4 AND 0.85 AND r2 <= 0.3")
    + f', {_RHO("u9", "r9")} AS "spearman_flux_R1", {_RHO("d9", "x9")} AS spearman_difference_distance_ratio, {_RHO("d9", "l9")} AS spearman_difference_leverage FROM turned',
)
ORACLES["s3_residuals"] = 'SELECT 0.0::DOUBLE AS "R1_out_residual", 0.0::DOUBLE AS "R1_in_residual"'
ORACLES["s3_entropy"] = text(MOVES + f", b AS (SELECT eid, {_BIN} AS b, sum(q) AS q FROM moves GROUP BY ALL)", "SELECT eid AS cell_id, " + r6(H_in="-sum(q * ln(q)) / ln(36)", effective_bins_in="exp(-sum(q * ln(q)))") + ", count(*) AS occupied_bins_in FROM b GROUP BY eid")
_EVAL = "CASE WHEN lv IS NOT NULL AND rv IS NOT NULL THEN 'two_sided_evaluable' WHEN lv IS NOT NULL THEN 'one_sided_evaluable_left' WHEN rv IS NOT NULL THEN 'one_sided_evaluable_right' ELSE 'no_transverse_side_evaluable' END"
_LABELS = RIDGE + f""", lab AS (SELECT r.*, s.tm, s.u, s.r1, {apart('s.tm', 's.th')} AS dmo, {_TYPE.format(chr(39) + 'x' + chr(39))} AS t, {_MISS} AS ms, le OR re AS edge, (lv IS NULL AND NOT le) OR (rv IS NULL AND NOT re) AS lost FROM fl_r r JOIN sup s ON s.cell_id = r.cell_id),
lab2 AS (SELECT *, tm IS NOT NULL AND ms NOT IN ('none', 'left', 'right') AND NOT edge AND NOT lost AS bad, u >= (SELECT quantile_cont(u, 0.9) FROM sup) AS high FROM lab)"""
ORACLES["rdg_labels"] = text(
    _LABELS,
    f"""SELECT cell_id, {_EVAL} AS evaluability, CASE t WHEN 'two_sided' THEN 'two_sided_branch_core' WHEN 'one_sided' THEN 'one_sided_branch_core' ELSE 'not_branch_core' END AS observability, CASE WHEN t = 'two_sided' THEN 'both_sides_observable' WHEN t = 'one_sided' AND ms = 'left' THEN 'left_flank_not_observable' WHEN t = 'one_sided' THEN 'right_flank_not_observable' ELSE 'not_branch_core' END AS flank_observability,
 CASE WHEN t = 'two_sided' THEN 'two_sided_transverse_ridge_candidate' WHEN t = 'one_sided' THEN 'one_sided_transverse_ridge_candidate' WHEN tm IS NULL THEN 'theta_mu_out_undefined' WHEN edge THEN 'analysis_domain_boundary' WHEN lost THEN 'transverse_sample_unsupported_or_missing' WHEN bad THEN 'interpolation_not_defensible' ELSE 'evaluated_not_transverse_maximum' END AS reason,
 tm IS NULL AS reason_theta_mu_out_undefined, edge AS reason_transverse_domain_boundary, lost AS reason_transverse_sample_unsupported_or_missing, bad AS reason_interpolation_not_defensible, coalesce(r1 >= 0.8, FALSE) AND coalesce(dmo <= 20, FALSE) AND tm IS NOT NULL AS orientation_reliable, coalesce(r1 < 0.5, FALSE) OR tm IS NULL AS orientation_ambiguous, t <> 'x' AND high AS core, t = 'two_sided' AND high AS core_two_sided, t = 'one_sided' AND high AS core_one_sided, """
    + r6(C_perp_normalized="(v - (lv + rv) / 2) / v", C_perp_one_sided_normalized="CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN (v - coalesce(lv, rv)) / v END", C_perp="(v - (lv + rv) / 2) * 1000", C_perp_one_sided="CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN (v - coalesce(lv, rv)) * 1000 END")
    + " FROM lab2",
)
_SMOOTH = STATS.replace("sup AS (SELECT * FROM stats WHERE n_move >= 3)", f"sup0 AS (SELECT * FROM stats WHERE n_move >= 3), sup AS (SELECT a.*, (SELECT avg(b.u) FROM sup0 b WHERE {_NEAR}) AS s0 FROM sup0 a)") + _SIDE.format(n="fl", v="s0", t="tm", src="sup", f="s0")
ORACLES["rdg_smoothed"] = text(
    _SMOOTH + f", lab AS (SELECT r.*, s.tm, {_TYPE.format(chr(39) + 'not_ridge' + chr(39))} AS t, {_MISS} AS ms, le OR re AS edge, (lv IS NULL AND NOT le) OR (rv IS NULL AND NOT re) AS lost, (SELECT quantile_cont(s0, 0.9) FROM sup) AS cut FROM fl_r r JOIN sup s ON s.cell_id = r.cell_id)",
    "SELECT cell_id, t AS ridge_type, t = 'two_sided' AS candidate, t = 'two_sided' AND v >= cut AS core, CASE WHEN t = 'two_sided' THEN 'transverse_ridge_candidate' WHEN tm IS NULL THEN 'theta_mu_out_undefined' WHEN edge THEN 'analysis_domain_boundary' WHEN lost THEN 'transverse_sample_unsupported_or_missing' WHEN ms <> 'none' THEN 'interpolation_not_defensible' ELSE 'evaluated_not_transverse_maximum' END AS reason, " + r6(S0_field_rate="v * 1000", threshold="cut * 1000") + " FROM lab",
)
_CLASS = "CASE WHEN edge THEN 'missing_because_of_boundary' WHEN u IS NULL THEN 'missing_because_of_support' WHEN i = 0 THEN 'direct_grid_information' ELSE 'interpolated' END"
_AT_FLUX = {"u": "u", "um": "um", "pm": "pm", "r1": "r1", "r2": "r2", "dmo": "dmo", "n_move": "n_move", "n_in": "n_in_move", "r1i": "r1i"}
ORACLES["sec_samples"] = text(
    TURNS.replace("obs AS", "RECURSIVE obs AS", 1) + FPROFILES[FPROFILES.index(", fl AS (") :].replace("WITH ", "") + ", supx AS (SELECT t.*, sqrt(pow(k.sx, 2) + pow(k.sy, 2)) / t.n_move / 86400.0 AS um FROM turned t LEFT JOIN tot k ON k.sid = t.cell_id WHERE t.n_move >= 3), pts_ AS (SELECT cell_id, i, gx, gy FROM seen)" + corners("sam", "pts_", "cell_id, i", "supx", {f"a_{a}": f for a, f in _AT_FLUX.items()}),
    f"SELECT s.cell_id, s.i::INTEGER AS i, {_CLASS.replace('edge', 's.edge').replace('u IS', 's.u IS').replace('i = 0', 's.i = 0')} AS sample_class, "
    + r6(at_P_move="a_pm", at_R1_out="a_r1", at_R2_out="a_r2", at_delta_theta_mu1_out="a_dmo", at_N_out_move="a_n_move", at_N_in_move="a_n_in", at_R1_in="a_r1i", at_U_out_all_magnitude_rate="a_u * 1000", at_U_out_move_magnitude_rate="a_um * 1000")
    + " FROM seen s JOIN sam m ON m.cell_id = s.cell_id AND m.i = s.i",
)
ORACLES["dfr_samples"] = text(
    PROFILES + ", supd AS (SELECT * FROM sup WHERE dxx IS NOT NULL), pts_ AS (SELECT cell_id, i, gx, gy FROM prof)" + corners("sam", "pts_", "cell_id, i", "supd", {"a_dm": "dm", "a_pm": "pm", "a_r1": "r1", "a_n": "n_move"}),
    f"SELECT s.cell_id, s.i::INTEGER AS i, {_CLASS.replace('edge', 's.edge').replace('u IS', 's.u IS').replace('i = 0', 's.i = 0')} AS sample_class, " + r6(at_D_out_all_magnitude="a_dm", at_P_move="a_pm", at_R1_out="a_r1", at_N_out_move="a_n") + " FROM prof s JOIN sam m ON m.cell_id = s.cell_id AND m.i = s.i",
)

# Long tracks in parts, and graphs in rounds, give what whole tracks and graphs in one task give.
for _part, _whole in (("san_parts", "san_sanitise"), ("mat_parts_nonoverlap", "mat_links_nonoverlap"), ("mat_parts_every_obs", "mat_links_every_obs"), ("mat_parts_gaps", "mat_gap_rejects"), ("grf_components_rounds", "grf_components"), ("grf_segments_ranked", "grf_segments")):
    ORACLES[_part] = ORACLES[_whole]

_R = 6370.997
ORACLES["geo_direct"] = f"""WITH e AS (SELECT event_id, radians(value * 0.5 - 40.0) AS lon, radians(value - 60 * floor(value / 60) - 30.0) AS lat, radians(event_id * 37 % 360) AS b, (event_id % 5000 + 0.5) / {_R} AS d FROM events),
p AS (SELECT event_id, degrees(lon + atan2(sin(b) * sin(d) * cos(lat), cos(d) - sin(lat) * (sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b)))) + 180 AS lon, degrees(asin(sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b))) AS lat FROM e)
SELECT event_id, round(lon - 360 * floor(lon / 360) - 180, 6) AS lon, round(lat, 6) AS lat FROM p"""
ORACLES["src_csv"] = """SELECT user_id::VARCHAR AS trajectory, count(*) AS observations, round(sum(epoch_us(ts) / 1e6) / count(*), 3) AS mean_time, round(avg(value), 6) AS x, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS y FROM events GROUP BY user_id"""
_ARRAYS = """SELECT user_id::DOUBLE AS trajectory, count(*) AS observations, sum(place % 1000)::BIGINT AS places, round(sum(epoch_us(ts) / 1e6) / count(*), 3) AS mean_time, round(sum(value), 3) AS sum_x, round(sum(k), 3) AS sum_y
FROM (SELECT *, json_extract(props, '$.k')::DOUBLE AS k, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) {} GROUP BY user_id"""
ORACLES["src_zarr"] = _ARRAYS.format("WHERE value BETWEEN 5 AND 60 AND k <= 75")
ORACLES["src_netcdf"] = _ARRAYS.format("")
ORACLES["src_parquet"] = """SELECT count(*) AS observations, round(min(value)::DOUBLE, 6) AS least_x, round(max(json_extract(props, '$.k')::DOUBLE), 6) AS greatest_y FROM events GROUP BY user_id % 2"""
_TYPES = {"tracks": "string,double,double,double", "segments": "string,bigint,struct<status:string,x:double,y:double>,struct<status:string,x:double,y:double>,bigint", "matrix": ",".join(["bigint"] * 4 + ["double"] * 4 + ["bigint", "double"])}
_ROWS = {"tracks": "(SELECT count(*) FROM tracks)", "segments": "(SELECT count(*) FROM segs)", "matrix": "(SELECT count(*) FROM links)"}
ORACLES["san_typed"] = text(LINKS, " UNION ALL ".join(f"SELECT '{given}' AS given, '{made}' AS made, '{types}' AS types, {_ROWS[made] if given == 'all' else '0::BIGINT'} AS n_rows" for given in ("none", "all") for made, types in _TYPES.items()))
ORACLES["val_schema"] = text(LINKS, """SELECT start_x_bin, start_y_bin, end_x_bin, end_y_bin, v.case_name, v.errors FROM links, (VALUES ('good', ''), ('lacking', 'missing_columns:end_y_bin,start_x_center'), ('types', 'invalid_dtype:end_x_bin;invalid_dtype:transition_count')) v(case_name, errors)""")
