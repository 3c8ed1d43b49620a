"""Structure of dated masks and movement of contours: parts and holes by scene, the connected channel, boundary distances, migration."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import cells as C
from ..operators import labels as LB
from ..operators import scenes as SC
from ..operators import spatial as P
from ..session import cut_lineage
from . import standins as S
from .q_cells import field
from .registry import Tables, query
from .standins import r6

_O4 = "(VALUES (1,0),(-1,0),(0,1),(0,-1)) AS o(dr, dc)"
_O8 = "(VALUES (1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1)) AS o(dr, dc)"
_GRID = "fr AS (SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col FROM (SELECT unnest(range(0, (SELECT max(p_partkey) + 1 FROM part))) AS r), (SELECT unnest(range(10)) AS c))"


def last_row(t: Tables) -> int:
    return t.part.agg(F.max("p_partkey").alias("m")).first().m


@query("ras_scene_structure", "RAS-33", f"""WITH RECURSIVE {S.CELLS}, {_GRID}, qm AS MATERIALIZED (SELECT DISTINCT year * 4 + quarter(day) AS sc, row, col FROM cl WHERE water = 1),
 qe AS MATERIALIZED (SELECT a.sc, a.row * 16 + a.col AS s, b.row * 16 + b.col AS d FROM qm a CROSS JOIN {_O8} JOIN qm b ON b.sc = a.sc AND b.row = a.row + dr AND b.col = a.col + dc),
 cc(sc, id, label) AS (SELECT sc, row * 16 + col, row * 16 + col FROM qm UNION SELECT qe.sc, qe.d, cc.label FROM cc JOIN qe ON cc.sc = qe.sc AND cc.id = qe.s AND cc.label < qe.d),
 pt AS (SELECT sc, label, count(*) AS n FROM (SELECT sc, id, min(label) AS label FROM cc GROUP BY 1, 2) GROUP BY 1, 2),
 iv AS MATERIALIZED (SELECT s.sc, fr.row, fr.col FROM (SELECT DISTINCT sc FROM qm) s, fr EXCEPT SELECT sc, row, col FROM qm),
 ie AS MATERIALIZED (SELECT a.sc, a.row * 16 + a.col AS s, b.row * 16 + b.col AS d FROM iv a CROSS JOIN {_O4} JOIN iv b ON b.sc = a.sc AND b.row = a.row + dr AND b.col = a.col + dc WHERE b.col BETWEEN 1 AND 8),
 rc(sc, id) AS (SELECT sc, row * 16 + col FROM iv WHERE col IN (0, 9) OR row IN (0, (SELECT max(p_partkey) FROM part)) UNION SELECT ie.sc, ie.d FROM rc JOIN ie ON rc.sc = ie.sc AND rc.id = ie.s),
 ho AS (SELECT sc, count(*) AS n FROM iv WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.sc = iv.sc AND rc.id = iv.row * 16 + iv.col) GROUP BY 1)
 SELECT CAST(pt.sc AS BIGINT) AS scene, count(*) AS parts, round(max(pt.n)::DOUBLE / sum(pt.n)::DOUBLE, 6) AS largest_share, coalesce(max(ho.n), 0) AS hole_cells, round(coalesce(max(ho.n), 0)::DOUBLE / sum(pt.n)::DOUBLE, 6) AS hole_share
 FROM pt LEFT JOIN ho ON ho.sc = pt.sc GROUP BY 1""")
def _(t: Tables):
    m = S.cells(t).where("water = 1").select((F.col("year") * 4 + F.quarter("day")).cast("long").alias("scene"), "row", "col")
    g = SC.scene_structure(m, ["scene"], F.col("scene"), (0, last_row(t), 0, 9))
    return g.select("scene", "parts", r6(F.col("largest_share")).alias("largest_share"), "hole_cells", r6(F.col("hole_share")).alias("hole_share"))


_TOL = 4


@query("ras_channel_connectivity", "RAS-12 WIN-15", f"""WITH RECURSIVE {S.CELLS}, ob AS (SELECT DISTINCT year // 3 AS sc, row, col FROM cl WHERE water IS NOT NULL), wm AS MATERIALIZED (SELECT DISTINCT year // 3 AS sc, row, col FROM cl WHERE water = 1),
 we AS MATERIALIZED (SELECT a.sc, a.row * 16 + a.col AS s, b.row * 16 + b.col AS d FROM wm a CROSS JOIN {_O8} JOIN wm b ON b.sc = a.sc AND b.row = a.row + dr AND b.col = a.col + dc),
 mn(sc, id) AS (SELECT sc, arg_min(row * 16 + col, (row * row + (col - 5) * (col - 5), row, col)) FROM wm GROUP BY 1 UNION SELECT we.sc, we.d FROM mn JOIN we ON mn.sc = we.sc AND mn.id = we.s),
 nd AS (SELECT p_partkey AS row, abs(p_partkey * 7 % 18 - 9) AS col, p_partkey // 20 AS k FROM part),
 pr AS (SELECT ob.sc, nd.k, count(*) AS o, count(wm.row) AS w, count(mn.id) AS m FROM nd JOIN ob USING (row, col) LEFT JOIN wm ON wm.sc = ob.sc AND wm.row = ob.row AND wm.col = ob.col LEFT JOIN mn ON mn.sc = ob.sc AND mn.id = ob.row * 16 + ob.col GROUP BY 1, 2),
 al AS (SELECT s.sc, k.k, v.v, CASE WHEN v.v = 0 THEN CASE WHEN coalesce(m, 0) > 0 THEN 1 ELSE 0 END ELSE CASE WHEN coalesce(o, 0) > 0 THEN 1 ELSE 0 END END AS c FROM (SELECT DISTINCT sc FROM ob) s, (SELECT unnest(range(0, (SELECT max(p_partkey) // 20 + 1 FROM part))) AS k) k, (SELECT unnest(range(2)) AS v) v LEFT JOIN pr ON pr.sc = s.sc AND pr.k = k.k),
 g AS (SELECT *, sum(c) OVER (PARTITION BY sc, v ORDER BY k ROWS UNBOUNDED PRECEDING) AS grp FROM al), r AS (SELECT *, row_number() OVER (PARTITION BY sc, v, grp ORDER BY k) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS gap FROM g),
 h AS (SELECT *, sum(CASE WHEN gap * 2 > {_TOL} THEN 1 ELSE 0 END) OVER (PARTITION BY sc, v ORDER BY k ROWS UNBOUNDED PRECEDING) AS hits FROM r),
 e AS (SELECT sc, v, coalesce(max(CASE WHEN c = 1 AND hits = 0 THEN (k + 1) * 2.0 END), 0) AS reach, max(CASE WHEN hits = 0 OR hits = 1 AND gap * 2 > {_TOL} THEN gap * 2.0 END) AS mg FROM h GROUP BY 1, 2),
 tt AS (SELECT sc, CAST(sum(o) AS BIGINT) AS o, CAST(sum(w) AS BIGINT) AS w, CAST(sum(m) AS BIGINT) AS m FROM pr GROUP BY 1)
 SELECT CAST(a.sc AS BIGINT) AS scene, tt.o AS n_observable, tt.w AS n_on_water, tt.m AS n_in_main, CAST(a.reach AS DOUBLE) AS connected_km, CAST(b.reach AS DOUBLE) AS observable_km, CAST(a.mg AS DOUBLE) AS max_gap_km, coalesce(round(a.reach::DOUBLE / b.reach::DOUBLE, 6), -1.0) AS connected_fraction
 FROM e a JOIN e b ON a.sc = b.sc AND a.v = 0 AND b.v = 1 JOIN tt ON tt.sc = a.sc""")
def _(t: Tables):
    hi = last_row(t)
    c = S.cells(t).withColumn("scene", F.floor(F.col("year") / 3))
    wet = c.where("water = 1").select("scene", "row", "col").distinct()
    lab = cut_lineage(LB.label_cells(wet, 16, 8, ["scene"], F.col("scene"), (hi + 1) * 16))
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("row"), F.abs(k * 7 % 18 - 9).alias("col"), (k / 10).alias("chain_km"))
    seen = c.where("water is not null").select("scene", "row", "col").distinct()
    g = SC.channel_connectivity(lab, seen, nodes, ["scene"], (0, 5), 2.0, hi // 20 + 1, float(_TOL))
    return g.withColumn("connected_fraction", F.coalesce(r6(F.col("connected_fraction")), F.lit(-1.0)))


def _blocks(name: str, source: str, level: float) -> str:
    """2x2 blocks of a field (row, col, z) about a level."""
    return (f"{name} AS MATERIALIZED (SELECT a.row, a.col, a.z - {level} AS a, b.z - {level} AS b, c.z - {level} AS c, d.z - {level} AS d FROM {source} a JOIN {source} b ON b.row = a.row AND b.col = a.col + 1"
            f" JOIN {source} c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN {source} d ON d.row = a.row + 1 AND d.col = a.col)")


def _segments(name: str, blocks: str) -> str:
    """Contour segments of blocks (row, col, seg, x1, y1, x2, y2), their middle (x, y) and length."""
    at = {"T": ("col + a / (a - b)", "row::DOUBLE"), "R": ("col + 1::DOUBLE", "row + b / (b - c)"), "B": ("col + d / (d - c)", "row + 1::DOUBLE"), "L": ("col::DOUBLE", "row + a / (a - d)")}
    first = {"L": (1, 14, 3, 12, 5), "T": (2, 13, 6, 9, 10), "R": (4, 11), "B": (8, 7)}
    second = {"T": (1, 14, 5), "R": (2, 13, 10, 3, 12), "B": (4, 11, 6, 9), "L": (8, 7)}
    pick = lambda ends, i: "CASE " + " ".join(f"WHEN k IN ({','.join(map(str, v))}) THEN {at[e][i]}" for e, v in ends.items()) + " END"
    extra = lambda e5, e10, i: f"CASE k WHEN 5 THEN {at[e5][i]} ELSE {at[e10][i]} END"
    return f"""{name} AS MATERIALIZED (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM (
 SELECT row, col, 0 AS seg, {pick(first, 0)} AS x1, {pick(first, 1)} AS y1, {pick(second, 0)} AS x2, {pick(second, 1)} AS y2 FROM (SELECT *, {_CODE} AS k FROM {blocks}) WHERE k BETWEEN 1 AND 14
 UNION ALL SELECT row, col, 1, {extra('R', 'B', 0)}, {extra('R', 'B', 1)}, {extra('B', 'L', 0)}, {extra('B', 'L', 1)} FROM (SELECT *, {_CODE} AS k FROM {blocks}) WHERE k IN (5, 10)))"""


_CODE = "(CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 2 ELSE 0 END + CASE WHEN c > 0 THEN 4 ELSE 0 END + CASE WHEN d > 0 THEN 8 ELSE 0 END)"


def _near(name: str, points: str, segments: str) -> str:
    return f"""{name} AS (SELECT p.row, p.col, p.seg, min(sqrt(pow(p.x - (s.x1 + t * (s.x2 - s.x1)), 2) + pow(p.y - (s.y1 + t * (s.y2 - s.y1)), 2))) AS dist FROM {points} p JOIN {segments} s ON true,
 LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))) ELSE 0.0 END AS t) GROUP BY 1, 2, 3)"""


def _inside(name: str, points: str, blocks: str, segments: str) -> str:
    return f"""{name} AS (SELECT p.row, p.col, p.seg, CASE WHEN b.a IS NOT NULL THEN (CASE WHEN (b.a > 0) = (b.d > 0) THEN b.a > 0 ELSE (p.y - b.row < b.a / (b.a - b.d)) = (b.a > 0) END) = ((SELECT count(*) FROM {segments} s WHERE s.row = b.row AND s.col = b.col AND (s.y1 > p.y) <> (s.y2 > p.y) AND s.x1 + (p.y - s.y1) * (s.x2 - s.x1) / (s.y2 - s.y1) < p.x) % 2 = 0) END AS inside
 FROM {points} p LEFT JOIN {blocks} b ON b.row = floor(p.y) AND b.col = floor(p.x))"""


_FD = "fd AS (SELECT row, col, avg(qty) AS z FROM cl GROUP BY 1, 2)"


@query("ras_boundary_distance", "RAS-31", f"""WITH {S.CELLS}, {_FD}, {_blocks('b1', 'fd', 25.3)}, {_blocks('b2', 'fd', 27.3)}, {_segments('s1', 'b1')}, {_segments('s2', 'b2')}, {_near('n1', 's1', 's2')}, {_near('n2', 's2', 's1')}, {_inside('i1', 's1', 'b2', 's2')}, {_inside('i2', 's2', 'b1', 's1')},
 al AS (SELECT 'first' AS direction, s1.len, dist, CASE WHEN inside THEN -dist WHEN NOT inside THEN dist END AS signed FROM s1 LEFT JOIN n1 USING (row, col, seg) LEFT JOIN i1 USING (row, col, seg)
  UNION ALL SELECT 'second', s2.len, dist, CASE WHEN inside THEN dist WHEN NOT inside THEN -dist END FROM s2 LEFT JOIN n2 USING (row, col, seg) LEFT JOIN i2 USING (row, col, seg)), bo AS (SELECT * FROM al UNION ALL SELECT 'both', len, dist, signed FROM al)
 SELECT direction, count(*) AS n, round(sum(CASE WHEN signed IS NULL THEN len ELSE 0 END) / sum(len), 6) AS unpaired_share, round(sum(signed * len) / sum(CASE WHEN signed IS NOT NULL THEN len END), 6) AS mean_signed, round(sum(CASE WHEN abs(signed) <= 1 THEN len ELSE 0 END) / sum(len), 6) AS within_1,
  round(max(dist), 6) AS hausdorff, round(median(signed), 6) AS signed_p50, round(median(dist), 6) AS p50, round(quantile_cont(dist, 0.9), 6) AS p90, round(quantile_cont(dist, 0.95), 6) AS p95 FROM bo GROUP BY 1""")
def _(t: Tables):
    corners = cut_lineage(C.corner_blocks(field(t), "z"))
    b1, b2 = (corners.select("row", "col", *[(F.col(c) - level).alias(c) for c in "abcd"]) for level in (25.3, 27.3))
    s1, s2 = (C.block_segments(b) for b in (b1, b2))
    d = cut_lineage(SC.boundary_distances(s1, s2, b1, b2))
    d = d.unionByName(d.withColumn("direction", F.lit("both")))
    w = lambda cond, value="len": F.sum(F.when(cond, F.col(value)).otherwise(0.0)) / F.sum("len")
    known = F.col("signed").isNotNull()
    g = B.summarise(d, ["direction"], {"n": F.count(F.lit(1)), "unpaired_share": w(~known), "mean_signed": F.sum(F.col("signed") * F.col("len")) / F.sum(F.when(known, F.col("len"))),
                                       "within_1": w(F.abs("signed") <= 1), "hausdorff": F.max("dist")}, {"signed_p50": ("signed", 0.5), "p50": ("dist", 0.5), "p90": ("dist", 0.9), "p95": ("dist", 0.95)})
    return g.select("direction", "n", *[r6(F.col(c)).alias(c) for c in ("unpaired_share", "mean_signed", "within_1", "hausdorff", "signed_p50", "p50", "p90", "p95")])


# the caller's surface heights of the three periods, metres, and the radius in which two steps are compared, cells
HEIGHTS, NEIGHBOUR, FACTOR = (16.0, 16.5, 17.25), 25.0, 2.0
_PERIOD = "CASE WHEN year <= 1993 THEN 0 WHEN year <= 1995 THEN 1 ELSE 2 END"


def _moved(k: int) -> str:
    """CTEs of step k: vertices with normals, lines traced sample by sample, the rate."""
    e, l = f"e{k}", f"e{k + 1}"
    bil = f"(({l}.a * (1 - (px - {l}.col)) + {l}.b * (px - {l}.col)) * (1 - (py - {l}.row)) + ({l}.d * (1 - (px - {l}.col)) + {l}.c * (px - {l}.col)) * (py - {l}.row))"
    return f"""{_segments(f's{k}', e)}, g{k} AS (SELECT s.row, s.col, seg, x, y, len, (b - a) * (1 - (y - s.row)) + (c - d) * (y - s.row) AS gx, (d - a) * (1 - (x - s.col)) + (c - b) * (x - s.col) AS gy FROM s{k} s JOIN {e} USING (row, col)),
 v{k} AS MATERIALIZED (SELECT row * 32 + col * 2 + seg AS vid, x, y, len, gx / sqrt(gx * gx + gy * gy) AS ux, gy / sqrt(gx * gx + gy * gy) AS uy FROM g{k} WHERE gx * gx + gy * gy > 0),
 t{k}(vid, x, y, ux, uy, k, pf, f) AS (SELECT vid, x, y, ux, uy, 0, NULL::DOUBLE, {bil} FROM (SELECT *, x AS px, y AS py FROM v{k}) q JOIN {l} ON {l}.row = floor(py) AND {l}.col = floor(px)
  UNION ALL SELECT vid, x, y, ux, uy, k, pf, {bil} FROM (SELECT vid, x, y, ux, uy, k + 1 AS k, f AS pf, x + ux * (k + 1) / 4 AS px, y + uy * (k + 1) / 4 AS py FROM t{k} WHERE f < 0) q JOIN {l} ON {l}.row = floor(py) AND {l}.col = floor(px)),
 h{k} AS (SELECT vid, max(CASE WHEN k = 0 THEN f END) AS start, max(CASE WHEN k > 0 AND f >= 0 THEN (k - 1 + pf / (pf - f)) / 4 END) AS dist FROM t{k} GROUP BY 1),
 m{k} AS MATERIALIZED (SELECT v{k}.vid, x, y, len, CASE WHEN start IS NULL OR start >= 0 THEN 'NOT_NESTED' WHEN dist IS NULL THEN 'NO_CROSSING' ELSE 'OK' END AS flag, CASE WHEN start < 0 THEN dist / {HEIGHTS[k + 1] - HEIGHTS[k]} END AS rate FROM v{k} LEFT JOIN h{k} USING (vid)),
 u{k} AS (SELECT '{k}' AS step, count(*) AS n, sum(CASE WHEN flag = 'OK' THEN len ELSE 0 END) / sum(len) AS ok_length, sum(CASE WHEN flag = 'NOT_NESTED' THEN len ELSE 0 END) / sum(len) AS not_nested_length, sum(CASE WHEN flag = 'NO_CROSSING' THEN len ELSE 0 END) / sum(len) AS no_crossing_length,
  median(rate) AS k_median, quantile_cont(rate, 0.25) AS k_p25, quantile_cont(rate, 0.75) AS k_p75, quantile_cont(rate, 0.9) AS k_p90, -1.0::DOUBLE AS agree_share FROM m{k})"""


_MOVE = ("ok_length", "not_nested_length", "no_crossing_length", "k_median", "k_p25", "k_p75", "k_p90", "agree_share")


@query("ras_migration", "RAS-32", f"""WITH RECURSIVE {S.CELLS}, pz AS (SELECT {_PERIOD} AS p, row // 4 AS row, col, avg(qty) AS z FROM cl GROUP BY 1, 2, 3), """ + ", ".join(f"z{k} AS (SELECT row, col, z FROM pz WHERE p = {k}), {_blocks(f'e{k}', f'z{k}', 25.3)}" for k in range(3)) + f""", {_moved(0)}, {_moved(1)},
 nn AS (SELECT a.vid, any_value(a.rate) AS k1, arg_min(b.rate, (pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.vid)) AS k2, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM m0 a JOIN m1 b ON abs(floor(a.y / 25) - floor(b.y / 25)) <= 1 WHERE a.flag = 'OK' AND b.flag = 'OK' GROUP BY 1),
 ag AS (SELECT *, CASE WHEN greatest(k1, k2) / greatest(least(k1, k2), 1e-6) <= {FACTOR} THEN 0.5 * (k1 + k2) END AS k FROM nn WHERE d <= {NEIGHBOUR}),
 un AS (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT 'both', count(k), -1.0, -1.0, -1.0, median(k), quantile_cont(k, 0.25), quantile_cont(k, 0.75), quantile_cont(k, 0.9), avg(CASE WHEN k IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE FROM ag)
 SELECT step, n, """ + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _MOVE) + " FROM un")
def _(t: Tables):
    """Two steps between three periods: flags and rates along the earlier contour's normals, and where both steps agree."""
    c = S.cells(t)
    period = F.when(F.col("year") <= 1993, 0).when(F.col("year") <= 1995, 1).otherwise(2)
    z = cut_lineage(c.groupBy(period.alias("p"), F.floor(F.col("row") / 4).alias("row"), "col").agg(F.avg("qty").alias("z")))
    e = [cut_lineage(C.corner_blocks(z.where(F.col("p") == k), "z", 25.3)) for k in range(3)]
    m = [cut_lineage(SC.movement(e[k], e[k + 1], HEIGHTS[k + 1] - HEIGHTS[k])) for k in range(2)]
    rows = [SC.step_summary(m[k]).withColumn("step", F.lit(str(k))).withColumn("agree_share", F.lit(-1.0)) for k in range(2)]
    vid = F.col("vid.row") * 32 + F.col("vid.col") * 2 + F.col("vid.seg")
    ok = [x.where("flag = 'OK'").select(vid.alias(f"v{k}"), F.col("x").alias("ab"[k] + "x"), F.col("y").alias("ab"[k] + "y"), F.col("rate").alias(f"k{k}")) for k, x in enumerate(m)]
    if ok[0].isEmpty() or ok[1].isEmpty():
        near = ok[0].limit(0).select("v0", F.col("k0").alias("k1"), F.col("k0").alias("k2"))
    else:
        near = P.knn(ok[0], ok[1], 1, "v0", "v1", ["k1"]).where(F.col("dist") <= NEIGHBOUR).select("v0", F.col("k1").alias("k2")).join(ok[0].select("v0", F.col("k0").alias("k1")), "v0")
    ratio = F.greatest("k1", "k2") / F.greatest(F.least("k1", "k2"), F.lit(1e-6))
    both = near.withColumn("k", F.when(ratio <= FACTOR, 0.5 * (F.col("k1") + F.col("k2"))))
    s = B.summarise(both, [], {"n": F.count("k"), "agree_share": F.avg(F.col("k").isNotNull().cast("double"))}, {"k_median": ("k", 0.5), "k_p25": ("k", 0.25), "k_p75": ("k", 0.75), "k_p90": ("k", 0.9)})
    s = s.withColumn("step", F.lit("both")).withColumns({c: F.lit(-1.0) for c in ("ok_length", "not_nested_length", "no_crossing_length")})
    out = rows[0].unionByName(rows[1]).unionByName(s.select(rows[0].columns))
    return out.select("step", "n", *[r6(F.col(c)).alias(c) for c in _MOVE])
