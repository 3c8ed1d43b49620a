"""Scene structure, connected channel, boundary distances and contour movement against brute force on small grids."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import cells as C
from tidewright.operators import labels as LB
from tidewright.operators import scenes as SC


def parts(cells, conn):
    """Components of a set of cells."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            own.add((r, c))
            for dr, dc in near:
                if (r + dr, c + dc) in left:
                    left.remove((r + dr, c + dc))
                    todo.append((r + dr, c + dc))
        out.append(own)
    return out


@pytest.mark.parametrize("tile", [3, 4, 256])
def test_scene_structure(spark, tile):
    rng = random.Random(tile)
    box = (2, 14, -3, 9)
    grid = [(r, c) for r in range(2, 15) for c in range(-3, 10)]
    scenes = {s: {x for x in grid if rng.random() < p} for s, p in ((1, 0.5), (2, 0.75), (3, 0.3), (4, 1.0))}
    scenes[5] = {(r, c) for r in range(4, 13) for c in range(0, 8) if r in (4, 12) or c in (0, 7)}  # a ring around dry tiles
    rows = [(s, r, c) for s, m in scenes.items() for r, c in m] + [(5, 4, 0), (5, 99, 0)]  # a repeat, a cell beyond the frame
    got = {r.scene: r for r in SC.scene_structure(spark.createDataFrame(rows, "scene long, row long, col long"), ["scene"], F.col("scene"), box, tile).collect()}
    for s, m in scenes.items():
        p = parts(m, 8)
        at_frame = lambda q: any(r in box[:2] or c in box[2:] for r, c in q)
        holes = sum(len(q) for q in parts(set(grid) - m, 4) if not at_frame(q))
        assert (got[s].parts, got[s].hole_cells) == (len(p), holes)
        assert got[s].largest_share == pytest.approx(max(map(len, p)) / len(m)) and got[s].hole_share == pytest.approx(holes / len(m))
    assert SC.scene_structure(spark.createDataFrame([], "scene long, row long, col long"), ["scene"], F.col("scene"), box, tile).count() == 0


def test_scene_tiles_of_a_narrow_frame_are_longer(spark, monkeypatch):
    """Parts by runs; a strip of 200 x 3 is cut into 10 tiles of 21 rows, and only cells beside another tile leave a tile."""
    rng = random.Random(3)
    box = (5, 204, 2, 4)
    grid = [(r, c) for r in range(5, 205) for c in range(2, 5)]
    m = {x for x in grid if rng.random() < 0.6}
    for conn in (4, 8):
        _, _, _, of = SC._runs(np.array([[(r, c) in m for r in range(5, 205)] for c in range(2, 5)]), conn)
        assert of.max() + 1 == len(parts(m, conn))
    kept, cut = [], SC.cut_lineage
    monkeypatch.setattr(SC, "cut_lineage", lambda d: kept.append(cut(d)) or kept[-1])
    df = spark.createDataFrame([(1, r, c) for r, c in m], "scene long, row long, col long")
    got = SC.scene_structure(df, ["scene"], F.col("scene"), box, 8).first()
    holes = sum(len(q) for q in parts(set(grid) - m, 4) if not any(r in box[:2] or c in box[2:] for r, c in q))
    assert (got.parts, got.hole_cells) == (len(parts(m, 8)), holes) and got.largest_share == pytest.approx(max(map(len, parts(m, 8))) / len(m))
    assert kept[0].select("tr", "tc").distinct().count() == 10 and kept[0].where("n < 0").count() == 9 * 2 * 3


def walk(flags, width, tolerance):
    reach = gap = most = 0.0
    for i, c in enumerate(flags):
        if c:
            reach, gap = (i + 1) * width, 0.0
        else:
            gap += width
            most = max(most, gap)
            if gap > tolerance:
                break
    return reach, most


def test_reach(spark):
    rng = random.Random(5)
    lists = {s: [rng.random() < p for _ in range(12)] for s, p in enumerate([0.2, 0.5, 0.8, 0.9, 1.0, 0.6, 0.7, 0.4])}
    rows = [(s, k, f) for s, fs in lists.items() for k, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "s long, k long, f boolean")
    for tolerance in (0.0, 2.0, 3.0, 4.0, 100.0):
        got = {r.s: (r.reach_km, r.max_gap) for r in SC.reach_from_start(df, ["s"], "f", 12, 2.0, tolerance).collect()}
        assert got == {s: walk(fs, 2.0, tolerance) for s, fs in lists.items() if any(fs)}


def test_channel_leaves_out_an_isolated_pool(spark):
    """Water on the axis that the main component does not reach counts as water, not as connected."""
    wet = [(r, 1) for r in range(0, 6)] + [(r, 2) for r in range(8, 12)]
    seen = spark.createDataFrame([(1, r, c) for r in range(12) for c in range(4)] + [(2, 0, 0)], "scene long, row long, col long")
    lab = LB.label_cells(spark.createDataFrame([(1, r, c) for r, c in wet], "scene long, row long, col long"), 4, 8, ["scene"], F.col("scene"), 100)
    nodes = spark.createDataFrame([(r, 1 if r < 7 else 2, r * 0.5) for r in range(12)], "row long, col long, chain_km double")
    got = {r.scene: r for r in SC.channel_connectivity(lab, seen, nodes, ["scene"], (0, 1), 1.0, 6, 1.0).collect()}
    assert (got[1].n_observable, got[1].n_on_water, got[1].n_in_main) == (12, 10, 6)
    assert (got[1].connected_km, got[1].observable_km, got[1].connected_fraction, got[1].max_gap_km) == (3.0, 6.0, 0.5, 2.0)
    assert (got[2].n_observable, got[2].connected_km, got[2].connected_fraction) == (0, 0.0, None)


def field_of(spark, rows, cols, f):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(rows) for c in range(cols)], "row long, col long, z double")


def test_boundary_distance_far_and_signed(spark):
    """Two discs: distances to segments, not vertices, signs by side, and a gap far wider than the first bucket."""
    disc = lambda r, c, x, y, s: s - math.hypot(c - x, r - y)
    b1 = C.corner_blocks(field_of(spark, 24, 90, lambda r, c: disc(r, c, 10, 11, 6.3)), "z").cache()
    b2 = C.corner_blocks(field_of(spark, 24, 90, lambda r, c: max(disc(r, c, 11, 12, 4.2), disc(r, c, 80, 12, 5.1))), "z").cache()
    s1, s2 = C.block_segments(b1).cache(), C.block_segments(b2).cache()
    got = SC.boundary_distances(s1, s2, b1, b2).collect()
    lines = {"first": s2.collect(), "second": s1.collect()}
    mids = {(tag, r.row, r.col, r.seg): ((r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2) for tag, rows in (("first", lines["second"]), ("second", lines["first"])) for r in rows}

    def away(p, s):
        vx, vy = s.x2 - s.x1, s.y2 - s.y1
        t = min(1, max(0, ((p[0] - s.x1) * vx + (p[1] - s.y1) * vy) / (vx * vx + vy * vy)))
        return math.hypot(p[0] - s.x1 - t * vx, p[1] - s.y1 - t * vy)

    def inside(p, segs):  # parity along the whole ray
        return sum((s.y1 > p[1]) != (s.y2 > p[1]) and s.x1 + (p[1] - s.y1) * (s.x2 - s.x1) / (s.y2 - s.y1) < p[0] for s in segs) % 2 == 1

    assert len(got) == len(mids)
    for r in got:
        p = mids[r.direction, *r.vid]
        want = min(away(p, s) for s in lines[r.direction])
        sign = 1 if inside(p, lines[r.direction]) == (r.direction == "second") else -1
        assert r.dist == pytest.approx(want, abs=1e-9) and r.signed == pytest.approx(sign * want, abs=1e-9)
    assert max(r.dist for r in got) > 50


def test_boundary_distance_sends_a_vertex_once(spark, monkeypatch):
    """Only vertices without a line near their tile go on; tiles and reach change no distance and no side."""
    rng = random.Random(8)
    z = {(r, c): rng.uniform(-1, 1) + (3 if c > 12 else 0) for r in range(-9, 10) for c in range(-7, 18)}
    f = spark.createDataFrame([(r, c, v) for (r, c), v in z.items() if rng.random() < 0.95], "row long, col long, z double")
    b1, b2 = C.corner_blocks(f, "z").cache(), C.corner_blocks(f, "z", 2.5).cache()
    s1, s2 = C.block_segments(b1).cache(), C.block_segments(b2).cache()
    near, sent = SC.nearest_segment, []
    monkeypatch.setattr(SC, "nearest_segment", lambda p, *a: sent.append(p.count()) or near(p, *a))
    key = lambda r: (r.direction, *r.vid, round(r.len, 9), round(r.dist, 9), None if r.signed is None else round(r.signed, 9))
    wide = sorted(map(str, map(key, SC.boundary_distances(s1, s2, b1, b2, 99, 256).collect())))
    assert not sent and len(wide) == s1.count() + s2.count()
    assert sorted(map(str, map(key, SC.boundary_distances(s1, s2, b1, b2, 2, 5).collect()))) == wide
    assert 0 < sum(sent) < len(wide)


def test_movement_has_no_reach(spark):
    """A straight contour moved by 70 cells is found at its place; beyond the field's edge there is no crossing; a vertex above the later level is not nested."""
    e1 = C.corner_blocks(field_of(spark, 6, 120, lambda r, c: c - 20.5), "z")
    far = C.corner_blocks(field_of(spark, 6, 120, lambda r, c: c - (90.25 if r < 4 else 500)), "z")
    got = {(r.flag, None if r.rate is None else round(r.rate, 6)): n for r, n in ((r, 1) for r in SC.movement(e1, far, 0.5).collect())}
    assert set(got) == {("OK", round((90.25 - 20.5) / 0.5, 6)), ("NO_CROSSING", None)}
    dry = C.corner_blocks(field_of(spark, 6, 120, lambda r, c: c - 3), "z")
    assert {r.flag for r in SC.movement(e1, dry, 0.5).collect()} == {"NOT_NESTED"}
    s = SC.step_summary(SC.movement(e1, far, 0.5)).first()
    assert s.ok_length + s.no_crossing_length == pytest.approx(1) and s.k_median == pytest.approx(139.5)


def test_main_component_is_the_nearest_one(spark):
    lab = spark.createDataFrame([(5, 5, 1), (5, 6, 1), (1, 2, 9), (2, 1, 7)], "row long, col long, label long")
    assert SC.main_component(lab, [], 0, 0).first().label == 9  # as near as 7, lower row
