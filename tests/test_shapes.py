"""Noding, projection and the choice of distinct rows against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadloom.functions import projection
from roadloom.operators import splitting
from roadloom.plans import geometry

LINES = "code string, pts array<struct<x:double,y:double>>, len double"


def ways(pts):
    out = [0.0]
    for a, b in zip(pts, pts[1:], strict=False):
        out.append(out[-1] + math.dist(a, b))
    return out


def cuts_by_brute_force(lines):
    """Per line the places where others meet it, away from its ends; pairs that run along each other don't count."""
    found = {c: set() for c in lines}
    for c in lines:
        for o in lines:
            if c == o:
                continue
            hits, beside = [], False
            for (a, b), f in zip(zip(lines[c], lines[c][1:], strict=False), ways(lines[c]), strict=False):
                for p, q in zip(lines[o], lines[o][1:], strict=False):
                    d, e, g = (b[0] - a[0], b[1] - a[1]), (q[0] - p[0], q[1] - p[1]), (p[0] - a[0], p[1] - a[1])
                    den = d[0] * e[1] - d[1] * e[0]
                    if abs(den) < 1e-12:
                        n = d[0] ** 2 + d[1] ** 2
                        s, t = (((r[0] - a[0]) * d[0] + (r[1] - a[1]) * d[1]) / n for r in (p, q))
                        on = abs(g[0] * d[1] - g[1] * d[0]) < 1e-9
                        beside |= on and min(max(s, t), 1) - max(min(s, t), 0) > 1e-6
                        continue
                    t, u = (g[0] * e[1] - g[1] * e[0]) / den, (g[0] * d[1] - g[1] * d[0]) / den
                    if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                        hits.append(f + t * math.dist(a, b))
            if not beside:
                found[c] |= {round(h, 6) for h in hits if 1e-6 < round(h, 6) < ways(lines[c])[-1] - 1e-6}
    return found


def random_lines(seed, n):
    rnd = random.Random(seed)
    point = lambda: (rnd.randint(0, 8), rnd.randint(0, 8)) if seed % 2 else (rnd.uniform(0, 8), rnd.uniform(0, 8))
    out = {}
    for k in range(n):
        pts = [point()]
        while len(pts) < rnd.randint(2, 4):
            p = point()
            if p != pts[-1]:
                pts.append(p)
        if len(pts) > 1:
            out[f"l{k:03d}"] = pts
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_noding_by_brute_force(spark, seed):
    lines = random_lines(seed, 30)
    df = lambda some: spark.createDataFrame([(c, [(float(x), float(y)) for x, y in p], 1.5) for c, p in some.items()], LINES)
    out = splitting.noded(df(lines), 1.0, carried=["len"]).collect()
    wanted = cuts_by_brute_force(lines)
    pieces = {}
    for r in sorted(out, key=lambda r: (r.code, r.part)):
        pieces.setdefault(r.code, []).append(r)
    assert pieces.keys() == lines.keys() and all(r.len == 1.5 for r in out)
    for c, rows in pieces.items():
        assert sum(r.length for r in rows) == pytest.approx(ways(lines[c])[-1])
        assert [r.part for r in rows] == list(range(len(wanted[c]) + 1)) and {r.pieces for r in rows} == {len(rows)}
        at = [0.0]
        for r in rows[:-1]:
            at.append(at[-1] + r.length)
        assert at[1:] == pytest.approx(sorted(wanted[c]), abs=1e-6)
        assert all(ways([(p.x, p.y) for p in r.pts])[-1] == pytest.approx(r.length, abs=1e-5) for r in rows)
    if seed == 2:  # noded lines have nothing left to split
        again = splitting.noded(df({f"{r.code}.{r.part}": [(p.x, p.y) for p in r.pts] for r in out}), 1.0, tolerance=1e-5)
        assert again.where("pieces > 1").count() == 0


def test_projection_round_trip(spark):
    """Within a millimetre over a whole zone; scale on the middle meridian; lengths of a degree."""
    rows = [(lon / 4, lat / 4) for lon in range(4 * 84 - 4, 4 * 90 + 5, 3) for lat in range(0, 4 * 60, 7)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("m", projection.to_metres(F.col("lon"), F.col("lat"), 45))
    for r in df.withColumn("g", projection.to_degrees(F.col("m.x"), F.col("m.y"), 45)).collect():
        assert abs(r.g.lon - r.lon) * 111_000 * math.cos(math.radians(r.lat)) < 1e-3 and abs(r.g.lat - r.lat) * 111_000 < 1e-3
    one = {(r.lon, r.lat): r.m for r in df.union(spark.createDataFrame([(87.0, 0.0), (87.0, 30.0)], "lon double, lat double").withColumn("m", projection.to_metres(F.col("lon"), F.col("lat"), 45))).collect()}
    assert one[(87.0, 0.0)].x == 500000.0 and one[(87.0, 0.0)].y == 0.0
    # the quarter of the meridian up to 30 degrees is 3320113.398 m long
    assert one[(87.0, 30.0)].y / projection.SCALE == pytest.approx(3320113.398, abs=1e-3)


def test_distinct_rows_by_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(1500):
        corner, size = rnd.randint(0, 60), rnd.randint(1, 6)
        rows.append((f"c{k:04d}", float(rnd.randint(0, 300)), rnd.choice(["west", "east", "middle", None]), [f"{corner + j}" for j in range(size)] + ([f"{corner}"] if k % 3 else [])))
    df = spark.createDataFrame(rows, "code string, score double, region string, cells array<string>")
    kept = []
    for code, score, region, cells in sorted(rows, key=lambda r: (-r[1], r[0])):
        own = set(cells)
        if any(len(own & o) / max(1, min(len(own), len(o))) > 0.5 for *_, o in kept) or sum(k[2] == region for k in kept) >= 4 or len(kept) >= 12:
            continue
        kept.append((code, score, region, own))
    assert geometry.distinct_top(df, 12, 4, 0.5) == [k[:3] for k in kept]
    assert geometry.distinct_top(df.limit(0)) == []
