"""Intersection of planar geometries, as an Arrow-batched function on their JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Point = tuple[float, float]


def parts(geometry: dict) -> tuple[list[Point], list[list[Point]], list[list[list[Point]]]]:
    """Points, open lines and polygons (rings) of a geometry."""
    kind, c = geometry["type"], geometry.get("coordinates")
    pair = lambda p: (float(p[0]), float(p[1]))
    line = lambda ps: [pair(p) for p in ps]
    if kind == "GeometryCollection":
        out: tuple = ([], [], [])
        for g in geometry["geometries"]:
            for a, b in zip(out, parts(g), strict=True):
                a.extend(b)
        return out
    return {
        "Point": lambda: ([pair(c)], [], []), "MultiPoint": lambda: (line(c), [], []), "LineString": lambda: ([], [line(c)], []), "MultiLineString": lambda: ([], [line(x) for x in c], []),
        "Polygon": lambda: ([], [], [[line(r) for r in c]]), "MultiPolygon": lambda: ([], [], [[line(r) for r in p] for p in c]),
    }[kind]()


def turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def on_segment(p: Point, a: Point, b: Point) -> bool:
    return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if t1 * t2 < 0 and t3 * t4 < 0:
        return True
    return on_segment(c, a, b) or on_segment(d, a, b) or on_segment(a, c, d) or on_segment(b, c, d)


def covers(rings: list[list[Point]], p: Point) -> bool:
    """Whether a polygon with holes holds a point; its borders belong to it."""
    inside = False
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if on_segment(p, a, b):
                return True
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return inside


def meet(g: dict, h: dict) -> bool:
    (ps, ls, gs), (qs, ms, hs) = parts(g), parts(h)
    edges = lambda lines, polys: [s for line in lines for s in zip(line, line[1:], strict=False)] + [s for rings in polys for r in rings for s in zip(r, r[1:] + r[:1], strict=True)]
    e, f = edges(ls, gs), edges(ms, hs)
    if any(p == q for p in ps for q in qs) or any(on_segment(p, *s) for p in ps for s in f) or any(on_segment(q, *s) for q in qs for s in e):
        return True
    if any(segments_meet(*s, *t) for s in e for t in f):
        return True
    starts = lambda points, lines, polys: points + [x[0] for x in lines] + [rings[0][0] for rings in polys]
    return any(covers(rings, p) for rings in hs for p in starts(ps, ls, gs)) or any(covers(rings, q) for rings in gs for q in starts(qs, ms, hs))


def intersects(geometry: dict) -> Callable:
    @F.pandas_udf(T.BooleanType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else meet(json.loads(v), geometry))

    return run
