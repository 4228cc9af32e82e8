"""Points and axis-aligned rectangles of GeoSPARQL, as Spark expressions over doubles.

A geometry is struct<xmin, ymin, xmax, ymax, point>, parsed from a WKT or GeoJSON literal; what
isn't a point or such a rectangle, in the CRS84 reference system, is NULL, an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import GEO, QueryError, XSD
from .values import BOOL, DBL, INT, STR, TERM, Value, iri_text, text

WKT, GEOJSON = GEO + "wktLiteral", GEO + "geoJSONLiteral"
#: Mean earth radius in metres, and the reference system's IRI and number.
RADIUS = 6371008.8
CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
SRID = 4326
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def let(x: Column, fn) -> Column:
    """fn of x with x evaluated once: a lambda's variable stands for it, so the expression doesn't multiply."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def _shape(n: Column, rect: Column) -> Column:
    xs, ys = F.filter(n, lambda _, k: k % 2 == 0), F.filter(n, lambda _, k: k % 2 == 1)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"), (~rect).alias("point"))


def _ring(n: Column) -> Column:
    """Whether ten numbers walk round an axis-aligned rectangle and come back."""
    at = lambda k: F.try_element_at(n, F.lit(k))
    closed = (at(1) == at(9)) & (at(2) == at(10))
    first_x = (at(2) == at(4)) & (at(3) == at(5)) & (at(6) == at(8)) & (at(7) == at(1))
    first_y = (at(1) == at(3)) & (at(4) == at(6)) & (at(5) == at(7)) & (at(8) == at(2))
    return (F.size(n) == 10) & closed & (first_x | first_y)


def parse_wkt(s: Column) -> Column:
    return let(F.trim(F.regexp_replace(s, rf"^\s*<{CRS84}>\s*", "")), _parse_body)


def _parse_body(body: Column) -> Column:
    pair = rf"{NUMBER}\s+{NUMBER}"
    numbers = F.transform(F.regexp_extract_all(body, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))
    point = body.rlike(rf"^(?i)POINT\s*\(\s*{pair}\s*\)$")
    poly = body.rlike(rf"^(?i)POLYGON\s*\(\s*\(\s*{pair}(?:\s*,\s*{pair}){{4}}\s*\)\s*\)$")
    env = body.rlike(rf"^(?i)ENVELOPE\s*\(\s*{NUMBER}(?:[\s,]+{NUMBER}){{3}}\s*\)$")


    def shape(n: Column) -> Column:
        e = lambda k: F.try_element_at(n, F.lit(k))
        box = F.struct(e(1).alias("xmin"), e(2).alias("ymin"), e(3).alias("xmax"), e(4).alias("ymax"), F.lit(False).alias("point"))
        return F.when(point, _shape(n, F.lit(False))).when(poly, F.when(_ring(n), _shape(n, F.lit(True)))).when(env, F.when((e(1) <= e(3)) & (e(2) <= e(4)), box))

    return let(numbers, shape)


def parse_geojson(s: Column) -> Column:
    kind = F.get_json_object(s, "$.type")
    point = F.from_json(F.get_json_object(s, "$.coordinates"), "array<double>")
    poly = F.flatten(F.flatten(F.from_json(F.get_json_object(s, "$.coordinates"), "array<array<array<double>>>")))
    return F.when((kind == "Point") & (F.size(point) == 2), _shape(point, F.lit(False))).when((kind == "Polygon") & _ring(poly), _shape(poly, F.lit(True)))


def geometry(x: Value) -> Column:
    if x.type == TERM:
        return F.when(x.col["dt"] == WKT, parse_wkt(x.col["v"])).when(x.col["dt"] == GEOJSON, parse_geojson(x.col["v"]))
    if x.type == STR:
        return parse_wkt(x.col)
    return F.lit(None).cast("struct<xmin: double, ymin: double, xmax: double, ymax: double, point: boolean>")


def coordinate(c: Column) -> Column:
    """A coordinate's text: the shortest double, without a needless fraction."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def as_wkt(g: Column) -> Column:
    t = {k: coordinate(g[k]) for k in ("xmin", "ymin", "xmax", "ymax")}
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", t[a], t[b]) for a, b in corners])
    return F.when(g.isNotNull(), F.when(g["point"], F.concat(F.lit("POINT("), t["xmin"], F.lit(" "), t["ymin"], F.lit(")"))).otherwise(F.concat(F.lit("POLYGON(("), ring, F.lit("))"))))


def as_geojson(g: Column) -> Column:
    t = {k: coordinate(g[k]) for k in ("xmin", "ymin", "xmax", "ymax")}
    pair = lambda a, b: F.concat(F.lit("["), t[a], F.lit(","), t[b], F.lit("]"))
    ring = F.concat_ws(",", pair("xmin", "ymin"), pair("xmax", "ymin"), pair("xmax", "ymax"), pair("xmin", "ymax"), pair("xmin", "ymin"))
    return F.when(g.isNotNull(), F.when(g["point"], F.concat(F.lit('{"type":"Point","coordinates":'), pair("xmin", "ymin"), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))))


def distance(a: Column, b: Column) -> Column:
    """Great-circle metres between two points (haversine)."""
    la, lb = F.radians(a["ymin"]), F.radians(b["ymin"])
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(b["xmin"] - a["xmin"]) / 2), 2)
    return F.when(a["point"] & b["point"], 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def equals(a: Column, b: Column) -> Column:
    return (a["xmin"] == b["xmin"]) & (a["ymin"] == b["ymin"]) & (a["xmax"] == b["xmax"]) & (a["ymax"] == b["ymax"])


def intersects(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def overlaps(a: Column, b: Column) -> Column:
    open_ = (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])
    return ~a["point"] & ~b["point"] & open_


def within(a: Column, b: Column) -> Column:
    strict = (a["xmin"] > b["xmin"]) & (a["xmin"] < b["xmax"]) & (a["ymin"] > b["ymin"]) & (a["ymin"] < b["ymax"])
    inside = (a["xmin"] >= b["xmin"]) & (a["xmax"] <= b["xmax"]) & (a["ymin"] >= b["ymin"]) & (a["ymax"] <= b["ymax"])
    return F.when(a["point"] & b["point"], equals(a, b)).when(b["point"], equals(a, b)).when(a["point"], strict).otherwise(inside)


def touches(a: Column, b: Column) -> Column:
    edge = lambda p, r: intersects(p, r) & ~within(p, r)
    return F.when(a["point"] & b["point"], F.lit(False)).when(a["point"], edge(a, b)).when(b["point"], edge(b, a)).otherwise(intersects(a, b) & ~overlaps(a, b) & ~equals(a, b))


RELATIONS = {"sfequals": equals, "sfintersects": intersects, "sfdisjoint": lambda a, b: ~intersects(a, b), "sftouches": touches, "sfcrosses": lambda a, b: F.lit(False), "sfwithin": within, "sfcontains": lambda a, b: within(b, a), "sfoverlaps": overlaps}


def _typed(v: Column, dt: str) -> Value:
    return Value(F.when(v.isNotNull(), F.struct(F.lit("literal").alias("kind"), v.alias("v"), F.lit(dt).alias("dt"), F.lit(None).cast("string").alias("lang"))), TERM)


def call(name: str, args: list[Value]) -> Value:
    """A geof: function by its lower-cased local name."""
    one = lambda fn: let(geometry(args[0]), fn)
    two = lambda fn: let(F.struct(geometry(args[0]).alias("a"), geometry(args[1]).alias("b")), lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), fn(p["a"], p["b"])))
    if name in RELATIONS and len(args) == 2:
        return Value(two(RELATIONS[name]), BOOL)
    if name == "distance" and len(args) in (2, 3):
        metres = two(distance)
        if len(args) == 2:
            return Value(metres, DBL)
        unit = args[2]
        u = F.lower(iri_text(unit) if unit.type.kind in ("iri", "node") else text(unit) if unit.type != TERM else unit.col["v"])
        return Value(F.when(u.rlike(r"kilomet(re|er)s?$|(^|/)km$"), metres / 1000).when(u.rlike(r"(^|[/#])met(re|er)s?$|(^|/)m$"), metres), DBL)
    if name in ("envelope", "aswkt"):
        return _typed(one(as_wkt), WKT)
    if name == "asgeojson":
        return _typed(one(as_geojson), GEOJSON)
    if name == "getsrid":
        return Value(one(lambda g: F.when(g.isNotNull(), F.lit(SRID).cast("bigint"))), INT)
    if name in ("issimple", "isvalid"):
        return Value(one(lambda g: F.when(g.isNotNull(), F.lit(True))), BOOL)
    raise QueryError(f"unknown function geof:{name}")
