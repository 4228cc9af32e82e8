"""SPARQL algebra to DataFrames.

Every variable is one column with a static type (see functions.values).  Patterns that share a
subject and whose predicates are columns of one table become one scan of it.  IRI variables from
a table stay native keys: joins run on them, and IRI strings are made in the last projection.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.expressions import Expressions, effective
from ..functions.values import BOOL, DBL, DEC, DECIMAL, DOUBLE, FLOAT, FULL_IRI, INT, INTEGER, NATIVE, NODE, RANK, STR, STRING, TERM, TERM_SCHEMA, Type, Value, cast_to, common, constant, iri_text, language, lexical_of, lit_type, null, number, rank_of, same_term, sort_key, text, to_term
from ..operators.paths import closure
from ..sources.mapping import PART, Dataset, TableMap, part_of
from ..terms import GEO, LANG_STRING, NUMERICS, RDF_TYPE, Blank, Iri, Literal, QueryError, Var
from .parser import Query, expression_variables, variables, visible

_names = itertools.count(1)
#: Rows of VALUES that are written into the plan one by one.
MANY_ROWS = 64


def fresh() -> str:
    return f"c{next(_names)}"


@dataclass
class Frame:
    """Solutions: a DataFrame and, by variable, the column that holds it."""

    df: DataFrame
    scope: dict[str, Value] = field(default_factory=dict)

    def select(self, values: dict[str, Value]) -> "Frame":
        """Only these variables, each in a column of its own."""
        named = {v: (fresh(), x) for v, x in values.items()}
        df = self.df.select(*[x.col.alias(c) for c, x in named.values()]) if named else self.df.select()
        return Frame(df, {v: Value(F.col(c), x.type, x.nullable) for v, (c, x) in named.items()})

    def extend(self, values: dict[str, Value]) -> "Frame":
        return self.select(self.scope | values)

    def where(self, condition: Column) -> "Frame":
        return Frame(self.df.where(condition), self.scope)


def term_equals(x: Value, t, df: DataFrame) -> Column:
    """Condition that a column holds a constant term; on native keys where it can be, so that it is pushed down."""
    if x.type.kind == "iri" and x.type.detail and isinstance(t, Iri):
        if not t.value.startswith(x.type.detail):
            return F.lit(False)
        key = t.value[len(x.type.detail) :]
        kind = df.select(x.col.alias("k")).schema["k"].dataType.simpleString()
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return x.col == F.lit(int(key)).cast(kind) if key.lstrip("-").isdigit() and str(int(key)) == key else F.lit(False)
        return x.col == key
    if x.type == TERM and isinstance(t, Literal):
        c = to_term(constant(t))
        return (x.col["v"] == c["v"]) & (x.col["kind"] == "literal") & x.col["dt"].eqNullSafe(c["dt"]) & x.col["lang"].eqNullSafe(c["lang"])
    if x.type == TERM:
        v = "_:" + t.label if isinstance(t, Blank) else t.value
        return (x.col["v"] == v) & (x.col["kind"] == ("bnode" if isinstance(t, Blank) else "iri"))
    return F.coalesce(same_term(x, constant(t)), F.lit(False)) if x.type.kind != "lit" else same_term(x, constant(t))


class Compiler:
    def __init__(self, data: Dataset, base: str | None = None, froms: list[str] | None = None, named: list[str] | None = None):
        self.data, self.base, self.froms, self.named = data, base, froms, named

    # -- patterns
    def pattern(self, p, graph=None) -> Frame:
        kind = p[0]
        if kind == "unit":
            return Frame(self.data.spark.range(1).select())
        if kind == "bgp":
            return self.bgp(p[1], graph)
        if kind == "join" and p[1][0] == "unit":
            return self.pattern(p[2], graph)
        if kind == "join" and p[2][0] == "bgp" and (computed := self.computed(p[2][1], graph)):
            # properties that are computed from a geometry bound on the left
            f = self.pattern(p[1], graph)
            if rest := [t for t in p[2][1] if t not in computed]:
                f = self.join(f, self.bgp(rest, graph))
            for s, q, o in computed:
                f = self.with_geometry(f, s, q, o, graph)
            return f
        if kind == "join":
            return self.join(self.pattern(p[1], graph), self.pattern(p[2], graph))
        if kind == "optional":
            return self.optional(self.pattern(p[1], graph), p[2], p[3], graph)
        if kind == "union":
            return self.union([self.pattern(p[1], graph), self.pattern(p[2], graph)])
        if kind == "minus":
            return self.minus(self.pattern(p[1], graph), self.pattern(p[2], graph))
        if kind == "filter":
            return self.filter(self.pattern(p[2], graph), p[1], graph)
        if kind == "extend":
            f, e = self.marked(self.pattern(p[1], graph), p[3], graph)
            return f.extend({p[2]: self.expressions(f)(e)})
        if kind == "values":
            return self.values(p[1], p[2])
        if kind == "graph":
            f = self.pattern(p[2], p[1])
            if isinstance(p[1], Var) and p[1].name not in f.scope:
                f = self.join(f, self.graph_names(p[1].name))
            return f
        if kind == "select":
            q = p[1]
            return self.select(q, graph)
        if kind == "frame":
            return p[1]
        raise QueryError(f"unknown pattern {kind}")

    def expressions(self, f: Frame) -> Expressions:
        return Expressions(f.scope, self.base)

    # -- scans
    def tables(self, graph) -> list[TableMap]:
        if graph is None and self.froms is None:
            return [m for m in self.data.maps if m.graph is None]
        return [m for m in self.data.maps if m.graph is not None]

    def active_quads(self, graph) -> DataFrame | None:
        q = self.data.quads
        if q is None:
            return None
        if graph is None:
            if self.froms is None:
                return q.where("g is null")
            return q.where(F.col("g").isin(self.froms)).select(F.lit(None).cast("string").alias("g"), "s", "p", "o").distinct()
        if isinstance(graph, Iri):
            return q.where(F.col("g") == graph.value) if self.named is None or graph.value in self.named else q.limit(0)
        return q.where("g is not null" if self.named is None else F.col("g").isin(self.named))

    def graph_names(self, var: str) -> Frame:
        parts = []
        q = self.active_quads(Var(var))
        if q is not None:
            parts.append(Frame(q).select({var: Value(F.col("g"), FULL_IRI, False)}))
        for m in self.data.maps:
            if m.graph is not None:
                parts.append(Frame(m.df).select({var: m.graph}))
        f = self.union(parts) if parts else Frame(self.data.spark.range(0).select()).select({var: null(FULL_IRI)})
        return Frame(f.df.distinct(), f.scope)

    def _bind(self, df: DataFrame, pairs: list[tuple[object, Value]]) -> Frame:
        """Rows of `df` that fit (term or variable, column) pairs."""
        binds: dict[str, Value] = {}
        for t, x in pairs:
            if isinstance(t, Var):
                if x.nullable:
                    df = df.where(x.col.isNotNull())
                    x = Value(x.col, x.type, False)
                if t.name in binds:
                    df = df.where(same_term(binds[t.name], x))
                else:
                    binds[t.name] = x
            else:
                df = df.where(term_equals(x, t, df))
        return Frame(df).select(binds)

    def _graph_pairs(self, m: TableMap, df: DataFrame, graph):
        if m.graph is None:
            return df, []
        if graph is None:
            return df.where(self._in_list(m.graph, self.froms, df)), []
        if isinstance(graph, Var) and self.named is not None:
            df = df.where(self._in_list(m.graph, self.named, df))
        if isinstance(graph, Iri) and self.named is not None and graph.value not in self.named:
            df = df.limit(0)
        return df, [(graph, m.graph)]

    def _in_list(self, x: Value, iris: list[str] | None, df: DataFrame) -> Column:
        out = F.lit(False)
        for i in iris or []:
            out = out | term_equals(x, Iri(i), df)
        return out

    def scan_table(self, m: TableMap, s, star: list[tuple[str, object]], graph) -> Frame:
        """One scan for all (predicate, object) patterns of a subject."""
        df, pairs = self._graph_pairs(m, m.df, graph)
        pairs = [*pairs, (s, m.subject)]
        for p, o in star:
            pairs.append((o, m.columns[p] if p != RDF_TYPE else Value(F.lit(m.cls), FULL_IRI, False)))
        for p, _ in star:
            if p != RDF_TYPE and m.columns[p].nullable:
                df = df.where(m.columns[p].col.isNotNull())
        return self._bind(df, pairs)

    def scan_quads(self, s, p, o, graph) -> Frame:
        df = self.active_quads(graph)
        pairs = [(graph, Value(F.col("g"), FULL_IRI, False))] if isinstance(graph, Var) else []
        if isinstance(p, Iri):
            df = df.where(F.col("p") == p.value)
            if PART in df.columns:  # quads kept in folders by predicate: the others aren't read
                df = df.where(F.col(PART) == part_of(F.lit(p.value)))
        else:
            pairs.append((p, Value(F.col("p"), FULL_IRI, False)))
        return self._bind(df, [*pairs, (s, Value(F.col("s"), NODE, False)), (o, Value(F.col("o"), TERM, False))])

    def homes(self, p: str, o, graph) -> list:
        """Tables (or None, the quads) that may hold triples of a predicate."""
        out: list = [m for m in self.tables(graph) if p in m.columns or p == RDF_TYPE and m.cls and (isinstance(o, Var) or isinstance(o, Iri) and o.value == m.cls)]
        if self.data.quads is not None and (self.data.predicates is None or p in self.data.predicates):
            out.append(None)
        return out

    def any_predicate(self, s, p: Var, o, graph, near: list[Type] | None = None) -> Frame:
        """A pattern whose predicate is a variable: all columns of all tables, one scan a table, and the quads.

        near: subject types of other patterns that the subject must meet; tables of other subjects are left out.
        """
        parts = []
        for m in self.tables(graph):
            if isinstance(s, Iri) and not s.value.startswith(m.subject.type.detail):
                continue
            if near and not any(common(m.subject.type, t) for t in near):
                continue
            df, pairs = self._graph_pairs(m, m.df, graph)
            cells = [*m.columns.items(), *([(RDF_TYPE, Value(F.lit(m.cls), FULL_IRI, False))] if m.cls else [])]
            for t, x in pairs:  # conditions on constants go below the unfolding
                if not isinstance(t, Var):
                    df = df.where(term_equals(x, t, df))
            if not isinstance(s, Var):
                df = df.where(term_equals(m.subject, s, df))
            keep = [(t, x) for t, x in [*pairs, (s, m.subject)] if isinstance(t, Var)]
            cols = [x.col.alias(f"_x{n}") for n, (_, x) in enumerate(keep)]
            rows = df.select(*cols, F.inline(F.array(*[F.struct(F.lit(q).alias("_p"), to_term(x).alias("_o")) for q, x in cells])))
            fit = [(t, Value(F.col(f"_x{n}"), x.type, x.nullable)) for n, (t, x) in enumerate(keep)]
            parts.append(self._bind(rows, [*fit, (p, Value(F.col("_p"), FULL_IRI, False)), (o, Value(F.col("_o"), TERM, True))]))
        if self.data.quads is not None:
            parts.append(self.scan_quads(s, p, o, graph))
        return self.union(parts) if parts else self.nothing({t.name for t in (s, p, o) if isinstance(t, Var)})

    def nothing(self, names) -> Frame:
        return Frame(self.data.spark.range(0).select()).select({v: null() for v in sorted(names)})

    def bgp(self, triples: list, graph) -> Frame:
        stars: dict[object, list] = {}
        parts: list[Frame] = []
        near: dict[object, list[Type]] = {}
        for s, p, o in triples:
            if isinstance(p, Iri) and isinstance(s, Var):
                h = self.homes(p.value, o, graph)
                if h and None not in h:
                    near.setdefault(s, [m.subject.type for m in h])
        computed = self.computed(triples, graph)
        for s, p, o in triples:
            if (s, p, o) in computed:
                continue
            if isinstance(p, tuple):
                parts.append(self.path(s, p, o, graph, near.get(s)))
            elif isinstance(p, Var):
                parts.append(self.any_predicate(s, p, o, graph, near.get(s)))
            else:
                stars.setdefault(s, []).append((p.value, o))
        for s, star in stars.items():
            parts += self.star(s, star, graph)
        whole = self.connect(parts)
        for s, p, o in computed:
            whole = self.with_geometry(whole, s, p, o, graph)
        return whole

    def computed(self, triples: list, graph) -> list:
        """Patterns of a geometry property, with a variable as subject."""
        names = [GEO + n for n in ("asWKT", "asGeoJSON", "hasGeometry")]
        return [(s, p, o) for s, p, o in triples if isinstance(p, Iri) and p.value in names and isinstance(s, Var)]

    def with_geometry(self, f: Frame, s: Var, p: Iri, o, graph) -> Frame:
        """Solutions whose subject is a geometry get the computed property, beside those of stored triples."""
        parts = []
        if s.name in f.scope:
            parts.append(self.geometry_property(f, s, p.value[len(GEO) :], o))
        if self.homes(p.value, o, graph):
            for stored in self.star(s, [(p.value, o)], graph):
                parts.append(self.join(f, stored))
        return self.union(parts) if parts else self.nothing(set(f.scope) | {t.name for t in (s, o) if isinstance(t, Var)})

    def geometry_property(self, f: Frame, s: Var, name: str, o) -> Frame:
        if name not in ("asWKT", "asGeoJSON", "hasGeometry"):
            return self.nothing({s.name} | ({o.name} if isinstance(o, Var) else set()))
        x = f.scope.get(s.name) or null()
        v = x if name == "hasGeometry" else geo.call(name.lower(), [x])
        f = f.where(geo.geometry(x).isNotNull()) if x.type in (TERM, STR) else f.where(F.lit(False))
        if isinstance(o, Var) and o.name not in f.scope:
            return f.extend({o.name: v})
        other = f.scope[o.name] if isinstance(o, Var) else constant(o)
        return f.where(same_term(v, other))

    def star(self, s, star: list[tuple[str, object]], graph) -> list[Frame]:
        """Scans for the patterns of one subject: one for each table that holds some of them alone."""
        homes = [(p, o, self.homes(p, o, graph)) for p, o in star]
        sure = [h[0] for _, _, h in homes if len(h) == 1 and h[0] is not None]
        by_table: dict[int, tuple[TableMap, list]] = {}
        out: list[Frame] = []
        for p, o, h in homes:
            if len(h) > 1 and sure:  # subjects of other templates can't meet the ones that are sure
                near = [m for m in h if m is None or any(common(m.subject.type, k.subject.type) for k in sure)]
                same = [m for m in near if any(m is k for k in sure)]
                h = same if len(same) == 1 and len(near) == 1 else near
            if isinstance(s, Iri):
                h = [m for m in h if m is None or s.value.startswith(m.subject.type.detail)]
            if len(h) == 1 and h[0] is not None:
                by_table.setdefault(id(h[0]), (h[0], []))[1].append((p, o))
            else:
                frames = [self.scan_quads(s, Iri(p), o, graph) if m is None else self.scan_table(m, s, [(p, o)], graph) for m in h]
                out.append(self.union(frames) if frames else self.nothing({t.name for t in (s, o, graph) if isinstance(t, Var)}))
        return [*(self.scan_table(m, s, ps, graph) for m, ps in by_table.values()), *out]

    def connect(self, parts: list[Frame]) -> Frame:
        """Join all parts, each next one sharing a variable with those before where one does."""
        if not parts:
            return Frame(self.data.spark.range(1).select())
        whole, rest = parts[0], parts[1:]
        while rest:
            n = next((n for n, f in enumerate(rest) if set(f.scope) & set(whole.scope)), 0)
            whole = self.join(whole, rest.pop(n))
        return whole

    # -- joins
    def join(self, a: Frame, b: Frame) -> Frame:
        shared = [v for v in a.scope if v in b.scope]
        maybe = [v for v in shared if a.scope[v].nullable or b.scope[v].nullable]
        if not maybe:
            return self._equi(a, b, shared, shared)
        if len(maybe) > 2:
            return self._loose(a, b, shared, "inner")
        # an unbound variable is compatible with anything: split by what is bound, so that each part is an equi-join
        return self._split(a, b, shared, maybe)

    def _split(self, a: Frame, b: Frame, shared: list[str], maybe: list[str]) -> Frame:
        if not maybe:
            return self._equi(a, b, shared, [v for v in shared if not a.scope[v].nullable and not b.scope[v].nullable])
        v, rest = maybe[0], maybe[1:]
        x, y = a.scope[v], b.scope[v]
        there = lambda f, val: Frame(f.df.where(val.col.isNotNull()), f.scope | {v: Value(val.col, val.type, False)}) if val.nullable else f
        parts = [self._split(there(a, x), there(b, y), shared, rest)]
        if x.nullable:
            gone = Frame(a.df.where(x.col.isNull()), {n: val for n, val in a.scope.items() if n != v})
            parts.append(self._split(gone, b, [n for n in shared if n != v], rest))
        if y.nullable:
            gone = Frame(b.df.where(y.col.isNull()), {n: val for n, val in b.scope.items() if n != v})
            parts.append(self._split(there(a, x), gone, [n for n in shared if n != v], rest))
        return self.union(parts)

    def _equal(self, x: Value, y: Value) -> Column | None:
        kind = common(x.type, y.type)
        return None if kind is None else cast_to(x, kind) == cast_to(y, kind)

    def _equi(self, a: Frame, b: Frame, shared: list[str], keys: list[str]) -> Frame:
        tests = [self._equal(a.scope[v], b.scope[v]) for v in keys]
        scope = b.scope | a.scope
        if any(t is None for t in tests):  # terms of these types are never equal
            return Frame(a.df.limit(0).crossJoin(b.df.limit(0)), scope).select(scope)
        for v in shared:  # a common representation is kept: the narrower one
            if a.scope[v].type == TERM and b.scope[v].type != TERM or a.scope[v].type in (NODE, FULL_IRI) and b.scope[v].type.detail:
                scope[v] = b.scope[v]
        on = None
        for t in tests:
            on = t if on is None else on & t
        df = a.df.join(b.df, on, "inner") if on is not None else a.df.crossJoin(b.df)
        return Frame(df, scope).select(scope)

    def _compatible(self, a: Frame, b: Frame, shared: list[str]) -> Column | None:
        on = None
        for v in shared:
            x, y = a.scope[v], b.scope[v]
            t = self._equal(x, y)
            t = F.lit(False) if t is None else t
            if x.nullable:
                t = t | x.col.isNull()
            if y.nullable:
                t = t | y.col.isNull()
            on = t if on is None else on & t
        return on

    def _merged(self, a: Frame, b: Frame, shared: list[str], outer: bool) -> dict[str, Value]:
        scope = {v: Value(x.col, x.type, x.nullable or outer) for v, x in b.scope.items() if v not in a.scope} | a.scope
        for v in shared:
            x, y = a.scope[v], b.scope[v]
            if x.nullable:
                kind = common(x.type, y.type) or TERM
                scope[v] = Value(F.coalesce(cast_to(x, kind), cast_to(y, kind)), kind, outer or y.nullable)
        return scope

    def _loose(self, a: Frame, b: Frame, shared: list[str], how: str, extra: Column | None = None) -> Frame:
        on = self._compatible(a, b, shared)
        if extra is not None:
            on = extra if on is None else on & extra
        scope = self._merged(a, b, shared, how != "inner")
        df = a.df.join(b.df, on if on is not None else F.lit(True), how)
        return Frame(df, scope).select(scope)

    def optional(self, a: Frame, right, condition, graph) -> Frame:
        b = self.pattern(right, graph)
        shared = [v for v in a.scope if v in b.scope]
        maybe = [v for v in shared if a.scope[v].nullable or b.scope[v].nullable]
        extra = None
        if condition is not None:
            extra = Expressions(self._merged(a, b, shared, False) if maybe else b.scope | a.scope, self.base).condition(condition)
        if not maybe or len(maybe) > 2:
            return self._loose(a, b, shared, "left_outer", extra)
        # split by what is bound: the rows that meet, and those that meet none
        met = self._split(a, b, shared, maybe)
        if condition is not None:
            met = met.where(self.expressions(met).condition(condition))
        return self.union([met, self.existence(a, b, True, extra)])

    def minus(self, a: Frame, b: Frame) -> Frame:
        return self.existence(a, b, True, overlap=True) if set(a.scope) & set(b.scope) else a

    def existence(self, a: Frame, b: Frame, negated: bool, extra: Column | None = None, overlap: bool = False) -> Frame:
        """Rows of `a` with a compatible row in `b`, or without one.

        extra: a condition on both rows; overlap: a variable must be bound on both sides.  Rows are
        parted by which of the variables are bound, so that each join is on keys.
        """
        shared = [v for v in a.scope if v in b.scope]
        how = ["left_semi", "left_anti"]
        if sum(a.scope[v].nullable or b.scope[v].nullable for v in shared) > 2:
            on = self._compatible(a, b, shared)
            if extra is not None:
                on = on & extra
            if overlap and all(a.scope[v].nullable or b.scope[v].nullable for v in shared):
                some = F.lit(False)
                for v in shared:
                    some = some | (a.scope[v].col.isNotNull() & b.scope[v].col.isNotNull())
                on = on & some
            return Frame(a.df.join(b.df, on, how[negated]), a.scope)
        out: list[DataFrame] = []
        for gone_a, left in self._bound_parts(a, shared):
            rest = left
            for gone_b, right in self._bound_parts(b, shared):
                keys = [v for v in shared if v not in gone_a and v not in gone_b]
                tests = [self._equal(a.scope[v], b.scope[v]) for v in keys]
                if any(t is None for t in tests) or overlap and not keys:
                    continue  # never equal, or nothing in common
                on = extra
                for t in tests:
                    on = t if on is None else on & t
                if on is None:  # nothing to compare: all rows or none
                    on, right = F.lit(True), right.limit(1).select(F.lit(1).alias(fresh()))
                if not negated:
                    out.append(rest.join(right, on, "left_semi"))
                rest = rest.join(right, on, "left_anti")
            if negated:
                out.append(rest)
        df = out[0] if out else a.df.limit(0)
        for d in out[1:]:
            df = df.unionByName(d)
        return Frame(df, a.scope)

    def _bound_parts(self, f: Frame, names: list[str]) -> list[tuple[set[str], DataFrame]]:
        """Disjoint parts of a frame's rows, each with the variables among `names` that are unbound in it."""
        parts: list[tuple[set[str], DataFrame]] = [(set(), f.df)]
        for v in names:
            x = f.scope[v]
            if x.nullable:
                parts = [p for gone, df in parts for p in ((gone, df.where(x.col.isNotNull())), (gone | {v}, df.where(x.col.isNull())))]
        return parts

    def union(self, frames: list[Frame]) -> Frame:
        if len(frames) == 1:
            return frames[0]
        names = sorted(set().union(*[f.scope for f in frames]))
        kinds: dict[str, tuple[Type, bool]] = {}
        for v in names:
            have = [f.scope[v] for f in frames if v in f.scope]
            kind = have[0].type
            for x in have[1:]:
                nodes = kind.kind in ("iri", "node") and x.type.kind in ("iri", "node")
                kind = common(kind, x.type) or ((FULL_IRI if kind.kind == x.type.kind == "iri" else NODE) if nodes else TERM)
            kinds[v] = (kind, any(x.nullable for x in have) or len(have) < len(frames))
        parts = []
        for f in frames:
            values = {v: Value(cast_to(f.scope[v], kinds[v][0]), kinds[v][0], kinds[v][1]) if v in f.scope else Value(self._typed_null(kinds[v][0], frames, v), kinds[v][0], True) for v in names}
            parts.append(f.select(values))
        df = parts[0].df
        for p in parts[1:]:
            df = df.union(p.df)
        return Frame(df, parts[0].scope)

    def _typed_null(self, kind: Type, frames: list[Frame], v: str) -> Column:
        if kind.kind == "iri" and kind.detail:
            f = next(f for f in frames if v in f.scope)
            return F.lit(None).cast(f.df.select(f.scope[v].col).schema[0].dataType)
        return null(kind).col

    def values(self, names: list[str], rows: list[list]) -> Frame:
        """Inline data, made in the JVM."""
        if not rows:
            return self.nothing(names)
        if len(rows) > MANY_ROWS and names:
            return self._many_values(names, rows)
        cols = []
        kinds = {}
        for n, v in enumerate(names):
            own = [constant(r[n]) for r in rows if r[n] is not None]
            kind = own[0].type if own else TERM
            for x in own[1:]:
                kind = common(kind, x.type) or TERM
            kinds[v] = (kind, len(own) < len(rows))
        for r in rows:
            cols.append(F.struct(*[(cast_to(constant(t), kinds[v][0]) if t is not None else null(kinds[v][0]).col).alias(f"x{n}") for n, (v, t) in enumerate(zip(names, r))]) if names else F.struct(F.lit(1).alias("x")))
        df = self.data.spark.range(1).select(F.inline(F.array(*cols)))
        return Frame(df).select({v: Value(F.col(f"x{n}"), kinds[v][0], kinds[v][1]) for n, v in enumerate(names)})

    def _many_values(self, names: list[str], rows: list[list]) -> Frame:
        """Many rows as one text constant, so that the plan doesn't grow with them; their terms are structs."""
        from ..sources.rdf_io import canonical

        def cell(t):
            if isinstance(t, Literal):
                return {"kind": "literal", "v": t.value, "dt": LANG_STRING if t.lang else t.datatype, "lang": t.lang and t.lang.lower()}
            return t and {"kind": "iri", "v": t.value, "dt": None, "lang": None}

        text = json.dumps([{f"x{n}": cell(t) for n, t in enumerate(r)} for r in rows])
        shape = "array<struct<" + ",".join(f"x{n}:struct<kind:string,v:string,dt:string,lang:string>" for n in range(len(names))) + ">>"
        df = self.data.spark.range(1).select(F.inline(F.from_json(F.lit(text), shape)))
        out = {}
        for n, v in enumerate(names):
            x = F.col(f"x{n}")
            value, dt = canonical(x["v"], x["dt"])
            lit = F.struct(x["kind"].alias("kind"), value.alias("v"), dt.alias("dt"), x["lang"].alias("lang"))
            out[v] = Value(F.when(x["kind"] == "literal", lit).otherwise(x), TERM, any(r[n] is None for r in rows))
        return Frame(df).select(out)

    # -- filters and EXISTS
    def filter(self, f: Frame, e, graph) -> Frame:
        if e[0] == "op" and e[1] == "&&":
            for part in e[2]:
                f = self.filter(f, part, graph)
            return f
        negated = False
        while e[0] == "op" and e[1] == "!" and e[2][0][0] == "exists":
            e, negated = e[2][0], not negated
        if e[0] == "exists":
            return self.exists(f, e[1], e[2] != negated, graph)
        f, e = self.marked(f, e, graph)
        return f.where(self.expressions(f).condition(e))

    def _inner(self, f: Frame, p, graph) -> tuple[Frame, object]:
        """Pattern of an EXISTS and the part of its filter that looks at outer variables."""
        if p[0] == "filter" and (expression_variables(p[1]) - variables(p[2])) & set(f.scope) and not mentioned(p[1]) - expression_variables(p[1]):
            return self.pattern(self.correlate(p[2], f), graph), p[1]
        return self.pattern(self.correlate(p, f), graph), None

    def correlate(self, p, f: Frame):
        """The pattern of an EXISTS with the outer solutions joined to each group whose expressions look at them, at any depth."""

        def bring(names: set[str], inner):
            """The outer values of `names`, and of what `inner` shares with them, beside `inner`."""
            names = names & set(f.scope)
            if not names:
                return inner
            g = f.select({v: f.scope[v] for v in sorted(names | variables(inner) & set(f.scope))})
            return ("join", ("frame", Frame(g.df.distinct(), g.scope)), inner)

        kind = p[0]
        if kind == "filter":
            return ("filter", p[1], bring(mentioned(p[1]) - variables(p[2]), self.correlate(p[2], f)))
        if kind == "extend":
            return ("extend", bring(mentioned(p[3]) - variables(p[1]), self.correlate(p[1], f)), p[2], p[3])
        if kind == "optional":
            left, right = self.correlate(p[1], f), self.correlate(p[2], f)
            return ("optional", bring(mentioned(p[3]) - variables(p[1]) - variables(p[2]), left) if p[3] is not None else left, right, p[3])
        if kind in ("join", "union", "minus"):
            return (kind, self.correlate(p[1], f), self.correlate(p[2], f))
        if kind == "graph":
            return (kind, p[1], self.correlate(p[2], f))
        return p

    def exists(self, f: Frame, p, negated: bool, graph) -> Frame:
        inner, outer = self._inner(f, p, graph)
        shared = [v for v in f.scope if v in inner.scope]
        maybe = any(f.scope[v].nullable or inner.scope[v].nullable for v in shared)
        extra = None
        if outer is not None:
            extra = Expressions(self._merged(f, inner, shared, False) if maybe else inner.scope | f.scope, self.base).condition(outer)
        return self.existence(f, inner, negated, extra)

    def marked(self, f: Frame, e, graph):
        """EXISTS deep inside an expression: a marker column for each, and the expression over those."""
        if not isinstance(e, tuple) or e[0] not in ("op", "call", "exists"):
            return f, e
        if e[0] == "exists":
            # rows that meet the pattern, by their values; equal rows meet it alike
            row = fresh()
            base = Frame(f.df.withColumn(row, F.struct(*[to_term(x) for _, x in sorted(f.scope.items())]) if f.scope else F.lit(1)), f.scope)
            once = Frame(base.df.dropDuplicates([row]) if f.scope else base.df, f.scope)
            met = self.exists(once, e[1], False, graph).df.select(F.col(row).alias(row + "m")).distinct()
            df = base.df.join(met, F.col(row).eqNullSafe(F.col(row + "m")), "left_outer")
            v = "_e" + row
            scope = f.scope | {v: Value(F.col(row + "m").isNull() if e[2] else F.col(row + "m").isNotNull(), BOOL, False)}
            return Frame(df, scope).select(scope), ("var", v)
        args = []
        for a in e[2]:
            f, a = self.marked(f, a, graph)
            args.append(a)
        return f, (e[0], e[1], args)

    # -- paths
    def path(self, s, p, o, graph, near: list[Type] | None = None) -> Frame:
        kind = p[0]
        if kind == "pred":
            return self.bgp([(s, Iri(p[1]), o)], graph)
        if kind == "inv":
            return self.path(o, p[1], s, graph)
        if kind == "seq":
            mid = Var("_p" + fresh())
            f = self.join(self.path(s, p[1], mid, graph), self.path(mid, p[2], o, graph))
            return Frame(f.df, {v: x for v, x in f.scope.items() if v != mid.name})
        if kind == "alt":
            return self.union([self.path(s, p[1], o, graph), self.path(s, p[2], o, graph)])
        if kind == "not":
            return self.negated(s, p[1], p[2], o, graph, near)
        return self.reach(s, p, o, graph, near)

    def negated(self, s, ahead: list[str], back: list[str], o, graph, near: list[Type] | None = None) -> Frame:
        parts = []
        for iris, a, b in ((ahead, s, o), (back, o, s)):
            if iris or (not ahead and not back and a is s):
                v = Var("_p" + fresh())
                f = self.any_predicate(a, v, b, graph, near if a is s else None)
                f = f.where(~iri_text(f.scope[v.name]).isin(iris)) if iris else f
                parts.append(Frame(f.df, {n: x for n, x in f.scope.items() if n != v.name}))
        return self.union(parts)

    def reach(self, s, p, o, graph, near: list[Type] | None = None) -> Frame:
        """p+, p* and p? as sets of pairs.

        near: subject types of other patterns that s must meet; only such nodes need a pair with themselves.
        """
        g = graph if isinstance(graph, Var) else None
        a, b = Var("_s"), Var("_o")
        step = self.path(a, p[1], b, graph)
        x, y = step.scope["_s"], step.scope["_o"]
        if g is not None:
            return self._reach_by_graph(s, p, o, g, step)
        native = x.type == y.type and x.type.kind == "iri" and p[0] == "plus"
        kind = x.type if native else TERM
        edges = step.df.select(cast_to(x, kind).alias("s"), cast_to(y, kind).alias("o"))
        flip = not isinstance(o, Var) and isinstance(s, Var)  # walk from the end that is known
        first, last = (o, s) if flip else (s, o)
        if flip:
            edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
        start = None
        if not isinstance(first, Var):
            probe = Value(F.col("s"), kind, False)
            if native:
                start = edges.where(term_equals(probe, first, edges)).select("s").distinct()
            else:
                start = self.data.spark.range(1).select(to_term(constant(first)).alias("s"))
        if p[0] == "maybe":
            pairs = edges if start is None else edges.join(start, "s", "left_semi")
        else:
            pairs = closure(edges, start)
        if p[0] in ("star", "maybe"):
            known = [to_term(constant(t)) for t in (s, o) if not isinstance(t, Var)]
            if start is not None:
                nodes = start
            else:
                nodes = self.nodes(graph, near)
            if known and start is None:
                nodes = nodes.union(self.data.spark.range(1).select(known[0]))
            pairs = pairs.unionByName(nodes.toDF("s").select("s", F.col("s").alias("o"))).distinct()
        if flip:
            pairs = pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))
        return self._bind(pairs.distinct(), [(s, Value(F.col("s"), kind, False)), (o, Value(F.col("o"), kind, False))])

    def _reach_by_graph(self, s, p, o, g: Var, step: Frame) -> Frame:
        """p+, p* and p? within each named graph; a node is one of its graph."""
        node = lambda f, x: F.struct(iri_text(f.scope[g.name]).alias("g"), to_term(x).alias("x"))
        pairs = step.df.select(node(step, step.scope["_s"]).alias("s"), node(step, step.scope["_o"]).alias("o"))
        pairs = pairs if p[0] == "maybe" else closure(pairs)
        if p[0] != "plus":
            f = self.any_predicate(Var("_s"), Var("_q"), Var("_o"), g)
            nodes = f.df.select(F.explode(F.array(node(f, f.scope["_s"]), node(f, f.scope["_o"]))).alias("s"))
            pairs = pairs.unionByName(nodes.select("s", F.col("s").alias("o")))
        pairs = pairs.select(F.col("s.g").alias("g"), F.col("s.x").alias("s"), F.col("o.x").alias("o")).distinct()
        return self._bind(pairs, [(g, Value(F.col("g"), FULL_IRI, False)), (s, Value(F.col("s"), TERM, False)), (o, Value(F.col("o"), TERM, False))])

    def nodes(self, graph, near: list[Type] | None = None) -> DataFrame:
        """All subjects and objects of the graph, as terms; with `near`, only subjects of such types."""
        if near:
            parts = [m.df.select(to_term(m.subject).alias("s")) for m in self.tables(graph) if m.subject.type in near]
            out = parts[0]
            for d in parts[1:]:
                out = out.union(d)
            return out.distinct()
        f = self.any_predicate(Var("_s"), Var("_q"), Var("_o"), graph)
        return f.df.select(to_term(f.scope["_s"]).alias("s")).union(f.df.select(to_term(f.scope["_o"]))).distinct()

    # -- queries
    def select(self, q: Query, graph=None) -> Frame:
        f = self.pattern(q.pattern, graph)
        inside = sorted(visible(q.pattern))
        exprs = {}
        sel, having, order = q.select, list(q.having), list(q.order)
        from .parser import has_aggregate

        if q.group is not None or (sel and any(e is not None and has_aggregate(e) for _, e in sel)) or any(map(has_aggregate, having)) or any(has_aggregate(e) for e, _ in order):
            f, exprs = self.aggregate(f, q, graph)
            swap = lambda e: _replace(e, exprs)
            sel = [(v, None if e is None else swap(e)) for v, e in sel]
            having, order = [swap(e) for e in having], [(swap(e), d) for e, d in order]
            for e in having:
                f = self.filter(f, e, graph)
        for v, e in sel or []:
            if e is not None:
                f, e = self.marked(f, e, graph)
                f = f.extend({v: self.expressions(f)(e)})
        names = [v for v, _ in sel] if sel is not None else inside
        keys = []
        if order:
            ex = self.expressions(f)
            for e, down in order:
                keys += [k.desc_nulls_last() if down else k.asc_nulls_first() for k in sort_key(ex(e))]
        out = {v: f.scope.get(v) or null() for v in names}
        if q.distinct:
            g = f.select(out)
            f = Frame(g.df.distinct(), g.scope)
            if keys:
                ex = self.expressions(f)
                keys = [k.desc_nulls_last() if down else k.asc_nulls_first() for e, down in order for k in sort_key(ex(e))]
                f = Frame(f.df.orderBy(*keys), f.scope)
        else:
            if keys:
                f = Frame(f.df.orderBy(*keys), f.scope)
            f = f.select(out)
        if q.offset:
            f = Frame(f.df.offset(q.offset), f.scope)
        if q.limit is not None:
            f = Frame(f.df.limit(q.limit), f.scope)
        return f

    def aggregate(self, f: Frame, q: Query, graph) -> tuple[Frame, dict]:
        keys = []
        for v, e in q.group or []:
            if e is not None:
                f, e = self.marked(f, e, graph)
                f = f.extend({v: self.expressions(f)(e)})
            keys.append(v)
        found: dict = {}

        def collect(e):
            if isinstance(e, tuple):
                if e[0] == "agg":
                    found.setdefault(_freeze(e), (e, f"_a{len(found)}"))
                elif e[0] in ("op", "call"):
                    for x in e[2]:
                        collect(x)

        for _, e in q.select or []:
            if e is not None:
                collect(e)
        for e in q.having:
            collect(e)
        for e, _ in q.order:
            collect(e)
        ex = self.expressions(f)
        named = {v: f.scope.get(v) or null() for v in keys}
        f = Frame(f.df, f.scope | named)
        outs: dict[str, tuple[Column, Type]] = {}
        for e, name in found.values():
            outs[name] = self.one_aggregate(e, ex, f)
        cols = [x.col.alias(v_) for v_, x in ((f"k{n}", named[v]) for n, v in enumerate(keys))]
        aggs = [c.alias(n) for n, (c, _) in outs.items()] or [F.count(F.lit(1)).alias("_none")]
        df = f.df.groupBy(*cols).agg(*aggs) if keys or q.group else f.df.agg(*aggs)
        scope = {v: Value(F.col(f"k{n}"), named[v].type, named[v].nullable) for n, v in enumerate(keys)}
        scope |= {n: Value(F.col(n), t, True) for n, (_, t) in outs.items()}
        return Frame(df, scope).select(scope), {k: ("var", n) for k, (_, n) in found.items()}

    def one_aggregate(self, e, ex: Expressions, f: Frame) -> tuple[Column, Type]:
        _, name, distinct, arg, sep = e
        if arg is None:
            if distinct:
                # distinct solutions; a struct so that unbound variables don't drop a row
                return F.count_distinct(F.struct(*[to_term(x) for v, x in sorted(f.scope.items()) if not v.startswith("_")])), INT
            return F.count(F.lit(1)), INT
        x = ex(arg)
        if name == "COUNT":
            return (F.count_distinct(x.col) if distinct else F.count(x.col)), INT
        if name == "SAMPLE":
            return F.any_value(x.col, F.lit(True)), x.type
        if name in ("MIN", "MAX"):
            if x.type != TERM and x.type != NODE:
                return (F.min if name == "MIN" else F.max)(x.col), x.type
            key = F.struct(*[F.coalesce(k.cast("string"), F.lit("")) if n not in (1,) else k for n, k in enumerate(sort_key(x))])
            return (F.min_by if name == "MIN" else F.max_by)(x.col, F.when(x.col.isNotNull(), key)), x.type
        if name == "GROUP_CONCAT":
            s = text(x) if x.type in (STR, TERM) else F.lit(None).cast("string") if x.type.kind in ("iri", "node") else lexical_of(x.col, x.type.detail)
            if x.type == TERM:
                s = F.when(x.col["kind"] == "literal", x.col["v"])
            got = F.sort_array(F.collect_set(s) if distinct else F.collect_list(s))
            return F.array_join(got, sep), STR
        # SUM and AVG: an error on any value that isn't a number; nothing to add is the integer 0
        if x.numeric:
            dt = x.type.detail
            if name == "SUM":
                total = F.sum_distinct(x.col) if distinct else F.try_sum(x.col)
                if dt == DECIMAL:
                    total = total.try_cast("decimal(38,18)")
                kind = lit_type(dt if dt != FLOAT else FLOAT)
                return F.when(F.count(F.lit(1)) == F.count(x.col), F.coalesce(total.cast(NATIVE[dt]), F.when(F.count(F.lit(1)) == 0, F.lit(0)).cast(NATIVE[dt]))) if x.nullable else F.coalesce(total.cast(NATIVE[dt]), F.lit(0).cast(NATIVE[dt])), kind
            col = x.col.cast("decimal(28,9)") if dt in (INTEGER, DECIMAL) else x.col
            out = DEC if dt in (INTEGER, DECIMAL) else x.type
            if distinct:
                mean = F.try_divide(F.sum_distinct(col), F.count_distinct(col))
            else:
                mean = F.try_avg(col)
            mean = F.coalesce(mean.cast(NATIVE[out.detail]), F.lit(0).cast(NATIVE[out.detail]))
            return (F.when(F.count(F.lit(1)) == F.count(x.col), mean) if x.nullable else mean), out
        n, r = number(x), rank_of(x)
        sets = F.collect_set(F.struct(n.alias("n"), r.alias("r"))) if distinct else None
        total = F.aggregate(F.transform(sets, lambda a: a["n"]), F.lit(0.0), lambda a, b: a + b) if distinct else F.sum(n)
        many = F.size(sets) if distinct else F.count(n)
        total = F.when(many == 0, F.lit(0.0)).otherwise(total)
        good = F.count(F.lit(1)) == F.count(n)
        if name == "AVG":
            return F.when(good, F.when(many == 0, F.lit(0.0)).otherwise(F.try_divide(total, many))), DBL
        top = F.coalesce(F.max(r), F.lit(0))
        exact = F.sum(F.when(r <= 1, F.when(x.col["v"].isNotNull(), x.col["v"].try_cast("decimal(28,9)")))) if x.type == TERM and not distinct else total.cast("decimal(38,9)")
        exact = F.coalesce(exact, F.lit(0).cast("decimal(38,9)"))
        v = F.when(top == 0, exact.cast("bigint").cast("string")).when(top == 1, lexical_of(exact.cast("decimal(38,18)"), DECIMAL)).otherwise(lexical_of(total, DOUBLE))
        dt = F.when(top == 0, INTEGER).when(top == 1, DECIMAL).when(top == 2, FLOAT).otherwise(DOUBLE)
        return F.when(good, F.struct(F.lit("literal").alias("kind"), v.alias("v"), dt.alias("dt"), F.lit(None).cast("string").alias("lang"))), TERM


def mentioned(e) -> set[str]:
    """All variables of an expression, those of the patterns of its EXISTS too."""
    if not isinstance(e, tuple):
        return set()
    if e[0] == "exists":
        return _in_pattern(e[1])
    if e[0] in ("op", "call"):
        return set().union(*[mentioned(x) for x in e[2]]) if e[2] else set()
    return expression_variables(e)


def _in_pattern(p) -> set[str]:
    out = variables(p)
    if p[0] == "filter":
        return out | mentioned(p[1]) | _in_pattern(p[2])
    if p[0] == "extend":
        return out | mentioned(p[3]) | _in_pattern(p[1])
    if p[0] in ("join", "union", "minus", "optional"):
        return out | _in_pattern(p[1]) | _in_pattern(p[2]) | (mentioned(p[3]) if p[0] == "optional" and p[3] is not None else set())
    return out | _in_pattern(p[2]) if p[0] == "graph" else out


def _freeze(e):
    return repr(e)


def _replace(e, found: dict):
    if isinstance(e, tuple):
        if e[0] == "agg":
            return found[_freeze(e)]
        if e[0] in ("op", "call"):
            return (e[0], e[1], [_replace(x, found) for x in e[2]])
    return e


def result(f: Frame, names: list[str]) -> DataFrame:
    """Solutions as a DataFrame with a column a variable: native literals, IRIs as strings, other terms as structs."""
    low = [n.lower() for n in names]
    clash = {n for n in names if low.count(n.lower()) > 1}
    cols = []
    for n in names:
        x = f.scope[n]
        c = iri_text(x) if x.type.kind in ("iri", "node") else x.col
        cols.append(c.alias(n if n not in clash or low.index(n.lower()) == names.index(n) else f"{n}_{names.index(n)}"))
    return f.df.select(*cols)


def query_frame(q: Query, data: Dataset) -> tuple[Frame, list[str]]:
    c = Compiler(data, q.base, q.froms, q.named)
    names = [v for v, _ in q.select] if q.select is not None else sorted(visible(q.pattern))
    return c.select(q), names


def run_query(q: Query, data: Dataset) -> DataFrame:
    """Result of any query form: SELECT solutions, ASK (result), CONSTRUCT and DESCRIBE (s, p, o)."""
    if q.form == "select":
        f, names = query_frame(q, data)
        return result(f, names)
    c = Compiler(data, q.base, q.froms, q.named)
    if q.form == "ask":
        f = c.pattern(q.pattern)
        return f.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
    inner = Query("select", q.pattern, None, group=None, order=q.order, limit=q.limit, offset=q.offset, base=q.base)
    f = c.select(inner)
    if q.form == "construct":
        return instantiate(f, [(None, *t) for t in q.template]).select("s", "p", "o").distinct()
    parts = []
    for t in q.describe or [Var(v) for v in f.scope]:
        x = f.scope.get(t.name) if isinstance(t, Var) else constant(t)
        if x is not None and x.type.kind != "lit":
            v = iri_text(x) if x.type != TERM else F.when(x.col["kind"] != "literal", x.col["v"])
            parts.append((f.df if isinstance(t, Var) else data.spark.range(1)).select(v.alias("s")))
    if not parts:
        return data.spark.range(0).select(F.lit("").alias("s"), F.lit("").alias("p"), null().col.alias("o"))
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted.union(p)
    every = c.any_predicate(Var("s"), Var("p"), Var("o"), None)
    rows = every.df.select(iri_text(every.scope["s"]).alias("s"), iri_text(every.scope["p"]).alias("p"), to_term(every.scope["o"]).alias("o"))
    return rows.join(wanted.where("s is not null").distinct(), "s", "left_semi").select("s", "p", "o").distinct()


def instantiate(f: Frame, quads: list) -> DataFrame:
    """Rows (g, s, p, o) of a template, one a quad and solution; ill-typed or unbound ones are left out."""
    node = fresh()
    df = f.df.withColumn(node, F.uuid())

    def value(t) -> Value:
        if isinstance(t, Var):
            return f.scope.get(t.name) or null()
        if isinstance(t, Blank):
            return Value(F.concat(F.lit("_:"), F.col(node), F.lit(t.label)), NODE, False)
        return constant(t)

    def name(x: Value, blanks: bool) -> Column:
        if x.type.kind in ("iri", "node"):
            c = iri_text(x)
            return c if blanks or x.type.kind == "iri" else F.when(~c.startswith("_:"), c)
        if x.type == TERM:
            return F.when(x.col["kind"].isin("iri", "bnode") if blanks else x.col["kind"] == "iri", x.col["v"])
        return F.lit(None).cast("string")

    rows = []
    for g, s, p, o in quads:
        graph = F.lit(None).cast("string") if g is None else name(value(g), False)
        rows.append(F.struct(graph.alias("g"), name(value(s), True).alias("s"), name(value(p), False).alias("p"), to_term(value(o)).alias("o"), F.lit(g is not None).alias("named")))
    if not rows:
        return df.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in ("g", "s", "p")], null().col.alias("o"))
    out = df.select(F.inline(F.array(*rows)))
    return out.where("s is not null and p is not null and o is not null and (g is not null or not named)").select("g", "s", "p", "o")
