"""SHACL Core validation.

The shapes graph is small and is read to the driver (MAX_SHAPE_TRIPLES at most, else an error); the
data stay distributed.  A constraint is a plan over (focus, value) pairs, the values coming from
the property path operator; a shape used by another is checked on the values in question as a set,
and what doesn't conform is joined back.  Results: one row a violation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DATETIME, STRING, TERM, Value, instant, number, to_term
from ..lineage import cut
from ..plans.compiler import Compiler, Frame
from ..plans.parser import inverse
from ..sources.mapping import Dataset
from ..terms import LANG_STRING, NUMERICS, RDF, RDFS, RDF_TYPE, SH, XSD, Blank, Iri, Literal, QueryError, Var
from .reasoner import well_typed

MAX_SHAPE_TRIPLES = 200_000
MAX_DEPTH = 32
RESULT = ("focus_node", "path", "value", "source_shape", "component", "severity", "message")


@dataclass
class Shapes:
    """The shapes graph by subject and predicate; objects are (kind, v, dt, lang)."""

    index: dict[str, dict[str, list[tuple]]] = field(default_factory=dict)

    @classmethod
    def read(cls, quads: DataFrame) -> "Shapes":
        rows = quads.select("s", "p", "o").limit(MAX_SHAPE_TRIPLES + 1).collect()
        if len(rows) > MAX_SHAPE_TRIPLES:
            raise QueryError("the shapes graph is too large")
        out = cls()
        for r in sorted(rows, key=str):
            out.index.setdefault(r["s"], {}).setdefault(r["p"], []).append(tuple(r["o"]))
        return out

    def all(self, s: str, name: str) -> list[tuple]:
        return self.index.get(s, {}).get(SH + name if ":" not in name else name, [])

    def one(self, s: str, name: str):
        got = self.all(s, name)
        return got[0][1] if got else None

    def items(self, head: str) -> list[tuple]:
        out = []
        seen = set()
        while head != RDF + "nil":
            if head in seen:
                raise QueryError("a list runs in circles")
            seen.add(head)
            node = self.index.get(head, {})
            out.append(node[RDF + "first"][0])
            head = node[RDF + "rest"][0][1]
        return out

    def path(self, node: tuple):
        """A SHACL path as a path of the algebra."""
        kind, v = node[0], node[1]
        if kind == "iri":
            return ("pred", v)
        own = self.index.get(v, {})
        if RDF + "first" in own:
            steps = [self.path(x) for x in self.items(v)]
            out = steps[0]
            for s in steps[1:]:
                out = ("seq", out, s)
            return out
        for name, make in (("inversePath", inverse), ("zeroOrMorePath", lambda x: ("star", x)), ("oneOrMorePath", lambda x: ("plus", x)), ("zeroOrOnePath", lambda x: ("maybe", x))):
            if SH + name in own:
                return make(self.path(own[SH + name][0]))
        if SH + "alternativePath" in own:
            parts = [self.path(x) for x in self.items(own[SH + "alternativePath"][0][1])]
            out = parts[0]
            for p in parts[1:]:
                out = ("alt", out, p)
            return out
        raise QueryError(f"not a path: {v}")

    def path_text(self, node: tuple) -> str:
        p = self.path(node)
        return p[1] if p[0] == "pred" else repr(p)


def constant(t: tuple) -> Column:
    kind, v, dt, lang = t
    cast = lambda x: F.lit(x).cast("string")
    return F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("v"), cast(dt).alias("dt"), cast(lang).alias("lang"))


def as_term(t: tuple):
    kind, v, dt, lang = t
    return Iri(v) if kind == "iri" else Blank(v[2:]) if kind == "bnode" else Literal(v, dt, lang)


class Validator:
    def __init__(self, data: Dataset, shapes: DataFrame):
        self.data, self.spark = data, data.spark
        self.shapes = Shapes.read(shapes)
        self.compiler = Compiler(data)

    # -- data access
    def pairs(self, path) -> DataFrame:
        """(f, v) of a path, as a set of terms."""
        f = self.compiler.path(Var("f"), path, Var("v"), None)
        return f.df.select(to_term(f.scope["f"]).alias("f"), to_term(f.scope["v"]).alias("v")).distinct()

    def triples(self) -> DataFrame:
        f = self.compiler.any_predicate(Var("s"), Var("p"), Var("o"), None)
        return f.df.select(to_term(f.scope["s"]).alias("s"), to_term(f.scope["p"])["v"].alias("p"), to_term(f.scope["o"]).alias("o"))

    def instances(self, cls: str) -> DataFrame:
        """Nodes (f) of a class or of one below it; the class tree may stand in data or shapes."""
        below = {cls}
        more = True
        tree = [(s, o[1]) for s, ps in self.shapes.index.items() for o in ps.get(RDFS + "subClassOf", [])]
        while more:
            new = {s for s, o in tree if o in below} - below
            below |= new
            more = bool(new)
        path = ("seq", ("pred", RDF_TYPE), ("star", ("pred", RDFS + "subClassOf")))
        if not self.compiler.homes(RDFS + "subClassOf", Var("o"), None):
            path = ("pred", RDF_TYPE)
        out = None
        for c in sorted(below):
            f = self.compiler.path(Var("f"), path, Iri(c), None)
            df = f.df.select(to_term(f.scope["f"]).alias("f"))
            out = df if out is None else out.union(df)
        return out.distinct()

    def targets(self, shape: str) -> DataFrame | None:
        parts = []
        for t in self.shapes.all(shape, "targetNode"):
            parts.append(self.spark.range(1).select(constant(t).alias("f")))
        classes = [t[1] for t in self.shapes.all(shape, "targetClass")]
        if any(t[1] in (RDFS + "Class", "http://www.w3.org/2002/07/owl#Class") for t in self.shapes.all(shape, RDF_TYPE)):
            classes.append(shape)
        parts += [self.instances(c) for c in classes]
        for name, side in (("targetSubjectsOf", "f"), ("targetObjectsOf", "v")):
            for t in self.shapes.all(shape, name):
                parts.append(self.pairs(("pred", t[1])).select(F.col(side).alias("f")))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    # -- shapes
    def violations(self, shape: str, focus: DataFrame, depth: int = 0) -> list[DataFrame]:
        """Result rows of a shape on focus nodes (f)."""
        if depth > MAX_DEPTH or self.shapes.one(shape, "deactivated") in ("true", "1"):
            return []
        path_node = self.shapes.all(shape, "path")
        path_text = None
        if path_node:
            path_text = self.shapes.path_text(path_node[0])
            values = focus.join(self.pairs(self.shapes.path(path_node[0])), "f")
        else:
            values = focus.select("f", F.col("f").alias("v"))
        message = self.shapes.one(shape, "message")
        severity = self.shapes.one(shape, "severity") or SH + "Violation"
        out = []

        def report(df: DataFrame, component: str, has_value: bool = True, of: str = shape) -> None:
            value = F.col("v") if has_value else F.lit(None).cast("struct<kind: string, v: string, dt: string, lang: string>")
            out.append(df.select(F.col("f").alias("focus_node"), F.lit(path_text).cast("string").alias("path"), value.alias("value"), F.lit(of).alias("source_shape"), F.lit(SH + component).alias("component"), F.lit(severity).alias("severity"), F.lit(message).cast("string").alias("message")))

        one = lambda name: self.shapes.one(shape, name)
        v = F.col("v")
        val = Value(v, TERM)
        text = F.when(v["kind"] != "bnode", v["v"])
        bad = lambda ok: values.where(~F.coalesce(ok, F.lit(False)))

        for t in self.shapes.all(shape, "class"):
            report(values.join(self.instances(t[1]).select(F.col("f").alias("v")), "v", "left_anti"), "ClassConstraintComponent")
        for t in self.shapes.all(shape, "datatype"):
            report(bad((v["kind"] == "literal") & (v["dt"] == t[1]) & well_typed(v["v"], v["dt"])), "DatatypeConstraintComponent")
        kinds = {"IRI": ("iri",), "BlankNode": ("bnode",), "Literal": ("literal",), "BlankNodeOrIRI": ("bnode", "iri"), "BlankNodeOrLiteral": ("bnode", "literal"), "IRIOrLiteral": ("iri", "literal")}
        for t in self.shapes.all(shape, "nodeKind"):
            report(bad(v["kind"].isin(*kinds[t[1][len(SH) :]])), "NodeKindConstraintComponent")
        counts = None
        if one("minCount") is not None or one("maxCount") is not None:
            counts = focus.join(values.groupBy("f").agg(F.count("v").alias("n")), "f", "left_outer").withColumn("n", F.coalesce("n", F.lit(0)))
        if one("minCount") is not None:
            report(counts.where(F.col("n") < int(one("minCount"))), "MinCountConstraintComponent", False)
        if one("maxCount") is not None:
            report(counts.where(F.col("n") > int(one("maxCount"))), "MaxCountConstraintComponent", False)
        if one("minLength") is not None:
            report(bad(F.char_length(text) >= int(one("minLength"))), "MinLengthConstraintComponent")
        if one("maxLength") is not None:
            report(bad(F.char_length(text) <= int(one("maxLength"))), "MaxLengthConstraintComponent")
        for t in self.shapes.all(shape, "pattern"):
            flags = re.sub("[^ismx]", "", one("flags") or "")
            report(bad(text.rlike(f"(?{flags}){t[1]}" if flags else t[1])), "PatternConstraintComponent")
        for name, act in (("minInclusive", ">="), ("maxInclusive", "<="), ("minExclusive", ">"), ("maxExclusive", "<")):
            for t in self.shapes.all(shape, name):
                report(bad(ordered(val, Value(constant(t), TERM), act)), name[0].upper() + name[1:] + "ConstraintComponent")
        for name, keep in (("equals", None), ("disjoint", True)):
            for t in self.shapes.all(shape, name):
                other = focus.join(self.pairs(("pred", t[1])), "f")
                if keep:
                    report(values.join(other, ["f", "v"], "left_semi"), "DisjointConstraintComponent")
                else:
                    report(values.join(other, ["f", "v"], "left_anti").union(other.join(values, ["f", "v"], "left_anti")), "EqualsConstraintComponent")
        for name, act in (("lessThan", "<"), ("lessThanOrEquals", "<=")):
            for t in self.shapes.all(shape, name):
                other = self.pairs(("pred", t[1])).select("f", F.col("v").alias("w"))
                both = values.join(other, "f").where(~F.coalesce(ordered(val, Value(F.col("w"), TERM), act), F.lit(False)))
                report(both.select("f", "v"), name[0].upper() + name[1:] + "ConstraintComponent")
        for t in self.shapes.all(shape, "in"):
            report(bad(F.array_contains(F.array(*[constant(x) for x in self.shapes.items(t[1])]), v)) if self.shapes.items(t[1]) else values, "InConstraintComponent")
        for t in self.shapes.all(shape, "hasValue"):
            report(focus.join(values.where(v == constant(t)).select("f"), "f", "left_anti"), "HasValueConstraintComponent", False)
        for t in self.shapes.all(shape, "languageIn"):
            ok = F.lit(False)
            for x in self.shapes.items(t[1]):
                tag = x[1].lower()
                ok = ok | (v["lang"] == tag) | v["lang"].startswith(tag + "-")
            report(bad(ok), "LanguageInConstraintComponent")
        if one("uniqueLang") in ("true", "1"):
            twice = values.where(v["lang"].isNotNull() & (v["lang"] != "")).groupBy("f", F.lower(v["lang"]).alias("l")).agg(F.count("*").alias("n")).where("n > 1")
            report(twice.select("f"), "UniqueLangConstraintComponent", False)
        for t in self.shapes.all(shape, "node"):
            report(self.semi(values, self.failing(t[1], values, depth)), "NodeConstraintComponent")
        for t in self.shapes.all(shape, "not"):
            report(self.anti(values, self.failing(t[1], values, depth)), "NotConstraintComponent")
        for t in self.shapes.all(shape, "and"):
            fails = [self.failing(x[1], values, depth) for x in self.shapes.items(t[1])]
            report(self.semi(values, self.some(fails)), "AndConstraintComponent")
        for name, good in (("or", lambda n, k: n < k), ("xone", lambda n, k: n == k - 1)):
            for t in self.shapes.all(shape, name):
                parts = self.shapes.items(t[1])
                fails = [self.failing(x[1], values, depth) for x in parts]
                union = self.union([x.distinct() for x in fails if x is not None])
                nodes = values.select("v").distinct()
                n = nodes.join(union.groupBy("v").agg(F.count("*").alias("n")), "v", "left_outer") if union is not None else nodes.withColumn("n", F.lit(0))
                wrong = n.where(~good(F.coalesce("n", F.lit(0)), len(parts))).select("v")
                report(values.join(wrong, "v", "left_semi"), "OrConstraintComponent" if name == "or" else "XoneConstraintComponent")
        for t in self.shapes.all(shape, "qualifiedValueShape"):
            fails = self.failing(t[1], values, depth)
            fit = self.anti(values, fails)
            if one("qualifiedValueShapesDisjoint") in ("true", "1"):
                for sib in self.siblings(shape):
                    if sib != t[1]:
                        fit = self.semi(fit, self.failing(sib, fit, depth))
            n = focus.join(fit.groupBy("f").agg(F.count("*").alias("n")), "f", "left_outer").withColumn("n", F.coalesce("n", F.lit(0)))
            if one("qualifiedMinCount") is not None:
                report(n.where(F.col("n") < int(one("qualifiedMinCount"))), "QualifiedMinCountConstraintComponent", False)
            if one("qualifiedMaxCount") is not None:
                report(n.where(F.col("n") > int(one("qualifiedMaxCount"))), "QualifiedMaxCountConstraintComponent", False)
        if one("closed") in ("true", "1"):
            allowed = [t[1] for p in self.shapes.all(shape, "property") for t in self.shapes.all(p[1], "path") if t[0] == "iri"]
            allowed += [x[1] for t in self.shapes.all(shape, "ignoredProperties") for x in self.shapes.items(t[1])]
            extra = values.select("f", F.col("v").alias("s")).join(self.triples(), "s").where(~F.col("p").isin(*allowed) if allowed else F.lit(True))
            rows = extra.select(F.col("f").alias("focus_node"), F.col("p").alias("path"), F.col("o").alias("value"))
            out.append(rows.select("focus_node", "path", "value", F.lit(shape).alias("source_shape"), F.lit(SH + "ClosedConstraintComponent").alias("component"), F.lit(severity).alias("severity"), F.lit(message).cast("string").alias("message")))
        for t in self.shapes.all(shape, "property"):
            out += self.violations(t[1], values.select(F.col("v").alias("f")).distinct(), depth + 1)
        return out

    def siblings(self, shape: str) -> list[str]:
        parents = [s for s, ps in self.shapes.index.items() if any(o[1] == shape for o in ps.get(SH + "property", []))]
        return [q[1] for s in parents for p in self.shapes.all(s, "property") for q in self.shapes.all(p[1], "qualifiedValueShape")]

    def failing(self, shape: str, values: DataFrame, depth: int) -> DataFrame | None:
        """Values (v) that don't conform to a shape; None if all do."""
        found = self.violations(shape, values.select(F.col("v").alias("f")).distinct(), depth + 1)
        return self.union([d.select(F.col("focus_node").alias("v")).distinct() for d in found]) if found and not self._nested(shape) else self._failing_nested(shape, values, depth)

    def _nested(self, shape: str) -> bool:
        return bool(self.shapes.all(shape, "property"))

    def _failing_nested(self, shape: str, values: DataFrame, depth: int) -> DataFrame | None:
        """As `failing`, for a shape with property shapes: their violations are of the nodes they start from."""
        if self.shapes.one(shape, "deactivated") in ("true", "1") or depth > MAX_DEPTH:
            return None
        nodes = values.select(F.col("v").alias("f")).distinct()
        own = Shapes({**self.shapes.index, shape: {k: o for k, o in self.shapes.index.get(shape, {}).items() if k != SH + "property"}})
        whole, self.shapes = self.shapes, own
        try:
            parts = [d.select(F.col("focus_node").alias("v")) for d in self.violations(shape, nodes, depth + 1)]
        finally:
            self.shapes = whole
        if self.shapes.all(shape, "path"):
            values_of = nodes.join(self.pairs(self.shapes.path(self.shapes.all(shape, "path")[0])), "f")
        else:
            values_of = nodes.select("f", F.col("f").alias("v"))
        for p in self.shapes.all(shape, "property"):
            bad = self.failing(p[1], values_of, depth + 1)
            if bad is not None:
                parts.append(values_of.join(bad.distinct(), "v", "left_semi").select(F.col("f").alias("v")))
        return self.union(parts)

    def union(self, parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for p in parts:
            out = p if out is None else out.union(p)
        return out

    def some(self, parts: list) -> DataFrame | None:
        got = self.union([p for p in parts if p is not None])
        return None if got is None else got.distinct()

    def semi(self, values: DataFrame, fails: DataFrame | None) -> DataFrame:
        return values.limit(0) if fails is None else values.join(fails.distinct(), "v", "left_semi")

    def anti(self, values: DataFrame, fails: DataFrame | None) -> DataFrame:
        return values if fails is None else values.join(fails.distinct(), "v", "left_anti")

    def validate(self) -> DataFrame:
        """All results of the shapes that have targets."""
        out = []
        for s in sorted(self.shapes.index):
            focus = self.targets(s)
            if focus is not None:
                out += self.violations(s, cut(focus))
        if not out:
            return self.spark.createDataFrame([], "focus_node struct<kind: string, v: string, dt: string, lang: string>, path string, value struct<kind: string, v: string, dt: string, lang: string>, source_shape string, component string, severity string, message string")
        return self.union(out)


def ordered(a: Value, b: Value, act: str) -> Column:
    """Comparison of two terms of one family; NULL where they can't be compared, as with one zone missing."""
    do = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[act]
    x, y = a.col, b.col
    zone = lambda c: c["v"].rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$")
    dates = F.when((x["dt"] == DATETIME) & (y["dt"] == DATETIME) & (zone(x) == zone(y)), do(instant(a), instant(b)))
    nums = do(number(a), number(b))
    same = (x["kind"] == "literal") & (y["kind"] == "literal") & (x["dt"] == y["dt"]) & ~x["dt"].isin(*NUMERICS, DATETIME, LANG_STRING)
    return F.coalesce(nums, dates, F.when(same, do(x["v"], y["v"])))


def validate(data: Dataset, shapes: DataFrame) -> tuple[bool, DataFrame]:
    """(conforms, results): it conforms iff there are no results, whatever their severity; results in order of focus, path and value."""
    rows = cut(Validator(data, shapes).validate())
    return rows.isEmpty(), rows.orderBy("focus_node", "path", "value")
