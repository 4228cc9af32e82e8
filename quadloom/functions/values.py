"""Typed columns: how a SPARQL value is kept in a DataFrame column.

A value's type says what its column holds:
  iri(template)  the native key, the IRI being the template and the key; an empty template: the whole IRI
  node           an IRI or a blank node (`_:label`) as a string
  lit(datatype)  a native column: BIGINT, DECIMAL, DOUBLE, FLOAT, BOOLEAN, STRING or TIMESTAMP_NTZ
  term           struct<kind, v, dt, lang>, for what is known only at run time
An unbound variable, and the value of an expression in error, is NULL in all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import INTEGERS, LANG_STRING, NUMERICS, XSD, Blank, Iri, Literal

TERM_SCHEMA = "struct<kind: string, v: string, dt: string, lang: string>"
STRING, INTEGER, DECIMAL, FLOAT, DOUBLE, BOOLEAN, DATETIME = (XSD + n for n in ("string", "integer", "decimal", "float", "double", "boolean", "dateTime"))
RANK = {INTEGER: 0, DECIMAL: 1, FLOAT: 2, DOUBLE: 3}
NATIVE = {STRING: "string", INTEGER: "bigint", DECIMAL: "decimal(38,18)", FLOAT: "float", DOUBLE: "double", BOOLEAN: "boolean", DATETIME: "timestamp_ntz"}


@dataclass(frozen=True)
class Type:
    kind: str
    detail: str = ""


TERM, NODE, FULL_IRI = Type("term"), Type("node"), Type("iri", "")


def lit_type(datatype: str) -> Type:
    return Type("lit", datatype)


BOOL, STR, INT, DEC, DBL, WHEN = map(lit_type, (BOOLEAN, STRING, INTEGER, DECIMAL, DOUBLE, DATETIME))


@dataclass(frozen=True)
class Value:
    col: Column
    type: Type
    nullable: bool = True
    fixed: bool = False  # a constant of the query, and no NaN

    @property
    def numeric(self) -> bool:
        return self.type.kind == "lit" and self.type.detail in RANK


def null(kind: Type = TERM) -> Value:
    return Value(F.lit(None).cast(TERM_SCHEMA if kind == TERM else NATIVE.get(kind.detail, "string") if kind.kind == "lit" else "string"), kind)


def constant(t) -> Value:
    """Column of a term of the query."""
    if isinstance(t, Iri):
        return Value(F.lit(t.value), FULL_IRI, False)
    if isinstance(t, Blank):
        return Value(F.lit("_:" + t.label), NODE, False)
    if t.lang is None:
        native = INTEGER if t.datatype in INTEGERS[:3] else t.datatype
        if native in (INTEGER, DECIMAL, DOUBLE, FLOAT, BOOLEAN, STRING) and well_formed(t.value, native):
            v: object = t.value
            if native == INTEGER and -(1 << 63) <= int(t.value) < 1 << 63:
                return Value(F.lit(int(t.value)).cast("bigint"), INT, False)
            if native == BOOLEAN:
                return Value(F.lit(t.value == "true"), BOOL, False)
            if native in (DOUBLE, FLOAT):
                v = float(t.value.replace("INF", "inf"))
                return Value(F.lit(v).cast(NATIVE[native]), lit_type(native), False)
            if native in (DECIMAL, STRING):
                return Value(F.lit(v).cast(NATIVE[native]), lit_type(native), False)
    return Value(F.struct(F.lit("literal").alias("kind"), F.lit(t.value).alias("v"), F.lit(t.datatype).alias("dt"), F.lit(t.lang).cast("string").alias("lang")), TERM, False)


def well_formed(text: str, datatype: str) -> bool:
    import re

    shape = {INTEGER: r"[+-]?[0-9]+", DECIMAL: r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", BOOLEAN: "true|false", STRING: r"(?s).*"}.get(datatype, r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN")
    return re.fullmatch(shape, text) is not None


def lexical_of(col: Column, datatype: str) -> Column:
    """Lexical form of a native literal column."""
    if datatype == DATETIME:
        whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        frac = F.regexp_replace(F.date_format(col, "SSSSSS"), "0+$", "")
        return F.when(frac == "", whole).otherwise(F.concat(whole, F.lit("."), frac))
    if datatype == DECIMAL:
        s = F.regexp_replace(col.cast("string"), r"(\.[0-9]*?)0+$", "$1")
        return F.regexp_replace(s, r"\.$", "")
    if datatype in (DOUBLE, FLOAT):
        s = col.cast("string")
        return F.when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").otherwise(s)
    return col.cast("string")


def iri_text(x: Value) -> Column:
    """Whole IRI (or blank node) of an iri or node column."""
    if x.type.kind == "iri" and x.type.detail:
        return F.concat(F.lit(x.type.detail), x.col.cast("string"))
    return x.col


def to_term(x: Value) -> Column:
    """Any value as the struct."""
    if x.type == TERM:
        return x.col
    if x.type.kind == "lit":
        v, kind, dt = lexical_of(x.col, x.type.detail), F.lit("literal"), F.lit(x.type.detail)
    else:
        v, dt = iri_text(x), F.lit(None).cast("string")
        kind = F.when(v.startswith("_:"), "bnode").otherwise("iri") if x.type == NODE else F.lit("iri")
    return F.when(x.col.isNotNull(), F.struct(kind.alias("kind"), v.alias("v"), dt.alias("dt"), F.lit(None).cast("string").alias("lang")))


def common(a: Type, b: Type) -> Type | None:
    """A type that holds both values' terms; None if no term has both types."""
    if a == b:
        return a
    nodes = ("iri", "node")
    if a.kind in nodes and b.kind in nodes:
        if a.detail and b.detail and not a.detail.startswith(b.detail) and not b.detail.startswith(a.detail):
            return None
        return FULL_IRI if a.kind == b.kind == "iri" else NODE
    if a == TERM or b == TERM:
        return TERM
    return None


def cast_to(x: Value, kind: Type) -> Column:
    if x.type == kind:
        return x.col
    if kind == TERM:
        return to_term(x)
    if kind in (NODE, FULL_IRI):
        return iri_text(x)
    raise AssertionError((x.type, kind))


def same_term(a: Value, b: Value) -> Column:
    """Term identity."""
    kind = common(a.type, b.type)
    if kind is None:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)) if a.nullable or b.nullable else F.lit(False)
    if a.type.kind == "iri" and a.type.detail and b.type == FULL_IRI or b.type.kind == "iri" and b.type.detail and a.type == FULL_IRI:
        return iri_text(a) == iri_text(b)
    if kind == TERM:
        # structs with nulls inside: null-safe below the top
        return F.when(a.col.isNotNull() & b.col.isNotNull(), to_term(a).eqNullSafe(to_term(b)))
    return cast_to(a, kind) == cast_to(b, kind)


def term_numeric(c: Column) -> Column:
    return c["dt"].isin(*NUMERICS)


def number(x: Value) -> Column:
    """Value as a double; NULL if it isn't a number."""
    if x.numeric:
        return x.col.cast("double")
    if x.type == TERM:
        v = F.when(x.col["v"] == "INF", "Infinity").when(x.col["v"] == "-INF", "-Infinity").otherwise(x.col["v"])
        return F.when(term_numeric(x.col), v.try_cast("double"))
    return F.lit(None).cast("double")


def rank_of(x: Value) -> Column:
    """Place in the numeric tower; NULL if it isn't a number."""
    if x.numeric:
        return F.lit(RANK[x.type.detail])
    if x.type == TERM:
        d = x.col["dt"]
        return F.when(d.isin(*INTEGERS), 0).when(d == DECIMAL, 1).when(d == FLOAT, 2).when(d == DOUBLE, 3)
    return F.lit(None).cast("int")


def text(x: Value) -> Column:
    """Value of a string literal (simple or with a language); NULL for all else."""
    if x.type == STR:
        return x.col
    if x.type == TERM:
        return F.when((x.col["kind"] == "literal") & x.col["dt"].isin(STRING, LANG_STRING), x.col["v"])
    return F.lit(None).cast("string")


def language(x: Value) -> Column:
    return x.col["lang"] if x.type == TERM else F.lit(None).cast("string")


def instant(x: Value) -> Column:
    """dateTime as TIMESTAMP, a missing zone read as UTC; NULL for all else."""
    if x.type == WHEN:
        return x.col.cast("timestamp")
    if x.type == TERM:
        return F.when(x.col["dt"] == DATETIME, F.regexp_replace(x.col["v"], "T", " ").try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def boolean(x: Value) -> Column:
    """xsd:boolean as BOOLEAN; NULL for all else."""
    if x.type == BOOL:
        return x.col
    if x.type == TERM:
        return F.when(x.col["dt"] == BOOLEAN, F.when(x.col["v"].isin("true", "1"), True).when(x.col["v"].isin("false", "0"), False))
    return F.lit(None).cast("boolean")


def is_string(x: Value) -> Column:
    return (x.col["kind"] == "literal") & x.col["dt"].isin(STRING, LANG_STRING)


def sort_key(x: Value) -> list[Column]:
    """Columns that order values: unbound, blank nodes, IRIs, literals; numbers by value, all else by text."""
    if x.type == TERM:
        c = x.col
        return [F.when(c["kind"] == "bnode", 1).when(c["kind"] == "iri", 2).when(c["kind"] == "literal", F.when(term_numeric(c), 3).otherwise(4)), number(x), F.coalesce(instant(x).cast("string"), c["v"]), c["lang"]]
    if x.type == NODE:
        return [F.when(x.col.startswith("_:"), 1).otherwise(2), x.col]
    if x.type.kind == "iri" and x.type.detail:
        return [iri_text(x)]
    return [x.col]
