"""SPARQL expressions as Spark columns.  An error is NULL, so Spark's three-valued logic is SPARQL's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import GEOF, INTEGERS, LANG_STRING, NUMERICS, RDF, XSD, Iri, Literal, QueryError, resolve
from . import geo
from .values import BOOL, BOOLEAN, DATETIME, DBL, DEC, DECIMAL, DOUBLE, FLOAT, FULL_IRI, INT, INTEGER, NATIVE, NODE, RANK, STR, STRING, TERM, TERM_SCHEMA, WHEN, Type, Value, boolean, common, cast_to, constant, instant, iri_text, is_string, language, lexical_of, lit_type, null, number, rank_of, same_term, term_numeric, text, to_term

#: IRI -> function of Values to a Value; see register_function.
CUSTOM: dict[str, Callable[..., Value]] = {}
DURATION = XSD + "dayTimeDuration"


def register_function(iri: str, fn: Callable[..., Value]) -> None:
    """Make `fn`, a function of Values that returns a Value, callable by its IRI."""
    CUSTOM[iri] = fn


def literal(v: Column, dt, lang=None) -> Value:
    """A literal struct; NULL if v is."""
    dt = F.lit(dt) if isinstance(dt, str) else dt
    lang = F.lit(None).cast("string") if lang is None else lang
    return Value(F.when(v.isNotNull(), F.struct(F.lit("literal").alias("kind"), v.alias("v"), dt.alias("dt"), lang.alias("lang"))), TERM)


def effective(x: Value) -> Column:
    """Effective boolean value; NULL where there is none."""
    if x.type == BOOL:
        return x.col
    if x.numeric:
        return (x.col != 0) & ~F.isnan(x.col.cast("double")) if x.type.detail in (FLOAT, DOUBLE) else x.col != 0
    if x.type == STR:
        return F.length(x.col) > 0
    if x.type == TERM:
        n = number(x)
        return F.when(term_numeric(x.col), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).when(x.col["dt"] == BOOLEAN, F.coalesce(boolean(x), F.lit(False))).when(is_string(x), F.length(x.col["v"]) > 0)
    return F.lit(None).cast("boolean")


def _not_nan(x: Value) -> Column | None:
    return ~F.isnan(x.col) if x.numeric and x.type.detail in (FLOAT, DOUBLE) and not x.fixed else None


def compare(sign: str, a: Value, b: Value) -> Column:
    """= != < <= > >= by value."""
    if sign == "!=":
        return ~compare("=", a, b)
    act = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[sign]
    if a.numeric and b.numeric:
        out = act(a.col, b.col)
        for x in (a, b):  # NaN equals nothing and is above nothing
            guard = _not_nan(x)
            if guard is not None and sign != "<":
                out = out & guard
        return out
    if a.type == b.type and a.type in (STR, BOOL, WHEN):
        return act(a.col, b.col)
    nodes = ("iri", "node")
    if a.type.kind in nodes and b.type.kind in nodes:
        return same_term(a, b) if sign == "=" else act(iri_text(a), iri_text(b))
    if TERM not in (a.type, b.type):
        if WHEN in (a.type, b.type) and {a.type, b.type} <= {WHEN, STR} and sign != "=":
            return F.lit(None).cast("boolean")
        if sign == "=" and (a.type.kind in nodes) != (b.type.kind in nodes):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        known = {STR, BOOL, WHEN}
        if sign == "=" and (a.numeric or a.type in known) and (b.numeric or b.type in known):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
        return F.lit(None).cast("boolean")
    x, y = to_term(a), to_term(b)
    n, m = number(a), number(b)
    both_num = F.when(n.isNotNull() & m.isNotNull(), F.when(F.isnan(n) | F.isnan(m), F.lit(sign == "=") & F.lit(False)).otherwise(act(n, m)))
    s, t = text(a), text(b)
    lang_a, lang_b = F.coalesce(language(a), F.lit("")), F.coalesce(language(b), F.lit(""))
    both_str = F.when(s.isNotNull() & t.isNotNull(), ((s == t) & (lang_a == lang_b)) if sign == "=" else F.when(s != t, act(s, t)).otherwise(act(lang_a, lang_b)))
    both_time = act(instant(a), instant(b))
    both_bool = act(boolean(a), boolean(b))
    typed = F.coalesce(both_num, both_str, both_time, both_bool)
    ready = x.isNotNull() & y.isNotNull()
    if sign == "=":
        node = (x["kind"] != "literal") | (y["kind"] != "literal")
        known = lambda c: c["dt"].isin(*NUMERICS, STRING, LANG_STRING, DATETIME, BOOLEAN)
        return F.when(ready, F.when(node, x.eqNullSafe(y)).otherwise(F.coalesce(typed, F.when(x.eqNullSafe(y), F.lit(True)).when(known(x) & known(y), F.lit(False)))))
    return F.when(ready, F.when((x["kind"] == "iri") & (y["kind"] == "iri"), act(x["v"], y["v"])).otherwise(typed))


def arithmetic(sign: str, a: Value, b: Value) -> Value:
    """+ - * / by the numeric tower; int / int is a decimal, division by zero and overflow are errors."""
    act = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[sign]
    if a.numeric and b.numeric:
        top = max(a.type.detail, b.type.detail, key=RANK.__getitem__)
        if sign == "/" and top == INTEGER:
            top = DECIMAL
        return Value(_act(act, sign, a.col, b.col, top), lit_type(top))
    r = F.greatest(rank_of(a), rank_of(b))
    r = F.when(rank_of(a).isNotNull() & rank_of(b).isNotNull(), r)
    native = lambda x, kind: x.col.cast(kind) if x.numeric else (x.col["v"].try_cast(kind) if x.type == TERM else F.lit(None).cast(kind))
    parts = []
    for rank, dt in enumerate((INTEGER, DECIMAL, FLOAT, DOUBLE)):
        out = DECIMAL if sign == "/" and dt == INTEGER else dt
        v = _act(act, sign, native(a, NATIVE[out]) if dt not in (FLOAT, DOUBLE) else number(a).cast(NATIVE[dt]), native(b, NATIVE[out]) if dt not in (FLOAT, DOUBLE) else number(b).cast(NATIVE[dt]), out)
        parts.append((rank, lexical_of(v, out), out))
    v = dt = None
    for rank, lex, out in parts:
        v = F.when(r == rank, lex) if v is None else v.when(r == rank, lex)
        dt = F.when(r == rank, out) if dt is None else dt.when(r == rank, out)
    return literal(v, dt)


def _act(act, sign: str, x: Column, y: Column, dt: str) -> Column:
    if dt == DECIMAL:
        # 38 digits hold neither operand's product nor a quotient of two 18-digit scales: narrow what goes in
        kind = "decimal(38,18)" if sign in "+-" else "decimal(28,9)"
        return act(x.cast(kind), y.cast(kind)).cast("decimal(38,18)") if sign in "+-" else act(x.try_cast(kind), y.try_cast(kind)).try_cast("decimal(38,18)")
    return act(x.cast(NATIVE[dt]), y.cast(NATIVE[dt])).cast(NATIVE[dt])


def cast(x: Value, dt: str) -> Value:
    """xsd constructor functions."""
    if dt == STRING:
        if x.type.kind in ("iri", "node"):
            v = iri_text(x)
            return Value(F.when(~v.startswith("_:"), v) if x.type == NODE else v, STR)
        return Value(F.when(x.col["kind"] != "bnode", x.col["v"]) if x.type == TERM else lexical_of(x.col, x.type.detail), STR)
    if x.type.kind in ("iri", "node"):
        return null(lit_type(dt) if dt in NATIVE else TERM)
    lex = x.col["v"] if x.type == TERM else lexical_of(x.col, x.type.detail)
    lex = F.when((x.col["kind"] == "literal"), lex) if x.type == TERM else lex
    from_bool = boolean(x)
    n = number(x)
    if dt in INTEGERS:
        v = F.when(n.isNotNull(), F.when(x.col.cast("bigint").isNotNull(), x.col.cast("bigint")) if x.type == INT else F.when(lex.rlike(r"^[+-]?[0-9]+$"), lex.try_cast("bigint")).otherwise(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).try_cast("bigint")))
        v = F.coalesce(v, from_bool.cast("bigint"), F.when(lex.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(lex).try_cast("bigint")))
        return Value(v, INT)
    if dt == DECIMAL:
        s = F.when(lex.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), lex.try_cast("decimal(38,18)"))
        return Value(F.coalesce(s, n.try_cast("decimal(38,18)"), from_bool.cast("int").cast("decimal(38,18)")), DEC)
    if dt in (DOUBLE, FLOAT):
        s = F.when(lex.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), lex.try_cast("double"))
        s = F.coalesce(n, s, F.when(lex == "INF", F.lit(float("inf"))).when(lex == "-INF", F.lit(float("-inf"))).when(lex == "NaN", F.lit(float("nan"))), from_bool.cast("int").cast("double"))
        return Value(s.cast(NATIVE[dt]), lit_type(dt))
    if dt == BOOLEAN:
        return Value(F.coalesce(from_bool, F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)), F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)), BOOL)
    if dt == DATETIME:
        return literal(F.when(lex.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"), lex), DATETIME) if x.type != WHEN else x
    raise QueryError(f"no cast to {dt}")


def _rebuild(x: Value, v: Column) -> Value:
    """A string result that keeps the language of x."""
    if x.type == TERM:
        return literal(v, F.coalesce(x.col["dt"], F.lit(STRING)), x.col["lang"])
    return Value(v, STR)


def _date_part(x: Value, group: int) -> Column:
    if x.type == WHEN:
        return [None, F.year, F.month, F.day, F.hour, F.minute][group](x.col).cast("bigint")
    if x.type != TERM:
        return F.lit(None).cast("bigint")
    lex = F.when(x.col["dt"] == DATETIME, x.col["v"])
    return F.regexp_extract(lex, DATE, group).try_cast("bigint")


DATE = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)(Z|[+-][0-9]{2}:[0-9]{2})?$"


def compatible(a: Value, b: Value) -> Column:
    """Whether the second argument of a string function may go with the first."""
    la, lb = language(a), language(b)
    return lb.isNull() | F.coalesce(la == lb, F.lit(False))


class Expressions:
    """Compiles expressions over the variables of `scope` (name -> Value)."""

    def __init__(self, scope: dict[str, Value], base: str | None = None, exists: Callable | None = None):
        self.scope, self.base, self.exists = scope, base, exists

    def __call__(self, e) -> Value:
        kind = e[0]
        if kind == "var":
            return self.scope.get(e[1]) or null()
        if kind == "term":
            return replace(constant(e[1]), fixed=not (isinstance(e[1], Literal) and e[1].value == "NaN"))
        if kind == "op":
            return self.op(e[1], e[2])
        if kind == "call":
            return self.call(e[1], e[2])
        if kind == "exists":
            if self.exists is None:
                raise QueryError("EXISTS isn't possible here")
            return self.exists(e)
        raise QueryError(f"{kind} isn't possible here")

    def condition(self, e) -> Column:
        return effective(self(e))

    def call(self, iri: str, args: list) -> Value:
        if iri in CUSTOM:
            return CUSTOM[iri](*map(self, args))
        if iri in (STRING, BOOLEAN, DECIMAL, DOUBLE, FLOAT, DATETIME, *INTEGERS):
            if len(args) != 1:
                raise QueryError("a cast takes one argument")
            return cast(self(args[0]), iri)
        if iri.lower().startswith(GEOF.lower()):
            return geo.call(iri[len(GEOF) :].lower(), [self(a) for a in args])
        raise QueryError(f"unknown function <{iri}>")

    def op(self, name: str, args: list) -> Value:
        if name == "&&":
            return Value(self.condition(args[0]) & self.condition(args[1]), BOOL)
        if name == "||":
            return Value(self.condition(args[0]) | self.condition(args[1]), BOOL)
        if name == "!":
            return Value(~self.condition(args[0]), BOOL)
        if name == "BOUND":
            return Value(self(args[0]).col.isNotNull(), BOOL, False)
        if name in ("=", "!=", "<", "<=", ">", ">="):
            return Value(compare(name, self(args[0]), self(args[1])), BOOL)
        if name in "+-*/" and len(args) == 2:
            return arithmetic(name, self(args[0]), self(args[1]))
        if name == "neg":
            return arithmetic("-", Value(F.lit(0).cast("bigint"), INT, False), self(args[0]))
        if name == "pos":
            return arithmetic("+", Value(F.lit(0).cast("bigint"), INT, False), self(args[0]))
        if name == "in":
            x = self(args[0])
            if not args[1:]:
                return Value(F.lit(False), BOOL)
            out = None
            for a in args[1:]:
                c = compare("=", x, self(a))
                out = c if out is None else out | c
            return Value(out, BOOL)
        if name == "IF":
            c, a, b = self.condition(args[0]), self(args[1]), self(args[2])
            kind = common(a.type, b.type) or TERM
            return Value(F.when(c, cast_to(a, kind)).when(~c, cast_to(b, kind)), kind)
        if name == "COALESCE":
            xs = [self(a) for a in args]
            kind = xs[0].type
            for x in xs[1:]:
                kind = common(kind, x.type) or TERM
            return Value(F.coalesce(*[cast_to(x, kind) for x in xs]), kind)
        method = getattr(self, "f_" + name.lower(), None)
        if method is None:
            raise QueryError(f"unknown function {name}")
        return method(*[self(a) for a in args])

    # -- terms
    def f_str(self, x):
        return cast(x, STRING)

    def f_isiri(self, x):
        c = x.col["kind"] == "iri" if x.type == TERM else ~x.col.startswith("_:") if x.type == NODE else F.when(x.col.isNotNull(), F.lit(x.type.kind == "iri"))
        return Value(c, BOOL)

    f_isuri = f_isiri

    def f_isblank(self, x):
        return Value(x.col["kind"] == "bnode" if x.type == TERM else x.col.startswith("_:") if x.type == NODE else F.when(x.col.isNotNull(), F.lit(False)), BOOL)

    def f_isliteral(self, x):
        return Value(x.col["kind"] == "literal" if x.type == TERM else F.when(x.col.isNotNull(), F.lit(x.type.kind == "lit")), BOOL)

    def f_isnumeric(self, x):
        return Value(F.coalesce(number(x).isNotNull(), F.lit(False)) if x.type == TERM else F.when(x.col.isNotNull(), F.lit(x.numeric)), BOOL)

    def f_sameterm(self, a, b):
        return Value(same_term(a, b), BOOL)

    def f_lang(self, x):
        if x.type == TERM:
            return Value(F.when(x.col["kind"] == "literal", F.coalesce(x.col["lang"], F.lit(""))), STR)
        return Value(F.when(x.col.isNotNull(), F.lit("")), STR) if x.type.kind == "lit" else null(STR)

    def f_langmatches(self, tag, want):
        t, r = F.lower(text(tag)), F.lower(text(want))
        return Value(F.when(r == "*", F.length(t) > 0).otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))), BOOL)

    def f_datatype(self, x):
        if x.type == TERM:
            return Value(F.when(x.col["kind"] == "literal", x.col["dt"]), FULL_IRI)
        return Value(F.when(x.col.isNotNull(), F.lit(x.type.detail)), FULL_IRI) if x.type.kind == "lit" else null(FULL_IRI)

    def f_iri(self, x):
        if x.type.kind == "iri":
            return x
        s = x.col if x.type in (NODE, STR) else F.when((x.col["kind"] == "iri") | (x.col["dt"] == STRING), x.col["v"]) if x.type == TERM else F.lit(None).cast("string")
        if self.base:
            cut = resolve(self.base, "x")[:-1]
            s = F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s).otherwise(F.concat(F.lit(cut), s))
        return Value(F.when(s.contains(":") & ~s.rlike(r"\s") & ~s.startswith("_:"), s), FULL_IRI)

    f_uri = f_iri

    def f_bnode(self, x=None):
        if x is None:
            return Value(F.concat(F.lit("_:"), F.uuid()), NODE)
        # one node for a label and solution: the row's values name the solution
        row = [to_term(v) for n, v in sorted(self.scope.items())]
        return Value(F.concat(F.lit("_:"), F.sha1(F.to_json(F.struct(text(x).alias("l"), *[r.alias(f"x{n}") for n, r in enumerate(row)])))), NODE)

    def f_strdt(self, x, dt):
        s = x.col if x.type == STR else F.when(x.col["dt"] == STRING, x.col["v"]) if x.type == TERM else F.lit(None).cast("string")
        return literal(s, iri_text(dt) if dt.type.kind in ("iri", "node") else F.when(dt.col["kind"] == "iri", dt.col["v"]) if dt.type == TERM else F.lit(None).cast("string"))

    def f_strlang(self, x, tag):
        s = x.col if x.type == STR else F.when(x.col["dt"] == STRING, x.col["v"]) if x.type == TERM else F.lit(None).cast("string")
        return literal(F.when(text(tag).isNotNull(), s), LANG_STRING, F.lower(text(tag)))

    def f_uuid(self):
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), FULL_IRI)

    def f_struuid(self):
        return Value(F.uuid(), STR)

    # -- strings
    def f_ucase(self, x):
        return _rebuild(x, F.upper(text(x)))

    def f_lcase(self, x):
        return _rebuild(x, F.lower(text(x)))

    def f_strlen(self, x):
        return Value(F.char_length(text(x)).cast("bigint"), INT)

    def f_concat(self, *xs):
        if not xs:
            return Value(F.lit(""), STR)
        v = F.concat(*[text(x) for x in xs])
        if all(x.type == STR for x in xs):
            return Value(v, STR)
        langs = [F.coalesce(language(x), F.lit("")) for x in xs]
        same = F.lit(True)
        for n in langs[1:]:
            same = same & (n == langs[0])
        kept = same & (langs[0] != "")
        return literal(v, F.when(kept, LANG_STRING).otherwise(STRING), F.when(kept, langs[0]))

    def f_substr(self, x, start, size=None):
        s, n = text(x), F.greatest(number(start).cast("int"), F.lit(1))
        return _rebuild(x, F.substring(s, n, number(size).cast("int") if size is not None else F.length(s)))

    def f_contains(self, a, b):
        return Value(F.when(compatible(a, b), F.contains(text(a), text(b))), BOOL)

    def f_strstarts(self, a, b):
        return Value(F.when(compatible(a, b), F.startswith(text(a), text(b))), BOOL)

    def f_strends(self, a, b):
        return Value(F.when(compatible(a, b), F.endswith(text(a), text(b))), BOOL)

    def f_strbefore(self, a, b):
        s, t = text(a), text(b)
        at = F.position(t, s)
        return self._side(a, b, F.substring(s, F.lit(1), at - 1), at)

    def f_strafter(self, a, b):
        s, t = text(a), text(b)
        at = F.position(t, s)
        return self._side(a, b, F.substring(s, at + F.length(t), F.length(s)), at)

    def _side(self, a, b, part: Column, at: Column) -> Value:
        v = F.when(compatible(a, b), F.when(at > 0, part).otherwise(F.lit("")))
        if a.type != TERM:
            return Value(v, STR)
        return literal(v, F.when(at > 0, a.col["dt"]).otherwise(STRING), F.when(at > 0, a.col["lang"]))

    def _pattern(self, pattern: Value, flags: Value | None) -> Column:
        p = text(pattern)
        if flags is None:
            return p
        f = text(flags)
        quoted = F.when(f.contains("q"), F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))).otherwise(p)
        on = F.regexp_replace(f, "[^ismx]", "")
        return F.when(on == "", quoted).otherwise(F.concat(F.lit("(?"), on, F.lit(")"), quoted))

    def f_regex(self, x, pattern, flags=None):
        return Value(F.rlike(text(x), self._pattern(pattern, flags)), BOOL)

    def f_replace(self, x, pattern, to, flags=None):
        return _rebuild(x, F.regexp_replace(text(x), self._pattern(pattern, flags), text(to)))

    def f_encode_for_uri(self, x):
        v = F.url_encode(text(x))
        for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
            v = F.regexp_replace(v, a, b)
        return Value(v, STR)

    def f_md5(self, x):
        return Value(F.md5(self._simple(x)), STR)

    def f_sha1(self, x):
        return Value(F.sha1(self._simple(x)), STR)

    def f_sha256(self, x):
        return Value(F.sha2(self._simple(x), 256), STR)

    def f_sha384(self, x):
        return Value(F.sha2(self._simple(x), 384), STR)

    def f_sha512(self, x):
        return Value(F.sha2(self._simple(x), 512), STR)

    def _simple(self, x) -> Column:
        return x.col if x.type == STR else F.when(x.col["dt"] == STRING, x.col["v"]) if x.type == TERM else F.lit(None).cast("string")

    # -- numbers
    def _number(self, x, native, double=None) -> Value:
        if x.numeric:
            return Value(native(x.col).cast(NATIVE[x.type.detail]), x.type)
        if x.type != TERM:
            return null(DBL)
        n = number(x)
        dt = F.when(x.col["dt"].isin(*INTEGERS), INTEGER).otherwise(x.col["dt"])
        v = F.when(dt == INTEGER, native(x.col["v"].try_cast("bigint")).cast("bigint").cast("string")).when(dt == DECIMAL, lexical_of(native(x.col["v"].try_cast("decimal(38,18)")).cast("decimal(38,18)"), DECIMAL)).otherwise(lexical_of(native(n).cast("double"), DOUBLE))
        return literal(F.when(n.isNotNull(), v), dt)

    def f_abs(self, x):
        return self._number(x, F.abs)

    def f_ceil(self, x):
        return self._number(x, F.ceil)

    def f_floor(self, x):
        return self._number(x, F.floor)

    def f_round(self, x):
        return self._number(x, lambda c: F.round(c, 0))

    def f_rand(self):
        return Value(F.rand(), DBL)

    # -- time
    def f_now(self):
        return Value(F.current_timestamp().cast("timestamp_ntz"), WHEN)

    def f_year(self, x):
        return Value(_date_part(x, 1), INT)

    def f_month(self, x):
        return Value(_date_part(x, 2), INT)

    def f_day(self, x):
        return Value(_date_part(x, 3), INT)

    def f_hours(self, x):
        return Value(_date_part(x, 4), INT)

    def f_minutes(self, x):
        return Value(_date_part(x, 5), INT)

    def f_seconds(self, x):
        if x.type == WHEN:
            return Value(F.date_format(x.col, "ss.SSSSSS").cast("decimal(38,18)"), DEC)
        lex = F.when(x.col["dt"] == DATETIME, x.col["v"]) if x.type == TERM else F.lit(None).cast("string")
        return Value(F.regexp_extract(lex, DATE, 6).try_cast("decimal(38,18)"), DEC)

    def _zone(self, x) -> Column:
        if x.type == WHEN:
            return F.when(x.col.isNotNull(), F.lit(""))
        return F.regexp_extract(F.when(x.col["dt"] == DATETIME, x.col["v"]), DATE, 7) if x.type == TERM else F.lit(None).cast("string")

    def f_tz(self, x):
        return Value(self._zone(x), STR)

    def f_timezone(self, x):
        z = self._zone(x)
        h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        sign = F.when(z.startswith("-"), "-").otherwise("")
        body = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        v = F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").when(z != "", F.concat(sign, F.lit("PT"), body))
        return literal(v, DURATION)
