"""RDF files: N-Triples and N-Quads by SQL functions, Turtle and TriG by a parser a file, and writers.

All readers give quads (g, s, p, o): g NULL for the default graph, s an IRI or `_:label`, o a term
struct.  Blank node labels carry a hash of their file, so files never share them.  Literals are
made canonical as they are read: whole numbers lose leading zeros, xsd:int and xsd:long are
xsd:integer, doubles and floats get one spelling, decimals lose trailing zeros.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import BOOLEAN, DECIMAL, DOUBLE, FLOAT, INTEGER, STRING, lexical_of
from ..plans.parser import ESCAPE, TOKEN, unescape
from ..terms import INTEGERS, LANG_STRING, RDF, XSD, QueryError, resolve

QUADS = "g string, s string, p string, o struct<kind: string, v: string, dt: string, lang: string>"
FORMATS = {"nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "trig": "trig", "jsonld": "json-ld", "json-ld": "json-ld"}
MEDIA = {"application/n-triples": "ntriples", "text/plain": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/trig": "trig", "application/ld+json": "json-ld"}

IRI_RE = r"<([^<>\"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>\"{}|^`\\\x00-\x20]*|\\U[0-9A-Fa-f]{8}[^<>\"{}|^`\\\x00-\x20]*)*)>"
BLANK_RE = r"(_:[\w](?:[\w.\-]*[\w\-])?)"
LITERAL_RE = r"\"((?:[^\"\\\n\r]|\\.)*)\"(?:\^\^" + IRI_RE + r"|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
LINE_RE = rf"^\s*(?:{IRI_RE}|{BLANK_RE})\s*{IRI_RE}\s*(?:{IRI_RE}|{BLANK_RE}|{LITERAL_RE})\s*(?:{IRI_RE}|{BLANK_RE})?\s*\.\s*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    """Escapes of a string column, by JSON's reader; a code point beyond the basic plane is first made a surrogate pair."""
    n = F.conv(F.regexp_extract(c, r"\\U(000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4}", 0).substr(3, 8), 16, 10).cast("bigint") - 65536
    pair = F.concat(F.lit(r"\u"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFC00)) / 1024 + 0xD800)), F.lit(r"\u"), F.lower(F.hex(n.bitwiseAND(F.lit(1023)) + 0xDC00)))
    one = F.when(c.rlike(r"\\U(000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4}"), F.replace(c, F.regexp_extract(c, r"\\U(000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4}", 0), pair)).otherwise(c)
    body = F.regexp_replace(F.replace(one, F.lit("\\'"), F.lit("'")), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    body = F.replace(body, F.lit("\t"), F.lit("\\t"))
    read = F.from_json(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "v string")["v"]
    return F.when(c.contains("\\"), read).otherwise(c)


def canonical(v: Column, dt: Column) -> tuple[Column, Column]:
    """Canonical lexical form and datatype of a typed literal."""
    whole = dt.isin(*INTEGERS[:3])
    n = F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("bigint"))
    d = F.when(v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double"))
    dec = F.when(v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), v.try_cast("decimal(38,18)"))
    out = F.when(whole & n.isNotNull(), n.cast("string")).when((dt == DECIMAL) & dec.isNotNull(), lexical_of(dec, DECIMAL)).when((dt == DOUBLE) & d.isNotNull(), lexical_of(d, DOUBLE)).when((dt == FLOAT) & d.isNotNull(), lexical_of(d.cast("float"), FLOAT)).otherwise(v)
    return out, F.when(whole & n.isNotNull(), INTEGER).otherwise(dt)


def read_lines(spark: SparkSession, path, quads: bool, strict: bool = True) -> DataFrame:
    """N-Triples or N-Quads; a bad line raises (strict) or is left out."""
    return parse_lines(spark.read.text(path).select(F.col("value").alias("line"), document_label()), quads, strict)


def document_label() -> Column:
    """Prefix of a file's blank node labels."""
    return F.concat(F.lit("f"), F.substring(F.sha1(F.col("_metadata.file_path")), 1, 12), F.lit("_")).alias("doc")


def parse_lines(lines: DataFrame, quads: bool, strict: bool = True) -> DataFrame:
    """Quads of lines (line, doc); works on streams as well."""
    lines = lines.where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    part = lambda n: F.regexp_extract("line", LINE_RE, n)
    good = F.col("line").rlike(LINE_RE) & ((part(9) == "") & (part(10) == "") if not quads else part(10) == "")
    if strict:
        lines = lines.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("line")))))
    else:
        lines = lines.where(good)
    blank = lambda n: F.concat(F.lit("_:"), F.col("doc"), F.substring(part(n), F.lit(3), F.length(part(n))))
    iri = lambda n: _unescaped(part(n))
    s = F.when(part(2) != "", blank(2)).otherwise(iri(1))
    kind = F.when(part(5) != "", "bnode").when(F.regexp_extract("line", rf"^\s*(?:{IRI_RE}|{BLANK_RE})\s*{IRI_RE}\s*(\")", 4) != "", "literal").otherwise("iri")
    df = lines.select(
        (F.when(part(9) != "", iri(9)) if quads else F.lit(None).cast("string")).alias("g"), s.alias("s"), iri(3).alias("p"), kind.alias("kind"),
        F.when(part(5) != "", blank(5)).alias("b"), iri(4).alias("i"), _unescaped(part(6)).alias("v"), F.nullif(iri(7), F.lit("")).alias("dt"), F.nullif(F.lower(part(8)), F.lit("")).alias("lang"),
    )
    dt = F.when(F.col("lang").isNotNull(), LANG_STRING).otherwise(F.coalesce("dt", F.lit(STRING)))
    v, dt = canonical(F.col("v"), dt)
    o = F.when(F.col("kind") == "literal", F.struct(F.col("kind"), v.alias("v"), dt.alias("dt"), F.col("lang"))).otherwise(F.struct(F.col("kind"), F.coalesce("b", "i").alias("v"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")))
    return df.select("g", "s", "p", o.alias("o"))


# -- Turtle and TriG
class TurtleReader:
    """Events of one Turtle or TriG document: (prefix, name, iri) (base, iri) (quad, g, s, p, o); o is (kind, v, dt, lang)."""

    def __init__(self, text: str, doc: str, trig: bool = False, base: str | None = None):
        self.doc, self.trig, self.base = doc, trig, base
        self.prefixes: dict[str, str] = {}
        self.toks = self._tokens(text)
        self.ahead: list[tuple[str, str]] = []
        self.fresh, self.graph = 0, None
        self.out: list[tuple] = []

    def _tokens(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
            at = m.end()

    def peek(self, n: int = 0) -> tuple[str, str]:
        while len(self.ahead) <= n:
            self.ahead.append(next(self.toks, ("end", "")))
        return self.ahead[n]

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.ahead.pop(0)
        return t

    def want(self, text: str) -> None:
        if self.take()[1] != text:
            raise QueryError(f"expected {text!r}")

    def node(self) -> str:
        self.fresh += 1
        return f"_:{self.doc}g{self.fresh}"

    def events(self) -> Iterator[tuple]:
        while self.peek()[0] != "end":
            self.statement()
            yield from self.out
            self.out.clear()

    def statement(self) -> None:
        kind, text = self.peek()
        low = text.lower()
        if low in ("@prefix", "prefix") and kind in ("lang", "word"):
            self.take()
            name = self.take()[1]
            iri = self.iri()
            self.prefixes[name[:-1]] = iri
            self.out.append(("prefix", name[:-1], iri))
            if low[0] == "@":
                self.want(".")
        elif low in ("@base", "base") and kind in ("lang", "word"):
            self.take()
            self.base = self.iri()
            self.out.append(("base", self.base))
            if low[0] == "@":
                self.want(".")
        elif self.trig and (text == "{" or low == "graph" and kind == "word" or self.peek(1)[1] == "{"):
            if low == "graph" and kind == "word":
                self.take()
            if self.peek()[1] != "{":
                k, v = self.subject_term()
                self.graph = v
            self.want("{")
            while self.peek()[1] != "}":
                self.triples()
                if self.peek()[1] == ".":
                    self.take()
                elif self.peek()[1] != "}":
                    raise QueryError("expected '.' or '}'")
            self.take()
            self.graph = None
        else:
            self.triples()
            self.want(".")

    def iri(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            return resolve(self.base, ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)), text[1:-1]))
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise QueryError(f"expected an IRI, found {text!r}")

    def emit(self, s: str, p: str, o: tuple) -> None:
        self.out.append(("quad", self.graph, s, p, o))

    def subject_term(self) -> tuple[str, str]:
        kind, text = self.peek()
        if kind == "bnode":
            self.take()
            return "bnode", f"_:{self.doc}{text[2:]}"
        return "iri", self.iri()

    def triples(self) -> None:
        text = self.peek()[1]
        if text in ("[", "("):
            o = self.object()
            s = o[1]
            if text == "[" and self.peek()[1] in (".", "}"):
                return
        else:
            s = self.subject_term()[1]
        self.properties(s)

    def properties(self, s: str) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.take()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.emit(s, p, self.object())
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return

    def object(self) -> tuple:
        kind, text = self.peek()
        if text == "[":
            self.take()
            me = self.node()
            if self.peek()[1] != "]":
                self.properties(me)
            self.want("]")
            return ("bnode", me, None, None)
        if text == "(":
            self.take()
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.take()
            if not items:
                return ("iri", RDF + "nil", None, None)
            nodes = [self.node() for _ in items]
            for n, (me, o) in enumerate(zip(nodes, items)):
                self.emit(me, RDF + "first", o)
                self.emit(me, RDF + "rest", ("bnode", nodes[n + 1], None, None) if n + 1 < len(nodes) else ("iri", RDF + "nil", None, None))
            return ("bnode", nodes[0], None, None)
        if kind == "string":
            self.take()
            v = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return ("literal", v, LANG_STRING, self.take()[1][1:].lower())
            if self.peek()[1] == "^^":
                self.take()
                return ("literal", v, self.iri(), None)
            return ("literal", v, STRING, None)
        sign = ""
        if text in ("+", "-"):
            sign = self.take()[1]
            kind, text = self.peek()
        if kind == "number":
            self.take()
            if text.endswith(".") and "e" not in text.lower():
                self.ahead.insert(0, ("punct", "."))
                text = text[:-1]
            dt = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return ("literal", (sign if sign == "-" else "") + text, XSD + dt, None)
        if kind == "word" and text in ("true", "false"):
            self.take()
            return ("literal", text, BOOLEAN, None)
        k, v = self.subject_term()
        return (k, v, None, None)


def parse_streaming(text: str, doc: str = "", trig: bool = False) -> Iterator[tuple]:
    """Events of a document, as they are read."""
    return TurtleReader(text, doc, trig).events()


def read_documents(spark: SparkSession, path, trig: bool) -> DataFrame:
    """Turtle or TriG: one task a file, in batches of rows."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for text, doc in zip(pdf["value"], pdf["doc"]):
                rows = []
                for e in parse_streaming(text, doc, trig):
                    if e[0] == "quad":
                        rows.append((e[1], e[2], e[3], dict(zip(("kind", "v", "dt", "lang"), e[4]))))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select("value", document_label())
    df = files.mapInPandas(run, QUADS)
    v, dt = canonical(F.col("o.v"), F.col("o.dt"))
    return df.withColumn("o", F.struct(F.col("o.kind").alias("kind"), F.when(F.col("o.kind") == "literal", v).otherwise(F.col("o.v")).alias("v"), F.when(F.col("o.kind") == "literal", dt).alias("dt"), F.col("o.lang").alias("lang")))


def load_rdf(spark: SparkSession, path, fmt: str | None = None, graph: str | None = None, strict: bool = True) -> DataFrame:
    """Quads of files; the format is a name, a media type, or told by the path; `graph` takes the default graph's triples."""
    name = path if isinstance(path, str) else path[0]
    kind = FORMATS.get((fmt or "").lower()) or MEDIA.get((fmt or "").split(";")[0].lower()) or FORMATS.get(name.rsplit(".", 1)[-1].lower()) or "ntriples"
    if kind == "json-ld":
        raise NotImplementedError("unsupported format: json-ld")
    df = read_lines(spark, path, kind == "nquads", strict) if kind in ("ntriples", "nquads") else read_documents(spark, path, kind == "trig")
    return df.withColumn("g", F.coalesce("g", F.lit(graph))) if graph else df


# -- writers
def _escaped(c: Column) -> Column:
    for a, b in ((r"\\", r"\\\\"), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ('"', r"\\\"")):
        c = F.regexp_replace(c, a, b)
    return c


def statement(quads: bool) -> Column:
    """One line for a quad row."""
    name = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    o = F.col("o")
    tail = F.when(o["lang"].isNotNull(), F.concat(F.lit("@"), o["lang"])).when(o["dt"] == STRING, F.lit("")).otherwise(F.concat(F.lit("^^<"), o["dt"], F.lit(">")))
    obj = F.when(o["kind"] == "literal", F.concat(F.lit('"'), _escaped(o["v"]), F.lit('"'), tail)).otherwise(name(o["v"]))
    parts = [name(F.col("s")), name(F.col("p")), obj]
    if quads:
        parts.append(F.when(F.col("g").isNotNull(), name(F.col("g"))))
    return F.concat_ws(" ", *parts, F.lit("."))


def write_rdf(quads: DataFrame, path: str, fmt: str = "ntriples", mode: str = "error") -> None:
    """N-Triples (graph names are left out) or N-Quads."""
    quads.select(statement(FORMATS[fmt] == "nquads").alias("value")).write.mode(mode).text(path)


def results_json(df: DataFrame) -> DataFrame:
    """SELECT solutions as SPARQL JSON bindings, one string a row (column `binding`)."""
    cols = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind.startswith("struct<kind"):
            term = F.struct(F.when(x["kind"] == "iri", "uri").otherwise(x["kind"]).alias("type"), x["v"].alias("value"), F.when(~x["dt"].isin(STRING, LANG_STRING), x["dt"]).alias("datatype"), x["lang"].alias("xml:lang"))
        else:
            dt = {"bigint": INTEGER, "double": DOUBLE, "float": FLOAT, "boolean": BOOLEAN, "timestamp_ntz": XSD + "dateTime"}.get(kind, DECIMAL if kind.startswith("decimal") else None)
            lex = lexical_of(x, dt) if dt else x.cast("string")
            node = F.when(x.startswith("_:"), "bnode").when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S*$"), "uri").otherwise("literal") if dt is None else F.lit("literal")
            term = F.struct(node.alias("type"), lex.alias("value"), F.lit(dt).cast("string").alias("datatype"))
        cols.append(F.when(x.isNotNull(), term).alias(c))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("binding"))
