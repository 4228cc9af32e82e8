"""Results of queries and updates as JSON, and readers of the result formats SPARQL XML, JSON, CSV and TSV.

A read result is (variables, rows), a row a dict from variable to term (kind, v, dt, lang); or True or False for ASK.
"""

from __future__ import annotations

import csv
import io
import json
import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from ..functions.values import BOOLEAN, DECIMAL, DOUBLE, INTEGER, STRING
from ..terms import LANG_STRING
from .rdf_io import results_json

SPACE = "{http://www.w3.org/2005/sparql-results#}"
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def select_json(df: DataFrame) -> dict:
    """A SELECT result as one SPARQL JSON object; for results that a client can hold."""
    return {"head": {"vars": df.columns}, "results": {"bindings": [json.loads(r["binding"]) for r in results_json(df).collect()]}}


def ask_json(df: DataFrame) -> dict:
    return {"head": {}, "boolean": bool(df.first()["result"])}


def construct_json(df: DataFrame) -> dict:
    """What a CONSTRUCT or DESCRIBE made, in short."""
    return {"triples": df.count()}


def update_json(affected: int) -> dict:
    return {"affected": affected}


def literal(v: str, dt: str | None = None, lang: str | None = None) -> tuple:
    return ("literal", v, LANG_STRING if lang else dt or STRING, lang.lower() if lang else None)


def read_json(text: str):
    data = json.loads(text)
    if "boolean" in data:
        return data["boolean"]
    kinds = {"uri": "iri", "bnode": "bnode"}
    term = lambda b: (kinds[b["type"]], b["value"], None, None) if b["type"] in kinds else literal(b["value"], b.get("datatype"), b.get("xml:lang"))
    return data["head"].get("vars", []), [{v: term(b) for v, b in r.items()} for r in data["results"]["bindings"]]


def read_xml(text: str):
    root = ElementTree.fromstring(text)
    if (truth := root.find(f"{SPACE}boolean")) is not None:
        return truth.text.strip() == "true"

    def term(x):
        kind = x.tag[len(SPACE) :]
        if kind == "literal":
            return literal(x.text or "", x.get("datatype"), x.get(XML_LANG))
        return ("iri" if kind == "uri" else "bnode", x.text or "", None, None)

    rows = [{b.get("name"): term(b[0]) for b in r.findall(f"{SPACE}binding")} for r in root.iter(f"{SPACE}result")]
    return [v.get("name") for v in root.iter(f"{SPACE}variable")], rows


def read_csv(text: str):
    """CSV says neither kinds nor datatypes: what looks like an IRI or a blank node is one, all else is a plain literal; an empty field is unbound."""
    lines = list(csv.reader(io.StringIO(text)))
    kind = lambda x: ("bnode", x[2:], None, None) if x.startswith("_:") else ("iri", x, None, None) if re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s]*", x) else literal(x)
    names = lines[0] if lines else []
    return names, [{v: kind(x) for v, x in zip(names, r) if x != ""} for r in lines[1:] if r or len(names) == 1]


NUMBER = (("[+-]?[0-9]+", INTEGER), (r"[+-]?[0-9]*\.[0-9]+", DECIMAL), (r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+", DOUBLE), ("true|false", BOOLEAN))
QUOTED = re.compile(r"([\"'])(.*)\1(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?", re.S)
ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def read_tsv(text: str):
    """TSV has terms as Turtle writes them."""
    lines = text.split("\n")
    names = [v.strip().lstrip("?") for v in lines[0].split("\t")] if lines[0].strip() else []

    def term(x):
        if x.startswith("<"):
            return ("iri", x[1:-1], None, None)
        if x.startswith("_:"):
            return ("bnode", x[2:], None, None)
        if m := QUOTED.fullmatch(x):
            plain = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda e: ESCAPE.get(e[1]) or chr(int(e[1][1:], 16)), m[2])
            return literal(plain, m[4], m[3])
        return literal(x, next((dt for form, dt in NUMBER if re.fullmatch(form, x)), None))

    return names, [{v: term(x.strip()) for v, x in zip(names, line.rstrip("\r").split("\t")) if x.strip()} for line in lines[1:] if line.strip() or len(names) == 1 and line]


READERS = {"json": read_json, "srj": read_json, "xml": read_xml, "srx": read_xml, "csv": read_csv, "tsv": read_tsv}


def read_results(text: str, fmt: str):
    """A result text in one of the formats of READERS."""
    return READERS[fmt.lower().lstrip(".")](text)
