"""RDF terms, for the driver's side: what queries, shapes and rule sets are written in."""

from __future__ import annotations

import re
from dataclasses import dataclass

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
GEO = "http://www.opengis.net/ont/geosparql#"
GEOF = "http://www.opengis.net/def/function/geosparql/"
RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"

INTEGERS = tuple(XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
NUMERICS = (*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double")


class QueryError(ValueError):
    """A query that doesn't parse or breaks a scope rule."""


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD + "string"
    lang: str | None = None


def valid_iri(text: str) -> bool:
    """Whether a text may stand as an IRI: not empty, no white space, a colon in it."""
    return bool(text) and ":" in text and not re.search(r"\s", text)


def resolve(base: str | None, ref: str) -> str:
    """An IRI reference against a base."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref):
        return ref
    from urllib.parse import urljoin, urlsplit

    if not urlsplit(base).netloc and not base.startswith("file:"):
        # urljoin knows only some schemes; join on a stand-in and put the own scheme back
        scheme, _, rest = base.partition(":")
        return scheme + urljoin("http:" + rest, ref)[4:] if rest.startswith("/") else base.rsplit("/", 1)[0] + "/" + ref if "/" in rest else base + ref
    scheme, _, rest = base.partition(":")
    return scheme + urljoin("http:" + rest, ref)[4:]
