"""Forms and corners of the language that the table queries don't reach."""

import pytest
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.functions.expressions import register_function
from quadloom.functions.values import STR, Value, text
from quadloom.sources.rdf_io import load_rdf
from quadloom.store import Store
from quadloom.streaming.ingest import into_store, quad_stream
from quadloom.terms import resolve

TTL = """@prefix : <urn:> . @prefix geo: <http://www.opengis.net/ont/geosparql#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p :b, :c ; :n "one", "two"@en ; :t "2020-02-03T04:05:06.5+01:00"^^xsd:dateTime . :b :p :c . :c :p :a ; :n "three" .
:place :at "POINT(1 2)"^^geo:wktLiteral ; :box "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"^^geo:wktLiteral .
"""


@pytest.fixture(scope="module")
def e(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("g") / "g.ttl"
    p.write_text(TTL)
    return Engine(Store(spark, load_rdf(spark, str(p))).dataset(), {"": "urn:", "geo": "http://www.opengis.net/ont/geosparql#", "geof": "http://www.opengis.net/def/function/geosparql/"})


def rows(e, q):
    return sorted(tuple(x["v"] if hasattr(x, "v") or isinstance(x, tuple) and hasattr(x, "asDict") else x for x in r) for r in e.query(q).collect())


def test_paths_on_a_cycle(e):
    assert len(rows(e, "SELECT * { ?x :p+ ?y }")) == 9
    assert rows(e, "SELECT ?y { :b :p+ ?y }") == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert rows(e, "SELECT ?x { ?x :p+ :b }") == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert rows(e, "SELECT ?y { :a :p/:p ?y }") == [("urn:a",), ("urn:c",)]
    assert rows(e, "SELECT ?y { :a (:p|^:p) ?y }") == [("urn:b",), ("urn:c",), ("urn:c",)]
    assert rows(e, "SELECT ?y { :a :p? ?y }") == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert rows(e, "SELECT ?y { :b !(:n|^:p) ?y }") == [("urn:c",)]
    assert rows(e, "SELECT ?y { :b ^(:p/:p) ?y }") == [("urn:c",)]


def test_forms(e):
    assert e.query("CONSTRUCT { ?x :q [ :r ?y ] } WHERE { ?x :p ?y }").count() == 8
    assert e.query("CONSTRUCT { ?n :q ?x } WHERE { ?x :n ?n }").count() == 0  # a literal is no subject
    assert e.query("DESCRIBE ?x { ?x :n 'three' }").count() == 2
    assert e.ask("ASK { FILTER NOT EXISTS { :a :zz ?o } }")
    assert rows(e, "SELECT REDUCED ?x { ?x :n 'one' }") == [("urn:a",)]


def test_functions(e):
    assert rows(e, "SELECT (TZ(?t) AS ?z) (SECONDS(?t) AS ?s) (STR(TIMEZONE(?t)) AS ?d) { :a :t ?t }")[0][0] == "+01:00"
    assert rows(e, 'SELECT (CONCAT(?n, "!"@en) AS ?c) { :a :n ?n FILTER(LANG(?n) = "en") }') == [("two!",)]
    assert rows(e, "SELECT (STRBEFORE(?n, 'w') AS ?c) { :a :n ?n FILTER(LANGMATCHES(LANG(?n), '*')) }") == [("t",)]
    assert rows(e, "SELECT ?x { ?x :n ?n FILTER(?n IN ('three', 1)) }") == [("urn:c",)]
    assert rows(e, 'SELECT (REPLACE("a.b", ".", "-", "q") AS ?x) {}') == [("a-b",)]
    assert rows(e, "SELECT (xsd:integer('12') + 1 AS ?x) (xsd:integer('x') AS ?y) {}") == [(13, None)]
    assert rows(e, "BASE <http://h/d/> SELECT (IRI('x') AS ?i) {}") == [("http://h/d/x",)]
    assert rows(e, "SELECT (COUNT(DISTINCT ?b) AS ?n) { ?x :p ?y BIND(BNODE('l') AS ?b) }") == [(4,)]
    assert resolve("http://a/b/c?d", "../e") == "http://a/e"
    register_function("urn:f:shout", lambda x: Value(F.concat(F.upper(text(x)), F.lit("!")), STR))
    assert rows(e, "SELECT (<urn:f:shout>('hey') AS ?x) {}") == [("HEY!",)]


def test_geometry(e):
    assert rows(e, "SELECT ?j { :place :at ?g . ?g geo:asGeoJSON ?j }") == [('{"type":"Point","coordinates":[1,2]}',)]
    assert rows(e, "SELECT ?j { BIND('POINT(3 4)'^^geo:wktLiteral AS ?g) ?g geo:asWKT ?j }") == [("POINT(3 4)",)]
    assert rows(e, "SELECT ?p { ?p :at ?a ; :box ?b FILTER(geof:sfWithin(?a, ?b) && !geof:sfTouches(?a, ?b) && geof:sfIntersects(?b, ?a)) }") == [("urn:place",)]
    assert e.ask("""ASK { FILTER(geof:sfOverlaps('{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'^^geo:geoJSONLiteral, 'ENVELOPE(1 1 3 3)'^^geo:wktLiteral)) }""")
    assert e.query("SELECT (geof:isValid('POLYGON((0 0, 1 0, 0 1, 0 0))'^^geo:wktLiteral) AS ?v) {}").first()[0] is None


def test_stream_into_store(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.nt").write_text("<urn:a> <urn:p> <urn:b> .\nnonsense\n")
    store = Store(spark, path=str(tmp_path / "store"))
    into_store(quad_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination()
    assert store.at().count() == 1
    (src / "b.nt").write_text("<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:p> <urn:c> .\n")
    into_store(quad_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination()
    assert store.at().count() == 2
