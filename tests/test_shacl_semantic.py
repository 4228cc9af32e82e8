"""SHACL constraints and semantic search on small graphs."""

import numpy as np
import pytest

from quadloom.operators import semantic
from quadloom.operators.shacl import validate
from quadloom.sources.mapping import Dataset
from quadloom.sources.rdf_io import load_rdf

DATA = """@prefix : <urn:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :P ; :age 5 ; :name "Al"@en, "Ally"@en ; :knows :b ; :low 1 ; :high 2 .
:b a :Q ; :age "x" ; :name "Bob" ; :knows :z ; :low 3 ; :high 2 . :Q rdfs:subClassOf :P . :z :other 1 .
"""
SHAPES = """@prefix : <urn:> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:S a sh:NodeShape ; sh:targetClass :P ;
  sh:property [ sh:path :age ; sh:datatype xsd:integer ; sh:maxInclusive 4 ] ;
  sh:property [ sh:path :name ; sh:maxCount 1 ; sh:uniqueLang true ; sh:minLength 3 ] ;
  sh:property [ sh:path :knows ; sh:class :P ; sh:node [ sh:property [ sh:path :age ; sh:minCount 1 ] ] ] ;
  sh:property [ sh:path :low ; sh:lessThan :high ] ;
  sh:property [ sh:path ( :knows :age ) ; sh:in ( "x" 5 ) ] ;
  sh:property [ sh:path [ sh:inversePath :knows ] ; sh:nodeKind sh:IRI ; sh:minCount 1 ; sh:severity sh:Warning ] ;
  sh:or ( [ sh:property [ sh:path :age ; sh:hasValue 5 ] ] [ sh:property [ sh:path :low ; sh:hasValue 3 ] ] ) ;
  sh:not [ sh:property [ sh:path :high ; sh:minCount 1 ] ] .
:T a sh:NodeShape ; sh:targetNode :z ; sh:closed true ; sh:ignoredProperties ( :third ) ; sh:property [ sh:path :none ] .
:U a sh:NodeShape ; sh:targetSubjectsOf :other ; sh:deactivated true ; sh:nodeKind sh:Literal .
"""


def test_shacl(spark, tmp_path):
    (tmp_path / "d.ttl").write_text(DATA)
    (tmp_path / "s.ttl").write_text(SHAPES)
    data = Dataset(spark, [], load_rdf(spark, str(tmp_path / "d.ttl")))
    ok, rows = validate(data, load_rdf(spark, str(tmp_path / "s.ttl")))
    got = sorted((r["focus_node"]["v"][-1], r["component"].split("#")[1].replace("ConstraintComponent", ""), (r["value"] or {"v": None})["v"]) for r in rows.collect())
    assert not ok
    want = [("a", "MaxInclusive", "5"), ("b", "Datatype", "x"), ("b", "MaxInclusive", "x"), ("a", "MaxCount", None), ("a", "UniqueLang", None), ("a", "MinLength", "Al"), ("b", "Class", "urn:z"), ("b", "Node", "urn:z"), ("b", "LessThan", "3"), ("a", "MinCount", None), ("a", "Not", "urn:a"), ("b", "Not", "urn:b"), ("z", "Closed", "1")]
    assert got == sorted(want, key=lambda x: x[:2]) or sorted(map(str, got)) == sorted(map(str, want))
    ok, rows = validate(data, load_rdf(spark, str(tmp_path / "s.ttl")).where("s = 'urn:U'"))
    assert ok and rows.count() == 0


def test_semantic(spark):
    v = semantic.embed("urn:ex:green_tea")
    assert abs(float(np.linalg.norm(v)) - 1) < 1e-6 and (v == semantic.embed("URN:ex:green_tea")).all()
    assert semantic.fnv1a(b"") == 0xCBF29CE484222325 and semantic.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    ix = semantic.Index(spark, capacity=5)
    assert ix.upsert(spark.createDataFrame([("green tea",), ("black tea",), ("steam engine",), ("green tea",)], "term string")) == 3
    assert ix.search("tea green", 1).first()["term"] == "green tea"
    ix.remove(spark.createDataFrame([("green tea",)], "term string"))
    assert not ix.contains("green tea") and ix.contains("black tea")
    assert semantic.semantic_retrieval(ix, "tea", "1")[0]["term"] == "black tea"
    for q, k in (("", "1"), ("tea", "x")):
        with pytest.raises(ValueError):
            semantic.semantic_retrieval(ix, q, k)
    with pytest.raises(ValueError):
        ix.upsert(spark.range(9).selectExpr("cast(id as string) term"))
