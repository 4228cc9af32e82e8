"""Rules, contradictions and caps of the reasoner."""

from quadloom.operators.reasoner import ill_typed, literal_values, materialize, parse_rules, RULES
from quadloom.sources.rdf_io import load_rdf

HEAD = "@prefix : <urn:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"


def infer(spark, tmp_path, text, **options):
    p = tmp_path / "r.ttl"
    p.write_text(HEAD + text)
    r = materialize(load_rdf(spark, str(p)), **options)
    return r, {(x["s"], x["p"].split("#")[-1].split(":")[-1], x["o"]["v"].split("#")[-1]) for x in r.inferred.collect()}


def test_chain(spark, tmp_path):
    r, _ = infer(spark, tmp_path, " ".join(f":n{k} rdfs:subClassOf :n{k + 1} ." for k in range(1, 40)))
    assert (r.inferred_triples, r.timed_out, r.inconsistent) == (741, False, False)
    r, _ = infer(spark, tmp_path, " ".join(f":n{k} rdfs:subClassOf :n{k + 1} ." for k in range(1, 40)), max_rounds=1)
    assert r.timed_out and r.inferred_triples < 741


def test_rules(spark, tmp_path):
    _, got = infer(
        spark,
        tmp_path,
        """:p rdfs:domain :A ; rdfs:range :B . :A rdfs:subClassOf :C . :x :p :y . :t a owl:TransitiveProperty . :a :t :b . :b :t :c .
        :s owl:inverseOf :z . :a :s :b . :f a owl:FunctionalProperty . :m :f :u , :w . :u :k 1 .
        :I owl:intersectionOf ( :A :D ) . :x a :D . :O owl:oneOf ( :o1 :o2 ) . :gp owl:propertyChainAxiom ( :par :par ) . :i :par :j . :j :par :l .
        :H owl:hasValue :hv ; owl:onProperty :hp . :q :hp :hv . :P owl:hasKey ( :id ) . :p1 a :P ; :id 7 . :p2 a :P ; :id 7 .""",
    )
    for t in (("urn:x", "type", "urn:A"), ("urn:y", "type", "urn:B"), ("urn:x", "type", "urn:C"), ("urn:a", "t", "urn:c"), ("urn:b", "z", "urn:a"), ("urn:u", "sameAs", "urn:w"), ("urn:w", "k", "1"), ("urn:x", "type", "urn:I"), ("urn:o1", "type", "urn:O"), ("urn:i", "gp", "urn:l"), ("urn:q", "type", "urn:H"), ("urn:p1", "sameAs", "urn:p2")):
        assert t in got, t


def test_contradictions(spark, tmp_path):
    r, _ = infer(spark, tmp_path, ":A owl:disjointWith :B . :x a :A , :B . :n :v 'z'^^<http://www.w3.org/2001/XMLSchema#boolean> .")
    assert r.inconsistent and set(r.contradictions) == {"cax-dw", "dt-not-type"}
    r, _ = infer(spark, tmp_path, ":x :p :y .", mode="off")
    assert r.inferred_triples == 0
    assert len(parse_rules(RULES)) > 50


def test_numbers_written_in_several_ways(spark):
    xsd = "http://www.w3.org/2001/XMLSchema#"
    one, real = f'"1"^^{xsd}integer', f'"1.0"^^{xsd}double'
    objects = {"a": one, "b": real, "c": f'"2"^^{xsd}integer', "d": '"1"@en', "e": f'"1"^^{xsd}string', "f": f'"{one}"@en', "g": f'"{one}"^^{xsd}string', "h": f'"x"^^{xsd}integer', "i": "urn:1"}
    t = spark.createDataFrame([(s, "urn:p", o) for s, o in objects.items()], "s string, p string, o string").repartition(3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    both = [("a", "urn:p", real), ("b", "urn:p", one)]
    assert rows(literal_values(t, t)) == both
    assert rows(literal_values(t, t.where("s = 'b'"))) == both
    assert rows(literal_values(t, t.where("s = 'c'"))) == []
    assert rows(ill_typed(t)) == [("h", "urn:p", objects["h"])]
