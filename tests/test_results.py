"""Result formats, read back."""

from quadloom.engine import Engine
from quadloom.sources import results
from quadloom.store import Store

XSD = "http://www.w3.org/2001/XMLSchema#"
WANT = (["x", "y"], [{"x": ("iri", "urn:a", None, None), "y": ("literal", "1", XSD + "integer", None)}, {"x": ("bnode", "b", None, None)}, {"y": ("literal", "h\ti \"é\"", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")}])
XML = """<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head><variable name="x"/><variable name="y"/></head><results>
<result><binding name="x"><uri>urn:a</uri></binding><binding name="y"><literal datatype="http://www.w3.org/2001/XMLSchema#integer">1</literal></binding></result>
<result><binding name="x"><bnode>b</bnode></binding></result><result><binding name="y"><literal xml:lang="en">h\ti "é"</literal></binding></result></results></sparql>"""
JSON = """{"head": {"vars": ["x", "y"]}, "results": {"bindings": [{"x": {"type": "uri", "value": "urn:a"}, "y": {"type": "literal", "value": "1", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}},
{"x": {"type": "bnode", "value": "b"}}, {"y": {"type": "literal", "value": "h\\ti \\"é\\"", "xml:lang": "en"}}]}}"""
TSV = "?x\t?y\n<urn:a>\t1\n_:b\t\n\t\"h\\ti \\\"é\\\"\"@en\n"


def test_readers():
    for text, fmt in ((XML, "srx"), (JSON, "srj"), (TSV, "tsv")):
        assert results.read_results(text, fmt) == WANT, fmt
    names, rows = results.read_results('x,y\r\nurn:a,1\r\n_:b,\r\n,"h, ""i"""\r\n', "csv")
    assert names == ["x", "y"] and rows == [{"x": ("iri", "urn:a", None, None), "y": ("literal", "1", XSD + "string", None)}, {"x": ("bnode", "b", None, None)}, {"y": ("literal", 'h, "i"', XSD + "string", None)}]
    assert results.read_results("x\r\nhttps://ex.org/s\r\na: b\r\n", "csv")[1] == [{"x": ("iri", "https://ex.org/s", None, None)}, {"x": ("literal", "a: b", XSD + "string", None)}]
    assert results.read_results('{"head": {}, "boolean": true}', "json") is True
    assert results.read_results('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>false</boolean></sparql>', "xml") is False
    assert results.read_results("?a\n1.5\n2e0\ntrue\nword\n", "tsv")[1] == [{"a": ("literal", v, XSD + t, None)} for v, t in (("1.5", "decimal"), ("2e0", "double"), ("true", "boolean"), ("word", "string"))]


def test_writers(spark):
    store = Store(spark)
    n = store.update('INSERT DATA { :a :p 1 , "x"@en . :b :p :a }', {"": "urn:"})
    e = Engine(store.dataset(), {"": "urn:"})
    assert results.update_json(n) == {"affected": 3} and results.ask_json(e.query("ASK { :a :p 1 }")) == {"head": {}, "boolean": True}
    assert results.construct_json(e.query("CONSTRUCT { ?s :q ?o } WHERE { ?s :p ?o }")) == {"triples": 3}
    got = results.select_json(e.query("SELECT ?s ?o { ?s :p ?o }"))
    import json

    names, rows = results.read_results(json.dumps(got), "json")
    assert names == ["s", "o"] and {(r["s"][1], r["o"]) for r in rows} == {("urn:a", ("literal", "1", XSD + "integer", None)), ("urn:a", ("literal", "x", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")), ("urn:b", ("iri", "urn:a", None, None))}
