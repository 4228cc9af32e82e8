"""Stores in files, tenants, transactions, EXISTS at any depth, joins over unbound variables and rules in several rounds."""

import pytest
from pyspark.sql import functions as F

from quadloom.engine import Engine, tables_engine
from quadloom.operators.paths import closure
from quadloom.operators.semantic import Index
from quadloom.sources.rdf_io import load_rdf
from quadloom.store import COMPACT, Conflict, Store, Transactions
from quadloom.streaming.ingest import into_store, quad_stream
from quadloom.terms import QueryError

from .test_queries import DIR, plan
from .test_reasoner import infer

P = {"": "urn:"}


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_store_in_files(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path=path, keep=3)
    assert store.at().count() == 0 and store.version == 0
    store.update("INSERT DATA { :a :p 1 . :b :q 2 . GRAPH :g { :a :p 3 } }", P)
    store.update("DELETE DATA { :b :q 2 . :z :z :z }", P)
    again = Store(spark, path=path, keep=3)
    assert again.version == 2 and rows(again.at()) == rows(store.at()) and again.at(1).count() == 3 and again.at().count() == 2
    again.update("INSERT DATA { :c :p 4 }", P)
    with pytest.raises(Conflict):  # the first store hasn't seen that version
        store.update("INSERT DATA { :d :p 5 }", P)
    for n in range(COMPACT + 2):
        again.update(f"INSERT DATA {{ :n :p {10 + n} }}", P)
    assert sorted(again.versions) == [again.version - 2, again.version - 1, again.version] and again.at().count() == 3 + COMPACT + 2
    held = {f for v in again.versions.values() for f in (v.base, *v.changes)}
    assert {p.name for p in (tmp_path / "store").iterdir()} == held | {"log"}
    scan = plan(Engine(again.dataset(), P).query("SELECT * { ?s :p ?o }"))
    assert "PartitionFilters: [isnotnull(part" in scan  # the folder of one predicate is read
    assert Engine(again.dataset(), P).query("SELECT * { ?s :p ?o }").count() == 2 + COMPACT + 2
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.nt").write_text("<urn:s> <urn:p> <urn:o> .\n<urn:n> <urn:p> <urn:o2> .\n")
    for _ in range(2):  # a batch run twice changes nothing
        into_store(quad_stream(spark, str(files)), again, str(tmp_path / f"c{_}")).awaitTermination()
        assert Store(spark, path=path, keep=3).at().where("s in ('urn:s', 'urn:n') and o.kind = 'iri'").count() == 2
    with pytest.raises(ValueError):
        into_store(quad_stream(spark, str(files)), Store(spark), str(tmp_path / "c9"))


def test_tenants(spark):
    store = Store(spark)
    store.update("INSERT DATA { GRAPH <urn:tenant:a:x> { :s :p 1 } GRAPH <urn:tenant:b:x> { :s :p 2 } :s :p 3 }", P)
    for leak in (
        "INSERT { GRAPH <urn:tenant:a:y> { ?s ?p ?o } } WHERE { GRAPH <urn:tenant:b:x> { ?s ?p ?o } }",
        "INSERT { GRAPH <urn:tenant:a:y> { ?s ?p ?o } } WHERE { GRAPH <urn:tenant:a:x> { ?s ?p ?o FILTER EXISTS { GRAPH <urn:tenant:b:x> { ?s ?p 2 } } } }",
        "INSERT { GRAPH <urn:tenant:a:y> { ?s ?p ?o } } WHERE { { SELECT * { GRAPH <urn:tenant:b:x> { ?s ?p ?o } } } }",
        "INSERT { GRAPH ?g { :s :p 9 } } WHERE { GRAPH ?g { ?s ?p ?o } }", "CLEAR ALL", "DROP NAMED", "COPY <urn:tenant:b:x> TO <urn:tenant:a:z>", "CLEAR GRAPH <urn:tenant:ab>",
    ):
        with pytest.raises(QueryError):
            store.update(leak, P, tenant="a")
    store.update("INSERT { GRAPH <urn:tenant:a:y> { ?s ?p ?o } } WHERE { { GRAPH ?g { ?s ?p ?o } } UNION { ?s ?p ?o } }", P, tenant="a")
    got = Engine(store.dataset().tenant("a"), P).query("SELECT ?g ?o { GRAPH ?g { ?s ?p ?o } }")
    assert {(r["g"], r["o"]["v"]) for r in got.collect()} == {("urn:tenant:a:x", "1"), ("urn:tenant:a:y", "1")}


def test_transactions_and_index(spark):
    store = Store(spark)
    index = Index(spark)
    store.attach(index)
    manager = Transactions(store, limit=2, seconds=60)
    one, two = manager.begin(), manager.begin()
    with pytest.raises(RuntimeError):
        manager.begin()
    one.update("INSERT DATA { :a :p :b }", P)
    one.update("DELETE { :a :p ?x } INSERT { :a :q ?x } WHERE { :a :p ?x }", P)
    assert Engine(one.dataset(), P).ask("ASK { :a :q :b }") and store.at().count() == 0
    assert one.commit() == store.version and Engine(store.dataset(), P).ask("ASK { :a :q :b }")
    two.update("INSERT DATA { :c :p :d }", P)
    with pytest.raises(Conflict):
        two.commit()
    three = manager.begin(seconds=-1)
    assert manager.expire() == 1 and three.status == "expired" and store.at().count() == 1
    with pytest.raises(RuntimeError):
        three.update("INSERT DATA { :c :p :d }", P)
    assert index.contains("urn:a") or index.rows.count() == 3  # terms of the newest version
    store.update("CLEAR ALL", P)
    assert index.rows.count() == 0


def test_exists_at_any_depth(spark, tmp_path):
    e = tables_engine(spark, DIR)
    flat = e.query("SELECT ?c { ?c t:c_acctbal ?b ; t:c_nation ?n FILTER EXISTS { ?s t:s_nation ?n ; t:s_acctbal ?x FILTER(?x > ?b) } }")
    deep = e.query("SELECT ?c { ?c t:c_acctbal ?b ; t:c_nation ?n FILTER EXISTS { { ?s t:s_nation ?n ; t:s_acctbal ?x FILTER(?x > ?b) } UNION { ?s t:s_nosuch ?x } } }")
    assert rows(flat) == rows(deep) and flat.count() > 0
    q = Engine(Store(spark, load_rdf(spark, _file(tmp_path, ":a :p 1 ; :q 5 . :b :p 2 ; :q 1 . :c :p 3 ."))).dataset(), P)
    assert rows(q.query("SELECT ?s { ?s :p ?x FILTER EXISTS { ?s :q ?y BIND(?y - ?x AS ?d) FILTER(?d > 0) } }")) == ["('urn:a',)"]
    assert rows(q.query("SELECT ?s { ?s :p ?x FILTER NOT EXISTS { ?s :q ?y OPTIONAL { ?s :p ?z FILTER(?z > ?x) } FILTER(?y > ?x) } }")) == ["('urn:b',)", "('urn:c',)"]
    assert rows(q.query("SELECT ?s { ?s :p ?x FILTER EXISTS { ?t :p ?z FILTER EXISTS { ?t :q ?w FILTER(?w > ?x + 2) } } }")) == ["('urn:a',)", "('urn:b',)"]


def _file(tmp_path, text):
    p = tmp_path / "d.ttl"
    p.write_text("@prefix : <urn:> . " + text)
    return str(p)


def test_unbound_variables_are_joined_by_keys(spark):
    e = tables_engine(spark, DIR)
    chain = "SELECT ?d ?q ?e { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } OPTIONAL { ?e t:toxic ?q } }"
    minus = "SELECT ?d { { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } } MINUS { ?e t:toxic ?t . ?e t:quality ?q . ?e t:d_lang ?l } }"
    exists = "SELECT ?d { { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } } FILTER EXISTS { ?e t:toxic ?q ; t:d_lang ?l } }"
    for text in (minus, exists):
        p = plan(e.query(text))
        assert "NestedLoop" not in p and "Cartesian" not in p, text
    p = plan(e.query(chain))  # an unbound ?q meets all, which is a product; a bound one is a key
    assert "NestedLoopJoin BuildRight, LeftOuter" not in p and "NestedLoopJoin BuildLeft, LeftOuter" not in p and "HashJoin" in p


def test_many_values_and_closure_in_graphs(spark, tmp_path):
    e = tables_engine(spark, DIR)
    some = " ".join(f'"{n}"' for n in range(100))
    assert e.query(f"SELECT ?n {{ VALUES ?n {{ {some} }} }}").count() == 100
    nums = " ".join(f"(<urn:tpch:nation/{n}> {n})" for n in range(70))
    got = e.query(f"SELECT ?k ?v {{ ?n t:n_nationkey ?k VALUES (?n ?v) {{ {nums} }} }}").collect()
    assert len(got) == 25 and all(str(r["k"]) == r["v"]["v"] for r in got)
    store = Store(spark)
    store.update("INSERT DATA { GRAPH :g { :a :p :b . :b :p :c } GRAPH :h { :c :p :d . :x :r :y } }", P)
    q = Engine(store.dataset(), P)
    got = {(r["g"], r["s"]["v"], r["o"]["v"]) for r in q.query("SELECT ?g ?s ?o { GRAPH ?g { ?s :p+ ?o } }").collect()}
    assert got == {("urn:g", "urn:a", "urn:b"), ("urn:g", "urn:a", "urn:c"), ("urn:g", "urn:b", "urn:c"), ("urn:h", "urn:c", "urn:d")}
    assert q.query("SELECT * { GRAPH ?g { ?s :p* ?o } }").count() == 4 + 3 + 4 and q.query("SELECT * { GRAPH ?g { :a :p? ?o } }").count() == 2
    edges = spark.createDataFrame([(n, n + 1) for n in range(20)] + [(20, 0)], "s int, o int")
    assert closure(edges).count() == 21 * 21
    assert "about" in q.explain("SELECT * { ?s :p ?o }")


def test_rules_in_several_rounds(spark, tmp_path):
    _, got = infer(
        spark, tmp_path,
        """:u rdfs:subPropertyOf :v . :a :u 1.0 . :b :w 1 . :p owl:equivalentProperty :w .
        :K owl:hasKey ( :id ) . :Sub rdfs:subClassOf :K . :k1 a :Sub ; :id 7 . :k2 a :K ; :id 7 . :k1 :has :t .
        :I owl:intersectionOf ( :A :B ) . :A1 rdfs:subClassOf :A . :B1 rdfs:subClassOf :B . :x a :A1 , :B1 .
        :ch owl:propertyChainAxiom ( :s1 :s2 ) . :s0 rdfs:subPropertyOf :s1 . :c0 :s0 :c1 . :c1 :s2 :c2 .
        :myFirst rdfs:subPropertyOf <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> . :O owl:oneOf :lst . :lst :myFirst :only ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .""",
    )
    for t in (("urn:a", "v", "1"), ("urn:b", "p", "1"), ("urn:k1", "sameAs", "urn:k2"), ("urn:k2", "has", "urn:t"), ("urn:x", "type", "urn:I"), ("urn:c0", "ch", "urn:c2"), ("urn:only", "type", "urn:O")):
        assert t in got, t
