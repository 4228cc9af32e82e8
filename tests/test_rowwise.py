"""Rules over whole tables without a copy of them: the same triples as the rounds give, and which ontologies that is for."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quadloom.engine import Engine, as_quads
from quadloom.lineage import shared_folder
from quadloom.operators.reasoner import CONTRADICTIONS, RULES, materialize, parse_rules
from quadloom.operators.rowwise import materialize_rows
from quadloom.operators.small import is_local
from quadloom.queries import TURTLE, statements
from quadloom.sources.mapping import Dataset, map_table

LINES = "t:R owl:someValuesFrom owl:Thing ; owl:onProperty t:part . t:H owl:hasValue 'R' ; owl:onProperty t:flag . t:U owl:unionOf ( t:H t:None ) . t:I owl:intersectionOf ( t:R t:H ) ."
ROWS = [
    (1, 7, "R", 1, 1.0, 0.5), (2, None, "R", 2, 3.0, 1.0), (3, 8, "A", 1 << 53, 9007199254740992.0, None), (4, 9, None, None, -0.0, 0.0),
    (5, None, None, 5, float("nan"), float("inf")), (6, 7, "R", 1, 2.0, 2.5), (6, 7, "R", 1, 2.0, 2.5), (None, 7, "R", 77, 77.0, 1e10),
]


def dataset(spark, ontology, rows=ROWS):
    df = spark.createDataFrame(rows, "k long, part long, flag string, n long, q double, x double")
    f = df.withColumns({"f": F.col("x").cast("float"), "d": F.col("n").cast("decimal(38,2)"), "at": F.lit("2020-01-01").cast("timestamp"), "day": F.lit("2020-01-01").cast("date")})
    return Dataset(spark, [map_table(f, "line", "urn:line/", "k", "urn:tpch:Line", {"part": ("part", "urn:part/")})]).with_quads(statements(spark, TURTLE + ontology))


def triples(df):
    return sorted(tuple(r) for r in df.select("s", "p", "o.kind", "o.v", "o.dt", F.coalesce("o.lang", F.lit(""))).na.fill("").where("s <> ''").collect())


ONTOLOGIES = {
    "lists": LINES,
    "classes": "t:part rdfs:domain t:A . t:A rdfs:subClassOf t:B . t:Line owl:equivalentClass t:Row . t:B owl:disjointWith t:H . t:H owl:hasValue 'R' ; owl:onProperty t:flag . t:V owl:hasValue <urn:part/7> ; owl:onProperty t:part .",
    "values": "t:H owl:hasValue 'R' ; owl:onProperty t:flag . t:A rdfs:subClassOf t:H . t:part rdfs:domain t:A . t:Line rdfs:subClassOf t:G . t:G owl:hasValue 'x'@en ; owl:onProperty t:note .",
    "numbers only": "t:a rdfs:subClassOf t:b .",
}


@pytest.mark.parametrize("name", ONTOLOGIES)
def test_same_as_the_rounds(spark, name):
    data = dataset(spark, ONTOLOGIES[name])
    got, want = materialize_rows(data), materialize(as_quads(data))
    assert got is not None and got.predicates is not None
    rows, expected = triples(got.inferred), triples(want.inferred)
    assert rows == expected and len(rows) == len(set(rows)) and got.inferred_triples == len(rows)
    assert {p for _, p, *_ in rows} <= got.predicates
    assert (got.inconsistent, sorted(got.contradictions)) == (want.inconsistent, sorted(want.contradictions))


def test_tables_are_not_copied(spark):
    """What is inferred of a table stays a plan over its rows: what is written doesn't grow with them."""
    rows = [(n, n % 3 or None, "RA"[n % 2], n % 7, float(n % 50), 0.25) for n in range(20_000)]
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = size()
    engine, report = Engine(dataset(spark, LINES, rows), {"t": "urn:tpch:"}).infer()
    df = engine.query("SELECT ?c (COUNT(*) AS ?n) { ?l a ?c FILTER(?c IN (t:R, t:H, t:U, t:I)) } GROUP BY ?c")
    both = sum(1 for r in rows if r[1] and r[2] == "R")
    assert {r["c"]["v"].split(":")[-1]: r["n"] for r in df.collect()} == {"R": sum(1 for r in rows if r[1]), "H": 10_000, "U": 10_000, "I": both}
    assert size() - before < 200_000  # the triples of the table take over 10 MB


@pytest.mark.parametrize(
    "ontology",
    [
        "t:part rdfs:range t:P .", "t:part owl:inverseOf t:of .", "t:flag rdfs:subPropertyOf t:mark .", "t:K owl:hasKey ( t:flag ) .", "t:H owl:hasValue 1 ; owl:onProperty t:n .",
        "t:S owl:someValuesFrom t:P ; owl:onProperty t:part .", "t:part a owl:FunctionalProperty .", "t:part owl:propertyDisjointWith t:flag .", "<urn:line/1> t:flag 'A' .", "t:flag rdfs:subPropertyOf <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> .",
        "[] a owl:AllDisjointProperties ; owl:members ( t:part t:flag ) .",
    ],
)
def test_left_to_the_rounds(spark, ontology):
    data = dataset(spark, ontology)
    assert materialize_rows(data) is None
    assert materialize_rows(dataset(spark, LINES), max_rounds=3) is None


def test_rows_of_a_subject_that_differ(spark):
    assert materialize_rows(dataset(spark, LINES, [(1, 7, "R", 1, 1.0, 0.5), (1, None, "A", 1, 1.0, 0.5)])) is None


def test_local_rules():
    local = {r.name for r in parse_rules(RULES) + parse_rules(CONTRADICTIONS) if is_local(r)}
    assert {"cax-sco", "prp-dom", "prp-spo1", "cls-hv1", "cls-hv2", "cls-svf2", "cls-uni", "cls-int2", "cax-dw", "scm-sco"} <= local
    assert not local & {"prp-rng", "prp-inv1", "prp-symp", "prp-trp", "prp-fp", "cls-svf1", "cls-avf", "eq-rep-s", "eq-rep-o", "prp-pdw", "prp-irp", "prp-asyp", "prp-adp", "cls-maxqc1"}
