"""RDFS and OWL 2 RL materialisation by semi-naive rounds.

Rules are written as text, body -> head, and compiled to joins.  A round joins, for each rule and
each of its body patterns, what the last round added with all that is known, and keeps what is
new.  Rules of whose vocabulary the data hold nothing are not compiled at all.  Triples are
rows of three strings here: a literal is written with its quotes, datatype and language.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import BOOLEAN, DECIMAL, DOUBLE, FLOAT, INTEGER, STRING
from ..lineage import cut
from .paths import closure
from ..terms import INTEGERS, LANG_STRING, NUMERICS, OWL, RDF, RDFS, XSD

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "q": "urn:quadloom:"}
#: Working predicates: members of an RDF list; they never leave the reasoner.
MEMBER = "urn:quadloom:member"

# The rules of RDFS and of the OWL 2 RL profile, by their names there.
RULES = """
scm-sco     ?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?c -> ?a rdfs:subClassOf ?c
scm-spo     ?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?c -> ?a rdfs:subPropertyOf ?c
prp-spo1    ?p rdfs:subPropertyOf ?q . ?x ?p ?y -> ?x ?q ?y
prp-eqp1    ?p owl:equivalentProperty ?q . ?x ?p ?y -> ?x ?q ?y
prp-eqp2    ?p owl:equivalentProperty ?q . ?x ?q ?y -> ?x ?p ?y
scm-eqp1    ?p owl:equivalentProperty ?q -> ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p
scm-eqp2    ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p if ?p != ?q -> ?p owl:equivalentProperty ?q
scm-op      ?p rdf:type owl:ObjectProperty -> ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-dp      ?p rdf:type owl:DatatypeProperty -> ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-cls     ?c rdf:type owl:Class -> ?c rdfs:subClassOf ?c . ?c owl:equivalentClass ?c . ?c rdfs:subClassOf owl:Thing . owl:Nothing rdfs:subClassOf ?c
scm-eqc1    ?a owl:equivalentClass ?b -> ?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?a
scm-eqc2    ?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?a if ?a != ?b -> ?a owl:equivalentClass ?b
cax-eqc1    ?a owl:equivalentClass ?b . ?x rdf:type ?a -> ?x rdf:type ?b
cax-eqc2    ?a owl:equivalentClass ?b . ?x rdf:type ?b -> ?x rdf:type ?a
cax-sco     ?a rdfs:subClassOf ?b . ?x rdf:type ?a -> ?x rdf:type ?b
scm-dom1    ?p rdfs:domain ?a . ?a rdfs:subClassOf ?b -> ?p rdfs:domain ?b
scm-dom2    ?q rdfs:domain ?c . ?p rdfs:subPropertyOf ?q -> ?p rdfs:domain ?c
scm-rng1    ?p rdfs:range ?a . ?a rdfs:subClassOf ?b -> ?p rdfs:range ?b
scm-rng2    ?q rdfs:range ?c . ?p rdfs:subPropertyOf ?q -> ?p rdfs:range ?c
prp-dom     ?p rdfs:domain ?c . ?x ?p ?y -> ?x rdf:type ?c
prp-rng     ?p rdfs:range ?c . ?x ?p ?y -> ?y rdf:type ?c
prp-inv1    ?p owl:inverseOf ?q . ?x ?p ?y -> ?y ?q ?x
prp-inv2    ?p owl:inverseOf ?q . ?x ?q ?y -> ?y ?p ?x
prp-symp    ?p rdf:type owl:SymmetricProperty . ?x ?p ?y -> ?y ?p ?x
prp-trp     ?p rdf:type owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z -> ?x ?p ?z
prp-fp      ?p rdf:type owl:FunctionalProperty . ?x ?p ?y . ?x ?p ?z if ?y != ?z -> ?y owl:sameAs ?z
prp-ifp     ?p rdf:type owl:InverseFunctionalProperty . ?x ?p ?z . ?y ?p ?z if ?x != ?y -> ?x owl:sameAs ?y
rdfs6       ?p rdf:type rdf:Property -> ?p rdfs:subPropertyOf ?p
rdfs8       ?c rdf:type rdfs:Class -> ?c rdfs:subClassOf rdfs:Resource
rdfs10      ?c rdf:type rdfs:Class -> ?c rdfs:subClassOf ?c
rdfs12      ?p rdf:type rdfs:ContainerMembershipProperty -> ?p rdfs:subPropertyOf rdfs:member
rdfs13      ?d rdf:type rdfs:Datatype -> ?d rdfs:subClassOf rdfs:Literal
cls-svf1    ?r owl:someValuesFrom ?c . ?r owl:onProperty ?p . ?x ?p ?y . ?y rdf:type ?c -> ?x rdf:type ?r
cls-svf2    ?r owl:someValuesFrom owl:Thing . ?r owl:onProperty ?p . ?x ?p ?y -> ?x rdf:type ?r
cls-avf     ?r owl:allValuesFrom ?c . ?r owl:onProperty ?p . ?x rdf:type ?r . ?x ?p ?y -> ?y rdf:type ?c
cls-hv1     ?r owl:hasValue ?v . ?r owl:onProperty ?p . ?x rdf:type ?r -> ?x ?p ?v
cls-hv2     ?r owl:hasValue ?v . ?r owl:onProperty ?p . ?x ?p ?v -> ?x rdf:type ?r
cls-maxc2   ?r owl:maxCardinality ONE . ?r owl:onProperty ?p . ?x rdf:type ?r . ?x ?p ?y . ?x ?p ?z if ?y != ?z -> ?y owl:sameAs ?z
cls-maxqc3  ?r owl:maxQualifiedCardinality ONE . ?r owl:onProperty ?p . ?r owl:onClass ?c . ?x rdf:type ?r . ?x ?p ?y . ?y rdf:type ?c . ?x ?p ?z . ?z rdf:type ?c if ?y != ?z -> ?y owl:sameAs ?z
cls-maxqc4  ?r owl:maxQualifiedCardinality ONE . ?r owl:onProperty ?p . ?r owl:onClass owl:Thing . ?x rdf:type ?r . ?x ?p ?y . ?x ?p ?z if ?y != ?z -> ?y owl:sameAs ?z
cls-int2    ?c owl:intersectionOf ?l . ?l q:member ?m . ?x rdf:type ?c -> ?x rdf:type ?m
cls-uni     ?c owl:unionOf ?l . ?l q:member ?m . ?x rdf:type ?m -> ?x rdf:type ?c
cls-oo      ?c owl:oneOf ?l . ?l q:member ?m -> ?m rdf:type ?c
scm-int     ?c owl:intersectionOf ?l . ?l q:member ?m -> ?c rdfs:subClassOf ?m
scm-uni     ?c owl:unionOf ?l . ?l q:member ?m -> ?m rdfs:subClassOf ?c
scm-hv      ?a owl:hasValue ?v . ?a owl:onProperty ?p . ?b owl:hasValue ?v . ?b owl:onProperty ?q . ?p rdfs:subPropertyOf ?q -> ?a rdfs:subClassOf ?b
scm-svf1    ?a owl:someValuesFrom ?x . ?a owl:onProperty ?p . ?b owl:someValuesFrom ?y . ?b owl:onProperty ?p . ?x rdfs:subClassOf ?y -> ?a rdfs:subClassOf ?b
scm-svf2    ?a owl:someValuesFrom ?x . ?a owl:onProperty ?p . ?b owl:someValuesFrom ?x . ?b owl:onProperty ?q . ?p rdfs:subPropertyOf ?q -> ?a rdfs:subClassOf ?b
scm-avf1    ?a owl:allValuesFrom ?x . ?a owl:onProperty ?p . ?b owl:allValuesFrom ?y . ?b owl:onProperty ?p . ?x rdfs:subClassOf ?y -> ?a rdfs:subClassOf ?b
scm-avf2    ?a owl:allValuesFrom ?x . ?a owl:onProperty ?p . ?b owl:allValuesFrom ?x . ?b owl:onProperty ?q . ?p rdfs:subPropertyOf ?q -> ?b rdfs:subClassOf ?a
eq-sym      ?x owl:sameAs ?y -> ?y owl:sameAs ?x
eq-trans    ?x owl:sameAs ?y . ?y owl:sameAs ?z -> ?x owl:sameAs ?z
eq-ref      ?x owl:sameAs ?y -> ?x owl:sameAs ?x . ?y owl:sameAs ?y
eq-rep-s    ?x owl:sameAs ?y . ?x ?p ?o if ?x != ?y -> ?y ?p ?o
eq-rep-p    ?p owl:sameAs ?q . ?x ?p ?y if ?p != ?q -> ?x ?q ?y
eq-rep-o    ?x owl:sameAs ?y . ?s ?p ?x if ?x != ?y -> ?s ?p ?y
"""

# Bodies that are inconsistent.
CONTRADICTIONS = """
cls-nothing2  ?x rdf:type owl:Nothing
cax-dw        ?a owl:disjointWith ?b . ?x rdf:type ?a . ?x rdf:type ?b
cls-com       ?a owl:complementOf ?b . ?x rdf:type ?a . ?x rdf:type ?b
eq-diff1      ?x owl:sameAs ?y . ?x owl:differentFrom ?y
eq-diff2      ?d rdf:type owl:AllDifferent . ?d owl:members ?l . ?l q:member ?x . ?l q:member ?y . ?x owl:sameAs ?y if ?x != ?y
eq-diff3      ?d rdf:type owl:AllDifferent . ?d owl:distinctMembers ?l . ?l q:member ?x . ?l q:member ?y . ?x owl:sameAs ?y if ?x != ?y
prp-irp       ?p rdf:type owl:IrreflexiveProperty . ?x ?p ?x
prp-asyp      ?p rdf:type owl:AsymmetricProperty . ?x ?p ?y . ?y ?p ?x
prp-pdw       ?p owl:propertyDisjointWith ?q . ?x ?p ?y . ?x ?q ?y
prp-adp       ?d rdf:type owl:AllDisjointProperties . ?d owl:members ?l . ?l q:member ?p . ?l q:member ?q . ?x ?p ?y . ?x ?q ?y if ?p != ?q
cax-adc       ?d rdf:type owl:AllDisjointClasses . ?d owl:members ?l . ?l q:member ?a . ?l q:member ?b . ?x rdf:type ?a . ?x rdf:type ?b if ?a != ?b
cls-maxc1     ?r owl:maxCardinality ZERO . ?r owl:onProperty ?p . ?x rdf:type ?r . ?x ?p ?y
cls-maxqc1    ?r owl:maxQualifiedCardinality ZERO . ?r owl:onProperty ?p . ?r owl:onClass ?c . ?x rdf:type ?r . ?x ?p ?y . ?y rdf:type ?c
cls-maxqc2    ?r owl:maxQualifiedCardinality ZERO . ?r owl:onProperty ?p . ?r owl:onClass owl:Thing . ?x rdf:type ?r . ?x ?p ?y
prp-npa1      ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetIndividual ?y . ?x ?p ?y
prp-npa2      ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetValue ?y . ?x ?p ?y
"""

# Annotation properties and datatypes that the axioms name.
ANNOTATIONS = tuple(RDFS + n for n in "label comment seeAlso isDefinedBy".split()) + tuple(OWL + n for n in "deprecated versionInfo priorVersion backwardCompatibleWith incompatibleWith".split())
DATATYPES = tuple(XSD + n for n in "string boolean decimal integer double float dateTime dateTimeStamp anyURI hexBinary base64Binary normalizedString token language Name NCName NMTOKEN long int short byte unsignedLong unsignedInt unsignedShort unsignedByte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger".split()) + (RDF + "langString", RDF + "PlainLiteral", RDF + "XMLLiteral", RDFS + "Literal")


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple
    head: tuple
    unequal: tuple | None


def term(word: str) -> str:
    if word[0] == "?" or word in ("ZERO", "ONE"):
        return word
    prefix, _, local = word.partition(":")
    return PREFIXES[prefix] + local


def parse_rules(text: str) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        name, rest = line.split(None, 1)
        body, _, head = rest.partition("->")
        body, _, guard = body.partition(" if ")
        triples = lambda s: tuple(tuple(term(w) for w in t.split()) for t in s.split(" . ") if t.strip())
        out.append(Rule(name, triples(body.strip()), triples(head.strip()), tuple(w for w in guard.split() if w[0] == "?") or None))
    return out


def encode(o: Column) -> Column:
    """A term struct as one string."""
    lit = F.concat(F.lit('"'), o["v"], F.lit('"'), F.when(o["lang"].isNotNull(), F.concat(F.lit("@"), o["lang"])).otherwise(F.concat(F.lit("^^"), o["dt"])))
    return F.when(o["kind"] == "literal", lit).otherwise(o["v"])


LITERAL = r'(?s)^"(.*)"(?:\^\^([^"]*)|@([^"]*))$'


def decode(c: Column) -> Column:
    """The term struct of such a string."""
    lang = F.nullif(F.regexp_extract(c, LITERAL, 3), F.lit(""))
    dt = F.when(lang.isNotNull(), LANG_STRING).otherwise(F.regexp_extract(c, LITERAL, 2))
    none = F.lit(None).cast("string")
    lit = F.struct(F.lit("literal").alias("kind"), F.regexp_extract(c, LITERAL, 1).alias("v"), dt.alias("dt"), lang.alias("lang"))
    return F.when(c.startswith('"'), lit).otherwise(F.struct(F.when(c.startswith("_:"), "bnode").otherwise("iri").alias("kind"), c.alias("v"), none.alias("dt"), none.alias("lang")))


def datatype(c: str | Column) -> Column:
    """The datatype of a typed literal written so; of other terms, something that is no datatype."""
    return F.substring_index(c, '"^^', -1)


def lexical(c: str | Column) -> Column:
    """The lexical form of a typed literal written so."""
    return F.substring(c, F.lit(2), F.length(c) - F.length(datatype(c)) - 4)


def literal_number(c: str | Column) -> Column:
    """The value of a number written so, as a double."""
    return lexical(c).try_cast("double")


def _match(t: DataFrame, pattern: tuple) -> DataFrame:
    """Rows of triples that fit a pattern, a column a variable."""
    cols: dict[str, Column] = {}
    for name, x in zip(("s", "p", "o"), pattern):
        if x in ("ZERO", "ONE"):
            n = "0" if x == "ZERO" else "1"
            t = t.where(F.col(name).isin(*[f'"{n}"^^{d}' for d in INTEGERS]))
        elif x[0] != "?":
            t = t.where(F.col(name) == x)
        elif x in cols:
            t = t.where(cols[x] == F.col(name))
        else:
            cols[x] = F.col(name)
    return t.select(*[c.alias(v) for v, c in cols.items()]) if cols else t.select(F.lit(1).alias("?one")).limit(1)


#: Rows of a pattern of the vocabulary that are sent to every executor rather than shuffled.
FEW = 100_000


def _body(parts: list[DataFrame], rule: Rule, counts: list[int | None]) -> DataFrame:
    """Join of a rule's patterns; counts: rows of each if known, so that small ones are broadcast."""
    few = lambda n: n is not None and n <= FEW
    whole, size = parts[0], counts[0]
    rest = list(zip(parts[1:], counts[1:]))
    while rest:  # a pattern that shares a variable next, so that no product is formed
        n = next((n for n, (p, _) in enumerate(rest) if set(p.columns) & set(whole.columns)), 0)
        p, many = rest.pop(n)
        on = [c for c in p.columns if c in whole.columns]
        whole, p = F.broadcast(whole) if few(size) else whole, F.broadcast(p) if few(many) else p
        whole = whole.join(p, on) if on else whole.crossJoin(p)
        size = size * many if few(size) and few(many) and size * many <= FEW else None
    if rule.unequal:
        whole = whole.where(F.col(f"`{rule.unequal[0]}`") != F.col(f"`{rule.unequal[1]}`"))
    return whole


class Vocabulary:
    """What words of the rules the triples use, and how often: predicates, and classes of rdf:type; and whether they hold numbers."""

    def __init__(self, t: DataFrame, rules: list[Rule]):
        words = sorted({x for r in rules for b in r.body for x in b if x[0] != "?" and ":" in x} | {OWL + "hasKey", OWL + "propertyChainAxiom", RDF + "first", RDF + "rest"})
        known = F.when(F.col("p").isin(words), F.col("p"))
        cls = F.when((F.col("p") == RDF + "type") & F.col("o").isin(words), F.col("o"))
        number = F.coalesce(datatype("o").isin(*NUMERICS) & F.col("o").startswith('"'), F.lit(False))
        rows = t.select(known.alias("p"), cls.alias("o"), number.alias("number")).where("p is not null or number").groupBy("p", "o", "number").agg(F.count("*").alias("n")).collect()
        self.predicates: dict[str, int] = {}
        self.classes: dict[str, int] = {}
        self.numbers = any(r["number"] for r in rows)
        for r in rows:
            if r["p"]:
                self.predicates[r["p"]] = self.predicates.get(r["p"], 0) + r["n"]
            if r["o"]:
                self.classes[r["o"]] = self.classes.get(r["o"], 0) + r["n"]

    def copy(self) -> "Vocabulary":
        out = Vocabulary.__new__(Vocabulary)
        out.predicates, out.classes, out.numbers = dict(self.predicates), dict(self.classes), self.numbers
        return out

    def add(self, other: "Vocabulary") -> None:
        for mine, more in ((self.predicates, other.predicates), (self.classes, other.classes)):
            for w, n in more.items():
                mine[w] = mine.get(w, 0) + n
        self.numbers |= other.numbers

    def may(self, pattern: tuple) -> bool:
        _, p, o = pattern
        if p[0] == "?":
            return True
        if p not in self.predicates:
            return False
        return p != RDF + "type" or o[0] == "?" or o in self.classes

    def may_all(self, rule: Rule) -> bool:
        return all(self.may(b) for b in rule.body)

    def count(self, pattern: tuple) -> int | None:
        """Rows that fit a pattern at most, if the vocabulary tells."""
        _, p, o = pattern
        if p == MEMBER or p[0] == "?":
            return None
        return self.classes.get(o, 0) if p == RDF + "type" and o[0] != "?" else self.predicates.get(p, 0)


def lists(t: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Members of all RDF lists: rows (l, pos, m)."""
    first = cut(t.where(F.col("p") == RDF + "first").select(F.col("s").alias("n"), F.col("o").alias("m")))
    if first.isEmpty():
        return first.select(F.col("n").alias("l"), F.lit(0).alias("pos"), "m")
    rest = cut(t.where(F.col("p") == RDF + "rest").select(F.col("s").alias("n"), F.col("o").alias("next")))
    heads = first.select("n").distinct()
    at = cut(heads.select(F.col("n").alias("l"), "n"))
    out = at.join(first, "n").select("l", F.lit(0).alias("pos"), "m")
    for k in range(1, rounds):
        at = cut(at.join(rest, "n").where(F.col("next") != RDF + "nil").select("l", F.col("next").alias("n")))
        if at.isEmpty():
            return cut(out)
        out = out.unionByName(at.join(first, "n").select("l", F.lit(k).alias("pos"), "m"))
    raise RuntimeError("a list doesn't end")


def member_triples(members: DataFrame) -> DataFrame:
    return members.select(F.col("l").alias("s"), F.lit(MEMBER).alias("p"), F.col("m").alias("o")).distinct()


def _list_rules(t: DataFrame, delta: DataFrame, members: DataFrame, vocabulary: Vocabulary) -> list[DataFrame]:
    """Rules that need a whole list: intersections, keys and property chains; only for subjects of new triples, or chains with a new step."""
    out = []
    size = members.groupBy("l").agg(F.count("*").alias("size"))
    pick = lambda p, a, b: t.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    touched = delta.select(F.col("s").alias("x")).distinct()
    if OWL + "intersectionOf" in vocabulary.predicates:
        want = pick(OWL + "intersectionOf", "c", "l").join(members, "l")
        got = want.join(pick(RDF + "type", "x", "m").join(touched, "x", "left_semi"), "m").groupBy("c", "l", "x").agg(F.count_distinct("pos").alias("have"))
        out.append(got.join(size, "l").where("have = size").select(F.col("x").alias("s"), F.lit(RDF + "type").alias("p"), F.col("c").alias("o")))
    if OWL + "hasKey" in vocabulary.predicates:
        keyed = pick(OWL + "hasKey", "c", "l").join(members, "l").join(pick(RDF + "type", "x", "c"), "c")
        values = keyed.join(t.select(F.col("s").alias("x"), F.col("p").alias("m"), F.col("o").alias("v")), ["x", "m"]).select("c", "l", "pos", "x", "v").distinct()
        new = values.join(touched, "x", "left_semi")
        pairs = new.join(values.withColumnRenamed("x", "y"), ["c", "l", "pos", "v"]).where("x <> y").groupBy("c", "l", "x", "y").agg(F.count_distinct("pos").alias("have"))
        out.append(pairs.join(size, "l").where("have = size").select(F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("o")), F.struct(F.col("y").alias("s"), F.col("x").alias("o")))).alias("e")).select("e.s", F.lit(OWL + "sameAs").alias("p"), "e.o"))
    if OWL + "propertyChainAxiom" in vocabulary.predicates:
        axioms = pick(OWL + "propertyChainAxiom", "q", "l")
        steps = axioms.join(members, "l")
        if delta.join(steps.select(F.col("m").alias("p")).distinct(), "p", "left_semi").isEmpty():
            return out
        longest = steps.agg(F.max("pos")).first()[0]
        edges = t.select(F.col("s").alias("a"), F.col("p").alias("m"), F.col("o").alias("b"))
        walk = steps.where("pos = 0").join(edges, "m").select("q", "l", "a", "b")
        for k in range(1, (longest or 0) + 1):
            out.append(_ended(walk, size, k))
            walk = walk.withColumnRenamed("b", "mid").join(steps.where(F.col("pos") == k).select("q", "l", "m"), ["q", "l"]).join(edges.withColumnRenamed("a", "mid"), ["m", "mid"]).select("q", "l", "a", "b")
        out.append(_ended(walk, size, (longest or 0) + 1))
    return out


def _ended(walk: DataFrame, size: DataFrame, k: int) -> DataFrame:
    return walk.join(size.where(F.col("size") == k), "l").select(F.col("a").alias("s"), F.col("q").alias("p"), F.col("b").alias("o"))


def literal_values(t: DataFrame, new: DataFrame) -> DataFrame:
    """dt-eq: triples whose number is written another way elsewhere, with that other way; either of them among the new ones, which are part of `t`."""

    def numbers(df: DataFrame) -> DataFrame:
        lit = df.where(F.col("o").startswith('"') & datatype("o").isin(*NUMERICS))
        return lit.select("s", "p", "o", literal_number("o").alias("n")).where("n is not null")

    every = numbers(t)
    if new is not t:
        every = every.join(numbers(new).select("n").distinct(), "n", "left_semi")
    # most numbers are written in one way, and go no further than this aggregate of hashes
    h = F.xxhash64("o")
    several = every.groupBy("n").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least <> most").select("n")
    forms = every.join(several, "n", "left_semi").select("n", F.col("o").alias("other")).distinct()
    return every.join(forms, "n").where("o <> other").select("s", "p", F.col("other").alias("o"))


def ill_typed(t: DataFrame) -> DataFrame:
    """dt-not-type: triples whose literal isn't of its datatype."""
    return t.where(F.col("o").startswith('"')).where(~well_typed(lexical("o"), datatype("o")))


# Lexical forms of datatypes, and the bounds of the bounded integers.
FORMS = {INTEGER: r"^[+-]?[0-9]+$", DECIMAL: r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", BOOLEAN: r"^(true|false|0|1)$", XSD + "date": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$", XSD + "dateTime": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-4]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$", XSD + "time": r"^([01][0-9]|2[0-4]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"}
FORMS |= {d: r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$" for d in (FLOAT, DOUBLE)}
BOUNDS = {"byte": (-(1 << 7), (1 << 7) - 1), "short": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1), "unsignedByte": (0, (1 << 8) - 1), "unsignedShort": (0, (1 << 16) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedLong": (0, (1 << 64) - 1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1)}


def well_typed(v: Column, dt: Column) -> Column:
    """Whether a lexical form belongs to a datatype; datatypes not known here take all."""
    out = None
    for d, shape in FORMS.items():
        out = F.when(dt == d, v.rlike(shape)) if out is None else out.when(dt == d, v.rlike(shape))
    for name, (low, high) in BOUNDS.items():
        n = v.try_cast("decimal(38,0)")
        ok = v.rlike(FORMS[INTEGER])
        if low is not None:
            ok = ok & F.coalesce(n >= F.lit(str(low)).cast("decimal(38,0)"), F.lit(True))
        if high is not None:
            ok = ok & F.coalesce(n <= F.lit(str(high)).cast("decimal(38,0)"), F.lit(True))
        out = out.when(dt == XSD + name, ok)
    return out.otherwise(True)


def axioms(spark: SparkSession) -> DataFrame:
    """Triples that hold in every ontology; none of them counts as inferred."""
    rows = [(p, RDF + "type", OWL + "AnnotationProperty") for p in ANNOTATIONS] + [(OWL + c, RDF + "type", OWL + "Class") for c in ("Thing", "Nothing")] + [(d, RDF + "type", RDFS + "Datatype") for d in DATATYPES]
    return spark.createDataFrame(rows, "s string, p string, o string")


@dataclass
class Report:
    """inferred: quads that the rules add; its count; whether the caps cut the work; whether the data contradict themselves, and by which rules.

    predicates: those of the inferred quads if these are a plan over the tables, else None.
    """

    inferred: DataFrame
    inferred_triples: int
    timed_out: bool
    inconsistent: bool
    contradictions: list[str]
    rounds: int
    predicates: set[str] | None = None


def materialize(quads: DataFrame, mode: str = "forward", max_rounds: int = 64, max_seconds: float | None = None, seed_axioms: bool = False, resources: bool = False) -> Report:
    """Forward closure of the default graph's triples (mode off: nothing; hybrid: as forward)."""
    spark = quads.sparkSession
    blank = lambda df: df.select(F.lit(None).cast("string").alias("g"), "s", "p", decode(F.col("o")).alias("o"))
    base = cut(quads.where("g is null").select("s", "p", encode(F.col("o")).alias("o")).distinct())
    if mode == "off":
        return Report(blank(base.limit(0)), 0, False, False, [], 0)
    began = time.monotonic()
    start = base.unionByName(axioms(spark)).distinct() if seed_axioms else base
    rules = parse_rules(RULES)
    contradictions = parse_rules(CONTRADICTIONS)
    fresh = Vocabulary(start, rules + contradictions)
    known, members = start, None
    if RDF + "first" in fresh.predicates:
        members = lists(base)
        known = known.unionByName(member_triples(members))
    # the hierarchies first, by paths of doubling length, so that they cost a few rounds however deep they are
    for p in (RDFS + "subClassOf", RDFS + "subPropertyOf"):
        if p in fresh.predicates:
            try:
                pairs = closure(known.where(F.col("p") == p).select("s", "o"), rounds=max_rounds)
            except RuntimeError:  # the rounds below end early as well
                continue
            known = known.unionByName(pairs.select("s", F.lit(p).alias("p"), "o").join(known.where(F.col("p") == p), ["s", "p", "o"], "left_anti"))
            fresh.predicates[p] = pairs.count()
    known = cut(known)
    delta, rounds, late = known, 0, False
    if members is not None:
        fresh.predicates[MEMBER] = 1
    seen = fresh.copy()
    while True:
        if rounds >= max_rounds or max_seconds is not None and time.monotonic() - began > max_seconds:
            late = True
            break
        made = []
        for r in rules:
            if not all(seen.may(b) for b in r.body):
                continue
            for n, b in enumerate(r.body):
                if not fresh.may(b) or rounds == 0 and n:  # in the first round all is new, so once is enough
                    continue
                counts = [(fresh if k == n else seen).count(x) for k, x in enumerate(r.body)]
                got = _body([_match(delta if k == n else known, x) for k, x in enumerate(r.body)], r, counts)
                for h in r.head:
                    made.append(got.select(*[(F.col(f"`{x}`") if x[0] == "?" else F.lit(x)).alias(c) for c, x in zip(("s", "p", "o"), h)]))
        if members is not None:
            made += _list_rules(known, delta, members, seen)
        if fresh.numbers:
            made.append(literal_values(known, delta))
        if rounds and (RDF + "first" in fresh.predicates or RDF + "rest" in fresh.predicates):  # lists that the rules have made or lengthened
            members = lists(known)
            made.append(member_triples(members))
        if not made:
            break
        every = made[0]
        for m in made[1:]:
            every = every.union(m)
        # a literal is never a subject, and a predicate is an IRI
        every = every.where(~F.col("s").startswith('"') & ~F.col("p").startswith('"') & ~F.col("p").startswith("_:")).distinct()
        delta = cut(every.join(known, ["s", "p", "o"], "left_anti"))
        rounds += 1
        if delta.isEmpty():
            break
        known = cut(known.unionByName(delta))
        fresh = Vocabulary(delta, rules + contradictions)
        if members is not None:
            fresh.predicates[MEMBER] = 1
        seen.add(fresh)
    found = [r.name for r in contradictions if seen.may_all(r) and not _body([_match(known, b) for b in r.body], r, [seen.count(b) for b in r.body]).isEmpty()]
    if not ill_typed(known).isEmpty():
        found.append("dt-not-type")
    added = known.where(F.col("p") != MEMBER).join(start, ["s", "p", "o"], "left_anti")
    added = cut(added)
    n = added.count()
    if resources:  # rdfs4: everything is a resource; not counted
        nodes = known.where(F.col("p") != MEMBER).select("s").union(known.where((F.col("p") != MEMBER) & ~F.col("o").startswith('"')).select("o")).distinct()
        added = added.unionByName(nodes.select("s", F.lit(RDF + "type").alias("p"), F.lit(RDFS + "Resource").alias("o")).join(known, ["s", "p", "o"], "left_anti"))
    return Report(blank(added), n, late, bool(found), found, rounds)

