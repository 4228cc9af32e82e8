"""Inference over mapped tables without copying them: rows that the rules can't tell apart are reasoned about once.

A rule is local if all its patterns over instances are about one subject and share no object.  If the
rules that an ontology sets off are all local, what a row's subject is inferred to be follows from the cells that
the ontology's terms are about: which are bound, and which hold one of its terms.  One made-up subject stands for all
rows alike in that, the driver closes ontology and such subjects (`small`), and what it adds is read off the rows
by a broadcast join whenever a query asks for it.  Numbers written in several ways are joined in the same manner.
Anything else (other rules, subjects in several tables or in the quads, rows of a subject that differ, numbers among
the quads) is left to `materialize`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import BOOLEAN, DATETIME, DOUBLE, FLOAT, INTEGER, STRING, TERM, Value, iri_text, lexical_of, to_term
from ..lineage import cut
from ..sources.mapping import Dataset, TableMap
from ..terms import NUMERICS, OWL, RDF, XSD
from .reasoner import BOUNDS, CONTRADICTIONS, FEW, FORMS, RULES, Report, decode, encode, ill_typed, literal_number, parse_rules, well_typed
from .small import TooMuch, close

#: Quads of an ontology, and kinds of rows, up to which it is tried.
MOST = 10_000
#: Made-up subjects, and objects that stand for any other value of a cell.
ROW, SOME = "urn:quadloom:row:", "urn:quadloom:some:"
TYPE = RDF + "type"


@dataclass
class Rows:
    """A table's subjects as `s`, the cells that matter to an ontology as encoded columns `names`, and numbers as their own columns."""

    table: TableMap
    df: DataFrame
    names: dict[str, str]
    numbers: dict[str, tuple[str, Value]]

    def key(self) -> Column:
        """One string for each kind of row."""
        return F.concat_ws("\x01", F.lit(""), *[F.coalesce(F.col(c), F.lit("\x02")) for c in self.names.values()])


def _rows(m: TableMap, terms: list[str]) -> Rows:
    names, numbers, cols = {}, {}, {"s": iri_text(m.subject)}
    for k, (p, x) in enumerate(m.columns.items()):
        if p in terms:
            names[p] = f"c{k}"
            text = encode(to_term(x))
            cols[f"c{k}"] = F.when(text.isin(terms), text).otherwise(F.when(text.isNotNull(), F.lit(SOME + p)))
        if x.numeric:
            numbers[p] = (f"n{k}", Value(F.col(f"n{k}"), x.type))
            cols[f"n{k}"] = x.col
    return Rows(m, m.df.select(*[c.alias(n) for n, c in cols.items()]), names, numbers)


def _number(x: Value) -> Column:
    """The value by which numbers are compared."""
    return literal_number(encode(to_term(x))) if x.type.detail == FLOAT else x.col.cast("double")


def _text_hash(x: Value, n: Column) -> Column:
    """The same for cells of one text only; a datatype writes a value in one way, but for zeros."""
    return F.when(n == 0, F.xxhash64(encode(to_term(x)))).otherwise(F.xxhash64(F.lit(x.type.detail), x.col))


def _once(rows: Rows) -> Rows | None:
    """The rows with each subject once; None if rows of a subject differ."""
    df = rows.df.where("s is not null")
    h = F.xxhash64("s")
    several = cut(df.groupBy(h.alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"))
    n = several.count()
    if n == 0:
        return Rows(rows.table, df, rows.names, rows.numbers)
    if n > FEW:
        again, df = df.distinct(), None
    else:
        keyed, several = df.withColumn("h", h), F.broadcast(several)
        again, df = keyed.join(several, "h", "left_semi").drop("h").distinct(), keyed.join(several, "h", "left_anti").drop("h")
    if not again.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    return Rows(rows.table, again if df is None else df.unionByName(again), rows.names, rows.numbers)


def _forms(tables: list[Rows]) -> tuple[DataFrame, dict[tuple[int, str], int]] | None:
    """Numbers written in several ways: rows (n, other), each way encoded, and how many triples each column gets of them; None if there are none."""
    cells = [(k, p, r.df.select(_number(x).alias("n"), x.col.alias("x")).where("n is not null"), Value(F.col("x"), x.type)) for k, r in enumerate(tables) for p, (_, x) in r.numbers.items()]
    if not cells:
        return None
    hashed = reduce(DataFrame.union, [df.select("n", _text_hash(x, F.col("n")).alias("h")) for _, _, df, x in cells])
    several = cut(hashed.groupBy("n").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("n"))
    few = several.count()
    if few == 0:
        return None
    some = F.broadcast(several) if few <= FEW else several
    written = []
    for k, p, df, x in cells:  # by value first, so that few are written out; zeros by text, as values don't tell them apart
        text = encode(to_term(x))
        kept = df.join(some, "n", "left_semi").groupBy("n", "x", F.when(F.col("n") == 0, text).alias("zero")).agg(F.count("*").alias("many"))
        written.append(kept.select(F.lit(k).alias("table"), F.lit(p).alias("p"), "n", F.coalesce("zero", text).alias("other"), "many"))
    counts = cut(reduce(DataFrame.union, written))
    forms = cut(counts.select("n", "other").distinct())
    ways = forms.groupBy("n").agg((F.count("*") - 1).alias("ways"))
    return forms, {(r["table"], r["p"]): r["many"] for r in counts.join(ways, "n").groupBy("table", "p").agg(F.sum(F.col("many") * F.col("ways")).alias("many")).collect()}


def _ill_typed(m: TableMap) -> bool:
    """dt-not-type among a table's cells; native integers, floating numbers, booleans and strings are always written well."""
    for x in m.columns.values():
        if x.type == TERM:
            bad = m.df.where(x.col["kind"] == "literal").where(~well_typed(x.col["v"], x.col["dt"]))
        elif x.type.kind == "lit" and x.type.detail not in (INTEGER, DOUBLE, FLOAT, BOOLEAN, STRING):
            bad = m.df
            if x.type.detail == DATETIME:  # with years of four digits they are too
                bad = bad.where(~x.col.between(F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")))
            bad = bad.where(~well_typed(lexical_of(x.col, x.type.detail), F.lit(x.type.detail)))
        else:
            continue
        if not bad.isEmpty():
            return True
    return False


def materialize_rows(data: Dataset, **options) -> Report | None:
    """As `materialize` for the default graph of `data`, with the inferred triples left a plan over the tables; None if that can't be done."""
    tables = [m for m in data.maps if m.graph is None]
    if options or not tables or data.quads is None:
        return None
    own = cut(data.quads.where("g is null").select("g", "s", "p", "o").limit(MOST + 1))
    quads = own.collect()
    rules, contradictions = parse_rules(RULES), parse_rules(CONTRADICTIONS)
    words = {x for r in rules + contradictions for b in r.body for x in b if ":" in x} | {OWL + "hasKey", OWL + "propertyChainAxiom", RDF + "first", RDF + "rest"}
    starts = [m.subject.type.detail for m in tables]
    if len(quads) > MOST or any(q["o"]["dt"] in NUMERICS for q in quads):
        return None
    if any(m.subject.type.kind != "iri" or words & {*m.columns, m.cls} for m in tables):
        return None
    if any(x.type == TERM and not m.df.where(x.col["dt"].isin(*NUMERICS)).isEmpty() for m in tables for x in m.columns.values()):
        return None
    if any(not a or a.startswith(('"', "_:")) or n != k and a.startswith(b) for n, a in enumerate(starts) for k, b in enumerate(starts)):
        return None
    terms = sorted({t for r in own.select(F.array("s", encode(F.col("o"))).alias("t")).collect() for t in r["t"]})
    if any("\x01" in t or "\x02" in t for t in terms):
        return None
    every = [_rows(m, terms) for m in tables]
    for r, start in zip(every, starts):
        mine = [t for t in terms if t.startswith(start)]
        if mine and not r.df.where(F.col("s").isin(mine)).isEmpty():
            return None

    # one subject for each kind of row; how many rows are of it
    kinds: dict[str, tuple[int, str, int]] = {}
    made = []
    tables_once = []
    for n, r in enumerate(every):
        r = _once(r)
        if r is None:
            return None
        tables_once.append(r)
        cells = list(r.names.items())
        found = r.df.groupBy(r.key().alias("key"), *r.names.values()).agg(F.count("*").alias("n")).limit(MOST + 1).collect()
        if len(kinds) + len(found) > MOST:
            return None
        for row in found:
            s = f"{ROW}{len(kinds)}"
            kinds[s] = (n, row["key"], row["n"])
            made += [(s, p, row[c]) for p, c in cells if row[c] is not None] + ([(s, TYPE, r.table.cls)] if r.table.cls else [])
    spark = data.spark
    encoded = [(r["s"], r["p"], r["o"]) for r in own.select("s", "p", encode(F.col("o")).alias("o")).collect()]
    try:
        added, found, rounds = close(encoded + made, rules, contradictions)
    except TooMuch:
        return None
    templates: dict[tuple[int, str], list] = {}
    total, rest = 0, []
    for s, p, o in added:
        if not s.startswith(ROW):
            rest.append((s, p, o))
            total += 1
            continue
        if p in words - {TYPE} or o.startswith(SOME) or p == TYPE and o in words - {OWL + "Thing", OWL + "Nothing"}:
            return None
        n, key, many = kinds[s]
        templates.setdefault((n, p), []).append((key, o))
        total += many
    predicates = {p for _, p, _ in rest}
    parts = [spark.createDataFrame(rest, "s string, p string, o string").select(F.lit(None).cast("string").alias("g"), "s", "p", decode(F.col("o")).alias("o"))]
    none = F.lit(None).cast("string").alias("g")
    for (n, p), rows in templates.items():
        r = tables_once[n]
        have = spark.createDataFrame(rows, "key string, o string").select("key", decode(F.col("o")).alias("o"))
        parts.append(r.df.select("s", r.key().alias("key")).join(F.broadcast(have), "key").select(none, "s", F.lit(p).alias("p"), "o"))
        predicates.add(p)
    written = _forms(tables_once)
    if written is not None:
        forms, counts = written
        forms = F.broadcast(forms) if forms.count() <= FEW else forms
        for (k, p), many in counts.items():
            if many:
                r = tables_once[k]
                c, x = r.numbers[p]
                other = r.df.select("s", c, _number(x).alias("n")).join(forms, "n").where(F.col("other") != encode(to_term(x)))
                parts.append(other.select(none, "s", F.lit(p).alias("p"), decode(F.col("other")).alias("o")))
                predicates.add(p)
                total += many
    typed = any(q["o"]["dt"] in FORMS or (q["o"]["dt"] or "").removeprefix(XSD) in BOUNDS for q in quads)
    if typed and not ill_typed(own.select(encode(F.col("o")).alias("o"))).isEmpty() or any(_ill_typed(m) for m in tables):
        found.append("dt-not-type")
    return Report(reduce(DataFrame.unionByName, parts), total, False, bool(found), found, rounds, predicates)
