"""Parquet tables seen as RDF.

A TableMap is a lazy projection: subject template and key column, class, and a column for each
predicate.  Nothing is copied; the compiler reads just the columns and rows that a query needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import BOOL, DBL, DEC, INT, STR, WHEN, TERM, Type, Value, lit_type
from ..terms import LANG_STRING, XSD

NAMESPACE = "urn:tpch:"
#: Column, and number of the folders, by which a store keeps quads by predicate.
PART, PARTS = "part", 64


def part_of(p: Column) -> Column:
    """Folder of a predicate."""
    return F.pmod(F.xxhash64(p), F.lit(PARTS)).cast("int")


@dataclass
class TableMap:
    """One table as triples; `columns` gives each predicate's IRI its Value (columns of `df`)."""

    name: str
    df: DataFrame
    subject: Value
    cls: str | None = None
    columns: dict[str, Value] = field(default_factory=dict)
    graph: Value | None = None


@dataclass
class Dataset:
    """What a query reads: mapped tables, and quads (g, s, p, o) with `o` a term struct.

    predicates: the IRIs that the quads may use; None if unknown.
    """

    spark: SparkSession
    maps: list[TableMap] = field(default_factory=list)
    quads: DataFrame | None = None
    predicates: set[str] | None = None

    def with_quads(self, quads: DataFrame, predicates: set[str] | None = None) -> "Dataset":
        return Dataset(self.spark, self.maps, quads, predicates)

    def tenant(self, name: str) -> "Dataset":
        """Only the named graphs urn:tenant:<name> and those below it."""
        own = f"urn:tenant:{name}"
        quads = self.quads.where((F.col("g") == own) | F.col("g").startswith(own + ":")) if self.quads is not None else None
        return Dataset(self.spark, [], quads, self.predicates)


def native(col: Column, kind: str) -> Value:
    """Literal column of a Spark type, as the types of RDF have it."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return Value(col.cast("bigint"), INT)
    if kind == "boolean":
        return Value(col, BOOL)
    if kind == "float":
        return Value(col, lit_type(XSD + "float"))
    if kind == "double":
        return Value(col, DBL)
    if kind.startswith("decimal"):
        return Value(col.cast("decimal(38,18)"), DEC)
    if kind in ("timestamp", "timestamp_ntz"):
        return Value(col.cast("timestamp_ntz"), WHEN)
    if kind == "date":
        return Value(F.struct(F.lit("literal").alias("kind"), col.cast("string").alias("v"), F.lit(XSD + "date").alias("dt"), F.lit(None).cast("string").alias("lang")), TERM)
    if kind == "string":
        return Value(col, STR)
    return Value(F.to_json(F.struct(col.alias("value"))), STR)


def map_table(df: DataFrame, name: str, template: str, key, cls: str | None = None, links: dict[str, tuple[str, str]] | None = None, namespace: str = NAMESPACE, extra: dict[str, Value] | None = None, graph: Value | None = None) -> TableMap:
    """Map a table: links are foreign keys, column -> (predicate's local name, template of the objects); all else are literals.

    `key` is a column name, or a Column where no column is a key.
    """
    links = links or {}
    columns: dict[str, Value] = {}
    for c, kind in df.dtypes:
        if c in links:
            p, t = links[c]
            columns[namespace + p] = Value(F.col(c), Type("iri", t))
        else:
            columns[namespace + c] = native(F.col(c), kind)
    columns |= extra or {}
    subject = Value(F.col(key) if isinstance(key, str) else key, Type("iri", template), False)
    return TableMap(name, df, subject, cls, columns, graph)


def tagged(text: Column, lang: Column) -> Value:
    """Language-tagged string from two columns."""
    return Value(F.when(text.isNotNull() & lang.isNotNull(), F.struct(F.lit("literal").alias("kind"), text.alias("v"), F.lit(LANG_STRING).alias("dt"), F.lower(lang).alias("lang"))), TERM)


def star_tables(spark: SparkSession, sf_dir: str) -> Dataset:
    """The driver's tables under urn:tpch: (see the README for the mapping)."""
    ns = NAMESPACE
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    at = lambda n: ns + n + "/"
    line = read("lineitem")
    whole = F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in line.columns]))
    talk = read("conversations")
    turn = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    then = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("next_turn").cast("string"))
    after = talk.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("turn").alias("next_turn"))
    chain = talk.select("conv_id", "turn").join(after, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))).select("conv_id", "turn", "next_turn")
    docs = read("documents")
    regions = read("customer").join(read("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    customer_links = {"c_nationkey": ("c_nation", at("nation"))}
    by_region = map_table(regions, "customer_by_region", at("customer"), "c_custkey", ns + "Customer", customer_links, graph=Value(F.col("n_regionkey"), Type("iri", ns + "g/region-"), False))
    by_region.columns.pop(ns + "n_regionkey")
    return Dataset(
        spark,
        [
            map_table(read("region"), "region", at("region"), "r_regionkey", ns + "Region"),
            map_table(read("nation"), "nation", at("nation"), "n_nationkey", ns + "Nation", {"n_regionkey": ("n_region", at("region"))}),
            map_table(read("customer"), "customer", at("customer"), "c_custkey", ns + "Customer", customer_links),
            map_table(read("supplier"), "supplier", at("supplier"), "s_suppkey", ns + "Supplier", {"s_nationkey": ("s_nation", at("nation"))}),
            map_table(read("part"), "part", at("part"), "p_partkey", ns + "Part"),
            map_table(read("orders"), "orders", at("order"), "o_orderkey", ns + "Order", {"o_custkey": ("o_customer", at("customer"))}),
            map_table(line, "lineitem", at("lineitem"), whole, ns + "Lineitem", {"l_orderkey": ("l_order", at("order")), "l_partkey": ("l_part", at("part")), "l_suppkey": ("l_supplier", at("supplier"))}),
            map_table(read("events"), "events", at("event"), "event_id", ns + "Event", {"user_id": ("e_user", at("user"))}),
            _renamed(map_table(docs, "documents", at("document"), "doc_id", ns + "Document", extra={ns + "d_ltext": tagged(F.col("text"), F.col("lang"))}), {"lang": "d_lang", "text": "d_text", "source": "d_source"}),
            _only(map_table(read("labels"), "labels", at("document"), "doc_id"), "quality", "toxic"),
            map_table(read("pages"), "pages", at("page"), "page_id", ns + "Page", {"url": ("url", "")}),
            map_table(read("benchmark"), "benchmark", at("item"), "item_id", ns + "Item"),
            map_table(talk, "conversations", at("turn"), turn, ns + "Turn"),
            _only(map_table(chain, "next_turns", at("turn"), turn, extra={ns + "next": Value(then, Type("iri", at("turn")), False)}), "next"),
            by_region,
        ],
    )


def _renamed(m: TableMap, names: dict[str, str]) -> TableMap:
    for old, new in names.items():
        m.columns[NAMESPACE + new] = m.columns.pop(NAMESPACE + old)
    return m


def _only(m: TableMap, *names: str) -> TableMap:
    """A map beside another of its subjects gives its own predicates alone, so that no triple comes twice."""
    m.columns = {NAMESPACE + n: m.columns[NAMESPACE + n] for n in names}
    return m
