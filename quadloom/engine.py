"""Entry points: query, ask, explain."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import iri_text, to_term
from .lineage import cut
from .operators.reasoner import Report, materialize
from .operators.rowwise import materialize_rows
from .operators.shacl import validate
from .plans import compiler
from .plans.parser import Query, parse_query
from .sources.mapping import Dataset, star_tables
from .terms import Var


MANY_PREDICATES = 100_000


@dataclass
class Engine:
    """Queries over one dataset."""

    data: Dataset
    prefixes: dict[str, str] = field(default_factory=dict)

    def query(self, text: str) -> DataFrame:
        """Result of a SELECT, ASK, CONSTRUCT or DESCRIBE query, not yet run."""
        return compiler.run_query(self.parse(text), self.data)

    def parse(self, text: str) -> Query:
        return parse_query(text, self.prefixes)

    def collect(self, text: str, timeout_ms: int | None = None) -> tuple[list, bool]:
        """(rows, timed out): the result's rows, or none if the time is up first; its Spark jobs are then cancelled."""
        if timeout_ms is None:
            return self.query(text).collect(), False
        if timeout_ms <= 0:
            return [], True
        sc = self.data.spark.sparkContext
        tag = f"quadloom-{uuid.uuid4()}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout_ms / 1000, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            rows = self.query(text).collect()
            return ([], True) if late.is_set() else (rows, False)
        except Exception:
            if late.is_set():
                return [], True
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def ask(self, text: str) -> bool:
        return self.query(text).first()[0]

    def infer(self, **options) -> tuple["Engine", Report]:
        """An engine that also sees what the rules derive, and the reasoner's report."""
        report = materialize_rows(self.data, **options) or materialize(as_quads(self.data), **options)
        own, inferred, predicates = self.data.quads, report.inferred, report.predicates
        if predicates is None:
            inferred = cut(inferred)
            # which predicates there are saves scans; of too many nothing is claimed, and the quads are always read
            names = [r["p"] for r in inferred.select("p").distinct().limit(MANY_PREDICATES + 1).collect()]
            predicates = set(names) if len(names) <= MANY_PREDICATES else None
        if own is not None:
            own = own.select("g", "s", "p", "o").distinct()  # what is inferred is distinct, and none of it known
            inferred, predicates = own.unionByName(inferred), None if self.data.predicates is None or predicates is None else predicates | self.data.predicates
        return Engine(self.data.with_quads(inferred, predicates), self.prefixes), report

    def validate(self, shapes: DataFrame) -> tuple[bool, DataFrame]:
        """SHACL: whether the data conform to a shapes graph, and the results."""
        return validate(self.data, shapes)

    def explain(self, text: str) -> str:
        """The algebra, an estimate for each triple pattern, and the plan that Spark makes of it with its cost figures."""
        q = self.parse(text)
        df = compiler.run_query(q, self.data)
        costs = "\n".join(f"{t}: about {rows} rows, {size} bytes" for t, rows, size in self.estimates(q))
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
        return f"== Algebra ==\n{outline(q.pattern)}\n== Patterns ==\n{costs}\n{plan}"

    def estimates(self, q: Query) -> list[tuple[str, int, int]]:
        """(pattern, rows, bytes) of each triple pattern by itself, as Spark's statistics of its plan have it."""
        c = compiler.Compiler(self.data, q.base, q.froms, q.named)
        out = []
        for graph, t in triples(q.pattern):
            df = c.pattern(("bgp", [t]), graph).df
            plan = df._jdf.queryExecution().optimizedPlan()
            size = int(str(plan.stats().sizeInBytes()))
            row = 8 + sum(f.dataType().defaultSize() for f in plan.schema().fields())
            rows = plan.stats().rowCount()
            out.append((" ".join(map(str, t)), int(str(rows.get())) if rows.isDefined() else max(1, size // row), size))
        return out


def as_quads(data: Dataset) -> DataFrame:
    """Default graph of a dataset as quads, mapped tables included."""
    f = compiler.Compiler(data).any_predicate(Var("s"), Var("p"), Var("o"), None)
    return f.df.select(F.lit(None).cast("string").alias("g"), iri_text(f.scope["s"]).alias("s"), iri_text(f.scope["p"]).alias("p"), to_term(f.scope["o"]).alias("o"))


def triples(p, graph=None) -> list[tuple[object, tuple]]:
    """(graph, triple pattern) of all triple patterns in a pattern."""
    if p[0] == "bgp":
        return [(graph, t) for t in p[1]]
    if p[0] == "graph":
        return triples(p[2], p[1])
    if p[0] == "select":
        return triples(p[1].pattern, graph)
    inner = [x for x in p[1:] if isinstance(x, tuple) and x and x[0] in PATTERNS]
    return [t for x in inner for t in triples(x, graph)]


PATTERNS = ("unit", "bgp", "join", "optional", "union", "minus", "filter", "extend", "values", "graph", "select")


def outline(p, depth: int = 0) -> str:
    """A pattern as an indented tree."""
    pad = "  " * depth
    if p[0] == "bgp":
        return "\n".join([f"{pad}bgp", *[f"{pad}  {s} {o} {t}" for s, o, t in p[1]]])
    inner = [x for x in p[1:] if isinstance(x, tuple) and x and x[0] in PATTERNS]
    own = [str(x) for x in p[1:] if x not in inner and not isinstance(x, Query)]
    lines = [f"{pad}{p[0]} {' '.join(own)}".rstrip()]
    if p[0] == "select":
        inner = [p[1].pattern]
    return "\n".join(lines + [outline(x, depth + 1) for x in inner])


_datasets: dict[tuple[str, str], Dataset] = {}


def tables_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Engine over the driver's tables, prefix t:; the mapping (schemas, no rows) is made once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _datasets:
        _datasets[key] = star_tables(spark, sf_dir)
    return Engine(_datasets[key], {"t": "urn:tpch:"})
