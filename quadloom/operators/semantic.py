"""Semantic top-k over terms and vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import STRING
from ..lineage import cut

DIMENSION = 256
#: Most terms that an index takes.
CAPACITY = 100_000
WORD = re.compile(r"[^\W_]+")


def fnv1a(data: bytes) -> int:
    """The public 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def embed(text: str, dim: int = DIMENSION) -> np.ndarray:
    """Feature-hash embedding: words and letter trigrams, signed buckets, unit length."""
    v = np.zeros(dim, np.float32)
    for w in WORD.findall(text.lower()):
        for f in (f"t:{w}", *(f"g:{w[k : k + 3]}" for k in range(len(w) - 2))):
            h = fnv1a(f.encode())
            v[h % dim] += 1.0 if h & 1 else -1.0
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / np.float32(n) if n else v


def embedding(c: Column, dim: int = DIMENSION) -> Column:
    """Embedding of a string column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        known: dict = {}
        return s.map(lambda t: known[t] if t in known else known.setdefault(t, embed(t or "", dim).tolist()))

    return run(c)


def term_text(t: Column) -> Column:
    """What a term is searched by: an IRI's text, a literal with its language or datatype, lower-cased."""
    tail = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["dt"] == STRING, F.lit("")).otherwise(F.concat(F.lit("^^"), t["dt"]))
    return F.lower(F.when(t["kind"] == "literal", F.concat(t["v"], tail)).otherwise(t["v"]))


def terms_of(quads: DataFrame) -> DataFrame:
    """Distinct terms (texts) of subjects, predicates and objects."""
    return quads.select(F.lower("s").alias("term")).union(quads.select(F.lower("p"))).union(quads.select(term_text(F.col("o")))).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(df: DataFrame, vector_col: str, query: list[float], k: int, id_col: str) -> DataFrame:
    """The k (held to 1..100) rows of highest cosine to a vector: (id_col, score), ties to the smaller id."""
    k = min(max(int(k), 1), 100)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, cosine(F.col(vector_col), q).alias("score")).where("score is not null").orderBy(F.col("score").desc(), id_col).limit(k)


class Index:
    """Embedded terms; an immutable DataFrame (term, vec) that upsert and remove replace."""

    def __init__(self, spark, dim: int = DIMENSION, capacity: int = CAPACITY, rows: DataFrame | None = None):
        self.spark, self.dim, self.capacity = spark, dim, capacity
        self.rows = rows if rows is not None else spark.createDataFrame([], "term string, vec array<float>")

    def upsert(self, terms: DataFrame) -> int:
        """Add terms (column term) that aren't there yet; an error beyond the capacity.  The number of terms."""
        new = terms.select("term").where("term is not null").distinct().join(self.rows, "term", "left_anti")
        rows = cut(self.rows.unionByName(new.select("term", embedding(F.col("term"), self.dim).alias("vec"))))
        n = rows.count()
        if n > self.capacity:
            raise ValueError(f"the index takes {self.capacity} terms at most")
        self.rows = rows
        return n

    def remove(self, terms: DataFrame) -> None:
        self.rows = cut(self.rows.join(terms.select("term").distinct(), "term", "left_anti"))

    def contains(self, term: str) -> bool:
        return not self.rows.where(F.col("term") == term.lower()).isEmpty()

    def reconcile(self, quads: DataFrame) -> None:
        """Make the index hold just the terms of these quads."""
        now = cut(terms_of(quads))
        self.rows = self.rows.join(now, "term", "left_semi")
        self.upsert(now)

    def search(self, text: str, k: int = 10) -> DataFrame:
        return top_k(self.rows, "vec", embed(text, self.dim).tolist(), k, "term")

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, dim: int = DIMENSION) -> "Index":
        return cls(spark, dim, rows=spark.read.parquet(path))


def semantic_retrieval(index: Index, q: str, k: str = "10") -> list[dict]:
    """Tool call with string arguments: hits as dicts, or ValueError with a stable text."""
    if not q or not q.strip():
        raise ValueError("semantic_retrieval: q must not be empty")
    if not re.fullmatch(r"[0-9]+", k):
        raise ValueError("semantic_retrieval: k must be a whole number")
    return [{"term": r["term"], "score": r["score"]} for r in index.search(q, int(k)).collect()]
