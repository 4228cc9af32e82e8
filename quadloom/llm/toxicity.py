"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-cased words of a text and the leading letters of each word (prefixes of
PREFIXES letters), so inflected forms of a word meet.  From the labelled rows a bounded sample
of examples is drawn by hash (MAX_EXAMPLES a label, a documented parameter).  All terms of the examples are tested
against the label; those that depend on it beyond chance (chi-square above CHI, in MIN_COUNT examples at least) span
the space of the cosine, however many they are.  Weights in it are 1 + log of a term's count by its inverse document frequency, and
document frequencies are counted over all documents.

The examples' vectors form an inverted index in blocks: each term's postings are
cut into blocks of BLOCK examples, and each block keeps the largest weight in it.  A query bounds
every block by those, visits blocks from the largest bound down, and stops where no bound reaches
the k-th score found; the k nearest are exact, ties to the smaller example number.  Votes weigh by similarity over
distance, and a prior of the sample's own base rate smooths them.  The share of toxic votes is calibrated on the
examples themselves, each scored without itself, by a monotone step function fitted to their labels.

Why the space is tested for: over all terms, nearest neighbours by cosine are neighbours by topic (README has the figures).

Only the bounded sample's vectors over the tested terms reach the driver.  Every document is scored on its whole text.

Defined results: null text is empty; a text without any of the terms, empty ones too, gets the calibrated
rate of such texts; very long texts are read whole; without labelled rows of both kinds every score is the base rate (0.0 with
no labelled row at all); labels that are null or neither 0 nor 1 teach nothing, and of an id with both 1 holds; of an id that
documents repeat, the least text is the example; rows that repeat doc_id are scored each; an empty table gives no rows; extra
columns are ignored by `score` and kept by `reject`, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, map_columns, named, remember, text_of

MAX_EXAMPLES = 2000
PREFIXES = (4, 5, 6)
#: Least chi-square (one in 16,000 by chance) and least number of examples of a term.
CHI = 16.0
MIN_COUNT = 4
BLOCK = 64
K = 15
#: Share of the vote that the base rate has beside the neighbours' similarities.
PRIOR = 0.5

WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> list[str]:
    """Terms of one lower-cased word: itself and its leading letters."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


class Vocabulary(dict):
    """word -> numbers of its terms in the space; filled as words come that begin as some term does, and bounded."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms
        self.heads = {t[: min(PREFIXES)] for t in terms}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = tuple([self.terms[t] for t in forms(word) if t in self.terms])
        return got

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's terms, and how often each is there."""
        got: dict[int, int] = {}
        heads, size = self.heads, min(PREFIXES)
        for w, c in Counter([w for w in WORD.findall(text.lower()) if w[:size] in heads]).items():
            for i in self[w]:
                got[i] = got.get(i, 0) + c
        return np.fromiter(got, np.int64, len(got)), np.fromiter(got.values(), np.int64, len(got))

    def __reduce__(self):
        return Vocabulary, (self.terms,)


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length."""
    w = (1.0 + np.log(counts)) * idf
    norm = np.sqrt((w * w).sum())
    return w / norm if norm > 0 else w


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], terms: dict[str, int], idf: np.ndarray, stands: tuple[float, float] = (1.0, 1.0), ids: list | None = None, k: int = K):
        """vectors: terms' numbers and counts of each example; stands: how many labelled rows an example of label 0 and of label 1 stands for."""
        self.k, self.n, self.ids = k, len(vectors), ids if ids is not None else list(range(len(vectors)))
        y = np.array(labels, bool)
        self.weight = np.where(y, stands[1], stands[0])
        self.base = float(self.weight[y].sum() / self.weight.sum()) if self.n else 0.0
        self.terms, self.idf, self.labels = terms, idf, y
        self.words = Vocabulary(terms)
        self.post: list[tuple] = []
        self.empty = self.base
        self.steps = (np.array([0.0]), np.array([self.base]))
        if not self.n or y.all() or not y.any():
            self.terms = {}
            return
        rows: list[list[tuple[int, float]]] = [[] for _ in terms]
        weighed = [(i, weights(c, idf[i])) for i, c in vectors]
        for d, (ids_, w) in enumerate(weighed):
            for i, x in zip(ids_.tolist(), w.tolist()):
                rows[i].append((d, x))
        for r in rows:
            docs, w = np.array([d for d, _ in r], np.int64), np.array([x for _, x in r])
            cuts = np.flatnonzero(np.diff(docs // BLOCK)) + 1
            starts = np.concatenate([[0], cuts]).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
            top = (docs[starts] // BLOCK, np.maximum.reduceat(w, starts)) if len(docs) else (docs, w)
            self.post.append((docs // BLOCK, docs % BLOCK, w, *top))
        self.blocks = -(-self.n // BLOCK)
        shares, at, none = [], [], []
        for d, (ids_, w) in enumerate(weighed):
            if len(ids_):
                shares.append(self.share(*self.nearest(ids_, w, without=d)))
                at.append(d)
            else:
                none.append(d)
        self.empty = float(((self.weight[none] * y[none]).sum() + self.base) / (self.weight[none].sum() + 1))
        self.steps = isotonic(np.array(shares), y[at].astype(float), self.weight[at])

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit-length weights of a text's terms."""
        ids, counts = self.words.counts(text)
        return ids, weights(counts, self.idf[ids]) if len(ids) else np.zeros(0)

    def nearest(self, ids: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, exactly; fewer if fewer share a term."""
        bound = np.zeros(self.blocks)
        post = [self.post[i] for i in ids.tolist()]
        for x, (_, _, _, blk, top) in zip(w.tolist(), post):
            bound[blk] += x * top  # a term's blocks are distinct
        k = self.k + (without >= 0)
        best_d, best_s, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        order = np.argsort(-bound, kind="stable")
        # blocks in bound order, in growing runs; ends when no block left can reach the k-th score
        at, run = 0, 4
        while at < self.blocks and bound[order[at]] > 0 and (len(best_s) < k or bound[order[at]] >= floor - 1e-12):
            part = order[at : at + run]
            at, run = at + run, run * 2
            slot = np.full(self.blocks, -1, np.int64)
            slot[part] = np.arange(len(part))
            score = np.zeros(len(part) * BLOCK)
            for x, (blocks, places, weights_, _, _) in zip(w.tolist(), post):
                s = slot[blocks]
                hit = s >= 0
                score[s[hit] * BLOCK + places[hit]] += x * weights_[hit]
            got = np.flatnonzero(score > 0)
            d = part[got // BLOCK] * BLOCK + got % BLOCK
            best_d, best_s = np.concatenate([best_d, d]), np.concatenate([best_s, score[got]])
            keep = np.lexsort((best_d, -best_s))[:k]
            best_d, best_s = best_d[keep], best_s[keep]
            floor = best_s[-1] if len(best_s) == k else 0.0
        if without >= 0:
            mine = best_d != without
            best_d, best_s = best_d[mine][: self.k], best_s[mine][: self.k]
        return best_d, np.minimum(best_s, 1.0)

    def share(self, docs: np.ndarray, sims: np.ndarray) -> float:
        """Toxic share of the votes; a vote weighs its example's similarity over its distance."""
        v = self.weight[docs] * sims / (1.05 - sims)
        return float((v[self.labels[docs]].sum() + PRIOR * self.base) / (v.sum() + PRIOR))

    def score(self, text: str) -> tuple[float, list, list[float]]:
        """Calibrated score and its evidence: examples' ids and cosines."""
        if not self.terms:
            return (self.empty if self.n else self.base), [], []
        ids, w = self.vector(text)
        if not len(ids):
            return self.empty, [], []
        docs, sims = self.nearest(ids, w)
        x, y = self.steps
        return float(np.interp(self.share(docs, sims), x, y)), [self.ids[d] for d in docs.tolist()], sims.tolist()


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone function of x that fits y best (pool adjacent violators)."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean of y, weight, mean of x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([b, c, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b2, n2, a2 = pools.pop()
            b1, n1, a1 = pools[-1]
            n = n1 + n2
            pools[-1] = [(b1 * n1 + b2 * n2) / n, n, (a1 * n1 + a2 * n2) / n]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of doc_id as text divides by five."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 5 == 0, F.lit(False))


def drawn(documents: DataFrame, labels: DataFrame, max_examples: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(rows (id, text, y), labelled rows by label): at most max_examples of each label, in hash order."""
    marked = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("id"))
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    many = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # the sample is drawn from ids alone, then only its texts are fetched, one an id
    draw = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_examples)
        draw = part if draw is None else draw.unionAll(part)
    texts = documents.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    return cut(texts.join(F.broadcast(draw), "id").groupBy("id", "y").agg(F.min("text").alias("text"))), many


def tested_terms(examples: DataFrame, zeros: int, ones: int) -> list[str]:
    """Terms of the examples that depend on the label."""

    def run(batch):
        terms, ys = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {f for w in set(WORD.findall(t.lower())) for f in forms(w)}
            terms += own
            ys += [y] * len(own)
        return {"term": pa.array(terms, pa.string()), "y": pa.array(ys, pa.int64())}

    n, pos, c, a = float(zeros + ones), float(ones), F.col("c").cast("double"), F.col("a").cast("double")
    chi = n * F.pow(a * (n - pos - c + a) - (c - a) * (pos - a), F.lit(2.0)) / (pos * (n - pos) * c * (n - c))
    seen = arrow_map(examples.select("text", "y"), run, "term string, y long").groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("a"))
    return sorted(r["term"] for r in seen.where((c >= MIN_COUNT) & (c < n)).where(chi > CHI).select("term").collect())


def train(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Index of a bounded sample of labelled rows, with document frequencies of all documents."""
    examples, many = drawn(documents, labels, max_examples, id_col, text_col, label_col)
    have = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    zeros, ones = have.get(0, 0), have.get(1, 0)
    stands = (many.get(0, 0) / max(1, zeros), many.get(1, 0) / max(1, ones))
    if not zeros or not ones:
        return Index([(np.zeros(0, np.int64),) * 2] * (zeros + ones), [0] * zeros + [1] * ones, {}, np.zeros(0), stands)
    vocabulary = Vocabulary({t: i for i, t in enumerate(tested_terms(examples, zeros, ones))})

    def frequencies(batch):
        remember(vocabulary)
        total = np.zeros(len(vocabulary.terms) + 1, np.int64)
        for t in batch.column(0).to_pylist():
            total[vocabulary.counts(t)[0]] += 1
        total[-1] = batch.num_rows
        at = np.flatnonzero(total)
        return {"term": pa.array(at), "n": pa.array(total[at])}

    def vectors(batch):
        remember(vocabulary)
        got = [vocabulary.counts(t) for t in batch.column(2).to_pylist()]
        return {"id": batch.column(0), "y": batch.column(1), "terms": pa.array([x.tolist() for x, _ in got], pa.list_(pa.int64())), "counts": pa.array([c.tolist() for _, c in got], pa.list_(pa.int64()))}

    found = arrow_map(documents.select(text_of(text_col).alias("text")), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.ones(len(vocabulary.terms) + 1)
    for r in found:
        n[r["term"]] = r["n"]
    kind = examples.schema["id"].dataType.simpleString()
    rows = arrow_map(examples.select("id", "y", "text"), vectors, f"id {kind}, y int, terms array<long>, counts array<long>").orderBy(F.xxhash64("id"), "id").collect()
    idf = 1.0 + np.log(n[-1] / n[:-1])
    return Index([(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in rows], [r["y"] for r in rows], vocabulary.terms, idf, stands, [r["id"] for r in rows])


def score(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score, predicted, neighbours array of ids, similarities array<double>)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(documents, labels, max_examples, id_col, text_col))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batch):
        index = shared.value
        remember(index.words)
        out = [index.score(t) for t in batch.column(1).to_pylist()]
        s = [x[0] for x in out]
        return {
            id_col: batch.column(0),
            "score": pa.array(s, pa.float64()),
            "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32()),
            "neighbours": pa.array([x[1] for x in out], pa.list_(batch.column(0).type)),
            "similarities": pa.array([x[2] for x in out], pa.list_(pa.float64())),
        }

    return arrow_map(documents.select(named(id_col), text_of(text_col).alias("_text")), run, f"`{id_col}` {kind}, score double, predicted int, neighbours array<{kind}>, similarities array<double>")


def reject(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns kept, whose score is below `threshold`."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(documents, labels, max_examples, id_col, text_col))
    at = documents.columns.index(text_col)

    def run(cols, _):
        index = shared.value
        remember(index.words)
        stay = pa.array([index.score(t or "")[0] < threshold for t in cols[at].to_pylist()], pa.bool_())
        return [c.filter(stay) for c in cols]

    return map_columns(documents, documents.columns, [], run)
