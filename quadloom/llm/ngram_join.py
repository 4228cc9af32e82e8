"""N-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets.

Rows and bands are chosen so that a pair at the threshold shares a band with at least the
target recall.  Texts that are equal, by 128 bits of hashes, are one node.  Band hashes are shuffled; nodes that share
one get an edge to the least node of that band, so a band held by very many nodes costs one
row each, not their pairs.  Components of those edges bring every pair that shares a band
together.  A component of up to BLOCK nodes is verified in one task; a larger one is cut into blocks, and each pair of
blocks is a task of its own with a bounded number of sets.  Where a component has more blocks than there are bands,
as chance bands may chain templated texts, its pairs are verified band by band instead: a band's nodes are a
task, or pairs of blocks, and a pair belongs to the first band that it shares; so a text goes to as many tasks as it
has bands, and to more only where one band itself is large.  Everywhere every pair that shares a band is verified on
both full sets; only link counts and a spanning forest of the links leave the task.

Defined results: null text is empty; texts without words link with nothing and
are a class each; texts of fewer words than an n-gram have one of all their words; very long texts are read whole; other equal
texts are copies of each other; rows that repeat doc_id are documents of their own, and a tie on it is broken by row key; a class is named by
its least doc_id (null if all are null); an empty table gives no rows; extra columns are ignored by `classes` and kept by `keep_one`, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bits, components, cut, find, named, row_key, shingles, small, text_of, unused

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 160
BLOCK = 256


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, and so fewest chance candidates, that reach `recall` in `most` hashes."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold < 1 else 1, 1)
    for rows in range(2, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Sketch:
    """Band hashes of a shingle set."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = bits(np.arange(1, bands + 1, dtype=np.uint64))

    def of(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, x.shape[1], 4096):
            low = np.minimum(low, (self.a * x[:, k : k + 4096] + self.b).min(axis=1))
        low = low.reshape(self.bands, self.rows)
        out = self.salt
        for j in range(self.rows):
            out = bits(out ^ low[:, j])
        return out.view(np.int64)


def same_text():
    """Two 64-bit hashes of column `text`; equal texts have equal ones, and others do not."""
    return F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")


def sketches(df: DataFrame, words: int, bands: int, rows: int, text_col: str, id_col: str) -> DataFrame:
    """Rows (doc, key, h, h2, bands array<long>, null without words)."""

    def run(batch):
        sk = Sketch(bands, rows)
        out = []
        for t in batch.column(4).to_pylist():
            s = shingles(t, words)
            out.append(sk.of(s) if len(s) else None)
        return {"doc": batch.column(0), "key": batch.column(1), "h": batch.column(2), "h2": batch.column(3), "bands": pa.array(out, pa.list_(pa.int64()))}

    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.select(named(id_col).alias("doc"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text")).select("doc", "key", *same_text(), "text")
    return arrow_map(keyed, run, f"doc {kind}, key long, h long, h2 long, bands array<long>")


def verify(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the (i, j) rows of `pairs` have Jaccard similarity of at least threshold."""
    sizes = np.array([len(s) for s in sets])
    if len(pairs) <= 8 * len(sets):
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    else:  # many pairs of few sets: products of slices of the membership matrix
        who = np.repeat(np.arange(len(sets)), sizes)
        _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = n[col] > 1
        renumber = np.cumsum(n > 1) - 1
        who, col = who[keep], renumber[col[keep]]
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        total = np.zeros((len(sets), len(sets)), np.float64)
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            a, b = np.searchsorted(col, [start, start + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[who[a:b], col[a:b] - start] = 1
            total += m @ m.T
        inter = total[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - inter
    return inter / np.maximum(union, 1) >= threshold


def _block_links(words: int, bands: int, rows: int, threshold: float):
    """Verifies one task's block pair, or its bucket of small groups; a group is a component or, `by_band`, what shares a band."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sk = Sketch(bands, rows)
        pdf = pdf.drop_duplicates(["grp", "node"]).sort_values(["grp", "node"], kind="stable")
        found = []
        for grp, part in pdf.groupby("grp", sort=False):
            if len(part) < 2:
                continue
            nodes, copies = part["node"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
            sets = [shingles(t, words) for t in part["text"]]
            sig = np.stack([sk.of(s) for s in sets])
            own = int(np.flatnonzero((sig == grp).all(axis=0))[0]) if part["by_band"].iloc[0] else None
            near = np.zeros((len(sets), len(sets)), bool)
            for k in range(bands if own is None else own):
                near |= sig[:, k][:, None] == sig[:, k][None, :]
            near = np.triu(near if own is None else ~near, 1)
            i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
            if i != j:  # each pair within one block is that block's own task
                side = part["chunk"].to_numpy() == i
                near &= side[:, None] != side[None, :]
            pairs = np.argwhere(near)
            pairs = pairs[verify(sets, pairs, threshold)] if len(pairs) else pairs
            if not len(pairs):
                continue
            count = np.zeros(len(sets), np.int64)
            np.add.at(count, pairs[:, 0], copies[pairs[:, 1]])
            np.add.at(count, pairs[:, 1], copies[pairs[:, 0]])
            parent: dict[int, int] = {}
            for a, b in pairs.tolist():
                a, b = find(parent, a), find(parent, b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            got = np.flatnonzero(count)
            found.append(pd.DataFrame({"node": nodes[got], "links": count[got], "root": [int(nodes[find(parent, x)]) for x in got.tolist()]}))
        return pd.concat(found) if found else pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")

    return links


def node_classes(df: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, most: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, nodes): rows (doc, key, h, h2, bare) of all documents; texts (h, h2, node, copies, bare, least) of all different texts; nodes (node, links, comp) of those with links.

    least: the least (doc, key) that holds the text.  most: nodes of a component that is verified by block pairs rather than by bands.
    """
    bands, rows = choose_bands(threshold, recall)
    most = block * bands if most is None else most
    # a node is named by the least number of the rows that hold its text
    sk = cut(sketches(df, words, bands, rows, text_col, id_col).withColumn("uid", F.monotonically_increasing_id()))
    every = sk.select("doc", "key", "h", "h2", "uid", F.col("bands").isNull().alias("bare"))
    texts = cut(every.groupBy("h", "h2", "bare").agg(F.min("uid").alias("node"), F.count("*").alias("copies"), F.min(F.struct("doc", "key")).alias("least")))
    reps = texts.where("not bare").select("node", "copies")
    banded = cut(sk.join(small(cut(reps.select(F.col("node").alias("uid")))), "uid", "left_semi").select(F.col("uid").alias("node"), F.explode("bands").alias("band")))
    shared = cut(banded.groupBy("band").agg(F.min("node").alias("home"), F.count("*").alias("n")).where("n > 1"))
    edges = banded.join(small(shared.select("band", "home")), "band").where("node <> home").select("node", "home").distinct()
    comp = components(edges)
    comp = comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct()).toDF("node", "comp")
    sizes = cut(comp.groupBy("comp").agg(F.count("*").alias("size")))
    comp = cut(comp.join(small(sizes), "comp"))
    whole = comp.where(F.col("size") <= most).select("node", F.col("comp").alias("grp"), "size", F.lit(False).alias("by_band"))
    split = cut(comp.where(F.col("size") > most).select("node"))
    split = banded.join(small(split), "node").join(small(shared.select("band", "n")), "band").select("node", F.col("band").alias("grp"), F.col("n").alias("size"), F.lit(True).alias("by_band"))
    groups = cut(whole.unionByName(split))
    n = groups.count()
    picked = cut(reps.join(small(groups), "node"))
    cand = cut(sk.select(F.col("uid").alias("node"), F.col("key").alias("__key"), F.col("h").alias("__h")).join(small(picked), "node"))
    text = df.select(row_key(id_col, text_col).alias("__key"), text_of(text_col).alias("text")).select("__key", F.xxhash64("text").alias("__h"), "text")
    full = text.join(small(cand), ["__key", "__h"])
    chunks = F.ceil(F.col("size") / block).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    full = full.withColumn("chunks", chunks).withColumn("chunk", F.when(F.col("chunks") > 1, chunk).otherwise(0))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    full = full.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    # small groups share tasks, a large one has its block pairs to itself
    buckets = max(1, n // block)
    task = F.when(F.col("chunks") > 1, F.xxhash64("grp", "i", "j")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    full = full.select(task.alias("task"), "node", "copies", "grp", "by_band", "chunk", "i", "j", "text")
    links = cut(full.groupBy("task", "by_band").applyInPandas(_block_links(words, bands, rows, threshold), "node long, links long, root long"))
    classes = components(links.select("node", "root"))
    classes = classes.unionByName(classes.select(F.col("component").alias("id"), "component").distinct())
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = counts.join(classes.withColumnRenamed("id", "node"), "node").select("node", "links", F.col("component").alias("comp"))
    return every, texts, cut(nodes)


def classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Rows (id_col, class_id, n_links long, kept boolean), one for each row of `df`.

    n_links counts the other documents at the threshold or above, copies included.
    """
    rows, texts, nodes = node_classes(df, text_col=text_col, id_col=id_col, **options)
    own = texts.where("not bare").join(small(nodes), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    class_of = own.groupBy("comp").agg(F.min("least.doc").alias("class_id"))
    own = cut(own.join(class_of, "comp").select("h", "h2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # texts without words hash alike, but are a class each
    out = rows.join(small(own), ["h", "h2"], "left").select(
        F.col("doc").alias(id_col),
        F.when(F.col("bare"), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("bare"), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )
    return out.withColumn("kept", named(id_col).eqNullSafe(F.col("class_id")))


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """`df` with one row of each class: the one of least (doc_id, row key); all columns kept.

    Rows that repeat both doc_id and text are one row of the result, any of them; texts without words stay.
    """
    rows, texts, nodes = node_classes(df, text_col=text_col, id_col=id_col, **options)
    own = texts.where("not bare").join(small(nodes), "node", "left").where("copies > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "node"))
    stays = own.groupBy("comp").agg(F.min("least").alias("stays"))
    own = cut(own.join(stays, "comp").select("h", "h2", "stays"))
    key, h = unused(df, "__key"), unused(df, "__h")
    met = rows.where("not bare").join(small(own), ["h", "h2"])
    gone = cut(met.where("not (key = stays.key and doc <=> stays.doc)").select(F.col("key").alias(key), F.col("h").alias(h)).distinct())
    twice = cut(met.groupBy(F.col("key").alias(key), F.col("h").alias(h)).agg(F.count("*").alias("n")).where("n > 1").select(key, h))
    keyed = df.select(*map(named, df.columns), row_key(id_col, text_col).alias(key), F.xxhash64(text_of(text_col)).alias(h)).join(small(gone), [key, h], "left_anti")
    if not twice.isEmpty():
        again = keyed.join(small(twice), [key, h], "left_semi").dropDuplicates([key, h])
        keyed = keyed.join(small(twice), [key, h], "left_anti").unionByName(again)
    return keyed.select(*map(named, df.columns))
