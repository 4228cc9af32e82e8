"""What several operators of this folder share: intermediate tables, row keys, look-up stores and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Bytes that one side of a join may have, in the size of its numbers, to be sent to every executor.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Only in local mode, where there is one machine, a folder of our own stands in if that is unset.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="quadloom-")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


#: How intermediate files are written where the shared folder is a local one; other file systems ignore it.  Hadoop's usual class for local files
#: starts a `chmod` for each file and once more for its check sums, and a process just started shares, and counts with, all of the executor's memory.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_plain: list[dict] = []  # one entry for each checkpoint being made, the same for all: the settings before the first
_plain_lock = threading.Lock()


@contextlib.contextmanager
def plain_files(spark: SparkSession):
    """Within it, PLAIN_FILES hold for the session's Hadoop settings, since a checkpoint takes no options; local files read meanwhile go without check sums too."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    with _plain_lock:
        _plain.append(_plain[0] if _plain else {k: conf.get(k) for k in PLAIN_FILES})
        for k, v in PLAIN_FILES.items():
            conf.set(k, v)
    try:
        yield
    finally:
        with _plain_lock:
            before = _plain.pop()
            for k, v in before.items() if not _plain else ():
                conf.unset(k) if v is None else conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    with plain_files(df.sparkSession):
        return df.checkpoint(eager=True)


class Stored:
    """A table written to the shared folder as Parquet; `df` reads it, `drop` deletes it.

    For large intermediates: compressed, read by column, and gone as soon as what was made of them is kept elsewhere.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.options(**PLAIN_FILES).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def named(column: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """`name`, or one made longer until no column of `df` has it, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_key(*cols: str):
    """A 64-bit key of a row; with the row's id beside it, one of 64 bits more."""
    return F.xxhash64(*[F.coalesce(named(c).cast("string"), F.lit("\0")) for c in cols])


def text_of(column: str = "text"):
    """The text with null read as the empty text."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file; the folder may be set by QUADLOOM_TOKENIZERS."""
    folder = os.environ.get("QUADLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of a record batch that goes back to Spark, which holds each whole beside its heap.
BATCH = 10_000


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """`mapInArrow` with `fn(batch) -> dict of columns` called on bounded record batches; what it returns goes back in bounded ones.

    What `fn` remembers in registered stores is let go at the end of each partition.
    """

    def run(batches):
        enter(fn.__module__)
        try:
            for batch in batches:
                if batch.num_rows:
                    out = fn(batch)
                    out = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.values()], names=list(out))
                    for at in range(0, out.num_rows, BATCH):
                        yield out.slice(at, BATCH)
        finally:
            release()

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, keep: list[str], extra: list[str], fn, added: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep` of `df`, as `fn` returns them, and the columns `added` (name -> type) behind them.

    fn(columns of keep, columns of extra) -> columns of keep and added; inside, columns have no names, so any names may stand outside.
    """
    added = added or {}
    plain = df.select(*[named(c).alias(f"c{n}") for n, c in enumerate([*keep, *extra])])
    schema = plain.select(*[f"c{n}" for n in range(len(keep))]).schema
    for n, kind in enumerate(added.values()):
        schema = schema.add(f"a{n}", kind)

    def run(batch):
        return dict(zip(schema.names, fn(list(batch.columns[: len(keep)]), list(batch.columns[len(keep) :]))))

    run.__module__ = fn.__module__
    return arrow_map(plain, run, schema).toDF(*keep, *added)


_stores: dict[int, dict] = {}
_models: dict[str, dict] = {}


def remember(*stores: dict) -> None:
    """Register look-up stores of this worker, so that `release` empties them."""
    for d in stores:
        _stores[id(d)] = d


def hold(module: str, models: dict) -> dict:
    """Register a module's dict of loaded models; a worker that turns to another module's work lets go of them."""
    _models[module] = models
    return models


def enter(module: str) -> None:
    """Let go of the models that other modules have loaded in this worker."""
    others = [d for name, d in _models.items() if name != module and d]
    for d in others:
        d.clear()
    if others:
        release()


def release() -> None:
    """Empty this worker's look-up stores and give the memory back to the system.

    Workers serve one operator after another and stay for a while when idle; what they remember would add up.
    """
    for d in _stores.values():
        d.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its pages
        pass


def _forest(batches):
    """A spanning forest of the edges of one partition, so that later rounds see few edges."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 200_000:  # bounded memory: what is known so far leaves as edges
            yield _flat(parent)
            parent = {}
    if parent:
        yield _flat(parent)


def find(parent: dict[int, int], x: int) -> int:
    """Root of `x` in a union-find kept as a dict, halving the path."""
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = p = parent.setdefault(p, p)
        x = p
    return x


def _flat(parent):
    rows = [(x, r) for x in list(parent) if (r := find(parent, x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), both long: rows (id, component).

    `component` is the smallest id that can be reached.  Large-star / small-star rounds:
    each is a partial minimum by node and a join with those minima, so a node with very many
    edges is pre-aggregated before its shuffle; the minima are checkpointed, so that the join is
    by broadcast where their size allows it and else one that Spark can split where it is skewed.  Nodes without an
    edge to another node have no row.  Nulls and self-loops are dropped; no edges give no
    rows.  Raises after `rounds` rounds rather than return components that are not final.
    """
    e = cut(edges.toDF("a", "b").selectExpr("cast(a as long) a", "cast(b as long) b").where("a is not null and b is not null and a <> b").mapInArrow(_forest, "a long, b long"))
    for _ in range(rounds):
        # large star: every neighbour above the node points at the least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(small(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour below the node, and the node, point at the least one
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(small(low), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        nxt = cut(star)
        same = nxt.select(F.count("*").alias("n"), F.bit_xor("b").alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))
        then = e.distinct().select(F.count("*").alias("n"), F.bit_xor("b").alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))
        now, before = same.unionAll(then).collect()  # two rows of counts
        e = nxt
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows take at most `most` bytes, else as it is; then Spark joins by shuffle.

    A number counts eight bytes and a row sixteen more; arrays and strings count by their lengths in all.
    `df` should be a checkpoint or a stored table, so that counting is cheap.
    """
    fixed = 16 + 8 * sum(len(f.dataType) if isinstance(f.dataType, StructType) else 1 for f in df.schema)
    long = [F.sum(8 * F.greatest(F.size(f.name), F.lit(0))) for f in df.schema if isinstance(f.dataType, ArrayType)]
    long += [F.sum(F.octet_length(f.name)) for f in df.schema if isinstance(f.dataType, StringType)]
    row = df.agg(F.count("*"), *long).first()
    return F.broadcast(df) if row[0] * fixed + sum(n or 0 for n in row[1:]) <= most else df


#: Bits of the map that `met` sends to every executor: 16 MB, whatever the number of keys.
SIEVE = 1 << 27


def sieve(df: DataFrame, hash_, keys: DataFrame, key_hash, bits: int = SIEVE):
    """(column, frame): a condition that holds for all rows of `frame`, which is `df` with the columns it needs, whose hash is among the keys' hashes, and for few others.

    The keys set bits of a map of fixed size, built from partial maps and broadcast.  Too many keys make the condition useless, not wrong.
    """
    place = lambda h: F.pmod(h, F.lit(bits)) + 1
    maps = keys.select(place(key_hash).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    frame = df.withColumn("__p", place(hash_)).withColumn("__part", F.bitmap_bucket_number("__p")).withColumn("__p", F.bitmap_bit_position("__p"))
    frame = frame.join(F.broadcast(maps), "__part", "left")
    bit = F.expr("shiftright(cast(conv(hex(substring(__map, cast(__p div 8 as int) + 1, 1)), 16, 10) as int), cast(__p % 8 as int)) % 2 = 1")
    return F.coalesce(bit, F.lit(False)), frame


class WordHashes(dict):
    """word -> 64-bit hash, remembered; bounded."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 100_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


word_hashes = WordHashes()
remember(word_hashes)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text.

    Words are the blank-separated parts of the lower-cased text.  A text of fewer than n words, but
    one at least, has one shingle: all its words.  A text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes.of(words)
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = bits(out ^ h[j : len(h) - n + 1 + j])
    return np.unique(out)
