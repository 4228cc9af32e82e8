"""A versioned quad store, SPARQL Update and transactions.

A version is a base of distinct quads and the changes since, each a pair of quads removed and quads added; so a
request costs what it changes, and after COMPACT changes a new base is written.  A request's operations see
each other's changes, and become one version when all have worked; an error leaves nothing behind.

With a `path`, bases are Parquet folders by a hash of the predicate, so that scans of one predicate read
its folder alone; changes are Parquet as well; and a log entry a version says what it is made of.  A store opens what is
there.  The entry is created last and once, so of two writers of the same next version one gets Conflict.
The newest `keep` versions stay, and pinned ones; folders that none of them reads are deleted.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .lineage import cut
from .plans.compiler import Compiler, Frame, instantiate
from .plans.parser import Update, parse_update
from .sources.mapping import PART, Dataset, part_of
from .sources.rdf_io import QUADS
from .terms import Iri, QueryError, valid_iri

KEEP = 16
COMPACT = 8
COLUMNS = ("g", "s", "p", "o")


class Conflict(RuntimeError):
    """Another writer has made this version."""


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUADS)


def among(quads: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Quads that are (left_semi) or aren't (left_anti) among others."""
    named = others.select(*[F.col(c).alias(f"_{c}") for c in COLUMNS])
    on = quads["s"].eqNullSafe(F.col("_s")) & quads["p"].eqNullSafe(F.col("_p")) & quads["o"].eqNullSafe(F.col("_o")) & quads["g"].eqNullSafe(F.col("_g"))
    return quads.join(named, on, how)


def changed(quads: DataFrame, removed: DataFrame | None, added: DataFrame | None) -> DataFrame:
    quads = among(quads, removed, "left_anti") if removed is not None else quads
    return quads.unionByName(added) if added is not None else quads


@dataclass
class Version:
    """What a version is made of: folders (or names, in memory) and their quads."""

    base: str
    changes: list[str]
    frame: DataFrame


class Store:
    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, path: str | None = None, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path, keep
        self.versions: dict[int, Version] = {}
        self.version = -1
        self.pins: set[int] = set()
        self.lock = threading.RLock()
        self.indexes: list = []
        if path:
            self._open()
        if quads is not None or self.version < 0:
            self.commit(quads if quads is not None else empty(spark))

    # -- files
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _open(self) -> None:
        fs, log = self._fs(f"{self.path}/log")
        if not fs.exists(log):
            return
        for n in sorted(int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()):
            entry = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{n}").collect()))
            frame = self._read(f"{entry['base']}/base")
            for c in entry["changes"]:
                frame = changed(frame, self._read(f"{c}/removed"), self._read(f"{c}/added"))
            self.versions[n], self.version = Version(entry["base"], entry["changes"], frame), n

    def _read(self, name: str) -> DataFrame:
        """A base or one side of a change, with the folder by which it is kept."""
        schema = empty(self.spark).schema
        if name.endswith("/base"):
            return self.spark.read.schema(schema.add(PART, IntegerType())).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").withColumn(PART, part_of(F.col("p")))

    def _log(self, n: int, version: Version) -> None:
        fs, entry = self._fs(f"{self.path}/log/{n}")
        try:
            out = fs.create(entry, False)
        except Exception as e:
            raise Conflict(f"version {n} is there already") from e
        out.write(bytearray(json.dumps({"base": version.base, "changes": version.changes}).encode()))
        out.close()

    # -- versions
    def commit(self, quads: DataFrame) -> int:
        """Make distinct `quads` the newest version."""
        with self.lock:
            name = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
            quads = quads.select(*COLUMNS).distinct()
            if self.path:
                quads.withColumn(PART, part_of(F.col("p"))).write.partitionBy(PART).parquet(f"{self.path}/{name}/base")
                frame = self._read(f"{name}/base")
            else:
                frame = cut(quads)
            return self._made(Version(name, [], frame), [name])

    def commit_changes(self, steps: list[tuple[DataFrame | None, DataFrame | None]]) -> int:
        """Make a version of the newest one and changes to it, in order; each removes quads that are there and adds ones that aren't."""
        with self.lock:
            now = self.versions[self.version]
            if len(now.changes) + len(steps) > COMPACT:
                frame = now.frame.select(*COLUMNS)
                for removed, added in steps:
                    frame = changed(frame, removed, added)
                return self.commit(frame)
            frame, names = now.frame, list(now.changes)
            for removed, added in steps:
                name = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
                if self.path:
                    for side, df in (("removed", removed), ("added", added)):
                        (df if df is not None else empty(self.spark)).select(*COLUMNS).write.parquet(f"{self.path}/{name}/{side}")
                    removed, added = (self._read(f"{name}/{side}") for side in ("removed", "added"))
                frame = changed(frame, removed, added)
                names.append(name)
            return self._made(Version(now.base, names, frame), names[len(now.changes) :])

    def _made(self, version: Version, written: list[str]) -> int:
        n = self.version + 1
        if self.path:
            try:
                self._log(n, version)
            except Conflict:
                self._delete(written)
                raise
        self.versions[n], self.version = version, n
        self._prune()
        for index in self.indexes:
            index.reconcile(self.at())
        return n

    def _prune(self) -> None:
        before = {f for v in self.versions.values() for f in (v.base, *v.changes)}
        free = sorted(set(self.versions) - self.pins - {self.version})
        for old in free[: max(0, len(self.versions) - self.keep)]:
            del self.versions[old]
            if self.path:
                fs, entry = self._fs(f"{self.path}/log/{old}")
                fs.delete(entry, False)
        if self.path:
            self._delete(before - {f for v in self.versions.values() for f in (v.base, *v.changes)})

    def _delete(self, names) -> None:
        for name in names:
            fs, folder = self._fs(f"{self.path}/{name}")
            fs.delete(folder, True)

    def at(self, version: int | None = None) -> DataFrame:
        """Quads of a version, the newest by default."""
        return self._frame(version).select(*COLUMNS)

    def _frame(self, version: int | None) -> DataFrame:
        n = self.version if version is None else version
        if n not in self.versions:
            raise KeyError(f"version {n} isn't kept")
        return self.versions[n].frame

    def pin(self) -> int:
        """Keep the newest version until it is let go."""
        self.pins.add(self.version)
        return self.version

    def unpin(self, version: int) -> None:
        self.pins.discard(version)

    def attach(self, index) -> None:
        """An index (see operators.semantic) that is brought up to date with each version."""
        self.indexes.append(index)
        index.reconcile(self.at())

    def dataset(self, version: int | None = None) -> Dataset:
        return Dataset(self.spark, [], self._frame(version))

    def statistics(self) -> DataFrame:
        """One row: quads and distinct subjects, predicates, objects and graphs."""
        return self.at().agg(F.count(F.lit(1)).alias("quads"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"), F.count_distinct("g").alias("graphs"))

    def graphs(self) -> DataFrame:
        return self.at().where("g is not null").select("g").distinct()

    # -- updates
    def update(self, text: str, prefixes: dict[str, str] | None = None, tenant: str | None = None) -> int:
        """Run an update request as one; the number of its operations that could change something."""
        with self.lock:
            steps, _, n = self.staged(self.at(), text, prefixes, tenant)
            self.commit_changes(steps)
        return n

    def insert(self, quads: DataFrame) -> int:
        """Add quads, as one version."""
        with self.lock:
            return self.commit_changes([(None, cut(among(quads.select(*COLUMNS).distinct(), self.at(), "left_anti")))])

    def staged(self, quads: DataFrame, text: str, prefixes: dict[str, str] | None = None, tenant: str | None = None) -> tuple[list, DataFrame, int]:
        """(changes, quads after them, operations) of a request run on `quads`."""
        steps, n = [], 0
        for u in parse_update(text, prefixes):
            if tenant is not None:
                check_tenant(u, tenant)
            removed, added, k = self.apply(quads, u, tenant)
            removed, added = (None if df is None else cut(df) for df in (removed, added))
            steps.append((removed, added))
            quads = changed(quads, removed, added)
            n += k
        return steps, quads, n

    def apply(self, quads: DataFrame, u: Update, tenant: str | None = None) -> tuple[DataFrame | None, DataFrame | None, int]:
        """(quads that an operation removes, quads that it adds, whether it could change something)."""
        if u.kind == "insert_data":
            return None, among(self._data(u.insert), quads, "left_anti"), len(u.insert)
        if u.kind == "delete_data":
            return among(self._data(u.delete), quads, "left_semi"), None, len(u.delete)
        if u.kind == "modify":
            return *self._modify(quads, u, tenant), 1
        if u.kind == "create":
            if not valid_iri(u.target):
                raise QueryError("no IRI")
            return None, None, 0
        if u.kind == "clear":
            gone = {"DEFAULT": F.col("g").isNull(), "NAMED": F.col("g").isNotNull(), "ALL": F.lit(True)}.get(u.target, F.coalesce(F.col("g") == u.target, F.lit(False)))
            return quads.where(gone), None, 1
        a, b = (None if x == "DEFAULT" else x for x in (u.source, u.target))
        if a == b:
            return None, None, 0
        inside = lambda g: F.col("g").isNull() if g is None else F.coalesce(F.col("g") == g, F.lit(False))
        moved = quads.where(inside(a)).withColumn("g", F.lit(b).cast("string")).select(*COLUMNS)
        if not u.silent and u.kind in ("copy", "move", "add", "load") and a is not None and quads.where(inside(a)).isEmpty():
            raise QueryError(f"no graph <{a}>")
        removed = among(quads.where(inside(b)), moved, "left_anti") if u.kind in ("copy", "move") else None
        if u.kind == "move":
            removed = removed.unionByName(quads.where(inside(a)))
        return removed, among(moved, quads, "left_anti"), 1

    def _data(self, quads: list) -> DataFrame:
        return instantiate(Frame(self.spark.range(1).select()), quads).distinct()

    def _modify(self, quads: DataFrame, u: Update, tenant: str | None) -> tuple[DataFrame | None, DataFrame | None]:
        froms, named = u.using, u.using_named
        if u.scope is not None and froms is None:
            froms = [u.scope]
        data = Dataset(self.spark, [], quads)
        c = Compiler(data if tenant is None else data.tenant(tenant), None, froms, named if u.using is not None else None)
        f = c.pattern(u.pattern)
        f = Frame(cut(f.df), f.scope)  # one evaluation for both templates
        scoped = lambda qs: [(Iri(u.scope) if g is None and u.scope else g, *t) for g, *t in qs]
        add = cut(instantiate(f, scoped(u.insert)).distinct()) if u.insert else None
        removed = among(instantiate(f, scoped(u.delete)).distinct(), quads, "left_semi") if u.delete else None
        if removed is not None and add is not None:  # what is deleted and inserted stays
            removed = among(removed, add, "left_anti")
        return removed, None if add is None else among(add, quads, "left_anti")


def own_graph(name, tenant: str) -> bool:
    own = f"urn:tenant:{tenant}"
    return isinstance(name, str) and (name == own or name.startswith(own + ":"))


def graphs_in(p) -> list:
    """Terms after GRAPH in a pattern, at any depth, those in expressions too."""
    if isinstance(p, (list, tuple)):
        out = [p[1]] if isinstance(p, tuple) and p and p[0] == "graph" else []
        return out + [g for x in p for g in graphs_in(x)]
    return graphs_in(p.pattern) + [g for x in (p.select, p.having, p.order, p.group) for g in graphs_in(x or [])] if hasattr(p, "pattern") else []


def check_tenant(u: Update, tenant: str) -> None:
    """Raise unless every graph that an operation names, to write or to read, belongs to the tenant.

    Graphs that a variable stands for are the tenant's in any case, since its patterns see no others.
    """
    written = [g.value if isinstance(g, Iri) else g for g, *_ in [*u.insert, *u.delete]]
    read = [g.value for g in graphs_in(u.pattern) if isinstance(g, Iri)]
    for g in [*written, *read, u.scope, u.source, u.target, *(u.using or []), *(u.using_named or [])]:
        if g is not None and not own_graph(g, tenant):
            raise QueryError(f"graph {g} isn't the tenant's")
    if any(g is None for g in written) and not u.scope:
        raise QueryError("a tenant writes to named graphs only")


class Transaction:
    """Requests that become one version together.  It sees its own changes on the version that it began with."""

    def __init__(self, store: Store, seconds: float):
        self.store, self.began, self.status = store, store.pin(), "active"
        self.until = time.monotonic() + seconds
        self.quads, self.steps = store.at(), []

    def _check(self) -> None:
        if self.status == "active" and time.monotonic() > self.until:
            self._end("expired")
        if self.status != "active":
            raise RuntimeError(f"the transaction is {self.status}")

    def _end(self, status: str) -> None:
        self.status = status
        self.store.unpin(self.began)

    def update(self, text: str, prefixes: dict[str, str] | None = None, tenant: str | None = None) -> int:
        self._check()
        steps, self.quads, n = self.store.staged(self.quads, text, prefixes, tenant)
        self.steps += steps
        return n

    def dataset(self) -> Dataset:
        self._check()
        return Dataset(self.store.spark, [], self.quads)

    def commit(self) -> int:
        """The new version; Conflict if another was made meanwhile."""
        self._check()
        with self.store.lock:
            if self.store.version != self.began:
                self._end("aborted")
                raise Conflict("another version was made meanwhile")
            n = self.store.commit_changes(self.steps)
        self._end("committed")
        return n

    def abort(self) -> None:
        self._check()
        self._end("aborted")


class Transactions:
    """Begins transactions on a store, up to a limit at a time."""

    def __init__(self, store: Store, limit: int = 64, seconds: float = 60.0):
        self.store, self.limit, self.seconds = store, limit, seconds
        self.all: list[Transaction] = []

    def expire(self) -> int:
        """End those whose time is up; how many."""
        late = [t for t in self.active() if time.monotonic() > t.until]
        for t in late:
            t._end("expired")
        return len(late)

    def active(self) -> list[Transaction]:
        self.all = [t for t in self.all if t.status == "active"]
        return self.all

    def begin(self, seconds: float | None = None) -> Transaction:
        self.expire()
        if len(self.active()) >= self.limit:
            raise RuntimeError(f"{self.limit} transactions are active")
        self.all.append(Transaction(self.store, self.seconds if seconds is None else seconds))
        return self.all[-1]
