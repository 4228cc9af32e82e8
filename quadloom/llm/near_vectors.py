"""Near-copies of embeddings by HNSW graphs per shard.

Equal vectors, by 128 bits of hashes, are one node.  Nodes are dealt to shards by hash; each shard gets a hierarchical
navigable small-world graph, built in batches of growing size: a batch is searched for in the
graph so far, its own members are compared, and neighbours are chosen so that no two stand in
for each other.  Every unordered pair of shards is one task: the nodes of each are searched for in
the graph of the other with beams, and what either search finds counts.  An audit against brute force, on queries in random order until AUDIT_LINKS
true links are met (or AUDIT queries are read), widens all beams until recall is at least RECALL.  A beam that is full of hits is widened until it
isn't; a node that fills a beam of DENSE (it lies in a large group), and all nodes where no beam below DENSE passes the audit, are
compared with the whole shard instead, exactly.  Candidates are verified by cosine in doubles.  Link counts and a forest of the
links leave the task, never the pairs.

Shards hold SHARD_BYTES of doubles on average, so a task's memory doesn't grow with the input; the number of tasks grows with the square of that of the shards.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, link with
nothing and are components of their own; vectors of different lengths don't link; rows that repeat
an id are vectors of their own; equal vectors link with each other; a null id is named by no component but its own; a cosine that is the
threshold to the last bit links; an empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, named, small

THRESHOLD = 0.9
RECALL = 0.995
SHARD_BYTES = 16 << 20
DEGREE = 24
#: Beams of building, and of searching to begin with.
BUILD_BEAM, BEAM = 48, 24
DENSE = 128
AUDIT, AUDIT_LINKS = 2048, 400


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Best `beam` nodes of each query found from its entry nodes: ids (len(x) where none) and similarities, best first."""
    n, many = len(x), len(q)
    beam = min(beam, n)
    xs = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    ls = np.concatenate([links, np.full((1, links.shape[1]), n, links.dtype)])
    ids = np.full((many, beam), n, np.int32)
    sims = np.full((many, beam), -2.0, np.float32)
    open_ = np.zeros((many, beam), bool)
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True

    def merge(live, new):
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[live[:, None], new]] = n
        seen[live[:, None], new] = True
        s = np.matmul(xs[new], q[live][:, :, None])[:, :, 0]
        s[new == n] = -2.0
        all_ids, all_sims = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], s], 1)
        all_open = np.concatenate([open_[live], new < n], 1)
        if all_sims.shape[1] > beam:
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            all_ids, all_sims, all_open = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_open))
        ids[live], sims[live], open_[live] = all_ids, all_sims, all_open

    live = np.arange(many)
    merge(live, entry.astype(np.int32).copy())
    step = min(step, beam)
    while len(live):
        score = np.where(open_[live], sims[live], -9.0)
        pick = np.argpartition(-score, step - 1, axis=1)[:, :step]
        ok = np.take_along_axis(score, pick, 1) > -3
        going = ok[:, :].any(axis=1)
        live, pick, ok = live[going], pick[going], ok[going]
        if not len(live):
            break
        open_[live[:, None], pick] = False
        merge(live, ls[np.where(ok, ids[live[:, None], pick], n)].reshape(len(live), -1))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(x: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Neighbours for each row of `own` among its candidates (len(x) where none, best first).

    A candidate that is nearer to a chosen one than to the node itself is passed over; places left go to the best of those.
    """
    n = len(x)
    xs = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    out = np.full((len(own), most), n, np.int32)
    for start in range(0, len(own), 256):
        part = slice(start, start + 256)
        c = cand[part]
        v = xs[c]
        to_own = np.matmul(v, x[own[part]][:, :, None])[:, :, 0]
        between = np.matmul(v, v.transpose(0, 2, 1))
        real = c < n
        taken = np.zeros(c.shape, bool)
        many = np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            rival = np.where(taken, between[:, j, :], -9.0).max(axis=1)
            good = real[:, j] & (many < most) & (rival <= to_own[:, j])
            taken[:, j] = good
            many += good
        rank = np.where(taken, 0, np.where(real, 1, 2)) * 4.0 - to_own
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        got = np.take_along_axis(c, best, 1)
        out[part, : got.shape[1]] = got
    return out


def build_layer(x: np.ndarray, degree: int, beam: int) -> np.ndarray:
    """Adjacency (len(x), degree) of a navigable graph of all rows of x; len(x) where none."""
    n = len(x)
    links = np.full((n, degree), n, np.int32)
    half = max(1, degree // 2)
    at = min(n, 512)
    sims = x[:at] @ x[:at].T
    np.fill_diagonal(sims, -9.0)
    width = min(at, 48)
    cand = np.argsort(-sims, axis=1, kind="stable")[:, :width].astype(np.int32)
    cand[np.take_along_axis(sims, cand, 1) < -3] = n
    links[:at, :half] = choose(x, np.arange(at), cand, half)
    _link_back(x, links, np.arange(at), links[:at, :half].copy())
    while at < n:
        new = np.arange(at, min(n, 2 * at, at + 1024))
        sub = np.where(links[:at] < at, links[:at], at)
        got = [beam_search(x[:at], sub, x[new[k : k + 256]], np.tile(np.arange(min(at, 4)), (len(new[k : k + 256]), 1)), beam)[0] for k in range(0, len(new), 256)]
        ids = np.concatenate(got)
        ids = np.where(ids < at, ids, n)
        mates = x[new] @ x[new].T
        np.fill_diagonal(mates, -9.0)
        near = np.argsort(-mates, axis=1, kind="stable")[:, : min(16, len(new) - 1)] + at if len(new) > 1 else np.empty((1, 0), np.int64)
        cand = np.concatenate([ids, near.astype(np.int32)], 1)
        xs = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
        s = np.matmul(xs[cand], x[new][:, :, None])[:, :, 0]
        s[cand == n] = -9.0
        cand = np.take_along_axis(cand, np.argsort(-s, axis=1, kind="stable"), 1)
        links[new, :half] = choose(x, new, cand, half)
        _link_back(x, links, new, links[new, :half].copy())
        at = int(new[-1]) + 1
    return links


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
    """Add the reverse of each link; where a node then has too many, choose among them."""
    n, degree = links.shape
    src, dst = np.repeat(new, to.shape[1]), to.ravel()
    src, dst = src[dst < n].astype(np.int32), dst[dst < n]
    s = np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((-s, dst))
    src, dst = src[order], dst[order]
    nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
    width = min(int(count.max(initial=0)), degree)
    if not len(nodes):
        return
    place = np.arange(len(dst)) - np.repeat(start, count)
    more = np.full((len(nodes), width), n, np.int32)
    keep = place < width
    more[np.repeat(np.arange(len(nodes)), count)[keep], place[keep]] = src[keep]
    cand = np.concatenate([links[nodes], more], 1)
    cand.sort(axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    xs = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    s = np.matmul(xs[cand], x[nodes][:, :, None])[:, :, 0]
    s[cand == n] = -9.0
    cand = np.take_along_axis(cand, np.argsort(-s, axis=1, kind="stable"), 1)
    few = (cand < n).sum(axis=1) <= degree
    links[nodes[few]] = cand[few][:, :degree]
    if not few.all():
        links[nodes[~few]] = choose(x, nodes[~few], cand[~few], degree)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray):
        self.x, self.layers = x, layers  # (members, adjacency among them), the whole shard first

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 11) -> "Graph":
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(degree / 2)).astype(int)
        layers = []
        for k in range(int(level.max(initial=0)) + 1):
            members = np.flatnonzero(level >= k) if k else np.arange(len(x))
            if k and len(members) < 8:
                break
            layers.append((members.astype(np.int32), build_layer(x[members], degree, beam)))
        return cls(layers, x)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best `beam` nodes found for each query."""
        entry = np.zeros((len(q), 1), np.int64)  # a member of the top layer, by its place there
        for k in range(len(self.layers) - 1, -1, -1):
            members, links = self.layers[k]
            ids, sims = beam_search(self.x[members], links, q, entry, beam if k == 0 else 8)
            if k == 0:
                return ids, sims
            ids = np.where(ids < len(members), ids, ids[:, :1])
            entry = np.searchsorted(self.layers[k - 1][0], members[ids[:, :4]])
        raise AssertionError("a graph has a layer")

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, **{f"m{k}": m for k, (m, _) in enumerate(self.layers)}, **{f"l{k}": a for k, (_, a) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Graph":
        z = np.load(io.BytesIO(data))
        return cls([(z[f"m{k}"], z[f"l{k}"]) for k in range(sum(n.startswith("m") for n in z.files))], z["x"])


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their magnitude."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def passing_beam(graph: Graph, q: np.ndarray, threshold: float, beam: int, recall: float) -> int:
    """The least of the doubled beams that passes the audit, or DENSE if none below does."""
    x, n = graph.x, len(graph.x)
    order = np.random.default_rng(5).permutation(len(q))[:AUDIT]
    while beam < DENSE:
        right = total = 0
        for k in range(0, len(order), 256):
            part = q[order[k : k + 256]]
            real = part @ x.T >= threshold + 1e-4
            ids, sims = graph.search(part, beam)
            mine = np.zeros((len(part), n + 1), bool)
            np.put_along_axis(mine, np.where(sims >= threshold - 1e-4, ids, n).astype(np.int64), True, 1)
            real[(sims[:, -1] >= threshold - 1e-4) & (beam < n)] = False  # a full beam is widened anyhow
            right += int((real & mine[:, :n]).sum())
            total += int(real.sum())
            if total >= AUDIT_LINKS:
                break
        if right >= recall * total:
            return beam
        beam *= 2
    return DENSE


def search_all(graph: Graph, q: np.ndarray, threshold: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, node places) of candidates, and which queries are to be compared with all nodes; those have no candidates here."""
    n, dense = len(graph.x), np.zeros(len(q), bool)
    beam = passing_beam(graph, q, threshold, beam, recall)
    if beam >= DENSE:
        dense[:] = True
        return np.zeros(0, np.int64), np.zeros(0, np.int64), dense
    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(q), 256):
        who, wide = np.arange(k, min(k + 256, len(q))), beam
        while len(who) and wide < DENSE:
            ids, sims = graph.search(q[who], wide)
            full = (sims[:, -1] >= threshold - 1e-4) & (wide < n)
            rows, cols = np.nonzero((sims >= threshold - 1e-4) & ~full[:, None] & (ids < n))
            at.append(who[rows])
            to.append(ids[rows, cols].astype(np.int64))
            who, wide = who[full], wide * 2
        dense[who] = True
    return np.concatenate(at), np.concatenate(to), dense


class Links:
    """Link counts of the nodes of one task, and a forest of the links."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.label = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count links between nodes; each link is given once."""
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        self.join(a, b)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give both ends of all links the least label of either, until no label moves."""
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:  # labels of labels
                next_ = self.label[self.label]
                if (next_ == self.label).all():
                    break
                self.label = next_


def scan(links: Links, q: np.ndarray, x: np.ndarray, at: np.ndarray, base: int, own: np.ndarray, threshold: float) -> None:
    """Compare query places `at` of q with all of x, exactly, and count.

    base: number of x's first node in `links`; own[k, j] says which of these links are counted here, as a function of places.
    """
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    for k in range(0, len(at), 256):
        who = at[k : k + 256]
        sims = q32[who] @ x32.T
        hit = sims >= threshold + 1e-4  # single precision is sure of these
        rows, cols = np.nonzero(~hit & (sims >= threshold - 1e-4))
        good = np.einsum("ij,ij->i", q[who[rows]], x[cols]) >= threshold
        hit[rows[good], cols[good]] = True
        hit &= own(who)
        links.count[who] += hit @ links.weights[base : base + len(x)]
        links.count[base : base + len(x)] += links.weights[who] @ hit
        a, b = [], []
        for i, row in zip(who.tolist(), hit):  # one link to each tree met is enough for the forest
            places = np.flatnonzero(row)
            if len(places):
                _, first = np.unique(links.label[base + places], return_index=True)
                a.append(np.full(len(first), i))
                b.append(base + places[first])
        if a:
            links.join(np.concatenate(a), np.concatenate(b))


def pair_links(qa: np.ndarray, ga: Graph, wa: np.ndarray, qb: np.ndarray | None, gb: Graph | None, wb: np.ndarray | None, threshold: float, beam: int, recall: float) -> Links:
    """Links between two shards' nodes, b's numbered after a's; or within one shard, if b is None."""
    n = len(qa)
    if qb is None:
        links = Links(wa)
        i, j, dense = search_all(ga, qa.astype(np.float32), threshold, beam, recall)
        real = (i != j) & ~dense[j]  # a link of a dense node is found by that node's scan
        key = np.unique(np.minimum(i, j)[real] * n + np.maximum(i, j)[real])
        i, j = key // n, key % n
        good = np.einsum("ij,ij->i", qa[i], qa[j]) >= threshold
        links.add(i[good], j[good])
        every = np.arange(n)
        scan(links, qa, qa, np.flatnonzero(dense), 0, lambda who: (every > who[:, None]) | ~dense & (every != who[:, None]), threshold)
        return links
    m = len(qb)
    links = Links(np.concatenate([wa, wb]))
    i, j, dense_a = search_all(gb, qa.astype(np.float32), threshold, beam, recall)
    k, l, dense_b = search_all(ga, qb.astype(np.float32), threshold, beam, recall)
    one, two = ~dense_b[j], ~dense_a[l]
    key = np.unique(np.concatenate([i[one] * m + j[one], l[two] * m + k[two]]))
    i, j = key // m, key % m
    good = np.einsum("ij,ij->i", qa[i], qb[j]) >= threshold
    links.add(i[good], n + j[good])
    scan(links, qa, qb, np.flatnonzero(dense_a), n, lambda who: np.ones((len(who), m), bool), threshold)
    # scanned from the other side, b's places come after a's
    back = Links(np.concatenate([wb, wa]))
    scan(back, qb, qa, np.flatnonzero(dense_b), m, lambda who: np.broadcast_to(~dense_a, (len(who), n)), threshold)
    links.count += np.roll(back.count, n)
    turn = np.concatenate([np.arange(n, n + m), np.arange(n)])
    links.join(turn, turn[back.label])
    return links


def links(df: DataFrame, threshold: float = THRESHOLD, shard: int | None = None, beam: int = BEAM, recall: float = RECALL, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row of `df`.

    n_links counts the other rows linked directly, copies included; component_id is the least id reachable.  shard: nodes of a shard on average.
    """
    v = named(vector_col).cast("array<double>")
    fine = F.col("v").isNotNull() & F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0)
    rows = df.select(named(id_col).alias("id"), v.alias("v")).select("id", F.when(fine, F.xxhash64("v")).alias("h"), F.when(fine, F.xxhash64(F.lit(1), F.col("v"))).alias("h2"), F.when(fine, F.col("v")).alias("v"))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    # a node is named by the least number of the rows that hold its vector
    same = cut(rows.where("h is not null").groupBy("h", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.min("uid").alias("node")))
    nodes = rows.select(F.col("uid").alias("node"), "v").join(small(same.select("node", "copies")), "node").withColumn("width", F.size("v"))
    many, width = same.count(), rows.agg(F.max(F.size("v"))).first()[0] or 1
    shards = max(1, -(-many // (shard or max(1024, SHARD_BYTES // (8 * width)))))
    nodes = cut(nodes.withColumn("s", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)).cast("int")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = unit(np.array(pdf["v"].tolist(), float))
        return pd.DataFrame({"s": [int(pdf["s"].iloc[0])], "width": [int(pdf["width"].iloc[0])], "graph": [Graph.build(x.astype(np.float32)).dump()], "nodes": [pdf["node"].to_numpy()], "copies": [pdf["copies"].to_numpy()], "units": [x.tobytes()]})

    graphs = cut(nodes.groupBy("s", "width").applyInPandas(build, "s int, width int, graph binary, nodes array<long>, copies array<long>, units binary"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("own")
        side = [(np.asarray(r.nodes, np.int64), np.asarray(r.copies, np.int64), np.frombuffer(r.units, float).reshape(len(r.nodes), -1), Graph.load(r.graph)) for r in pdf.itertuples()]
        if len(side) == 2:
            (a, wa, qa, ga), (b, wb, qb, gb) = side
            found, ids = pair_links(qa, ga, wa, qb, gb, wb, threshold, beam, recall), np.concatenate([a, b])
        elif pdf["s"].iloc[0] == pdf["t"].iloc[0]:
            (ids, wa, qa, ga), = side
            found = pair_links(qa, ga, wa, None, None, None, threshold, beam, recall)
        else:  # the other shard has no vectors of this length
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        got = np.flatnonzero(found.count)
        return pd.DataFrame({"node": ids[got], "links": found.count[got], "root": ids[found.label[got]]})

    # each shard goes to the tasks of all its pairs: (least, greatest)
    held = graphs.select("*", F.col("s").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("t"))
    held = held.select("graph", "nodes", "copies", "units", "width", "own", F.least("own", "t").alias("s"), F.greatest("own", "t").alias("t"))
    found = cut(held.groupBy("s", "t", "width").applyInPandas(task, "node long, links long, root long"))
    comp = components(found.where("node <> root").select("node", "root"))
    comp = cut(comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct()).toDF("node", "comp"))
    count = cut(found.groupBy("node").agg(F.sum("links").alias("links")))
    told = same.join(small(count), "node", "left").join(small(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = cut(told.groupBy("comp").agg(F.min("least").alias("component_id")))
    told = told.join(small(least), "comp").select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "h", "h2").join(small(cut(told)), ["h", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", named(id_col).eqNullSafe(F.col("component_id")))
