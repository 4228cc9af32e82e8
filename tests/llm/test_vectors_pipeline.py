"""Vector operators and the pipeline against brute force."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quadloom.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, node long, id long, s int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def vectors(n=900, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(0, 200):  # a large cluster, a chain, pairs and copies
        x[k] = x[0] + 0.15 * rng.normal(size=d)
    for k in range(300, 400, 2):
        x[k + 1] = x[k] + 0.2 * rng.normal(size=d)
    x[500:520] = x[500]
    x[521] = 3 * x[520]
    return x.astype(np.float32)


def odd(x):
    rows = [(n, [float(a) for a in v]) for n, v in enumerate(x)]
    return rows + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (None, rows[500][1]), (7, rows[7][1])]


def test_near_vectors(spark):
    x = vectors()
    rows = odd(x)
    got = near_vectors.links(table(spark, rows), shard=200).collect()
    assert len(got) == len(rows)
    fine = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in fine])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = sorted((str(i), int(k)) for (i, _), k in zip(fine, near.sum(1)))
    mine = sorted((str(r["vec_id"]), r["n_links"]) for r in got if str(r["vec_id"]) in dict(want))
    found, true = sum(k for _, k in mine), sum(k for _, k in want)
    assert found <= true and found >= 0.99 * true
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert by[519]["component_id"] == 500 and by[521]["component_id"] == 520 and by[150]["component_id"] == by[3]["component_id"]
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2005))
    # all in one shard, and by scans alone
    whole = {str(r["vec_id"]): r["n_links"] for r in near_vectors.links(table(spark, rows)).collect()}
    scans = near_vectors.links(table(spark, rows), shard=300, beam=near_vectors.DENSE).collect()
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in scans if str(r["vec_id"]) in dict(want)) == want
    assert sum(whole[i] for i, _ in want) >= 0.99 * true
    assert near_vectors.links(table(spark, rows[:1])).collect()[0]["kept"] and near_vectors.links(table(spark, []).limit(0)).count() == 0


def test_topk(spark):
    x = np.round(vectors(700, 8, 2), 2)
    rows = [(n, [float(a) for a in v]) for n, v in enumerate(x)] + [(2000, None), (2050, [float("inf")] * 8), (2100, [1.0, 2.0]), (50, [float(a) for a in x[50]]), (None, [float(a) for a in x[50]])]
    rows += [(3000 + n, rows[650][1]) for n in range(7)]
    got = topk.search(table(spark, rows), F.col("id") % 50 == 0, shard=100, block=5).collect()
    mine = {}
    for r in got:
        mine.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = {}
    for n, (i, q) in enumerate(fine):
        if i is None or i % 50:
            continue
        cand = [(-int(q @ v), j is None, j or 0) for m, (j, v) in enumerate(fine) if m != n and len(v) == len(q)]
        for rank, (s, none, j) in enumerate(sorted(cand)[:5], 1):
            want.setdefault((i, rank), []).append((None if none else j, -s))
    assert {k: sorted(map(str, v)) for k, v in mine.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    assert topk.search(table(spark, []).limit(0), F.col("id") % 50 == 0).count() == 0
    # ids beyond what a double holds, beside a null one; values beyond what single precision holds
    big = 2**53 + 1
    rows = [(big + 49 - (big + 49) % 50, [1.0, 2.0]), (big, [1.0, 2.0]), (None, [1.0, 2.0]), (big + 2, [1e30, -1e30]), (7, [])]
    got = topk.search(table(spark, rows), F.col("id") % 50 == 0).collect()
    assert {r["vec_id"] for r in got} == {big, None, big + 2} and len(got) == 3 and got[0]["query_id"] % 50 == 0


def test_bounds_hold():
    gen = np.random.default_rng(4)
    for scale in (1.0, 100.0, 1e6):
        x, q = np.floor(scale * gen.normal(size=(500, 12))), np.floor(scale * gen.normal(size=(20, 12)))
        assert (topk.Approximation(x).bounds(q) >= q @ x.T).all()


def stages(spark, docs, folder, sf_dir):
    """What each stage was given and gave, each read from its file."""
    import corpus_pipeline

    out = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(n)))
        then = spark.read.parquet(str(folder / str(n)))
        out.append((name, docs, then))
        docs = then
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage on all that the stage before it kept, against a plain version of what it promises."""
    import zlib

    from tokenizers import Tokenizer

    from quadloom.llm import pii, toxicity
    from quadloom.llm.common import vocabulary_path

    from .test_line_dedup import brute
    from .test_text_operators import brute_classes

    d = "/root/testdata/sf0.001"
    done = {name: (before, after) for name, before, after in stages(spark, spark.read.parquet(f"{d}/documents.parquet"), tmp_path, d)}
    assert list(done) == ["toxicity", "line dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    for name in list(done)[:4]:
        before, after = done[name]
        assert after.columns == before.columns
        if name != "toxicity":
            assert after.where("n_chars <> char_length(text)").count() == 0

    before, after = done["toxicity"]
    index = toxicity.train(before, spark.read.parquet(f"{d}/labels.parquet"))
    assert text(after) == {i: t for i, t in text(before).items() if index.score(t or "")[0] < 0.5}
    labels = pq.read_table(f"{d}/labels.parquet").to_pandas()
    held = {i for i in set(labels.doc_id) if zlib.crc32(str(i).encode()) % 5 == 0}
    clean = set(labels[labels.toxic == 0].doc_id) & held
    assert len(clean & set(text(after))) >= 0.9 * len(clean & set(text(before)))

    before, after = done["line dedup"]
    want = brute(sorted(text(before).items()))
    assert text(after) == {i: t for i, (t, gone) in want.items() if t.split() or not gone}

    before, after = done["n-gram Jaccard join"]
    rows = sorted(text(before).items())
    _, root = brute_classes(rows)
    least = {}
    for (i, t), r in zip(rows, root):
        least.setdefault(r if (t or "").split() else ("bare", i), i)
    assert sorted(text(after)) == sorted(least.values())

    before, after = done["PII"]
    got = text(after)
    for i, t in text(before).items():
        assert not pii.base_spans(got[i])
        if not pii.mentions(t, pii.base_spans(t)):
            assert got[i] == t

    before, after = done["best-fit packing"]
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    sizes = {}
    for r in after.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in text(before).items()}
    import corpus_pipeline

    assert corpus_pipeline.run(spark, d).count() == after.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, "a", 1), (None, "plain text here", "en", "s", 15, "b", 2), (2, "", "en", None, 0, None, 3), (3, " \n ", "de", "s", 3, "c", None), (4, "one two three", "en", "s", 13, "d", 4), (4, "one two three", "en", "s", 13, "d", 4), (5, "word " * 60000, "en", "s", 300000, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key string, lines_removed int")
    d = "/root/testdata/sf0.001"
    *first, (_, before, packed) = stages(spark, docs, tmp_path / "odd", d)
    kept = sorted((str(r["doc_id"]), r["text"] if r["doc_id"] != 5 else r["text"].split().count("word"), r["__key"]) for r in before.collect())
    assert kept == sorted([("1", None, "a"), ("None", "plain text here", "b"), ("2", "", None), ("3", " \n ", "c"), ("4", "one two three", "d"), ("5", 50, "e")], key=lambda r: (r[0], str(r[1])))
    assert sorted(str(r["doc_id"]) for r in packed.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert [after.count() for _, _, after in stages(spark, docs.limit(0), tmp_path / "none", d)] == [0] * 5
