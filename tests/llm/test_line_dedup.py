"""Line dedup against a brute-force version, word by word, and its odd rows."""

import random
import re

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quadloom.llm import common, line_dedup

from .test_text_operators import documents, words


def brute_words(rows, least):
    """Words in windows of `least` words that stand at an earlier place; beyond that place where they overlap it."""
    first, out = {}, {}
    for i, text in rows:
        w = (text or "").split()
        cover = np.zeros(len(w) + 1, int)  # one beyond the last word of the furthest window over a word
        for a in range(len(w) - least + 1):
            d, b = first.setdefault(tuple(w[a : a + least]), (i, a))
            if (d, b) != (i, a):
                start = max(a, b + least) if d == i else a
                cover[start : a + least] = np.maximum(cover[start : a + least], a + least)
        out[i] = cover
    return out


def brute_text(text, cover):
    """What stays of a text, and the lines gone, by the rules of the docstring."""
    out, gone, at = [], 0, 0
    for line in (text or "").split("\n"):
        parts = re.findall(r"\S+\s*", line)
        lead = line[: len(line) - len(line.lstrip())]
        mine = [cover[at + n] > 0 for n in range(len(parts))]
        if not parts:
            if at > 0 and cover[at - 1] > at:
                gone += 1
            else:
                out.append(line)
        elif all(mine):
            gone += 1
        else:
            kept, n, cut = [], 0, False
            while n < len(parts):
                m = n
                while m < len(parts) and mine[m]:
                    m += 1
                if m - n >= line_dedup.MIN_PIECE:
                    n, cut = m, True
                else:
                    kept.append(parts[n])
                    n += 1
            line = lead + "".join(kept)
            out.append(line.rstrip() if cut else line)
        at += len(parts)
    return "\n".join(out), gone


def brute(rows, least=line_dedup.MIN_WORDS):
    cover = brute_words(rows, least)
    return {i: brute_text(t, cover[i]) for i, t in rows}


def found(spark, rows, least=line_dedup.MIN_WORDS):
    return {r["doc_id"]: (r["text"] or "", r["lines_removed"]) for r in line_dedup.apply(documents(spark, rows), least).collect()}


def test_against_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, 90).split() for _ in range(6)]
    lines = [words(rng, n) for n in (1, 3, 6, 10, 15, 30, 60) for _ in range(4)]
    rows = []
    for n in range(70):  # passages cut at any word, joined to other text, in lines of any length
        out = []
        for _ in range(rng.randrange(0, 6)):
            p, at = rng.choice(pool), rng.randrange(60)
            out += p[at : at + rng.randrange(5, 90)] + words(rng, rng.randrange(0, 20), 9000).split()
        rows.append((n, "".join(w + rng.choice([" "] * 9 + ["\n", "\n\n", "  "]) for w in out)))
    for n in range(70, 110):  # whole lines
        rows.append((n, "\n".join(rng.choice(lines) if rng.random() < 0.7 else words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(0, 25)))))
    for n, p in enumerate((1, 2, 7, 30, 49, 50, 51)):  # texts that repeat themselves
        phrase = words(rng, p, 10**6)
        rows.append((200 + n, words(rng, 5, 9000) + " " + "\n".join([phrase] * (400 // p))))
    for least in (10, 50):
        assert found(spark, rows, least) == brute(rows, least)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    """Shuffled joins behind maps of bits give the same."""
    monkeypatch.setattr(line_dedup, "small", lambda df: df)
    rng = random.Random(12)
    pool = [words(rng, 70) for _ in range(5)]
    rows = [(n, f"{words(rng, 9, 9000)} {rng.choice(pool)}\n{rng.choice(pool)} {words(rng, 30, 9000)}" if n % 3 else words(rng, 80, 9000)) for n in range(40)]
    assert found(spark, rows) == brute(rows)
    hashes = spark.range(2000).select(F.xxhash64("id").alias("h"))
    maybe, frame = common.sieve(hashes, F.col("h"), hashes.limit(50), F.col("h"), 1 << 20)
    assert 50 <= frame.where(maybe).count() < 60


def test_across_line_ends(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 20) for _ in range(4))
    mine, other = words(rng, 12, 9000), words(rng, 12, 9000)
    rows = [(1, f"{mine} {a}\n{b}\n{c} {other}"), (2, f"x {a}\n\n{b}\n{c} y"), (3, f"v {a} {b} {c} {d} y\nz")]
    assert found(spark, rows) == {1: (rows[0][1], 0), 2: ("x\ny", 2), 3: (f"v {d} y\nz", 0)}


def test_odd_rows(spark):
    rng = random.Random(4)
    one = words(rng, 60)
    rows = [(1, None), (2, ""), (3, one), (3, one), (4, one), (None, one + "\n\n"), (5, "\n".join(["x"] * 5000)), (6, " \n\t\n"), (7, words(rng, 60000, 10**6))]
    got = line_dedup.apply(documents(spark, rows))
    texts = sorted((str(r["doc_id"]), r["text"], r["lines_removed"]) for r in got.collect())
    want = [("1", None, 0), ("2", "", 0), ("3", "", 1), ("3", "", 1), ("4", "", 1), ("None", one + "\n\n", 0), ("5", "\n".join(["x"] * 50), 4950), ("6", " \n\t\n", 0), ("7", rows[-1][1], 0)]
    assert texts == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert got.columns[:-1] == documents(spark, []).columns and line_dedup.apply(documents(spark, []).limit(0)).count() == 0
    # columns named as those that the operator uses inside
    df = spark.createDataFrame([(1, one, 5, "k", [1], "s", 2), (2, one, 6, "l", [2], "t", 3)], "doc_id long, text string, lines_removed int, __key string, __spans array<int>, spans string, `a.b` int")
    got = {r["doc_id"]: r for r in line_dedup.apply(df).collect()}
    assert (got[2]["text"], got[2]["lines_removed"], got[2]["__key"], got[2]["__spans"], got[2]["spans"], got[2]["a.b"]) == ("", 1, "l", [2], "t", 3)
    assert got[1]["text"] == one and got[1]["lines_removed"] == 0


def test_words():
    rng = random.Random(3)
    for size in (16, 64, 1 << 18):
        for _ in range(80):
            texts = ["".join(rng.choice("ab  \n\t\x0b\x1c\x85\xa0   　éß日€ x") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 8))]
            line_dedup.CHUNK, kept = size, line_dedup.CHUNK
            try:
                many = [int(n) for _, w in line_dedup.chunks(pa.array([*texts, "z"]).slice(0, len(texts))) for n in np.diff(w.at)]
            finally:
                line_dedup.CHUNK = kept
            assert many == [len(t.split()) for t in texts]
    t = " ".join(["alpha", "q" * 5000, "beta", "alpha", "q" * 5000])
    data = np.frombuffer(t.encode(), np.uint8)
    h = line_dedup.hashes(data, *line_dedup.bounds(data, np.array([0, len(data)])))
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
