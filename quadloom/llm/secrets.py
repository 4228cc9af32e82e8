"""Secrets by fixed patterns and corpus-wide ownership frequency.

Every document gives its base matches and further candidates: long words that mix letters and
digits with high entropy.  A candidate's value is hashed, and the distinct owners
that hold the value are counted over the whole corpus.  A value held by more than MAX_OWNERS owners
is a widely copied example; the rest look live, however many documents of their owners hold them.  Base spans are always
reported; a further candidate is a span (kind `entropy`) only if it looks live.

Values that very many documents hold are counted from distinct (value, owner) rows
with partial sums a task; no value's places are gathered.

Defined results: null text is empty; an empty text has no spans; very long texts are read whole, in linear time; a null owner counts as one of its own; rows
that repeat both doc_id and text get the same result and count once; spans that start together are listed by kind; an empty table gives no rows;
extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, named, row_key, small, text_of

KINDS = ("assign", "access", "hex")
MAX_OWNERS = 2

# The base patterns; either case is spelt out, so that no letter beyond ASCII folds into them.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: A shorter run can't reach the 24 characters, so asking for them at once finds the same matches.
HEX = re.compile(r"[0-9a-f]{24,}")
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value), in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    out.sort()
    return out


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates outside the base spans."""
    out, n = [], 0
    for m in LOOSE.finditer(text):
        s, e = m.start(), m.end()
        while n < len(base) and base[n][2] <= s:
            n += 1
        if any(b[0] < e and b[2] > s for b in base[n : n + 3]):
            continue
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v) and entropy(v) >= 3.5:
            out.append((s, 3, e, v))
    return out


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Rows (id_col, n_assign, n_access, n_hex, base_sha256, spans, live, n_examples), one for each row of `df`.

    spans: all spans; live: those whose value looks live; n_examples: base spans that are widely copied.
    """
    names = (*KINDS, "entropy")

    def run(batch):
        counts, sha, cands = [[], [], []], [], []
        for t in batch.column(3).to_pylist():
            base = base_spans(t)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            cands.append([{"kind": k, "s": s, "e": e, "v": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for s, k, e, v in sorted(base + loose_spans(t, base))])
        out = {"doc": batch.column(0), "key": batch.column(1), "owner": batch.column(2)}
        out |= {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)}
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("v", pa.int64())]))
        return out | {"base_sha256": pa.array(sha, pa.string()), "cands": pa.array(cands, kind)}

    of = lambda c: df.schema[c].dataType.simpleString()
    rows = df.select(named(id_col).alias("doc"), row_key(id_col, text_col).alias("key"), F.coalesce(named(owner_col).cast("string"), F.lit("\0")).alias("owner"), text_of(text_col).alias("text"))
    rows = cut(arrow_map(rows, run, f"doc {of(id_col)}, key long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, cands array<struct<kind: int, s: long, e: long, v: long>>"))
    each = rows.where(F.size("cands") > 0).select("key", "owner", F.explode("cands").alias("c")).select("key", "owner", "c.*")
    freq = each.select("v", "owner").distinct().groupBy("v").agg(F.count("*").alias("owners"))
    wide = freq.where(F.col("owners") > max_owners).select("v", F.lit(True).alias("wide"))
    told = each.select("key", "kind", "s", "e", "v").distinct().join(small(cut(wide)), "v", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    told = told.where(~F.col("wide") | (F.col("kind") < 3)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e", "wide"))).alias("all"))
    name = lambda x: F.element_at(F.array(*map(F.lit, names)), x["kind"] + 1)
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")
    out = rows.join(told, "key", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<s: long, kind: int, e: long, wide: boolean>>)")))
    return out.select(
        F.col("doc").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", text(F.col("all")).alias("spans"),
        text(F.filter("all", lambda x: ~x["wide"])).alias("live"), F.size(F.filter("all", lambda x: x["wide"])).cast("long").alias("n_examples"),
    )
