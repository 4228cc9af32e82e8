"""Line dedup by winnowing.

A passage of at least MIN_WORDS words goes where it also stands at an earlier place, in order of
(doc_id, row key, word); the first place stays whole.  Passages are runs of words, wherever lines
begin and end, so one whose ends are joined to other text is found as well.

Fingerprints.  Each window of MIN_WORDS words selects the least hash of the runs of `gram()` words in
it, ties the rightmost; a window's choice depends on nothing around it, so two copies of one
select the same, and every repeated passage has a fingerprint.  Windows in a row that select one place
are a stretch: one row with the fingerprint and the hash of all words of the stretch.

Positions.  Fingerprints that stand at one place only end here; the places of the others are joined.

Extension.  A stretch that stands whole at an earlier place agrees with it to both its ends.  Where the
stretches around one fingerprint differ, the first of each kind are laid out window by window, from
the fingerprint to both ends, and compared.  Matches of neighbouring fingerprints overlap, so a match
reaches both ways, word by word and across line ends, as far as the texts agree.

Deletion.  Later places go.  A run that overlaps its own first place (a text that repeats itself with a
short period) loses what lies beyond that place.  Lines all of whose words go go as a whole, and so do blank
lines between two words of one match; of other lines the words that go do, with the white space after them,
and the white space at the line's end with them.  Parts of a line of fewer than MIN_PIECE words stay, since so few agree by
chance next to a match.  White space within and between lines doesn't count in comparisons.

A passage that very many documents share is one partial aggregate a task and one row of a join;
no list of its places is ever gathered.  Lists are gathered by document only, and are shorter than its text.

Defined results: null text is empty, kept as null in the text column; empty texts and texts of fewer than
MIN_WORDS words lose nothing; very long texts are read whole, their hashes in chunks; rows that repeat both
doc_id and text are one document and get the same result; of other ties on doc_id the row key decides; a null doc_id is before all others;
blank lines at the ends of what goes stay; an empty table gives an empty one; extra columns are kept by `apply` whatever their names, but
one named `lines_removed` gives way to the count of lines gone as a whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map, bits, cut, map_columns, named, row_key, sieve, small, text_of, unused

MIN_WORDS = 50
#: Words of a part of a line that goes, at least.
MIN_PIECE = 3
#: Bytes of text hashed at once.
CHUNK = 1 << 18
#: A word of more bytes is hashed on its own.
LONG = 4096

WORD = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15
LETTERS = bits(np.arange(1, 257, dtype=np.uint64))
SPACE = np.zeros(256, bool)
SPACE[list(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")] = True
# White space beyond ASCII, as UTF-8.
WIDE_SPACE = {2: [0xC285, 0xC2A0], 3: [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n at least, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            full = np.full(n + n // 4, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """The words of some texts, one after another: hashes of any runs of them, and where each text begins."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: UTF-8; ends: where each text begins in it, and the end of the last."""
        start, stop = bounds(data, ends)
        h = hashes(data, start, stop)
        up, self.down = powers(len(h) + 1)
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.total[1:])
        self.at = np.searchsorted(start, ends)

    def of(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from `first` up to before `stop`."""
        return bits((self.total[stop] - self.total[first]) * self.down[first] + (stop - first).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words; those across two texts mean nothing."""
        return bits((self.total[k:] - self.total[:-k]) * self.down[: len(self.total) - k])


def bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the one behind its last."""
    space = SPACE[data]
    for size, codes in WIDE_SPACE.items():
        lead = np.flatnonzero(np.isin(data, np.unique([c >> 8 * (size - 1) for c in codes]).astype(np.uint8)))
        if len(lead):
            code = sum(data[lead + n].astype(np.int64) << 8 * (size - 1 - n) for n in range(size))
            for n in range(size):
                space[lead[np.isin(code, codes)] + n] = True
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = ends[:-1] < ends[1:]
    first[ends[:-1][full]] = word[ends[:-1][full]]
    last[ends[1:][full] - 1] = word[ends[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of words, by sums over their bytes."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(stop, start[at] + CHUNK, "right")))
        a, b = start[at], stop[to - 1]
        if b - a <= CHUNK:
            up, down = powers(CHUNK + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(LETTERS[data[a:b]] * up[: b - a], out=total[1:])
            s, e = start[at:to] - a, stop[at:to] - a
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    for n in np.flatnonzero(stop - start > LONG).tolist():
        out[n] = xxhash.xxh64_intdigest(data[start[n] : stop[n]].tobytes())
    return bits(out)


def chunks(texts: pa.Array):
    """Yields (row of the first text, Words) of runs of texts of about CHUNK bytes; nulls aren't expected."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, Words(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def gram(min_words: int) -> int:
    """Words of a run that may be a fingerprint."""
    return max(1, min_words // 4)


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of `width` values, ties the rightmost."""
    place, size = np.arange(len(x), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(x[b] <= x[a], b, a)
        size += step
    return place


def stretches(words: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """Text, first and last window, fingerprint, and hash of all words, of each stretch."""
    k = gram(min_words)
    begin, many = words.at[:-1], np.diff(words.at)
    fits = many >= min_words
    if not fits.any():
        return (np.zeros(0, np.int64),) * 5
    grams = words.grams(k)
    place = least_places(grams, min_words - k + 1)
    # windows within one text: between its first word and min_words before its end
    edge = np.zeros(len(words.total) + 1, np.int32)
    np.add.at(edge, begin[fits], 1)
    np.add.at(edge, begin[fits] + many[fits] - min_words + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[: len(place)]))
    chosen = place[window]
    new = np.ones(len(window), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    opens = np.zeros(len(words.total) + 1, bool)
    opens[begin[fits]] = True
    new |= opens[window]
    heads = np.flatnonzero(new)
    first, last = window[heads], window[np.concatenate([heads[1:], [len(window)]]) - 1]
    text = np.searchsorted(words.at, first, "right") - 1
    content = words.of(first, last + min_words)
    return text, first - words.at[text], last - words.at[text], grams[chosen[heads]].view(np.int64), content.view(np.int64)


def _keyed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return df.select(named(id_col).alias("doc"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))


def _all_stretches(df: DataFrame, min_words: int, text_col: str, id_col: str) -> DataFrame:
    def run(batch):
        found = [(at, stretches(w, min_words)) for at, w in chunks(batch.column(2))]
        take = pa.array(np.concatenate([at + x[0] for at, x in found]))
        first, last, low, content = (np.concatenate([x[n] for _, x in found]) for n in range(1, 5))
        out = {"doc": batch.column(0).take(take), "key": batch.column(1).take(take)}
        return out | {"first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32)), "low": pa.array(low), "content": pa.array(content)}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(_keyed(df, text_col, id_col), run, f"doc {kind}, key long, first int, last int, low long, content long")


def _pack(first, last):
    return F.shiftleft(first.cast("long"), 32) + last.cast("long")


def _unpack(packed) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(packed, np.int64)
    return x >> 32, x & 0xFFFFFFFF


def _semi(df: DataFrame, keys: DataFrame, on: list[str], hash_) -> DataFrame:
    """Rows of `df` whose `on` is among the keys; where the keys are too many to broadcast, rows that a map of them rules out aren't shuffled."""
    held, names = small(keys), df.columns
    if held is keys:
        maybe, df = sieve(df, hash_, keys, hash_)
        df = df.where(maybe)
    return df.join(held, on, "left_semi").select(*names)


def _same_row(a: DataFrame, b: DataFrame, doc: str = "doc", key: str = "key"):
    return (a[key] == b["_key"]) & a[doc].eqNullSafe(b["_doc"])


def _laid_out(df: DataFrame, places: DataFrame, min_words: int, text_col: str, id_col: str) -> DataFrame:
    """Rows (doc, key, first, low, window) of all windows in the stretches at `places` (_doc, _key, spots, lows)."""

    def run(batch):
        texts, every, lows = batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        rows, firsts, seen, found = [], [], [], []
        for at, words in chunks(texts):
            for n in range(len(words.at) - 1):
                a, b = _unpack(every[at + n])
                many = b - a + 1
                mine = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
                rows.append(np.full(len(mine), at + n))
                firsts.append(mine)
                seen.append(np.repeat(np.array(lows[at + n], np.int64), many))
                found.append(words.of(words.at[n] + mine, words.at[n] + mine + min_words).view(np.int64))
        take = pa.array(np.concatenate(rows))
        out = {"doc": batch.column(0).take(take), "key": batch.column(1).take(take), "first": pa.array(np.concatenate(firsts).astype(np.int32))}
        return out | {"low": pa.array(np.concatenate(seen)), "window": pa.array(np.concatenate(found))}

    kind = df.schema[id_col].dataType.simpleString()
    keyed = _keyed(df, text_col, id_col)
    held = small(places)
    if held is places:  # most texts have no such place, and need not be shuffled
        maybe, keyed = sieve(keyed, F.col("key"), places, F.col("_key"))
        keyed = keyed.where(maybe)
    joined = keyed.join(held, _same_row(keyed, places)).select("doc", "key", "text", "spots", "lows")
    return arrow_map(joined, run, f"doc {kind}, key long, first int, low long, window long")


def _later(places: DataFrame, homes: DataFrame, by: list[str], stop, min_words: int) -> DataFrame:
    """Rows (doc, key, span) of the places that are copies of an earlier one; where they overlap it, from the end of its first window on.

    Both sides grow with the corpus, so it is a shuffled join at every size; Spark splits it at a passage that very many documents share.
    """
    both = places.join(homes, by).where(F.struct("doc", "key", "first") > F.struct("home.doc", "home.key", "home.first"))
    own = F.col("home.doc").eqNullSafe(F.col("doc")) & (F.col("home.key") == F.col("key"))
    both = both.select("doc", "key", F.when(own, F.greatest("first", F.col("home.first") + min_words)).otherwise(F.col("first")).alias("start"), stop.alias("stop"))
    return both.where("start < stop").select("doc", "key", _pack(F.col("start"), F.col("stop")).alias("span"))


def _merged(batch):
    """Spans that overlap made one."""
    out = []
    for packed in batch.column(2).to_pylist():
        mine: list[list[int]] = []
        for a, b in zip(*(x.tolist() for x in _unpack(sorted(packed)))):
            if mine and a < mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
        out.append([(a << 32) + b for a, b in mine])
    return {"_doc": batch.column(0), "_key": batch.column(1), "spans": pa.array(out, pa.list_(pa.int64()))}


def repeated_spans(df: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (_doc, _key, spans array<long>): by id and row key, the words that go, first << 32 | one beyond the last."""
    kind = df.schema[id_col].dataType.simpleString()
    every = Stored(_all_stretches(df, min_words, text_col, id_col))
    seen = cut(every.df.groupBy("low").agg(F.count("*").alias("n")).where("n > 1").select("low"))
    met = Stored(_semi(every.df, seen, ["low"], F.xxhash64("low")))
    every.drop()
    # checkpointed, so that the joins are by broadcast, or ones that Spark can split at a hot passage
    here = F.struct("doc", "key", "first", "last")
    each = cut(met.df.groupBy("low", "content").agg(F.min(here).alias("home"), F.count("*").alias("n")))
    whole = _later(met.df, cut(each.where("n > 1").select("low", "content", "home")), ["low", "content"], F.col("last") + min_words, min_words)
    mixed = cut(each.groupBy("low").agg(F.count("*").alias("n")).where("n > 1").select("low"))
    places = each.join(small(mixed), "low", "left_semi").select("home.doc", "home.key", F.struct(_pack(F.col("home.first"), F.col("home.last")).alias("spot"), "low").alias("x"))
    places = places.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list("x").alias("x"))
    windows = Stored(_laid_out(df, cut(places.select("_doc", "_key", F.col("x.spot").alias("spots"), F.col("x.low").alias("lows"))), min_words, text_col, id_col))
    homes = windows.df.groupBy("low", "window").agg(F.min(F.struct("doc", "key", "first")).alias("home"), F.count("*").alias("n")).where("n > 1").select("low", "window", "home")
    part = _later(windows.df, cut(homes), ["low", "window"], F.col("first") + min_words, min_words)
    spans = whole.unionByName(part).groupBy("doc", "key").agg(F.collect_set("span").alias("spans"))
    out = cut(arrow_map(spans, _merged, f"_doc {kind}, _key long, spans array<long>"))
    met.drop()
    windows.drop()
    return out


def without(text: str, spans: list[int]) -> tuple[str, int]:
    """The text without the words of `spans`, and how many lines went as a whole."""
    match = np.zeros(len(text.split()) + 1, np.int64)  # the match that a word is in, from 1
    for n, (a, b) in enumerate(zip(*_unpack(spans)), 1):
        match[a:b] = n
    out, gone, at = [], 0, 0
    for line in text.split("\n"):
        many = len(line.split())
        mine = match[at : at + many] > 0
        if not many:
            inside = at > 0 and match[at] > 0 and match[at - 1] == match[at]
            gone += bool(inside)
            if not inside:
                out.append(line)
        elif mine.all():
            gone += 1
        elif not mine.any():
            out.append(line)
        else:
            words = [m.span() for m in WORD.finditer(line)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            done = False
            for a, b in reversed(edges.reshape(-1, 2).tolist()):
                if b - a >= MIN_PIECE:
                    line = line[: words[a][0]] + (line[words[b][0] :] if b < many else "")
                    done = True
            out.append(line.rstrip() if done else line)
        at += many
    return "\n".join(out), gone


def apply(df: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`df` with what goes taken from its text, and the column `lines_removed` (long) added."""
    spans = repeated_spans(df, min_words, text_col, id_col)
    names = [c for c in df.columns if c.lower() != "lines_removed"]
    key, of, own, held = (unused(df, n) for n in ("__key", "__of", "__doc", "__spans"))
    spans = spans.toDF(own, of, held)
    keyed = df.select(*map(named, names), row_key(id_col, text_col).alias(key))
    found = small(spans)
    on = (F.col(key) == F.col(of)) & named(id_col).eqNullSafe(F.col(own))
    if found is spans:  # texts that lose nothing need not be shuffled
        maybe, frame = sieve(keyed.select(*map(named, names), F.col(key)), F.col(key), spans, F.col(of))
        joined = frame.where(maybe).join(spans, on, "left").select(*map(named, names), held)
        joined = joined.unionByName(frame.where(~maybe).select(*map(named, names), F.lit(None).cast("array<bigint>").alias(held)))
    else:
        joined = keyed.join(found, on, "left")
    at = names.index(text_col)

    def run(cols, extra):
        spans = extra[0]
        gone = np.zeros(len(spans), np.int64)
        rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            new = []
            for n, text, own in zip(rows.tolist(), cols[at].take(pa.array(rows)).to_pylist(), spans.take(pa.array(rows)).to_pylist()):
                text, gone[n] = without(text or "", own)
                new.append(text)
            cols[at] = pc.replace_with_mask(cols[at], spans.is_valid(), pa.array(new, cols[at].type))
        return [*cols, pa.array(gone)]

    return map_columns(joined, names, [held], run, {"lines_removed": "long"})
