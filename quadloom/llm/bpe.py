"""BPE encoding by longest matches with backtracking, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary's byte strings gives every token that starts
at each place of a pre-token.  A left-to-right walk takes the longest one that may stand
after the token before it and steps back where none can.  Two tokens may stand side by side
iff BPE, run on their joined bytes, would keep that border: the pair table answers this from
the merge ranks, and remembers its answers.  A sequence whose neighbours all are compatible
is the merge result, so no merge is ever replayed.  Decoding copies byte ranges out of one
table: all tokens' bytes end to end, and where each begins.

Defined results: null text is the empty text (no ids); texts are encoded whole whatever
their length; repeated rows, and rows that share a null or other id, are encoded each on their own; where merges tie the left one
is made first; the special token's string in a text is that token, as the tokenizers library has it; an empty
table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hold, named, remember, text_of, vocabulary_path

#: The pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most entries that a worker remembers before it starts anew.
MEMORY = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files write each byte, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.ids = ids
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left, right) -> rank of the merge; token -> (rank, left, right) of the merge that makes it
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(merges):
            x, y = ids[raw(a)], ids[raw(b)]
            self.rank[x, y] = n
            self.made.setdefault(ids[raw(a) + raw(b)], (n, x, y))
        size = max([*ids.values(), *self.special.values()]) + 1
        by_id = [b""] * size
        for s, i in ids.items():
            by_id[i] = s
        for s, i in self.special.items():
            by_id[i] = s.encode()
        self.by_id = by_id
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s.decode("latin-1"), (len(s), i))
        self.automaton.make_automaton()
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in by_id])]).astype(np.int64)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN)
        # white space bounds pre-tokens but for one leading blank, so a blank and the letters after it are one piece
        self.pieces = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between tokens a and b.

        Undo merges from the latest to the earliest.  At each point the tokens that touch the
        border are (x, y); had a merge of them come before the merge that was undone last,
        it would have crossed the border.  On equal ranks the left one is made first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, made = self.rank, self.made
        x, y, since, left = a, b, 1 << 60, False
        while True:
            crossing = rank.get((x, y))
            # the merge undone last had rank `since`; a crossing merge wins if earlier, or as early but further left
            if crossing is not None and (crossing < since or crossing == since and not left):
                known = False
                break
            rx, ry = made.get(x), made.get(y)
            if rx is None and ry is None:
                known = True
                break
            if ry is None or rx is not None and rx[0] > ry[0]:
                since, left, x = rx[0], True, rx[2]
            else:
                since, left, y = ry[0], False, ry[1]
        if len(self.pairs) > MEMORY:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        data = word.encode("utf-8")
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(data.decode("latin-1")):
            starts[end - size + 1].append((size, i))  # shorter ones come first
        out: list[int] = []
        sizes: list[int] = []
        dead = bytearray(n + 1)  # places from which no rest can be encoded
        at, choice = 0, len(starts[0]) - 1
        tries: list[int] = []
        while at < n:
            options, placed = starts[at], False
            while choice >= 0:
                size, i = options[choice]
                if not dead[at + size] and (not out or self.compatible(out[-1], i)):
                    out.append(i)
                    sizes.append(size)
                    tries.append(choice)
                    at += size
                    choice = len(starts[at]) - 1 if at < n else -1
                    placed = True
                    break
                choice -= 1
            if not placed:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                at -= sizes.pop()
                out.pop()
                choice = tries.pop() - 1
        return tuple(out)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        words = self.words
        for w in self.split.findall(chunk):
            got = words.get(w)
            if got is None:
                got = self.encode_word(w)
                if len(w) < 64:
                    if len(words) > MEMORY:
                        words.clear()
                    words[w] = got
            ids.extend(got)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self.cut_special is not None and (parts := self.cut_special.split(text))[1:]:
            return np.concatenate([np.array([self.special[p]], "<u4") if p in self.special else self.encode(p) for p in parts])
        chunks, out = self.chunks, []
        for c in self.pieces.findall(text):
            got = chunks.get(c)
            if got is None:
                got = self._chunk(c)
                if len(c) < 64:
                    if len(chunks) > MEMORY:
                        chunks.clear()
                    chunks[c] = got
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: byte ranges of the table, in the order of the ids."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(sizes)
        data = self.blob[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        try:
            data.decode("utf-8")
            return data
        except UnicodeDecodeError:  # ids that don't come from a text
            return data.decode("utf-8", errors="replace").encode("utf-8")


_codecs: dict[str, Codec] = hold(__name__, {})


def codec(path: str) -> Codec:
    """The codec of a file, built once a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    c = _codecs[path]
    remember(c.words, c.chunks, c.pairs)
    return c


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row a row of `df`: id_col, ids array<long>, decoded string."""
    path = path or vocabulary_path("byte_bpe_50k.json")

    def run(batch):
        c = codec(path)
        ids = [c.encode(t) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "ids": pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), "decoded": pa.array([c.decode(x).decode("utf-8") for x in ids], pa.string())}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(named(id_col), text_of(text_col).alias("_text")), run, f"`{id_col}` {kind}, ids array<long>, decoded string")


def encode_digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """As `encode`, but only n_tokens and digests leave the task: texts and ids are not carried on."""
    path = path or vocabulary_path("byte_bpe_50k.json")

    def run(batch):
        c = codec(path)
        n, a, b = [], [], []
        for t in batch.column(1).to_pylist():
            ids = c.encode(t)
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(named(id_col), text_of(text_col).alias("_text")), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
