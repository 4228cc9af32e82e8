"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds.

Documents are tokenised and an end id is added; only those longer than a sequence are cut,
into full pieces and a last one.  Pieces are dealt to groups of bounded size, and each group
is packed by best-fit decreasing.  A dual-feasible function f (one for which sizes that fit a
bin have f-values of at most 1 in sum) bounds the bins that any packing of the group needs;
a group whose best-fit count equals its bound is certified and final.  Of every other group,
and of each group's emptiest bin, the pieces go back: they are dealt anew, across groups, and
packed again, until one group is left, a round gains nothing, or the rounds are used up.  Column `certified` tells of each
piece whether the group that it was last packed in met its bound; what isn't certified when the rounds end says so.

The tokeniser's ids are those of the tokenizers library for the whole text.  White space bounds
this vocabulary's tokens, so ids of blank-separated words are remembered by each worker; a new word is split into
pre-tokens here, and the library's model merges each.

Defined results: null text is empty, and a document without ids is its end id alone; texts are
read whole, however long; rows that repeat doc_id (null too) are documents of their own, told apart by nothing
in the output; pieces of equal length are packed in order of row key and piece; extra columns are ignored whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, hold, named, remember, row_key, text_of, vocabulary_path

#: Entries of each look-up store; a full one becomes the old one, from which what is met again moves on.
MEMORY = 200_000
#: The vocabulary's pre-tokens, after its lower-casing, and the characters that stand for the 256 bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(0x100) if b not in SHOWN)}


class Words(dict):
    """Ids of words, found when a word is first asked for."""

    def __init__(self, model, size: int):
        self.tokenize = model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(size)]
        self.split = regex.compile(PATTERN).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                parts = [word]
            elif (stem := word[:-1]).isalpha():  # what follows the letters is a pre-token, as it is one character
                parts = [stem, word[-1]]
            else:
                parts = self.split(word)
            if len(parts) == 1:
                seen = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
                four = self.four
                ids = b"".join([four[t.id] for t in self.tokenize(seen)])
            else:  # pre-tokens are kept as well: by themselves they are split no further
                ids = b"".join([self[p] for p in parts])
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts for a vocabulary whose tokens never hold white space."""

    #: Letters, digits and marks on which Python's and the library's case and space rules agree.
    PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏ–—‘-„•…€]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.special = tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        self.known = Words(self.full.model, self.full.get_vocab_size())
        probe = "It's naïve: 42 €-words, they'll ''do Ñandú"
        if self.encode(probe) != self._whole(probe):
            raise ValueError("the vocabulary's words aren't those of PATTERN")

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.PLAIN.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        known = self.known
        turn(known, known.old)
        return b"".join([known[w] for w in text.lower().split()])


def turn(store: dict, old: dict) -> None:
    """Make a full store the old one."""
    if len(store) > MEMORY:
        old.clear()
        old.update(store)
        store.clear()


_tokenizers: dict[str, WordTokenizer] = hold(__name__, {})


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, built once a worker."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, size: int, end_id: int, path: str, text_col: str, id_col: str) -> DataFrame:
    """Rows (doc, key, piece, start, length, ids_crc32) of all documents."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch):
        t = tokenizer(path)
        remember(t.known, t.known.old)
        at: list[int] = []
        cols: list[list[int]] = [[], [], [], []]
        for n, text in enumerate(batch.column(2).to_pylist()):
            data = t.encode(text) + end
            total = len(data) // 4
            for k, start in enumerate(range(0, total, size)):
                part = data[4 * start : 4 * (start + size)]
                at.append(n)
                for c, v in zip(cols, (k, start, len(part) // 4, zlib.crc32(part))):
                    c.append(v)
        take = pa.array(at, pa.int64())
        out = {"doc": batch.column(0).take(take), "key": batch.column(1).take(take)}
        return out | {n: pa.array(c, k) for n, c, k in zip(("piece", "start", "length", "ids_crc32"), cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(named(id_col).alias("doc"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text")), run, f"doc {kind}, key long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int, most: int = 32) -> int:
    """Bins of `size` that any packing needs: the best of two families of dual-feasible functions.

    The first, for every k up to half a bin, counts a piece above size - k as a whole bin, drops those below k
    and keeps the rest by length (k = 0 is the volume bound).  The second, for every k from 1 to `most`, rounds a
    piece down to the k + 1st parts of a bin that it spans, each worth a k-th, unless it spans them exactly.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    x = np.arange(size + 1)
    mass = np.cumsum(count * x)
    many = np.cumsum(count)
    k = np.arange(size // 2 + 1)
    big = many[size] - many[size - k]
    mid = mass[size - k] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    best = int((big + -(-mid // size)).max())
    for k in range(1, most + 1):
        parts, rest = np.divmod((k + 1) * x, size)
        worth = np.where(rest == 0, k * x, parts * size)
        best = max(best, -(-int((count * worth).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: of each piece its bin and offset, and of each bin what it holds.

    Bins are kept by free room, and a bit set finds the least room that suffices, so a piece
    costs the same however many bins there are.
    """
    order = np.argsort(-lengths, kind="stable")
    bin_of = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    have = 0  # bit r: some bin has room r
    used: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        above = have >> n
        if above:
            r = n + ((above & -above).bit_length() - 1)
            b = rooms[r].pop()
            if not rooms[r]:
                have &= ~(1 << r)
        else:
            b, r = len(used), size
            used.append(0)
        bin_of[i], offset[i] = b, size - r
        used[b] = size - r + n
        r -= n
        if r:
            rooms[r].append(b)
            have |= 1 << r
    return bin_of, offset, np.array(used, np.int64)


def _group_packer(size: int, last: bool):
    """Packs one group; pieces of bins that go back have a null bin."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "piece", "nth"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offset, used = best_fit(lengths, size)
        certified = len(used) == lower_bound(lengths, size)
        back = np.zeros(len(used), bool)
        if not last and len(used):
            # an uncertified group gives up all bins with room; a certified one only its emptiest
            back = used < size if not certified else (used == used.min()) & (used < size) & (np.arange(len(used)) == int(used.argmin()))
        out = pdf.assign(bin=bins, offset=offset, done=~back[bins], certified=certified)
        return out[["doc", "key", "nth", "piece", "start", "length", "ids_crc32", "grp", "bin", "offset", "done", "certified"]]

    return pack


def pack(df: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None, group: int = 2048, rounds: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pack all documents of `df`; rows (id_col, piece, start, length, ids_crc32, sequence_id, offset, certified).

    group: pieces that one task packs at once on average.  The number of groups follows the number of pieces,
    so a task's memory doesn't grow with the input.  A sequence_id names (round, group, bin).
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    kind = df.schema[id_col].dataType.simpleString()
    rest = cut(pieces(df, size, end_id, path, text_col, id_col).withColumn("nth", F.monotonically_increasing_id()))
    whole = rest.where(F.col("length") == size)
    done = [whole.select("doc", "piece", "start", "length", "ids_crc32", (-F.col("nth") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    rest = rest.where(F.col("length") < size)
    schema = f"doc {kind}, key long, nth long, piece int, start long, length long, ids_crc32 long, grp int, bin long, offset long, done boolean, certified boolean"
    before = None
    for step in range(rounds):
        n = rest.count()
        if n == 0:
            break
        groups = max(1, -(-n // group))
        last = groups == 1 or step == rounds - 1 or (before is not None and n > 0.9 * before)
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("key", "piece", "nth", F.lit(step)), F.lit(groups)).cast("int"))
        packed = cut(dealt.groupBy("grp").applyInPandas(_group_packer(size, last), schema))
        sequence = (F.lit(step).cast("long") * F.lit(1 << 58)) + F.col("grp").cast("long") * F.lit(1 << 26) + F.col("bin")
        done.append(packed.where("done").select("doc", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", "certified"))
        rest = packed.where("not done").select("doc", "key", "nth", "piece", "start", "length", "ids_crc32")
        before = n
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("doc", id_col)
