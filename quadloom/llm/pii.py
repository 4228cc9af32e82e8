"""Personal data by base patterns and a skip-chain conditional random field.

Base spans come from four fixed patterns, leftmost and non-overlapping a kind, with their checks
(parts of at most 255, Luhn, digit counts).  The field then labels every mention of a document,
the base spans and the loose ones: numbers of seven digits or more, words with an at sign or a
spelt-out one.  Labels are none, email, ip, card and phone.  Each mention has unary potentials
from its shape and the word before it, each next mention a chain potential, and mentions that
are equal or alike (same digits, one's last seven digits the other's, same mailbox)
share a skip potential, however far apart they are.  Loopy belief propagation passes
messages along both until none changes by more than SETTLED, damped after ROUNDS rounds and for MAX_ROUNDS at
most; a loose mention whose best label isn't none is a span
too, if it overlaps no base span.  Base spans are observed, so they stay.

All weights are fitted here, on mentions of a bounded sample of documents (SAMPLE, drawn by hash, a documented
parameter) with the base patterns as silver labels: unary ones by softmax regression, pair ones as log-odds of the
label pairs of chain and skip edges, with PRIOR_EDGES imagined skip edges that mostly agree, so that a corpus which
repeats few mentions has potentials as well.  Each base mail and phone number also teaches its loose spelling, as if its pattern were hidden, in its place;
loose mentions of those shapes that are alike to no base span are unlabelled and teach nothing.  So shape and
cue words can label a mention in a text without any base span.  Each mention likes its next twin and its next kin only, so a
number that a text repeats very often costs one edge a time.

Defined results: null text is empty (and stays null when masked), an empty text has no spans; texts are read whole in time linear in their
length; rows are handled each on their own, whatever repeats; overlapping spans are listed by start, then kind, and masked as one;
without any mention in the sample all weights are zero and only base spans come
out; an empty table gives no rows; extra columns are ignored by `find` and kept by `mask`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import arrow_map, map_columns, named, row_key, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 4000
#: Mentions that one document teaches at most, drawn by hash over the whole text.
PER_TEXT = 32
ROUNDS, MAX_ROUNDS = 64, 1000
SETTLED = 1e-6
#: Imagined skip edges, and the share of them whose ends agree.
PRIOR_EDGES, PRIOR_AGREES = 40.0, 0.98

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The base patterns.  The mail pattern is matched from its at sign outwards, and the
# address pattern as runs of dotted numbers taken by fours, which gives the same matches in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE_NUMBER = re.compile(r"\(?[0-9]+\)?(?:[ .\-][0-9]+)*")
AT_SIGN = re.compile(r"@|\[at\]|\(at\)")
#: What stands on both sides of an at sign, one blank between at most.
SIDE = re.compile(r" ?([^\s@()\[\]]+)")
NO_SIDE = frozenset("@()[]")
DIGITS = re.compile(r"[0-9]")
BEFORE = re.compile(r"([^\W\d_]+)\W*$")


def luhn(digits: str) -> bool:
    """The check sum of payment card numbers."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if n % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all base spans, in order."""
    out = []
    at, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > at and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append((s, 0, m.end()))
            at = m.end()
        else:
            at = p + 1
        p = text.find("@", at)
    if DIGITS.search(text):
        for m in DOTTED.finditer(text):
            if text.find(".", m.start(), m.end()) < 0:
                continue
            parts = m[0].split(".")
            where = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                    out.append((where, 1, where + size))
                where += size + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def loose_mails(text: str) -> list[tuple[int, int]]:
    """Words around an at sign or a spelt-out one, leftmost and non-overlapping; matched outwards from the signs."""
    out, at = [], 0
    for m in AT_SIGN.finditer(text) if "@" in text or "(at)" in text or "[at]" in text else ():
        s = m.start() - (m.start() > at and text[m.start() - 1] == " ")
        end = s
        while s > at and not text[s - 1].isspace() and text[s - 1] not in NO_SIDE:
            s -= 1
        right = SIDE.match(text, m.end()) if s < end else None
        if right:
            out.append((s, right.end()))
            at = right.end()
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, observed label or -1): base spans and the loose mentions beside them, in order."""
    found = [(s, e, k + 1) for s, k, e in base]
    found += [(s, e, -1) for s, e in loose_mails(text)]
    if DIGITS.search(text):
        found += [(m.start(), m.end(), -1) for m in LOOSE_NUMBER.finditer(text) if len(DIGITS.findall(m[0])) >= 7]
    found.sort(key=lambda x: (x[2] < 0, x[0], -x[1]))
    taken: list[tuple[int, int, int]] = []
    if len(found) > len(base):
        # a loose mention must overlap neither a base span nor a loose one before it
        import bisect

        starts: list[int] = []
        ends: list[int] = []
        for s, e, _ in sorted(x for x in found if x[2] > 0):
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        last = -1
        for s, e, y in found:
            if y > 0:
                taken.append((s, e, y))
                continue
            n = bisect.bisect_left(starts, e) - 1
            if s >= last and (n < 0 or ends[n] <= s):
                taken.append((s, e, y))
                last = e
        taken.sort()
        return taken
    return found


CUES = ("mail", "tel", "phone", "call", "fax", "card", "ip", "address", "number")
N_FEATURES = 24
AT = re.compile(r" ?(?:\[at\]|\(at\)) ?")
SPELT = re.compile(rf"[A-Za-z0-9._%+-]++{AT.pattern}{DOMAIN.pattern}\W*+")
GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}")
COUNTRY = re.compile(r"\+[0-9]+[ .-]?")


def features(text: str, start: int, end: int) -> np.ndarray:
    """Shape of a mention and the word before it, each feature 0 or 1."""
    s = text[start:end]
    d = "".join(DIGITS.findall(s))
    x = np.zeros(N_FEATURES)
    x[0] = 1
    x[1] = "@" in s
    x[2] = s.startswith("+")
    x[3] = "(" in s
    x[4] = s.count(".") == 3 and not re.search(r"[^0-9.]", s) and all(0 < len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    x[5] = 12 <= len(d) <= 19 and luhn(d)
    x[6 + (0 if len(d) < 7 else 1 if len(d) < 9 else 2 if len(d) < 12 else 3 if len(d) <= 15 else 4 if len(d) <= 19 else 5)] = 1
    m = BEFORE.search(text, max(0, start - 24), start)
    word = m[1].lower() if m else ""
    for n, c in enumerate(CUES):
        x[12 + n] = word.startswith(c)
    x[21] = len(d) == len(s)
    x[22] = bool(SPELT.fullmatch(s))
    x[23] = bool(GROUPED.fullmatch(s))
    return x


def loosened(s: str, label: int) -> str:
    """The loose spelling of a base mail or phone number; empty if it has none."""
    if label == 1:
        return " (at) ".join(s.rsplit("@", 1))
    if label == 4:
        rest = COUNTRY.sub("", s, count=1)
        return rest if LOOSE_NUMBER.fullmatch(rest) and len(DIGITS.findall(rest)) >= 7 else ""
    return ""


def likeness(text: str, start: int, end: int) -> tuple[str, str]:
    """Keys of a mention: equal ones are the same value, and equal kin keys are alike."""
    s = text[start:end].lower()
    d = "".join(DIGITS.findall(s))
    if "@" in s or "(at)" in s or "[at]" in s:
        box = re.split(r" ?(?:@|\[at\]|\(at\)) ?", s, maxsplit=1)
        return "m" + "@".join(box), "h" + box[0]
    return "d" + d, "t" + d[-7:]


class Field:
    """Potentials of the skip-chain field, in logs."""

    def __init__(self, unary=None, chain=None, twin=None, kin=None):
        k = len(LABELS)
        self.unary = np.zeros((N_FEATURES, k)) if unary is None else unary
        self.chain = np.zeros((k, k)) if chain is None else chain
        self.twin = np.zeros((k, k)) if twin is None else twin
        self.kin = np.zeros((k, k)) if kin is None else kin
        self.trained = unary is not None

    def edges(self, text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(left, right, kind of edge): chain 0, twins 1, kin 2."""
        out = [(n, n + 1, 0) for n in range(len(found) - 1)]
        last: dict[str, int] = {}
        for n, (s, e, _) in enumerate(found):
            same, kin = likeness(text, s, e)
            if same in last:
                out.append((last[same], n, 1))
            elif kin in last:
                out.append((last[kin], n, 2))
            last[same] = last[kin] = n
        return out

    def beliefs(self, unary: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Label marginals by loopy sum-product messages; exact where the edges form a forest of at most ROUNDS in width."""
        if not edges:
            return softmax(unary)
        a, b, kind = (np.array(x, np.int64) for x in zip(*edges))
        table = np.stack([self.chain, self.twin, self.kin])[kind]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([table, table.transpose(0, 2, 1)])  # [edge, from, to]
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), unary.shape[1]))
        for n in range(MAX_ROUNDS):
            total = unary.copy()
            np.add.at(total, dst, msg)
            into = (total[src] - msg[back])[:, :, None] + table
            new = logsum(into, 1)
            new -= new.max(axis=1, keepdims=True)
            new = 0.5 * (new + msg) if n >= ROUNDS else new
            moved = np.abs(new - msg).max()
            msg = new
            if moved < SETTLED:
                break
        total = unary.copy()
        np.add.at(total, dst, msg)
        return softmax(total)

    def label(self, text: str, found: list[tuple[int, int, int]]) -> list[int]:
        """Best label of each mention; observed ones keep theirs."""
        unary = np.stack([features(text, s, e) for s, e, _ in found]) @ self.unary
        for n, (_, _, y) in enumerate(found):
            if y >= 0:
                unary[n] = -1e3
                unary[n, y] = 0.0
        p = self.beliefs(unary, self.edges(text, found))
        return [y if y >= 0 else int(p[n].argmax()) for n, (_, _, y) in enumerate(found)]


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def evidence(text: str) -> tuple[list[int], list[int], list[int]] | None:
    """What a text teaches: its mentions' features (as bits), silver labels, and its edges' (kind, label, label) as numbers."""
    found = mentions(text, base_spans(text))
    if not found:
        return None
    k = len(LABELS)
    labels = [max(y, 0) for _, _, y in found]
    links = Field().edges(text, found)
    for a, b, kind in links:
        # a loose mention alike to an observed one is what the field is to find: it takes that label
        if kind and 0 in (labels[a], labels[b]):
            labels[a] = labels[b] = max(labels[a], labels[b])
    hashes = [xxhash.xxh64_intdigest(f"{n}:{text[s:e]}".encode("utf-8", "surrogatepass")) for n, (s, e, _) in enumerate(found)]
    drawn = set(sorted(range(len(found)), key=hashes.__getitem__)[:PER_TEXT])
    # an edge is taught with its left mention
    links = [x for x in links if x[0] in drawn]
    shapes = {n: features(text, *found[n][:2]) for n in drawn | {b for _, b, _ in links}}
    told = {n: labels[n] > 0 or not (x[22] or x[23]) for n, x in shapes.items()}
    edges = [(kind * k + labels[a]) * k + labels[b] for a, b, kind in links if told[a] and told[b]]
    taught = [(shapes[n], labels[n]) for n in sorted(drawn) if told[n]]
    for s, e, y in (found[n] for n in sorted(drawn)):
        if loose := loosened(text[s:e], y):
            before = text[max(0, s - 24) : s]
            taught.append((features(before + loose, len(before), len(before) + len(loose)), y))
    return [int(sum(1 << n for n in np.flatnonzero(x).tolist())) for x, _ in taught], [y for _, y in taught], edges


def fit(taught: list[tuple[list[int], list[int], list[int]]]) -> Field:
    """Fit the field on the evidence of some texts."""
    k = len(LABELS)
    bits = np.array([b for x, _, _ in taught for b in x], np.int64)
    ys = [y for _, y, _ in taught for y in y]
    same = np.eye(k, dtype=bool)
    agree = PRIOR_EDGES * np.where(same, PRIOR_AGREES / k, (1 - PRIOR_AGREES) / (k * (k - 1)))
    pairs = np.concatenate([np.full(k * k, 0.5), agree.ravel(), agree.ravel()])
    np.add.at(pairs, np.array([e for _, _, x in taught for e in x], np.int64), 1)
    pairs = pairs.reshape(3, k, k)
    if len(set(ys)) < 2:
        return Field()
    x, y = ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(float), np.eye(k)[ys]
    w = np.zeros((x.shape[1], k))
    for _ in range(300):
        w -= 0.5 * (x.T @ (softmax(x @ w) - y) / len(x) + 1e-3 * w)
    pairs = (pairs + pairs.transpose(0, 2, 1)) / 2
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    odds = np.log(joint / (joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)))
    return Field(w, *odds)


def spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each (start, kind, end)."""
    base = base_spans(text)
    if not field.trained:
        return base, base
    found = mentions(text, base)
    if len(found) == len(base):
        return base, base
    labels = field.label(text, found)
    added = [(s, y - 1, e) for (s, e, seen), y in zip(found, labels) if seen < 0 and y > 0]
    return base, sorted(base + added)


def train(df: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> Field:
    """Fit on at most `sample` documents with mentions, drawn by hash; only their evidence, a few numbers each, is fetched."""

    def run(batch):
        got = [(k, x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := evidence(t))]
        cols = [pa.array([x[n] for _, x in got], pa.list_(pa.int64())) for n in range(3)]
        return {"k": pa.array([k for k, _ in got], pa.int64()), "bits": cols[0], "labels": cols[1], "edges": cols[2]}

    told = arrow_map(df.select(row_key(id_col, text_col).alias("k"), text_of(text_col).alias("t")), run, "k long, bits array<long>, labels array<long>, edges array<long>")
    rows = told.orderBy("k", "bits", "labels").limit(sample).collect()
    return fit([(r["bits"], r["labels"], r["edges"]) for r in rows])


def rendered(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Rows (id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans); counts by kind are of base spans."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, sample, text_col, id_col))

    def run(batch):
        field, counts, sha, every, total = shared.value, [[], [], [], []], [], [], []
        for t in batch.column(1).to_pylist():
            base, full = spans(t, field)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(rendered(base).encode()).hexdigest())
            every.append(rendered(full))
            total.append(len(full))
        out = {id_col: batch.column(0)} | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)}
        return out | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array(every, pa.string()), "n_spans": pa.array(total, pa.int64())}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(named(id_col), text_of(text_col).alias("_text")), run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go as one."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """`df`, all rows and columns, with the spans in its text masked."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, sample, text_col, id_col))
    at = df.columns.index(text_col)

    def run(cols, _):
        field = shared.value
        cols[at] = pa.array([t and masked(t, spans(t, field)[1]) for t in cols[at].to_pylist()], cols[at].type)
        return cols

    return map_columns(df, df.columns, [], run)
