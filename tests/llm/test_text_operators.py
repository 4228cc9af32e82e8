"""Operators on texts against brute-force versions, with the odd rows that each must take."""

import random
import zlib

import numpy as np
import pytest

from quadloom.llm import bpe, html_text, ngram_join, packing, pii, secrets
from quadloom.llm.common import components, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, grp string, score double, owner string"


def documents(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, 2, "g", 0.5, "o") for i, t in rows], DOCS).repartition(3)


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n "), (7, "one two"), (7, "one two"), (None, words(rng, 80)), (8, words(rng, 30000, 50000)), (9, "one two"), (10, words(rng, 4))]
    return rows + [(20 + n, words(rng, rng.randrange(5, 900))) for n in range(20)]


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    rows = packing.pack(documents(spark, odd), group=8).collect()
    want = {}
    for i, text in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append(ids)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, docs in want.items():
        expected = [(k, s, len(d[s : s + 4096]), zlib.crc32(np.array(d[s : s + 4096], "<u4").tobytes())) for d in docs for k, s in enumerate(range(0, len(d), 4096))]
        assert sorted(got[i]) == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 4096) + 1
    assert packing.pack(documents(spark, odd).limit(0)).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, offset, used = packing.best_fit(x, 100)
        assert used.max() <= 100 and len(used) >= packing.lower_bound(x, 100)
        for b in range(len(used)):
            mine = np.flatnonzero(bins == b)
            order = mine[np.argsort(offset[mine])]
            assert (np.cumsum(x[order]) - x[order] == offset[order]).all()
    assert packing.lower_bound(np.array([60, 60, 60, 40]), 100) == 3
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


def test_word_tokenizer_random():
    rng = random.Random(2)
    t = packing.tokenizer(vocabulary_path("word_bpe_49k.json"))
    for _ in range(3000):
        s = "".join(rng.choice("abcdeTHinsreO'  \n.,Éé12ßÄĀ\xa0²½µ’–ªħŁ!-<|>İΣσ日\x1c\x85") for _ in range(rng.randint(0, 40)))
        assert list(np.frombuffer(t.encode(s), "<u4")) == t.full.encode(s, add_special_tokens=False).ids
    assert t.encode("a <|endoftext|> b") == np.array(t.full.encode("a <|endoftext|> b", add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = bpe.encode(documents(spark, odd)).collect()
    assert len(rows) == len(odd)
    want = sorted((str(i), t.encode(s or "", add_special_tokens=False).ids, s or "") for i, s in odd)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in rows) == want
    c = bpe.codec(vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for s in ["x<|endoftext|>y", "I'm it's 'll  \t z", "日本語 🎉 é́", "\x1c a\x85b\xa0c　d", "a" * 999] + ["".join(rng.choice("abcdethinsreo'  \n.,é12ß　!-") for _ in range(30)) for _ in range(2000)]:
        ids = t.encode(s, add_special_tokens=False).ids
        assert list(c.encode(s)) == ids and c.decode(np.array(ids, "<u4")).decode() == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(documents(spark, []).limit(0)).count() == 0


def brute_classes(rows, n=5, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) / u >= least:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return links, root


@pytest.mark.parametrize("options", [{}, {"block": 4}, {"block": 4, "most": 8}])
def test_ngram_join(spark, odd, options):
    rng = random.Random(9)
    base = words(rng, 200).split()
    rows = list(odd)
    for n in range(40):  # a chain of near copies, so that classes outgrow single links
        base = base[:]
        base[rng.randrange(200)] = f"z{n}"
        rows.append((100 + n, " ".join(base)))
    got = ngram_join.classes(documents(spark, rows), **options).collect()
    links, root = brute_classes(rows)
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted((str(i), k) for (i, _), k in zip(rows, links))
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert all(classes[100 + n] == 100 for n in range(40)) and classes[3] == 1 and classes[9] == 7 and classes[5] == 5


def test_ngram_keep_one(spark, odd):
    kept = ngram_join.keep_one(documents(spark, odd))
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    gone = {"2", "3", "9"}
    assert ids == sorted({str(i) for i, _ in odd} - gone) and kept.columns == documents(spark, []).columns
    assert ngram_join.keep_one(documents(spark, []).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "one two", "k", 5, "x"), (2, "one two", "l", 6, "y"), (3, "three", "m", 7, "z")], "doc_id long, text string, __key string, h long, `a.b` string")
    assert sorted(map(tuple, ngram_join.keep_one(df).collect())) == [(1, "one two", "k", 5, "x"), (3, "three", "m", 7, "z")]
    b, r = ngram_join.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**r) ** b >= 0.9995


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(500)] + [(None, 3), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>{body}
<aside>side</aside><form><p>form</p></form><div id="comments"><p>first!</p></div><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    article = "<article><header><h1>Head &lt;one&gt;</h1></header><p>Fi<b>rs</b>t &amp;amp;\n  caf&eacute;&nbsp;x<br>line<p>Second <i>it</i><ul><li>a<li>b</ul><section class=comments><p>no</p></section><footer>by</footer></article>"
    want = "Head <one> First &amp; café x line Second it a b"
    rows = [(1, "http://h/a", PAGE.replace("{body}", article)), (2, "http://h/a", PAGE.replace("{body}", article)), (3, None, None), (4, "http://h/b", ""), (5, "u", "<p>cut <b"), (6, "http://k/1", "plain &#x41;&#66; text"), (7, "http://h/c", PAGE.replace("{body}", "<main><p>" + "long " * 50000 + "</p></main>"))]
    rows += [(10 + n, f"http://tree/{n}", f"<html><body><div class='top'><p>Same bar</p></div><div class='body'><p>Unique text number {n}</p></div></body></html>") for n in range(8)]
    rows += [(30 + n, "http://copies/1", "<html><body><p>All the same</p></body></html>") for n in range(6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, node int")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == got[2]["text"] == want and got[1]["n_chars"] == len(want) and got[1]["url"] == "http://h/a"
    assert got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "cut" and got[6]["text"] == "plain AB text"
    assert got[7]["n_chars"] == 5 * 50000 - 1
    assert all(got[10 + n]["text"] == f"Unique text number {n}" for n in range(8))
    assert all(got[30 + n]["text"] == "All the same" for n in range(6))
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_quotes_and_names(spark):
    text = lambda page: html_text.main_text(html_text.blocks(page), set())
    assert text('<article><p>a <a href="x>link</a> b "q>c</a> d</p></article>') == "a c d"  # the value ends at the next quote
    assert text('<p>kept</p><a href="x>lost') == "kept"  # no other quote: the page ends inside the tag
    assert text("<p title=it's>a</p><p data-x = 'y>z' hidden>b</p><p x=>c</p></ bogus>d") == "a c d"
    assert len(text("<p " + "a=b " * 200000 + ">x</p>" + "<i '" * 1000)) == 1
    df = spark.createDataFrame([(1, "http://h/1", "<p>a</p>", "old", 9, "k", "l")], "page_id long, url string, html string, text string, n_chars int, __host string, `__low` string")
    assert [r.asDict() for r in html_text.extract(df).collect()] == [{"page_id": 1, "url": "http://h/1", "__host": "k", "__low": "l", "text": "a", "n_chars": 1}]


def test_style_tree_by_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(3)
    pages = []
    for n in range(40):
        bar = "<div class=bar><p>Same bar</p>" + ("<p>now and then</p>" if n % 3 else "") + "</div>"
        pages.append((n, f"http://h{n % 3}/x", f"<body>{bar}<div class=body>" + "".join(f"<p>{words(rng, 8)}</p>" for _ in range(rng.randrange(1, 4))) + "</div></body>"))
    pages += [(n + 100, u, h) for n, u, h in pages[:9]]  # copies of pages count once
    seen: dict = {}
    for _, url, page in pages:
        found = html_text.blocks(page)
        nodes = {a for path, *_ in found for a in html_text.ancestors(path)}
        rest = html_text.outside(html_text.content(found), nodes)
        for node in nodes:
            below = [html_text.ancestors(path) for path, *_ in found]
            kids = [up[up.index(node) + 1] for up in below if node in up and up[-1] != node]
            kids = tuple(k for k, before in zip(kids, [None, *kids]) if k != before)
            texts = tuple(t for path, t, *_ in found if node in html_text.ancestors(path))
            for kind, value in ((0, kids), (1, texts)):
                if value:
                    seen.setdefault((html_text.host_of(url), html_text.path_hash(node), kind), set()).add((value, rest[node]))
    entropy = {}
    for k, values in seen.items():
        times = Counter(v for v, _ in values).values()
        m = sum(times)
        entropy[k] = 1.0 if m <= 1 else -sum(c / m * math.log(c / m) for c in times) / math.log(m)
    want = {(h, n): (entropy.get((h, n, 0), entropy[h, n, 1]) + entropy[h, n, 1]) / 2 for h, n, k in entropy if k == 1}
    tree = html_text.style_tree(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {(r["host"], r["node"]): r["importance"] for r in tree}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and min(want.values()) < 0.2


def test_pii_long_and_disguised(spark):
    import time

    began = time.time()
    for t in ("x" * 10**6 + " a@b", "ab1@" * 50000, "5" * 10**6, "a [at] " + "b.-" * 200000 + "_"):
        pii.evidence(t)
    assert time.time() - began < 20
    rng = random.Random(11)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [(n, f"mail ann{n}.b@mail{n % 5}.example.com or call +1 {number()} now, order {rng.randrange(10**6, 10**7)}") for n in range(80)]
    hidden = [f"please call {number()} or write to jo{n}.lee (at) example.org today, order {rng.randrange(10**6, 10**7)}" for n in range(40)]
    out = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, rows + [(1000 + n, t) for n, t in enumerate(hidden)])).collect()}
    found = [out[1000 + n] for n in range(40)]
    assert sum("phone" in x for x in found) >= 36 and sum("email" in x for x in found) >= 36 and sum(x.count(":") for x in found) <= 2 * 2 * 40


def test_secrets_long(spark):
    import time

    began = time.time()
    for t in ("token" * 200000, "api_key = " * 100000, "a" * 10**6, "0a" * 500000, "AKIA" * 250000):
        secrets.loose_spans(t, secrets.base_spans(t))
    assert time.time() - began < 20


def test_pii(spark):
    import re

    def brute(text):
        out = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
            out.append((m.start(), 0, m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 12 <= len(d) <= 19 and pii.luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
        return sorted(out)

    rng = random.Random(8)
    for _ in range(20000):
        s = "".join(rng.choice("12345 -.@+()ab") for _ in range(rng.randrange(0, 45)))
        assert pii.base_spans(s) == brute(s), s
    text = "mail ann.b@mail1.example.com or call +1 (743) 555-3824 now; again call (743) 555-3824 today. card 4539 1488 0343 6467 ip 10.0.0.7 order 1234567"
    rows = [(n, f"row {n} " + text) for n in range(30)] + [(90, None), (91, ""), (91, ""), (None, "5" * 40000), (92, "x@y.z" * 3)]
    out = pii.find(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    r = next(r for r in out if r["doc_id"] == 3)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert len(r["spans"].split(",")) == 5 and r["spans"].count("phone") == 2  # the repeated number is found by its twin
    m = {r["doc_id"]: r["text"] for r in pii.mask(documents(spark, rows)).collect()}
    assert m[3] == "row 3 mail [EMAIL] or call [PHONE] now; again call [PHONE] today. card [CARD] ip [IP] order 1234567" and m[90] is None
    # messages give exact marginals where edges form a tree
    gen = np.random.default_rng(0)
    f = pii.Field(gen.normal(size=(pii.N_FEATURES, 5)), gen.normal(size=(5, 5)), gen.normal(size=(5, 5)), gen.normal(size=(5, 5)))
    unary, edges = gen.normal(size=(4, 5)), [(0, 1, 0), (1, 2, 1), (1, 3, 2)]
    p = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        w = np.exp(sum(unary[n, y[n]] for n in range(4)) + sum([f.chain, f.twin, f.kin][k][y[a], y[b]] for a, b, k in edges))
        for n in range(4):
            p[n, y[n]] += w
    assert np.allclose(f.beliefs(unary, edges), p / p.sum(axis=1, keepdims=True))
    assert pii.find(documents(spark, []).limit(0)).count() == 0


def test_secrets(spark):
    import re

    def brute(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])

    rng = random.Random(3)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "abc123XYZ", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "f", "-"]
    for _ in range(8000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        assert [x[:3] for x in secrets.base_spans(s)] == brute(s), s
    rows = [(n, "token = EXAMPLE123456") for n in range(9)] + [(50, 'password: "own-secret-9"'), (51, None), (52, ""), (53, "see Zk9fQ2xLpT7vWb3YhN8rDs"), (53, "see Zk9fQ2xLpT7vWb3YhN8rDs")]
    got = {r["doc_id"]: r for r in secrets.scan(documents(spark, rows)).collect()}
    assert got[0]["n_examples"] == 1 and got[0]["live"] == "" and got[0]["spans"] == "assign:0:21"
    assert got[50]["live"] == got[50]["spans"] != "" and got[51]["spans"] == "" and got[53]["spans"] == "entropy:4:26"
    assert secrets.scan(documents(spark, rows)).count() == len(rows) and secrets.scan(documents(spark, []).limit(0)).count() == 0
