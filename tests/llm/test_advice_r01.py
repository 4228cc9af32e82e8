
import random

from quadloom.llm import html_text, pii, secrets

from .test_text_operators import documents, words


def test_html_tree_inside_articles(spark):
    rng = random.Random(2)
    page = "<html><body><div>{bar}</div><article><h1>{head}</h1><p>{a}</p><p>{b}</p><div class='x7'><p>Licensed to all by the press office of this town, who keep every right there is</p></div></article></body></html>"
    rows = [(n, f"http://h/{n}", page.format(bar="bar", head=f"Head {n}", a=words(rng, 30), b=words(rng, 5))) for n in range(8)]
    # one article on many pages, each with its own other text: a copy is no boilerplate
    copy = "<html><body><div class='y'><p>{own}</p></div><article><h1>One head</h1><p>The very same text in all of them</p><p>And its end</p></article></body></html>"
    rows += [(20 + n, f"http://copies/{n}", copy.format(own=words(rng, 4))) for n in range(8)]
    # an article that markup takes away leaves the rest of its page
    rows += [(40, "http://one/1", "<html><body><div><p>Body text</p></div><aside><article><p>Teaser</p></article></aside></body></html>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Licensed" not in got[n] and got[n].startswith(f"Head {n} w") for n in range(8))
    assert all(got[20 + n] == "One head The very same text in all of them And its end" for n in range(8))
    assert got[40] == "Body text"


def test_html_deep():
    for tag in ("div", "font", "section"):
        page = "<article>" + f"<{tag}>" * 600 + "in" + f"</{tag}>" * 600 + "<p>after</p></article><p>out</p>"
        assert html_text.main_text(html_text.blocks(page), set()) == "in after"
    page = "<article>" + "<div>" * 600 + "<nav>menu</nav><p>text</p>" + "</div>" * 600 + "<p>end</p></article>"
    assert html_text.main_text(html_text.blocks(page), set()) == "text end"
    assert len(html_text.blocks("<font>x<p>y</q>" * 20000)) >= 20000  # in linear time


def test_pii_without_base_spans(spark):
    rng = random.Random(6)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [(n, f"mail ann{n}.b@mail1.example.com or call +1 {number()} now. order {rng.randrange(10**6, 10**7)} of 2024-01-{rng.randrange(10, 28)}") for n in range(60)]
    rows += [(100, "write to jane.doe (at) example.com today"), (101, "please call (743) 555-3824 now"), (102, "tea (at) noon, order 7654321 of 2023-11-15"), (103, "nothing at all")]
    got = {r["doc_id"]: r["text"] for r in pii.mask(documents(spark, rows)).collect()}
    assert got[100] == "write to [EMAIL] today" and got[101] == "please call [PHONE] now"
    assert got[102] == rows[-2][1] and got[103] == rows[-1][1]
    assert all("order " + t.split("order ")[1] in got[n] for n, t in rows[:60])


def test_secrets_of_one_owner(spark):
    own, shared = "Zk9fQ2xLpT7vWb3YhN8rDs", "Qx7bN4mKtR9wZc2VfJ6hLp"
    rows = [(3 * n, f"see {own} row {n}") for n in range(300)] + [(n, f"use {shared} row {n}") for n in range(2000, 2006)]
    got = {r["doc_id"]: r for r in secrets.scan(documents(spark, rows)).collect()}  # the owner is src{doc_id % 3}
    assert all(got[3 * n]["live"] == got[3 * n]["spans"] == "entropy:4:26" for n in range(300))
    assert all(got[n]["spans"] == "" for n in range(2000, 2006))


def test_pii_evidence_of_whole_text():
    text = " ".join(f"order {n}" for n in range(1000000, 1000100)) + " " + " ".join(f"mail a{n}@b.example.com" for n in range(100))
    bits, labels, edges = pii.evidence(text)
    assert labels.count(0) + (len(labels) - labels.count(0)) // 2 == pii.PER_TEXT and labels.count(0) > 4 and labels.count(1) > 8 and edges
