"""Main text of web pages by site style trees.

A page is read into blocks, each with the path of its elements (tag and class) and its text.
Pages of one host are merged into a style tree: a node is a path.  Its presentation importance
is the entropy of the child sequences seen there, its content importance the entropy of the
texts seen there, both to the base of how often the node was seen; their mean is the node's
importance.  Nodes seen often whose importance is low (the same menu, notice or advert page
after page) are removed from every page of that host.  What markup names is removed by name:
navigation, headers and footers of the page, asides, forms, scripts, styles, adverts, notices and
comments.  Where a page marks its article, all else is not content; nodes of low importance go
inside the article as well.

Copies of an article on one host are articles still, so what is counted at a node is distinct
pages: pages whose two longest blocks of content outside the node agree (by the least hash of their runs
of five words, so that near copies mostly agree too) and whose node agrees count once.

Trees are sums by (host, path), so a host with very many pages costs partial sums; no host's
pages are gathered.

Defined results: null html is empty, and an empty or textless page has the empty text; very long pages are read whole, in linear time; a null url
is a host of its own; unclosed, misnested and cut-off markup is read on as browsers do (a quote that isn't closed takes all up to the
next one, or to the end of the page); of nodes that tie at the bounds those at MIN_IMPORTANCE stay; repeated
rows give repeated results; an empty table gives no rows; extra columns are kept whatever their names, but for the html and columns named
`text` or `n_chars`, which give way to the results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, map_columns, named, shingles, small, text_of, unused

#: A node is judged when seen this often, and removed below this importance.
MIN_SEEN = 4
MIN_IMPORTANCE = 0.2
#: Elements open at this depth or beyond are of the path of the one around them; all else about them holds.
PATH_DEPTH = 400

# An attribute: its name, and a value in quotes (to the next quote of its kind, or the end of the page) or without.
_NAME, _BLANK = r"[^ \t\n\f\r/>]", r"[ \t\n\f\r]*+"
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?=>|\Z)|[^ \t\n\f\r>]++)"
_ATTRIBUTES = rf"(?:[ \t\n\f\r/]++|{_NAME}[^ \t\n\f\r/>=]*+(?:{_BLANK}={_BLANK}{_VALUE})?+)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z]{_NAME}*+)({_ATTRIBUTES})(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
# Elements by their part in a page.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside form head button select option menu dialog svg canvas object audio video map script style textarea title noscript template iframe noembed noframes xmp".split())
CLOSED_BY = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form blockquote pre hr address figure fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|aside|header|masthead|footer|"
    r"comment|comments|commentlist|disqus|reply|replies|respond|discussion|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|subscribe|newsletter|signup|login|search|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|\s)main(?:\s|$)", re.I)


def host_of(url: str) -> str:
    """Host of a url, in lower case; empty if there is none."""
    m = re.match(r"[^/?#]*//([^/?#]*)", url)
    return m[1].rpartition("@")[2].lower() if m else ""


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """(path, text, named as not content, in an article) of each block, in page order.

    Texts have their references decoded and white space made single blanks.
    """
    out: list[tuple[str, str, bool, bool]] = []
    # an open element: tag, path, not content, in an article, place of the nearest block element at or above it
    stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, 0)]
    opened: Counter[str] = Counter()  # so that an end tag without a start tag needs no search
    parts: list[str] = []
    owner = stack[0]

    def close(n):
        for element in stack[n:]:
            opened[element[0]] -= 1
        del stack[n:]

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((owner[1], text, owner[2], owner[3]))

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            top = stack[-1]
            if (top[2], top[3]) != (owner[2], owner[3]):
                flush()
            if not parts:
                owner = top
            parts.append(page[at:begin])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            for n in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[n][0] == tag:
                    if stack[n][2] != stack[n - 1][2] or stack[n][3] != stack[n - 1][3]:
                        flush()
                    close(n)
                    break
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ") if parts else None
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if tag not in INLINE and len(stack) > 1 and stack[-1][0] in INLINE:
            # a block inside an unclosed inline element: an open p around it ends as well
            n = stack[-1][4]
            if n and tag in CLOSED_BY.get(stack[n][0], ()):
                close(n)
        up = stack[-1]
        names = ""
        rest = m[3]
        if "=" in rest:
            names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(rest))
        inside = up[3] or tag in ("article", "main") or bool(names and MAIN.search(names) and not NAMED.search(names))
        bad = up[2] or tag in NEVER or (tag == "header" and not up[3]) or bool(names and tag not in ("html", "body") and NAMED.search(names)) or bool(rest and HIDDEN.search(rest))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)|</{re.escape(tag)}$", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if rest.endswith("/") and tag in ("svg", "path"):
            continue
        path = f"{up[1]}/{tag}" + (f".{names}" if names else "") if len(stack) < PATH_DEPTH else up[1]
        stack.append((tag, path, bad, inside, up[4] if tag in INLINE else len(stack)))
        opened[tag] += 1
    flush()
    return out


def path_hash(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def ancestors(path: str) -> list[str]:
    """A path and those above it."""
    cuts = [n for n, c in enumerate(path) if c == "/" and n] + [len(path)]
    return [path[:n] for n in cuts]


def content(found: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str]]:
    """(path, text) of the blocks that markup lets stay: those in the article, if it has any."""
    marked = any(inside and not bad for _, _, bad, inside in found)
    return [(path, text) for path, text, bad, inside in found if not bad and (inside or not marked)]


def outside(kept: list[tuple[str, str]], nodes) -> dict[str, int]:
    """For each node, a hash of the two longest blocks of content outside it."""
    longest = sorted(kept, key=lambda b: -len(b[1]))
    least: dict[str, int] = {}
    out = {}
    for node in nodes:
        two = []
        for path, text in longest:
            if path != node and not path.startswith(node + "/"):
                if text not in least:
                    least[text] = int(shingles(text, 5)[0])
                two.append(least[text])
                if len(two) == 2:
                    break
        out[node] = path_hash(repr(sorted(two)))
    return out


def style_tree(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows (host, node, seen, presentation, content, importance) of all hosts."""

    def run(batch):
        hosts, nodes, kinds, values, others = [], [], [], [], []
        for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = host_of(url)
            children: dict[str, list[str]] = {}
            contents: dict[str, list[str]] = {}
            found = blocks(page)
            for path, text, _, _ in found:
                up = ancestors(path)
                for a, b in zip(up, up[1:]):
                    seq = children.setdefault(a, [])
                    if not seq or seq[-1] != b:
                        seq.append(b)
                for a in up:
                    contents.setdefault(a, []).append(text)
            rest = outside(content(found), contents)
            for kind, told in ((0, children), (1, contents)):
                for path, seq in told.items():
                    hosts.append(host)
                    nodes.append(path_hash(path))
                    kinds.append(kind)
                    values.append(path_hash("\0".join(seq)))
                    others.append(rest[path])
        return {"host": pa.array(hosts, pa.string()), "node": pa.array(nodes, pa.int64()), "kind": pa.array(kinds, pa.int32()), "value": pa.array(values, pa.int64()), "rest": pa.array(others, pa.int64())}

    each = arrow_map(pages.select(text_of(html_col).alias("html"), text_of(url_col).alias("url")), run, "host string, node long, kind int, value long, rest long")
    times = each.distinct().groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"))
    # entropy from sums alone: log m - (sum of n log n) / m, to the base m
    sums = times.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("m") <= 1, F.lit(1.0)).otherwise((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m"))
    both = sums.withColumn("entropy", entropy).groupBy("host", "node").agg(F.max("m").alias("seen"), F.max(F.when(F.col("kind") == 0, F.col("entropy"))).alias("presentation"), F.max(F.when(F.col("kind") == 1, F.col("entropy"))).alias("content"))
    return both.withColumn("importance", (F.coalesce("presentation", "content") + F.col("content")) / 2)


def main_text(found: list[tuple[str, str, bool, bool]], low: set[int]) -> str:
    """Text of the blocks that stay."""
    kept = content(found)
    gone: dict[str, bool] = {}
    for path, _ in kept:
        if path not in gone:
            gone[path] = any(path_hash(a) in low for a in ancestors(path)) if low else False
    # where no node is of importance nothing tells boilerplate from text
    return " ".join([t for path, t in kept if not gone[path]] or [t for _, t in kept])


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_seen: int = MIN_SEEN, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """`pages` without its html, with `text` and `n_chars` (code points) added."""
    tree = style_tree(pages, html_col, url_col)
    low = tree.where((F.col("seen") >= min_seen) & (F.col("importance") < min_importance))
    low = cut(low.groupBy("host").agg(F.collect_list("node").alias("nodes")))
    at, own, page, held = (unused(pages, n) for n in ("__host", "__of", "__html", "__low"))
    host = F.lower(F.regexp_replace(F.regexp_extract(text_of(url_col), r"^[^/?#]*//([^/?#]*)", 1), "^.*@", ""))
    rest = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    joined = pages.select(*map(named, rest), text_of(html_col).alias(page), host.alias(at)).join(small(low).toDF(own, held), F.col(at) == F.col(own), "left")

    def run(cols, extra):
        texts = [main_text(blocks(h), set(low or ())) for h, low in zip(extra[0].to_pylist(), extra[1].to_pylist())]
        return [*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_columns(joined, rest, [page, held], run, {"text": "string", "n_chars": "long"})
