"""The queries of this folder's operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, line_dedup, near_vectors, ngram_join, packing, pii, secrets, topk, toxicity
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.links(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_removed long, n_chars long (of what stays), text_sha256 string (of what stays; null text: empty)."""
    done = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lines_removed", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links long, kept boolean."""
    return ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_html, op4_near_vectors, op5_line_dedup, op6_topk, op7_pii, op8_bpe, op9_secrets, op10_ngram_join)}
#: White space, as Python's split() has it, inside a class.
_WS = r"\s\v\x1c-\x1f\x{85}\p{Z}"
ORACLES: dict[str, str] = {
    "op5_line_dedup": rf"""
        WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
        parts AS (SELECT *, regexp_extract_all(line, '[^{_WS}]+[{_WS}]*') AS ps, regexp_extract(line, '^[{_WS}]*') AS lead FROM lines),
        counted AS (SELECT *, len(ps) AS k, coalesce(sum(len(ps)) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM parts),
        toks AS (SELECT doc_id, ln, base + i - 1 AS w, ps[i] AS tok, regexp_extract(ps[i], '^[^{_WS}]+') AS word FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM counted)),
        whole AS (SELECT doc_id, list(word ORDER BY w) AS ws FROM toks GROUP BY 1),
        wins AS (SELECT doc_id, i - 1 AS a, array_to_string(ws[i:i + 49], ' ') AS c FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM whole WHERE len(ws) >= 50)),
        homes AS (SELECT c, min(struct_pack(d := doc_id, a := a)) AS h FROM wins GROUP BY c HAVING count(*) > 1),
        later AS (SELECT doc_id, CASE WHEN h.d = doc_id THEN greatest(wins.a, h.a + 50) ELSE wins.a END AS start, wins.a + 50 AS stop FROM wins JOIN homes USING (c) WHERE h.d <> doc_id OR h.a <> wins.a),
        spans AS (SELECT doc_id, start, max(stop) AS stop FROM later WHERE start < stop GROUP BY 1, 2),
        cover AS (SELECT t.*, coalesce(max(s.stop) OVER (PARTITION BY t.doc_id ORDER BY t.w), 0) AS reach FROM toks t LEFT JOIN spans s ON s.doc_id = t.doc_id AND s.start = t.w),
        isles AS (SELECT *, reach > w AS gone, row_number() OVER (PARTITION BY doc_id, ln ORDER BY w) - row_number() OVER (PARTITION BY doc_id, ln, reach > w ORDER BY w) AS isle FROM cover),
        runs AS (SELECT *, gone AND count(*) OVER (PARTITION BY doc_id, ln, gone, isle) >= 3 AS cut FROM isles),
        full_ AS (SELECT doc_id, ln, bool_and(gone) AS all_gone, bool_or(cut) AS cut, string_agg(tok, '' ORDER BY w) FILTER (NOT cut) AS body FROM runs GROUP BY 1, 2),
        told AS (SELECT c.doc_id, c.ln, coalesce(f.all_gone, p.reach > c.base, false) AS removed,
                 CASE WHEN f.cut THEN regexp_replace(c.lead || coalesce(f.body, ''), '[{_WS}]+$', '') ELSE c.line END AS line
                 FROM counted c LEFT JOIN full_ f ON f.doc_id = c.doc_id AND f.ln = c.ln LEFT JOIN cover p ON c.k = 0 AND p.doc_id = c.doc_id AND p.w = c.base - 1),
        out_ AS (SELECT doc_id, count(*) FILTER (removed) AS lines_removed, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT removed), '') AS text FROM told GROUP BY 1)
        SELECT doc_id, lines_removed, length(text) AS n_chars, sha256(text) AS text_sha256 FROM out_""",
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_near_vectors": """
        WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
              AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
        r(v, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, p.b FROM r JOIN p ON r.m = p.a)
        SELECT v AS vec_id, (SELECT count(*) FROM p WHERE a = v)::BIGINT AS n_links, min(m) AS component_id, v = min(m) AS kept FROM r GROUP BY v""",
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
        j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        p AS MATERIALIZED (SELECT a, b FROM j JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c / (x.k + y.k - c) >= 0.8),
        r(v, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, p.b FROM r JOIN p ON r.m = p.a),
        l AS (SELECT a, count(*) AS k FROM p GROUP BY 1)
        SELECT v AS doc_id, min(m) AS class_id, coalesce(any_value(l.k), 0)::BIGINT AS n_links, v = min(m) AS kept FROM r LEFT JOIN l ON l.a = v GROUP BY v""",
}
