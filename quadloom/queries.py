"""Registered queries of the engine, one or more for each operator, with their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, as_quads, tables_engine
from .operators import semantic
from .operators.reasoner import materialize
from .sources.mapping import Dataset
from .lineage import shared_folder
from .sources.rdf_io import load_rdf, results_json, statement
from .store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sparql(name: str, text: str, oracle: str | None = None, after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a SPARQL query over the tables; `after` only shapes the result's columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = tables_engine(spark, sf_dir).query(text)
        return after(df) if after else df

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def rounded(*cols: str, digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def key(*cols: str) -> Callable[[DataFrame], DataFrame]:
    """IRIs of the tables to their integer keys, so that SQL can be compared."""
    return lambda df: df.withColumns({c: F.regexp_extract(c, r"([0-9]+)$", 1).cast("bigint") for c in cols})


def both(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


sparql(
    "flagship",
    """SELECT ?nname (COUNT(?o) AS ?orders) (SUM(?price) AS ?revenue)
       WHERE { ?c t:c_nation ?n . ?n t:n_name ?nname . ?o t:o_customer ?c ; t:o_totalprice ?price . FILTER(?price > 1000) }
       GROUP BY ?nname ORDER BY ?nname""",
    "SELECT n_name AS nname, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE o_totalprice>1000 GROUP BY n_name",
    rounded("revenue"),
)

# -- scans and basic patterns
sparql("bgp_star", "SELECT ?n ?b { ?c t:c_name ?n ; t:c_acctbal ?b }", "SELECT c_name AS n, c_acctbal AS b FROM customer")
sparql("scan_subject", "SELECT ?p ?o { <urn:tpch:nation/7> ?p ?o }", "SELECT 'urn:tpch:n_name' AS p, n_name AS o FROM nation WHERE n_nationkey=7 UNION ALL SELECT 'urn:tpch:n_region', 'urn:tpch:region/' || n_regionkey FROM nation WHERE n_nationkey=7 UNION ALL SELECT 'urn:tpch:n_nationkey', '7' UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:tpch:Nation'", lambda df: df.withColumn("o", F.col("o.v")))
sparql("scan_object", "SELECT ?c { ?c t:c_nation <urn:tpch:nation/3> }", "SELECT 'urn:tpch:customer/' || c_custkey AS c FROM customer WHERE c_nationkey=3")
sparql("scan_literal_object", 'SELECT ?o { ?o t:o_orderstatus "F" ; t:o_orderpriority "1-URGENT" }', "SELECT 'urn:tpch:order/' || o_orderkey AS o FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT'")
sparql("scan_class", "SELECT (COUNT(*) AS ?n) { ?x a t:Supplier }", "SELECT count(*) AS n FROM supplier")
sparql("bgp_path_join", "SELECT ?rn ?cn { ?c t:c_nation ?x . ?x t:n_region ?r . ?r t:r_name ?rn . ?c t:c_name ?cn }", "SELECT r_name AS rn, c_name AS cn FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
sparql("bgp_blank_node", "SELECT ?cn ?nn { ?c t:c_name ?cn ; t:c_nation [ t:n_name ?nn ; t:n_region [ t:r_name 'ASIA' ] ] }", "SELECT c_name AS cn, n_name AS nn FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA'")
sparql("var_predicate", "SELECT ?p (COUNT(?o) AS ?k) { ?r a t:Region . ?r ?p ?o } GROUP BY ?p", "SELECT 'urn:tpch:r_name' AS p, count(*) AS k FROM region UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM region UNION ALL SELECT 'urn:tpch:r_regionkey', count(*) FROM region")
sparql("line_revenue", "SELECT ?f ?s (SUM(?q) AS ?qty) (SUM(?p * (1 - ?d)) AS ?rev) (COUNT(*) AS ?n) { ?l t:l_returnflag ?f ; t:l_linestatus ?s ; t:l_quantity ?q ; t:l_extendedprice ?p ; t:l_discount ?d } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice*(1-l_discount)), 1) AS rev, count(*) AS n FROM lineitem GROUP BY 1, 2", both(rounded("qty"), rounded("rev", digits=1)))
sparql("line_join", "SELECT ?b (COUNT(*) AS ?n) { ?l t:l_part ?p ; t:l_order ?o . ?p t:p_brand ?b . ?o t:o_orderstatus 'F' } GROUP BY ?b", "SELECT p_brand AS b, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey WHERE o_orderstatus='F' GROUP BY 1")

# -- joins (J1-J12)
sparql("filter_range", "SELECT ?p { ?o t:o_totalprice ?p FILTER(?p >= 1000 && ?p < 50000) }", "SELECT o_totalprice AS p FROM orders WHERE o_totalprice>=1000 AND o_totalprice<50000")
sparql("cross_product", "SELECT ?a ?b { ?r t:r_name ?a . ?n t:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation")
sparql("optional", "SELECT ?l ?q { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } }", "SELECT d.lang AS l, quality::BIGINT AS q FROM documents d LEFT JOIN labels USING (doc_id)")
sparql("optional_filter", 'SELECT ?l ?q { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q FILTER(?l = "en") } }', "SELECT d.lang AS l, quality::BIGINT AS q FROM documents d LEFT JOIN labels b ON d.doc_id=b.doc_id AND d.lang='en'")
sparql("optional_unbound_join", "SELECT ?d ?q ?m { ?d t:d_lang 'fr' OPTIONAL { ?d t:quality ?q } VALUES (?q ?m) { (1 'good') (0 'bad') } }", "SELECT 'urn:tpch:document/' || d.doc_id AS d, v.q, m FROM documents d LEFT JOIN labels b ON d.doc_id=b.doc_id JOIN (VALUES (1::BIGINT,'good'),(0::BIGINT,'bad')) v(q,m) ON b.quality IS NULL OR b.quality=v.q WHERE d.lang='fr'")
sparql("union_branch", "SELECT ?b { { ?x t:c_acctbal ?b } UNION { ?x t:s_acctbal ?b } }", "SELECT c_acctbal AS b FROM customer UNION ALL SELECT s_acctbal FROM supplier")
sparql("union_three", "SELECT ?x ?b ?m { { ?x t:c_acctbal ?b } UNION { ?x t:s_acctbal ?b } UNION { ?x t:p_size ?m } }", "SELECT 'urn:tpch:customer/' || c_custkey AS x, c_acctbal AS b, NULL::BIGINT AS m FROM customer UNION ALL SELECT 'urn:tpch:supplier/' || s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'urn:tpch:part/' || p_partkey, NULL, p_size FROM part")
sparql("minus", "SELECT ?l { ?d t:d_lang ?l MINUS { ?d t:quality ?q } }", "SELECT d.lang AS l FROM documents d ANTI JOIN labels b ON d.doc_id=b.doc_id")
sparql("minus_disjoint", "SELECT ?n { ?r t:r_name ?n MINUS { ?x t:s_name ?y } }", "SELECT r_name AS n FROM region")
sparql("exists", "SELECT ?d { ?d t:d_lang ?l FILTER EXISTS { ?d t:toxic 1 } }", "SELECT d.doc_id AS d FROM documents d SEMI JOIN (SELECT * FROM labels WHERE toxic=1) b ON d.doc_id=b.doc_id", key("d"))
sparql("not_exists", "SELECT ?d { ?d t:d_lang ?l FILTER NOT EXISTS { ?d t:toxic 1 } }", "SELECT d.doc_id AS d FROM documents d ANTI JOIN (SELECT * FROM labels WHERE toxic=1) b ON d.doc_id=b.doc_id", key("d"))
sparql("exists_in_or", 'SELECT ?d { ?d t:d_lang ?l FILTER(?l = "es" || EXISTS { ?d t:toxic 1 }) }', "SELECT d.doc_id AS d FROM documents d WHERE lang='es' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic=1)", key("d"))
sparql("exists_correlated", "SELECT ?c { ?c t:c_acctbal ?b ; t:c_nation ?n FILTER EXISTS { ?s t:s_nation ?n ; t:s_acctbal ?x FILTER(?x > ?b) } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=c_nationkey AND s_acctbal>c_acctbal)", key("c"))
sparql("values_undef", 'SELECT ?m ?k { VALUES (?m ?k) { ("BUILDING" 1) (UNDEF 2) } ?c t:c_mktsegment ?m }', "SELECT c_mktsegment AS m, k::BIGINT AS k FROM customer JOIN (VALUES ('BUILDING',1),(NULL,2)) v(m,k) ON v.m IS NULL OR v.m=c_mktsegment")
sparql("values_after", 'SELECT ?n ?m { ?c t:c_name ?n ; t:c_mktsegment ?m } VALUES ?m { "BUILDING" "MACHINERY" }', "SELECT c_name AS n, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY')")
sparql("subselect", "SELECT ?o { { SELECT ?c (MAX(?p) AS ?mp) { ?x t:o_customer ?c ; t:o_totalprice ?p } GROUP BY ?c } ?o t:o_customer ?c ; t:o_totalprice ?mp }", "SELECT o_orderkey AS o FROM orders JOIN (SELECT o_custkey c, max(o_totalprice) mp FROM orders GROUP BY 1) m ON o_custkey=c AND o_totalprice=mp", key("o"))

# -- projection, modifiers and forms
sparql("bind_arith", "SELECT ?rev { ?l t:l_extendedprice ?p ; t:l_discount ?d BIND(?p * (1 - ?d) AS ?rev) }", "SELECT round(l_extendedprice*(1-l_discount),5) AS rev FROM lineitem", rounded("rev", digits=5))
sparql("select_star", "SELECT * { ?r t:r_name ?n }", "SELECT r_name AS n, 'urn:tpch:region/' || r_regionkey AS r FROM region")
sparql("distinct_proj", "SELECT DISTINCT ?s { ?o t:o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
sparql("topk", "SELECT ?o ?p { ?o t:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10", "SELECT 'urn:tpch:order/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 10")
sparql("slice", "SELECT ?k { ?o t:o_orderkey ?k } ORDER BY ?k OFFSET 20 LIMIT 10", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 10 OFFSET 20")
sparql("order_expression", "SELECT ?n { ?c t:c_name ?n ; t:c_acctbal ?b } ORDER BY DESC(ABS(?b)) ?n LIMIT 15", "SELECT c_name AS n FROM customer ORDER BY abs(c_acctbal) DESC, n LIMIT 15")
sparql("ask", "ASK { ?p t:p_size 1 }", "SELECT count(*)>0 AS result FROM part WHERE p_size=1")
sparql("construct", "CONSTRUCT { ?n t:hasCustomer ?c } WHERE { ?c t:c_nation ?n }", "SELECT DISTINCT 'urn:tpch:nation/' || c_nationkey AS s, 'urn:tpch:hasCustomer' AS p, 'urn:tpch:customer/' || c_custkey AS o FROM customer", lambda df: df.withColumn("o", F.col("o.v")))
sparql("construct_where", "CONSTRUCT WHERE { ?r t:r_name ?n }", "SELECT 'urn:tpch:region/' || r_regionkey AS s, 'urn:tpch:r_name' AS p, r_name AS o FROM region", lambda df: df.withColumn("o", F.col("o.v")))
sparql("describe", "DESCRIBE <urn:tpch:region/1>", "SELECT 'urn:tpch:r_name' AS p, r_name AS o FROM region WHERE r_regionkey=1 UNION ALL SELECT 'urn:tpch:r_regionkey', '1' UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:tpch:Region'", lambda df: df.select("p", F.col("o.v").alias("o")))

# -- aggregation
sparql("group_having", "SELECT ?m (COUNT(*) AS ?n) (AVG(?b) AS ?a) { ?c t:c_mktsegment ?m ; t:c_acctbal ?b } GROUP BY ?m HAVING(COUNT(*) > 5)", "SELECT c_mktsegment AS m, count(*) AS n, round(avg(c_acctbal),2) AS a FROM customer GROUP BY 1 HAVING count(*)>5", rounded("a"))
sparql("group_expr", "SELECT ?y (COUNT(*) AS ?n) { ?o t:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("group_unbound", "SELECT ?q (COUNT(*) AS ?n) { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } } GROUP BY ?q", "SELECT quality::BIGINT AS q, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
sparql("implicit_group_empty", "SELECT (COUNT(*) AS ?n) (SUM(?p) AS ?s) (MIN(?p) AS ?m) { ?o t:o_totalprice ?p FILTER(false) }", "SELECT count(*) AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS m FROM orders WHERE false")
sparql("count_distinct", "SELECT (COUNT(DISTINCT ?u) AS ?n) { ?e t:e_user ?u }", "SELECT count(DISTINCT user_id) AS n FROM events")
sparql("count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) { { ?x t:c_nation ?v } UNION { ?x t:c_nation ?v } }", "SELECT count(*) AS n FROM customer")
sparql("count_expr", "SELECT (COUNT(?q) AS ?n) { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } }", "SELECT count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id)")
sparql("aggregate_in_expression", "SELECT ?m (SUM(?b) / COUNT(?b) AS ?a) { ?c t:c_mktsegment ?m ; t:c_acctbal ?b } GROUP BY ?m", "SELECT c_mktsegment AS m, round(sum(c_acctbal)/count(*), 2) AS a FROM customer GROUP BY 1", rounded("a"))
sparql("aggregate_over_expression", "SELECT ?m (AVG(IF(?b > 0, ?b, 0.0e0)) AS ?a) { ?c t:c_mktsegment ?m ; t:c_acctbal ?b } GROUP BY ?m", "SELECT c_mktsegment AS m, round(avg(CASE WHEN c_acctbal>0 THEN c_acctbal ELSE 0 END), 2) AS a FROM customer GROUP BY 1", rounded("a"))
sparql("group_concat", 'SELECT ?r (GROUP_CONCAT(DISTINCT ?n; SEPARATOR="; ") AS ?g) { ?x t:n_region ?r ; t:n_name ?n } GROUP BY ?r', "SELECT 'urn:tpch:region/' || n_regionkey AS r, string_agg(DISTINCT n_name,'; ' ORDER BY n_name) AS g FROM nation GROUP BY 1")
sparql("sum_min_max_sample", "SELECT ?t (SUM(?v) AS ?s) (MIN(?v) AS ?mn) (MAX(?v) AS ?mx) (SAMPLE(?t) AS ?x) { ?e t:event_type ?t ; t:value ?v } GROUP BY ?t", "SELECT event_type AS t, round(sum(value),2) AS s, min(value) AS mn, max(value) AS mx, event_type AS x FROM events GROUP BY 1", rounded("s"))
sparql("sum_avg_distinct", "SELECT (SUM(DISTINCT ?z) AS ?s) (AVG(DISTINCT ?z) AS ?a) (SUM(?z) AS ?t) { ?p t:p_size ?z }", "SELECT sum(DISTINCT p_size)::BIGINT AS s, round(avg(DISTINCT p_size), 4) AS a, sum(p_size)::BIGINT AS t FROM part", rounded("a", digits=4))

# -- paths (H1-H10)
sparql("path_seq", "SELECT ?c ?r { ?c t:c_nation/t:n_region ?r }", "SELECT c_custkey AS c, n_regionkey::BIGINT AS r FROM customer JOIN nation ON c_nationkey=n_nationkey", key("c", "r"))
sparql("path_inv", "SELECT ?r ?n { ?r ^t:n_region ?n }", "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM nation", key("r", "n"))
sparql("path_alt", "SELECT ?n { ?x (t:c_nation|t:s_nation) ?n }", "SELECT c_nationkey::BIGINT AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier", key("n"))
sparql("path_plus", "SELECT ?a ?b { ?a t:next+ ?b }", "WITH RECURSIVE e AS (SELECT a.conv_id c, a.turn s, b.turn d FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1), r AS (SELECT * FROM e UNION SELECT r.c, r.s, e.d FROM r JOIN e ON r.c=e.c AND r.d=e.s) SELECT 'urn:tpch:turn/' || c || '-' || s AS a, 'urn:tpch:turn/' || c || '-' || d AS b FROM r")
sparql("path_plus_constant", "SELECT ?b { <urn:tpch:turn/1-0> t:next+ ?b }", "SELECT 'urn:tpch:turn/1-' || turn AS b FROM conversations WHERE conv_id=1 AND turn>0")
sparql("path_star", "SELECT (COUNT(*) AS ?n) { ?a a t:Turn . ?a t:next* ?b }", "WITH c AS (SELECT conv_id, count(*) k FROM conversations GROUP BY 1) SELECT sum(k*(k+1)//2)::BIGINT AS n FROM c")
sparql("path_maybe", "SELECT (COUNT(*) AS ?n) { ?a a t:Turn . ?a t:next? ?b }", "WITH c AS (SELECT conv_id, count(*) k FROM conversations GROUP BY 1) SELECT sum(2*k-1)::BIGINT AS n FROM c")
sparql("path_nps", "SELECT ?o { ?s a t:Region . ?s !(rdf:type|t:r_regionkey) ?o }", "SELECT r_name AS o FROM region", lambda df: df.withColumn("o", F.col("o.v")))

# -- named graphs
sparql("graph_var", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?c t:c_acctbal ?b } } GROUP BY ?g", "SELECT 'urn:tpch:g/region-' || n_regionkey AS g, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
sparql("graph_iri", "SELECT ?c { GRAPH <urn:tpch:g/region-2> { ?c t:c_acctbal ?b } }", "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=2", key("c"))
sparql("from_merge", "SELECT ?c ?b FROM <urn:tpch:g/region-1> FROM <urn:tpch:g/region-3> { ?c t:c_acctbal ?b }", "SELECT c_custkey AS c, c_acctbal AS b FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey IN (1,3)", key("c"))
sparql("from_named", "SELECT ?g ?c FROM NAMED <urn:tpch:g/region-4> { GRAPH ?g { ?c t:c_name ?b } }", "SELECT 'urn:tpch:g/region-4' AS g, c_custkey AS c FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=4", key("c"))

# -- expressions and functions
sparql("str_functions", "SELECT (UCASE(?p) AS ?u) (LCASE(?p) AS ?lo) (STRLEN(?p) AS ?n) (SUBSTR(?p, 2, 3) AS ?s) (CONTAINS(?p, 'bolt') AS ?c) (STRBEFORE(?p, ' ') AS ?b) (STRAFTER(?p, ' ') AS ?a) (STRSTARTS(?p, 's') AS ?x) (STRENDS(?p, 't') AS ?y) (CONCAT(?p, '-', ?br) AS ?cc) { ?i t:p_name ?p ; t:p_brand ?br }", "SELECT upper(p_name) AS u, lower(p_name) AS lo, length(p_name) AS n, substr(p_name,2,3) AS s, contains(p_name,'bolt') AS c, CASE WHEN contains(p_name,' ') THEN split_part(p_name,' ',1) ELSE '' END AS b, CASE WHEN contains(p_name,' ') THEN substr(p_name, strpos(p_name,' ')+1) ELSE '' END AS a, starts_with(p_name,'s') AS x, ends_with(p_name,'t') AS y, p_name || '-' || p_brand AS cc FROM part")
sparql("regex_replace", "SELECT (REGEX(?p, '^LARGE', 'i') AS ?m) (REPLACE(?p, 'o', '0') AS ?r) { ?i t:p_name ?p }", "SELECT regexp_matches(p_name,'(?i)^large') AS m, regexp_replace(p_name,'o','0','g') AS r FROM part")
sparql("hash_functions", "SELECT (MD5(?p) AS ?a) (SHA1(?p) AS ?b) (SHA256(?p) AS ?c) { ?i t:p_name ?p }", "SELECT md5(p_name) AS a, sha1(p_name) AS b, sha256(p_name) AS c FROM part")
sparql("sha_long", "SELECT (STRLEN(SHA384(?p)) AS ?a) (STRLEN(SHA512(?p)) AS ?b) { ?i t:p_name ?p }", "SELECT 96::BIGINT AS a, 128::BIGINT AS b FROM part")
sparql("encode_uri", "SELECT (ENCODE_FOR_URI(?p) AS ?e) { ?i t:p_name ?p }", "SELECT url_encode(p_name) AS e FROM part")
sparql("date_functions", "SELECT (YEAR(?t) AS ?y) (MONTH(?t) AS ?mo) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (SECONDS(?t) AS ?s) (TZ(?t) AS ?z) { ?e t:ts ?t }", "SELECT year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, round(second(ts) + (microsecond(ts) % 1000000) / 1e6, 6)::DOUBLE AS s, '' AS z FROM events", rounded("s", digits=6))
sparql("date_compare", 'SELECT (COUNT(*) AS ?n) { ?o t:o_orderdate ?d FILTER(?d < "1996-01-01T00:00:00"^^xsd:dateTime) }', "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
sparql("numeric_functions", "SELECT (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) { ?x t:c_acctbal ?b }", "SELECT abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r FROM customer")
sparql("arithmetic", "SELECT ?k (?z + 1 AS ?a) (?z - 2 AS ?b) (?z * 3 AS ?c) (?z / 4 AS ?d) (-?z AS ?e) (?z / 0 AS ?f) { ?p t:p_partkey ?k ; t:p_size ?z }", "SELECT p_partkey AS k, p_size::BIGINT + 1 AS a, p_size::BIGINT - 2 AS b, p_size::BIGINT * 3 AS c, p_size / 4.0::DOUBLE AS d, -p_size::BIGINT AS e, NULL::DOUBLE AS f FROM part", lambda df: df.withColumns({c: F.col(c).cast("double") for c in ("d", "f")}))
sparql("lang_functions", "SELECT ?l (COUNT(*) AS ?n) { ?d t:d_ltext ?x BIND(LANG(?x) AS ?l) FILTER(LANGMATCHES(?l, 'en')) } GROUP BY ?l", "SELECT lang AS l, count(*) AS n FROM documents WHERE lang='en' GROUP BY 1")
sparql("lang_string_functions", "SELECT ?k (STRLEN(?x) AS ?n) (LANG(UCASE(?x)) AS ?l) (STR(?x) = ?y AS ?same) { ?d t:d_ltext ?x ; t:d_text ?y ; t:doc_id ?k }", "SELECT doc_id AS k, length(text) AS n, lang AS l, true AS same FROM documents")
sparql("if_coalesce_in", "SELECT ?d (COALESCE(?q, -1) AS ?v) (IF(?q = 1, 'good', 'bad') AS ?g) { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } FILTER(?l IN ('en', 'de')) }", "SELECT d.doc_id AS d, coalesce(quality,-1)::BIGINT AS v, CASE WHEN quality=1 THEN 'good' WHEN quality IS NOT NULL THEN 'bad' END AS g FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.lang IN ('en','de')", key("d"))
sparql("bound_and_errors", "SELECT ?d { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } FILTER(!BOUND(?q) || ?q + 1 > 1) }", "SELECT d.doc_id AS d FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality+1>1", key("d"))
sparql("type_tests", "SELECT ?p (COUNT(*) AS ?n) (SUM(IF(ISIRI(?o), 1, 0)) AS ?i) (SUM(IF(ISLITERAL(?o), 1, 0)) AS ?l) (SUM(IF(ISNUMERIC(?o), 1, 0)) AS ?m) (SUM(IF(ISBLANK(?o), 1, 0)) AS ?b) { ?x a t:Nation . ?x ?p ?o } GROUP BY ?p", "SELECT * FROM (VALUES ('urn:tpch:n_name', 25::BIGINT, 0::BIGINT, 25::BIGINT, 0::BIGINT, 0::BIGINT), ('urn:tpch:n_region', 25, 25, 0, 0, 0), ('urn:tpch:n_nationkey', 25, 0, 25, 25, 0), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 25, 25, 0, 0, 0)) v(p, n, i, l, m, b)")
sparql("datatype_and_casts", "SELECT ?k (STR(DATATYPE(?b)) AS ?t) (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:boolean(?z) AS ?f) (xsd:double(?z) AS ?d) { ?c t:c_custkey ?k ; t:c_acctbal ?b BIND(?k - ?k AS ?z) }", "SELECT c_custkey AS k, 'http://www.w3.org/2001/XMLSchema#double' AS t, trunc(c_acctbal)::BIGINT AS i, c_custkey::VARCHAR AS s, false AS f, 0.0::DOUBLE AS d FROM customer")
sparql("iri_functions", "SELECT (STR(IRI(CONCAT('urn:x:', ?n))) AS ?i) (STR(?r) AS ?s) (LANG(STRLANG(?n, 'en')) AS ?l) (STR(DATATYPE(STRDT(?n, t:name))) AS ?d) { ?r t:r_name ?n FILTER(?n != 'MIDDLE EAST') }", "SELECT 'urn:x:' || r_name AS i, 'urn:tpch:region/' || r_regionkey AS s, 'en' AS l, 'urn:tpch:name' AS d FROM region WHERE r_name <> 'MIDDLE EAST'")
sparql("fresh_values", "SELECT (COUNT(DISTINCT ?u) AS ?n) (MIN(STRLEN(STR(?u))) AS ?l) (SUM(IF(?x >= 0 && ?x < 1, 1, 0)) AS ?r) { ?c t:c_name ?m BIND(UUID() AS ?u) BIND(RAND() AS ?x) }", "SELECT count(*) AS n, 45::BIGINT AS l, count(*) AS r FROM customer")
sparql("numeric_promotion", "SELECT ?k (?z + 0.5 AS ?a) (?z * 1.0e0 AS ?b) (?z = 7.0 AS ?e) { ?p t:p_partkey ?k ; t:p_size ?z }", "SELECT p_partkey AS k, p_size + 0.5::DOUBLE AS a, p_size::DOUBLE AS b, p_size = 7 AS e FROM part", rounded("a"))

# -- geo (X1-X14)
POINTS = """?n t:n_nationkey ?k BIND(STRDT(CONCAT('POINT(', STR(?k * 5 - 60), ' ', STR(?k * 2 - 25), ')'), <http://www.opengis.net/ont/geosparql#wktLiteral>) AS ?a)
    BIND('POINT(10 50)'^^<http://www.opengis.net/ont/geosparql#wktLiteral> AS ?b)"""
GEOF = "PREFIX geof: <http://www.opengis.net/def/function/geosparql/> "
sparql("geo_distance", GEOF + f"SELECT ?k (geof:distance(?a, ?b) AS ?d) {{ {POINTS} }}", "SELECT n_nationkey::BIGINT AS k, round(2*6371008.8*asin(sqrt(pow(sin(radians(50-(n_nationkey*2-25))/2),2) + cos(radians(n_nationkey*2-25))*cos(radians(50))*pow(sin(radians(10-(n_nationkey*5-60))/2),2))), 2) AS d FROM nation", rounded("d"))
sparql("geo_relations", GEOF + f"SELECT ?k (geof:sfWithin(?a, ?r) AS ?w) (geof:sfTouches(?a, ?r) AS ?t) (geof:sfIntersects(?a, ?r) AS ?i) (geof:sfDisjoint(?a, ?r) AS ?j) (geof:sfContains(?r, ?a) AS ?c) (geof:sfCrosses(?a, ?r) AS ?x) {{ {POINTS} BIND('POLYGON((-50 -30, 0 -30, 0 0, -50 0, -50 -30))'^^<http://www.opengis.net/ont/geosparql#wktLiteral> AS ?r) }}", "SELECT n_nationkey::BIGINT AS k, x > -50 AND x < 0 AND y > -30 AND y < 0 AS w, i AND NOT (x > -50 AND x < 0 AND y > -30 AND y < 0) AS t, i, NOT i AS j, x > -50 AND x < 0 AND y > -30 AND y < 0 AS c, false AS x FROM (SELECT *, x >= -50 AND x <= 0 AND y >= -30 AND y <= 0 AS i FROM (SELECT n_nationkey, n_nationkey*5-60 AS x, n_nationkey*2-25 AS y FROM nation))")
sparql("geo_text", GEOF + f"SELECT ?k (STR(geof:envelope(?a)) AS ?e) (geof:getSRID(?a) AS ?s) (geof:isValid(?a) AS ?v) {{ {POINTS} }}", "SELECT n_nationkey::BIGINT AS k, 'POINT(' || (n_nationkey*5-60) || ' ' || (n_nationkey*2-25) || ')' AS e, 4326::BIGINT AS s, true AS v FROM nation")


# -- reasoning, validation, updates, files and vectors
def registered(oracle: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def take(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return take


def part_of(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    """Some tables of the mapping, whole."""
    return Dataset(spark, [m for m in tables_engine(spark, sf_dir).data.maps if m.name in names])


def statements(spark: SparkSession, text: str) -> DataFrame:
    """Quads of a small Turtle text (schemas and shapes that belong to a query)."""
    from .sources.rdf_io import QUADS, canonical, parse_streaming

    rows = [(e[1], e[2], e[3], e[4]) for e in parse_streaming(text, "q_") if e[0] == "quad"]
    df = spark.createDataFrame(rows, QUADS)
    v, dt = canonical(F.col("o.v"), F.col("o.dt"))
    lit = F.col("o.kind") == "literal"
    return df.withColumn("o", F.struct(F.col("o.kind").alias("kind"), F.when(lit, v).otherwise(F.col("o.v")).alias("v"), F.when(lit, dt).alias("dt"), F.col("o.lang").alias("lang")))


TURTLE = "@prefix t: <urn:tpch:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix sh: <http://www.w3.org/ns/shacl#> . "


@registered("SELECT c_custkey AS c FROM customer")
def infer_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = part_of(spark, sf_dir, "customer").with_quads(statements(spark, TURTLE + "t:c_nation rdfs:domain t:Located ."))
    engine, _ = Engine(data, {"t": "urn:tpch:"}).infer()
    return key("c")(engine.query("SELECT ?c { ?c a t:Located }"))


@registered("SELECT 'urn:tpch:customer/' || c_custkey AS x FROM customer UNION ALL SELECT 'urn:tpch:supplier/' || s_suppkey FROM supplier")
def infer_subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = part_of(spark, sf_dir, "customer", "supplier").with_quads(statements(spark, TURTLE + "t:Customer rdfs:subClassOf t:Party . t:Supplier rdfs:subClassOf t:Party ."))
    engine, _ = Engine(data, {"t": "urn:tpch:"}).infer()
    return engine.query("SELECT ?x { ?x a t:Party }")


@registered("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
def infer_inverse_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owl:inverseOf over a foreign key."""
    data = part_of(spark, sf_dir, "nation").with_quads(statements(spark, TURTLE + "t:n_region owl:inverseOf t:hasNation ."))
    engine, _ = Engine(data, {"t": "urn:tpch:"}).infer()
    return key("r")(engine.query("SELECT ?r (COUNT(?n) AS ?n2) { ?r t:hasNation ?n } GROUP BY ?r")).select(F.col("r").cast("int").alias("r"), F.col("n2").alias("n"))


@registered("SELECT 741::BIGINT AS n, false AS timed_out, false AS inconsistent")
def infer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TURTLE + " ".join(f"t:n{k} rdfs:subClassOf t:n{k + 1} ." for k in range(1, 40))
    r = materialize(statements(spark, text))
    return spark.range(1).select(F.lit(r.inferred_triples).cast("bigint").alias("n"), F.lit(r.timed_out).alias("timed_out"), F.lit(r.inconsistent).alias("inconsistent"))


@registered("SELECT c_custkey AS focus, c_acctbal AS value FROM customer WHERE c_acctbal<0")
def shacl_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = statements(spark, TURTLE + "t:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:property [ sh:path t:c_acctbal ; sh:minInclusive 0 ] .")
    _, rows = Engine(part_of(spark, sf_dir, "customer")).validate(shapes)
    return rows.select(F.regexp_extract("focus_node.v", "([0-9]+)$", 1).cast("bigint").alias("focus"), F.col("value.v").cast("double").alias("value"))


@registered("SELECT d.doc_id AS focus FROM documents d ANTI JOIN labels b ON d.doc_id=b.doc_id")
def shacl_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = statements(spark, TURTLE + "t:S a sh:NodeShape ; sh:targetClass t:Document ; sh:property [ sh:path t:quality ; sh:minCount 1 ] .")
    _, rows = Engine(part_of(spark, sf_dir, "documents", "labels")).validate(shapes)
    return rows.select(F.regexp_extract("focus_node.v", "([0-9]+)$", 1).cast("bigint").alias("focus"))


@registered("SELECT 'Datatype' AS component, count(*) AS n FROM part UNION ALL SELECT 'Pattern', count(*) FROM part WHERE NOT regexp_matches(p_name, 'l') HAVING count(*)>0 UNION ALL SELECT 'In', count(*) FROM part WHERE p_size NOT IN (1,2,3) HAVING count(*)>0")
def shacl_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = statements(spark, TURTLE + "t:S a sh:NodeShape ; sh:targetClass t:Part ; sh:property [ sh:path t:p_retailprice ; sh:datatype t:none ] ; sh:property [ sh:path t:p_name ; sh:pattern 'l' ] ; sh:property [ sh:path t:p_size ; sh:in ( 1 2 3 ) ] .")
    _, rows = Engine(part_of(spark, sf_dir, "part")).validate(shapes)
    return rows.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent", 1).alias("component")).agg(F.count("*").alias("n"))


@registered("SELECT CASE WHEN o_orderstatus='F' THEN 'X' ELSE o_orderstatus END AS s, count(*) AS n FROM orders GROUP BY 1")
def update_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, as_quads(part_of(spark, sf_dir, "orders")))
    store.update('DELETE { ?o t:o_orderstatus "F" } INSERT { ?o t:o_orderstatus "X" } WHERE { ?o t:o_orderstatus "F" }', {"t": "urn:tpch:"})
    df = Engine(store.dataset(), {"t": "urn:tpch:"}).query("SELECT ?s (COUNT(?o) AS ?n) { ?o t:o_orderstatus ?s } GROUP BY ?s")
    return df.withColumn("s", F.col("s.v"))


@registered("SELECT 'urn:x:b' AS g, count(*) AS n FROM nation")
def update_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, as_quads(part_of(spark, sf_dir, "nation")))
    store.update("INSERT { GRAPH <urn:x:a> { ?n t:n_name ?v } } WHERE { ?n t:n_name ?v } ; COPY <urn:x:a> TO <urn:x:b> ; DROP GRAPH <urn:x:a> ; CLEAR DEFAULT", {"t": "urn:tpch:"})
    return Engine(store.dataset()).query("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


@registered("SELECT count(*) AS now, (SELECT count(*) FROM region) AS before FROM region WHERE r_regionkey > 1")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, as_quads(part_of(spark, sf_dir, "region")))
    first = store.pin()
    store.update("DELETE { ?r ?p ?o } WHERE { ?r t:r_regionkey ?k ; ?p ?o FILTER(?k <= 1) }", {"t": "urn:tpch:"})
    count = lambda v: Engine(store.dataset(v), {"t": "urn:tpch:"}).query("SELECT (COUNT(*) AS ?n) { ?r t:r_name ?x }")
    return count(None).withColumnRenamed("n", "now").crossJoin(count(first).withColumnRenamed("n", "before"))


@registered("""WITH c AS (SELECT '<urn:tpch:customer/' || c_custkey || '> <' AS s, * FROM customer), x AS (SELECT '>' AS e, '"^^<http://www.w3.org/2001/XMLSchema#integer> .' AS i)
    SELECT s || 'urn:tpch:c_name> "' || c_name || '" .' AS line FROM c UNION ALL SELECT s || 'urn:tpch:c_mktsegment> "' || c_mktsegment || '" .' FROM c UNION ALL SELECT s || 'urn:tpch:c_nation> <urn:tpch:nation/' || c_nationkey || '> .' FROM c
    UNION ALL SELECT s || 'urn:tpch:c_custkey> "' || c_custkey || i FROM c, x UNION ALL SELECT s || 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:tpch:Customer> .' FROM c""")
def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements of the table but those of its one double, whose lexical form SQL writes otherwise (read_ntriples has it)."""
    quads = as_quads(part_of(spark, sf_dir, "customer"))
    return quads.where(F.col("p") != "urn:tpch:c_acctbal").select(statement(False).alias("line"))


@registered("""SELECT '{"k":{"type":"literal","value":"' || r_regionkey || '","datatype":"http://www.w3.org/2001/XMLSchema#integer"},"n":{"type":"literal","value":"' || r_name || '"}}' AS binding FROM region""")
def json_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_json(tables_engine(spark, sf_dir).query("SELECT ?k ?n { ?r t:r_regionkey ?k ; t:r_name ?n }"))


@registered("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id=0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = df.where("vec_id = 0").select("embedding").first()
    hits = semantic.top_k(df, "embedding", list(first[0]) if first else [0.0], 10, "vec_id")
    return hits.withColumn("score", F.round("score", 6))


@registered()
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names nearest to a phrase; hashing has no SQL twin."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_name").alias("term")).distinct()
    vectors = names.select("term", semantic.embedding(F.col("term")).alias("vec"))
    return semantic.top_k(vectors, "vec", semantic.embed("large steel").tolist(), 10, "term")


@registered("SELECT 5 * 3 + 25 * 4 AS quads, 30 AS subjects, 6 AS predicates")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, as_quads(part_of(spark, sf_dir, "region", "nation")))
    return store.statistics().select(*[F.col(c).cast("int").alias(c) for c in ("quads", "subjects", "predicates")])


# -- joins over unbound variables, correlated EXISTS, closures in graphs
sparql("count_all", "SELECT (COUNT(*) AS ?n) { ?s ?p ?o . ?s a t:Region }", "SELECT 3 * count(*) AS n FROM region")
sparql("optional_chain", "SELECT ?l ?q ?t { ?d t:d_lang ?l OPTIONAL { ?d t:quality ?q } OPTIONAL { ?d t:quality ?q ; t:toxic ?t } }", "SELECT d.lang AS l, b.quality::BIGINT AS q, b.toxic::BIGINT AS t FROM documents d LEFT JOIN labels b ON d.doc_id=b.doc_id")
sparql("minus_unbound", "SELECT ?d { { ?d t:d_lang ?l OPTIONAL { ?d t:toxic ?q } } MINUS { ?d t:d_source 'src0' . ?d t:toxic ?q } }", "SELECT d.doc_id AS d FROM documents d LEFT JOIN labels b ON d.doc_id=b.doc_id WHERE NOT (d.source='src0' AND b.toxic IS NOT NULL)", key("d"))
sparql("exists_nested", "SELECT ?c { ?c t:c_acctbal ?b ; t:c_nation ?n FILTER EXISTS { { ?s t:s_nation ?n ; t:s_acctbal ?x FILTER(?x > ?b) } UNION { ?s t:s_nation ?n ; t:s_suppkey ?x FILTER(?x = ?b) } } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=c_nationkey AND (s_acctbal>c_acctbal OR s_suppkey=c_acctbal))", key("c"))
sparql("graph_closure", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?c t:c_nation+ ?x } } GROUP BY ?g", "SELECT 'urn:tpch:g/region-' || n_regionkey AS g, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")


# -- files (A1-A4, A9, A10): a whole table written out and read back
def read_back(name: str, fmt: str, graph: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/rdf-{uuid.uuid4().hex}"
        quads = as_quads(part_of(spark, sf_dir, "customer")).withColumn("g", F.lit(graph).cast("string"))
        quads.select(statement(graph is not None).alias("value")).write.text(path)
        data = Dataset(spark, [], load_rdf(spark, path, fmt))
        inner = "?c t:c_name ?n ; t:c_acctbal ?b ; t:c_nation ?x"
        text = f"GRAPH <{graph}> {{ {inner} }}" if graph else inner
        df = Engine(data, {"t": "urn:tpch:"}).query(f"SELECT ?n ?b ?x {{ {text} }}")
        return df.select(F.col("n.v").alias("n"), F.col("b.v").cast("double").alias("b"), F.col("x.v").alias("x"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = "SELECT c_name AS n, c_acctbal AS b, 'urn:tpch:nation/' || c_nationkey AS x FROM customer"


read_back("read_ntriples", "ntriples")
read_back("read_nquads", "nquads", "urn:x:g")
read_back("read_turtle", "turtle")
read_back("read_trig", "trig")


# -- updates over whole tables
def updated(name: str, tables: tuple[str, ...], request: str, query: str, oracle: str, after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, as_quads(part_of(spark, sf_dir, *tables)))
        store.update(request, {"t": "urn:tpch:"})
        df = Engine(store.dataset(), {"t": "urn:tpch:"}).query(query)
        return after(df) if after else df

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle


BY_GRAPH = "SELECT ?g ?p (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g ?p"
updated("update_data", ("region", "nation"), 'INSERT DATA { <urn:tpch:nation/0> t:note "x" . <urn:tpch:nation/1> t:note "y" } ; DELETE DATA { <urn:tpch:nation/1> t:note "y" . <urn:tpch:region/0> t:r_name "AFRICA" . <urn:none> t:note "x" }', "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p",
        "SELECT 'urn:tpch:note' AS p, 1 AS n UNION ALL SELECT 'urn:tpch:r_name', count(*) FROM region WHERE r_name<>'AFRICA' UNION ALL SELECT 'urn:tpch:r_regionkey', count(*) FROM region UNION ALL SELECT unnest(['urn:tpch:n_name','urn:tpch:n_nationkey','urn:tpch:n_region']), count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)")
updated("update_delete_where", ("customer",), 'DELETE WHERE { ?c t:c_mktsegment "BUILDING" ; t:c_acctbal ?b }', "SELECT ?p (COUNT(*) AS ?n) { ?c ?p ?o FILTER(?p IN (t:c_mktsegment, t:c_acctbal, t:c_name)) } GROUP BY ?p",
        "SELECT unnest(['urn:tpch:c_mktsegment','urn:tpch:c_acctbal']) AS p, count(*) AS n FROM customer WHERE c_mktsegment<>'BUILDING' UNION ALL SELECT 'urn:tpch:c_name', count(*) FROM customer")
updated("update_with_using", ("orders",), "INSERT { GRAPH <urn:x:a> { ?o t:o_orderstatus ?v } } WHERE { ?o t:o_orderstatus ?v } ; WITH <urn:x:a> DELETE { ?o t:o_orderstatus ?v } INSERT { ?o t:state ?v } WHERE { ?o t:o_orderstatus ?v FILTER(?v != 'O') } ; INSERT { GRAPH <urn:x:b> { ?o t:copy ?v } } USING <urn:x:a> WHERE { ?o t:state ?v }", BY_GRAPH,
        "SELECT 'urn:x:a' AS g, 'urn:tpch:o_orderstatus' AS p, count(*) AS n FROM orders WHERE o_orderstatus='O' UNION ALL SELECT 'urn:x:a', 'urn:tpch:state', count(*) FROM orders WHERE o_orderstatus<>'O' UNION ALL SELECT 'urn:x:b', 'urn:tpch:copy', count(*) FROM orders WHERE o_orderstatus<>'O'")
updated("update_add_move_load", ("supplier",), "CREATE GRAPH <urn:x:n> ; ADD DEFAULT TO <urn:x:a> ; MOVE <urn:x:a> TO <urn:x:b> ; LOAD <urn:x:b> INTO GRAPH <urn:x:c> ; ADD SILENT <urn:x:none> TO <urn:x:c>", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", "SELECT unnest(['urn:x:b','urn:x:c']) AS g, 5 * count(*) AS n FROM supplier")


# -- shapes (V2-V18): results by component
def shapes(name: str, tables: tuple[str, ...], target: str, body: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, rows = Engine(part_of(spark, sf_dir, *tables)).validate(statements(spark, TURTLE + f"t:S a sh:NodeShape ; {target} ; {body} ."))
        return rows.groupBy(F.regexp_extract("component", "#(.*)ConstraintComponent", 1).alias("component")).agg(F.count("*").alias("n"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = "SELECT component, n FROM (" + oracle + ") WHERE n > 0"


def told(component: str, table: str, where: str) -> str:
    return f"SELECT '{component}' AS component, count(*) AS n FROM {table} WHERE {where}"


shapes("shacl_class_kind", ("customer", "nation"), "sh:targetClass t:Customer", "sh:property [ sh:path t:c_nation ; sh:class t:Region ; sh:nodeKind sh:Literal ]", " UNION ALL ".join(told(c, "customer", "true") for c in ("Class", "NodeKind")))
shapes("shacl_lengths", ("part",), "sh:targetClass t:Part", "sh:property [ sh:path t:p_name ; sh:minLength 11 ; sh:maxLength 12 ]", told("MinLength", "part", "length(p_name)<11") + " UNION ALL " + told("MaxLength", "part", "length(p_name)>12"))
shapes("shacl_bounds", ("orders",), "sh:targetSubjectsOf t:o_totalprice", "sh:property [ sh:path t:o_totalprice ; sh:minExclusive 20000 ; sh:maxExclusive 100000 ; sh:maxInclusive 150000 ]", " UNION ALL ".join(told(c, "orders", w) for c, w in (("MinExclusive", "o_totalprice<=20000"), ("MaxExclusive", "o_totalprice>=100000"), ("MaxInclusive", "o_totalprice>150000"))))
shapes("shacl_pairs", ("part",), "sh:targetClass t:Part", "sh:property [ sh:path t:p_size ; sh:lessThan t:p_partkey ; sh:lessThanOrEquals t:p_partkey ; sh:disjoint t:p_partkey ]", " UNION ALL ".join(told(c, "part", w) for c, w in (("LessThan", "p_size>=p_partkey"), ("LessThanOrEquals", "p_size>p_partkey"), ("Disjoint", "p_size=p_partkey"))))
shapes("shacl_logic", ("customer",), "sh:targetClass t:Customer", "sh:or ( [ sh:property [ sh:path t:c_acctbal ; sh:minInclusive 0 ] ] [ sh:property [ sh:path t:c_mktsegment ; sh:hasValue 'BUILDING' ] ] ) ; sh:not [ sh:property [ sh:path t:c_mktsegment ; sh:hasValue 'MACHINERY' ] ] ; sh:and ( [ sh:property [ sh:path t:c_acctbal ; sh:maxInclusive 5000 ] ] [ sh:property [ sh:path t:c_name ; sh:minCount 1 ] ] ) ; sh:xone ( [ sh:property [ sh:path t:c_acctbal ; sh:minInclusive 0 ] ] [ sh:property [ sh:path t:c_mktsegment ; sh:hasValue 'BUILDING' ] ] )",
       " UNION ALL ".join(told(c, "customer", w) for c, w in (("Or", "c_acctbal<0 AND c_mktsegment<>'BUILDING'"), ("Not", "c_mktsegment='MACHINERY'"), ("And", "c_acctbal>5000"), ("Xone", "(c_acctbal>=0) = (c_mktsegment='BUILDING')"))))
shapes("shacl_closed", ("supplier",), "sh:targetClass t:Supplier", "sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> t:s_suppkey ) ; sh:property [ sh:path t:s_name ]", "SELECT 'Closed' AS component, 2 * count(*) AS n FROM supplier")
shapes("shacl_languages", ("documents",), "sh:targetClass t:Document", "sh:property [ sh:path t:d_ltext ; sh:languageIn ( 'en' 'de' ) ; sh:uniqueLang true ]", told("LanguageIn", "documents", "lang NOT IN ('en','de')"))
shapes("shacl_paths", ("customer", "nation"), "sh:targetClass t:Nation", "sh:property [ sh:path [ sh:inversePath t:c_nation ] ; sh:maxCount 5 ]", "SELECT 'MaxCount' AS component, count(*) AS n FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*)>5)")
shapes("shacl_sequence", ("customer", "nation"), "sh:targetClass t:Customer", "sh:property [ sh:path ( t:c_nation t:n_region ) ; sh:hasValue <urn:tpch:region/1> ]", told("HasValue", "customer JOIN nation ON c_nationkey=n_nationkey", "n_regionkey<>1"))
shapes("shacl_qualified", ("customer", "nation"), "sh:targetClass t:Nation", "sh:property [ sh:path [ sh:inversePath t:c_nation ] ; sh:qualifiedValueShape [ sh:property [ sh:path t:c_mktsegment ; sh:hasValue 'BUILDING' ] ] ; sh:qualifiedMinCount 2 ]", "SELECT 'QualifiedMinCount' AS component, count(*) AS n FROM nation WHERE (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey AND c_mktsegment='BUILDING')<2")
shapes("shacl_node", ("customer", "nation"), "sh:targetObjectsOf t:c_nation", "sh:node [ sh:property [ sh:path t:n_region ; sh:in ( <urn:tpch:region/0> <urn:tpch:region/1> ) ] ]", told("Node", "nation", "n_regionkey NOT IN (0,1) AND n_nationkey IN (SELECT c_nationkey FROM customer)"))


# -- rules over whole tables
def inferred(name: str, tables: tuple[str, ...], ontology: str, query: str, oracle: str, after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = part_of(spark, sf_dir, *tables).with_quads(statements(spark, TURTLE + ontology))
        engine, _ = Engine(data, {"t": "urn:tpch:"}).infer()
        df = engine.query(query)
        return after(df) if after else df

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle


inferred("infer_hierarchies", ("orders",), "t:o_orderstatus rdfs:subPropertyOf t:state . t:state rdfs:subPropertyOf t:fact . t:o_customer rdfs:range t:Buyer ; owl:equivalentProperty t:buyer . t:Order rdfs:subClassOf t:Doc . t:Doc rdfs:subClassOf t:Thing .", "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o FILTER(?p IN (t:state, t:fact, t:buyer)) } GROUP BY ?p", "SELECT unnest(['urn:tpch:state','urn:tpch:fact','urn:tpch:buyer']) AS p, count(*) AS n FROM orders")
inferred("infer_ranges", ("orders", "customer"), "t:o_customer rdfs:range t:Buyer . t:Buyer rdfs:subClassOf t:Party .", "SELECT ?c { ?c a t:Party }", "SELECT DISTINCT o_custkey AS c FROM orders", key("c"))
inferred("infer_lines", ("lineitem",), "t:R owl:someValuesFrom owl:Thing ; owl:onProperty t:l_part . t:H owl:hasValue 'R' ; owl:onProperty t:l_returnflag . t:U owl:unionOf ( t:H t:None ) . t:I owl:intersectionOf ( t:R t:H ) .", "SELECT ?c (COUNT(*) AS ?n) { ?l a ?c FILTER(?c IN (t:R, t:H, t:U, t:I)) } GROUP BY ?c",
         "SELECT 'urn:tpch:R' AS c, count(*) AS n FROM lineitem UNION ALL SELECT unnest(['urn:tpch:H','urn:tpch:U','urn:tpch:I']), count(*) FROM lineitem WHERE l_returnflag='R'", lambda df: df.withColumn("c", F.col("c.v")))
inferred("infer_chains", ("customer", "nation"), "t:inRegion owl:propertyChainAxiom ( t:c_nation t:n_region ) . t:inRegion owl:inverseOf t:holds . t:near a owl:SymmetricProperty . t:holds rdfs:subPropertyOf t:near .", "SELECT ?r (COUNT(?c) AS ?n) { ?c t:near ?r . ?r t:holds ?c } GROUP BY ?r", "SELECT 'urn:tpch:region/' || n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
inferred("infer_keys", ("customer", "supplier", "nation"), "t:Nation owl:hasKey ( t:n_region ) .", "SELECT (COUNT(*) AS ?n) { ?a <http://www.w3.org/2002/07/owl#sameAs> ?b }", "SELECT sum(k*k)::BIGINT AS n FROM (SELECT count(*) AS k FROM nation GROUP BY n_regionkey HAVING count(*)>1)")


@registered("SELECT true AS inconsistent, 'cax-dw,cls-com,prp-pdw' AS rules")
def infer_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "t:Customer owl:disjointWith t:Buyer . t:o_customer rdfs:range t:Buyer . t:Order owl:complementOf t:Doc . t:o_customer rdfs:domain t:Doc . t:o_customer owl:propertyDisjointWith t:buyer . t:buyer owl:equivalentProperty t:o_customer ."
    r = materialize(as_quads(part_of(spark, sf_dir, "orders", "customer").with_quads(statements(spark, TURTLE + text))))
    return spark.range(1).select(F.lit(r.inconsistent).alias("inconsistent"), F.lit(",".join(sorted(r.contradictions))).alias("rules"))
