"""Queries over the driver's tables and the SQL that must give the same rows.

Each query applies inventory operators to whole tables. Doubles that depend on summation order go
through decimals; integers are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import dates, text
from weftline.operators import core, facts, grading, graph, memory, retrieval
from weftline.plans import ontology
from weftline.sources import tables
from weftline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def big(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- A: core operators ---------------------------------------------------------------------------


@query("""
SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE contains(lower(c_mktsegment), 'building') AND contains(lower(r_name), 'asia') AND c_acctbal >= 0 GROUP BY n_name
""")
def segment_by_nation(spark, sf):
    """Customers of a segment in nations of a region with a balance of at least 0, by nation."""
    s = ontology.store(spark, sf)
    nations = core.filter_relation_connected(s.view("Nation"), s, "part_of", "Region", {"r_name": "ASIA"})
    rows = core.filter_numeric(core.lookup_entities(s, "Customer", {"c_mktsegment": "BUILDING"}, limit=None), "c_acctbal", ">=", 0)
    return rows.join(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 50")
def lookup_entities_substring(spark, sf):
    s = ontology.store(spark, sf)
    return core.lookup_entities(s, "Customer", {"c_mktsegment": "build"}).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part WHERE contains(lower(p_name), 'ring') AND contains(CAST(p_size AS VARCHAR), '1') ORDER BY p_partkey LIMIT 50")
def lookup_entities_multi(spark, sf):
    s = ontology.store(spark, sf, ("Part", "Nation"))
    return core.lookup_entities(s, "Part", {"p_name": "ring", "p_size": 1}).select("p_partkey", "p_name", *big("p_size"))


@query("SELECT 'Part::p_partkey=' || p_partkey AS __id__, 'Part' AS __type__, p_name, CAST(NULL AS VARCHAR) AS missing FROM part")
def project_missing_column(spark, sf):
    return core.project_properties(ontology.view(spark, sf, "Part"), ["p_name", "missing"])


def _categorical(spark, sf, mode):
    return core.filter_categorical(ontology.view(spark, sf, "Part"), "p_name", ["Red", "ring"], mode).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring')")
def filter_categorical_any(spark, sf):
    return _categorical(spark, sf, "any")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring')")
def filter_categorical_all(spark, sf):
    return _categorical(spark, sf, "all")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring'))")
def filter_categorical_exclude(spark, sf):
    return _categorical(spark, sf, "exclude")


@query("""
SELECT op, count(*) AS n FROM (SELECT unnest([CASE WHEN l_quantity < 25 THEN '<' END, CASE WHEN l_quantity <= 25 THEN '<=' END,
  CASE WHEN l_quantity > 25 THEN '>' END, CASE WHEN l_quantity >= 25 THEN '>=' END, CASE WHEN l_quantity = 25 THEN '==' END]) AS op FROM lineitem)
WHERE op IS NOT NULL GROUP BY op
""")
def filter_numeric_each_op(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity")
    out = None
    for op in ("<", "<=", ">", ">=", "=="):
        n = core.filter_numeric(rows, "l_quantity", op, 25).agg(F.lit(op).alias("op"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out.where("n > 0")


@query(r"""
SELECT event_id, TRY_CAST(replace(nullif(regexp_extract(props, '-?[0-9][0-9,]*\.?[0-9]*', 0), ''), ',', '') AS DOUBLE) AS number FROM events
WHERE TRY_CAST(replace(nullif(regexp_extract(props, '-?[0-9][0-9,]*\.?[0-9]*', 0), ''), ',', '') AS DOUBLE) >= 50
""")
def numeric_from_text(spark, sf):
    """Numbers read from JSON text."""
    rows = core.filter_numeric(table(spark, sf, "events"), "props", ">=", 50)
    return rows.select("event_id", text.to_num(F.col("props")).alias("number"))


@query("SELECT p_partkey, p_name FROM part WHERE len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['small', 'red', 'ring', 'widget'])) >= 2")
def filter_set_overlap(spark, sf):
    return core.filter_set_overlap(ontology.view(spark, sf, "Part"), "p_name", ["Small", "red", "ring", "widget"], 2, " ").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND contains(lower(n_name), '_1'))")
def filter_relation_connected(spark, sf):
    s = ontology.store(spark, sf)
    return core.filter_relation_connected(s.view("Customer"), s, "located_in", "Nation", {"n_name": "_1"}).select("c_custkey", "c_name")


def _walk(spark, sf, etype, relation, direction, hops):
    s = ontology.store(spark, sf)
    starts = s.view(etype).select(F.col("__id__").alias("start_id"))
    return core.traverse_relations(s, starts, relation, direction, hops).select("start_id", "node_id", "__type__", F.col("hops").cast("long").alias("hops"))


@query("SELECT 'Customer::c_custkey=' || c_custkey AS start_id, 'Nation::n_nationkey=' || c_nationkey AS node_id, 'Nation' AS __type__, CAST(1 AS BIGINT) AS hops FROM customer")
def traverse_1hop(spark, sf):
    return _walk(spark, sf, "Customer", "located_in", "out", 1)


@query("""
WITH RECURSIVE e AS (
  SELECT 'Customer::c_custkey=' || c_custkey AS src, 'Nation::n_nationkey=' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'Supplier::s_suppkey=' || s_suppkey, 'Nation::n_nationkey=' || s_nationkey FROM supplier
  UNION ALL SELECT 'Nation::n_nationkey=' || n_nationkey, 'Region::r_regionkey=' || n_regionkey FROM nation
), w AS (
  SELECT src AS start_id, dst AS node_id, 1 AS hops FROM e WHERE src LIKE 'Supplier::%'
  UNION ALL SELECT w.start_id, e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.node_id WHERE w.hops < 2
)
SELECT start_id, node_id, split_part(node_id, '::', 1) AS __type__, CAST(min(hops) AS BIGINT) AS hops FROM w GROUP BY start_id, node_id
""")
def traverse_2hop(spark, sf):
    return _walk(spark, sf, "Supplier", None, "out", 2)


@query("SELECT 'Region::r_regionkey=' || n_regionkey AS start_id, 'Nation::n_nationkey=' || n_nationkey AS node_id, 'Nation' AS __type__, CAST(1 AS BIGINT) AS hops FROM nation")
def traverse_in(spark, sf):
    return _walk(spark, sf, "Region", "part_of", "in", 1)


@query("""
WITH one AS (SELECT n_nationkey AS a, n_regionkey AS r FROM nation)
SELECT 'Nation::n_nationkey=' || a AS start_id, 'Region::r_regionkey=' || r AS node_id, 'Region' AS __type__, CAST(1 AS BIGINT) AS hops FROM one
UNION ALL SELECT 'Nation::n_nationkey=' || x.a, 'Nation::n_nationkey=' || y.a, 'Nation', CAST(2 AS BIGINT) FROM one x JOIN one y USING (r)
""")
def traverse_both(spark, sf):
    """Nations and regions both ways; a nation comes back to itself over its region."""
    return _walk(spark, sf, "Nation", "part_of", "both", 2)


@query("""
SELECT 'sum' AS op, CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'min', min(o_totalprice) FROM orders
UNION ALL SELECT 'max', max(o_totalprice) FROM orders UNION ALL SELECT 'count', CAST(count(*) AS DOUBLE) FROM orders
""")
def aggregate_global(spark, sf):
    rows = table(spark, sf, "orders").select("o_totalprice")
    made = [core.aggregate_values(rows, "o_totalprice", op).select(F.lit(op).alias("op"), "value") for op in ("sum", "min", "max", "count")]
    return made[0].union(made[1]).union(made[2]).union(made[3])


@query("""
SELECT o_orderpriority AS "group", round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) AS DOUBLE) / count(o_totalprice), 4) AS average FROM orders GROUP BY 1
""")
def aggregate_grouped(spark, sf):
    return core.aggregate_values(table(spark, sf, "orders"), "o_totalprice", "average", "o_orderpriority").select("group", F.round("value", 4).alias("average"))


@query("""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'and') THEN true ELSE false END AS the_and,
  contains(lower(text), 'question') AS question FROM conversations
""")
def slot_keyword_fallback(spark, sf):
    rows = core.extract_runtime_slots(table(spark, sf, "conversations"), "text", ["the_and", "question"])
    slot = lambda s: F.coalesce(F.try_element_at("slots", F.lit(s)), F.lit(False)).alias(s)
    return rows.select("conv_id", "turn", slot("the_and"), slot("question"))


# --- B: graph ------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn,
  nullif(l_returnflag, 'N') AS flag FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, arg_min(l_partkey, rn) AS l_partkey, arg_min(flag, rn) FILTER (flag IS NOT NULL) AS flag, count(*) AS n_merged
FROM o GROUP BY l_orderkey, l_linenumber
""")
def build_graph_fold(spark, sf):
    """B1: line items folded by key; the first flag that isn't empty wins."""
    rows = table(spark, sf, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return graph.fold(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "flag"], order).select("l_orderkey", *big("l_linenumber"), "l_partkey", "flag", *big("n_merged"))


@query("""
SELECT DISTINCT 'Part::p_partkey=' || l_partkey AS node_id, CAST(0 AS BIGINT) AS n_merged FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)
""")
def build_graph_bare_endpoints(spark, sf):
    """B1: endpoints of of_part edges without an entity among the parts of size 25 or less."""
    known = ontology.view(spark, sf, "Part").where("p_size <= 25").select(F.col("__id__").alias("node_id"))
    ends = table(spark, sf, "lineitem").select(ontology.entity_id("Part", ["p_partkey"], [F.col("l_partkey")]).alias("node_id")).distinct()
    return ends.join(known, "node_id", "left_anti").select("node_id", F.lit(0).cast("long").alias("n_merged"))


@query("SELECT DISTINCT l_orderkey AS src, 'supplied_by' AS relation, l_suppkey AS dst FROM lineitem")
def edge_dedup(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit("supplied_by").alias("relation"), F.col("l_suppkey").alias("dst")).distinct()


@query("""
SELECT DISTINCT 'Part::p_partkey=' || p_partkey AS src, 'has_token' AS relation, 'Token::token=' || t AS dst
FROM (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS t FROM part) WHERE t <> ''
""")
def derive_split_edges(spark, sf):
    return graph.derive_edges(ontology.view(spark, sf, "Part"), "has_token", "p_name", "Token", "token", " ")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers, coalesce(c, 0) > 0 OR coalesce(s, 0) > 0 AS covered FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON s_nationkey = n_nationkey
""")
def enrich_counts_covered(spark, sf):
    counted = {"customers": (table(spark, sf, "customer").where("c_acctbal > 9900"), "c_nationkey"), "suppliers": (table(spark, sf, "supplier").where("s_acctbal > 9000"), "s_nationkey")}
    return graph.enrich_counts(table(spark, sf, "nation"), "n_nationkey", counted).select(*big("n_nationkey"), "n_name", "customers", "suppliers", "covered")


@query("SELECT n_name, m AS min_price FROM nation JOIN (SELECT s_nationkey, min(s_acctbal) FILTER (s_acctbal > 0) AS m FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def covered_min_value(spark, sf):
    suppliers = table(spark, sf, "supplier")
    places = graph.enrich_counts(table(spark, sf, "nation"), "n_nationkey", {"suppliers": (suppliers, "s_nationkey")})
    return graph.covered_minimum(places, "n_nationkey", suppliers, "s_nationkey", "s_acctbal").select("n_name", "min_price")


@query("""
SELECT 'Region' AS __type__, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
""")
def graph_stats_types(spark, sf):
    return graph.stats_types(ontology.store(spark, sf, tuple(ontology.ENTITIES)))


@query("SELECT 'part_of' AS relation, count(*) AS n FROM nation UNION ALL SELECT 'located_in', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'placed_by', count(*) FROM orders")
def graph_stats_relations(spark, sf):
    return graph.stats_relations(ontology.store(spark, sf, tuple(ontology.ENTITIES), ("part_of", "located_in", "placed_by")))


@query("SELECT p_type, p_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 5")
def graph_samples_topk(spark, sf):
    return graph.samples(table(spark, sf, "part"), "p_type", ["p_partkey"]).select("p_type", "p_partkey", *big("rn"))


@query("SELECT l_orderkey AS src, count(DISTINCT l_suppkey) AS tails FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def axiom_functional(spark, sf):
    return graph.audit_functional(edge_dedup(spark, sf), "supplied_by")


@query("SELECT k, CAST(2 AS BIGINT) AS types FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier)")
def axiom_disjoint(spark, sf):
    nodes = ontology.view(spark, sf, "Customer").select("__type__", F.col("c_custkey").alias("k")).union(ontology.view(spark, sf, "Supplier").select("__type__", "s_suppkey"))
    return graph.audit_disjoint(nodes, "k", ["Customer", "Supplier"])


@query("SELECT l_orderkey AS src, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1 HAVING count(*) < 2 OR count(*) > 6")
def axiom_cardinality(spark, sf):
    return graph.audit_cardinality(edge_dedup(spark, sf), "supplied_by", 2, 6)


# --- D: sources and chunks -------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND c_name IS NOT NULL AND c_name <> ''")
def dropna_source(spark, sf):
    rows = table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return tables.dropna(rows, ["c_name", "c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) AS chunk FROM conversations")
def fixed_chunks(spark, sf):
    return tables.fixed_chunks(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "chunk")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), g AS (
  SELECT conv_id, i, 0 AS seq, n AS total, n >= 400 AS full FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN g.full THEN g.seq + 1 ELSE g.seq END, CASE WHEN g.full THEN t.n ELSE g.total + t.n END,
    CASE WHEN g.full THEN t.n ELSE g.total + t.n END >= 400 FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1
)
SELECT conv_id, CAST(seq AS BIGINT) AS seq, count(*) AS turns FROM g GROUP BY conv_id, seq
""")
def greedy_chunks(spark, sf):
    """Turns of each conversation in chunks closed once they reach 400 characters."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    made = turns.select("conv_id", F.posexplode(tables.greedy_chunks(F.col("t"), F.char_length, 400)).alias("seq", "items"))
    return made.select("conv_id", *big("seq"), F.size("items").cast("long").alias("turns"))


# --- E: facts --------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(text, '[\s\p{Z}]+', '', 'g') ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def fact_dedup(spark, sf):
    """E12 over documents: a grouped minimum of doc_id by the folded text's hash, so texts aren't shuffled."""
    docs = table(spark, sf, "documents").select(F.sha2(text.folded(F.coalesce("text", F.lit(""))), 256).alias("k"), "doc_id", "source")
    return docs.groupBy("k").agg(F.min(F.struct("doc_id", "source")).alias("f")).select("f.doc_id", "f.source")


@query(r"""
SELECT c.conv_id, c.turn, coalesce(len(list_filter(regexp_extract_all(c.text, '(\d+(?:\.\d+)?)', 1), lambda x: NOT contains(coalesce(p.text, ''), x))), 0) = 0 AS grounded
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
""")
def grounding_numbers(spark, sf):
    """Whether each number of a turn occurs in the turn before it."""
    turns = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, -1)
    return turns.select("conv_id", "turn", text.numbers_grounded(F.col("text"), F.first("text").over(w)).alias("grounded"))


_ALIASES = [("src1", "alpha"), ("src2", "alpha"), ("src3", "beta"), ("src4", "src4")]


@query("""
SELECT coalesce(c, source) AS source, count(*) AS n FROM documents LEFT JOIN (VALUES ('src1', 'alpha'), ('src2', 'alpha'), ('src3', 'beta')) v(a, c) ON a = source GROUP BY 1
""")
def canonicalize_alias(spark, sf):
    aliases = spark.createDataFrame(_ALIASES, "alias string, canonical string")
    return facts.canonical_names(table(spark, sf, "documents").select("source"), "source", aliases).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, printf('%d-%04d', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS fid FROM conversations")
def format_fact_id(spark, sf):
    return facts.fact_ids(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query("""
SELECT count(*) AS needed, count(l.doc_id) AS covered, round(count(l.doc_id) / greatest(count(*), 1), 3) AS coverage
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def evidence_coverage(spark, sf):
    return facts.evidence_coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


# --- F: retrieval ------------------------------------------------------------------------------------

_ASKED = [(1, "the lake of the north"), (2, "rise and fall"), (3, "casa de la costa")]
_LEX = r"""
WITH docs AS (SELECT item_id, regexp_replace(text, '[\s\p{Z}]+', '', 'g') AS t FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: t[i:i]), list_transform(range(1, length(t)), lambda i: t[i:i+1]))) AS term FROM docs),
w AS (SELECT term, ln(1 + (SELECT count(*) FROM docs) / count(*)) * CASE WHEN length(term) = 1 THEN 2 ELSE 3 END AS idf FROM p GROUP BY term)
"""


@query(_LEX + "SELECT term, round(idf, 6) AS idf FROM w")
def lexical_idf(spark, sf):
    docs = table(spark, sf, "benchmark")
    return retrieval.idf(retrieval.postings(docs, "item_id", F.col("text")), docs).select("term", F.round("idf", 6).alias("idf"))


@query(_LEX + r""", q AS (SELECT i AS query_id, regexp_replace(s, '\s+', '', 'g') AS t FROM (VALUES (1, 'the lake of the north'), (2, 'rise and fall'), (3, 'casa de la costa')) v(i, s)),
qt AS (SELECT DISTINCT query_id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: t[i:i]), list_transform(range(1, length(t)), lambda i: t[i:i+1]))) AS term FROM q),
s AS (SELECT query_id, item_id, sum(idf) AS score FROM p JOIN w USING (term) JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank, score / max(score) OVER (PARTITION BY query_id) AS relative FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, item_id, rank, round(score, 6) AS score, round(relative, 6) AS relative FROM r WHERE rank <= 20
""")
def lexical_topk(spark, sf):
    docs = table(spark, sf, "benchmark")
    posted = retrieval.postings(docs, "item_id", F.col("text"))
    scores = retrieval.lexical_scores(posted, retrieval.idf(posted, docs), spark.createDataFrame(_ASKED, "query_id long, text string"), "item_id")
    return retrieval.lexical_search(scores, "item_id").select("query_id", "item_id", *big("rank"), F.round("score", 6).alias("score"), F.round("relative", 6).alias("relative"))


@query("""
SELECT conv_id, turn, n, total FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n, count(*) OVER (PARTITION BY role) AS total
FROM conversations WHERE role = 'assistant') WHERE n BETWEEN 21 AND 40
""")
def subject_paging(spark, sf):
    """The second page of one subject's rows, with the total."""
    mine = table(spark, sf, "conversations").where(retrieval.subject_matches(F.col("role"), "assistant"))
    return retrieval.paged(mine, ["conv_id", "turn"], 2, 20).select("conv_id", "turn", *big("n", "total"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date_iso FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-20'")
def timeline_range(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date_iso"), F.col("event_id").alias("fid"))
    return retrieval.timeline(rows, "2024-01-10", "2024-01-20").select("event_id", "date_iso")


@query("SELECT t AS topic, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS t FROM part) WHERE t <> '' GROUP BY 1")
def topic_histogram(spark, sf):
    return retrieval.topic_histogram(table(spark, sf, "part"), text.tokens(F.col("p_name"), " "))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def enumerate_distinct_elements(spark, sf):
    return retrieval.enumerate_elements(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_SYNONYMS = [("red", "scarlet"), ("red", "crimson"), ("small", "tiny"), ("ring", "loop")]


@query("""
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT p_partkey, word FROM w UNION SELECT p_partkey, s FROM w JOIN (VALUES ('red', 'scarlet'), ('red', 'crimson'), ('small', 'tiny'), ('ring', 'loop')) v(k, s) ON k = word
""")
def synonym_expand(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return retrieval.synonym_expand(words, "word", spark.createDataFrame(_SYNONYMS, "word string, synonym string"))


@query("""
SELECT p_partkey, tier FROM (SELECT *, min(tier) OVER () AS least FROM (SELECT p_partkey, CAST(CASE WHEN p_brand = 'Brand#99' THEN 1
  WHEN contains(lower(p_name), 'red') AND p_size > 40 THEN 2 WHEN contains(lower(p_name), 'red') THEN 3 END AS BIGINT) AS tier FROM part) WHERE tier IS NOT NULL) WHERE tier = least
""")
def relaxation_tiers(spark, sf):
    """K1: an exact brand, else a colour and size, else the colour."""
    red = text.has_text(F.col("p_name"), "red")
    tier = F.when(F.col("p_brand") == "Brand#99", 1).when(red & (F.col("p_size") > 40), 2).when(red, 3)
    rows = table(spark, sf, "part").select("p_partkey", tier.cast("long").alias("tier")).where("tier is not null")
    return retrieval.least_tier(rows).select("p_partkey", "tier")


# --- G: dates and text -------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(1 + (isodow(o_orderdate) - 1 - 1 - 5 + 14) % 7 AS INTEGER) AS saturday FROM orders")
def last_weekday_before(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.last_weekday_before(F.to_date("o_orderdate"), 5).alias("saturday"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS month_before, CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS half_year_after FROM orders")
def shift_month(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.shift_month(day, -1).alias("month_before"), dates.shift_month(day, 6).alias("half_year_after"))


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[\s\p{Z}]+', '', 'g') AS x, regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '[\s\p{Z}]+', '', 'g') AS y FROM conversations),
p AS (SELECT * FROM t WHERE y IS NOT NULL),
a AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(x)), lambda i: x[i:i+1])) AS g FROM p) GROUP BY ALL),
b AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(y)), lambda i: y[i:i+1])) AS g FROM p) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS n FROM a JOIN b USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN greatest(length(x) - 1, 0) + greatest(length(y) - 1, 0) = 0 THEN 1.0
  ELSE 2.0 * coalesce(n, 0) / (greatest(length(x) - 1, 0) + greatest(length(y) - 1, 0)) END, 6) AS f1 FROM p LEFT JOIN o USING (conv_id, turn)
""")
def char_bigram_f1(spark, sf):
    """Each turn against the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf, "conversations").select("conv_id", "turn", text.folded(F.col("text")).alias("x"), text.folded(F.lag("text").over(w)).alias("y")).where("y is not null")
    return grading.bigram_f1(pairs, ["conv_id", "turn"], "x", "y").select("conv_id", "turn", F.round("f1", 6).alias("f1"))


# --- H: grading ----------------------------------------------------------------------------------------


def _graded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS exact, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def grade_aggregate(spark, sf):
    return grading.grade_aggregate(_graded(spark, sf), "lang", F.col("quality") == 1)


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS exact, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def grade_rollup(spark, sf):
    return grading.grade_aggregate(_graded(spark, sf), "lang", F.col("quality") == 1, rollup=True)


@query("""
SELECT doc_id, CASE WHEN a AND NOT b THEN 'pass_to_fail' ELSE 'fail_to_pass' END AS change FROM (SELECT doc_id, quality = 1 AS a, n_chars > 1500 AS b FROM documents JOIN labels USING (doc_id)) WHERE a <> b
""")
def run_diff(spark, sf):
    rows = _graded(spark, sf)
    return grading.run_diff(rows.select("doc_id", (F.col("quality") == 1).alias("ok")), rows.select("doc_id", (F.col("n_chars") > 1500).alias("ok")), "doc_id", "ok")


@query("""
SELECT lang, label, count(*) AS n FROM (SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'not extracted' WHEN n_chars < 800 THEN 'not retrieved' WHEN toxic = 1 THEN 'refused'
  WHEN quality = 0 THEN 'not cited' ELSE 'answered wrongly' END AS label FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY ALL
""")
def failure_attribution(spark, sf):
    """H8, H9: each document asks for its label as evidence; short ones retrieve nothing, toxic ones refuse, poor ones cite nothing."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels")
    fid = lambda c: F.col(c).cast("string")
    some = lambda test: F.when(test, F.array(fid("doc_id"))).otherwise(F.array().cast("array<string>"))
    failures = docs.join(labels, "doc_id", "left").select(
        fid("doc_id").alias("idx"), "lang", F.array(fid("doc_id")).alias("evidence"), some(F.col("n_chars") >= 800).alias("collected"), some(F.coalesce(F.col("quality") != 0, F.lit(True))).alias("cited"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("refused"),
    )
    made = grading.attribute_failures(failures.drop("lang"), labels.select(fid("doc_id").alias("fid"), F.array(fid("doc_id")).alias("sources")))
    return grading.attribution_summary(made.join(failures.select("idx", "lang"), "idx"), "lang")


@query("""
SELECT doc_id, CASE WHEN (b_ok, b_len) > (a_ok, a_len) THEN 'B' ELSE 'A' END AS pick FROM
(SELECT doc_id, CAST(quality AS BIGINT) AS a_ok, n_chars % 100 AS a_len, CAST(1 - toxic AS BIGINT) AS b_ok, n_chars % 70 AS b_len FROM documents JOIN labels USING (doc_id))
""")
def pick_better(spark, sf):
    rows = _graded(spark, sf)
    a = rows.select("doc_id", F.col("quality").cast("long").alias("ok"), (F.col("n_chars") % 100).alias("len"))
    b = rows.select("doc_id", (1 - F.col("toxic")).cast("long").alias("ok"), (F.col("n_chars") % 70).alias("len"))
    return grading.pick_better(a, b, "doc_id", ["ok", "len"]).select("doc_id", "pick")


@query("SELECT key, value, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS rn FROM (SELECT p_brand AS key, p_type AS value, count(*) AS n FROM part GROUP BY ALL)) WHERE rn <= 5")
def pattern_digest_topk(spark, sf):
    return grading.pattern_digest(table(spark, sf, "part"), F.col("p_brand"), F.col("p_type")).select("key", "value", "n", *big("rn"))


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS turn FROM documents) ORDER BY turn, lang LIMIT 40")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return grading.stratified(docs, "lang", F.md5(F.col("doc_id").cast("string").cast("binary")), 40).select("doc_id", "lang", *big("turn"))


@query("""
SELECT model, namespace, count(*) AS calls, count(*) FILTER (value > 50) AS cache_hits, CAST(sum(length(props)) AS BIGINT) AS prompt_tokens, CAST(sum(user_id) AS BIGINT) AS completion_tokens
FROM (SELECT event_type AS model, CAST(user_id % 3 AS VARCHAR) AS namespace, * FROM events) GROUP BY GROUPING SETS ((), (model), (namespace))
""")
def ledger_grouping_sets(spark, sf):
    calls = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("string").alias("namespace"), (F.col("value") > 50).alias("cache_hit"), F.char_length("props").cast("long").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens")
    )
    return grading.ledger_summary(calls).drop("level")


# --- I, validator, M ---------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, CAST(sum(CAST(floor(p_retailprice * 0.05) AS BIGINT) * CAST(ceil(l_linenumber / 4.0) AS BIGINT)) AS BIGINT) AS ground,
  CAST(sum(CAST(p_retailprice * l_linenumber AS DECIMAL(18,2))) AS DOUBLE) AS meals, CAST(count(*) FILTER (p_partkey IS NULL) AS BIGINT) AS unknown
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 45 GROUP BY l_orderkey
""")
def plan_cost(spark, sf):
    """I8, K7: cost of an order's lines as legs and meals for as many people as the line number; unknown parts are counted."""
    known = table(spark, sf, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(known, "l_partkey", "left")
    ground = F.floor(F.col("p_retailprice") * 0.05) * F.ceil(F.col("l_linenumber") / 4.0)
    meals = (F.col("p_retailprice") * F.col("l_linenumber")).cast("decimal(18,2)")
    return rows.groupBy("l_orderkey").agg(F.sum(ground).cast("long").alias("ground"), F.sum(meals).cast("double").alias("meals"), F.count_if(F.col("p_retailprice").isNull()).alias("unknown"))


@query("""
WITH t AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM t GROUP BY user_id, event_type, island HAVING count(*) >= 2
""")
def islands_min_run(spark, sf):
    """Validator: runs of equal values of at least a length, as for minimum nights."""
    from weftline.operators.rules import runs

    return runs(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"]).groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).where("n >= 2").drop("island")


@query("""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10
""")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id = 7").select("embedding").first()
    vector = F.array(*(F.lit(float(x)) for x in (asked[0] if asked else [])))
    return memory.search(rows, vector, "vec_id", "embedding", 10).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def md5_dedup(spark, sf):
    return memory.first_by_md5(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "copies")


@query("SELECT conv_id, turn, rn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def last_k_messages(spark, sf):
    return memory.last_messages(table(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", *big("rn"))
