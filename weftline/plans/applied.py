"""More queries over the driver's tables, each calling the operator that its name says, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import dates, text
from weftline.operators import core, facts, grading, graph, memory, retrieval, rules
from weftline.plans import ontology
from weftline.plans.catalog import big, query
from weftline.sources.tables import table

_SPACE = r"[\s\p{Z}]+"


def _turns(spark, sf):
    """Turns as facts: fid, subject, statement, date_iso, ftype, session_no."""
    fid = F.format_string("%d-%04d", "conv_id", "turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", fid.alias("fid"), F.col("role").alias("subject"), F.col("text").alias("statement"), F.lit(None).cast("string").alias("date_iso"),
        F.when(F.col("turn") % 2 == 0, "event").otherwise("state").alias("ftype"), F.col("conv_id").alias("session_no"),
    )


_TURNS = "t AS (SELECT conv_id, turn, printf('%d-%04d', conv_id, turn) AS fid, role AS subject, text AS statement, CASE WHEN turn % 2 = 0 THEN 'event' ELSE 'state' END AS ftype FROM conversations)"


# --- B: graphs --------------------------------------------------------------------------------------


def _graph(spark, sf):
    key = lambda k, c: F.create_map(F.lit(k), F.col(c).cast("string"))
    nations, parts = table(spark, sf, "nation"), table(spark, sf, "part")
    entities = nations.select(F.lit("Nation").alias("etype"), key("n", "n_nationkey").alias("key"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"), F.col("n_nationkey").cast("long").alias("ord"))
    # Parts folded by brand: the first name and type of each.
    folded = parts.select(F.lit("Brand").alias("etype"), key("b", "p_brand").alias("key"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type")).alias("props"), F.col("p_partkey").cast("long").alias("ord"))
    relations = nations.select(F.lit("part_of").alias("relation"), F.lit("Nation").alias("head_type"), key("n", "n_nationkey").alias("head_key"), F.lit("Region").alias("tail_type"), key("r", "n_regionkey").alias("tail_key"), F.col("n_nationkey").cast("long").alias("ord"))
    return graph.build_graph(entities.unionByName(folded), relations.unionByName(relations))


@query("""
WITH p AS (SELECT p_brand, arg_min(p_name, p_partkey) AS name, arg_min(p_type, p_partkey) AS type, count(*) AS n FROM part GROUP BY 1)
SELECT 'Nation::n=' || n_nationkey AS node_id, 'Nation' AS etype, n_name AS name, CAST(NULL AS VARCHAR) AS type, CAST(1 AS BIGINT) AS n_merged FROM nation
UNION ALL SELECT 'Brand::b=' || p_brand, 'Brand', name, type, n FROM p UNION ALL SELECT DISTINCT 'Region::r=' || n_regionkey, 'Region', NULL, NULL, 0 FROM nation
""")
def build_graph_nodes(spark, sf):
    """B1: entities folded by key, the first non-empty value of each property, bare endpoints."""
    nodes, _ = _graph(spark, sf)
    prop = lambda k: F.try_element_at("props", F.lit(k)).alias(k)
    return nodes.select("node_id", "etype", prop("name"), prop("type"), *big("n_merged"))


@query("SELECT 'Nation::n=' || n_nationkey AS src, 'part_of' AS relation, 'Region::r=' || n_regionkey AS dst, false AS derived FROM nation")
def build_graph_edges(spark, sf):
    """B1: one edge for each head, relation and tail, though every relation comes twice."""
    _, edges = _graph(spark, sf)
    return edges.select("src", "relation", "dst", "derived")


@query("SELECT 'Supplier::s_suppkey=' || s_suppkey AS src, 'Nation::n_nationkey=' || s_nationkey AS dst FROM supplier")
def axiom_endpoints(spark, sf):
    """located_in edges whose head isn't a customer."""
    s = ontology.store(spark, sf)
    return graph.audit_endpoints(s.edges, s.all_nodes(), "located_in", ["Customer"], ["Nation"]).select("src", "dst")


@query("SELECT conv_id AS query_id, turn AS chunk_id, role FROM conversations WHERE turn % 3 = 0 AND conv_id % 2 = 1")
def mini_graph(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), "role")
    return graph.mini_graph(rows, rows.where("chunk_id % 3 = 0 and query_id % 2 = 1").select("query_id", "chunk_id"))


# --- E: facts ---------------------------------------------------------------------------------------


@query(rf"""
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(role, '{_SPACE}', '', 'g'), regexp_replace(text, '{_SPACE}', '', 'g') ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn = 1
""")
def fact_dedup_turns(spark, sf):
    """One turn for each role and text without white space."""
    return facts.fact_dedup(_turns(spark, sf), "subject", "statement", ["conv_id", "turn"]).select("conv_id", "turn")


@query(rf"""
WITH {_TURNS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t) WHERE rn <= 4)
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, regexp_replace(subject, '{_SPACE}', '', 'g'), regexp_replace(statement, '{_SPACE}', '', 'g') ORDER BY turn) AS k FROM c) WHERE k = 1
""")
def filter_session(spark, sf):
    """The first four facts of each session, deduplicated."""
    return facts.filter_session(_turns(spark, sf), "turn", [], 4).select("conv_id", "turn")


@query(rf"""
WITH {_TURNS}, k AS (SELECT *, regexp_replace(statement, '{_SPACE}', '', 'g') AS f FROM t)
SELECT conv_id, turn FROM k WHERE ftype = 'event' OR f NOT IN (SELECT f FROM k WHERE ftype = 'event' AND f IS NOT NULL)
""")
def audit_merge(spark, sf):
    """States whose text no event has, after all events."""
    rows = _turns(spark, sf)
    return facts.audit_merge(rows.where("ftype = 'event'"), rows.where("ftype = 'state'")).select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS alias FROM events")
def sanitised_alias(spark, sf):
    """An alias that names a speaker or a canonical entity is blank."""
    rows = table(spark, sf, "events")
    return rows.select("event_id", facts.sanitised_alias(F.col("event_type"), F.array(F.lit("click")), F.array(F.lit("view"))).alias("alias"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS name, arg_min(event_type, event_id) AS etype,
  array_to_string(list_sort(list_distinct(list(CASE WHEN event_id % 3 <> 0 THEN event_type END) FILTER (event_id % 3 <> 0))), ',') AS aliases FROM events GROUP BY user_id
""")
def entity_rollup(spark, sf):
    """Each name's first type, and its different aliases; a third of the aliases are blank."""
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("etype"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("alias"), F.col("event_id").alias("ord"))
    return facts.entity_rollup(rows).select("name", "etype", F.array_join("aliases", ",").alias("aliases"))


def _mentions(spark, sf):
    rows = table(spark, sf, "events").where("event_id % 5 = 0")
    user = F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))
    made = rows.select(
        F.col("event_id").cast("string").alias("fid"), user.alias("subject"), F.lit("偏好").alias("ftype"), F.when(F.col("event_id") % 2 == 0, "喜欢").otherwise("no").alias("statement"),
        F.array("event_type").alias("topics"), F.array(F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("sources"), F.array("event_type", user).alias("mentions"),
    )
    kinds = rows.select(F.col("event_type").alias("name"), F.lit("活动").alias("etype")).distinct()
    people = rows.where("user_id % 40 < 20").select(user.alias("name"), F.lit("人物").alias("etype")).distinct()
    return made, kinds.union(people)


@query("""
WITH f AS (SELECT CAST(event_id AS VARCHAR) AS fid, 'u' || (user_id % 40) AS subject, event_type, event_id % 2 = 0 AS happy, user_id % 40 < 20 AS known FROM events WHERE event_id % 5 = 0)
SELECT fid AS src, '属于主题' AS relation, 'topic:' || event_type AS dst FROM f UNION SELECT fid, '记录于', 's' || fid FROM f UNION SELECT fid, '归属于', subject FROM f WHERE known
UNION SELECT fid, '涉及活动', event_type FROM f UNION SELECT fid, '涉及人物', subject FROM f WHERE known UNION SELECT subject, '喜爱', event_type FROM f WHERE known AND happy
""")
def fact_edges(spark, sf):
    """Edges of facts to topics, subjects, sources and mentioned entities, and what people like."""
    return facts.fact_edges(*_mentions(spark, sf))


@query("SELECT 'c' || o_custkey AS head, 'o' || (o_orderkey % 50) AS tail FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 50 < 30")
def entity_edges(spark, sf):
    """Relations between known entities only."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    orders = table(spark, sf, "orders").select(name("c", F.col("o_custkey")).alias("head"), name("o", F.col("o_orderkey") % 50).alias("tail"))
    known = spark.range(30).select(name("o", F.col("id")).alias("name")).union(table(spark, sf, "customer").where("c_custkey % 2 = 0").select(name("c", F.col("c_custkey")))).union(table(spark, sf, "orders").where("o_custkey % 2 = 0").select(name("c", F.col("o_custkey"))).distinct())
    return facts.entity_edges(orders, known).select("head", "tail")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE 'model' END AS date_iso, CASE WHEN o_orderkey % 3 = 0 THEN '日' ELSE '无' END AS granularity FROM orders")
def override_dates(spark, sf):
    """A resolved date replaces the model's."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit("model").alias("date_iso"), F.lit("无").alias("granularity"), F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate").cast("string")).otherwise("").alias("found"))
    return facts.override_dates(rows, F.col("found"), F.lit("日")).select("o_orderkey", "date_iso", "granularity")


@query("""SELECT n_nationkey, substring(sha256('{"k":' || n_nationkey || ',"name":"' || n_name || '"}'), 1, 8) AS digest FROM nation""")
def fingerprint(spark, sf):
    rows = table(spark, sf, "nation")
    return rows.select("n_nationkey", facts.fingerprint(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("digest"))


# --- F: retrieval -----------------------------------------------------------------------------------


@query(rf"""
WITH {_TURNS}, h AS (SELECT *, CASE WHEN contains(lower(statement), 'zebra') THEN 1 WHEN contains(lower(statement), 'the') THEN 2 END AS tier FROM t WHERE subject = 'user' AND ftype = 'event'),
k AS (SELECT * FROM h WHERE tier = (SELECT min(tier) FROM h)) SELECT fid, n, total FROM (SELECT *, row_number() OVER (ORDER BY fid) AS n, count(*) OVER () AS total FROM k) WHERE n BETWEEN 6 AND 10
""")
def facts_by_subject(spark, sf):
    """F8: no fact has the keyword, so synonyms count; the second page of five, with the total."""
    found = retrieval.facts_by_subject(_turns(spark, sf), "user", ["zebra"], {"zebra": ["the"]}, "event", page=2, size=5)
    return found.select("fid", *big("n", "total"))


@query(f"WITH {_TURNS} SELECT coalesce(bool_or(subject = 'assistant' AND contains(lower(statement), 'the')), false) AS found FROM t")
def exists_fact(spark, sf):
    return retrieval.exists_fact(_turns(spark, sf), "assistant", ["the"]).withColumnRenamed("exists", "found")


@query(f"""
WITH {_TURNS}, r AS (SELECT * FROM t WHERE subject = 'user' AND turn % 2 = 0)
SELECT fid, n, total FROM (SELECT *, row_number() OVER (ORDER BY fid) AS n, count(*) OVER () AS total FROM r) WHERE n <= 20
""")
def related_facts(spark, sf):
    """facts with an edge of two kinds to an entity; other relations don't count."""
    rows = _turns(spark, sf)
    relation = F.when(F.col("turn") % 4 == 0, "涉及人物").when(F.col("turn") % 2 == 0, "归属于").otherwise("记录于")
    edges = rows.select(F.col("fid").alias("src"), relation.alias("relation"), F.col("subject").alias("dst"))
    return retrieval.related_facts(rows, edges, "user").select("fid", *big("n", "total"))


@query("SELECT p_partkey FROM part WHERE contains(replace(lower(p_name), ' ', ';'), 'red') AND p_brand = 'Brand#11'")
def facts_by_topic(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", text.tokens(F.col("p_name"), " ").alias("topics"), F.col("p_brand").alias("subject"))
    return retrieval.facts_by_topic(rows, "red", "Brand#11").select("p_partkey")


@query("SELECT s_name AS name FROM supplier WHERE contains(lower(s_name), '1') OR contains(CAST(s_nationkey AS VARCHAR), '1') ORDER BY s_name LIMIT 30")
def find_entities(spark, sf):
    """the text in a name or an alias."""
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.array(F.col("s_nationkey").cast("string")).alias("aliases"), F.lit("Supplier").alias("etype"))
    return retrieval.find_entities(rows, "1", "Supplier").select("name")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' WHEN event_type = 'click' THEN 'press' ELSE event_type END AS resolved FROM events")
def resolve_name(spark, sf):
    """exact names stay, aliases give their name, others themselves."""
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("name"))
    aliases = spark.createDataFrame([("click", "press", 1), ("view", "look", 1)], "alias string, canonical string, ord int")
    return retrieval.resolve_name(rows, spark.createDataFrame([("view",)], "name string"), aliases).select("event_id", "resolved")


@query("""
SELECT p_partkey, tier FROM (SELECT *, min(tier) OVER (PARTITION BY p_size) AS least FROM (SELECT p_partkey, p_size, CAST(CASE WHEN contains(lower(p_name), 'red') THEN 1 ELSE 2 END AS BIGINT) AS tier FROM part)) WHERE tier = least
""")
def least_tier_by_group(spark, sf):
    """K1: the least tier that answers, for each size."""
    tier = F.when(text.has_text(F.col("p_name"), "red"), 1).otherwise(2).cast("long")
    return retrieval.least_tier(table(spark, sf, "part").select("p_partkey", "p_size", tier.alias("tier")), ["p_size"]).select("p_partkey", "tier")


# --- G: dates and answers ---------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(d) - 1 AS VARCHAR) WHEN 1 THEN strftime(CAST(d - to_months(CAST(o_orderkey % 9 + 1 AS INTEGER)) AS DATE), '%Y-%m')
  WHEN 2 THEN CAST(CAST(d - CAST(7 * (o_orderkey % 9 + 1) AS INTEGER) AS DATE) AS VARCHAR) ELSE '' END AS value,
  CASE o_orderkey % 4 WHEN 0 THEN '年' WHEN 1 THEN '月' WHEN 2 THEN '周' ELSE '无' END AS granularity FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def resolve_relative(spark, sf):
    """Last year, N months ago, N weekends ago, and numbers that no calendar holds."""
    n = (F.col("o_orderkey") % 9 + 1).cast("string")
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, "去年").when(kind == 1, F.concat(n, F.lit("个月前"))).when(kind == 2, F.concat(n, F.lit("个周末前"))).otherwise(F.concat(n, F.lit("9999999999个月前")))
    rows = table(spark, sf, "orders").select("o_orderkey", dates.relative_date(F.to_date("o_orderdate"), said).alias("r"))
    return rows.select("o_orderkey", "r.value", "r.granularity")


@query("SELECT o_orderkey, year(d) || '-' || month(d) || '-' || day(d) || 'ok' AS answer FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def normalize_answer(spark, sf):
    """Dates in digits, no marks or space, lower case."""
    day = F.to_date("o_orderdate")
    said = F.concat(F.year(day).cast("string"), F.lit(" 年 "), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日。（OK！）"))
    return table(spark, sf, "orders").select("o_orderkey", dates.normalized_answer(said).alias("answer"))


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AS same FROM orders")
def answer_equivalent(spark, sf):
    """A year covers a date in it, and not in the next."""
    year = F.year(F.to_date("o_orderdate"))
    gold = F.concat(year.cast("string"), F.lit("年"))
    answer = F.concat((year + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("年3月"))
    return table(spark, sf, "orders").select("o_orderkey", dates.same_answer(gold, answer).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 20 AS BIGINT) END AS nights FROM orders")
def nights_between(spark, sf):
    """Nights between dates in two notations; what isn't a date gives null."""
    day = F.to_date("o_orderdate")
    end = F.date_format(F.date_add(day, (F.col("o_orderkey") % 20).cast("int")), "M/d/yyyy")
    said = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(end)
    return table(spark, sf, "orders").select("o_orderkey", dates.nights_between(F.date_format(day, "yyyy-MM-dd"), said).cast("long").alias("nights"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, substring('一二三四五六日', CAST(isodow(CAST(o_orderdate AS DATE)) AS INTEGER), 1) AS sign FROM orders")
def session_dates(spark, sf):
    """A session's date from its heading, and the sign of its weekday."""
    heading = F.concat(F.lit("1:56 pm on "), F.date_format("o_orderdate", "d MMMM, yyyy"))
    day = dates.parse_session_datetime(heading)
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), dates.weekday_sign(day).alias("sign"))


# --- H: grading -------------------------------------------------------------------------------------


def _judged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@query("""
SELECT count(*) AS n, round(count(*) FILTER (quality = 1) / greatest(count(*), 1), 4) AS strict, round(count(*) FILTER (quality = 1 OR n_chars > 1500) / greatest(count(*), 1), 4) AS lenient,
  count(*) FILTER (quality <> 1 AND n_chars > 1500) AS flips FROM documents JOIN labels USING (doc_id)
""")
def lenient_rescore(spark, sf):
    rows = _judged(spark, sf).select(F.when(F.col("quality") == 1, "exact").otherwise("wrong").alias("grade"), (F.col("n_chars") > 1500).alias("lenient_ok"))
    return grading.lenient_rescore(rows)


@query("""
SELECT doc_id, CASE WHEN toxic = 0 AND doc_id % 2 = 0 THEN CAST('q' || doc_id AS VARCHAR) ELSE 'asked' END AS question, CASE WHEN toxic = 0 AND doc_id % 2 = 0 THEN 4 ELSE 5 END AS category,
  CASE WHEN doc_id % 2 = 0 AND toxic = 0 THEN 'fixed' WHEN doc_id % 2 = 0 THEN NULL ELSE 'gold' END AS answer FROM labels
""")
def apply_repairs(spark, sf):
    """H1: a repair replaces the gold; an adversarial one clears it and keeps its category."""
    labels = table(spark, sf, "labels")
    asked = labels.select(F.col("doc_id").alias("idx"), F.lit("asked").alias("question"), F.lit(5).alias("category"), F.lit("gold").alias("answer"))
    fixes = labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("idx"), F.lit("fixed").alias("answer"), (F.col("toxic") == 1).alias("adversarial"), F.when(F.col("toxic") == 0, F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("question"))
    return grading.apply_repairs(asked, fixes).select(F.col("idx").alias("doc_id"), "question", "category", "answer")


@query("SELECT doc_id, quality, 'repaired' AS gold_version FROM labels UNION ALL SELECT doc_id, 1 - quality, 'original' FROM labels")
def grade_all(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return grading.grade_all(labels, labels.withColumn("quality", (1 - F.col("quality")).cast("int")))


@query("SELECT doc_id, array_to_string(list_filter(['valid_cost', CASE WHEN quality = 1 THEN 'valid_room_rule' END, CASE WHEN toxic = 1 THEN 'valid_cuisine' END], lambda x: x IS NOT NULL), ',') AS keys FROM labels")
def applicable_keys(spark, sf):
    """Constraints that a query's map makes applicable; the cost always is."""
    constraint = F.create_map(F.lit("house rule"), F.when(F.col("quality") == 1, "pets").otherwise(""), F.lit("cuisine"), F.when(F.col("toxic") == 1, "Thai"))
    return table(spark, sf, "labels").select("doc_id", F.array_join(grading.applicable_keys(constraint), ",").alias("keys"))


@query("""
WITH s AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS delivered, coalesce(quality = 1, false) AS a, coalesce(toxic = 0, false) AS b, n_chars % 2 = 0 AS applies, coalesce(n_chars > 1000, false) AND l.doc_id IS NOT NULL AS h FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS n, round(count(*) FILTER (delivered) / count(*), 4) AS delivery, round(sum(a::INT + b::INT) / (count(*) * 2), 4) AS soft_micro, round(count(*) FILTER (a AND b) / count(*), 4) AS soft_macro,
  round(count(*) FILTER (applies AND h) / greatest(count(*) FILTER (applies), 1), 4) AS hard_micro, round(count(*) FILTER (delivered AND (NOT applies OR h)) / count(*), 4) AS hard_macro,
  round(count(*) FILTER (delivered AND a AND b AND (NOT applies OR h)) / count(*), 4) AS final FROM s
""")
def plan_scores(spark, sf):
    """Rates over fixed denominators; documents without labels deliver nothing."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "n_chars")
    asked = docs.select("query_id", F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("applicable"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.lit(True).alias("delivered"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")).join(docs.select("query_id", (F.col("n_chars") > 1000).alias("h")), "query_id")
    return grading.plan_scores(asked, done, ["a", "b"], ["h"])


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN n_chars > 1000 END AS gated FROM documents JOIN labels USING (doc_id)")
def gate_hard(spark, sf):
    return _judged(spark, sf).select("doc_id", grading.gate_hard(F.col("n_chars") > 1000, F.col("quality") == 1, F.col("toxic") == 0).alias("gated"))


@query("SELECT doc_id, n_chars % 7 > n_chars % 5 OR (quality = 0 AND toxic = 0 AND n_chars % 2 < n_chars % 3) AS adopted FROM documents JOIN labels USING (doc_id)")
def adopts(spark, sf):
    """A greater score, or fewer blockers while nothing is final."""
    c = F.col("n_chars")
    return _judged(spark, sf).select("doc_id", grading.adopts(c % 5, c % 7, F.col("quality"), F.col("toxic"), c % 3, c % 2).alias("adopted"))


@query("""
WITH b AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0 AND value > 50) AS before, count(*) FILTER (event_id % 2 = 1 AND value > 50) AS after FROM events GROUP BY 1)
SELECT user_id AS query_id, before, after, CASE WHEN after < before THEN 'improved' WHEN after > before THEN 'worse' ELSE 'same' END AS change FROM b WHERE before + after > 0
""")
def replay_summary(spark, sf):
    """Blocking issues before and after."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("code"), (F.col("value") > 50).alias("blocking"), "event_id")
    return grading.replay_summary(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).select("query_id", *big("before", "after"), "change")


@query("SELECT event_id, event_type IN ('click', 'view') AS routed FROM events")
def route_feedback(spark, sf):
    """Items of some kinds go one way, the others another."""
    mine, other = grading.route_feedback(table(spark, sf, "events").select("event_id", F.col("event_type").alias("target")), ["click", "view"])
    return mine.select("event_id", F.lit(True).alias("routed")).union(other.select("event_id", F.lit(False)))


@query("SELECT p_partkey FROM part WHERE p_size <> 7")
def envelope(spark, sf):
    """Rows with a match note don't answer."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") == 7, "near").otherwise("").alias("match_note"))
    return grading.envelope(rows)[0].select("p_partkey")


@query("SELECT conv_id, string_agg(role || ':' || turn, chr(10) ORDER BY turn) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3 GROUP BY conv_id")
def text_digest(spark, sf):
    """The first lines of each conversation as one text."""
    line = F.concat("role", F.lit(":"), F.col("turn").cast("string"))
    return grading.text_digest(table(spark, sf, "conversations"), ["conv_id"], line, ["turn"], 3)


# --- J, M -------------------------------------------------------------------------------------------


@query("""
SELECT doc_id AS query_id, quality < toxic OR (quality = toxic AND n_chars % 100 < n_chars % 70 - 0.5) AS better FROM documents JOIN labels USING (doc_id)
""")
def dominates(spark, sf):
    """Fewer blocking issues, or as many of the same codes and a total lower by over 0.5."""
    rows, codes = _judged(spark, sf), F.array(F.lit("x"))
    side = lambda n, total: rows.select(F.col("doc_id").alias("query_id"), F.col(n).alias("blocking"), codes.alias("codes"), (F.col("n_chars") % total).alias("total"))
    return rules.dominates(side("quality", 100), side("toxic", 70))


@query("""
SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 2 = 1 AND text <> '') WHERE rn = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)
""")
def memory_additions(spark, sf):
    """M4: texts of a batch that are new to the store, each once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 2 = 0").select(F.md5(F.col("text").cast("binary")).alias("hash"))
    return memory.additions(docs.where("doc_id % 2 = 1"), known, "text", "doc_id").select("doc_id")


@query("SELECT p_partkey, p_name || '|' || p_type AS memories FROM part")
def parse_memories(spark, sf):
    """M6: texts of the memory list in a model's answer, fenced; empty ones don't count."""
    raw = F.concat(F.lit('Here:\n```json\n{"memory": [{"text": "'), "p_name", F.lit('"}, {"text": " "}, {"text": "'), "p_type", F.lit('"}]}\n```'))
    return table(spark, sf, "part").select("p_partkey", F.array_join(memory.parse_memories(raw), "|").alias("memories"))


@query("SELECT 'Part' AS etype, count(*) AS n FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT 'Nation', count(*) FROM nation WHERE contains(lower(n_name), '1')")
def lookup_counts(spark, sf):
    """A1 without a limit."""
    s = ontology.store(spark, sf, ("Part", "Nation"))
    count = lambda etype, field, value: core.lookup_entities(s, etype, {field: value}, limit=None).agg(F.lit(etype).alias("etype"), F.count("*").alias("n"))
    return count("Part", "p_name", "red").union(count("Nation", "n_name", "1"))


# --- Conversations: sessions, annotations, answers ------------------------------------------------------


@query("SELECT o_orderkey AS session_no, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_iso, substring('一二三四五六日', CAST(isodow(CAST(o_orderdate AS DATE)) AS INTEGER), 1) AS weekday FROM orders")
def session_nodes(spark, sf):
    """A node for each session with its ISO date and weekday sign."""
    return facts.session_nodes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_no"), F.to_date("o_orderdate").alias("session_date")))


@query("""
SELECT role AS subject, trim(text, ' ') AS statement, '背景' AS ftype, '无' AS granularity, 'D' || conv_id || ':' || turn AS source, CAST(conv_id AS BIGINT) AS session_no FROM conversations WHERE turn % 2 = 0 AND trim(coalesce(text, ''), ' ') <> ''
UNION ALL SELECT role, trim(text, ' '), '事件', '日', NULL, 0 FROM conversations WHERE turn % 2 = 1 AND trim(coalesce(text, ''), ' ') <> ''
""")
def annotation_facts(spark, sf):
    """Observations and dated events as facts."""
    rows = table(spark, sf, "conversations").select("turn", F.col("role").alias("subject"), F.col("text").alias("statement"), F.format_string("D%d:%d", "conv_id", "turn").alias("dia_id"), F.lit("2024-01-01").alias("date_iso"))
    made = facts.annotation_facts(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"))
    return made.select("subject", "statement", "ftype", "granularity", F.get("sources", F.lit(0)).alias("source"), *big("session_no"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 AS DOUBLE) ELSE 0.0 END AS score FROM events
WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-10' AND (contains(event_type, 'click') OR (event_id % 5 = 0 AND event_id % 3 > 0))
""")
def timeline_scored(spark, sf):
    """dated rows that hold a keyword or that the index ranks, with their scores."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("fid"), F.col("event_type").alias("statement"), F.date_format("ts", "yyyy-MM-dd").alias("date_iso"))
    scores = rows.where("fid % 5 = 0").select("fid", (F.col("fid") % 3).cast("double").alias("score"))
    return retrieval.timeline(rows, "2024-01-10", None, keywords=["click"], scores=scores).select(F.col("fid").alias("event_id"), "score")


@query("""
WITH v AS (SELECT event_id // 3 AS question, event_id % 3 AS ord, event_type AS norm, event_type = 'view' AS refused, event_id % 7 AS evidence FROM events),
p AS (SELECT *, count(*) FILTER (refused) OVER (PARTITION BY question) AS nr FROM v),
q AS (SELECT *, count(*) OVER (PARTITION BY question, norm) AS n FROM p WHERE nr < 2 OR refused),
r AS (SELECT *, CASE WHEN n > 1 THEN 1 WHEN NOT refused THEN 3 ELSE 4 END AS tier FROM q)
SELECT CAST(question AS BIGINT) AS question, CAST(ord AS BIGINT) AS ord, norm AS answer, refused, n FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY tier, CASE WHEN tier > 2 THEN -evidence ELSE 0 END, ord) AS rn FROM r) WHERE rn = 1
""")
def consensus(spark, sf):
    """three events are the candidates of a question, and a view is a refusal."""
    kind, n = F.col("event_type"), F.col("event_id")
    votes = table(spark, sf, "events").select(F.floor(n / 3).cast("long").alias("question"), (n % 3).alias("ord"), kind.alias("answer"), kind.alias("norm"), (kind == "view").alias("refused"), (n % 7).alias("evidence"))
    return retrieval.consensus(votes).select("question", *big("ord"), "answer", "refused", *big("n"))


@query("SELECT event_id, event_id % 150 >= CASE WHEN event_type = 'click' THEN 60 ELSE 110 END AS again FROM events")
def refusal_recheck(spark, sf):
    """refusals that are asked again, by the best fact's score and subject."""
    asked = retrieval.people_asked(F.lit("who made the click"), F.array(F.lit("click"), F.lit("view")))
    return table(spark, sf, "events").select("event_id", retrieval.refusal_recheck(F.col("event_id") % 150, F.col("event_type"), asked).alias("again"))


@query("""
WITH t AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS turn FROM labels), p AS (SELECT *, row_number() OVER (ORDER BY turn, quality) AS place FROM t)
SELECT doc_id, (place - 1) // 9 AS round FROM p WHERE place <= 45
""")
def partition_rounds(spark, sf):
    """Five training rounds of nine rows, with the levels in turn."""
    return grading.partition_rounds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", F.col("doc_id")).select("doc_id", *big("round"))
