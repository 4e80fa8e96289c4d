"""Reasoning and walking over the driver's tables: saturation, clashes, long walks; and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import axioms, core
from weftline.operators.containment import match_entities, match_subjects
from weftline.operators.lexindex import LexicalIndex
from weftline.plans import catalog, ontology
from weftline.plans.catalog import query
from weftline.schema import Schema
from weftline.session import shared_folder
from weftline.sources.tables import table

#: Customers and suppliers are parties and nations and regions places; hosts is located_in seen from the place. Things and entities are the same.
SCHEMA = {
    "entity_types": {n: {"primary_key": ["id"], "attributes": [{"name": "id"}]} for n in ("Region", "Nation", "Customer", "Supplier", "Order", "Party", "Place", "Thing", "Entity", "Embassy")},
    "relation_types": {
        "located_in": {"domain": ["Party"], "range": ["Place"], "functional": True},
        "hosts": {"domain": ["Place"], "range": ["Party"], "inverse_of": "located_in"},
        "part_of": {"domain": ["Nation"], "range": ["Region"]},
        "placed_by": {"domain": ["Order"], "range": ["Customer", "Supplier"]},
        "placed": {"domain": ["Customer", "Supplier"], "range": ["Order"], "inverse_of": "placed_by"},
    },
    "axioms": [
        *({"kind": "subclass", "sub": a, "sup": b} for a, b in (("Customer", "Party"), ("Supplier", "Party"), ("Nation", "Place"), ("Region", "Place"), ("Party", "Thing"), ("Place", "Thing"), ("Thing", "Entity"), ("Entity", "Thing"), ("Embassy", "Party"), ("Embassy", "Place"))),
        {"kind": "disjoint", "classes": ["Party", "Place", "Order"]},
        {"kind": "cardinality", "class": "Customer", "relation": "placed", "min": 1, "max": 15},
    ],
}


def _schema() -> Schema:
    return Schema.from_dict(SCHEMA)


def _facts(spark, sf):
    """Nodes and edges: what the tables say, nations located in nations, and suppliers that host customers."""
    t = lambda n: table(spark, sf, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    node = lambda kind, name, c: t(name).select(key(kind, c).alias("__id__"), F.lit(kind).alias("__type__"))
    nodes = node("Region", "region", "r_regionkey").union(node("Nation", "nation", "n_nationkey")).union(node("Customer", "customer", "c_custkey")).union(node("Supplier", "supplier", "s_suppkey")).union(node("Order", "orders", "o_orderkey"))
    edge = lambda df, a, name, b: df.select(a.alias("src"), F.lit(name).alias("relation"), b.alias("dst"))
    nation, customer = t("nation"), t("customer")
    edges = edge(customer, key("Customer", "c_custkey"), "located_in", key("Nation", "c_nationkey")).union(edge(t("supplier"), key("Supplier", "s_suppkey"), "located_in", key("Nation", "s_nationkey")))
    edges = edges.union(edge(nation, key("Nation", "n_nationkey"), "part_of", key("Region", "n_regionkey"))).union(edge(t("orders"), key("Order", "o_orderkey"), "placed_by", key("Customer", "o_custkey")))
    edges = edges.union(edge(nation.where("n_nationkey % 7 = 0"), key("Nation", "n_nationkey"), "located_in", F.concat(F.lit("Nation:"), ((F.col("n_nationkey") + 1) % 25).cast("string"))))
    return nodes, edges.union(edge(customer.where("c_custkey % 40 = 0"), F.concat(F.lit("Supplier:"), (F.col("c_custkey") % 9 + 1).cast("string")), "hosts", key("Customer", "c_custkey")))


_FACTS = """
nodes AS (SELECT 'Region:' || r_regionkey AS node, 'Region' AS type FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Customer' FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'Order:' || o_orderkey, 'Order' FROM orders),
edges AS (SELECT 'Customer:' || c_custkey AS src, 'located_in' AS relation, 'Nation:' || c_nationkey AS dst FROM customer UNION SELECT 'Supplier:' || s_suppkey, 'located_in', 'Nation:' || s_nationkey FROM supplier
  UNION SELECT 'Nation:' || n_nationkey, 'part_of', 'Region:' || n_regionkey FROM nation UNION SELECT 'Order:' || o_orderkey, 'placed_by', 'Customer:' || o_custkey FROM orders
  UNION SELECT 'Nation:' || n_nationkey, 'located_in', 'Nation:' || ((n_nationkey + 1) % 25) FROM nation WHERE n_nationkey % 7 = 0 UNION SELECT 'Supplier:' || (c_custkey % 9 + 1), 'hosts', 'Customer:' || c_custkey FROM customer WHERE c_custkey % 40 = 0),
sub(a, b) AS (VALUES ('Customer', 'Party'), ('Supplier', 'Party'), ('Nation', 'Place'), ('Region', 'Place'), ('Party', 'Thing'), ('Place', 'Thing'), ('Thing', 'Entity'), ('Entity', 'Thing'), ('Embassy', 'Party'), ('Embassy', 'Place')),
ends(f, t, axiom) AS (VALUES ('src:located_in', 'class:Party', 'domain: located_in -> Party'), ('dst:located_in', 'class:Place', 'range: located_in -> Place'), ('src:hosts', 'class:Place', 'domain: hosts -> Place'), ('dst:hosts', 'class:Party', 'range: hosts -> Party'),
  ('src:part_of', 'class:Nation', 'domain: part_of -> Nation'), ('dst:part_of', 'class:Region', 'range: part_of -> Region'), ('src:placed_by', 'class:Order', 'domain: placed_by -> Order'), ('dst:placed', 'class:Order', 'range: placed -> Order'),
  ('src:hosts', 'dst:located_in', 'inverse: hosts <-> located_in'), ('dst:hosts', 'src:located_in', 'inverse: hosts <-> located_in'), ('src:located_in', 'dst:hosts', 'inverse: hosts <-> located_in'), ('dst:located_in', 'src:hosts', 'inverse: hosts <-> located_in'),
  ('src:placed', 'dst:placed_by', 'inverse: placed <-> placed_by'), ('dst:placed', 'src:placed_by', 'inverse: placed <-> placed_by'), ('src:placed_by', 'dst:placed', 'inverse: placed <-> placed_by'), ('dst:placed_by', 'src:placed', 'inverse: placed <-> placed_by')),
steps AS (SELECT 'class:' || a AS f, 'class:' || b AS t, 'subclass: ' || a || ' <- ' || b AS axiom FROM sub UNION SELECT * FROM ends),
walk AS (SELECT DISTINCT f, f AS t, CAST([] AS VARCHAR[]) AS proof, [f] AS seen FROM (SELECT f FROM steps UNION SELECT t FROM steps)
  UNION ALL SELECT walk.f, steps.t, list_append(proof, axiom), list_append(seen, steps.t) FROM walk JOIN steps ON steps.f = walk.t WHERE NOT list_contains(seen, steps.t)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY len(proof), proof) AS rn FROM walk),
reach AS (SELECT f, t, proof FROM ranked WHERE rn = 1),
told AS (SELECT node, 'class:' || type AS f FROM nodes UNION SELECT src, 'src:' || relation FROM edges UNION SELECT dst, 'dst:' || relation FROM edges),
types0 AS (SELECT node, substr(t, 7) AS type, proof, row_number() OVER (PARTITION BY node, t ORDER BY len(proof), proof) AS rn FROM told JOIN reach USING (f) WHERE starts_with(t, 'class:')),
types AS (SELECT node, type, proof FROM types0 WHERE rn = 1 UNION ALL SELECT node, type, [] FROM nodes WHERE (node, type) NOT IN (SELECT (node, type) FROM types0))"""


@query(f"WITH RECURSIVE {_FACTS} SELECT node, type, array_to_string(proof, '; ') AS proof FROM types")
def saturated_types(spark, sf):
    """Every class of every node with its shortest proof; the classes hold a cycle."""
    nodes, edges = _facts(spark, sf)
    closure = axioms.saturate(axioms.axiom_steps(spark, _schema()))
    return axioms.derived_types(nodes, edges, closure).select("node", "type", F.array_join("proof", "; ").alias("proof"))


@query(f"""WITH RECURSIVE {_FACTS},
links0 AS (SELECT src, relation, dst, CAST([] AS VARCHAR[]) AS proof FROM edges
  UNION ALL SELECT CASE WHEN starts_with(t, 'dst:') THEN dst ELSE src END, substr(t, 5), CASE WHEN starts_with(t, 'dst:') THEN src ELSE dst END, r.proof FROM edges JOIN reach r ON r.f = 'src:' || relation WHERE NOT starts_with(t, 'class:')),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, relation, dst ORDER BY len(proof), proof) AS rn FROM links0) WHERE rn = 1),
fan AS (SELECT src, relation, count(*) AS n, list_sort(list_distinct(flatten(list(proof)))) AS how FROM links GROUP BY ALL),
apart(a, b) AS (VALUES ('Order', 'Party'), ('Order', 'Place'), ('Party', 'Place')),
found AS (
  SELECT x.node, 'disjoint' AS kind, a || ', ' || b AS subject, list_concat(list_concat(x.proof, y.proof), ['disjoint: Order, Party, Place']) AS axioms FROM apart JOIN types x ON x.type = a JOIN types y ON y.type = b AND y.node = x.node
  UNION ALL SELECT src, 'functional', relation, list_append(how, 'functional: ' || relation) FROM fan WHERE relation = 'located_in' AND n > 1
  UNION ALL SELECT t.node, 'cardinality', 'Customer.placed', list_concat(list_concat(t.proof, coalesce(how, [])), ['cardinality: Customer.placed 1..15']) FROM types t LEFT JOIN fan ON src = t.node AND relation = 'placed' WHERE t.type = 'Customer' AND coalesce(n, 0) NOT BETWEEN 1 AND 15)
SELECT node, kind, subject, array_to_string(list_sort(list_distinct(axioms)), '; ') AS axioms FROM found""")
def axiom_clashes(spark, sf):
    """What the instances contradict, and the axioms that together do."""
    nodes, edges = _facts(spark, sf)
    return axioms.clashes(nodes, edges, _schema()).select("node", "kind", "subject", F.array_join(F.array_sort("axioms"), "; ").alias("axioms"))


@query("""
WITH RECURSIVE e AS (SELECT 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b FROM nation UNION SELECT 'Nation:' || n_nationkey, 'Nation:' || ((n_nationkey * 3 + 1) % 25) FROM nation UNION SELECT 'Region:' || n_regionkey, 'Nation:' || n_nationkey FROM nation WHERE n_nationkey % 5 = 2
  UNION SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer),
s AS (SELECT 'Customer:' || c_custkey AS start_id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'Nation:' || n_nationkey FROM nation),
walk AS (SELECT start_id, start_id AS node_id, 0 AS hops FROM s UNION SELECT start_id, b, hops + 1 FROM walk JOIN e ON a = node_id WHERE hops < 10)
SELECT start_id, node_id, CAST(min(hops) AS BIGINT) AS hops FROM walk WHERE hops > 0 GROUP BY ALL
""")
def traverse_ten_hops(spark, sf):
    """Ten hops through a graph with cycles."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    n = F.col("n_nationkey")
    hop = lambda df, a, b: df.select(a.alias("src"), F.lit("to").alias("relation"), b.alias("dst"))
    edges = hop(nation, key("Nation", n), key("Region", F.col("n_regionkey"))).union(hop(nation, key("Nation", n), key("Nation", (n * 3 + 1) % 25))).union(hop(nation.where("n_nationkey % 5 = 2"), key("Region", F.col("n_regionkey")), key("Nation", n)))
    edges = edges.union(hop(customer, key("Customer", F.col("c_custkey")), key("Nation", F.col("c_nationkey"))))
    starts = customer.where("c_mktsegment = 'BUILDING'").select(key("Customer", F.col("c_custkey")).alias("start_id")).union(nation.select(key("Nation", n)))
    store = core.GraphStore({e: ontology.view(spark, sf, e) for e in ("Nation", "Region")}, edges)
    return core.traverse_relations(store, starts, "to", "out", 10).select("start_id", "node_id", F.col("hops").cast("long").alias("hops"))


_TERMS = "list_concat(list_transform(range(1, length(t) + 1), lambda i: t[i:i]), list_transform(range(1, length(t)), lambda i: t[i:i+1]))"


@query(rf"""
WITH docs AS (SELECT conv_id * 1000 + turn AS key, regexp_replace(coalesce(text, ''), '[\s\p{{Z}}]+', '', 'g') AS t FROM conversations),
p AS (SELECT DISTINCT key, unnest({_TERMS}) AS term FROM docs),
w AS (SELECT term, ln(1 + (SELECT count(*) FROM docs) / count(*)) * CASE WHEN length(term) = 1 THEN 2 ELSE 3 END AS idf FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, regexp_replace(text, '[\s\p{{Z}}]+', '', 'g') AS t FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest({_TERMS}) AS term FROM q),
s AS (SELECT query_id, key, sum(idf) AS score FROM p JOIN w USING (term) JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM s)
SELECT query_id, key, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20
""")
def lexical_index_topk(spark, sf):
    """Every benchmark item's 20 nearest turns, from an index of all turns that is stored in two batches."""
    turns = table(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    index = LexicalIndex(spark, f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}")
    index.add("even", turns.where("conv_id % 2 = 0"), "key", "text")
    index.add("odd", turns.where("conv_id % 2 <> 0"), "key", "text")
    found = index.search(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.hits.select("query_id", F.col("key").cast("long").alias("key"), *catalog.big("rank"), F.round("score", 6).alias("score"))


_ASKED = "SELECT row_number() OVER (ORDER BY text) AS query_id, text FROM (SELECT DISTINCT substr(upper(p_name), 3, 6) AS text FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_name || ' of ' || p_brand FROM part)"


def _asked_names(spark, sf):
    part = table(spark, sf, "part")
    return spark.sql(_ASKED.replace("FROM part", "FROM {part}"), part=part).select(F.col("query_id").cast("long").alias("query_id"), "text")


@query(f"WITH a AS ({_ASKED}), e AS (SELECT DISTINCT p_name AS name, p_type AS alias FROM part) SELECT DISTINCT query_id, name, 'part' AS etype FROM a JOIN e ON contains(lower(name), lower(text)) OR contains(lower(alias), lower(text))")
def match_entities_batch(spark, sf):
    """parts whose name or type holds each of many asked texts."""
    entities = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_type").alias("aliases")).withColumn("etype", F.lit("part"))
    return match_entities(_asked_names(spark, sf), entities)


@query(f"WITH a AS ({_ASKED}), s AS (SELECT DISTINCT p_name AS subject FROM part) SELECT DISTINCT query_id, subject FROM a JOIN s ON subject = text OR contains(lower(subject), lower(text)) OR (length(text) > 2 AND subject <> '' AND contains(lower(text), lower(subject)))")
def match_subjects_batch(spark, sf):
    """F8: parts' names that hold each of many asked texts, or lie in them."""
    return match_subjects(_asked_names(spark, sf), table(spark, sf, "part").select(F.col("p_name").alias("subject")))
