"""Graph construction (inventory B): candidates to folded nodes and deduplicated edges, derived edges, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import collapsed, stripped
from weftline.schema import Schema

NODE = "node_id string, etype string, key map<string,string>, props map<string,string>, n_merged int, source string, ord bigint"
EDGE = "src string, relation string, dst string, derived boolean, ord bigint"


def node_id(etype: Column, key: Column) -> Column:
    """``etype::k=v|k=v`` with keys in order and values canonical."""
    parts = F.array_sort(F.transform(F.map_entries(key), lambda e: F.concat(e["key"], F.lit("="), collapsed(e["value"]))))
    return F.concat(etype, F.lit("::"), F.concat_ws("|", parts))


def first_value(value: Column, order: Column) -> Column:
    """Aggregate: the first value by order that is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), order))


def fold(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """B1 on typed columns: one row per key; each value is the first non-empty one; n_merged rows were folded.

    A grouped aggregate with map-side combine; no list of a key's rows is ever built.
    """
    by = F.struct(*order)
    return rows.groupBy(*keys).agg(*(first_value(F.col(v), by).alias(v) for v in values), F.count("*").cast("int").alias("n_merged"))


def build_graph(entities: DataFrame, relations: DataFrame, schema: Schema | None = None) -> tuple[DataFrame, DataFrame]:
    """B1: candidates to (nodes, edges).

    ``entities``: etype, key map, props map, ord. ``relations``: relation, head_type, head_key, tail_type,
    tail_key, ord. Unknown types are dropped if a schema is given; endpoints without an entity become
    bare nodes with n_merged 0, unchecked; edges are one per (head, relation, tail).
    """
    if schema is not None:
        entities = entities.where(F.col("etype").isin([e.name for e in schema.entities]))
    named = entities.withColumn("node_id", node_id(F.col("etype"), F.col("key")))
    heads = named.groupBy("node_id").agg(F.first("etype").alias("etype"), F.min_by("key", "ord").alias("key"), F.count("*").cast("int").alias("n_merged"), F.min("ord").alias("ord"))
    props = named.select("node_id", "ord", F.explode("props").alias("name", "value")).groupBy("node_id", "name").agg(first_value(F.col("value"), F.col("ord")).alias("value"))
    maps = props.where("value is not null").groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
    nodes = heads.join(maps, "node_id", "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    ends = relations.select(
        "relation", "ord", node_id(F.col("head_type"), F.col("head_key")).alias("src"), node_id(F.col("tail_type"), F.col("tail_key")).alias("dst"),
        *("head_type", "head_key", "tail_type", "tail_key"),
    )
    edges = ends.groupBy("src", "relation", "dst").agg(F.min("ord").alias("ord")).withColumn("derived", F.lit(False))
    mentioned = ends.select(F.col("src").alias("node_id"), F.col("head_type").alias("etype"), F.col("head_key").alias("key"), "ord").unionByName(
        ends.select(F.col("dst").alias("node_id"), F.col("tail_type").alias("etype"), F.col("tail_key").alias("key"), "ord")
    )
    bare = mentioned.join(heads, "node_id", "left_anti").groupBy("node_id").agg(F.first("etype").alias("etype"), F.min_by("key", "ord").alias("key"), F.min("ord").alias("ord"))
    bare = bare.withColumn("n_merged", F.lit(0)).withColumn("props", F.create_map().cast("map<string,string>"))
    columns = ["node_id", "etype", "key", "props", "n_merged", "ord"]
    return nodes.select(*columns).unionByName(bare.select(*columns)), edges.select("src", "relation", "dst", "derived", "ord")


def split_values(value: Column, separator: str | None = ";") -> Column:
    """Trimmed, non-empty parts of a delimited value; the whole value if there is no separator."""
    import re

    text = F.coalesce(value.cast("string"), F.lit(""))
    parts = F.split(text, re.escape(separator)) if separator else F.array(text)
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def derive_edges(rows: DataFrame, relation: str, value: str, target_type: str, target_key: str, separator: str | None = ";") -> DataFrame:
    """B2 on a typed view (__id__, value): one derived edge for each different part: src, relation, dst."""
    parts = rows.select(F.col("__id__").alias("src"), F.explode(split_values(F.col(value), separator)).alias("part"))
    return parts.select("src", F.lit(relation).alias("relation"), F.concat(F.lit(f"{target_type}::{target_key}="), collapsed(F.col("part"))).alias("dst")).distinct()


def derive_relations(nodes: DataFrame, edges: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """B2: edges from attributes, in schema order, so later relations see nodes made by earlier ones; idempotent."""
    for r in schema.relations:
        if not r.derive:
            continue
        field = r.derive.get("attr_by_domain", {})
        for domain in r.domains:
            attr = field.get(domain, r.derive.get("attr"))
            target = schema.entity(r.ranges[0])
            mine = nodes.where(F.col("etype") == domain)
            value = F.coalesce(F.try_element_at("props", F.lit(attr)), F.try_element_at("key", F.lit(attr)))
            made = derive_edges(mine.select(F.col("node_id").alias("__id__"), value.alias("v")), r.name, "v", target.name, target.primary_key[0], r.derive.get("split", ";"))
            made = made.withColumn("derived", F.lit(True)).withColumn("ord", F.lit(None).cast("long"))
            part = F.substring_index("dst", f"{target.primary_key[0]}=", -1)
            fresh = made.select(F.col("dst").alias("node_id"), F.lit(target.name).alias("etype"), F.create_map(F.lit(target.primary_key[0]), part).alias("key")).dropDuplicates(["node_id"])
            fresh = fresh.join(nodes, "node_id", "left_anti").withColumn("props", F.create_map().cast("map<string,string>")).withColumn("n_merged", F.lit(0)).withColumn("ord", F.lit(None).cast("long"))
            nodes = nodes.unionByName(fresh.select(*nodes.columns))
            edges = edges.unionByName(made.join(edges, ["src", "relation", "dst"], "left_anti").select(*edges.columns))
    return nodes, edges


def enrich_from_reference(nodes: DataFrame, reference: DataFrame, etype: str) -> tuple[DataFrame, DataFrame]:
    """Reference rows (node_id, key, props) overwrite existing nodes' fields; new nodes are tagged; returns (nodes, added)."""
    ref = reference.select("node_id", F.col("key").alias("_key"), F.map_filter("props", lambda _, v: v.isNotNull() & (v != "")).alias("_props"))
    both = nodes.join(ref, "node_id", "full_outer")
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce("_props", F.create_map().cast("map<string,string>")), k))
    merged = F.when(F.col("_props").isNull(), F.col("props")).otherwise(F.map_concat(kept, "_props"))
    out = both.select(
        "node_id", F.coalesce("etype", F.lit(etype)).alias("etype"), F.coalesce("key", "_key").alias("key"), merged.alias("props"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"), "ord",
        F.when(F.col("etype").isNull(), F.lit("reference")).alias("source"),
    )
    return out, out.where("source = 'reference'").agg(F.count("*").alias("added"))


def city_base(name: Column) -> Column:
    """A name up to " (", trimmed."""
    return stripped(F.split_part(F.coalesce(name, F.lit("")), F.lit(" ("), F.lit(1)))


def enrich_counts(places: DataFrame, key: str, counted: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Add for each name the count of rows of a view by its column, and ``covered``: whether any is above 0."""
    out = places
    for name, (view, column) in counted.items():
        n = view.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))
    return out.withColumn("covered", F.greatest(*(F.col(c) for c in counted), F.lit(0)) > 0)


def covered_minimum(places: DataFrame, key: str, priced: DataFrame, column: str, price: str) -> DataFrame:
    """Covered places with their least positive price, cheapest first, those without a price last, then by name."""
    least = priced.where(F.col(price) > 0).groupBy(F.col(column).alias(key)).agg(F.min(price).alias("min_price"))
    return places.where("covered").join(least, key, "left").orderBy(F.col("min_price").asc_nulls_last(), key)


def stats_types(store) -> DataFrame:
    """Nodes by type."""
    return store.all_nodes().groupBy("__type__").agg(F.count("*").alias("n"))


def stats_relations(store) -> DataFrame:
    """Edges by relation."""
    return store.edges.groupBy("relation").agg(F.count("*").alias("n"))


def samples(rows: DataFrame, by: str, order: Sequence[str], per_type: int = 5) -> DataFrame:
    """The first rows of each type."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_type)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as Parquet, edges partitioned by relation."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select("src", "relation", "dst", "derived", "ord")


def export_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link JSON lines."""
    nodes.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/nodes.jsonl")
    edges.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/edges.jsonl")


def mini_graph(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates of the given chunks; chunk ids are told apart by query_id."""
    return entities.join(chunks.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")


# Data-level audits in place of a reasoner.


def audit_functional(edges: DataFrame, relation: str) -> DataFrame:
    """Heads with more than one different tail."""
    return edges.where(F.col("relation") == relation).groupBy("src").agg(F.count_distinct("dst").alias("tails")).where("tails > 1")


def audit_cardinality(edges: DataFrame, relation: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Heads with fewer or more edges than allowed."""
    n = edges.where(F.col("relation") == relation).groupBy("src").agg(F.count("*").alias("n"))
    return n.where((F.col("n") < least) | (F.lit(False) if most is None else F.col("n") > most))


def audit_disjoint(nodes: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """Keys that occur under more than one of types that must be disjoint."""
    mine = nodes.where(F.col("__type__").isin(list(types)))
    return mine.groupBy(key).agg(F.count_distinct("__type__").alias("types")).where("types > 1")


def audit_endpoints(edges: DataFrame, nodes: DataFrame, relation: str, domain: Sequence[str], range_: Sequence[str]) -> DataFrame:
    """Edges whose head or tail is of another type than declared."""
    typed = nodes.select(F.col("__id__"), F.col("__type__"))
    out = edges.where(F.col("relation") == relation)
    out = out.join(typed.toDF("src", "src_type"), "src", "left").join(typed.toDF("dst", "dst_type"), "dst", "left")
    return out.where(~F.coalesce(F.col("src_type").isin(list(domain)), F.lit(False)) | ~F.coalesce(F.col("dst_type").isin(list(range_)), F.lit(False)))
