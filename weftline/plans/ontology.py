"""The driver's tables as an ontology: typed views and derived edges, all lazy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.core import GraphStore
from weftline.sources.tables import table

#: Entity type: table, key columns.
ENTITIES = {
    "Region": ("region", ("r_regionkey",)),
    "Nation": ("nation", ("n_nationkey",)),
    "Customer": ("customer", ("c_custkey",)),
    "Supplier": ("supplier", ("s_suppkey",)),
    "Part": ("part", ("p_partkey",)),
    "Order": ("orders", ("o_orderkey",)),
}
#: Relation: head type, column that names the target's key, target type.
RELATIONS = (
    ("part_of", "Nation", "n_regionkey", "Region"),
    ("located_in", "Customer", "c_nationkey", "Nation"),
    ("located_in", "Supplier", "s_nationkey", "Nation"),
    ("placed_by", "Order", "o_custkey", "Customer"),
)


def entity_id(etype: str, keys: Sequence[str], values: Sequence[Column]) -> Column:
    parts = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(zip(keys, values, strict=True), key=lambda kv: kv[0])]
    return F.concat(F.lit(f"{etype}::"), F.concat_ws("|", *parts))


def view(spark: SparkSession, sf_dir: str, etype: str) -> DataFrame:
    name, keys = ENTITIES[etype]
    rows = table(spark, sf_dir, name)
    return rows.select(entity_id(etype, keys, [F.col(k) for k in keys]).alias("__id__"), F.lit(etype).alias("__type__"), F.col(keys[0]).cast("long").alias("ord"), *rows.columns)


def store(spark: SparkSession, sf_dir: str, etypes: Sequence[str] = ("Region", "Nation", "Customer", "Supplier"), relations: Sequence[str] = ("part_of", "located_in")) -> GraphStore:
    views = {e: view(spark, sf_dir, e) for e in etypes}
    made = []
    for relation, head, column, target in RELATIONS:
        if relation in relations and head in views:
            key = ENTITIES[target][1]
            made.append(views[head].select(F.col("__id__").alias("src"), F.lit(relation).alias("relation"), entity_id(target, key, [F.col(column)]).alias("dst")))
    return GraphStore(views, reduce(DataFrame.union, made))
