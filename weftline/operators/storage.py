"""Graphs as tables (inventory A12, B10): nodes by id, edges by source and once more by target.

The tables are bucketed and sorted by their keys, all into the same number of buckets. A walk or a filter
by relation then shuffles what it starts from, which is small, and never the stored graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.core import GraphStore

BUCKETS = 64


def _write(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def save_store(store: GraphStore, name: str, buckets: int = BUCKETS) -> None:
    """Write a store's tables into the catalog's database ``name``; what is there is replaced. ``buckets`` should be a few times the cluster's cores, so that one holds what a task can sort."""
    spark = store.edges.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    for etype, view in store.views.items():
        _write(view, f"`{name}`.`node_{etype.lower()}`", "__id__", buckets)
    _write(store.all_nodes(), f"`{name}`.`nodes`", "__id__", buckets)
    _write(store.edges, f"`{name}`.`edges_by_src`", "src", buckets)
    _write(store.edges, f"`{name}`.`edges_by_dst`", "dst", buckets)
    kinds = spark.createDataFrame([(e, f"node_{e.lower()}") for e in store.views], "etype string, place string")
    kinds.coalesce(1).write.mode("overwrite").saveAsTable(f"`{name}`.`kinds`")


def open_store(spark: SparkSession, name: str) -> GraphStore:
    """The store that ``save_store`` has written."""
    views = {r.etype: spark.table(f"`{name}`.`{r.place}`") for r in spark.table(f"`{name}`.`kinds`").collect()}
    return _Stored(views, spark.table(f"`{name}`.`edges_by_src`"), {"nodes": spark.table(f"`{name}`.`nodes`")}, spark.table(f"`{name}`.`edges_by_dst`"))


class _Stored(GraphStore):
    def all_nodes(self) -> DataFrame:
        return self.extras["nodes"]

