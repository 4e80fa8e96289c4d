"""Graphs kept up by batches (inventory B1): candidates added and taken back, folded from mergeable state.

What a batch says becomes signed entries, aggregated before they are written: how often a node, a property's
value, an edge or a mention of an endpoint was said with a place in the order. Entries of all batches are
summed; what is left over zero is what is said now, and the first by order wins, as in ``build_graph``. So
any split of the candidates into batches, in any sequence, gives the graph of all of them at once, also
after some were taken back. A batch writes its entries first and its marker last; a batch of a known name
is not applied again, and one that broke off is replaced by the next try. ``compact`` folds the entries of
all batches into one, so that reading costs what is said now and not what ever was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import node_id

#: One entry: a thing said (kind: node, prop, edge or end), its order, and how often more than it was taken back.
ENTRY = "kind string, id string, etype string, key map<string,string>, relation string, name string, value string, ord bigint, sign bigint"
_BY = ["kind", "id", "etype", "key", "relation", "name", "value", "ord"]


def _entries(entities: DataFrame | None, relations: DataFrame | None, sign: int) -> list[DataFrame]:
    none = F.lit(None).cast("string")
    out = []
    row = lambda df, kind, id_, etype, key, relation=none, name=none, value=none: df.select(
        F.lit(kind).alias("kind"), id_.alias("id"), etype.alias("etype"), key.alias("key"), relation.alias("relation"), name.alias("name"), value.alias("value"), F.col("ord").cast("bigint").alias("ord"), F.lit(sign).cast("bigint").alias("sign"))
    no_key = F.lit(None).cast("map<string,string>")
    if entities is not None:
        named = entities.withColumn("_id", node_id(F.col("etype"), F.col("key")))
        out.append(row(named, "node", F.col("_id"), F.col("etype"), F.col("key")))
        said = named.select("_id", "ord", F.explode("props").alias("_name", "_value")).where("_value is not null and _value <> ''")
        out.append(row(said, "prop", F.col("_id"), none, no_key, name=F.col("_name"), value=F.col("_value")))
    if relations is not None:
        ends = relations.withColumns({"_src": node_id(F.col("head_type"), F.col("head_key")), "_dst": node_id(F.col("tail_type"), F.col("tail_key"))})
        out.append(row(ends, "edge", F.col("_src"), none, no_key, relation=F.col("relation"), value=F.col("_dst")))
        out += [row(ends, "end", F.col(i), F.col(t), F.col(k)) for i, t, k in (("_src", "head_type", "head_key"), ("_dst", "tail_type", "tail_key"))]
    return out


def _summed(rows: DataFrame) -> DataFrame:
    """Entries of the same thing as one; those that cancel vanish. Maps can't be grouped by, so a key goes as its entries in order."""
    flat = rows.withColumn("key", F.array_sort(F.map_entries("key")))
    net = flat.groupBy(*_BY).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return net.withColumn("key", F.map_from_entries("key"))


class GraphLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        """``path`` is a folder that driver and executors share. One writer at a time."""
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _names(self) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _mark(self, batch: str, covers: list[str]) -> None:
        self.spark.createDataFrame([(c,) for c in covers], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/{batch}")

    def batches(self) -> tuple[list[str], set[str]]:
        """The folders that count, and the names of all batches that they hold."""
        marks = {n: {r.batch for r in self.spark.read.parquet(f"{self.path}/done/{n}").collect()} for n in self._names() if self._exists(f"{self.path}/done/{n}/_SUCCESS")}
        live = [n for n, held in marks.items() if not any(held < other for other in marks.values())]
        return live, set().union(*marks.values()) if marks else set()

    def apply(self, batch: str, entities: DataFrame | None = None, relations: DataFrame | None = None, gone_entities: DataFrame | None = None, gone_relations: DataFrame | None = None) -> bool:
        """Add candidates and take others back; False if the batch had been applied. Candidates are those of ``build_graph``; one is taken back by saying the same again, whether it was added before or comes later."""
        if batch in self.batches()[1]:
            return False
        parts = _entries(entities, relations, 1) + _entries(gone_entities, gone_relations, -1)
        rows = _summed(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], ENTRY)
        rows.write.mode("overwrite").parquet(f"{self.path}/entries/{batch}")
        self._mark(batch, [batch])
        return True

    def entries(self) -> DataFrame:
        """What is said now: entries summed over all batches, those above zero."""
        live, _ = self.batches()
        rows = self.spark.read.schema(ENTRY).parquet(*(f"{self.path}/entries/{b}" for b in live)) if live else self.spark.createDataFrame([], ENTRY)
        return _summed(rows)

    def compact(self, name: str) -> None:
        """Fold all batches into one folder ``name``. Their own folders stay until someone deletes them, but aren't read again."""
        _, known = self.batches()
        self.entries().write.mode("overwrite").parquet(f"{self.path}/entries/{name}")
        self._mark(name, sorted(known | {name}))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) as ``build_graph`` of all that is said now."""
        said = self.entries().where("sign > 0")
        kind = lambda k: said.where(F.col("kind") == k)
        least = lambda rows: rows.groupBy(F.col("id").alias("node_id")).agg(F.first("etype").alias("etype"), F.min_by("key", "ord").alias("key"), F.sum("sign").cast("int").alias("n_merged"), F.min("ord").alias("ord"))
        heads = least(kind("node"))
        values = kind("prop").groupBy(F.col("id").alias("node_id"), "name").agg(F.min_by("value", "ord").alias("value"))
        maps = values.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
        nodes = heads.join(maps, "node_id", "left")
        bare = least(kind("end").join(heads.select(F.col("node_id").alias("id")), "id", "left_anti")).withColumns({"n_merged": F.lit(0), "props": F.lit(None).cast("map<string,string>")})
        both = nodes.unionByName(bare).withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
        edges = kind("edge").groupBy(F.col("id").alias("src"), "relation", F.col("value").alias("dst")).agg(F.min("ord").alias("ord")).withColumn("derived", F.lit(False))
        return both.select("node_id", "etype", "key", "props", "n_merged", "ord"), edges.select("src", "relation", "dst", "derived", "ord")
