"""Append-only memory (inventory M): vector search, last messages, deduplicated additions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """M1: cosine with zero norms taken as 1e-9."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return dot(a, b) / (norm(a) * norm(b))


def search(store: DataFrame, query: Column, key: str, vector: str, k: int, user: str | None = None) -> DataFrame:
    """M1: the k nearest entries of a user by cosine, ties by key: a top-k over one scan."""
    mine = store if user is None else store.where(F.col("user_id") == user)
    return mine.withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), key).limit(k)


#: Payload fields that a search leaves out, as the text and its hash go by themselves.
OWN_FIELDS = ("data", "hash")


def search_result(found: DataFrame, key: str, text: str, payload: str) -> DataFrame:
    """M5: id, memory, payload (a map without the text and its hash) and score of found entries, best first."""
    rest = F.map_filter(payload, lambda k, v: ~k.isin(*OWN_FIELDS))
    return found.select(F.col(key).alias("id"), F.col(text).alias("memory"), rest.alias("payload"), "score").orderBy(F.desc("score"), "id")


def append(store_path: str, rows: DataFrame) -> None:
    """M2: append rows as Parquet."""
    rows.write.mode("append").parquet(store_path)


def last_messages(messages: DataFrame, by: str, order: str, k: int = 10) -> DataFrame:
    """M3: the last k messages of each user."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def first_by_md5(rows: DataFrame, text: str, order: str) -> DataFrame:
    """M4: the first row of each text, told apart by MD5; a grouped minimum with map-side combine."""
    hashed = rows.where(F.col(text).isNotNull()).withColumn("hash", F.md5(F.col(text).cast("binary")))
    return hashed.groupBy("hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def additions(batch: DataFrame, existing: DataFrame, text: str, order: str) -> DataFrame:
    """M4: rows of a batch whose text is new to ``existing`` (hash) and first in the batch.

    Pass the ten nearest entries as ``existing`` for the surveyed behaviour, the whole store for store-wide deduplication.
    """
    hashed = batch.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("hash", F.md5(F.col(text).cast("binary")))
    w = Window.partitionBy("hash").orderBy(order)
    first = hashed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(existing.select("hash").distinct(), "hash", "left_anti")


def parse_memories(raw: Column) -> Column:
    """M6: texts of a model's answer: the first JSON object with a ``memory`` list, with or without a fence around it."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    items = F.coalesce(F.from_json(body, "memory array<struct<text:string>>")["memory"], F.array().cast("array<struct<text:string>>"))
    return F.filter(F.transform(items, lambda x: F.trim(x["text"])), lambda t: t.isNotNull() & (t != ""))


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], size: int = 256) -> DataFrame:
    """M7: add ``embedding`` by a pluggable function over batches of texts."""

    def batches(parts):
        for part in parts:
            texts = part[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), size) for v in embedder(texts[i : i + size])]
            yield part.assign(embedding=vectors)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(batches, f"{names}, embedding array<double>")
