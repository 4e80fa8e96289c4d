"""A stored lexical index (inventory F2-F4): additions by batches, exact top-k with few postings read.

The index is a folder of Parquet tables, each with a folder for every batch:

* ``postings``: (place, term, block, docs): the documents of a block of 2**BLOCK_BITS neighbouring numbers that
  hold a term, sorted by place (a hash of the term) and term, so a reader of some terms skips the rest;
* ``terms``: (place, term, df): how many documents of the batch hold a term;
* ``docs``: (doc, key): the documents' numbers;
* ``batches``: one row for each batch, written last: a batch without it doesn't count.

A batch adds its own files and changes none, and adding it again replaces it, so a broken run is simply
repeated. Frequencies are summed over batches when a query asks, so its scores are those of an index
built at once.

A term weighs the same in every document that holds it (its idf), so its weight is the bound of all
its blocks, and pruning is by terms: a query's rarest terms are read first, and their documents scored in
full by looking into the other terms' blocks. From the k-th best of these scores follows which of the
remaining terms can still bring a document into the first k on their own, with all that are commoner;
only those are read, too, and every skipped document is one that can't reach the k-th score.

Postings of a block meet the queries that look for documents there, and running sums over the block's
documents give the scores; what leaves a block for a query is its own first k, ties included.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import terms
from weftline.operators.retrieval import lexical_search
from weftline.session import checkpointed

BLOCK_BITS = 12
PLACES = 256
#: The first round reads a query's rarest terms until they hold this many documents for each of the first k.
AHEAD = 4
#: Different terms of all queries up to which they are named to the reader, so that files and row groups are skipped.
NAMED = 2_000
#: Queries that meet one copy of a block's postings.
QUERY_SHARE = 256
#: A hair below a k-th score, so that ties by key and rounding are decided with all documents at hand.
HAIR = 1e-6


def _place(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PLACES)).cast("int")


def weight(term: Column, df: Column, n: Column) -> Column:
    """ln(1 + N / df), twice for single characters and three times for pairs."""
    return F.log(1 + n / df) * F.when(F.char_length(term) == 1, 2).otherwise(3)


def _block_scores(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of each query the documents of one block that hold a sought term and no done one, with whole scores: those that can be among the first k. A row without a document says how many postings were looked into."""

    def scored(asked: pa.Table, posted: pa.Table) -> pa.Table:
        lists = posted.column("docs").combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        spots = np.split(lists.flatten().to_numpy(zero_copy_only=False) & ((1 << BLOCK_BITS) - 1), ends[:-1]) if len(ends) else []
        held = dict(zip(posted.column("term").to_pylist(), spots, strict=True))
        rows, docs, scores, looked = [], [], [], []
        low = asked.column("block")[0].as_py() << BLOCK_BITS if asked.num_rows else 0
        for row, q in enumerate(asked.select(["terms", "idfs", "seek", "done", "least"]).to_pylist()):
            score, count, wanted = np.zeros(1 << BLOCK_BITS), np.zeros(1 << BLOCK_BITS, np.int64), np.zeros(1 << BLOCK_BITS, bool)
            here = [(held[t], *x) for t, *x in zip(q["terms"], q["idfs"], q["seek"], q["done"], strict=True) if t in held]
            for at, idf, seek, _ in here:
                # Summed from the largest on, so that a score doesn't depend on the order of rows.
                score[at] += idf
                count[at] += 1
                if seek:
                    wanted[at] = True
            for at, _, _, done in here:
                if done:
                    wanted[at] = False
            found = np.flatnonzero(wanted)
            if len(found):
                total = int(count[found].sum())
                bound = -np.inf if q["least"] is None else q["least"]
                if len(found) > k:
                    bound = max(bound, np.partition(score[found], -k)[-k])
                found = found[score[found] >= bound - HAIR]
                rows += [row] * (len(found) + 1)
                docs += [*(found + low).tolist(), None]
                scores += [*score[found].tolist(), None]
                looked += [0] * len(found) + [total]
        some = asked.select(["query_id", "batch"]).take(pa.array(rows, pa.int64()))
        return some.append_column("doc", pa.array(docs, pa.int64())).append_column("score", pa.array(scores, pa.float64())).append_column("looked", pa.array(looked, pa.int64()))

    return scored


@dataclass
class Found:
    """``hits``: query_id, key, score, rank, relative. ``read``: query_id, postings of all its terms, those read to find documents, and blocks looked into to score them."""

    hits: DataFrame
    read: DataFrame


class LexicalIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        """``path`` is a folder that driver and executors share; it may not exist yet."""
        self.spark, self.path = spark, path

    def add(self, batch: str, docs: DataFrame, key: str, text: str) -> None:
        """Add documents, or replace those of the batch of that name. Keys may be of any type, the same for all batches; a null text has no terms but counts as a document."""
        place = lambda table: f"{self.path}/{table}/batch={batch}"
        # Numbers are given once, on disk; a batch's number range is its own, as blocks carry the batch.
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("terms")).withColumn("doc", F.monotonically_increasing_id()).write.parquet(staging)
        made = self.spark.read.parquet(staging)
        self._drop(place("batches"))
        made.select("doc", "key").write.mode("overwrite").parquet(place("docs"))
        posted = made.select(F.explode("terms").alias("term"), "doc").withColumn("block", F.shiftright("doc", BLOCK_BITS))
        # A block bounds how many documents meet in a row, whatever the term.
        blocks = posted.groupBy("term", "block").agg(F.array_sort(F.collect_list("doc")).alias("docs")).withColumn("place", _place(F.col("term")))
        blocks.repartitionByRange("place", "term").sortWithinPartitions("place", "term", "block").write.mode("overwrite").parquet(place("postings"))
        held = self.spark.read.parquet(place("postings")).groupBy("place", "term").agg(F.sum(F.size("docs")).alias("df"))
        held.repartitionByRange("place", "term").sortWithinPartitions("place", "term").write.mode("overwrite").parquet(place("terms"))
        made.agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(place("batches"))
        self._drop(staging)

    def _drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _read(self, table: str) -> DataFrame:
        """A table's rows of finished batches."""
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}").withColumn("batch", F.col("batch").cast("string"))
        done = [str(r.batch) for r in self.spark.read.parquet(f"{self.path}/batches").select("batch").distinct().collect()]
        return rows.where(F.col("batch").isin(done))

    def size(self) -> int:
        return self._read("batches").agg(F.sum("n")).first()[0] or 0

    def weights(self) -> DataFrame:
        """term, df, idf over all batches."""
        n = F.lit(self.size()).cast("double")
        return self._read("terms").groupBy("place", "term").agg(F.sum("df").alias("df")).withColumn("idf", weight(F.col("term"), F.col("df"), n))

    def search(self, queries: DataFrame, k: int = 20) -> Found:
        """The first ``k`` documents of each query (query_id, text) by the sum of their shared terms' idf, ties by key: the rows of ``lexical_search`` over all texts."""
        asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).distinct().withColumn("place", _place(F.col("term")))
        asked = checkpointed(asked)
        named = [(r.place, r.term) for r in asked.select("place", "term").distinct().limit(NAMED + 1).collect()]
        some = F.lit(True)
        if len(named) <= NAMED:
            some = F.col("place").isin(sorted({p for p, _ in named})) & F.col("term").isin([t for _, t in named])
        # Rarest first; ``before`` documents are held by rarer terms, and a document whose rarest term is this one scores ``tail`` at most.
        rarest = Window.partitionBy("query_id").orderBy(F.desc("idf"), "term")
        told = asked.join(self.weights().where(some), ["place", "term"]).withColumns({
            "before": F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "tail": F.sum("idf").over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        })
        told = checkpointed(told)
        postings = self._read("postings").where(some).select("batch", "place", "term", "block", "docs")
        early = F.col("before") < AHEAD * k
        one = checkpointed(self._scored(told.withColumns({"seek": early, "done": F.lit(False), "least": F.lit(None).cast("double")}), postings, k))
        worst = one.where("doc is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_rn") == k).select("query_id", F.col("score").alias("least"))
        reaches = ~early & (F.col("least").isNull() | (F.col("tail") >= F.col("least") - HAIR))
        later = checkpointed(told.join(worst, "query_id", "left").withColumns({"seek": reaches, "done": early}))
        both = checkpointed(one.unionByName(self._scored(later, postings, k)))
        keyed = both.where("doc is not null").join(self._read("docs").select("batch", "doc", "key"), ["batch", "doc"])
        hits = lexical_search(keyed.select("query_id", "key", "score"), "key", k, k)
        looked = both.groupBy("query_id").agg(F.sum("looked").alias("looked"))
        cost = later.groupBy("query_id").agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("seek") | F.col("done"), F.col("df"))).alias("read")).join(looked, "query_id", "left")
        return Found(hits, cost.na.fill(0))

    def _scored(self, told: DataFrame, postings: DataFrame, k: int) -> DataFrame:
        """query_id, batch, doc, score, looked of the documents that hold a term with ``seek`` and none with ``done``, as ``_block_scores`` says."""
        kind = told.schema["query_id"].dataType.simpleString()
        sought = told.where("seek").select("query_id", "place", "term")
        there = checkpointed(postings.select("batch", "place", "term", "block").join(sought, ["place", "term"]).select("query_id", "batch", "block").distinct())
        by_idf = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("less"), "term", "seek", "done")))
        whole = told.groupBy("query_id").agg(by_idf.alias("all"), F.max("least").alias("least"))
        whole = whole.select("query_id", F.col("all.term").alias("terms"), F.transform("all.less", lambda x: -x).alias("idfs"), F.col("all.seek").alias("seek"), F.col("all.done").alias("done"), "least")
        shares = -(-told.select("query_id").distinct().count() // QUERY_SHARE) or 1
        asked = there.join(whole, "query_id").withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)))
        posted = postings.join(told.select("place", "term").distinct(), ["place", "term"], "left_semi").join(there.select("batch", "block").distinct(), ["batch", "block"], "left_semi")
        posted = posted.select("batch", "block", "term", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
        by = ["batch", "block", "share"]
        return asked.groupBy(*by).cogroup(posted.groupBy(*by)).applyInArrow(_block_scores(k), f"query_id {kind}, batch string, doc long, score double, looked long")
