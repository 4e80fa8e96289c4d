"""The stored lexical index against scoring of all texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import retrieval
from weftline.operators.lexindex import LexicalIndex

KIND = "key string, text string"


def texts(n, seed):
    rng = random.Random(seed)
    letters = "aaaaaaaabbbbbccccddeefghijklmnop漢字"
    return [(f"k{seed}-{i}", "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))) for i in range(n)] + [(f"null{seed}", None)]


def scored(spark, rows, queries, k):
    """The rows that scoring every text gives."""
    docs = spark.createDataFrame(rows, KIND)
    posted = retrieval.postings(docs, "key", F.col("text"))
    scores = retrieval.lexical_scores(posted, retrieval.idf(posted, docs), queries, "key")
    return rounded(retrieval.lexical_search(scores, "key", k, k))


def rounded(hits):
    return {(r.query_id, r["rank"]): (r.key, round(r.score, 7), round(r.relative, 7)) for r in hits.collect()}


@pytest.fixture
def index(spark, tmp_path):
    return LexicalIndex(spark, f"file://{tmp_path}/index")


def test_same_rows_as_all_texts_and_additions(spark, index, tmp_path):
    queries = spark.createDataFrame([(1, "pz漢"), (2, "aab"), (3, "the lion"), (4, "zzz"), (5, ""), (6, None), (7, "opno")], "query_id long, text string")
    one, two = texts(300, 1), texts(200, 2)
    index.add("1", spark.createDataFrame(one, KIND), "key", "text")
    for k in (3, 20):
        assert rounded(index.search(queries, k).hits) == scored(spark, one, queries, k)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    index.add("2", spark.createDataFrame(two, KIND), "key", "text")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing that was there is written again
    want = scored(spark, one + two, queries, 20)
    assert rounded(index.search(queries, 20).hits) == want and index.size() == len(one + two)
    index.add("2", spark.createDataFrame(two, KIND), "key", "text")  # again: the same
    assert rounded(index.search(queries, 20).hits) == want and index.size() == len(one + two)


def test_a_batch_that_broke_off_does_not_count(spark, index, tmp_path):
    queries = spark.createDataFrame([(1, "abc")], "query_id long, text string")
    one = texts(50, 1)
    index.add("1", spark.createDataFrame(one, KIND), "key", "text")
    index.add("2", spark.createDataFrame(texts(50, 2), KIND), "key", "text")
    index._drop(f"file://{tmp_path}/index/batches/batch=2")
    assert index.size() == len(one) and rounded(index.search(queries, 5).hits) == scored(spark, one, queries, 5)


def test_few_postings_are_read(spark, index):
    """A query of one rare and several very common terms reads the rare one's postings alone."""
    rows = [(f"{i:05d}", "ab" + ("x" if i % 400 == 0 else "") + "cd") for i in range(4000)]
    index.add("1", spark.createDataFrame(rows, KIND), "key", "text")
    queries = spark.createDataFrame([(1, "abxcd"), (2, "ab")], "query_id long, text string")
    found = index.search(queries, 5)
    read = {r.query_id: r for r in found.read.collect()}
    assert read[1].postings > 20_000 and read[1]["read"] < 100 and read[1].looked < 100
    assert rounded(found.hits) == scored(spark, rows, queries, 5)


def test_an_empty_batch_and_no_hits(spark, index):
    queries = spark.createDataFrame([(1, "abc")], "query_id long, text string")
    index.add("0", spark.createDataFrame([], KIND), "key", "text")
    assert index.size() == 0 and index.search(queries, 5).hits.collect() == []
    index.add("1", spark.createDataFrame([("a", ""), ("b", "zz")], KIND), "key", "text")
    assert index.size() == 2 and index.search(queries, 5).hits.collect() == []
    assert index.search(queries.limit(0), 5).hits.collect() == []


def test_time_follows_the_length_of_a_text(spark):
    """A text of 60,000 code points, white space and astral ones among them, costs no more than its length (F1: it took minutes)."""
    long = "lorem ipsum \U0001f600漢 dolor sit　amet " * 2_000
    rows = spark.createDataFrame([(1, long), (2, "a"), (3, ""), (4, None)], "n int, text string")
    began = time.monotonic()
    got = {r.n: (set(r.t), len(r.t), r.grams) for r in rows.select("n", text.terms(F.col("text")).alias("t"), F.size(text.char_grams(F.col("text"), 3)).alias("grams")).collect()}
    assert time.monotonic() - began < 20
    folded = "".join(long.split())
    want = set(folded) | {folded[i : i + 2] for i in range(len(folded) - 1)}
    assert got == {1: (want, len(want), len(long) - 2), 2: ({"a"}, 1, 0), 3: (set(), 0, 0), 4: (set(), 0, 0)}


def test_a_block_sends_a_query_s_first_documents_only(spark, index):
    """Ties at the k-th place stay, so that keys decide; the rest of the block is not sent on (F1: all documents were)."""
    rows = [(f"{i:05d}", "ab" if i % 3 else "abc") for i in range(3000)]
    index.add("1", spark.createDataFrame(rows, KIND), "key", "text")
    told = index.weights().where(F.col("term").isin("a", "b", "c")).selectExpr("1L query_id", "place", "term", "idf", "true seek", "false done", "cast(null as double) least")
    sent = index._scored(told, index._read("postings"), 5).where("doc is not null")
    assert sent.count() == 1000
    queries = spark.createDataFrame([(i, "abc") for i in range(300)], "query_id long, text string")
    found = rounded(index.search(queries, 5).hits)
    assert found == scored(spark, rows, queries, 5) and len(found) == 1500
