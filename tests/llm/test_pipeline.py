"""The pipeline's stages against brute force on a small table, and that decisions take effect."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontaminate, mixing, neardup, quality, sharding
from weftline.llm.common import table


def test_stages(spark, sf):
    from tests.llm.test_similarity import classes_by_brute_force

    docs = table(spark, sf, "documents")
    assert [f.__name__.removesuffix("_stage") for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicate", "decontamination", "mixing", "sharding"]
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, table(spark, sf, "labels"))
    good = {r.doc_id for r in quality.score_documents(docs, model).where("predicted = 1").collect()}
    classes = classes_by_brute_force({d: rows[d].text for d in sorted(good)})
    single = set(classes.values())
    hits = {r.doc_id for r in decontaminate.find_overlaps(docs.where(docs.doc_id.isin(sorted(single))), table(spark, sf, "benchmark")).collect()}
    clean = single - hits
    shards = corpus_pipeline.run(spark, sf).collect()
    # After the mix each document comes none to three times, in its own size; a source's sizes come near its target.
    got = defaultdict(int)
    for r in shards:
        got[r.doc_id] += 1
    assert set(got) <= clean and max(got.values()) <= 3
    assert all(tuple(r)[:-1] == tuple(rows[r.doc_id]) and 0 <= r.shard < 24 for r in shards)
    left = docs.where(docs.doc_id.isin(sorted(clean)))
    want = {r.doc_id: r.taken / r.size for r in mixing.taken_words(*mixing.mix(left)).collect()}
    assert all(got[d] in (int(want[d]), int(want[d]) + 1) for d in clean)
    where = defaultdict(set)
    for r in shards:
        where[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


ODD = [
    (1, "one two three four five", "en", "a"), (1, "one two three four five", "en", "a"), (2, None, None, None), (None, "x y z", "en", "a"), (None, "x y z", "en", "a"), (3, "", "en", "b"), (4, "  \n ", "en", "b"), (5, "word " * 30_000, "en", "b"), ((1 << 60) + 1, "a large id beside a null one", "de", None),
]


def tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    """Without labels nothing is rejected: each different text that isn't a benchmark item stays, in one shard."""
    sf = tables(spark, tmp_path, ODD, [], [(1, "x y z"), (None, None)])
    rows = corpus_pipeline.run(spark, sf).collect()
    left = {(r.doc_id, r.text) for r in rows}
    # Rows without words come once; equal rows are one document; ids above 2**53 stay; texts without words are classes of their own.
    assert left <= {(1, ODD[0][1]), (2, None), (4, "  \n "), (5, ODD[7][1]), ((1 << 60) + 1, ODD[8][1])}
    assert {(2, None), (4, "  \n ")} <= left and (None, "x y z") not in left
    assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "shard"]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).collect() == []


def test_internal_names_as_columns(spark):
    """Columns named like the stages' own, in any case, come out as they went in."""
    names = ("_key", "_group", "_n", "_times", "_mixed", "_copy", "_rows", "_hit", "_taken", "_size", "_KEY_", "group", "size", "n", "rows", "shards", "node", "hash", "class_id", "words", "item", "score")
    docs = spark.createDataFrame([(1, "one two three four", "en", "s"), (1, "one two three four", "en", "s"), (2, "other words stand here", "en", "s"), (3, None, "en", None), (4, "held item text", "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.lit(1).cast("long")).withColumns({c: F.concat(F.lit(c), F.lit("-"), F.col("doc_id")) for c in names})
    items = spark.createDataFrame([(1, "held item text")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = {
        "quality": (quality.keep_good(docs, labels), {1, 2, 3, 4}), "near": (neardup.keep_one(docs), {1, 2, 3, 4}), "leaks": (decontaminate.drop_contaminated(docs, items), {1, 2, 3}),
        "mix": (mixing.mixed_documents(docs), None), "shards": (sharding.sharded(docs), {1, 2, 3, 4}),
    }
    for name, (out, ids) in made.items():
        assert out.columns == [*docs.columns, *(["shard"] if name == "shards" else [])], name
        rows = out.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names), name
        assert ids is None or {r.doc_id for r in rows} == ids, name
    assert "shard" in made["shards"][0].columns and sharding.sharded(docs.withColumn("SHARD", F.lit(7))).columns.count("shard") == 1
