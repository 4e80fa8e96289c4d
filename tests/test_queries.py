"""Registered queries against their SQL, the entry point, and streaming."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalog
from weftline.streaming.memory_stream import add_messages

SOME = ("segment_by_nation", "traverse_both", "build_graph_fold", "greedy_chunks", "lexical_topk", "char_bigram_f1", "failure_attribution", "islands_min_run", "ledger_grouping_sets", "cosine_topk")


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"n_name", "n"}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, sf, name):
    from oracle_check import normal

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, made = catalog.QUERIES[name](spark, sf), db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(made.columns)
    assert normal([tuple(r) for r in df.select(*columns).collect()]) == normal(made.select(*(f'"{c}"' for c in columns)).fetchall())


def test_stream_adds_each_text_once(spark, tmp_path):
    inbox, store = f"{tmp_path}/in", f"{tmp_path}/store"
    kind = "user_id string, text string, ts timestamp"
    for texts in (["a", "b", "a"], ["b", "c", None]):
        spark.createDataFrame([("u", t, None) for t in texts], kind).write.mode("append").parquet(inbox)
        add_messages(spark.readStream.schema(kind).parquet(inbox), store, f"{tmp_path}/check").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]
