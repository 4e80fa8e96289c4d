"""Graphs kept up by batches, and names of a batch."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, retrieval
from weftline.operators.containment import match_entities, match_subjects
from weftline.operators.increments import GraphLog

ENTITY = "etype string, key map<string,string>, props map<string,string>, ord long"
RELATION = "relation string, head_type string, head_key map<string,string>, tail_type string, tail_key map<string,string>, ord long"


def candidates(seed, n=120):
    rng = random.Random(seed)
    key = lambda: {"id": str(rng.randint(0, 12)), "b": rng.choice("xy")}
    entities = [(rng.choice("AB"), key(), {p: rng.choice(["1", "2", "", None]) for p in rng.sample("pqr", 2)}, i) for i in range(n)]
    relations = [(rng.choice("rs"), rng.choice("AB"), key(), rng.choice("ABC"), key(), n + i) for i in range(n)]
    return entities, relations


def whole(nodes, edges):
    text = lambda m: sorted(m.items())
    rows = sorted((r.node_id, r.etype, text(r.key), text(r.props), r.n_merged, r.ord) for r in nodes.collect())
    return rows, sorted(tuple(r) for r in edges.collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_any_split_gives_the_whole_graph(spark, tmp_path, parts):
    entities, relations = candidates(parts)
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    log = GraphLog(spark, f"file://{tmp_path}/log")
    assert whole(*log.graph()) == ([], [])
    deal = lambda rows: [[r for n, r in enumerate(rows) if n * 7 % 11 % parts == i] for i in range(parts)]
    noise_e, noise_r = candidates(99, 20)
    for i, (e, r) in enumerate(zip(deal(entities), deal(relations), strict=True)):
        # Noise is said in one batch and taken back in another, in the first case before it is said.
        assert log.apply(f"b{i}", make(e, ENTITY), make(r, RELATION))
    assert log.apply("gone", gone_entities=make(noise_e, ENTITY), gone_relations=make(noise_r, RELATION))
    assert log.apply("noise", make(noise_e, ENTITY), make(noise_r, RELATION))
    want = whole(*graph.build_graph(make(entities, ENTITY), make(relations, RELATION)))
    assert whole(*log.graph()) == want
    assert not log.apply("b0", make(entities, ENTITY), make(relations, RELATION)) and whole(*log.graph()) == want
    log.compact("all")
    assert log.batches()[0] == ["all"] and whole(*log.graph()) == want and not log.apply("gone", make(entities, ENTITY))
    assert log.apply("later", gone_entities=make(entities[:60], ENTITY), gone_relations=make(relations[:60], RELATION))
    assert whole(*log.graph()) == whole(*graph.build_graph(make(entities[60:], ENTITY), make(relations[60:], RELATION)))


def test_a_batch_that_broke_off(spark, tmp_path):
    entities, relations = candidates(5, 30)
    log = GraphLog(spark, f"file://{tmp_path}/log")
    log.apply("a", spark.createDataFrame(entities, ENTITY))
    spark.createDataFrame([], "x int").write.parquet(f"file://{tmp_path}/log/entries/b")  # entries without a marker
    want = whole(*graph.build_graph(spark.createDataFrame(entities, ENTITY), spark.createDataFrame([], RELATION)))
    assert whole(*log.graph()) == want
    assert log.apply("b", relations=spark.createDataFrame(relations, RELATION))
    assert whole(*log.graph()) == whole(*graph.build_graph(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(relations, RELATION)))


def test_names_of_a_batch_equal_single_searches(spark):
    names = [("Caroline", "person", ["Caro", "C."]), ("Melanie", "person", []), ("the Lake", "place", None), ("", "none", ["x"]), ("Ro", "person", ["Roland"])]
    entities = spark.createDataFrame(names, "name string, etype string, aliases array<string>")
    texts = ["caro", "ROL", "la", "Melanie and Caroline", "ro", "Ro", "", "zz", None, "the Lake house"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {(r.query_id, r.name) for r in match_entities(asked, entities).collect()}
    assert got == {(i, r.name) for i, t in enumerate(texts) if t for r in retrieval.find_entities(entities, t).collect()}
    subjects = entities.select(F.col("name").alias("subject"))
    got = {(r.query_id, r.subject) for r in match_subjects(asked, subjects).collect()}
    assert got == {(i, r.subject) for i, t in enumerate(texts) if t for r in subjects.where(retrieval.subject_matches(F.col("subject"), t)).collect()} | {(6, "")}
