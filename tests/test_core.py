"""Core operators, graph construction, retrieval and grading on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import core, facts, grading, graph, memory, retrieval
from weftline.plans import sandbox, views
from weftline.schema import Schema, SchemaError, check_schema, degraded, merge_schema
from weftline.sources import tables


@pytest.fixture(scope="module")
def store(spark):
    make = spark.createDataFrame
    flight = "__id__ string, __type__ string, ord int, `Flight Number` string, FlightDate string, Price double, OriginCityName string, DestCityName string, DepTime string, ArrTime string"
    views_ = {
        "Flight": make([("F1", "Flight", 1, "F1", "d1", 120.0, "Columbus", "Newark", None, None), ("F2", "Flight", 2, "F2", "d1", 80.5, "Columbus", "Newark", None, None)], flight),
        "City": make([("C1", "City", 3, "Columbus"), ("C2", "City", 4, "Newark")], "__id__ string, __type__ string, ord int, name string"),
        "Restaurant": make([("R1", "Restaurant", 5, "R1", "Newark", "American, French", 20.0, 4.0)], "__id__ string, __type__ string, ord int, Name string, City string, Cuisines string, `Average Cost` double, `Aggregate Rating` double"),
    }
    return core.GraphStore(views_, make([("F1", "arrives_at", "C2"), ("R1", "located_in", "C2")], "src string, relation string, dst string"))


def test_operators_on_the_smoke_graph(store):
    flights = core.lookup_entities(store, "Flight", {"OriginCityName": "columbus"})
    assert flights.count() == 2 and core.lookup_entities(store, "Flight", limit=1).first()["__id__"] == "F1"
    assert [r["__id__"] for r in core.filter_numeric(flights, "Price", "<=", 100).collect()] == ["F2"]
    assert core.filter_numeric(flights, "Price", "~", 100).count() == 0
    assert core.project_properties(flights, ["Price", "none"]).orderBy("Price").first().asDict() == {"__id__": "F2", "__type__": "Flight", "Price": 80.5, "none": None}
    start = flights.where("`Flight Number` = 'F1'").select(F.col("__id__").alias("start_id"))
    assert [r.node_id for r in core.traverse_relations(store, start, "arrives_at").collect()] == ["C2"]
    assert core.traverse_relations(store, start, "arrives_at", "sideways").count() == 0
    eats = store.view("Restaurant")
    assert core.filter_set_overlap(eats, "Cuisines", ["french"]).count() == 1 and core.filter_set_overlap(eats, "Cuisines", ["fren"]).count() == 0
    assert core.aggregate_values(flights, "Price", "sum").first().value == 200.5
    assert core.filter_relation_connected(eats, store, "located_in", "City", {"name": "Nowhere"}).count() == 0
    assert core.filter_relation_connected(eats, store, "located_in", "City", {"name": "newark"}).count() == 1
    with pytest.raises(KeyError):
        store.view("Nothing")


def test_edge_cases_of_filters(spark):
    rows = spark.createDataFrame([("a", "t", "x y", None), ("b", "t", None, "n/a"), ("c", "t", "Y", "3")], "__id__ string, __type__ string, f string, v string")
    ids = lambda df: sorted(r["__id__"] for r in df.collect())
    assert [ids(core.filter_categorical(rows, "f", [], m)) for m in ("any", "all", "exclude")] == [[], ["a", "b", "c"], ["a", "b", "c"]]
    assert ids(core.filter_categorical(rows, "f", ["y"])) == ["a", "c"] and ids(core.filter_categorical(rows, "f", ["y"], "exclude")) == ["b"]
    assert core.aggregate_values(rows, "v", "count").first().value == 3
    assert [(r.group, r.value) for r in core.aggregate_values(rows, "v", "count", "f").collect()] == [("Y", 1.0)]
    assert core.aggregate_values(rows.where("v = 'n/a'"), "v", "sum").first().value is None
    assert core.aggregate_values(rows, "v", "median").first().value is None
    slots = core.extract_runtime_slots(rows, "f", ["y_z", "q"]).orderBy("__id__").collect()
    assert [r.slots for r in slots] == [{"y_z": True}, {}, {"y_z": True}]


def test_numbers_in_text(spark):
    values = ["$1,200.50", "abc", "-3", "", None, "12,,3", "1.2.3"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(text.to_num(F.col("v")).alias("n"))
    assert [r.n for r in rows.collect()] == [1200.5, None, -3.0, None, None, 123.0, 1.2]


def test_bigram_f1_and_terms(spark):
    rows = spark.createDataFrame([("abab", "ab"), ("", " "), ("a", "bc"), ("a b", "ab")], "a string, b string").select(text.char_bigram_f1(F.col("a"), F.col("b")).alias("f"), text.terms(F.col("a")).alias("t")).collect()
    assert [round(r.f, 4) for r in rows] == [0.5, 1.0, 0.0, 1.0] and rows[0].t == ["a", "b", "ab", "ba"]


SEED = {
    "entity_types": {
        "Dish": {"primary_key": ["name"], "attributes": [{"name": "name"}, {"name": "served_at"}, {"name": "price", "dtype": "float"}], "attribute_aliases": {"cost": "price"}},
        "Place": {"primary_key": ["name"], "attributes": [{"name": "name"}]},
    },
    "relation_types": {"served": {"domain": "Dish", "range": "Place", "derive": {"attr": "served_at"}}},
    "axioms": [{"kind": "disjoint", "classes": ["Dish", "Place"]}],
}


def test_schema(spark):
    schema = Schema.from_dict(SEED)
    assert schema.validate() == [] == check_schema(schema) and Schema.from_yaml(f"```yaml\n{schema.to_yaml()}```").to_dict() == schema.to_dict()
    assert schema.entity("Dish").canonical_attr("cost") == "price" and schema.entity("Dish").canonical_attr("x") is None
    broken = SEED | {"relation_types": {"r": {"domain": "Dish", "range": "Nowhere", "inverse_of": "q"}}}
    assert len(Schema.from_dict(broken).validate()) == 2
    conflict = {"entity_types": {n: {"primary_key": ["k"], "attributes": [{"name": "k"}]} for n in "ABC"}, "axioms": [{"kind": "disjoint", "classes": ["A", "B"]}, {"kind": "subclass", "sub": "C", "sup": "A"}, {"kind": "subclass", "sub": "C", "sup": "B"}]}
    assert [(f.kind, f.subject) for f in check_schema(Schema.from_dict(conflict))] == [("disjointness", "C")]
    for bad in ({}, {"entity_types": {"A": {}}}, {"entity_types": {"A": {"primary_key": "k", "attributes": [{"name": "k", "dtype": "blob"}]}}}, SEED | {"axioms": [{"kind": "odd"}]}):
        with pytest.raises(SchemaError):
            Schema.from_dict(bad)
    assert degraded(schema, {"Dish": {"served_at"}}).entity("Dish").primary_key == ["served_at"]
    assert merge_schema(schema, Schema.from_dict({"entity_types": {"Dish": {"primary_key": ["other"], "attributes": [{"name": "spice"}]}}})).entity("Dish").names[-1] == "spice"


def test_build_graph_and_derive(spark):
    schema = Schema.from_dict(SEED)
    ents = [("Dish", {"name": "Pho  bo"}, {"price": "", "served_at": "A; B;"}, 1), ("Dish", {"name": " Pho bo"}, {"price": "9", "served_at": "C"}, 2), ("Alien", {"name": "x"}, {}, 3)]
    rels = [("likes", "Dish", {"name": "Pho bo"}, "Guest", {"name": "Z"}, 1), ("likes", "Dish", {"name": "Pho bo"}, "Guest", {"name": "Z"}, 2)]
    kind = "map<string,string>"
    nodes, edges = graph.build_graph(spark.createDataFrame(ents, f"etype string, key {kind}, props {kind}, ord int"), spark.createDataFrame(rels, f"relation string, head_type string, head_key {kind}, tail_type string, tail_key {kind}, ord int"), schema)
    by = {r.node_id: r for r in nodes.collect()}
    assert set(by) == {"Dish::name=Pho bo", "Guest::name=Z"} and edges.count() == 1
    assert (by["Dish::name=Pho bo"].props, by["Dish::name=Pho bo"].n_merged, by["Guest::name=Z"].n_merged) == ({"price": "9", "served_at": "A; B;"}, 2, 0)
    more, all_edges = graph.derive_relations(nodes, edges, schema)
    assert {(r.dst, r.derived) for r in all_edges.where("relation = 'served'").collect()} == {("Place::name=A", True), ("Place::name=B", True)} and more.count() == 4
    again_nodes, again = graph.derive_relations(more, all_edges, schema)
    assert again_nodes.count() == 4 and again.count() == all_edges.count()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,city\n"A, B",X\nC,NaN\nD,\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), ["name", "city"]).collect()] == [("A, B", "X")]
    dates = ["['2022-03-01']", "2022-03-01", None, '["[", "\'", "2", "0", "2", "2", "-", "0", "3", "-", "0", "1", "\'", "]"]']
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string").orderBy("i").select(tables.parse_dates(F.col("d")).alias("o")).collect()
    assert [r.o for r in rows] == [["2022-03-01"], ["2022-03-01"], [], ["2022-03-01"]]
    assert spark.createDataFrame([("{'cuisine': None, 'room type': 'private'}",), ("no",)], "v string").select(tables.parse_literal_map(F.col("v")).alias("m")).collect()[0].m == {"cuisine": None, "room type": "private"}
    chunks = spark.createDataFrame([(["aa", "bbb", "c", "dddd"],)], "x array<string>").select(tables.greedy_chunks(F.col("x"), F.char_length, 4).alias("a"), tables.greedy_chunks(F.col("x"), F.char_length, 4, overlap=True).alias("b")).first()
    assert chunks.a == [["aa", "bbb"], ["c", "dddd"]] and chunks.b == [["aa", "bbb"], ["bbb", "c"], ["c", "dddd"]]


def test_facts(spark):
    rows = spark.createDataFrame([(1, "A b", "x 12"), (2, "Ab", "x12"), (3, "Ab", "X12")], "ord int, s string, t string")
    assert sorted(r.ord for r in facts.fact_dedup(rows, "s", "t", ["ord"]).collect()) == [1, 3]
    key = spark.createDataFrame([({"Name": "Parrot's", "City": "Miami"},), ({"Name": "Italiize"},), ({"n": "99"},)], "k map<string,string>")
    assert [r.g for r in key.select(facts.grounded(F.col("k"), F.lit("Parrot's,Miami,Chinese")).alias("g")).collect()] == [True, False, True]


def test_retrieval_tiers(spark):
    rows = spark.createDataFrame([("f1", "Ann", "likes tea", "2023-01-02", "fact"), ("f2", "Annabel", "has a red car", "2023-02-02", "fact"), ("f3", "Bob", "tea time", None, "fact")], "fid string, subject string, statement string, date_iso string, ftype string")
    found = lambda **k: [r.fid for r in retrieval.facts_by_subject(rows, "Ann", **k).orderBy("n").collect()]
    assert found() == ["f1", "f2"] and found(keywords=["tea"]) == ["f1"] and found(keywords=["auto"], synonyms={"auto": ["car"]}) == ["f2"] and found(low="2023-02-01") == ["f2"]
    assert retrieval.exists_fact(rows, "Ann", ["zebra"]).first().exists is False and retrieval.exists_fact(rows, "Ann", ["tea"]).first().exists is True
    assert [r.fid for r in retrieval.timeline(rows, high="2023-01-31").collect()] == ["f1"]


def test_toolbox(spark):
    make = spark.createDataFrame
    known = make([("f1", "Ann", "likes tea", "2023-01-02", "fact", ["food"]), ("f2", "Bob", "reads books", None, "fact", ["hobby", "food"])], "fid string, subject string, statement string, date_iso string, ftype string, topics array<string>")
    people = make([("Ann", "人物", ["Annie"]), ("Bob", "人物", [])], "name string, etype string, aliases array<string>")
    box = retrieval.ToolBox(known, people, make([("f1", "归属于", "Ann"), ("f1", "涉及物品", "tea"), ("f2", "归属于", "Bob")], "src string, relation string, dst string"))
    assert [r["name"] for r in box.execute("查找实体", text="annie")] == ["Ann"] and [r["fid"] for r in box.execute("获取相关事实", entity="tea")] == ["f1"]
    assert [r["fid"] for r in box.execute("检索事实", keywords=["books"])][0] == "f2" and box.execute("列出主题")[0] == {"topic": "food", "n": 2}
    assert box.execute("计算日期", anchor="2023-05-25", expression="昨天")[0]["value"] == "2023-05-24"
    assert {r["node_id"] for r in box.execute("遍历关系", start="f1")} == {"Ann", "tea"} and isinstance(box.execute("none"), str) and isinstance(box.execute("查找实体"), str)


def test_grades(spark):
    rows = [(1, "三个孩子", "3", None, 1), (2, "对话中未提及该信息", None, "red", 5), (3, "未提及，但可能是red", None, "red", 5), (4, "不是，他没有", "不是", None, 5), (5, "2023年5月7日", "5月7日", None, 2), (6, None, "x", None, 1), (7, "maybe", "tea", None, 1)]
    got = grading.deterministic_grade(spark.createDataFrame(rows, "idx int, answer string, gold string, trap string, category int")).collect()
    assert {r.idx: r.grade for r in got} == {1: "exact", 2: "exact", 3: "wrong", 4: "exact", 5: "exact", 6: "wrong", 7: None}
    keys = spark.createDataFrame([({},), ({"cuisine": "x", "transportation": "y"},)], "c map<string,string>").select(grading.applicable_keys(F.col("c")).alias("k")).collect()
    assert [r.k for r in keys] == [["valid_cost"], ["valid_cost", "valid_cuisine", "valid_transportation"]]
    queries = spark.createDataFrame([(1, ["h"]), (2, ["h"]), (3, [])], "query_id int, applicable array<string>")
    results = spark.createDataFrame([(1, True, True, True), (2, True, False, True)], "query_id int, delivered boolean, s boolean, h boolean")
    r = grading.plan_scores(queries, results, ["s"], ["h"]).first()
    assert (r.delivery, r.soft_micro, r.hard_micro, r.final) == (0.6667, 0.3333, 1.0, 0.3333)


def test_memory(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = memory.search(rows, F.array(F.lit(1.0), F.lit(0.0)), "id", "v", 3).collect()
    assert [(r.id, round(r.score, 4)) for r in got] == [(1, 1.0), (3, 0.7071), (2, 0.0)]
    parsed = spark.createDataFrame([('```json\n{"memory": [{"text": " a "}, {"text": ""}]}\n```',), ("none",)], "r string").select(memory.parse_memories(F.col("r")).alias("m")).collect()
    assert [r.m for r in parsed] == [["a"], []]


def test_views(store, spark):
    exact = views.search_flights(store, "Columbus", "Newark", "d1").collect()
    assert [(r["Flight Number"], r.match_note, r.suggestion) for r in exact] == [("F2", "exact", ""), ("F1", "exact", "")]
    loose = views.search_flights(store, "Columbus", "Utah", "d9", max_price=100).collect()
    assert [(r["Flight Number"], r.match_note) for r in loose] == [("F2", "dest_relaxed")] and loose[0].suggestion.endswith("Newark")
    rows, stages = views.find_restaurants(store, "newark", ["French"], 10)
    assert rows.count() == 0 and stages.first().empty_stage == "cost"
    cost = spark.range(1).select(views.trip_cost(F.array(F.lit(120.0)), F.array(F.lit(30.0), F.lit(25.0)), F.array(F.struct(F.lit(90.0).alias("price"), F.lit(2).alias("nights"), F.lit(2).alias("occupancy"))), F.array(F.lit(150.0)), F.lit(2), "taxi").alias("c")).first().c
    assert tuple(cost) == (240.0, 110.0, 180.0, 150.0, 680.0)


def test_sandbox(store):
    good = "def cheap(store, most):\n    'Cheap flights.'\n    return filter_numeric(store.view('Flight'), 'Price', '<=', most).select('Price')\n"
    catalog = sandbox.FunctionCatalog()
    assert catalog.publish("cheap", good, store, most=100) and catalog.load("cheap")(store, 100).count() == 1
    assert not catalog.publish("dear", good.replace("cheap", "dear"), store, most=1) and catalog.functions["dear"].failed == "no rows"
    for bad in ("import os", "def f():\n    return open('x')", "x = (1).__class__", "def f(s):\n    return s.write.parquet('x')", "def f():\n    return F.udf(1)"):
        with pytest.raises(sandbox.SandboxError):
            sandbox.check_source(bad)
    assert sandbox.parse_action('Action: look[{"a": 1}]') == ("look", {"a": 1}) and sandbox.parse_action("look(a=1)") == ("look", {"a": 1}) and sandbox.parse_action("hm") is None
