"""Conversations: loaders, annotations, extraction forms, tools' order, consensus, gates, model calls."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import dates
from weftline.operators import facts, grading, memory, retrieval
from weftline.plans import sandbox
from weftline.schema import Schema, SchemaError, load_skeleton
from weftline.sources import tables

FILE = [
    {
        "sample_id": "c1",
        "conversation": {"speaker_a": "Ann", "speaker_b": "Bob", "session_1": [{"speaker": "Ann", "dia_id": "D1:1", "text": "hi"}, {"speaker": "Bob", "dia_id": "D1:2", "text": ""}], "session_1_date_time": "1:00 pm on 8 May, 2023", "session_2": []},
        "qa": [{"question": "q", "category": 2, "answer": 7, "evidence": ["D1:1"]}, {"question": "r", "category": 5, "adversarial_answer": "z"}],
        "observation": {"session_1_observation": {"Ann": [["is well", "D1:1"], ["no id", ""], "odd"], "Bob": []}},
        "event_summary": {"events_session_1": {"Ann": ["runs", " "], "Bob": [], "date": "2023年五月二十五日"}, "events_session_2": {"Bob": ["reads"], "date": "8 May, 2023"}, "events_session_3": {"Bob": ["sits"]}},
    }
]


def test_conversation_file(spark, tmp_path):
    path = f"{tmp_path}/c.json"
    (tmp_path / "c.json").write_text(json.dumps(FILE, ensure_ascii=False))
    turns = tables.load_turns(spark, path)
    assert [r.dia_id for r in tables.session_by_no(turns, 1).collect()] == ["D1:1"] and tables.session_by_no(turns, 2).count() == 0
    asked = tables.load_questions(spark, path).orderBy("idx").collect()
    assert [(r.idx, r.category, r.answer, r.adversarial_answer, r.evidence) for r in asked] == [(0, 2, "7", None, ["D1:1"]), (1, 5, None, "z", [])]
    seen, events = tables.load_observations(spark, path), tables.load_events(spark, path)
    assert [tuple(r) for r in seen.collect()] == [("c1", "D1:1", "Ann", "is well")]
    assert {(r.date_iso, r.subject, r.statement) for r in events.collect()} == {("2023-05-25", "Ann", "runs"), ("2023-05-08", "Bob", "reads"), ("", "Bob", "sits")}
    made = {r.statement: (r.ftype, r.granularity, r.sources, r.session_no) for r in facts.annotation_facts(seen, events).collect()}
    assert made == {"is well": ("背景", "无", ["D1:1"], 1), "runs": ("事件", "日", [], 0), "reads": ("事件", "日", [], 0), "sits": ("事件", "无", [], 0)}
    speakers = facts.speaker_labels(tables.load_speakers(spark, path)).select("name", "identity")
    mentions = spark.createDataFrame([("Ann", "人物", "Annie", 1), ("Ann", "物品", "Ann", 2), ("Bob", "地点", None, 3)], "name string, etype string, alias string, ord int")
    rolled = {(r.name, r.etype): (r.aliases, r.identity) for r in facts.entity_rollup(mentions, speakers).collect()}
    assert rolled == {("Ann", "人物"): (["Annie"], "说话人甲"), ("Bob", "地点"): ([], None), ("Bob", "人物"): ([], "说话人乙")}
    sessions = turns.select("session_no", dates.parse_session_datetime(F.col("session_date")).alias("session_date")).unionByName(spark.createDataFrame([(3, None)], "session_no int, session_date date"))
    assert {tuple(r) for r in facts.session_nodes(sessions).collect()} == {(1, "2023-05-08", "一"), (3, "", "")}


def test_chinese_dates(spark):
    texts = ["2023年5月25日", "2023 年 十二月 三十一号", "2023年十月", "2023年13月1日", "2023年2月30日", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(dates.cn_date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in rows.collect()] == ["2023-05-25", "2023-12-31", None, None, None, None, None]


DISHES = Schema.from_dict(
    {
        "entity_types": {
            "Dish": {"primary_key": ["name"], "attributes": [{"name": "name"}, {"name": "price", "dtype": "float"}], "attribute_aliases": {"cost": "price"}},
            "Place": {"primary_key": ["name"], "attributes": [{"name": "name"}]},
        },
        "relation_types": {"served": {"domain": "Dish", "range": "Place"}},
    }
)


def test_extraction_forms(spark):
    compact = 'Here:\n```json\n{"e": [["No", {"name": "q"}], ["Dish", {"name": "Pho", "z": 1}, {"cost": 9, "hue": "red"}], ["Place", {"name": "A"}], ["Place", {"z": 1}], 5], "r": [["served", 0, 1], ["served", 0, 2], ["eaten", 0, 1], ["served", "x", 1], 7]}\n``` done {'
    verbose = '{"entities": [{"etype": "Dish", "key": {"name": "Pho"}, "properties": {"price": 3}}, {"etype": "Dish"}], "relations": [{"relation": "served", "head": ["Dish", {"name": "Pho"}], "tail": ["Place", {"name": "B"}]}, {"relation": "served", "head": ["No", {}], "tail": []}]}'
    raw = spark.createDataFrame([("c", compact), ("v", verbose), ("x", "none"), ("n", None), ("o", "{}")], "chunk_id string, text string")
    e, r, counts = facts.parse_extraction(raw, "text", DISHES)
    assert {(x.chunk_id, x.pos, x.etype, x.key["name"], x.props.get("price")) for x in e.collect()} == {("c", 0, "Dish", "Pho", "9"), ("c", 1, "Place", "A", None), ("v", 0, "Dish", "Pho", "3")}
    assert {x.chunk_id: (x.head, x.tail, x.head_key["name"], x.tail_type, x.tail_key["name"]) for x in r.collect()} == {"c": (0, 1, "Pho", "Place", "A"), "v": (0, None, "Pho", "Place", "B")}
    assert {x.chunk_id: (x.invalid, x.failed) for x in counts.collect()} == {"c": (7, False), "v": (2, False), "x": (0, True), "n": (0, True), "o": (0, False)}


def test_skeleton():
    schema = load_skeleton()
    assert schema.entity("会话").primary_key == ["序号"] and len(schema.entities) == 8 and len(schema.relations) == 16
    assert load_skeleton(schema.to_yaml()).to_dict() == schema.to_dict()
    with pytest.raises(SchemaError):
        load_skeleton("entity_types: {A: {primary_key: [k], attributes: [{name: k}]}}\nrelation_types: {r: {domain: A, range: B}}")


FACT = "fid string, subject string, statement string, date_iso string, granularity string, date_raw string, ftype string, sources array<string>"


@pytest.fixture(scope="module")
def known(spark):
    rows = [
        ("f1", "Ann", "tea tea", "2023-02-01", "日", "昨天", "事件", ["D1:1"]), ("f2", "Ann", "coffee", "2023-01-01", "日", "", "状态", []),
        ("f3", "Bob", "tea", "2023-01-05", "日", "", "事件", ["D9:1"]), ("f4", "Ann's mother", "计划去跑步活动中心看看并且一直待到很晚很晚才回家", None, "无", "", "计划", ["x"]), ("f5", "Ann", "运动", "2023-03-01", "日", "", "事件", None),
    ]
    return spark.createDataFrame(rows, FACT)


def test_timeline_order_and_lines(spark, known):
    scores = spark.createDataFrame([("f1", 2.0), ("f2", 3.0), ("f3", 9.0)], "fid string, score double")
    order = lambda **k: [r.fid for r in retrieval.timeline(known, subject="Ann", **k).collect()]
    assert order() == ["f2", "f1", "f5"] and order(keywords=["tea"]) == ["f1"] and order(keywords=["tea"], scores=scores) == ["f2", "f1"] and order(low="2023-02-01", high="2023-02-01") == ["f1"]
    sessions = spark.createDataFrame([(1, "2023-02-02")], "session_no int, session_date string")
    line = retrieval.fact_line(*(F.col(c) for c in ("fid", "subject", "statement", "ftype", "date_iso", "granularity", "date_raw", "sources", "anchor")))
    got = {r.fid: r.line for r in retrieval.with_anchor(known, sessions).select("fid", line.alias("line")).collect()}
    assert got["f1"] == "[f1] Ann｜tea tea｜事件｜2023-02-01(日|原文:昨天)｜锚:2023-02-02｜出处:D1:1" and got["f3"] == "[f3] Bob｜tea｜事件｜2023-01-05(日)｜出处:D9:1" and "｜无日期｜" in got["f4"]
    assert retrieval.rendered(["a"], 1) == "（共1条）\na" and "显示第1-1条" in retrieval.rendered(["a"], 2) and retrieval.rendered([], 0).endswith("（无结果）")


def test_enumerate_category(spark, known):
    entities = spark.createDataFrame([("tea", "活动"), ("cup", "物品")], "name string, etype string")
    edges = spark.createDataFrame([("f1", "涉及活动", "tea"), ("f3", "涉及活动", "tea"), ("f1", "涉及物品", "cup"), ("f2", "归属于", "Ann")], "src string, relation string, dst string")
    got = lambda *a: [(r.element, r.fid) for r in retrieval.enumerate_category(known, edges, entities, *a).collect()]
    assert got("Ann") == [("计划去跑步活动中心看看并且一直待到很晚很", "f4"), ("tea", "f1"), ("运动", "f5")]
    assert got("Ann", "作品") == [("cup", "f1")] and got("") == [] and got("Nobody") == []


def test_consensus_and_gates(spark):
    votes = [("a", 0, "X", "x", False, 1), ("a", 1, "未", "", True, 0), ("a", 2, "x", "x", False, 5), ("b", 0, "N", "n", True, 0), ("b", 1, "N", "n", True, 0), ("b", 2, "y", "y", False, 9), ("c", 0, "p", "p", False, 1), ("c", 1, "q", "q", False, 3), ("c", 2, "N", "n", True, 9)]
    rows = spark.createDataFrame(votes, "question string, ord int, answer string, norm string, refused boolean, evidence int")
    assert {r.question: (r.ord, r.refused) for r in retrieval.consensus(rows).collect()} == {"a": (0, False), "b": (0, True), "c": (1, False)}
    picks = spark.createDataFrame([("b", 2), ("c", 0)], "question string, pick int")
    assert {r.question: r.ord for r in retrieval.consensus(rows, picks).collect()} == {"a": 0, "b": 0, "c": 0}
    no = grading.REFUSAL
    cases = [
        ("Ann 去哪", no, [], [], 70.0, "Ann"), ("Ann 去哪", no, [], [], 50.0, "Ann"), ("谁", no, [], [], 100.0, "Ann"), ("谁", no, [], [], 110.0, None), ("谁", "无法确定，也许", ["f"], ["Bob"], None, None),
        ("Ann 去哪", "x", ["f"], ["Bob"], None, None), ("Ann 去哪", "x", ["f"], ["Ann's mother"], None, None), ("Ann 去哪吗", "x", ["f"], ["Bob"], None, None), ("Ann 和 Bob", "x", ["f"], ["Cy"], None, None), (None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(i, *c, ["Ann", "Bob"]) for i, c in enumerate(cases)], "i int, question string, answer string, evidence array<string>, subjects array<string>, top_score double, top_subject string, people array<string>")
    plain = {r.i: r.answer for r in retrieval.gated_answers(rows).collect()}
    assert plain == {0: no, 1: no, 2: no, 3: no, 4: no, 5: no, 6: "x", 7: "x", 8: "x", 9: None}
    retry = F.struct(F.lit("again").alias("answer"), F.array(F.lit("g")).alias("evidence"), F.array(F.lit("Ann")).alias("subjects"))
    asked = {r.i: (r.answer, r.refused) for r in retrieval.gated_answers(rows, retry, F.lit(True)).collect()}
    assert [asked[i][0] for i in (0, 1, 2, 3, 5)] == ["again", no, no, "again", "x"] and not asked[0][1] and asked[1][1]


def test_toolbox_names_and_sessions(spark, known):
    people = spark.createDataFrame([("Ann", "人物", ["Annie", "Bob"]), ("tea", "活动", [])], "name string, etype string, aliases array<string>")
    edges = spark.createDataFrame([("f1", "涉及活动", "tea")], "src string, relation string, dst string")
    box = retrieval.ToolBox(known.withColumn("topics", F.array(F.lit("t"))), people, edges, spark.createDataFrame([(1, "2023-02-02")], "session_no int, session_date string"))
    assert (box.resolve("Annie"), box.resolve("Bob"), box.resolve("Cy"), box.resolve("")) == ("Ann", "Bob", "Cy", "")
    assert [r["fid"] for r in box.execute("查询时间线", subject="Annie")] == ["f2", "f1", "f5"] and [r["fid"] for r in box.execute("查询时间线", keywords=["运"])] == ["f5"]
    assert "锚:2023-02-02" in box.lines(box.facts.where("fid = 'f1'"))


def test_rounds(spark):
    rows = spark.range(40).select("id", F.concat(F.lit("l"), F.col("id") % 3).alias("level"))
    got = grading.partition_rounds(rows, "level", F.xxhash64("id"), 6, 4).collect()
    assert len({r.id for r in got}) == 24 and all(sum(r.round == k and r.level == f"l{j}" for r in got) == 2 for k in range(4) for j in range(3))
    assert grading.partition_rounds(rows.limit(5), "level", F.xxhash64("id"), 6, 4).count() == 5


def test_model_calls(spark):
    requests = spark.createDataFrame([("r", "m", "a", "inf_q1"), ("r", "m", "b", "inf_q1"), ("r", "m", "bad", "x"), ("r", "m", "a", "inf_q1")], "role string, model string, messages string, namespace string")
    cache = spark.createDataFrame([], "request_id string, content string")
    misses = sandbox.cache_misses(requests, cache)
    ledger = spark.createDataFrame([("inf_q1",)], "namespace string")
    allowed = sandbox.within_budget(misses, ledger, {"inf_q": 2, "i": 0})
    assert sorted((r.namespace, r.allowed) for r in allowed.collect()) == [("inf_q1", False), ("inf_q1", True), ("x", True)]

    def call(role, model, messages):
        if messages == "bad":
            raise ValueError("no")
        return messages.upper(), 1, 2

    done = sandbox.call_models(misses, call, attempts=2, wait=0.0).cache()
    assert sorted((r.content or "", r.error or "") for r in done.collect()) == [("", "no"), ("A", ""), ("B", "")]
    assert sorted(str(r.content) for r in sandbox.answered(requests, done).collect()) == ["A", "A", "B", "None"]
    assert sandbox.cache_misses(requests, done.where("content is not null")).count() == 1


def test_compile_rounds(spark):
    from weftline.operators.core import GraphStore

    store = GraphStore({"N": spark.createDataFrame([("a", "N")], "__id__ string, __type__ string")}, spark.createDataFrame([], "src string, relation string, dst string"))
    seen = []

    def write(failed):
        seen.append(failed)
        return "import os" if not failed else "def f(store):\n    return store.view('N')\n"

    catalog = sandbox.FunctionCatalog()
    assert sandbox.compile_function(catalog, "f", write, store) and len(seen) == 2 and "Import" in seen[1]
    assert not sandbox.compile_function(catalog, "g", lambda failed: "import os", store, rounds=2)


def test_search_payload(spark):
    rows = spark.createDataFrame([(1, "x", {"data": "x", "hash": "h", "k": "v"}, [1.0])], "id int, text string, payload map<string,string>, v array<double>")
    got = memory.search_result(memory.search(rows, F.array(F.lit(1.0)), "id", "v", 3), "id", "text", "payload").first()
    assert (got.id, got.memory, got.payload) == (1, "x", {"k": "v"})
