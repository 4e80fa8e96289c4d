"""Saturation, clashes, delta walks and stored graphs."""

import random
import uuid

import pytest

from weftline.operators import axioms, core, storage
from weftline.plans import reasoning
from weftline.schema import Schema


def schema(**parts):
    names = ("A", "B", "C", "D")
    return Schema.from_dict({"entity_types": {n: {"primary_key": ["id"]} for n in names}, "relation_types": parts.get("relations", {}), "axioms": parts.get("axioms", [])})


def brute(steps):
    """All pairs, and their shortest first proofs, by breadth-first search."""
    out = {}
    for start in {x for a, b, _ in steps for x in (a, b)}:
        best = front = {start: ()}
        while front:
            new = {}
            for node, proof in front.items():
                for a, b, axiom in steps:
                    if a == node and b not in best:
                        new[b] = min(new.get(b, (*proof, axiom)), (*proof, axiom))
            best, front = best | new, new
        out |= {(start, n): list(p) for n, p in best.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_saturation_equals_search(spark, seed):
    rng = random.Random(seed)
    steps = sorted({(rng.choice("abcdefg"), rng.choice("abcdefg"), f"x{rng.randint(0, 9)}") for _ in range(16)})
    got = axioms.saturate(spark.createDataFrame(steps, axioms.STEP)).collect()
    assert {(r["from"], r["to"]): r.proof for r in got} == brute(steps) and len(got) == len(brute(steps))


def test_clashes_name_their_axioms(spark):
    made = schema(
        relations={"in": {"domain": ["A"], "range": ["B"], "functional": True}, "holds": {"domain": ["B"], "range": ["A", "C"], "inverse_of": "in"}},
        axioms=[{"kind": "subclass", "sub": "C", "sup": "A"}, {"kind": "subclass", "sub": "A", "sup": "C"}, {"kind": "disjoint", "classes": ["A", "B"]}, {"kind": "cardinality", "class": "B", "relation": "holds", "min": 2}, {"kind": "subclass", "sub": "D", "sup": "C"}, {"kind": "subclass", "sub": "D", "sup": "B"}],
    )
    nodes = spark.createDataFrame([("x", "C"), ("x", "C"), ("y", "B"), ("z", "B"), (None, "A"), ("w", None)], "__id__ string, __type__ string")
    edges = spark.createDataFrame([("x", "in", "y"), ("z", "holds", "x"), ("z", "holds", "x"), ("y", "in", "z"), (None, "in", "y")], "src string, relation string, dst string")
    got = {(r.node, r.kind, r.subject): set(r.axioms) for r in axioms.clashes(nodes, edges, made).collect()}
    assert got[("x", "functional", "in")] == {"inverse: holds <-> in", "functional: in"}
    assert got[("y", "disjoint", "A, B")] == {"domain: in -> A", "disjoint: A, B"}
    assert set(got) == {("x", "functional", "in"), ("y", "disjoint", "A, B"), ("y", "cardinality", "B.holds")}
    impossible = {r.type: set(r.axioms) for r in axioms.unsatisfiable(spark, made).collect()}
    assert impossible == {"D": {"subclass: D <- C", "subclass: C <- A", "subclass: D <- B", "disjoint: A, B"}}
    assert any(line.startswith("[functional] in: x; axioms: ") for line in axioms.audited(nodes, edges, made))


def test_nothing_clashes_without_axioms(spark):
    nodes = spark.createDataFrame([("x", "A")], "__id__ string, __type__ string")
    edges = spark.createDataFrame([], "src string, relation string, dst string")
    assert axioms.clashes(nodes, edges, schema()).collect() == []
    assert [(r.node, r.type, r.proof) for r in axioms.derived_types(nodes, edges, axioms.saturate(axioms.axiom_steps(spark, schema()))).collect()] == [("x", "A", [])]


def walked(edges, starts, relation, direction, hops):
    pairs = {(a, b) for s, r, d in edges if relation in (None, r) for a, b in ([(s, d)] if direction == "out" else [(d, s)] if direction == "in" else [(s, d), (d, s)])}
    out = {}
    for start in starts:
        front = {start}
        for hop in range(1, hops + 1):
            front = {b for a, b in pairs if a in front}
            for b in front:
                out.setdefault((start, b), hop)
    return out


@pytest.fixture(scope="module")
def ring(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randint(0, 30)}", rng.choice(["r", "s"]), f"n{rng.randint(0, 30)}") for _ in range(45)] + [("n1", "r", "n1"), ("hub", "r", "n2")] + [(f"n{i}", "r", "hub") for i in range(30)]
    nodes = spark.createDataFrame([(f"n{i}", "N", i) for i in range(25)] + [("hub", "N", 99)], "__id__ string, __type__ string, ord long")
    return edges, core.GraphStore({"N": nodes}, spark.createDataFrame(edges, "src string, relation string, dst string"))


@pytest.mark.parametrize(("relation", "direction", "hops"), [("r", "out", 1), ("r", "out", 10), (None, "in", 3), ("s", "both", 4), (None, "both", 2)])
def test_walk_equals_search(spark, ring, relation, direction, hops):
    edges, store = ring
    starts = ["n1", "n3", "hub", "nowhere", "n1"]
    got = core.traverse_relations(store, spark.createDataFrame([(s,) for s in starts], "start_id string"), relation, direction, hops).collect()
    assert {(r.start_id, r.node_id): r.hops for r in got} == walked(edges, starts, relation, direction, hops) and len(got) == len(walked(edges, starts, relation, direction, hops))


def test_a_stored_graph_is_not_shuffled(spark, ring):
    edges, store = ring
    name = f"graph_{uuid.uuid4().hex[:8]}"
    storage.save_store(store, name, buckets=4)
    kept = storage.open_store(spark, name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        starts = spark.createDataFrame([("n1",), ("hub",)], "start_id string")
        for direction in ("out", "in"):
            rows = core.traverse_relations(kept, starts, None, direction, 1)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in plan.splitlines() if f"edges_by_{'src' if direction == 'out' else 'dst'}" in line]
            assert scans and all("Bucketed: true" in line for line in scans)
            # Exchanges stand above the starts and the found pairs, never between the edges' scan and their join.
            join = plan[: plan.index("edges_by_")].rindex("SortMergeJoin")
            assert "Exchange" not in plan[plan.index("edges_by_") - 400 : plan.index("edges_by_")].split("Project")[-1] and join > 0
            assert {(r.start_id, r.node_id): r.hops for r in rows.collect()} == walked(edges, ["n1", "hub"], None, direction, 1)
        far = core.traverse_relations(kept, starts, "r", "out", 10)
        assert {(r.start_id, r.node_id): r.hops for r in far.collect()} == walked(edges, ["n1", "hub"], "r", "out", 10)
        linked = core.filter_relation_connected(kept.view("N"), kept, "r", "N", None)
        assert sorted(r["__id__"] for r in linked.collect()) == sorted({s for s, r, d in edges if r == "r" and (d == "hub" or int(d[1:]) < 25)} & ({f"n{i}" for i in range(25)} | {"hub"}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_schema_of_the_queries_is_sound():
    assert reasoning._schema().relation("hosts").inverse_of == "located_in"
