"""Near-duplicates and nearest neighbours against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import ann, neardup
from weftline.llm.components import components
from weftline.llm.wordhash import word_hashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=16), st.lists(st.sampled_from("abc"), max_size=16), st.integers(0, 18))
def test_banded_distance(a, b, most):
    d = distance(a, b)
    assert neardup.banded_distance(a, b, most) == (d if d <= most else most + 1)


def test_sketches_follow_order_and_occurrence():
    words = [f"w{i}" for i in range(60)]
    a, b = (neardup.order_sketches(word_hashes(w), 5, 40) for w in (words, words[30:] + words[:30]))
    assert len(a) == 40 and (a == neardup.order_sketches(word_hashes(list(words)), 5, 40)).all() and 0 < (a != b).sum()
    assert len(neardup.order_sketches(word_hashes(["x"]), 5, 40)) == 0 and len(neardup.candidate_keys(word_hashes([]))) == 0
    # Blocks of sketches give the same keys as all at once.
    whole, neardup.RANKS = neardup.RANKS, 100
    assert (neardup.order_sketches(word_hashes(words), 5, 40) == a).all()
    neardup.RANKS = whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=neardup.EXACT), st.lists(st.sampled_from("abcd"), min_size=1, max_size=neardup.EXACT))
def test_short_texts_lose_no_link(a, b):
    if distance(a, b) <= neardup.most_edits(max(len(a), len(b))):
        assert set(neardup.candidate_keys(word_hashes(a)).tolist()) & set(neardup.candidate_keys(word_hashes(b)).tolist())


@pytest.mark.parametrize("words", [12, 15, 20, 24, 25, 60, 160, 199, 200, 500])
@pytest.mark.parametrize("edited", ["sub", "mixed"])
def test_similar_texts_share_a_key(words, edited):
    """At the threshold itself, with as many scattered edits as it allows, 95 % of pairs meet."""
    rng, met, tries = random.Random(words), 0, 100
    for _ in range(tries):
        a = [f"w{rng.randrange(5000)}" for _ in range(words)]
        b = list(a)
        for i in rng.sample(range(words), neardup.most_edits(words)):
            way = 0 if edited == "sub" else rng.randrange(3)
            b[i] = "new" * (way < 2) + str(rng.random()) * (way < 2) + f" {a[i]}" * (way == 1)
        b = " ".join(b).split()
        met += not neardup.similar(" ".join(a), " ".join(b)) or bool(set(neardup.candidate_keys(word_hashes(a)).tolist()) & set(neardup.candidate_keys(word_hashes(b)).tolist()))
    assert met >= 0.92 * tries


def test_planted_pairs_are_joined(spark):
    """Nine words with the fifth changed, sixty with ten changed, and so on: accepted pairs, each in a vocabulary of its own."""
    rng, rows = random.Random(5), []
    for p in range(300):
        n = rng.choice((5, 9, 12, 14, 17, 22, 30, 60, 150, 190, 230))
        a = [f"v{p}x{rng.randrange(4000)}" for _ in range(n)]
        b = list(a)
        for i in [n // 2] if n < 10 else rng.sample(range(n), rng.randint(1, n // 6)):
            b[i] = f"n{rng.random()}"
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * p] == 2 * p for p in range(300)) and sum(got[2 * p + 1] == 2 * p for p in range(300)) >= 297


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (5, 6), (7, 7), (9, 8), (8, 6)] + [(i, i + 1) for i in range(100, 140)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 5, 9: 5} | dict.fromkeys(range(100, 141), 100)


def classes_by_brute_force(texts):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = (texts[x].lower().split() for x in (i, j))
            same = texts[i] == texts[j] or (a and b and neardup.similar(texts[i], texts[j]))
            if same:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_near_duplicates_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == classes_by_brute_force(texts)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(classes_by_brute_force(texts).values()))


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(3)
    base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(200)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:50], "new", *base[52:]])), (3, None), (4, ""), (5, "hi"), (6, "Hi"), (None, "unique text here"), (None, "another text without an id"), (7, " ".join(base[:90])), (8, "w " * 20_000)]
    # Many texts that share a passage and nothing else, and near copies among them.
    for i in range(40):
        own = [f"o{i}x{j}" for j in range(80)]
        rows += [(100 + 2 * i, " ".join(own + passage)), (101 + 2 * i, " ".join([*own[:40], "edit", *own[41:], *passage]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "keys", "key", "hub", "member", "class_id", "copies", "root", "a", "b")})
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()]
    want = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, None: None, 7: 7, 8: 8} | {100 + i: 100 + i - i % 2 for i in range(80)}
    assert len(got) == len(rows) and dict(got) == want
    kept = neardup.keep_one(docs)
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 2 and kept.count() == len(set(want.values())) + 1
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_ids_of_any_type(spark):
    rows = [("b", "one two three"), ("a", "one two three"), (None, "one two three"), ("c", None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.class_id, r.copies) for r in got].count(("b", "a", 3)) == 1 and {r.class_id for r in got} == {"a", "c"}
    large = (1 << 60) + 1
    got = neardup.near_duplicates(spark.createDataFrame([(large, "x y"), (None, "x y"), (large + 1, "z")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(large, large), (None, large), (large + 1, large + 1)}


def test_large_family_of_loose_copies(spark):
    """Classes are those of all similar pairs that share a sketch, also where few members are near their hub."""
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(1000):
        words = list(base)
        for i in range(200):
            if rng.random() < 0.1:
                words[i] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    meet = defaultdict(list)
    for i, t in enumerate(texts):
        for key in neardup.candidate_keys(word_hashes(t.split())).tolist():
            meet[key].append(i)
    root = list(range(1000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for some in meet.values():
        for n, i in enumerate(some):
            for j in some[:n]:
                if find(i) != find(j) and neardup.similar(texts[i], texts[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert len(set(got.values())) == len({find(i) for i in range(1000)}) and got == {i: find(i) for i in range(1000)}


def test_nearest_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = defaultdict(list)
    for r in ann.nearest(rows, rows.where("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, x = zip(*((r.vec_id, r.embedding) for r in rows.collect()), strict=True)
    ids, x = np.array(ids), np.array(x, dtype=np.float64)
    share = []
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        top = np.lexsort((ids, -score))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s - score[ids == v][0]) < 1e-12 for _, v, s in mine)
        share.append(np.isin(ids[top], [v for _, v, _ in mine]).mean())
    assert np.mean(share) >= 0.9


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(40)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [nan, 1.0, 1.0]), (53, [inf, 1.0, 1.0]), (54, [None, 1.0, 1.0]), (55, []), (None, [1.0, 1.0, 1.0]), (0, [1.0, 0.0, 0.5])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("query_id", "rank", "score", "node", "tree", "leaf", "bunch")})
    got = ann.nearest(data, data.where("vec_id in (0, 1, 50, 51)")).orderBy("query_id", "rank").collect()
    for q in (0, 1):
        # The row without an id is a candidate, after others of its score.
        exact = sorted([(-(1 + (q % 3) * (i % 3) + 0.25), i) for i in range(40) if i != q] + [(-(1.5 + q % 3), None)], key=lambda x: (x[0], x[1] is None, x[1]))[:20]
        assert [(r.vec_id, -r.score) for r in got if r.query_id == q] == [(i, pytest.approx(s)) for s, i in exact]
    assert {r.query_id for r in got} == {0, 1}
    assert ann.nearest(data.limit(0), data.limit(0)).collect() == []


def evenly(words, every):
    return [f"new{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


def clustered(words, rng):
    most = neardup.most_edits(len(words))
    at = rng.randrange(len(words) - most)
    return [f"new{i}" if at <= i < at + most else w for i, w in enumerate(words)]


def scattered(words, rng):
    spots = set(rng.sample(range(len(words)), neardup.most_edits(len(words))))
    return [f"new{i}" if i in spots else w for i, w in enumerate(words)]


@pytest.mark.parametrize("n", [15, 24, 25, 60, 199, 200, 250, 1000, 3000])
def test_keys_shared_at_the_threshold(n):
    """Similar pairs share a key wherever the edits stand; evenly spaced ones are the hardest for windows."""
    rng = random.Random(n)
    tries = 40 if n < 1000 else 12
    for edit, least in ((lambda w: evenly(w, 5), 0.99), (lambda w: clustered(w, rng), 0.95), (lambda w: scattered(w, rng), 0.95)):
        met = 0
        for t in range(tries):
            words = [f"w{t}x{rng.randrange(10**6)}" for _ in range(n)]
            other = edit(words)
            assert neardup.similar(" ".join(words), " ".join(other))
            met += bool(np.isin(neardup.candidate_keys(word_hashes(words)), neardup.candidate_keys(word_hashes(other))).any())
        assert met / tries >= (least if n >= 20 else 0.95), (n, met, tries)


def test_every_fifth_word_replaced(spark):
    rng = random.Random(8)
    rows = []
    for p in range(20):
        words = [f"w{p}x{rng.randrange(10**6)}" for _ in range(250)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(evenly(words, 5)))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_keys_are_shuffled_once(spark):
    """Shared keys are found by one shuffle of the buckets (before: one to count, one to join), hot keys among them."""
    rows = [(n, 5, n % 7) for n in range(3000)] + [(n, 5, 1000 + n) for n in range(3000)] + [(7, 5, -1), (8, 5, -1)]
    found = neardup._shared(spark.createDataFrame(rows, "node long, n_words int, key long"))
    assert sorted(map(tuple, found.collect())) == sorted([r for r in rows if r[2] < 1000])
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_a_hot_hub_s_pairs_carry_ids_alone(spark, monkeypatch):
    """What is read twice for hot hubs is ids; bags are joined once (before: the join with bags ran twice). Ends are listed without expanding pairs."""
    bag = lambda n: bytes([n % 3 * 4] + [1] * (neardup.BAG - 1))
    bags = spark.createDataFrame([(n, 20, bytearray(bag(n))) for n in range(1300)], "node long, n_words int, bag binary")
    pairs = [(0, n) for n in range(1, 1300)] + [(1, n) for n in range(2, 50)]
    given_pairs = spark.createDataFrame(pairs, "hub long, member long")
    asked = []
    spread = neardup.spread_join
    monkeypatch.setattr(neardup, "spread_join", lambda rows, *rest: asked.append(rows.columns) or spread(rows, *rest))
    near = sorted(map(tuple, neardup._near_pairs(given_pairs, bags).collect()))
    assert near == sorted((a, b) for a, b in pairs if abs(a % 3 - b % 3) * 4 <= 4)
    assert asked == [["hub", "member"]]
    ends = neardup._ends(given_pairs)
    assert {r.node for r in ends.collect()} == set(range(1300)) and "Generate" not in ends._jdf.queryExecution().sparkPlan().toString()


def test_members_of_open_groups_are_joined_once(spark):
    """Open groups are told by one join that lists their members (before: three joins, one for the groups and two for their blocks), without hubs."""
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6), (7, 8), (7, 9)], "hub long, member long")
    roots = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (8, 7), (9, 7)], "node long, root long")
    found = neardup._open_groups(pairs, roots)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1, False, 1, 1), (1, 3, 3, True, 1, 1), (1, 4, 4, True, 1, 1)]
    known = spark.createDataFrame([(n, n) for n in range(10)], "node long, what long")
    plan = neardup._blocks(found, known)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1  # with what is known


def test_block_aligns_few_unlike_pairs(monkeypatch):
    """Long texts of one vocabulary pass the bag of BAG counts though a fourth of their words differ; the wide bag rules most of them out before they are aligned, and no similar pair."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(700)]
    texts = [" ".join(w if rng.random() > 0.13 else f"n{rng.randrange(10**6)}" for w in base) for _ in range(40)]
    texts.append(" ".join(w if i % 10 else f"x{i}" for i, w in enumerate(texts[0].split())))
    n = len(texts)
    t = pa.table({"key": [0] * n, "node": range(n), "root": range(n), "minor": [True] * n, "keys": [[0]] * n, "text": texts, "row": [0] * n, "col": [0] * n})
    t = pa.concat_tables([t.append_column("row_side", pa.array([side] * n)) for side in (True, False)])
    aligned, align = [], neardup.banded_distance
    monkeypatch.setattr(neardup, "banded_distance", lambda *a: aligned.append(1) or align(*a))
    links = set(map(tuple, (sorted(r.values()) for r in neardup._block_links(t).to_pylist())))
    bags = [neardup.word_bag(word_hashes(x.split())).astype(int) for x in texts]
    passed = sum(max(np.maximum(a - b, 0).sum(), np.maximum(b - a, 0).sum()) <= 140 for i, a in enumerate(bags) for b in bags[:i])
    assert (0, n - 1) in links and all(neardup.similar(texts[a], texts[b]) for a, b in links)
    assert passed > 200 and len(aligned) < passed / 4


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars are told as such: one step and no second one to see that nothing changes."""
    import weftline.llm.components as module

    steps = []
    staged = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: steps.append(name) or staged(df, name))
    rows = {r.node: r.root for r in module.components(spark.createDataFrame([(1, n) for n in range(2, 30)] + [(40, 50)], "a long, b long")).collect()}
    assert rows == dict.fromkeys(range(1, 30), 1) | {40: 40, 50: 40} and len(steps) == 2


def test_hubs_are_met_where_keys_are_dealt(spark, monkeypatch):
    """Pairs of hub and member take no shuffle of buckets but that by key (before: cut buckets were shuffled twice more, to be counted and joined)."""
    rng, seen, staged = random.Random(4), {}, neardup.staged
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.1 else f"n{rng.randrange(10**6)}" for w in base[: rng.choice((30, 45, 60))]) for _ in range(150)]
    monkeypatch.setattr(neardup, "staged", lambda df, name: seen.setdefault(name, (df, staged(df, name)))[1])
    monkeypatch.setattr(neardup, "discard", lambda *_: None)
    neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = seen["nd-pairs"][0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Inner" not in plan
    # The same pairs by hand.
    node = {bytes(r.hash): r.node for r in seen["nd-nodes"][1].collect()}
    row = {r.row: node[bytes(r.hash)] for r in seen["nd-sketches"][1].collect()}
    buckets = defaultdict(set)
    for r in seen["nd-sketches"][1].collect():
        c = int(np.floor(np.log(r.n_words) / float(np.log(1 / neardup.SIMILARITY))))
        for key in r["keys"] if row[r.row] == r.row else []:
            buckets[key, c].add(r.row)
            buckets[key, c + 1].add(r.row)
    want = {(min(b), n) for b in buckets.values() for n in b if n != min(b)}
    assert want and sorted(map(tuple, seen["nd-pairs"][1].collect())) == sorted(want)


@pytest.mark.parametrize("few", [True, False])
def test_texts_to_verify_are_shuffled_once(spark, monkeypatch, few):
    """Ids say where a text goes, for hubs and members at once (before: texts were read and joined for members and for hubs, then met in a third join)."""
    monkeypatch.setattr(neardup, "HUB_SHARE", 3)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 1000 if few else 0)
    monkeypatch.setattr(neardup, "SLICE", 2)
    word = lambda n, i: f"w{i}" if i >= n % 4 else f"x{n}"
    texts = {n: " ".join(word(n, i) for i in range(10)) for n in range(40)}
    pairs = [(0, n) for n in range(1, 40)] + [(1, n) for n in range(2, 9)] + [(38, 39)]
    table = spark.createDataFrame(list(texts.items()), "node long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = neardup._verified(spark.createDataFrame(pairs, "hub long, member long"), table)
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, checked.collect())) == sorted((a, b, neardup.similar(texts[a], texts[b])) for a, b in pairs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == (1 if few else 3)
