"""Sharding, mixing and decontamination: exact rules on small tables and against brute force."""

import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import common, decontaminate, mixing, sharding
from weftline.llm.common import prefix_sum

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, None, None, None), (None, "x y", "en", "a", 3), (3, "", "en", "b", 0), (4, "  \n ", "en", "b", 4), (5, "word " * 30_000, "en", "b", 150_000), (6, "one two three", "de", "c", 13),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns whose names clash with the operators' own.
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({c: F.lit("clash") for c in ("size", "shard", "slot", "rank", "words", "hash", "group", "weight", "_chunk", "_value", "block", "start", "skey", "epoch", "seed", "item_id", "under")})


def lpt_by_heap(sizes, shards):
    heap, loads = [(0, i) for i in range(shards)], [0] * shards
    for s in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        loads[i] = load + s
        heapq.heappush(heap, (loads[i], i))
    return loads


@pytest.mark.parametrize("seed", range(20))
def test_plan_deals_as_the_heap(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((rng.randint(1, 9), rng.randint(1, 400))) for _ in range(rng.randint(0, 600))] + [7] * rng.choice((0, 200)) + [9000] * rng.randint(0, 2)
    count = defaultdict(int)
    for s in sizes:
        count[s] += 1
    loads, upto = [0] * 7, defaultdict(int)
    for size, first, after, shard in sharding.lpt_plan(sorted(count.items(), reverse=True), 7):
        assert first == upto[size] < after
        upto[size] = after
        loads[shard] += size * (after - first)
    assert loads == lpt_by_heap(sizes, 7) and upto == count


def test_prefix_sums_by_range(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice((None, 1, 2, 3)), rng.randint(0, 5)) for _ in range(500)]
    made = prefix_sum(spark.createDataFrame(rows, "p string, o long, v long").repartition(7), ["p"], ["o"], F.col("v"), "s").collect()
    for p in "ab":
        mine = sorted((r for r in made if r.p == p), key=lambda r: (r.o is None, r.o or 0, r.s, r.v != 0))
        total = 0
        for r in sorted(mine, key=lambda r: (r.s, r.v > 0)):
            assert r.s == total
            total += r.v
        assert [r.o for r in mine] == sorted((r.o for r in mine), key=lambda o: (o is None, o or 0))


def test_hot_keys_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 500), ("b", 3), ("c", 30)) for i in range(n)], "k string, i long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = common.spread_join(rows, keyed, "k", "n")
    assert got.columns == ["k", "i", "top"] and got.groupBy("k", "top").count().orderBy("k").collect() == [("a", 499, 500), ("b", 2, 3), ("c", 29, 30)]


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_documents(docs, 5).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        groups[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        sizes[texts[r.doc_id]] += r.size
    assert len(rows) == len(texts) and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads.values()) == sorted(lpt_by_heap(sizes.values(), 5))


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.shard)
    assert by[1] == by[6] and len(by[1]) == 1
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {8}
    assert sharding.shard_documents(odd.limit(0), 3).collect() == []


def test_mix_takes_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spans, slots = mixing.mix(docs, shard_blocks=8)
    rows = mixing.taken_words(spans, slots).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    assert all(abs(taken - target) <= 1 and target <= 2 * size for size, taken, target in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(v[0] for v in by.values())) < 1e-6
    assert {r.doc_id: r.taken for r in mixing.taken_words(*mixing.mix(docs)).collect()} == {r.doc_id: r.taken for r in rows}
    # Every output shard draws from every large source.
    assert slots.select("shard").distinct().count() > 1
    assert all((r.first_shard is None) == (r.taken == 0) for r in rows)
    counts = defaultdict(lambda: defaultdict(int))
    for r in slots.collect():
        counts[r.shard][r.skey] += 1
    assert all(sum(c.values()) == 8 for s, c in counts.items() if s < max(counts)) and sorted(counts) == list(range(len(counts)))


def test_mixed_blocks_hold_the_taken_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = mixing.mixed_blocks(docs, shard_blocks=16).collect()
    taken = {r.doc_id: r for r in mixing.taken_words(*mixing.mix(docs)).collect()}
    streams = defaultdict(list)
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        streams[r.source] += [(r.doc_id, w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)]
    starts = {s: {tuple(w for _, w in x[i : i + 256]): i for i in range(0, len(x), 256)} for s, x in streams.items()}
    got = defaultdict(int)
    for b in blocks:
        at = next(i for words, i in starts[b.source].items() if words[: len(b.tokens)] == tuple(b.tokens))
        for d, _ in streams[b.source][at : at + len(b.tokens)]:
            got[d] += 1
    assert {d: n for d, n in got.items() if n} == {d: r.taken for d, r in taken.items() if r.taken}
    assert len({(b.shard, b.pick) for b in blocks}) == len(blocks)


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}
    order = ["a", "b", "c", "d", None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            break
        fixed |= {s: 2.0 * sizes[s] for s in above}
    want = fixed | {s: level * weight[s] for s in free}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == want and [r.source for r in sorted(got, key=lambda r: r.skey)] == order


def test_sharded_rows_keep_their_columns(spark, odd):
    rows = sharding.sharded(odd, 3)
    assert rows.columns == [*(c for c in odd.columns if c != "shard"), "shard"] and rows.count() == len(ODD)
    where = defaultdict(set)
    for r in rows.collect():
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and sharding.sharded(odd.limit(0), 3).collect() == []


def test_mix_of_odd_rows(spark, odd):
    spans, slots = mixing.mix(odd)
    rows = mixing.taken_words(spans, slots).collect()
    assert len(rows) == len(ODD) and sorted(r.size for r in rows) == [0, 0, 0, 2, 3, 3, 3, 30_000]
    assert mixing.taken_words(*mixing.mix(odd.limit(0))).collect() == []
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.where("doc_id = 3").count() == 1


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def least_breaks(masks, longest):
    """For each length, the fewest broken tokens that leave no mask a free window: shortest paths over the last tokens' states."""
    width = max(m[-1] for m in masks)
    looks = [(m[-1] + 1, sum(1 << (m[-1] - o) for o in m)) for m in masks]
    cost = {0: 0}
    for n in range(1, longest + 1):
        ways = {}
        for past, broken in cost.items():
            for bit in (0, 1):
                seen = past << 1 | bit
                if all(n < span or seen & bits for span, bits in looks):
                    key = seen & ((1 << width) - 1)
                    ways[key] = min(ways.get(key, n), broken + bit)
        cost = ways
        yield n, min(cost.values())


def test_masks_hit_whatever_fifth_is_broken():
    for least, most, masks in decontaminate.CLASSES:
        assert all(broken > n // 5 for n, broken in least_breaks(masks, min(most, 80)) if n >= least)


def test_every_offset_of_broken_tokens(spark):
    """Every fifth token replaced, from each offset, and other spreads, amid a document; items of nine tokens too."""
    rng, docs, bench = random.Random(8), [], []
    for n in (5, 9, 10, 12, 15, 20, 21, 40, 60):
        item = [f"i{n}w{j}" for j in range(n)]
        bench.append((n, " ".join(item)))
        spreads = [set(range(o, n, 5)) for o in range(5) if len(range(o, n, 5)) <= n // 5] + [set(rng.sample(range(n), n // 5)) for _ in range(6)]
        for s in spreads:
            words = [f"x{rng.random()}" if j in s else w for j, w in enumerate(item)]
            docs.append((len(docs), " ".join([*(f"b{rng.random()}" for _ in range(30)), *words, *(f"a{rng.random()}" for _ in range(30))]), n))
    bench.append((99, "two words"))
    rows = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_start) for r in decontaminate.find_overlaps(rows, items).collect()}
    assert got == {(d, n, 30) for d, _, n in docs}
    # Blocks of items give the same.
    assert {(r.doc_id, r.item_id, r.doc_start) for r in decontaminate.find_overlaps(rows, items, block_seeds=300).collect()} == got


def test_excerpts_and_put_in_tokens(spark):
    item = [f"w{j}" for j in range(40)]
    docs = [(1, [*item[5:35]]), (2, [*item[:19], "more", *item[19:]]), (3, item[:10]), (4, [*item[:20], *item[21:]]), (5, item[::2])]
    rows = spark.createDataFrame([(d, "start " * 9 + " ".join(w) + " end" * 9) for d, w in docs], "doc_id long, text string")
    got = {r.doc_id: (r.doc_start, r.overlap, r.matched) for r in decontaminate.find_overlaps(rows, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (9, 30, 30), 2: (29, 21, 21), 4: (9, 20, 20)}


def test_overlaps_tolerate_substitutions(spark):
    w = ITEM.split()
    swapped = [*w[:5], "XX", *w[6:17], "YY", *w[18:]]
    docs = [
        (1, f"before it {ITEM} after it"), (2, f"start {' '.join(swapped)} end"), (3, " ".join(w[:9]) + " then other words"), (4, "nothing here " * 50), (5, None), (6, ""), (7, " ".join(w[8:])), (8, ITEM.upper().replace(" ", ",  ")), (None, ITEM), (9, "short item"), (10, "lorem " * 20_000 + ITEM),
    ]
    bench = [(1, ITEM), (2, None), (3, ""), (4, "short item"), (5, ITEM)]
    rows = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string").withColumn("words", F.lit(1))).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, 2, 7, 8, None, 10) for i in (1, 5)} | {(9, 4)}
    assert next(r.matched for r in rows if r.doc_id == 2 and r.item_id == 1) == 22
    plain = spark.createDataFrame([*docs, (None, "clean"), (1, "clean too")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(plain, spark.createDataFrame(bench, "item_id long, text string")).collect()) == ["1", "3", "4", "5", "6", "None"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), empty).collect() == []


def test_overlaps_against_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda df: {r[0]: r[1] for r in df.select(df.columns[0], decontaminate.tokens(F.col("text"))).collect()}
    want = set()
    for d, w in words(docs).items():
        for i, item in words(bench).items():
            at = defaultdict(int)
            spots = defaultdict(list)
            for p, x in enumerate(item):
                spots[x].append(p)
            for q, x in enumerate(w):
                for p in spots.get(x, ()):
                    at[q - p] += 1
            for start in at:
                first, skipped = max(0, start), max(0, -start)
                over = min(len(item) - skipped, len(w) - first)
                same = [item[skipped + j] == w[first + j] for j in range(over)]
                # Of all stretches the one of the highest score, the earlier end, the longer.
                best = max(((3 * sum(same[a:b]) - 2 * (b - a), -b, b - a) for a in range(over) for b in range(a + 1, over + 1) if same[a] and same[b - 1]), default=(0, 0, 0)) if sum(same) >= 5 else (0, 0, 0)
                n = (best[0] + 2 * best[2]) // 3
                if over == len(item) >= 5 and sum(same) >= 0.8 * len(item) or n >= 12 and n >= 0.4 * len(item) and n >= 0.8 * best[2]:
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in want})
