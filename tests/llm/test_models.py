"""Quality, language-model scores, personal data, secrets and rollups."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import pii, ppm, quality, rollups, secrets

ODD = [(1, "one two three"), (1, "one two three"), (2, None), (None, "x y 12"), (3, ""), (4, " \n "), (5, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("long")})
    return rows.withColumns({c: F.lit("clash") for c in ("score", "held_out", "quality", "x", "spans", "word", "gram", "n", "_row", "rare", "base", "tokens", "sign", "start", "path2")})


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.score_documents(docs, quality.train(docs, labels)).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    assert sum(r.predicted == q for r, q in held) / len(held) >= 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    assert quality.score_documents(odd, model).count() == len(ODD)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    untaught = quality.score_documents(odd, quality.train(odd.limit(0), labels.limit(0)))
    assert {round(r.score, 6) for r in untaught.collect()} == {0.5}
    assert quality.score_documents(odd.limit(0), model).collect() == []


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def trie_of(texts):
    grams, n = ppm.count_grams(texts)
    low, at = np.unique(grams & 0xFFFF, return_inverse=True)
    return grams, n, (low, np.bincount(at, n).astype(np.int64))


def test_trie_equals_plain_ppm_and_sums_to_one():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"abcd \n\xc3\xa9"), rng.integers(0, 60)).tolist()) for _ in range(40)]
    grams, n, low = trie_of(texts)
    whole = ppm.build_trie(grams, n, low)
    plain = ppm.AdaptivePPM()
    for t in texts:
        plain.log10(t)
    asked = [*texts[:4], b"abcz zz", b"", b"\n\n", b"zzzz", b"ab\xc3\xa9q d"]
    want = [plain.log10(t, learn=False) for t in asked]
    assert whole.log10_each(asked) == pytest.approx(want, abs=1e-4)
    for context in (*(int(g) >> 8 for g in rng.choice(grams, 20)), 0x7A7A7A7A, 0x7A7A6162):
        assert (10.0 ** whole.log10_grams((context << 8) + np.arange(256))).sum() == pytest.approx(1, abs=1e-5)
    # Slices by the last two bytes add up to the whole.
    pair = (grams >> 8) & 0xFFFF
    sizes = [(int(p), int((pair == p).sum())) for p in np.unique(pair)]
    total, bounds = np.zeros(len(asked)), ppm.slice_bounds(sizes, 50)
    for first, after in bounds:
        mine, pairs = (pair >= first) & (pair < after), np.arange(1 << 16)
        total += ppm.build_trie(grams[mine], n[mine], low, (pairs >= first) & (pairs < after)).log10_each(asked)
    assert len(bounds) > 3 and total == pytest.approx(want, abs=1e-4)


def test_slices_do_not_change_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    one, many = ({r.doc_id: r.score for r in ppm.score_documents(docs, n).collect()} for n in (1 << 40, 3000))
    assert one == pytest.approx(many, rel=1e-9)


def test_adaptive_model_learns_repeats():
    model = ppm.AdaptivePPM()
    first, second = model.log10(b"the cat sat on the mat. " * 3), model.log10(b"the cat sat on the mat. " * 3)
    assert second > 0.5 * first


def test_base_scores_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    words = {r.doc_id: [*re.findall(rb"[^\x20\x09-\x0d]+", r.text.encode().lower()), None] for r in docs.collect()}
    count = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in words.items():
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0) and r.score < 0


def test_scores_of_odd_rows(spark, odd):
    rows = ppm.score_documents(odd).collect()
    assert len(rows) == len(ODD) and sorted(r.n_tokens for r in rows) == [1, 1, 1, 4, 4, 4, 30_001]
    assert ppm.score_documents(odd.limit(0)).collect() == []


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
TRICKY = ["a@b@c.d", "a@b.c@d.e.f", "@@x@y.z", "mail me: joe.x@ex-am.co.uk, now", "1.2.3.4.5", "300.1.1.1 and 10.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0)30 1234-567", "+1 +12345678901", "x" * 20_000 + "@", "1 " * 5000, "", "é1@ä.de a@b.co"]


def by_pattern(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    if len(text) < 10_000:
        assert pii.base_spans(text) == by_pattern(text)
    else:
        assert pii.base_spans(text) == []


def test_field_on_generated_texts():
    field, hits, wrong, missed = pii.trained_field(), 0, 0, 0
    for text, gold in pii.generated_examples(300, 99):
        found = set()
        for s, e in pii.runs(text):
            bounds, segments = pii.segments(text, s, e)
            found |= {(bounds[a][0], k, bounds[b - 1][1]) for a, b, k in field.decode(len(bounds), segments)}
        hits, wrong, missed = hits + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95


def test_field_decoding_is_the_best_segmentation():
    field = pii.SemiMarkovField()
    field.weights = {"a": 2.0, "b": 1.5, "c": 1.0, "d": -1.0}
    found = [(0, 2, 0, ("a",)), (1, 3, 1, ("b", "c")), (2, 3, 2, ("c",)), (0, 1, 3, ("d",))]

    def best(i):
        return 0.0 if i == 3 else max([best(i + 1), *(field.score(s[3]) + best(s[1]) for s in found if s[0] == i)])

    assert sum(field.score(next(s[3] for s in found if s[:3] == d)) for d in field.decode(3, found)) == best(0) == 3.0
    assert 0 < min(field.expected(3, found)) and max(field.expected(3, found)) < 1


def test_personal_data_of_odd_rows(spark, odd):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    made = pii.find_personal_data(spark.createDataFrame([(1, "call (555) 123-4567 or a@b.co")], "doc_id long, text string")).first()
    assert (made.n_email, made.n_phone, made.n_added) == (1, 0, 1) and made.spans == "phone:5:19,email:23:29"
    assert pii.find_personal_data(odd.limit(0)).collect() == []


def test_forest_on_held_out_findings():
    found = secrets.generated_findings(1000, 4)
    x = np.array([secrets.finding_features(t, s, e, p) for t, s, e, p, _ in found])
    assert ((secrets.trained_forest().score(x) >= 0.5) == np.array([y for *_, y in found])).mean() > 0.93


def test_secrets(spark, odd):
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f'token = "{key}" here', "src/app.py"), (2, f"commit {key} merged", None), (3, "a_very_long_identifier_name_1", None), (4, None, None), (None, f"api_key: {key}", None)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    assert {r.doc_id for r in found} == {1, None} and all(r.end - r.start == 40 == r.length for r in found)
    assert secrets.scan(odd).collect() == [] == secrets.scan(odd.limit(0)).collect()


def test_candidates_begin_at_the_value():
    text = 'API_KEY=ghp_0123456789abcdefghij password: "hunter2!x" see eyJhbGciOiJIUzI1NiJ9x.eyJzdWIiOiIxMjM0In0.abcDEF-123 and path/to/some/module/name.py == done'
    assert [text[a:b] for a, b in secrets.candidates(text)] == ["ghp_0123456789abcdefghij", "hunter2!x", "eyJhbGciOiJIUzI1NiJ9x.eyJzdWIiOiIxMjM0In0.abcDEF-123", "path/to/some/module/name"]


def test_forest_learns_given_findings(spark):
    """Labelled findings decide: here digests after 'secret' are none, and those after 'harmless' are."""
    import random

    rng, found = random.Random(1), []
    for _ in range(400):
        good = rng.random() < 0.5
        front, body = ("order harmless ", "".join(rng.choice("0123456789abcdef") for _ in range(40))) if good else ("my secret = ", "-".join(str(rng.randrange(10**6)) for _ in range(4)))
        found.append((front + body, len(front), len(front) + len(body), None, int(good)))
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(found[300:])], "doc_id long, text string")
    kept = {r.doc_id for r in secrets.scan(rows, forest=secrets.fit_forest(found[:300])).collect()}
    assert kept == {i for i, f in enumerate(found[300:]) if f[4]}


def test_large_ids_beside_null_stay(spark):
    large = (1 << 60) + 1
    rows = spark.createDataFrame([(large, 'password = "aB3$xY9!zQ" a@b.co'), (None, "x"), (large + 2, None)], "doc_id long, text string").coalesce(1)
    ids = {large, None, large + 2}
    assert {r.doc_id for r in pii.find_personal_data(rows).collect()} == ids
    assert {r.doc_id for r in quality.score_documents(rows, quality.AdditiveModel().fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()} == ids
    assert {r.doc_id for r in secrets.scan(rows, threshold=0).collect()} == {large}
    assert {r.doc_id for r in ppm.score_documents(rows).collect()} == ids
    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {r.doc_id for r in pii.find_personal_data(named).collect()} == {str(large), None, str(large + 2)}


def test_base_spans_by_pattern_on_documents(spark, sf):
    """Counts and digests of the base patterns over whole documents."""
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.find_personal_data(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        want = by_pattern(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]


def test_rollup_commits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "d e", "s", "en"), (3, None, None, "de"), (4, "x", "t", None)], "doc_id long, text string, source string, lang string")
    count = lambda rows: rollups.counted(rows, "words@1")
    roll = rollups.TokenRollup(spark, f"file://{tmp_path}/roll")
    totals = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in roll.totals().collect()}
    assert totals() == {}
    assert roll.commit("b1", inserts=count(docs)) and not roll.commit("b1", inserts=count(docs))
    assert totals() == {("s", "en"): (2, 5), (None, "de"): (1, 0), ("t", None): (1, 1)}
    moved = docs.where("doc_id = 2").withColumn("text", F.lit("d e f g")).withColumn("source", F.lit("t"))
    assert roll.commit("b2", revisions=count(moved), deletes=docs.where("doc_id = 4").select("doc_id", F.lit("words@1").alias("tokenizer")))
    assert totals() == {("s", "en"): (1, 3), (None, "de"): (1, 0), ("t", "en"): (1, 4)}
    # A commit that broke off before its deltas were whole doesn't count, and its next try replaces it.
    count(docs).withColumn("sign", F.lit(1)).write.parquet(f"file://{tmp_path}/roll/entries/b3")
    before = totals()
    assert roll.batches() == ["b1", "b2"] and totals() == before
    assert roll.commit("b3", deletes=docs.select("doc_id", F.lit("words@1").alias("tokenizer"))) and totals() == {}
    with pytest.raises(ValueError):
        roll.commit("../x")


def test_byte_pairs_in_pieces_are_the_same(spark):
    encoding = rollups.byte_pair_encoding("byte_bpe_50k", rollups.VOCABULARIES)
    text = "Some words, 123 numbers and it's marks!  And\nlines... " * 4000
    assert len(list(rollups.pieces(text))) > 1 and "".join(rollups.pieces(text)) == text
    assert [t for p in rollups.pieces(text) for t in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
    rows = rollups.counted(spark.createDataFrame([(1, "one two", "s", "en"), (2, None, "s", "en")], "doc_id long, text string, source string, lang string"), "byte_bpe_50k@1").collect()
    assert [r.tokens for r in sorted(rows)] == [2, 0]


def test_rollup_of_text_ids_and_many_copies(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "a b", "s", "en")] * 5 + [(None, "x", "s", "en")] * 3 + [("d2", None, "s", None)], "doc_id string, text string, source string, lang string")
    rollup = rollups.TokenRollup(spark, f"file://{tmp_path}/r", "string")
    assert rollup.commit("a", inserts=rollups.counted(docs, "words@1"))
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "words@1", 8, 13), ("s", None, "words@1", 1, 0)}
    rollup.commit("b", deletes=spark.createDataFrame([("d1", "words@1"), (None, "words@1"), ("none", "words@1")], "doc_id string, tokenizer string"))
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", None, "words@1", 1, 0)}
    assert spark.read.parquet(f"file://{tmp_path}/r/entries/b").count() == 2
    rollup.commit("c", revisions=rollups.counted(docs.where("doc_id = 'd1'").withColumn("source", F.lit("t")), "words@1"))
    assert ("t", "en", "words@1", 5, 10) in {tuple(r) for r in rollup.totals().collect()}
