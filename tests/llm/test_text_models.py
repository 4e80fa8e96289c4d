"""Toxicity, alignment of tokenizers and collocations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import align, collocations, toxicity

ODD = [(1, "a b c a b c."), (1, "a b c a b c."), (2, None), (None, "x y 12"), (3, ""), (4, " \n "), (5, "word " * 30_000), (6, "▁ odd 　 \U0001f600\x00<s> <|endoftext|>"), (2**60, "Big ID, big id")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    return rows.withColumns({c: F.lit("clash") for c in ("score", "held_out", "toxic", "_most", "row", "cols", "vals", "bucket", "links", "pair", "times", "_row", "groups", "n", "a", "b", "w", "word", "pivot", "salt", "phrase", "k", "f", "part")})


# -- toxicity --


def brute_score(model, text):
    """z by the definition: every pair of inputs by itself."""
    words = "".join(c if c.isalnum() or ord(c) > 0xFFFF else " " for c in (text or "").lower()).split()
    buckets = Counter()
    for word in words:
        row, bucket = toxicity.hashed_terms([word])
        assert set(row) <= {0}
        buckets.update(model.slots[bucket].tolist())
    x = {i: np.log2(1 + c) for i, c in buckets.items() if i >= 0}
    z = model.bias + sum(model.weights[i] * v for i, v in x.items())
    z += sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in x for j in x if i < j)
    return 1 / (1 + np.exp(-z))


def test_toxicity_of_held_out_rows_and_brute_force(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    for r in docs.where("doc_id < 150").select("doc_id", "text").collect():
        assert abs(brute_score(model, r.text) - rows[r.doc_id].score) < 1e-9


def test_toxicity_needs_the_pair(spark):
    """An insult or a group alone is harmless; both together are toxic."""
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = list(rng.choice(filler, 30)) + ["vermin"] * insult + ["islanders"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, model).where("held_out").collect()}
    assert np.mean([got[i] == t for i, _, t in labels if i in got]) > 0.98


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score_documents(odd, model).count() == len(ODD)
    untaught = toxicity.score_documents(odd, toxicity.train(odd.limit(0), labels.limit(0)))
    assert {round(r.score, 6) for r in untaught.collect()} == {0.5}
    assert toxicity.score_documents(odd.limit(0), model).collect() == []


def test_terms_are_the_same_in_any_slice():
    texts = ["Ärger über Größe " * 50, "", None, "one two", "x" * 40]
    whole = toxicity.hashed_terms(texts)
    for i, t in enumerate(texts):
        alone = toxicity.hashed_terms([t])
        assert sorted(alone[1]) == sorted(whole[1][whole[0] == i])
    assert [list(range(s.start, s.stop)) for s in toxicity.slices(["a" * 10, "b" * toxicity.CHARS, "", None, "c"])] == [[0], [1], [2, 3, 4]]


# -- alignment --


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.VOCABULARIES}/{align.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{align.VOCABULARIES}/{align.B_FILE}")


def brute_links(rows):
    """Every document by plain loops over every pair of tokens near each other."""
    a, b = libraries()
    letters = align._byte_letters()
    docs = []
    for doc_id, text in rows:
        want = f" {text}".encode() if text else b""
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spell_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(spell_a) != want or b"".join(spell_b) != want:
            ids_a, ids_b, spell_a, spell_b = [], [], [], []
        ends = [list(np.cumsum([len(x) for x in s])) for s in (spell_a, spell_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], Counter(), 0, 0
        for cut in cuts:
            gi, gj = [], []
            while i < len(ids_a) and ends[0][i] <= cut:
                gi.append(i)
                i += 1
            while j < len(ids_b) and ends[1][j] <= cut:
                gj.append(j)
                j += 1
            groups.append(f"{','.join(str(ids_a[x]) for x in gi)}|{','.join(str(ids_b[x]) for x in gj)}")
            span = lambda k, x: (ends[k][x - 1] if x else 0, ends[k][x])
            links.update((ids_a[x], ids_b[y]) for x in gi for y in gj if max(span(0, x)[0], span(1, y)[0]) < min(span(0, x)[1], span(1, y)[1]))
        docs.append((doc_id, len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
    counts = sum((d[4] for d in docs), Counter())
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, groups in docs:
        best = sum(t for p, t in links.items() if counts[p] == top[p[1]])
        out.append((doc_id, n_a, n_b, n_groups, sum(links.values()), best, sum(t * counts[p] for p, t in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return Counter(out)


@pytest.mark.parametrize("head", [0, 50, 300_000])
def test_alignment_equals_brute_force(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in align.linked_documents(docs, head=head).collect()) == brute_links(rows)


def test_alignment_of_odd_rows(spark, odd):
    assert Counter(tuple(r) for r in align.linked_documents(odd).collect()) == brute_links(ODD)
    assert align.linked_documents(odd.limit(0)).collect() == []


def test_both_encoders_of_a_are_one(spark):
    a, _ = libraries()
    fast = align.byte_level(f"{align.VOCABULARIES}/{align.A_FILE}")
    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.choice(np.r_[32:127, 160:400, 0x3040:0x30FF, 0x1F600:0x1F640, 9, 10, 13], 60)) for _ in range(300)]
    assert fast.encode(texts) == [a.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_text_that_isnt_given_back_has_no_tokens():
    made = align.Aligner(align.Encoder(lambda ts: [[0, 1] for _ in ts], [b" ", b"ab"]), align.Encoder(lambda ts: [[0] for _ in ts], [b" ab"]))
    got = made(["ab", "ac", None, "abc", "ab"])
    assert got.n_a.tolist() == [2, 0, 0, 0, 2] and got.n_links.tolist() == [2, 0, 0, 0, 2] and got.groups == ["0,1|0", "", "", "", "0,1|0"]


# -- collocations --


def brute_collocations(rows, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {q for p, b in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * b >= inside * found[q]}
        scored = []
        for p, a in found.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == brute_collocations([(r.lang, r.text) for r in docs.collect()])


def test_collocations_of_repeats_and_hot_pivots(spark):
    """Runs of one word, words that come back inside an n-gram, ties of rarity; pivots dealt over many tasks; buckets that many words share."""
    rng = np.random.default_rng(11)
    rows = [(("en", "de", None)[i % 3], " ".join(rng.choice(list("abcdeABC,"), 60)) + "\tx x x x x x. y z y z y z") for i in range(90)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute_collocations(rows)
    assert any(p == "x x x" for _, _, p, *_ in want)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want
    assert sorted(tuple(r) for r in collocations.collocations(docs, top=5).collect()) == brute_collocations(rows, top=5)
    assert sorted(tuple(r) for r in collocations.collocations(docs, buckets=3, pivot_rows=7).collect()) == want


def test_collocations_of_odd_rows(spark, odd):
    want = brute_collocations([(None, t) for _, t in ODD], least=2)
    assert sorted(tuple(r) for r in collocations.collocations(odd, least=2).collect()) == want and want
    assert collocations.collocations(odd.limit(0)).collect() == []


def test_scores_past_64_bits(spark):
    a, left, right = 9 * 10**13, 9 * 10**13 + 3, 10**14 - 1
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_phrases_of_fragments_in_compiled_code(spark, monkeypatch):
    """All n-grams with the pivot and no other, listed by compiled code (before: by an interpreted lambda)."""
    rows = [("en", 1, 2, 2, "a b p c d", 3), ("en", 1, 1, 1, "b p c", 4), ("en", 1, 0, 1, "p c", 5), ("en", 1, 1, 0, "b p", 6), ("en", 2, 0, 1, "q r", 7), ("en", 4, 0, 1, "q r", 8)]
    plans, staged = [], collocations.staged
    monkeypatch.setattr(collocations, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, name))
    got = collocations.owned_phrases(spark.createDataFrame(rows, "lang string, key long, at int, right int, fragment string, n long"), 1)
    want = {"b p": 13, "p c": 12, "a b p": 3, "b p c": 7, "p c d": 3, "q r": 15}
    assert sorted(map(tuple, got.collect())) == sorted(("en", phrase, a) for phrase, a in want.items())
    assert "lambda" not in plans[0]
