"""The training-data queries that __spark_entry__.py registers, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import align, ann, collocations, decontaminate, mixing, neardup, pii, ppm, quality, rollups, secrets, sharding, toxicity
from weftline.llm.common import shared_dir, table


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def _maintained(spark: SparkSession, sf_dir: str, *tokenizers: str) -> DataFrame:
    """Load all documents under each tokenizer, replay a load, move the documents labelled as poor to a source of their own and delete the toxic ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = rollups.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for tokenizer in (*tokenizers, tokenizers[0]):
        rollup.commit(f"load-{tokenizer.partition('@')[0]}", inserts=rollups.counted(docs, tokenizer))
    # What is counted now moves to its new source; no text is counted again.
    poor = rollup.current().join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").drop("copies")
    rollup.commit("revise-poor", revisions=poor.withColumn("source", F.lit("poor")))
    gone = labels.where("toxic = 1").select("doc_id", F.explode(F.array(*map(F.lit, tokenizers))).alias("tokenizer"))
    rollup.commit("delete-toxic", deletes=gone)
    return rollup.totals()


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maintained(spark, sf_dir, "words@1", "byte_bpe_50k@1")


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can count."""
    return _maintained(spark, sf_dir, "words@1")


def op7_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, slots = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(spans, slots).drop("source")


def op9_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.linked_documents(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_rp_forest": op1_rp_forest,
    "op2_pii_spans": op2_pii_spans,
    "op3_quality_scores": op3_quality_scores,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_lpt_shards": op5_lpt_shards,
    "op6_token_rollup": op6_token_rollup,
    "token_rollup_words": token_rollup_words,
    "op7_secret_findings": op7_secret_findings,
    "op8_source_mix": op8_source_mix,
    "op9_benchmark_overlaps": op9_benchmark_overlaps,
    "op10_ppm_scores": op10_ppm_scores,
    "op11_toxicity": op11_toxicity,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}

#: Streams, blocks, epochs, ranks and the draw of shards by the same rules.
_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS skey FROM s0
), s2 AS (
  SELECT *, CAST([3, 1, 2][CAST(skey % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM s1
), s3 AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS trial
  FROM s2
), s4 AS (
  SELECT source, skey, source_size, least(cap, weight * max(CASE WHEN ratio >= trial THEN trial END) OVER ()) AS target FROM s3
), p AS (
  SELECT d.doc_id, d.size, s4.skey, s4.source_size, s4.target, CAST(round(s4.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY s4.skey ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    row_number() OVER () AS row_id
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
), spans AS (
  SELECT *, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM p WHERE size > 0
), blocks AS (
  SELECT skey, source_size, goal, block, unnest(range(0, (greatest(goal, 1) - 1) // greatest(source_size, 1) + 1)) AS epoch FROM spans WHERE start <= block * 256
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY skey, epoch ORDER BY md5(concat_ws(':', 20240117, epoch, skey, block)), block) - 1 AS rank FROM blocks
), placed AS (
  SELECT *, max(CASE WHEN block = (source_size - 1) // 256 THEN rank END) OVER (PARTITION BY skey, epoch) AS short_rank FROM ranked
), slots AS (
  SELECT skey, block, epoch * ((source_size - 1) // 256 + 1) + rank AS slot, greatest(0, least(256, source_size - block * 256, goal - (epoch * source_size + rank * 256
    - CASE WHEN rank > short_rank THEN ((source_size - 1) // 256 + 1) * 256 - source_size ELSE 0 END))) AS words FROM placed
), used AS (
  SELECT * FROM slots WHERE words > 0
), drawn AS (
  SELECT skey, (row_number() OVER (ORDER BY md5(concat_ws(':', 20240117, 'draw', skey, slot))) - 1) // 256 AS shard FROM used
), counts AS (
  SELECT shard, skey, count(*) AS n FROM drawn GROUP BY ALL
), based AS (
  SELECT *, sum(n) OVER (PARTITION BY skey ORDER BY shard) - n AS base FROM counts
), dealt AS (
  SELECT used.*, shard FROM used JOIN based ON used.skey = based.skey AND slot >= base AND slot < base + n
), met AS (
  SELECT row_id, shard, least(start + size, block * 256 + words) - greatest(start, block * 256) AS n FROM spans JOIN dealt USING (skey, block)
), taken AS (
  SELECT row_id, sum(n) AS taken, min(shard) AS first_shard FROM met WHERE n > 0 GROUP BY row_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_shard AS BIGINT) AS first_shard FROM p LEFT JOIN taken USING (row_id)
"""

#: Final counts of the maintained rollup, computed from the documents at once.
_ROLLUP_SQL = r"""
WITH poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT CASE WHEN doc_id IN (SELECT doc_id FROM poor) THEN 'poor' ELSE source END AS source, lang, 'words@1' AS tokenizer, count(*) AS docs,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toxic) GROUP BY ALL
"""

_WORDS_SQL = r"""list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[[:punct:]\s]+(\s|$)|(^|\s)[[:punct:]\s]+|\s+', ' ', 'g'), ' '), lambda w: w <> '')"""
_MASKS_SQL = {c: [f"concat_ws(' ', {', '.join(f'w[p+{o}]' for o in m)})" for m in masks] for c, (_, _, masks) in enumerate(decontaminate.CLASSES)}


def _seeds_sql(key: str, of: str, c: int) -> str:
    least = decontaminate.CLASSES[c][0]
    of_class = f" AND len(w) BETWEEN {least} AND {decontaminate.CLASSES[c][1]}" if key == "item_id" else ""
    spans = [m[-1] for m in decontaminate.CLASSES[c][2]]
    return " UNION ALL ".join(f"SELECT {key}, p, '{c}{i}' AS m, {k} AS k FROM {of} WHERE p + {spans[i]} <= len(w){of_class}" for i, k in enumerate(_MASKS_SQL[c]))


#: Seeds are joined as text instead of hashes; the best stretch comes from running sums along each diagonal.
_OVERLAP_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
dp AS (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d), ip AS (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM i),
dk AS ({' UNION ALL '.join(_seeds_sql('doc_id', 'dp', c) for c in _MASKS_SQL)}), ik AS ({' UNION ALL '.join(_seeds_sql('item_id', 'ip', c) for c in _MASKS_SQL)}),
diagonal AS (SELECT DISTINCT doc_id, item_id, dk.p - ik.p AS s FROM dk JOIN ik USING (m, k)),
laid AS (SELECT doc_id, item_id, greatest(s, 0) AS a, greatest(-s, 0) AS b, d.w AS dw, i.w AS iw FROM diagonal JOIN d USING (doc_id) JOIN i USING (item_id)),
ranged AS (SELECT *, least(len(iw) - b, len(dw) - a) AS over, len(iw) AS item_words, row_number() OVER () AS x FROM laid),
step AS (SELECT *, unnest(range(1, over + 1)) AS j FROM ranged), agreed AS (SELECT * EXCLUDE (dw, iw), CASE WHEN iw[b + j] = dw[a + j] THEN 1 ELSE 0 END AS hit FROM step),
summed AS (SELECT *, sum(3 * hit - 2) OVER (PARTITION BY x ORDER BY j) AS sums, sum(hit) OVER (PARTITION BY x) AS total FROM agreed),
lows AS (SELECT *, least(0, min(sums) OVER (PARTITION BY x ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM summed),
scored AS (SELECT *, sums - coalesce(low, 0) AS score, row_number() OVER (PARTITION BY x ORDER BY sums - coalesce(low, 0) DESC, j) AS rn FROM lows),
top AS (SELECT * FROM scored WHERE rn = 1),
starts AS (SELECT top.x, coalesce(min(l.j) FILTER (l.sums = top.low AND top.low < 0), 0) AS since FROM top JOIN lows l ON l.x = top.x AND l.j < top.j GROUP BY top.x),
best AS (SELECT top.*, coalesce(since, 0) AS since, j - coalesce(since, 0) AS length FROM top LEFT JOIN starts USING (x)),
counted AS (SELECT *, (score + 2 * length) // 3 AS n, over = item_words AND total >= item_words * 0.8 AS whole FROM best),
good AS (SELECT doc_id, item_id, CASE WHEN whole THEN a ELSE a + since END AS doc_start, CASE WHEN whole THEN over ELSE length END AS overlap, CASE WHEN whole THEN total ELSE n END AS matched, item_words
  FROM counted WHERE whole OR (n >= 12 AND n >= item_words * 0.4 AND n >= length * 0.8)
  UNION ALL SELECT doc_id, item_id, 0, len(w), len(w), len(w) FROM d JOIN i USING (w) WHERE len(w) BETWEEN 1 AND 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_start, overlap) AS rn FROM good)
SELECT doc_id, item_id, CAST(doc_start AS INT) AS doc_start, CAST(overlap AS INT) AS overlap, CAST(matched AS INT) AS matched, CAST(item_words AS INT) AS item_words FROM ranked WHERE rn = 1
"""

#: The heap as a recursion over groups by size; of equal sizes, ranks go to shards in runs.
_SHARD_SQL = """
WITH RECURSIVE r AS (SELECT doc_id, text, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CASE WHEN text IS NULL THEN '6e756c6c' ELSE md5(text) END AS g FROM documents),
g AS (SELECT g, CAST(sum(size) AS BIGINT) AS weight FROM r GROUP BY g),
o AS (SELECT weight, row_number() OVER (ORDER BY weight DESC) AS i FROM g),
lpt AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(range(24), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(0 AS BIGINT) AS weight, 0 AS shard
  UNION ALL SELECT o.i, list_transform(range(1, 25), lambda k: loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN o.weight ELSE 0 END),
    o.weight, list_position(loads, list_min(loads)) - 1 FROM lpt JOIN o ON o.i = lpt.i + 1
),
n AS (SELECT weight, shard, count(*) AS n FROM lpt WHERE i > 0 GROUP BY ALL),
e AS (SELECT weight, shard, sum(n) OVER (PARTITION BY weight ORDER BY shard) - n AS first, sum(n) OVER (PARTITION BY weight ORDER BY shard) AS after FROM n),
k AS (SELECT g, weight, row_number() OVER (PARTITION BY weight ORDER BY g) - 1 AS rank FROM g),
p AS (SELECT g, shard FROM k JOIN e ON k.weight = e.weight AND rank >= first AND rank < after),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], [CAST(x AS BIGINT) for x in range(8)]),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
b AS (SELECT r.*, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM r),
c AS (SELECT b.*, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM b, t)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard FROM c JOIN p USING (g)
"""

#: All n-grams are counted at once; no pivots are needed.
_COLLOCATION_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(s[1:cut], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(s[cut + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM scored),
inner_ AS (SELECT lang, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE first = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op13_collocations": _COLLOCATION_SQL, "op5_lpt_shards": _SHARD_SQL, "op9_benchmark_overlaps": _OVERLAP_SQL, "op8_source_mix": _MIX_SQL, "token_rollup_words": _ROLLUP_SQL}
