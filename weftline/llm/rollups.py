"""Token counts kept as delta-maintained rollups.

A commit turns changes of documents into signed entries: an insert adds its counts, a delete takes
them back, a revision takes the old counts back and adds the new. Entries are summed by source,
language and tokenizer version, and a total is the sum of all commits' deltas, so it never needs the
texts again. A commit writes its entries first and its deltas last; only a commit whose deltas have
Spark's success marker counts. Committing a batch id again changes nothing, and a commit that broke
off is overwritten by the next try.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import ship
from weftline.llm.mixing import WORD

#: Where the public tokenizers' vocabulary files are on driver and executors.
VOCABULARIES = "/opt/tokenizers"
KEYS = ["source", "lang", "tokenizer"]
ENTRY = "source string, lang string, tokenizer string, sign int, tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"

#: The pattern that splits a text before byte pairs are merged.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def byte_pair_encoding(name: str, folder: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(folder, f"{name}.tiktoken").read_bytes().splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A text is encoded in pieces of about this many characters, cut before a space run, which the pattern
#: never merges across; so very long texts need no more memory than short ones.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=[^\s\d'])(?= [^\W\d_])")


def pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        m = _CUT.search(text, start + PIECE)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def counted(docs: DataFrame, tokenizer: str, folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens of ``docs`` (doc_id, text, source, lang).

    ``tokenizer`` is ``name@version``. The name ``words`` counts runs of non-space characters;
    other names are byte-pair vocabularies in ``folder``. A null or empty text has 0 tokens.
    """
    name = tokenizer.partition("@")[0]
    head = ["doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer")]
    if name == "words":
        return docs.select(*head, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    ship(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_pair_encoding(name, folder)
        for part in parts:
            tokens = [sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *KEYS)), pa.array(tokens, pa.int64())], ["doc_id", *KEYS, "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*head, "text").mapInArrow(batches, f"doc_id {kind}, source string, lang string, tokenizer string, tokens long")


class TokenRollup:
    """Totals under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long") -> None:
        """``id_type`` is the type of doc_id in all that is committed."""
        self.spark, self.path = spark, path.rstrip("/")
        self.entry = f"doc_id {id_type}, {ENTRY}"

    def _has(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def batches(self) -> list[str]:
        """Ids of the commits that count, in order."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(n for n in names if self._has(f"{self.path}/deltas/{n}/_SUCCESS"))

    def _read(self, part: str, schema: str, but: str = "") -> DataFrame:
        paths = [f"{self.path}/{part}/{n}" for n in self.batches() if n != but]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """doc_id, source, lang, tokenizer, tokens, copies of the documents counted now."""
        net = self._read("entries", self.entry).groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("copies"))
        return net.where("copies > 0")

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply one batch; False if it had been committed.

        ``inserts`` and ``revisions`` are rows of ``counted``; ``deletes`` has doc_id and tokenizer. A
        revision replaces whatever its (doc_id, tokenizer) counts now, also under another source or
        language, and inserts where there is nothing; equal ids in one batch's revisions all count.
        Deleting what isn't there changes nothing. Null keys are keys like any other.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")
        if self._has(f"{self.path}/deltas/{batch}/_SUCCESS"):
            return False
        columns = ["doc_id", *KEYS, "sign", "tokens"]
        signed = [df.withColumn("sign", F.lit(1)).select(*columns) for df in (inserts, revisions) if df is not None]
        gone = [df.select("doc_id", "tokenizer") for df in (deletes, revisions) if df is not None]
        if gone:
            keys = (gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).distinct().toDF("_doc", "_tokenizer")
            now = self.current()
            old = now.join(keys, now["doc_id"].eqNullSafe(keys["_doc"]) & now["tokenizer"].eqNullSafe(keys["_tokenizer"]), "left_semi")
            # All copies of a document are taken back by one entry.
            signed.append(old.withColumn("sign", (-F.col("copies")).cast("int")).select(*columns))
        entries = signed[0] if signed else self.spark.createDataFrame([], self.entry)
        for more in signed[1:]:
            entries = entries.unionByName(more)
        entries.write.mode("overwrite").parquet(f"{self.path}/entries/{batch}")
        kept = self.spark.read.schema(self.entry).parquet(f"{self.path}/entries/{batch}")
        deltas = kept.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys with no documents left are left out."""
        summed = self._read("deltas", DELTA).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs != 0 or tokens != 0")
