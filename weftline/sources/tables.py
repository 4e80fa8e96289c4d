"""Sources and sinks (inventory D): dictionary tables, chunkers, conversations, JSON lines, padded submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.dates import cn_date, parse_session_datetime

#: Texts that stand for a missing value.
MISSING = ("", "nan", "NaN", "NA", "None", "null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropna(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in any of the columns."""
    for c in columns or rows.columns:
        rows = rows.where(F.col(f"`{c}`").isNotNull() & ~F.trim(F.col(f"`{c}`").cast("string")).isin(*MISSING))
    return rows


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """A CSV with a header, all text, missing values dropped; the schema is given, never inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return dropna(spark.read.csv(path, header=True, sep=separator, schema=schema, quote='"', escape='"'), columns)


def read_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Lines of two fields, cut at the first tab."""
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(F.trim(cut[0]).alias(left), F.trim(cut[1]).alias(right))


QUERY = T.StructType(
    [T.StructField(n, t) for n, t in (("idx", T.LongType()), ("org", T.StringType()), ("dest", T.StringType()), ("days", T.IntegerType()), ("date", T.StringType()), ("people_number", T.IntegerType()), ("local_constraint", T.StringType()), ("budget", T.DoubleType()), ("query", T.StringType()), ("level", T.StringType()), ("visiting_city_number", T.IntegerType()), ("reference_information", T.StringType()))]
)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """D3: travel queries from JSON lines; dates and constraints parsed."""
    raw = spark.read.schema(QUERY).json(path)
    return raw.withColumns({"date": parse_dates(F.col("date")), "local_constraint": parse_literal_map(F.col("local_constraint"))})


def parse_dates(value: Column) -> Column:
    """Dates of a list, a list in text, a list of its characters, or one date; null gives none."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    # A list exploded to characters is a JSON list of single characters; joined, it is the text again.
    chars = F.from_json(F.translate(text, "\n", " "), "array<string>")
    exploded = F.when((F.size(chars) > 1) & F.forall(chars, lambda c: F.char_length(c) <= 1), F.array_join(chars, ""))
    return F.regexp_extract_all(F.coalesce(exploded, text), F.lit(r"(\d{4}-\d{1,2}-\d{1,2})"), F.lit(1))


def parse_literal_map(value: Column) -> Column:
    """A Python dictionary in text as a map of texts; empty if it can't be read."""
    text = F.coalesce(value, F.lit(""))
    for old, new in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false")):
        text = F.regexp_replace(text, old, new)
    loose = {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    return F.coalesce(F.from_json(text, "map<string,string>", loose), F.create_map().cast("map<string,string>"))


#: Table families by the words in a reference section's title; the first that fits counts.
SOURCE_FAMILIES = (("flights", ("flight",)), ("accommodations", ("accommodation", "hotel", "airbnb")), ("restaurants", ("restaurant",)), ("attractions", ("attraction",)))


def match_source(title: Column) -> Column:
    """The family of a reference section, null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(SOURCE_FAMILIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(title), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def greedy_chunks(items: Column, size, most: int, overlap: bool = False) -> Column:
    """Arrays of items, each closed once its size reaches ``most``; with ``overlap`` the next begins with the last item.

    The items of one section or session are folded in order; an item is never cut.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"), F.lit(0).alias("n"), F.lit(False).alias("fresh"))

    def step(acc, item):
        grown = F.concat(acc["open"], F.array(item))
        n = acc["n"] + size(item)
        full = n >= most
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(item) if overlap else empty).otherwise(grown).alias("open"),
            F.when(full, size(item) if overlap else F.lit(0)).otherwise(n).cast("int").alias("n"),
            (~full).alias("fresh"),
        )

    return F.aggregate(items, start, step, lambda acc: F.when(acc["fresh"] & (F.size(acc["open"]) > 0), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def reference_chunks(sections: DataFrame, most: int = 5000) -> DataFrame:
    """Sections (source, text) to (source, seq, header, text): line 1 heads every chunk."""
    lines = F.split("text", "\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    made = sections.select("source", F.element_at(lines, 1).alias("header"), F.posexplode(greedy_chunks(body, lambda x: F.char_length(x) + 1, most)).alias("seq", "rows"))
    return made.select("source", "seq", "header", F.concat_ws("\n", "header", "rows").alias("text"))


def fixed_chunks(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 200) -> DataFrame:
    """Add ``chunk``: blocks of ``size`` rows in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk", F.floor((n - 1) / size).cast("long"))


TURN = "array<struct<speaker:string,dia_id:string,text:string>>"


def load_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of conversation files: sample_id, session_no, session_date, seq, speaker, dia_id, text; empty turns are left out."""
    raw = spark.read.schema("sample_id string, conversation map<string,string>").json(path, multiLine=True)
    entry = raw.select("sample_id", "conversation", F.explode(F.map_entries("conversation")).alias("e")).where(F.col("e.key").rlike(r"^session_\d+$"))
    stamp = F.try_element_at("conversation", F.concat("e.key", F.lit("_date_time")))
    turns = entry.select("sample_id", F.regexp_extract("e.key", r"(\d+)", 1).cast("int").alias("session_no"), stamp.alias("session_date"), F.posexplode(F.from_json("e.value", TURN)).alias("seq", "t"))
    return turns.select("sample_id", "session_no", "session_date", "seq", "t.*").where(F.coalesce(F.trim("text"), F.lit("")) != "")


def load_speakers(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, speaker_a, speaker_b of conversation files."""
    raw = spark.read.schema("sample_id string, conversation map<string,string>").json(path, multiLine=True)
    return raw.select("sample_id", *(F.coalesce(F.try_element_at("conversation", F.lit(c)), F.lit("")).alias(c) for c in ("speaker_a", "speaker_b")))


QA = "array<struct<question:string,category:int,answer:string,adversarial_answer:string,evidence:array<string>>>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of conversation files: sample_id, idx, question, category, answer, adversarial_answer, evidence (empty if none)."""
    raw = spark.read.schema(f"sample_id string, qa {QA}").json(path, multiLine=True)
    asked = raw.select("sample_id", F.posexplode("qa").alias("idx", "q")).select("sample_id", "idx", "q.*")
    return asked.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def _by_speaker(spark: SparkSession, path: str, part: str) -> DataFrame:
    """sample_id, entry, said (speaker to JSON) of a part of conversation files that goes by session."""
    raw = spark.read.schema(f"sample_id string, {part} map<string,map<string,string>>").json(path, multiLine=True)
    return raw.select("sample_id", F.explode(part).alias("entry", "said"))


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, dia_id, subject, statement of bundled observations; items without a text or an id are left out."""
    rows = _by_speaker(spark, path, "observation").select("sample_id", F.explode("said").alias("subject", "items"))
    item = rows.select("sample_id", "subject", F.explode(F.from_json("items", "array<string>")).alias("item")).withColumn("item", F.from_json("item", "array<string>"))
    seen = item.select("sample_id", F.get("item", F.lit(1)).alias("dia_id"), "subject", F.get("item", F.lit(0)).alias("statement"))
    return seen.where((F.coalesce("dia_id", F.lit("")) != "") & (F.coalesce("statement", F.lit("")) != ""))


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, date_iso, subject, statement of bundled event summaries; the date, English or Chinese, is blank if it can't be read."""
    rows = _by_speaker(spark, path, "event_summary")
    stamp = F.try_element_at("said", F.lit("date"))
    dated = rows.withColumn("date_iso", F.coalesce(F.coalesce(parse_session_datetime(stamp), cn_date(stamp)).cast("string"), F.lit("")))
    each = dated.select("sample_id", "date_iso", F.explode("said").alias("subject", "items")).where("subject != 'date'")
    events = each.select("sample_id", "date_iso", "subject", F.explode(F.from_json("items", "array<string>")).alias("statement"))
    return events.where(F.coalesce(F.trim("statement"), F.lit("")) != "")


def session_by_no(turns: DataFrame, session_no: int) -> DataFrame:
    """The turns of one session, in order; none if there is no such session."""
    return turns.where(F.col("session_no") == session_no).orderBy("sample_id", "seq")


def turns_by_dia(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns of the given ids."""
    return turns.join(ids.select("dia_id").distinct(), "dia_id", "left_semi")


def chunk_turns(turns: DataFrame, by: Sequence[str], order: str, text: str, least: int = 6000, most: int = 3000) -> DataFrame:
    """Sessions over ``least`` characters in chunks closed at ``most``, each after the first beginning with the turn before."""
    grouped = turns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("t"), F.sum(F.char_length(text)).alias("n"))
    texts = F.transform("t", lambda x: x[text])
    cut = F.when(F.col("n") > least, greedy_chunks(texts, F.char_length, most, overlap=True)).otherwise(F.array(texts))
    return grouped.select(*by, F.posexplode(cut).alias("seq", "turns"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    rows.write.mode(mode).json(path)


def padded_submission(queries: DataFrame, plans: DataFrame, key: str, plan: str) -> DataFrame:
    """One row for each query, an empty plan where there is none."""
    kind = plans.schema[plan].dataType.simpleString()
    return queries.select(key).join(plans.select(key, plan), key, "left").withColumn(plan, F.coalesce(plan, F.from_json(F.lit("[]"), kind)))


def load_repairs(spark: SparkSession, path: str, conv: str) -> DataFrame:
    """Gold repairs of a conversation; broken lines are skipped, the last of an idx counts."""
    raw = spark.read.schema("conv string, idx int, answer string, adversarial boolean, question string").option("mode", "DROPMALFORMED").json(path)
    ordered = raw.where(F.col("conv") == conv).withColumn("_ord", F.monotonically_increasing_id())
    w = Window.partitionBy("idx").orderBy(F.desc("_ord"))
    return ordered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_ord")
