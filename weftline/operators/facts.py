"""Fact assembly from extracted candidates (inventory E): cleaning, grounding, deduplication, naming, edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dates import weekday_sign
from weftline.functions.text import SPACE, folded, has_text, numbers_grounded, stripped
from weftline.schema import Schema

#: The source-token and date forms, and the granularities.
SOURCE_FORM = r"D\d+:\d+"
DATE_FORM = r"^\d{4}(-\d{2}(-\d{2})?)?(~\d{4}-\d{2}-\d{2})?$"
GRANULARITIES = ("日", "周", "月", "年", "无")
OTHER = "其他"

#: The two forms of an extraction: rows of lists, or objects by name.
FORMS = "e array<string>, r array<string>, entities array<string>, relations array<string>"
MAP = "map<string,string>"


def _own_keys(schema: Schema, part: str) -> Column:
    """A map from each entity type to its key fields, or to its attributes by every name they go by."""
    pairs = []
    for e in schema.entities:
        if part == "key":
            inner = F.array(*map(F.lit, e.primary_key))
        else:
            names = {n: n for n in e.names} | {k: v for k, v in e.aliases.items() if k not in e.names}
            inner = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast(MAP)
        pairs += [F.lit(e.name), inner]
    return F.create_map(*pairs)


def parse_extraction(raw: DataFrame, text: str, schema: Schema) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model output in JSON, with or without a fence and words around it, to (entities, relations, counts).

    Compact form: ``e`` lists [type, key, attributes] and ``r`` [relation, i, j], places among the sound
    entities. Verbose form: ``entities`` (etype, key, properties) and ``relations`` (relation, head and tail
    as [type, key]). Entities: chunk_id, pos, etype, key (key fields only), props (by canonical name).
    Relations: chunk_id, relation, head, tail (places; null where a verbose end is no extracted entity),
    head_type, head_key, tail_type, tail_key. Counts: chunk_id, invalid (unknown types and relations, no key
    field, places out of range, broken items), failed (no JSON object). ``raw`` has chunk_id and ``text``.
    """
    answer = F.coalesce(F.col(text), F.lit(""))
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(answer), r"(?s)(\{.*\})", 1)
    parsed = raw.select("chunk_id", F.json_object_keys(body).alias("fields"), F.from_json(body, FORMS).alias("x"))
    compact = F.array_contains("fields", "e")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    strings = lambda c: F.from_json(c, "array<string>")
    some = lambda c: F.coalesce(c, F.create_map().cast(MAP))
    entity = lambda t, k, p: F.struct(t.alias("etype"), F.from_json(k, MAP).alias("key"), some(F.from_json(p, MAP)).alias("props"))
    item = lambda x, i: F.get(strings(x), F.lit(i))
    found = F.when(compact, F.transform(listed(F.col("x.e")), lambda x: entity(item(x, 0), item(x, 1), item(x, 2)))).otherwise(
        F.transform(listed(F.col("x.entities")), lambda x: entity(*(F.get_json_object(x, f"$.{n}") for n in ("etype", "key", "properties"))))
    )
    keys, names = _own_keys(schema, "key"), _own_keys(schema, "attributes")

    def cleaned(e: Column) -> Column:
        own, known = F.try_element_at(keys, e["etype"]), F.try_element_at(names, e["etype"])
        kept = F.filter(F.map_entries(e["props"]), lambda kv: F.map_contains_key(known, kv["key"]))
        # Of two names of one attribute the later counts, as in a dictionary.
        named = F.transform(kept, lambda kv: F.struct(F.try_element_at(known, kv["key"]).alias("key"), kv["value"].alias("value")))
        last = F.filter(named, lambda kv, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == kv["key"]))
        return F.struct(e["etype"].alias("etype"), F.map_filter(some(e["key"]), lambda k, v: F.coalesce(F.array_contains(own, k), F.lit(False))).alias("key"), F.map_from_entries(last).alias("props"))

    known = [e.name for e in schema.entities]
    sound = F.filter(F.transform(F.filter("found", lambda e: F.coalesce(e["etype"].isin(known) & e["key"].isNotNull(), F.lit(False))), cleaned), lambda e: F.size(e["key"]) > 0)
    made = parsed.withColumn("found", found).withColumn("good", sound)
    sign = lambda t, k: F.concat_ws("|", t, F.to_json(F.array_sort(F.map_entries(k))))
    signs = F.transform("good", lambda e: sign(e["etype"], e["key"]))
    end = lambda i: F.get("good", i)

    def by_place(x: Column) -> Column:
        head, tail = item(x, 1).try_cast("int"), item(x, 2).try_cast("int")
        return F.struct(item(x, 0).alias("relation"), head.alias("head"), tail.alias("tail"), end(head)["etype"].alias("head_type"), end(head)["key"].alias("head_key"), end(tail)["etype"].alias("tail_type"), end(tail)["key"].alias("tail_key"))

    def by_name(x: Column) -> Column:
        side = lambda n: (item(F.get_json_object(x, f"$.{n}"), 0), F.from_json(item(F.get_json_object(x, f"$.{n}"), 1), MAP))
        (ht, hk), (tt, tk) = side("head"), side("tail")
        place = lambda t, k: F.nullif(F.array_position(signs, sign(t, k)), F.lit(0)).cast("int") - 1
        return F.struct(F.get_json_object(x, "$.relation").alias("relation"), place(ht, hk).alias("head"), place(tt, tk).alias("tail"), ht.alias("head_type"), hk.alias("head_key"), tt.alias("tail_type"), tk.alias("tail_key"))

    made = made.withColumn("linked", F.when(compact, F.transform(listed(F.col("x.r")), by_place)).otherwise(F.transform(listed(F.col("x.relations")), by_name)))
    allowed = [r.name for r in schema.relations]
    whole = lambda r: F.coalesce(r["relation"].isin(allowed) & r["head_type"].isin(known) & r["tail_type"].isin(known) & r["head_key"].isNotNull() & r["tail_key"].isNotNull(), F.lit(False))
    made = made.withColumn("links", F.filter("linked", whole))
    entities = made.select("chunk_id", F.posexplode("good").alias("pos", "e")).select("chunk_id", "pos", "e.*")
    relations = made.select("chunk_id", F.explode("links").alias("r")).select("chunk_id", "r.*")
    lost = F.size("found") - F.size("good") + F.size("linked") - F.size("links")
    return entities, relations, made.select("chunk_id", lost.alias("invalid"), F.col("fields").isNull().alias("failed"))


def grounded(key: Column, chunk: Column) -> Column:
    """Every key value that isn't a number occurs verbatim in the chunk, white space collapsed."""
    fold = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")
    return F.forall(F.map_values(key), lambda v: v.isNull() | v.rlike(r"^\s*-?[0-9.]+\s*$") | v.isin("true", "false") | F.contains(fold(chunk), stripped(fold(v))))


def drop_ungrounded(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grounded entities, and relations both of whose ends are grounded in their chunk."""
    kept = entities.join(chunks.select("chunk_id", F.col("text").alias("_chunk")), "chunk_id").where(grounded(F.col("key"), F.col("_chunk"))).drop("_chunk")
    ends = kept.select("chunk_id", "pos")
    for end in ("head", "tail"):
        relations = relations.join(ends.withColumnRenamed("pos", end), ["chunk_id", end], "left_semi")
    return kept, relations


def drop_alarms(total_chunks: Column, dropped_chunks: Column, entities: Column, ungrounded: Column) -> Column:
    """Warnings above 15 % of chunks dropped or 10 % of entities ungrounded."""
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    found = F.array(F.when(ratio(dropped_chunks, total_chunks) > 0.15, F.lit("chunks dropped")), F.when(ratio(ungrounded, entities) > 0.10, F.lit("entities ungrounded")))
    return F.filter(found, lambda x: x.isNotNull())


def norm_facts(facts: DataFrame, types: Sequence[str]) -> DataFrame:
    """E5: facts need subject and statement; unknown types become OTHER; lists are cut; dates and granularities checked."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    date_ = stripped(F.coalesce("date_iso", F.lit("")))
    return facts.where((stripped(F.coalesce("subject", F.lit(""))) != "") & (stripped(F.coalesce("statement", F.lit(""))) != "")).withColumns(
        {
            "ftype": F.when(F.col("ftype").isin(list(types)), F.col("ftype")).otherwise(OTHER),
            "topics": F.slice(F.filter(listed("topics"), lambda x: x != ""), 1, 3),
            "mentions": F.slice(listed("mentions"), 1, 8),
            "sources": F.slice(F.filter(listed("sources"), lambda x: x.rlike(f"^{SOURCE_FORM}$")), 1, 4),
            "date_iso": F.when(date_.rlike(DATE_FORM), date_).otherwise(""),
            "granularity": F.when(F.col("granularity").isin(list(GRANULARITIES)), F.col("granularity")).otherwise("无"),
        }
    )


def ground_facts(facts: DataFrame, blob: str, known_sources: str) -> DataFrame:
    """Facts with a known source and only grounded numbers; an ungrounded date phrase clears the date, an ungrounded value the value."""
    kept = facts.where(F.arrays_overlap("sources", known_sources) & numbers_grounded(F.col("statement"), F.col(blob)))
    has = lambda c: (F.coalesce(F.col(c), F.lit("")) == "") | F.contains(F.col(blob), F.col(c))
    dated = has("date_raw")
    return kept.withColumns(
        {"date_iso": F.when(dated, F.col("date_iso")).otherwise(""), "granularity": F.when(dated, F.col("granularity")).otherwise("无"), "date_raw": F.when(dated, F.col("date_raw")).otherwise(""), "value": F.when(has("value"), F.col("value")).otherwise("")}
    )


def first_by(rows: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fact_dedup(facts: DataFrame, subject: str, statement: str, order: Sequence[str]) -> DataFrame:
    """One fact for each subject and statement without white space; case counts; the first by order stays."""
    return first_by(facts, [folded(F.coalesce(F.col(subject), F.lit(""))), folded(F.coalesce(F.col(statement), F.lit("")))], order)


def filter_session(facts: DataFrame, order: str, etypes: Sequence[str], most: int = 60) -> DataFrame:
    """The first ``most`` facts of each session, then deduplicated; needs session_no, subject, statement."""
    w = Window.partitionBy("session_no").orderBy(order)
    cut = facts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    return first_by(cut, [F.col("session_no"), folded(F.col("subject")), folded(F.col("statement"))], [order]).where(F.lit(not etypes) | F.col("etype").isin(list(etypes)) if "etype" in facts.columns else F.lit(True))


def audit_merge(base: DataFrame, audit: DataFrame) -> DataFrame:
    """Second-pass facts whose folded statement is new."""
    key = folded(F.col("statement")).alias("_k")
    return base.unionByName(audit.withColumn("_k", key).join(base.select(key).distinct(), "_k", "left_anti").drop("_k"))


def canonical_names(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace names by their canonical form (alias, canonical); one hop; identities and repeats don't count."""
    known = aliases.where("alias != canonical").groupBy(F.col("alias").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    joined = rows.join(known, rows[column] == known["_alias"], "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def canonical_lists(rows: DataFrame, column: str, mapping: Column) -> DataFrame:
    """E10 on an array column, by a map column."""
    return rows.withColumn(column, F.transform(column, lambda x: F.coalesce(F.try_element_at(mapping, x), x)))


def sanitised_alias(alias: Column, speakers: Column, canonical: Column) -> Column:
    """Blank if it names a speaker or another canonical entity."""
    return F.when(F.array_contains(speakers, alias) | F.array_contains(canonical, alias), F.lit("")).otherwise(alias)


def fact_ids(facts: DataFrame, conv: str, order: Sequence[str]) -> DataFrame:
    """``fid`` = conversation and a running number of at least four digits."""
    n = F.row_number().over(Window.partitionBy(conv).orderBy(*order))
    return facts.withColumn("fid", F.format_string("%s-%04d", F.col(conv).cast("string"), n))


def entity_rollup(mentions: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Name, first type by ord, sorted different aliases but the name itself; ``mentions`` has name, etype, alias, ord.

    With ``speakers`` (name, identity) each speaker is there as a person, and ``identity`` tells who speaks.
    """
    alias = F.when((F.coalesce("alias", F.lit("")) != "") & (F.col("alias") != F.col("name")), F.col("alias"))
    rolled = mentions.groupBy("name").agg(F.min_by("etype", "ord").alias("etype"), F.array_sort(F.collect_set(alias)).alias("aliases"))
    if speakers is None:
        return rolled
    people = speakers.select("name", F.lit(PERSON).alias("etype"), "identity")
    kept = rolled.join(people, ["name", "etype"], "left")
    added = people.join(rolled, ["name", "etype"], "left_anti").select("name", "etype", F.array().cast("array<string>").alias("aliases"), "identity")
    return kept.unionByName(added)


def speaker_labels(conversations: DataFrame) -> DataFrame:
    """Name and identity of both speakers (speaker_a, speaker_b) of each sample_id."""
    both = F.array(*(F.struct(F.col(c).alias("name"), F.lit(label).alias("identity")) for c, label in (("speaker_a", "说话人甲"), ("speaker_b", "说话人乙"))))
    return conversations.select("sample_id", F.explode(both).alias("s")).select("sample_id", "s.*")


def session_nodes(sessions: DataFrame) -> DataFrame:
    """session_no, ISO date and weekday sign of sessions (session_no, session_date a date); both blank without a date."""
    day = F.col("session_date")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return sessions.select("session_no", blank(day.cast("string")).alias("date_iso"), blank(weekday_sign(day)).alias("weekday")).distinct()


def annotation_facts(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Facts from a corpus's own annotations, to be added with ``unionByName``.

    ``observations`` (dia_id, subject, statement) become background facts of their session, without those whose
    dia_id names no session; ``events`` (date_iso, subject, statement) become events without a session (0).
    """
    texts = F.array().cast("array<string>")
    rest = {"date_raw": F.lit(""), "value": F.lit(""), "topics": texts, "mentions": texts}
    statement, said = F.trim("statement").alias("statement"), F.coalesce(F.trim("statement"), F.lit("")) != ""
    place = F.regexp_extract("dia_id", r"^D(\d+):", 1).try_cast("int")
    seen = observations.where(said & place.isNotNull()).select("subject", statement, F.lit("背景").alias("ftype"), F.lit("").alias("date_iso"), F.lit("无").alias("granularity"), F.array("dia_id").alias("sources"), place.alias("session_no"))
    day = F.coalesce("date_iso", F.lit(""))
    held = events.where(said).select("subject", statement, F.lit("事件").alias("ftype"), day.alias("date_iso"), F.when(day != "", "日").otherwise("无").alias("granularity"), texts.alias("sources"), F.lit(0).alias("session_no"))
    return seen.unionByName(held).withColumns(rest)


#: The type of persons.
PERSON = "人物"
#: Entity types whose mentions make edges 涉及…, and words of a positive preference.
MENTIONED = ("人物", "地点", "组织", "物品", "活动")
LIKES = ("喜欢", "爱", "享受", "热爱", "着迷", "痴迷")


def fact_edges(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Src, relation, dst of facts to topics, known subjects, first sources and mentioned entities, and person likes activity."""
    edge = lambda src, relation, dst: F.struct(src.alias("src"), relation.alias("relation"), dst.alias("dst"))
    lit = F.lit
    topics = facts.select(F.explode(F.transform("topics", lambda t: edge(F.col("fid"), lit("属于主题"), F.concat(lit("topic:"), t)))).alias("e"))
    first = facts.where(F.size("sources") > 0).select(edge(F.col("fid"), lit("记录于"), F.element_at("sources", 1)).alias("e"))
    people = entities.where("etype = '人物'").select(F.col("name").alias("subject"))
    subject = facts.join(people, "subject", "left_semi").select(edge(F.col("fid"), lit("归属于"), F.col("subject")).alias("e"))
    mentioned = facts.select("fid", "subject", "ftype", "statement", F.posexplode("mentions").alias("pos", "name")).join(entities.select("name", "etype"), "name")
    involves = mentioned.where(F.col("etype").isin(*MENTIONED)).select(edge(F.col("fid"), F.concat(lit("涉及"), F.col("etype")), F.col("name")).alias("e"))
    happy = reduce(lambda a, b: a | b, (has_text(F.col("statement"), w) for w in LIKES))
    liked = mentioned.where((F.col("ftype") == "偏好") & (F.col("etype") == "活动") & happy).join(people, "subject", "left_semi").groupBy("fid", "subject").agg(F.min_by("name", "pos").alias("name"))
    liked = liked.select(edge(F.col("subject"), lit("喜爱"), F.col("name")).alias("e"))
    return reduce(DataFrame.union, (topics, first, subject, involves, liked)).select("e.*").distinct()


def entity_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between known, different entities."""
    names = entities.select("name")
    out = relations.where("head != tail").join(names.withColumnRenamed("name", "head"), "head", "left_semi")
    return out.join(names.withColumnRenamed("name", "tail"), "tail", "left_semi")


def override_dates(facts: DataFrame, resolved: Column, granularity: Column) -> DataFrame:
    """A date that the resolver finds replaces the model's."""
    good = F.coalesce(resolved, F.lit("")) != ""
    return facts.withColumns({"date_iso": F.when(good, resolved).otherwise(F.col("date_iso")), "granularity": F.when(good, granularity).otherwise(F.col("granularity"))})


def evidence_coverage(needed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Share of different needed ids that are covered, to 3 places."""
    hit = covered.select(key).distinct().withColumn("_hit", F.lit(1))
    joined = needed.select(key).distinct().join(hit, key, "left")
    return joined.agg(F.count("*").alias("needed"), F.count("_hit").alias("covered"), F.round(F.count("_hit") / F.greatest(F.count("*"), F.lit(1)), 3).alias("coverage"))


def fingerprint(value: Column) -> Column:
    """Eight hex digits of a struct's JSON."""
    return F.substring(F.sha2(F.to_json(value), 256), 1, 8)
