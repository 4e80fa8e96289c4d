"""Lexical index and retrieval tools over facts (inventory F).

Tiers (direct hit, synonyms, lexical rank) are computed in one plan with a ``tier`` column, of which the
least stays; ranking windows run only over what a question has matched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dates import date_in_range, relative_date
from weftline.functions.text import any_keyword, has_text, terms
from weftline.operators.core import GraphStore, traverse_relations
from weftline.operators.grading import REFUSAL, REFUSAL_OPENINGS


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, one row for each different term of a document."""
    return docs.select(F.col(key), F.explode(terms(text)).alias("term"))


def idf(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + N / df), twice for single characters and three times for pairs."""
    n = docs.agg(F.count("*").alias("_n"))  # one row, broadcast; nothing runs while the plan is built
    df = posted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    return df.select("term", "df", (F.log(1 + F.col("_n") / F.col("df")) * F.when(F.char_length("term") == 1, 2).otherwise(3)).alias("idf"))


def lexical_scores(posted: DataFrame, weights: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key, score: sum of the idf of shared terms; ``queries`` has query_id and text."""
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    return posted.join(asked.join(weights, "term"), "term").groupBy("query_id", key).agg(F.sum("idf").alias("score"))


def lexical_search(scores: DataFrame, key: str, limit: int = 20, cap: int = 20) -> DataFrame:
    """scores over their maximum, best first, ties by key; never more than ``cap``."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    # The rank is cut first, so that tasks keep few rows of a query before they meet; the best is among them.
    front = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(limit, cap))
    return front.withColumn("relative", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))


def resolve_name(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """add ``resolved``: an exact name, else an alias's name, else the text itself; ``names`` has name."""
    exact = entities.select("name", F.lit(True).alias("_exact")).distinct()
    other = aliases.groupBy(F.col("alias").alias("name")).agg(F.max_by("canonical", "ord").alias("_canonical"))
    joined = names.join(exact, "name", "left").join(other, "name", "left")
    return joined.withColumn("resolved", F.when(F.col("_exact"), F.col("name")).otherwise(F.coalesce("_canonical", "name"))).drop("_exact", "_canonical")


def find_entities(entities: DataFrame, text: str, etype: str = "", limit: int = 30) -> DataFrame:
    """entities whose name or an alias contains the text, of an exact type if given."""
    hit = has_text(F.col("name"), text) | F.exists("aliases", lambda a: has_text(a, text))
    return entities.where(hit & ((F.col("etype") == etype) if etype else F.lit(True))).orderBy("name").limit(limit)


def paged(rows: DataFrame, order: Sequence[Column | str], page: int, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of one page with ``n`` (place) and ``total``; ``by`` pages each group by itself."""
    last = page * size
    if by:
        total = F.count("*").over(Window.partitionBy(*by))
        n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("total", total).withColumn("n", n).where(F.col("n").between(last - size + 1, last))
    # Without groups a top-k keeps the pages so far, and the count is one row: no window spans the table.
    top = rows.orderBy(*order).limit(last).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    return top.where(F.col("n") > last - size).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def subject_matches(subject: Column, asked: str) -> Column:
    """Equal, or one contains the other; the asked name may contain the subject only if it has over two characters."""
    inside = F.contains(F.lit(asked.lower()), F.lower(subject)) if len(asked) > 2 else F.lit(False)
    return F.coalesce((subject == asked) | has_text(subject, asked) | ((subject != "") & inside), F.lit(False))


def least_tier(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Only the rows of the least tier."""
    if by:
        w = Window.partitionBy(*by)
        return rows.withColumn("_least", F.min("tier").over(w)).where("tier = _least").drop("_least")
    least = rows.agg(F.min("tier").alias("_least"))  # one row, broadcast
    return rows.join(F.broadcast(least), F.col("tier") == F.col("_least")).drop("_least")


def facts_by_subject(facts: DataFrame, subject: str, keywords: Sequence[str] = (), synonyms: Mapping[str, Sequence[str]] | None = None, ftype: str = "", low: str | None = None, high: str | None = None, scores: DataFrame | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """F8: facts of a subject by type, date and keywords: direct hits, else synonyms, else lexical rank; paged."""
    mine = facts.where(subject_matches(F.col("subject"), subject) & date_in_range(F.col("date_iso"), low, high) & ((F.col("ftype") == ftype) if ftype else F.lit(True)))
    order = [F.col("date_iso").asc_nulls_last(), "fid"]
    if keywords:
        added = expand(keywords, SYNONYMS if synonyms is None else synonyms)
        tier = F.when(any_keyword(F.col("statement"), keywords), 1).when(any_keyword(F.col("statement"), added), 2)
        if scores is not None:
            mine = mine.join(scores.select("fid", "score"), "fid", "left")
            tier = F.coalesce(tier, F.when(F.col("score") > 0, 3))
            order = [F.col("score").desc_nulls_last(), "fid"]
        mine = least_tier(mine.withColumn("tier", tier).where("tier is not null"))
    return paged(mine, order, page, size)


def exists_fact(facts: DataFrame, subject: str, keywords: Sequence[str]) -> DataFrame:
    """whether a fact of the subject contains a keyword; only direct hits count."""
    hit = subject_matches(F.col("subject"), subject) & any_keyword(F.col("statement"), keywords)
    return facts.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("exists"))


def related_facts(facts: DataFrame, edges: DataFrame, entity: str, page: int = 1, size: int = 20) -> DataFrame:
    """facts with an edge 涉及… or 归属于… to the entity, by fid; paged with the total."""
    hits = edges.where((F.col("dst") == entity) & (F.startswith("relation", F.lit("涉及")) | F.startswith("relation", F.lit("归属于")))).select(F.col("src").alias("fid"))
    return paged(facts.join(hits, "fid", "left_semi"), ["fid"], page, size)


def search_facts(facts: DataFrame, posted: DataFrame, weights: DataFrame, keywords: Sequence[str], synonyms: Mapping[str, Sequence[str]] | None = None, subject: str = "", limit: int = 20) -> DataFrame:
    """lexical search for keywords, with synonyms if that finds nothing; a subject filters unless that empties the result."""
    spark = facts.sparkSession
    asked = [(1, " ".join(keywords)), (2, " ".join([*keywords, *expand(keywords, SYNONYMS if synonyms is None else synonyms)]))]
    found = lexical_search(lexical_scores(posted, weights, spark.createDataFrame(asked, "query_id int, text string"), "fid"), "fid", limit)
    found = least_tier(found.withColumnRenamed("query_id", "tier")).drop("tier").join(facts, "fid")
    if subject:
        found = least_tier(found.withColumn("tier", F.when(subject_matches(F.col("subject"), subject), 1).otherwise(2))).drop("tier")
    return found.orderBy("rank")


def timeline(facts: DataFrame, low: str | None = None, high: str | None = None, subject: str = "", keywords: Sequence[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """dated facts of a subject in an inclusive range, by date and fid.

    With keywords, facts that contain one, or that ``scores`` (fid, score, of the keywords as one text) ranks above 0;
    the best score first, then the earliest date.
    """
    kept = facts.where((F.coalesce("date_iso", F.lit("")) != "") & date_in_range(F.col("date_iso"), low, high))
    if subject:
        kept = kept.where(F.col("subject") == subject)
    if not keywords:
        return kept.orderBy("date_iso", "fid")
    hit = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.coalesce("statement", F.lit("")), k))
    if scores is None:
        return kept.where(hit).orderBy("date_iso", "fid")
    ranked = kept.join(scores.select("fid", "score"), "fid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked.where(hit | (F.col("score") > 0)).orderBy(F.desc(F.round("score", 9)), "date_iso", "fid")


def topic_histogram(rows: DataFrame, topics: Column) -> DataFrame:
    """topics and how many rows have them, commonest first."""
    return rows.select(F.explode(topics).alias("topic")).where("topic != ''").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic")


def facts_by_topic(facts: DataFrame, topic: str, subject: str = "") -> DataFrame:
    """facts whose joined topics contain the text."""
    hit = has_text(F.concat_ws(";", "topics"), topic)
    return facts.where(hit & ((F.col("subject") == subject) if subject else F.lit(True)))


def with_anchor(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """add ``anchor``, the date of the session (session_no, session_date) of a fact's first source; blank if there is none."""
    number = F.regexp_extract(F.coalesce(F.get("sources", F.lit(0)), F.lit("")), r"^D(\d+):", 1).try_cast("int")
    dated = sessions.groupBy(F.col("session_no").alias("_no")).agg(F.max(F.col("session_date").cast("string")).alias("anchor"))
    return facts.withColumn("_no", number).join(dated, "_no", "left").drop("_no").withColumn("anchor", F.coalesce("anchor", F.lit("")))


def fact_line(fid: Column, subject: Column, statement: Column, ftype: Column, day: Column, granularity: Column, raw: Column, sources: Column, anchor: Column) -> Column:
    """one line of text for a fact; a date phrase of its own comes with the day that it counts from."""
    day, granularity, raw, anchor = (F.coalesce(c, F.lit("")) for c in (day, granularity, raw, anchor))
    phrase = F.when(raw != "", F.concat(F.lit("原文:"), raw))
    when = F.when(day != "", F.concat(day, F.lit("("), F.concat_ws("|", granularity, phrase), F.lit(")"))).otherwise(F.coalesce(phrase, F.lit("无日期")))
    base = F.when((raw != "") & (anchor != ""), F.concat(F.lit("锚:"), anchor))
    return F.concat_ws("｜", F.concat(F.lit("["), fid, F.lit("] "), subject), statement, ftype, when, base, F.concat(F.lit("出处:"), F.array_join(sources, ";")))


def rendered(lines: Sequence[str], total: int) -> str:
    """a head with the count, and lines; the head says how to see the rest."""
    more = f"，显示第1-{len(lines)}条，可用 页 参数翻页" if total > len(lines) else ""
    return f"（共{total}条{more}）\n" + ("\n".join(lines) or "（无结果）")


#: Chinese words and their near synonyms.
SYNONYMS = {
    "祖母": ("奶奶",), "奶奶": ("祖母",), "外婆": ("姥姥",), "先生": ("丈夫",), "丈夫": ("先生",), "老公": ("丈夫",), "女儿": ("闺女",), "闺女": ("女儿",), "儿子": ("孩子",),
    "母亲": ("妈妈",), "妈妈": ("母亲",), "父亲": ("爸爸",), "长跑": ("公益跑", "马拉松", "跑步"), "马拉松": ("长跑", "公益跑"), "公益跑": ("长跑", "慈善"), "慈善跑": ("公益跑",),
    "读书": ("阅读", "看书", "读"), "阅读": ("读书", "看书"), "看书": ("读书", "阅读"), "徒步": ("爬山", "远足", "健行"), "远足": ("徒步",), "露营": ("野营",), "野营": ("露营",),
    "陶艺": ("陶罐", "黏土", "陶艺课"), "演唱会": ("音乐会", "演出", "现场"), "音乐会": ("演唱会", "演出"), "演出": ("演唱会", "音乐会", "表演"), "身份": ("跨性别", "转变", "女性"),
    "领域": ("职业", "学业", "专业"), "职业": ("工作", "事业"), "感受": ("觉得", "感到", "开心", "感激"), "挫折": ("受伤", "困难", "失败", "事故"), "乐器": ("吉他", "钢琴", "小提琴", "单簧管"),
    "放松": ("减压", "平静", "解压"), "减压": ("放松", "压力"), "象征": ("代表", "意味着", "寓意"), "计划": ("打算", "想要", "准备"), "书": ("著作", "读"), "著作": ("书",),
    "画": ("绘画", "画作", "作品"), "绘画": ("画", "画作"), "作品": ("画", "陶罐", "碗"),
}


def expand(words: Sequence[str], synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> list[str]:
    """the terms that synonyms add to keywords, in order, each once."""
    return [s for s in dict.fromkeys(s for w in words for s in synonyms.get(w, ())) if s not in words]


def synonym_expand(rows: DataFrame, word: str, synonyms: DataFrame) -> DataFrame:
    """F19 by join: every word and its synonyms (word, synonym), each once for a row's key columns."""
    keys = [c for c in rows.columns if c != word]
    more = rows.join(synonyms.toDF(word, "_synonym"), word).select(*keys, F.col("_synonym").alias(word))
    return rows.select(*keys, word).unionByName(more).distinct()


def enumerate_elements(found: DataFrame, by: Sequence[str], element: str, order: Sequence[str]) -> DataFrame:
    """different elements of each group, each by its first row."""
    w = Window.partitionBy(*by, element).orderBy(*order)
    return found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Question kinds by their marks, the first that fits; categories by their words, 活动 by default.
QUESTION_KINDS = (("列举", "有哪些|哪些|都有什么|什么活动|什么作品|什么书|参加过什么"), ("时间", "什么时候|哪天|哪一年|几月|何时|哪一次"))
CATEGORIES = (("活动", "活动|爱好|运动|兴趣"), ("书", "书|著作|读物"), ("作品", "作品|画|陶罐|碗|创作"), ("宠物", "宠物|猫|狗"))
#: The entity type of each category's elements (活动 for others), the types of facts that may name one, and how much of a statement tells and names it.
CATEGORY_TYPES = {"书": "物品", "作品": "物品", "宠物": "物品"}
ELEMENT_FACTS, TOLD, NAMED = ("事件", "计划"), 12, 20


def enumerate_category(facts: DataFrame, edges: DataFrame, entities: DataFrame, subject: str, category: str = "活动") -> DataFrame:
    """``element`` and its first fact, for all a subject has of a category, by date and fid.

    Elements are entities of the category's type that the subject's facts (or those of a subject whose name holds
    its name) touch, and then events and plans that hold a word of the category, unless they are an entity's first fact.
    """
    etype = CATEGORY_TYPES.get(category, "活动")
    mine = facts.where(F.contains("subject", F.lit(subject)) if subject else F.lit(False))
    named = entities.where(F.col("etype") == etype).select(F.col("name").alias("dst")).where("dst != ''").distinct()
    touched = edges.where(F.col("relation").isin("涉及活动", "涉及物品")).join(named, "dst", "left_semi").select(F.col("src").alias("fid"), F.col("dst").alias("element")).distinct()
    by_entity = enumerate_elements(mine.join(touched, "fid"), [], "element", ["fid"])
    words = dict(CATEGORIES).get(category, category)
    worded = mine.where(F.col("ftype").isin(*ELEMENT_FACTS) & F.exists(F.split(F.lit(words), r"\|"), lambda w: F.contains(F.col("statement"), w)))
    worded = worded.join(by_entity.select("fid"), "fid", "left_anti").withColumn("_told", F.substring("statement", 1, TOLD))
    worded = worded.join(by_entity.select(F.col("element").alias("_told")), "_told", "left_anti")
    by_words = enumerate_elements(worded, [], "_told", ["fid"]).withColumn("element", F.substring("statement", 1, NAMED)).drop("_told")
    return by_entity.unionByName(by_words).orderBy(F.coalesce("date_iso", F.lit("")), "fid", "element")


def question_kind(question: Column) -> Column:
    """列举, 时间 or neither."""
    out = F.lit("")
    for name, form in reversed(QUESTION_KINDS):
        out = F.when(question.rlike(form), name).otherwise(out)
    return out


def infer_category(question: Column) -> Column:
    """a category by keyword, 活动 by default."""
    out = F.lit("活动")
    for name, form in reversed(CATEGORIES):
        out = F.when(question.rlike(form), name).otherwise(out)
    return out


def answer_context(collected: DataFrame, lexical: DataFrame, most: int = 45, more: int = 15) -> DataFrame:
    """the best collected facts (fid, score) and the best lexical ones not among them."""
    top = collected.orderBy(F.desc("score"), "fid").limit(most)
    rest = lexical.join(top.select("fid"), "fid", "left_anti").orderBy(F.desc("score"), "fid").limit(more)
    return top.select("fid", "score").unionByName(rest.select("fid", "score"))


def consensus(votes: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """one of the candidates of each question of ``votes`` (question, ord, answer, norm, refused, evidence: a number).

    Two refusals leave only refusals to choose from. Then the first candidate whose normalised text occurs twice;
    else the one that a model picks (``picks``: question, pick, an ord), if it may be chosen; else a
    non-refusal with most evidence, the first of equals. Returns question, ord, answer, refused, n (candidates alike).
    """
    asked = Window.partitionBy("question")
    pool = votes.withColumn("_refusals", F.count_if("refused").over(asked)).where((F.col("_refusals") < 2) | F.col("refused"))
    pool = pool.withColumn("n", F.count("*").over(Window.partitionBy("question", "norm")))
    pool = pool.join(picks.select("question", "pick"), "question", "left") if picks is not None else pool.withColumn("pick", F.lit(None).cast("int"))
    tier = F.when((F.col("n") > 1) & (F.coalesce("norm", F.lit("")) != ""), 1).when(F.col("ord") == F.col("pick"), 2).when(~F.col("refused"), 3).otherwise(4)
    best = asked.orderBy(tier, F.when(tier > 2, -F.col("evidence")), "ord")
    return pool.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("question", "ord", "answer", "refused", "n")


def people_asked(question: Column, people: Column) -> Column:
    """those of the known people whom a question names, in their order."""
    return F.filter(people, lambda p: (p != "") & F.contains(question, p))


def refusal_recheck(top_score: Column, top_subject: Column, asked: Column) -> Column:
    """whether a refusal is asked again: a top score of 60, or of 110 unless the top fact is about the first person asked for."""
    bound = F.coalesce(F.contains(top_subject, F.get(asked, F.lit(0))), F.lit(False))
    return F.coalesce(top_score >= F.when(bound, 60).otherwise(110), F.lit(False))


def subject_doubt(question: Column, asked: Column, subjects: Column) -> Column:
    """whether evidence is about someone else: one person is asked for, in no list and no yes-or-no question, and no subject holds the name."""
    single = (F.size(asked) == 1) & (question_kind(question) != "列举") & ~F.contains(question, F.lit("吗"))
    return single & ~F.exists(subjects, lambda s: F.contains(F.coalesce(s, F.lit("")), F.get(asked, F.lit(0))))


def gated_answers(rows: DataFrame, retry: Column | None = None, confirmed: Column | None = None) -> DataFrame:
    """answer, evidence and subjects after all gates, and ``refused``.

    ``rows``: question, answer, evidence (ids), subjects (of the evidence), people (known), top_score and top_subject (of
    the question's best fact). A refusal that passes ``refusal_recheck`` becomes ``retry``, a struct of answer, evidence
    and subjects, if that has evidence and isn't a refusal. Any opening of a refusal becomes the standard one, without
    evidence. An answer under ``subject_doubt`` is refused unless ``confirmed``. Without the model's columns refusals and doubts stand.
    """
    asked = people_asked(F.col("question"), F.coalesce("people", F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    refuses = lambda c: F.startswith(F.coalesce(c, F.lit("")), F.lit(REFUSAL))
    kept = F.struct("answer", *(F.coalesce(c, none).alias(c) for c in ("evidence", "subjects")))
    if retry is not None:
        again = refuses(F.col("answer")) & refusal_recheck(F.col("top_score"), F.col("top_subject"), asked) & (F.size(retry["evidence"]) > 0) & ~refuses(retry["answer"])
        kept = F.when(F.coalesce(again, F.lit(False)), retry).otherwise(kept)
    empty = F.struct(F.lit(REFUSAL).alias("answer"), none.alias("evidence"), none.alias("subjects"))
    opening = F.exists(F.array(*map(F.lit, REFUSAL_OPENINGS)), lambda o: F.startswith(F.coalesce("_kept.answer", F.lit("")), o))
    clean = F.when(~refuses(F.col("_kept.answer")) & opening, empty).otherwise(F.col("_kept"))
    doubt = ~refuses(F.col("_kept.answer")) & (F.size("_kept.evidence") > 0) & subject_doubt(F.col("question"), asked, F.col("_kept.subjects"))
    sure = F.lit(False) if confirmed is None else F.coalesce(confirmed, F.lit(False))
    done = rows.withColumn("_kept", kept).withColumn("_kept", clean).withColumn("_kept", F.when(F.coalesce(doubt, F.lit(False)) & ~sure, empty).otherwise(F.col("_kept")))
    return done.withColumns({c: F.col(f"_kept.{c}") for c in ("answer", "evidence", "subjects")}).withColumn("refused", refuses(F.col("answer"))).drop("_kept")


def evidence_ids(line: Column, pool: Column) -> Column:
    """fact ids of an evidence line that are in the pool; null without a line."""
    return F.when(line.isNotNull(), F.array_intersect(F.regexp_extract_all(line, F.lit(r"([A-Za-z0-9_-]+-\d{4,})"), F.lit(1)), pool))


class ToolBox:
    """facts (fid, subject, statement, ftype, date_iso, topics), entities (name, etype, aliases), edges and sessions
    (session_no, session_date) of one conversation, with its lexical index, and the nine tools by name."""

    def __init__(self, facts: DataFrame, entities: DataFrame, edges: DataFrame, sessions: DataFrame | None = None) -> None:
        self.facts, self.edges = facts if sessions is None else with_anchor(facts, sessions), edges
        w = Window.partitionBy("name").orderBy(F.monotonically_increasing_id().desc())
        self.entities = entities.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")  # the last of a name counts
        self.names = self.entities.select("name").union(facts.select(F.col("subject"))).where("name != ''").distinct()
        self.aliases = self.entities.select(F.posexplode("aliases").alias("ord", "alias"), F.col("name").alias("canonical")).where("trim(alias) != ''").withColumn("alias", F.trim("alias"))
        named = edges.where(F.startswith("relation", F.lit("涉及"))).groupBy(F.col("src").alias("fid")).agg(F.array_join(F.array_sort(F.collect_set("dst")), "").alias("_names"))
        texts = facts.join(named, "fid", "left").select("fid", F.concat_ws("", "statement", "subject", F.concat_ws("", "topics"), "_names").alias("text"))
        self.posted = postings(texts, "fid", F.col("text"))
        self.weights = idf(self.posted, texts)
        self.tools = {
            "查找实体": lambda text, etype="": find_entities(self.entities, text, etype),
            "按主体查事实": lambda subject, keywords=(), **k: facts_by_subject(self.facts, self.resolve(subject), keywords, **k),
            "获取相关事实": lambda entity, page=1: related_facts(self.facts, self.edges, self.resolve(entity), page),
            "检索事实": lambda keywords, subject="": search_facts(self.facts, self.posted, self.weights, keywords, subject=self.resolve(subject), limit=25),
            "查询时间线": lambda low=None, high=None, subject="", keywords=(): timeline(self.facts, low, high, self.resolve(subject), keywords, self.scored(keywords) if keywords else None),
            "计算日期": self.compute_date,
            "列出主题": lambda: topic_histogram(self.facts, F.col("topics")),
            "按主题查事实": lambda topic, subject="": facts_by_topic(self.facts, topic, self.resolve(subject)),
            "遍历关系": self.walk,
        }

    def resolve(self, name: str) -> str:
        """a known name or subject as it is, else the name that it is an alias of."""
        if not name:
            return name
        one = self.facts.sparkSession.createDataFrame([(name,)], "name string")
        return resolve_name(one, self.names, self.aliases).first()["resolved"]

    def scored(self, keywords: Sequence[str]) -> DataFrame:
        """fid and score of the keywords as one text."""
        one = self.facts.sparkSession.createDataFrame([(0, " ".join(keywords))], "query_id int, text string")
        return lexical_scores(self.posted, self.weights, one, "fid").select("fid", "score")

    def lines(self, rows: DataFrame, limit: int = 25) -> str:
        """the first rows as text; facts need granularity, date_raw and sources, and the box its sessions."""
        line = fact_line(*(F.col(c) for c in ("fid", "subject", "statement", "ftype", "date_iso", "granularity", "date_raw", "sources", "anchor")))
        return rendered([r[0] for r in rows.select(line).limit(limit).collect()], rows.count())

    def compute_date(self, anchor: str, expression: str) -> DataFrame:
        """the date that an expression means, seen from an ISO anchor."""
        one = self.facts.sparkSession.createDataFrame([(anchor, expression)], "anchor string, expression string")
        return one.select("anchor", "expression", relative_date(F.to_date("anchor"), F.col("expression")).alias("r")).select("anchor", "expression", "r.*")

    def walk(self, start: str, relation: str = "", direction: str = "out", hops: int = 1) -> DataFrame:
        """up to 40 nodes within one or two hops; an empty relation is any."""
        nodes = self.edges.select(F.col("src").alias("__id__")).union(self.edges.select("dst")).distinct().withColumn("__type__", F.lit("node"))
        one = self.facts.sparkSession.createDataFrame([(start,)], "start_id string")
        return traverse_relations(GraphStore({"node": nodes}, self.edges), one, relation or None, direction, min(max(hops, 1), 2)).orderBy("hops", "node_id").limit(40)

    def execute(self, name: str, **arguments) -> list[dict] | str:
        """a tool's rows, or its error as text."""
        if name not in self.tools:
            return f"no tool {name}; there are {', '.join(self.tools)}"
        try:
            return [r.asDict(recursive=True) for r in self.tools[name](**arguments).collect()]
        except Exception as e:  # noqa: BLE001  an agent reads the error
            return f"{name}: {str(e)[:300]}"
