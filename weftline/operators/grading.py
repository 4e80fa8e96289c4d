"""Grading, aggregation, attribution and comparison of runs (inventory H)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dates import answer_digits, normalized_answer, numeral, same_answer
from weftline.functions.text import stripped

#: The standard refusal and openings that count as one.
REFUSAL = "对话中未提及该信息"
REFUSAL_OPENINGS = ("未提及", "没有提到", "未提到", "无法确定", "无法回答", "不能确定", "没有说明", "未说明", "没有相关信息", "对话中没有", "未提供", "没有记录")


def apply_repairs(questions: DataFrame, repairs: DataFrame) -> DataFrame:
    """H1: repaired gold (idx, answer, adversarial, question) over the original; an answerable repair turns category 5 into 4."""
    fix = repairs.select("idx", F.col("answer").alias("_answer"), F.coalesce("adversarial", F.lit(False)).alias("_adversarial"), F.col("question").alias("_question"))
    joined = questions.join(fix, "idx", "left")
    fixed = F.col("_answer").isNotNull() & ~F.col("_adversarial")
    return joined.withColumns(
        {
            "question": F.coalesce("_question", "question"),
            "category": F.when(fixed & (F.col("category") == 5), 4).otherwise(F.col("category")),
            "answer": F.when(F.coalesce("_adversarial", F.lit(False)), F.lit(None)).otherwise(F.coalesce("_answer", "answer")),
        }
    ).drop("_answer", "_adversarial", "_question")


def is_clean_refusal(answer: Column) -> Column:
    """H2: opens as a refusal and has at most four digits after the standard one."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    rest = F.when(F.startswith(text, F.lit(REFUSAL)), F.substr(text, F.lit(len(REFUSAL) + 1))).otherwise("")
    opens = F.startswith(text, F.lit(REFUSAL))
    for o in REFUSAL_OPENINGS:
        opens = opens | F.startswith(text, F.lit(o))
    return opens & (F.regexp_count(rest, F.lit(r"\d")) <= 4)


def _counted_digits(answer: Column) -> Column:
    """Digits of an answer, or of the Chinese numeral that opens it."""
    opening = numeral(F.regexp_extract(stripped(F.coalesce(answer, F.lit(""))), "^([零一二两三四五六七八九十]{1,3})", 1))
    return F.coalesce(F.nullif(answer_digits(answer), F.lit("")), opening.cast("string"), F.lit(""))


def deterministic_grade(rows: DataFrame) -> DataFrame:
    """H3: add ``grade``: exact, wrong or null (for a model); ``rows`` has answer, gold, trap, category.

    A null gold asks for a refusal; the trap's text makes it wrong. Category 5 with a gold needs the gold
    in front; a whole-number gold needs its digits; anything else the sure equivalence of G9.
    """
    norm = rows.withColumns({"_p": normalized_answer("answer"), "_g": normalized_answer("gold"), "_t": normalized_answer("trap"), "_same": same_answer("gold", "answer"), "_digits": _counted_digits(F.col("answer"))})
    asked = F.col("gold").isNull()
    grade = (
        F.when(F.col("answer").isNull(), "wrong")
        .when(asked & (F.col("_t") != "") & F.contains("_p", F.col("_t")), "wrong")
        .when(asked & is_clean_refusal(F.col("answer")), "exact")
        .when(asked, None)
        .when((F.col("category") == 5) & (F.col("_g") != "") & F.startswith("_p", F.col("_g")), "exact")
        .when(F.col("gold").rlike(r"^\d+$") & (F.col("_digits") == F.col("gold")), "exact")
        .when(F.col("_same"), "exact")
    )
    return norm.withColumn("grade", grade).drop("_p", "_g", "_t", "_same", "_digits")


def with_model_grade(rows: DataFrame, grader: Column | None = None) -> DataFrame:
    """H4: a model's grade where the rules give none; what isn't exact, partial or wrong is wrong. ``grader`` is a column or a UDF's call."""
    model = F.lit("wrong") if grader is None else F.when(grader.isin("exact", "partial", "wrong"), grader).otherwise("wrong")
    return rows.withColumn("source", F.when(F.col("grade").isNotNull(), "rules").otherwise("model")).withColumn("grade", F.coalesce("grade", model))


def grade_all(repaired: DataFrame, original: DataFrame) -> DataFrame:
    """H5: grades under both golds, marked by gold_version."""
    return repaired.withColumn("gold_version", F.lit("repaired")).unionByName(original.withColumn("gold_version", F.lit("original")))


def grade_aggregate(graded: DataFrame, category: str, exact: Column, rollup: bool = False) -> DataFrame:
    """H6: n, exact and rate to 4 places by category; with ``rollup`` also over all, category null."""
    grouped = graded.rollup(category) if rollup else graded.groupBy(category)
    n = F.count("*")
    return grouped.agg(n.alias("n"), F.count_if(exact).alias("exact"), F.round(F.count_if(exact) / F.greatest(n, F.lit(1)), 4).alias("rate"))


def lenient_rescore(graded: DataFrame, lenient: str = "lenient_ok") -> DataFrame:
    """H7: strict and lenient rates and how many rows the second look turns."""
    exact = F.col("grade") == "exact"
    ok = exact | F.col(lenient)
    n = F.greatest(F.count("*"), F.lit(1))
    return graded.agg(F.count("*").alias("n"), F.round(F.count_if(exact) / n, 4).alias("strict"), F.round(F.count_if(ok) / n, 4).alias("lenient"), F.count_if(~exact & F.col(lenient)).alias("flips"))


def attribute_failures(failures: DataFrame, facts: DataFrame) -> DataFrame:
    """H8: a label for each failure by what its evidence turned into.

    ``failures``: idx, evidence, collected, cited (arrays), refused. ``facts``: fid, sources. Covered are
    evidence ids that some fact has as a source.
    """
    needed = failures.select("idx", F.explode_outer("evidence").alias("source"))
    sourced = facts.select("fid", F.explode("sources").alias("source"))
    found = needed.join(sourced, "source", "left").groupBy("idx").agg(
        F.array_sort(F.collect_set("source")).alias("needed"), F.array_sort(F.collect_set(F.when(F.col("fid").isNotNull(), F.col("source")))).alias("covered"), F.collect_set("fid").alias("fids")
    )
    joined = failures.join(found, "idx")
    label = (
        F.when(F.size("needed") == 0, "no evidence (adversarial)")
        .when(F.size("covered") == 0, "not extracted (no fact has the evidence)")
        .when(F.size(F.array_intersect("fids", "collected")) == 0, "not retrieved (facts exist)")
        .when(F.col("refused"), "refused (facts were retrieved)")
        .when(F.size(F.array_intersect("fids", "cited")) == 0, "not cited (facts were retrieved)")
        .otherwise("answered wrongly (facts were cited)")
    )
    return joined.select("idx", label.alias("label"), "covered", F.array_except("needed", "covered").alias("missed"))


def attribution_summary(attributed: DataFrame, category: str = "category") -> DataFrame:
    """H9: counts by category and label, the label cut at a parenthesis."""
    label = F.trim(F.split_part("label", F.lit("("), F.lit(1))).alias("label")
    return attributed.groupBy(category, label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category, "label")


def run_diff(a: DataFrame, b: DataFrame, key: str, passed: str) -> DataFrame:
    """Ids of run B that went from pass to fail or back; ids that A lacks count as failed there."""
    old = a.select(key, F.col(passed).alias("_old"))
    both = b.select(key, F.col(passed).alias("_new")).join(old, key, "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    change = F.when(F.col("_old") & ~F.col("_new"), "pass_to_fail").when(~F.col("_old") & F.col("_new"), "fail_to_pass")
    return both.select(key, change.alias("change")).where("change is not null")


def bigram_f1(pairs: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """G11 over folded texts of rows told apart by ``key``: key, f1. Grams are counted by groups, so a long text costs its length and no more."""
    from weftline.functions.text import char_grams

    both = pairs.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("side"), char_grams(F.col(a), 2).alias("grams")), F.struct(F.lit(0).alias("side"), char_grams(F.col(b), 2).alias("grams")))).alias("s"))
    grams = both.select(*key, "s.side", F.explode("s.grams").alias("g")).groupBy(*key, "g").agg(F.sum("side").alias("x"), F.count("*").alias("n"))
    shared = grams.groupBy(*key).agg(F.sum(F.least(F.col("x"), F.col("n") - F.col("x"))).alias("shared"))
    size = lambda c: F.greatest(F.char_length(c) - 1, F.lit(0))
    total = size(a) + size(b)
    f1 = F.when(total == 0, 1.0).otherwise(2.0 * F.coalesce("shared", F.lit(0)) / F.greatest(total, F.lit(1)))
    return pairs.join(shared, list(key), "left").select(*key, f1.alias("f1"))


def sample_disputes(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows in a seeded pseudorandom order."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


#: Hard constraints and the query fields that make them applicable; the cost always is.
HARD_CONSTRAINTS = (("valid_cost", None), ("valid_room_rule", "house rule"), ("valid_cuisine", "cuisine"), ("valid_room_type", "room type"), ("valid_transportation", "transportation"))


def applicable_keys(constraint: Column) -> Column:
    """Names of the hard constraints that a query's constraint map makes applicable."""
    some = lambda k: F.coalesce(F.try_element_at(constraint, F.lit(k)), F.lit("")) != ""
    return F.filter(F.array(*(F.lit(n) if k is None else F.when(some(k), F.lit(n)) for n, k in HARD_CONSTRAINTS)), lambda x: x.isNotNull())


def plan_scores(queries: DataFrame, results: DataFrame, soft: Sequence[str], hard: Sequence[str]) -> DataFrame:
    """Rates over fixed denominators; a query without a result fails all.

    ``queries``: query_id, applicable (array). ``results``: query_id, delivered, one boolean for each soft
    and hard constraint. A hard constraint counts only where it applies, and only once all soft ones pass two gates (H15) upstream.
    """
    joined = queries.join(results, "query_id", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    on = lambda c: F.array_contains("applicable", c)
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    scored = joined.select(
        true("delivered").alias("delivered"), count(true(c) for c in soft).alias("soft"), count(on(c) for c in hard).alias("hard_n"), count(on(c) & true(c) for c in hard).alias("hard"),
    )
    rate = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 4)
    all_soft, all_hard, n = F.col("soft") == len(soft), F.col("hard") == F.col("hard_n"), F.count("*")
    return scored.agg(
        n.alias("n"), rate(F.count_if("delivered"), n).alias("delivery"), rate(F.sum("soft"), n * len(soft)).alias("soft_micro"), rate(F.count_if(all_soft), n).alias("soft_macro"),
        rate(F.sum("hard"), F.sum("hard_n")).alias("hard_micro"), rate(F.count_if(all_hard & F.col("delivered")), n).alias("hard_macro"), rate(F.count_if(F.col("delivered") & all_soft & all_hard), n).alias("final"),
    )


def gate_hard(hard: Column, soft_a: Column, soft_b: Column) -> Column:
    """A hard result only where both gating soft constraints pass."""
    return F.when(soft_a & soft_b, hard)


def pick_better(a: DataFrame, b: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """For each key the run with the greater tuple; ties keep A; ``pick`` says which."""
    x = a.select(key, F.struct(*order).alias("_a"))
    y = b.select(key, F.struct(*order).alias("_b"))
    both = x.join(y, key, "full_outer")
    better = F.col("_a").isNull() | F.coalesce(F.col("_b") > F.col("_a"), F.lit(False))
    return both.select(key, F.when(better, F.lit("B")).otherwise("A").alias("pick"), F.when(better, F.col("_b")).otherwise(F.col("_a")).alias("best")).select(key, "pick", "best.*")


def adopts(old: Column, new: Column, final_old: Column, final_new: Column, blockers_old: Column, blockers_new: Column) -> Column:
    """A strictly greater score tuple, or fewer blockers while no plan is final."""
    return (new > old) | ((final_old == 0) & (final_new == 0) & (blockers_new < blockers_old))


def replay_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocking issues before and after by query: counts, and improved, worse or same; both have query_id, code, blocking."""
    n = lambda df, name: df.where("blocking").groupBy("query_id").agg(F.count("*").alias(name))
    both = n(old, "before").join(n(new, "after"), "query_id", "full_outer").na.fill(0)
    return both.withColumn("change", F.when(F.col("after") < F.col("before"), "improved").when(F.col("after") > F.col("before"), "worse").otherwise("same"))


def pattern_digest(rows: DataFrame, key: Column, value: Column, most: int = 5) -> DataFrame:
    """The commonest values of each key: key, value, n, rn."""
    n = rows.groupBy(key.alias("key"), value.alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def stratified(rows: DataFrame, level: str, shuffled: Column, n: int | None = None) -> DataFrame:
    """Rows taken from the levels in turn, in a hashed order in each; ``turn`` counts the rounds."""
    w = Window.partitionBy(level).orderBy(shuffled)
    out = rows.withColumn("turn", F.row_number().over(w))
    # No level gives more than n of the first n, so each task keeps n of a level before they meet.
    return out.orderBy("turn", level) if n is None else out.where(F.col("turn") <= n).orderBy("turn", level).limit(n)


def partition_rounds(rows: DataFrame, level: str, shuffled: Column, per_round: int = 9, rounds: int = 5) -> DataFrame:
    """Disjoint training rounds of ``per_round`` rows with the levels in turn; ``round`` counts from 0. Fewer rows fill fewer rounds."""
    pool = stratified(rows, level, shuffled, per_round * rounds)  # this bound makes the window below small
    place = F.row_number().over(Window.orderBy("turn", level)) - 1
    return pool.withColumn("round", F.floor(place / per_round).cast("int")).drop("turn")


def route_feedback(items: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Items of the given target kinds, and the others."""
    mine = F.coalesce(F.col("target").isin(list(kinds)), F.lit(False))
    return items.where(mine), items.where(~mine)


def envelope(rows: DataFrame, note: str = "match_note", most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows that answer, at most five suggestions): rows with a match note answer only loosely."""
    loose = F.coalesce(F.col(note), F.lit("")) != ""
    return rows.where(~loose), rows.where(loose).limit(most)


def ledger_summary(calls: DataFrame) -> DataFrame:
    """Calls, cache hits and tokens in all, by model and by namespace, by grouping sets."""
    sets = calls.groupingSets([[], ["model"], ["namespace"]], "model", "namespace")
    return sets.agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.grouping_id().alias("level"))


def text_digest(rows: DataFrame, by: Sequence[str], line: Column, order: Sequence[str], most: int = 20) -> DataFrame:
    """The first lines of each group as one text."""
    w = Window.partitionBy(*by).orderBy(*order)
    some = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).withColumn("_line", line)
    return some.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_line"))), lambda x: x["_line"]), "\n").alias("digest"))
