"""Names inside longer names (inventory F7, F8, I2, I6): a join by rare q-grams, verified; no nested loop.

Every whole is indexed by its distinct substrings of one to GRAM characters. A part asks by the one of its
substrings of GRAM characters (its whole self, if shorter) that the fewest wholes hold, so a match is
never lost, a common syllable is never the key where a rarer one is there, and a group of many names is
dealt by its grams over many tasks. What shares a gram is compared exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _windows(text: Column, size: Column) -> Column:
    """Substrings of ``size`` characters; the text must have as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size))


def all_grams(text: Column) -> Column:
    """The distinct substrings of one to GRAM characters; none of an empty or null text."""
    longest = F.least(F.length(text), F.lit(GRAM))
    every = F.flatten(F.transform(F.sequence(F.lit(1), longest), lambda n: _windows(text, n)))
    return F.when(F.length(text) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containing(asked: DataFrame, names: DataFrame, part: str, whole: str, within: Sequence[str] = ()) -> DataFrame:
    """``asked`` joined to the rows of ``names`` whose ``whole`` holds ``part``, both with equal ``within`` columns.

    Other columns of both come along and must differ in name. An empty or null part is in nothing here;
    equal rows of ``asked`` give a pair each. Comparison is by characters: fold case before.
    """
    keys = [*within, "_gram"]
    index = names.select("*", F.explode(all_grams(F.col(whole))).alias("_gram"))
    held = index.groupBy(*keys).agg(F.count("*").alias("_held"))
    ask = asked.where(F.length(part) > 0)
    own = _windows(F.col(part), F.least(F.length(part), F.lit(GRAM)))
    # The rarest gram of each different part; a gram that no whole holds (0) ends the search at once.
    rare = ask.select(*within, part).distinct().select(*within, part, F.explode(F.array_distinct(own)).alias("_gram"))
    rare = rare.join(held, keys, "left").groupBy(*within, part).agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), "_gram")).alias("_rare"))
    rare = rare.where("_rare.n > 0").select(*within, part, F.col("_rare._gram").alias("_gram"))
    met = rare.join(index, keys).where(F.contains(F.col(whole), F.col(part))).drop("_gram")
    return ask.join(met, [*within, part])


def match_entities(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """F7 for a batch: query_id, name, etype of entities whose name or an alias holds the asked text in any case, once each.

    ``asked`` has query_id and text, ``entities`` name, etype and aliases (array). An empty text asks for nothing here.
    """
    ask = asked.select("query_id", F.lower("text").alias("_part"))
    spelt = F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x))))
    names = entities.select("name", "etype", spelt.alias("_whole")).distinct()
    return containing(ask, names, "_part", "_whole").select("query_id", "name", "etype").distinct()


def match_subjects(asked: DataFrame, subjects: DataFrame) -> DataFrame:
    """F8 for a batch: query_id, subject of subjects that equal the asked text, hold it, or lie in it in any case, once each.

    A text of two characters or fewer can't hold a subject, as ``retrieval.subject_matches`` has it; empty
    texts and subjects only match their equals. ``asked`` has query_id and text, ``subjects`` subject.
    """
    ask = asked.select("query_id", F.col("text"), F.lower("text").alias("_asked"))
    have = subjects.select("subject").distinct().withColumn("_subject", F.lower("subject"))
    same = ask.join(have, ask["text"] == have["subject"]).select("query_id", "subject")
    over = containing(ask, have, "_asked", "_subject").select("query_id", "subject")
    # The other way round: each subject is looked up among the asked texts.
    under = containing(have, ask.where(F.char_length("text") > 2), "_subject", "_asked").select("query_id", "subject")
    return same.union(over).union(under).distinct()
