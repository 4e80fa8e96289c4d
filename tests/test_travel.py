"""Validation in one pass, its plan, and names found in names."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import rules
from weftline.operators.containment import containing
from weftline.plans import travel


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def made(spark, sf):
    return travel.tables(spark, sf.replace("sf0.001", "sf0.01"))


def test_every_code_occurs(spark, made):
    issues = rules.validate_plans(made["plans"], travel.trips(made), travel.atlas(made))
    codes = {r.code: r.blocking for r in issues.select("code", "blocking").distinct().collect()}
    assert len(codes) == 41 and [c for c, blocking in codes.items() if not blocking] == ["cost.unknown"]


def test_one_shuffle_of_plans(spark, made):
    """Days are grouped once; whatever else is shuffled is cells, answers and reference tables."""
    plans = spark.createDataFrame(made["plans"].limit(50).collect(), made["plans"].schema).withColumn("marker", F.lit(1))
    text = explained(rules.validate_plans(plans, travel.trips(made), travel.atlas(made)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_names_without_plans_or_cities(spark, made):
    """Empty tables: no plans give plan.empty for every query; no queries give nothing; an empty atlas knows nothing."""
    q, a = travel.trips(made), travel.atlas(made)
    none = rules.validate_plans(made["plans"].limit(0), q, a)
    assert {r.code for r in none.collect()} == {"plan.empty"} and none.count() == q.count()
    assert rules.validate_plans(made["plans"], q.limit(0), a).collect() == []
    bare = type(a)(*(getattr(a, t).limit(0) for t in ("restaurants", "accommodations", "attractions", "flights", "ground", "cities")))
    some = rules.validate_plans(made["plans"].where("query_id = 53"), q.where("query_id = 53"), bare)
    assert {"meal.not_in_graph", "accom.not_in_graph", "attraction.not_in_graph", "route.city_invalid"} <= {r.code for r in some.collect()}


def test_strict_states(spark, made):
    """Every inner city of another state counts when strict."""
    q, a = travel.trips(made), travel.atlas(made)
    plans, three = made["plans"].where("query_id % 53 = 47"), q.where("query_id % 53 = 47").withColumn("dest", F.lit("NOWHERE"))
    count = lambda strict: rules.validate_plans(plans, three, a, strict).where("code = 'route.state'").count()
    assert 0 < count(False) < count(True)


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé漢 "])
def test_containment_equals_loops(spark, alphabet):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    small, large = sorted({(rng.choice("xy"), word(5)) for _ in range(120)}), sorted({(rng.choice("xyz"), word(12)) for _ in range(150)})
    asked = spark.createDataFrame([*small, ("x", None), (None, "a")], "city string, part string")
    names = spark.createDataFrame([*large, ("x", None), (None, "aa")], "city string, whole string")
    got = containing(asked, names, "part", "whole", ["city"])
    assert sorted((r.city, r.part, r.whole) for r in got.collect()) == sorted((c, p, w) for c, p in small for d, w in large if c == d and p and p in w)
    assert "NestedLoop" not in explained(got)
    anywhere = containing(asked.select("part"), names.select("whole"), "part", "whole")
    everyone = [(p, w) for _, p in [*small, ("", "a")] for w in [w for _, w in large] + ["aa"] if p and p in w]
    assert sorted((r.part, r.whole) for r in anywhere.collect()) == sorted(everyone)
    assert containing(asked.limit(0), names, "part", "whole", ["city"]).collect() == containing(asked, names.limit(0), "part", "whole", ["city"]).collect() == []
