"""Parsers, costs and validation on the itinerary fixture."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import parsing
from weftline.operators import itinerary, rules

PLAN = "query_id int, day int, days int, current_city string, transportation string, breakfast string, attraction string, lunch string, dinner string, accommodation string"
QUERY = "query_id int, org string, dest string, days int, people int, budget double, visiting_city_number int, constraint map<string,string>, cuisines array<string>"
INN = "Budget Inn, Houston"
GOOD = [
    (0, 1, "from Austin to Houston", "Flight Number: F1, from Austin to Houston, Departure Time: 08:00, Arrival Time: 09:00", "-", "Space Center, Houston;", "Sushi Bar, Houston", "Rome's Pizza, Houston", INN),
    (1, 2, "Houston", "-", "Pho Saigon, Houston", "Museum, Houston;", "Pappas BBQ, Houston", "La Balanza, Houston", INN),
    (2, 3, "from Houston to Austin", "Taxi, from Houston to Austin", "-", "-", "-", "Taco Stand, Austin", "-"),
]


@pytest.fixture(scope="module")
def atlas(spark):
    make = spark.createDataFrame
    eats = [("Rome's Pizza", "Houston", "Italian", 20), ("Sushi Bar", "Houston", "Japanese", 30), ("Taco Stand", "Austin", "Mexican", 10), ("Pho Saigon", "Houston", "Vietnamese", 15), ("Pappas BBQ", "Houston", "American BBQ", 25), ("La Balanza", "Houston", "Peruvian", 18)]
    return itinerary.Atlas(
        make([(*r[:3], float(r[3]), i) for i, r in enumerate(eats)], "name string, city string, cuisines string, cost double, ord int"),
        make([("Huge, New and Green Oasis", "Houston", 100.0, "Private room", 2.0, 2.0, "No smoking", 0), ("Budget Inn", "Houston", 40.0, "Entire home/apt", 1.0, 2.0, "", 1)], "name string, city string, price double, room_type string, min_nights double, occupancy double, house_rules string, ord int"),
        make([("Space Center", "Houston", 0), ("Museum", "Houston", 1)], "name string, city string, ord int"),
        make([("F1", "Austin", "Houston", 100.0, 0)], "number string, origin string, dest string, price double, ord int"),
        make([("Houston", "Austin", 150.7, True), ("Austin", "Houston", 150.7, True)], "origin string, dest string, km double, valid boolean"),
        make([("Houston", "Texas", True), ("Austin", "Texas", True)], "name string, state string, covered boolean"),
    )


def batch(spark, cases):
    """Plans and queries of numbered cases (plan, changes to the query)."""
    base = {"org": "Austin", "dest": "Texas", "days": 3, "people": 1, "budget": 100_000.0, "visiting_city_number": 1, "constraint": {}, "cuisines": []}
    plans = spark.createDataFrame([(i, *r) for i, (plan, _) in enumerate(cases) for r in plan], PLAN)
    return plans, spark.createDataFrame([(i, *(base | changes).values()) for i, (_, changes) in enumerate(cases)], QUERY)


def changed(day, **cells):
    names = ("day", "days", "current_city", "transportation", "breakfast", "attraction", "lunch", "dinner", "accommodation")
    return [tuple(cells.get(n, v) if i == day else v for n, v in zip(names, r, strict=True)) for i, r in enumerate(GOOD)]


CASES = [
    (GOOD, {}, set()),
    (changed(1, lunch="Taco Stand, Austin"), {}, {("meal.city_mismatch", 1), ("meal.repeat", 2)}),
    (changed(1, dinner="Sushi Bar, Houston", attraction="Nowhere, Houston;", days=5), {}, {("meal.repeat", 1), ("attraction.not_in_graph", 1), ("days.seq", 1)}),
    (changed(1, accommodation="Huge, New and Green Oasis, Houston"), {}, {("accom.min_nights", 1)}),
    (changed(2, transportation="Self-driving, from Houston to Austin"), {}, {("transport.mixed", None)}),
    (changed(0, transportation="Flight Number: F9, from Austin to Houston"), {}, {("transport.flight_not_in_graph", 0), ("cost.unknown", None)}),
    (changed(1, lunch="-", attraction="Museum, Houston"), {}, {("completeness.meal", 1), ("attraction.format", 1)}),
    (changed(1, current_city="Dallas"), {}, {("route.sequence", None), ("route.city_invalid", 1), ("route.city_count", None), ("meal.city_mismatch", 1), ("attraction.city_mismatch", 1), ("accom.city_mismatch", 1)}),
    (GOOD, {"budget": 50.0}, {("budget.over", None)}),
    (GOOD, {"constraint": {"transportation": "no flight", "room type": "private room", "house rule": "smoking"}, "cuisines": ["Italian", "Greek"]}, {("constraint.transport", 0), ("constraint.room_type", 0), ("constraint.room_type", 1), ("constraint.cuisine", None)}),
    (GOOD[:2], {}, {("days.count", None), ("route.loop", None)}),
    ([], {}, {("plan.empty", None)}),
]


def test_issue_codes(spark, atlas):
    """One batch; a good plan has no issue, and each change brings its own."""
    plans, queries = batch(spark, [(plan, changes) for plan, changes, _ in CASES])
    got = [set() for _ in CASES]
    for r in rules.validate_plans(plans, queries, atlas).collect():
        assert r.blocking == (r.code != "cost.unknown")
        got[r.query_id].add((r.code, r.day))
    assert got == [codes for *_, codes in CASES]


def test_costs(spark, atlas):
    stay = [(0, 1, "from Austin to Houston", "Flight Number: F1, from Austin to Houston", "Rome's Pizza, Houston", "-", "Sushi Bar, Houston", "-", "Huge, New and Green Oasis, Houston")]
    ride = lambda mode: [(0, 1, "from Houston to Austin", f"{mode}, from Houston to Austin", "-", "-", "-", "-", "-")]
    plans, queries = batch(spark, [(stay, {"people": 5, "days": 1}), (ride("Taxi"), {"people": 6, "days": 1}), (ride("Self-driving"), {"people": 6, "days": 1})])
    a, b, c = sorted(itinerary.plan_costs(plans, queries, atlas).collect(), key=lambda r: r.query_id)
    assert (a.flights, a.meals, a.hotels, a.ground, a.unknown, a.total) == (500.0, 250.0, 300.0, 0.0, 0, 1050.0)
    assert (b.ground, c.ground) == (150 * 2, 7 * 2)


def test_parsers(spark):
    def one(expression, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(expression(F.col("v")).alias("o"))
        return [r.o for r in rows.collect()]

    assert one(parsing.place_name, "Huge, New and Green Oasis, Tucson", "x", None) == ["Huge, New and Green Oasis", "-", "-"]
    assert one(parsing.place_city, "Huge, New and Green Oasis, Tucson", "Rome's Pizza, Houston (Texas)") == ["Tucson", "Houston"]
    assert one(parsing.split_attractions, "A, X; B, Y; ", "A, X; B, Y", "", None) == [["A, X", "B, Y"], ["A, X"], [], []]
    assert one(parsing.transport_mode, "Flight by taxi", "self-driving", "Flight", "bus") == ["Taxi", "Self-driving", "Flight", None]
    assert one(parsing.amount, "$1,200.50", "abc", "") == [1200.5, None, None]
    assert one(parsing.scalar_cell, '["A"]', '["a", "b"]', "[]", None, "x") == ["A", "a; b", "-", "-", "x"]
    assert one(parsing.plan_days, 'Final: {"plan": [{"days": 1}]} done', '[{"days": 2}]', "none") == [[{"days": "1"}], [{"days": "2"}], None]


def test_repair_and_downgrade(spark, atlas):
    from weftline.operators import repair

    bad = changed(1, breakfast="Nowhere, Houston", attraction="Space Center, Houston;", accommodation="Huge, New and Green Oasis, Houston")
    plans, queries = batch(spark, [(bad, {}), (GOOD, {"budget": 380.0})])
    fixed = repair.local_repair(plans, queries, atlas).cache()
    codes = {(r.query_id, r.code) for r in rules.validate_plans(fixed, queries, atlas).collect()}
    assert {c for c in codes if c[0] == 0} == set()
    costs = itinerary.plan_costs(plans, queries, atlas).cache()
    dear = {r.query_id: r.total for r in costs.collect()}
    cheaper = repair.budget_downgrade(plans, queries, atlas, costs).cache()
    after = {r.query_id: r.total for r in itinerary.plan_costs(cheaper, queries, atlas).collect()}
    assert after[0] == dear[0] and after[1] <= dear[1]


def test_repair_requests_and_records(spark, atlas):
    from weftline.operators import repair

    plans, queries = batch(spark, [(GOOD, {"constraint": {"room type": "private room"}}), (GOOD, {}), ([], {})])
    issues = spark.createDataFrame([(0, "meal.repeat", 1, "lunch", True), (1, "cost.unknown", None, None, False)], "query_id int, code string, day int, field string, blocking boolean")
    asked = repair.repair_requests(plans, queries, issues).collect()
    assert [r.query_id for r in asked] == [0] and '"room_type":{"required":"Private room"}' in asked[0].constraints and '"cuisine"' not in asked[0].constraints and "Space Center" in asked[0].plan and "meal.repeat" in asked[0].issues
    assert {r.query_idx: [d.days for d in r.plan] for r in repair.plan_records(queries, plans).collect()} == {0: [1, 2, 3], 1: [1, 2, 3], 2: []}


def test_finalised_and_model_repaired(spark, atlas):
    """A model's sound plan replaces a faulty one, an unreadable answer nothing; the greedy steps mend it, too."""
    from weftline.operators import repair

    bad = changed(1, breakfast="Nowhere, Houston", attraction="Space Center, Houston;")
    plans, queries = batch(spark, [(bad, {}), (GOOD, {})])
    good = repair.plan_records(queries, plans).where("query_idx = 1").select(F.to_json("plan")).first()[0]
    answers = spark.createDataFrame([(0, f"Fixed: {good}"), (1, "no plan")], "query_id int, answer string")
    day = lambda p: {r.query_id: (r.breakfast, r.attraction) for r in p.where("day = 1").collect()}
    mended = repair.model_repair(plans, queries, atlas, answers)
    assert mended.count() == 6 and day(mended) == dict.fromkeys((0, 1), (GOOD[1][4], GOOD[1][5]))
    final = day(repair.finalize_plans(plans, queries, atlas))
    assert final[1] == (GOOD[1][4], GOOD[1][5]) and "Nowhere" not in final[0][0]
