"""Plan validation: 41 rules over a batch of itineraries in one pass (inventory 2.10).

Plans are rows (query_id, day from 0, the eight cells); queries have query_id, org, dest, days, people,
budget, visiting_city_number, constraint (map) and cuisines (array). Every rule emits (query_id, code,
day, field, blocking); only cost.unknown doesn't block.

A plan becomes one row: an array of its days and an array of what was looked up for its cells. Cells
that ask for the same thing ask once, each kind of reference table answers by one join, and the rules are
expressions over the two arrays, so the plans themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.parsing import DAY_KEYS, MEALS, filled, first_flight_number, or_empty, place_city, place_name, route_from, route_to, split_attractions, strip_paren, transport_mode
from weftline.functions.text import stripped
from weftline.operators.containment import containing
from weftline.operators.itinerary import Atlas, rooms

#: Room types that a constraint allows.
ROOMS = {"shared room": "Shared room", "private room": "Private room", "entire room": "Entire home/apt"}
ISSUE = "struct<code:string,day:int,field:string,blocking:boolean>"
#: What a reference table may say about a cell.
FACT = {
    "cuisines": "string", "cost": "double", "room_type": "string", "house_rules": "string", "min_nights": "double", "occupancy": "double",
    "origin": "string", "dest": "string", "km": "double", "state": "string", "covered": "boolean",
}


def runs(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Add ``island``: equal neighbouring values of a group share a number."""
    whole, own = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, value).orderBy(*order)
    return rows.withColumn("island", F.row_number().over(whole) - F.row_number().over(own))


def routed(plans: DataFrame) -> DataFrame:
    """Add the day's ends (o, d), whether it moves, its cities and where it lodges."""
    city = F.col("current_city")
    o, d = stripped(strip_paren(route_from(city))), stripped(strip_paren(route_to(city)))
    stay = stripped(strip_paren(stripped(or_empty(city))))
    out = plans.withColumns({"o": o, "d": d, "moving": (o != "") | (d != ""), "stay": stay})
    cities = F.when(F.col("moving"), F.array("o", "d")).otherwise(F.array("stay"))
    return out.withColumns({"cities": F.filter(cities, lambda c: c != ""), "lodging": F.when(F.col("moving"), F.nullif("d", F.lit(""))).otherwise(F.nullif("stay", F.lit("")))})


# -- look-ups --


def _fact(**known: Column) -> Column:
    return F.struct(*(known.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in FACT.items()))


def _asked(days: DataFrame) -> DataFrame:
    """Add ``asks``: an array of (slot, pos, kind, cell, name, city) of a day's cells that reference tables can answer."""
    ask = lambda slot, kind, cell, name, city, pos=None: F.struct(F.lit(slot).alias("slot"), (F.lit(0) if pos is None else pos).cast("int").alias("pos"), F.lit(kind).alias("kind"), cell.alias("cell"), name.alias("name"), city.alias("city"))
    place = lambda slot, kind: F.when(filled(F.col(slot)), ask(slot, kind, F.col(slot), place_name(F.col(slot)), place_city(F.col(slot))))
    t, c, none = F.col("transportation"), F.col("current_city"), F.lit("")
    own = (route_from(t) != "") & (route_to(t) != "")
    end = lambda get: stripped(strip_paren(F.when(own, get(t)).otherwise(get(c))))
    going = filled(t)
    days = days.withColumns({"mode": F.when(going, transport_mode(t)), "from_": F.when(going, end(route_from)), "to_": F.when(going, end(route_to)), "going": going})
    single = [place(m, "restaurant") for m in MEALS] + [
        place("accommodation", "accommodation"),
        F.when(F.col("mode") == "Flight", ask("flight", "flight", t, F.coalesce(first_flight_number(t), none), none)),
        F.when(F.col("mode").isin("Taxi", "Self-driving"), ask("drive", "ground", t, F.col("o"), F.col("d"))),
        F.when(F.col("mode").isin("Taxi", "Self-driving"), ask("leg", "ground", t, F.col("from_"), F.col("to_"))),
    ]
    sights = F.when(filled(F.col("attraction")), F.transform(split_attractions(F.col("attraction")), lambda x, i: ask("sight", "attraction", x, place_name(x), place_city(x), i)))
    stops = F.transform("cities", lambda x, i: ask("city", "city", x, x, none, i))
    none_yet = F.array().cast("array<struct<slot:string,pos:int,kind:string,cell:string,name:string,city:string>>")
    return days.withColumn("asks", F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), F.coalesce(sights, none_yet), F.coalesce(stops, none_yet)))


def _answers(asked: DataFrame, atlas: Atlas) -> DataFrame:
    """kind, name, city, fact of the different (kind, name, city) that a reference table knows."""
    eat = atlas.restaurants.select(F.lit("restaurant").alias("kind"), "name", "city", "ord", _fact(cuisines=F.col("cuisines"), cost=F.col("cost")).alias("fact"))
    bed = _fact(cost=F.col("price"), room_type=F.col("room_type"), house_rules=F.col("house_rules"), min_nights=F.col("min_nights"), occupancy=F.col("occupancy"))
    sleep = atlas.accommodations.select(F.lit("accommodation").alias("kind"), "name", "city", "ord", bed.alias("fact"))
    see = atlas.attractions.select(F.lit("attraction").alias("kind"), "name", "city", "ord", _fact().alias("fact"))
    places = eat.union(sleep).union(see).toDF("kind", "_name", "_city", "ord", "fact")
    ask = asked.where(F.col("kind").isin("restaurant", "accommodation", "attraction") & ~F.col("name").isin("-", "") & (F.col("city") != "-"))
    ask = ask.withColumns({"_part": F.lower("name"), "_in": F.lower("city")})
    # An equal name and city in any case, the last such row; else the first row of the very city whose name holds the asked one.
    exact = places.groupBy("kind", F.lower("_name").alias("_part"), F.lower("_city").alias("_in")).agg(F.max_by("fact", "ord").alias("fact"))
    met = ask.join(exact, ["kind", "_part", "_in"], "left")
    rest = met.where("fact is null").select("kind", "name", "city", "_part")
    inside = containing(rest, places.select("kind", F.col("_city").alias("city"), F.lower("_name").alias("_whole"), "ord", "fact"), "_part", "_whole", ["kind", "city"])
    placed = met.where("fact is not null").select("kind", "name", "city", "fact").union(inside.groupBy("kind", "name", "city").agg(F.min_by("fact", "ord").alias("fact")))
    flown = atlas.flights.groupBy(F.col("number").alias("name")).agg(F.min_by(_fact(origin=F.col("origin"), dest=F.col("dest"), cost=F.col("price")), "ord").alias("fact"))
    flown = flown.select(F.lit("flight").alias("kind"), "name", F.lit("").alias("city"), "fact")
    driven = atlas.ground.where("valid").select(F.lit("ground").alias("kind"), F.col("origin").alias("name"), F.col("dest").alias("city"), _fact(km=F.col("km")).alias("fact"))
    known = atlas.cities.groupBy("name").agg(F.max(_fact(state=F.col("state"), covered=F.col("covered"))).alias("fact"))
    known = known.select(F.lit("city").alias("kind"), "name", F.lit("").alias("city"), "fact")
    return placed.union(asked.join(flown.union(driven).union(known), ["kind", "name", "city"]).select("kind", "name", "city", "fact"))


def assembled(plans: DataFrame, queries: DataFrame, atlas: Atlas) -> DataFrame:
    """Queries' columns (days as ``_days``), n (rows of the plan, null if it has none), ``x`` (its days in order) and ``a`` (answers by day, meal and place: day, meal, slot, pos, cell, name, city, fact)."""
    q = queries.withColumnRenamed("days", "_days")
    cells = ["query_id", "day", *DAY_KEYS]
    days = _asked(routed(plans.select(*cells).join(q.select("query_id", "_days"), "query_id")))
    day = F.struct("day", *DAY_KEYS, "o", "d", "moving", "cities", "lodging", "mode", "from_", "to_", "going", "asks")
    whole = days.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("day") < F.col("_days"), day))).alias("x"))
    asks = whole.select("query_id", F.explode("x").alias("t")).select("query_id", F.col("t.day").alias("day"), F.inline("t.asks"))
    found = _answers(asks.select("kind", "name", "city").distinct(), atlas)
    meal = F.array_position(F.array(*map(F.lit, MEALS)), F.col("slot")).alias("meal")
    answers = F.array_sort(F.collect_list(F.struct("day", meal, "slot", "pos", "cell", "name", "city", "fact")))
    told = asks.join(found, ["kind", "name", "city"], "left").groupBy("query_id").agg(answers.alias("a"))
    bare = F.transform("x", lambda t: t.dropFields("asks")).alias("x")
    out = q.join(whole.select("query_id", "n", bare), "query_id", "left").join(told, "query_id", "left")
    return out.withColumn("a", F.coalesce("a", F.array().cast(told.schema["a"].dataType)))


# -- rules --


def _issue(code: str, day: Column | None = None, field: str | Column | None = None, blocking: bool = True) -> Column:
    text = field if isinstance(field, Column) else F.lit(field).cast("string")
    return F.struct(F.lit(code).alias("code"), (F.lit(None) if day is None else day).cast("int").alias("day"), text.alias("field"), F.lit(blocking).alias("blocking")).cast(ISSUE)


def _if(test: Column, code: str, blocking: bool = True) -> Column:
    """An array of one issue of the plan, or none."""
    return F.when(test, F.array(_issue(code, blocking=blocking)))


def _of(rows: Column, test, code: str, field: str | Column | None = None, day=lambda t: t["day"]) -> Column:
    """An issue for each element of ``rows`` that meets ``test``."""
    return F.transform(F.filter(rows, test), lambda t: _issue(code, day(t), field(t) if callable(field) else field))


def _repeats(rows: Column, key) -> Column:
    """The elements whose ``key`` an earlier element has."""
    keys = F.transform(rows, key)
    return F.filter(rows, lambda t, i: F.array_position(keys, key(t)) != i + 1)


def _islands(values: Column) -> Column:
    """(start, length) of the runs of equal neighbours; starts count from 0."""
    n = F.size(values)
    spots = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | ~F.get(values, i).eqNullSafe(F.get(values, i - 1))))
    return F.transform(spots, lambda s, j: F.struct(s.alias("start"), (F.coalesce(F.get(spots, j + 1), n) - s).alias("length")))


def _day_rules(x: Column) -> list[Column]:
    """Rules that a day's own cells decide."""
    city, trip = (lambda t: or_empty(t["current_city"])), (lambda t: t["transportation"])
    lacks = lambda t: reduce(lambda a, b: a | b, (t[k].isNull() for k in DAY_KEYS))
    looks = lambda t: F.contains(city(t), F.lit("from ")) | F.contains(city(t), F.lit(" to "))
    idle = lambda t: F.size(t["cities"]) < 2
    ban = F.try_element_at("constraint", F.lit("transportation"))
    banned = lambda t: F.coalesce(((ban == "no flight") & F.contains(trip(t), F.lit("Flight"))) | ((ban == "no self-driving") & F.contains(trip(t), F.lit("Self-driving"))), F.lit(False))
    move, see, bed = "transportation", "attraction", "accommodation"
    return [
        _of(x, lambda t: ~t["days"].eqNullSafe(t["day"] + 1), "days.seq", "days"),
        _of(x, lacks, "day.keys"),
        _of(x, lambda t: ~lacks(t) & ~t["moving"] & looks(t), "current_city.malformed", "current_city"),
        _of(x, lambda t: ~lacks(t) & ~t["moving"] & (stripped(city(t)) == ""), "current_city.empty", "current_city"),
        _of(x, lambda t: t["going"] & t["mode"].isNull(), "transport.template", move),
        _of(x, lambda t: ~t["going"] & t["moving"], "transport.missing", move),
        _of(x, lambda t: t["going"] & banned(t), "constraint.transport", move),
        F.flatten(F.transform(x, lambda t: F.transform(F.filter(t["cities"], lambda c: t["going"] & ~F.contains(trip(t), c)), lambda c: _issue("transport.endpoint_mismatch", t["day"], move)))),
        *(_missing_meal(x, m, idle) for m in MEALS),
        _of(x, lambda t: ~filled(t[see]) & idle(t), "completeness.attraction", see),
        _of(x, lambda t: filled(t[see]) & ~F.endswith(stripped(or_empty(t[see])), F.lit(";")), "attraction.format", see),
        _of(x, lambda t: ~filled(t[bed]) & (t["day"] != F.col("_days") - 1), "completeness.accommodation", bed),
        _of(x, lambda t: filled(t[bed]) & t["lodging"].isNotNull() & ~F.contains(t[bed], t["lodging"]), "accom.city_mismatch", bed),
    ]


def _missing_meal(x: Column, meal: str, idle) -> Column:
    return _of(x, lambda t: ~filled(t[meal]) & idle(t), "completeness.meal", meal)


def _route_rules(x: Column, a: Column, strict: bool) -> list[Column]:
    """Rules over the plan's list of cities, two for a moving day."""
    none = F.array().cast("array<string>")
    stops = F.col("stops")
    n, last = F.size(stops), F.size(stops) - 1
    first = F.get(F.filter(x, lambda t: t["day"] == 0), F.lit(0))
    start = F.when(first["moving"], first["o"])
    blocks = _islands(stops)
    inner = lambda s: (s > 0) & (s < last)
    alone = lambda b: (b["length"] == 1) & inner(b["start"])
    back = lambda b: inner(b["start"]) & (F.array_position(stops, F.get(stops, b["start"])) - 1 < b["start"])
    spots = F.filter(F.transform(stops, lambda c, j: F.struct(c.alias("c"), j.alias("j"), F.get(F.filter(a, lambda t: (t["slot"] == "city") & (t["cell"] == c)), F.lit(0))["fact"].alias("fact"))), lambda s: s["c"] != "")
    away = F.filter(spots, lambda s: (F.col("_days") > 3) & inner(s["j"]) & (F.coalesce(s["fact"]["state"], F.lit("")) != "") & (s["fact"]["state"] != F.col("dest")))
    half = lambda s: F.floor(s["j"] / 2)
    yes = lambda s: F.lit(True)
    others = F.array_remove(F.array_distinct(F.array_remove(F.coalesce(stops, none), "")), F.col("org"))
    return [
        _if((n >= 2) & ~F.coalesce(start == F.col("org"), F.lit(False)), "route.start"),
        _if((n >= 2) & (F.get(stops, F.lit(0)) != F.get(stops, last)), "route.loop"),
        _if((n < 3) | F.exists(blocks, lambda b: alone(b) | back(b)), "route.sequence"),
        _of(spots, lambda s: s["fact"].isNull(), "route.city_invalid", day=half),
        _of(away if strict else F.slice(away, 1, 1), yes, "route.state", day=half),
        _of(spots, lambda s: inner(s["j"]) & ~F.coalesce(s["fact"]["covered"], F.lit(True)), "city.uncovered", day=half),
        _if(F.size(others) != F.col("visiting_city_number"), "route.city_count"),
    ]


def _answer_rules(x: Column, a: Column) -> list[Column]:
    """Rules that reference tables decide."""
    named = lambda t: (t["name"] != "-") & (t["city"] != "-")
    lost = lambda t: t["fact"].isNull()
    cities = lambda t: F.get(F.filter(x, lambda y: y["day"] == t["day"]), F.lit(0))["cities"]
    elsewhere = lambda t: ~F.exists(cities(t), lambda c: F.contains(t["cell"], c))
    slot = lambda *names: F.filter(a, lambda t: t["slot"].isin(*names))
    place, move, see, bed = (lambda t: t["slot"]), "transportation", "attraction", "accommodation"
    # Meals: one place a cell; each restaurant once; every wanted cuisine away from home.
    meals = slot(*MEALS)
    single = F.filter(meals, lambda t: ~F.contains(t["cell"], F.lit(";")))
    served = F.filter(single, lambda t: named(t) & ~lost(t))
    tasted = F.filter(served, lambda t: t["city"] != F.col("org"))
    wanted = F.filter(F.coalesce("cuisines", F.array().cast("array<string>")), lambda c: ~F.exists(tasted, lambda t: F.coalesce(F.contains(t["fact"]["cuisines"], c), F.lit(False))))
    sights = slot("sight")
    good = F.filter(sights, named)
    # Lodging: what the query asks of a room; each stay as long as the place wants.
    beds = slot(bed)
    known = F.filter(beds, lambda t: ~lost(t))
    want, rule = F.try_element_at("constraint", F.lit("room type")), F.try_element_at("constraint", F.lit("house rule"))
    allowed = F.create_map(*(F.lit(v) for kv in ROOMS.items() for v in kv))
    room = lambda t: F.coalesce(t["fact"]["room_type"], F.lit(""))
    wrong = lambda t: F.coalesce(((want == "not shared room") & (room(t) == "Shared room")) | (room(t) != F.try_element_at(allowed, want)), F.lit(False))
    broken = lambda t: F.coalesce(F.contains(F.coalesce(t["fact"]["house_rules"], F.lit("")), F.concat(F.lit("No "), rule)), F.lit(False))
    nights = F.transform(x, lambda t: F.coalesce(t[bed], F.lit("-")))
    stays = F.transform(_islands(nights), lambda b: F.struct(F.get(x, b["start"])["day"].alias("day"), b["length"].alias("length")))
    least = lambda b: F.floor(F.coalesce(F.get(F.filter(known, lambda t: t["day"] == b["day"]), F.lit(0))["fact"]["min_nights"], F.lit(0.0)))
    # Transport: a flight as the table has it, a road that can be driven, modes that go together.
    leg = lambda t: F.get(F.filter(x, lambda y: y["day"] == t["day"]), F.lit(0))
    unflown = lambda t: ~F.coalesce((t["fact"]["origin"] == leg(t)["from_"]) & (t["fact"]["dest"] == leg(t)["to_"]), F.lit(False))
    modes = F.transform(x, lambda t: t["mode"])
    has = lambda m: F.coalesce(F.array_contains(F.filter(modes, lambda v: v.isNotNull()), m), F.lit(False))
    return [
        _of(slot("flight"), unflown, "transport.flight_not_in_graph", move),
        _of(slot("drive"), lost, "transport.ground_not_in_graph", move),
        _if((has("Self-driving") & has("Flight")) | (has("Taxi") & has("Self-driving")), "transport.mixed"),
        _of(meals, lambda t: F.contains(t["cell"], F.lit(";")), "meal.multi_entity", place),
        _of(single, lambda t: ~named(t), "meal.format", place),
        _of(single, lambda t: named(t) & lost(t), "meal.not_in_graph", place),
        _of(served, elsewhere, "meal.city_mismatch", place),
        F.transform(_repeats(served, lambda t: F.trim(t["cell"])), lambda t: _issue("meal.repeat", t["day"], t["slot"])),
        F.transform(wanted, lambda c: _issue("constraint.cuisine")),
        _of(sights, lambda t: ~named(t), "attraction.format", see),
        _of(good, lost, "attraction.not_in_graph", see),
        _of(good, elsewhere, "attraction.city_mismatch", see),
        F.transform(_repeats(good, lambda t: t["cell"]), lambda t: _issue("attraction.repeat", t["day"], see)),
        _of(beds, lost, "accom.not_in_graph", bed),
        _of(known, wrong, "constraint.room_type", bed),
        _of(known, broken, "constraint.house_rule", bed),
        _of(stays, lambda b: b["length"] < least(b), "accom.min_nights", bed),
    ]


def _costs(x: Column, a: Column) -> Column:
    """The costs of a plan as ``itinerary.plan_costs`` counts them: flights, meals, hotels, ground, unknown, total."""
    people = F.greatest(F.coalesce("people", F.lit(1)), F.lit(1))
    slot = lambda *names: F.filter(a, lambda t: t["slot"].isin(*names))
    leg = lambda t: F.get(F.filter(x, lambda y: y["day"] == t["day"]), F.lit(0))
    routed_ = lambda t: (leg(t)["from_"] != "") & (leg(t)["to_"] != "")
    km = lambda t: t["fact"]["km"]
    drive = lambda t: F.when(leg(t)["mode"] == "Self-driving", F.floor(km(t) * 0.05) * F.ceil(people / 5)).otherwise(F.floor(km(t)) * F.ceil(people / 4))
    priced = {
        "flights": F.transform(F.filter(slot("flight"), routed_), lambda t: t["fact"]["cost"] * people),
        "meals": F.transform(slot(*MEALS), lambda t: t["fact"]["cost"] * people),
        "hotels": F.transform(slot("accommodation"), lambda t: t["fact"]["cost"] * rooms(people, t["fact"]["occupancy"])),
        "ground": F.transform(F.filter(slot("leg"), routed_), lambda t: drive(t)),
    }
    sums = {k: F.aggregate(v, F.lit(0.0), lambda s, c: s + F.coalesce(c, F.lit(0.0)).cast("double")) for k, v in priced.items()}
    unknown = sum((F.size(F.filter(v, lambda c: c.isNull())) for v in priced.values()), F.size(F.filter(x, lambda t: t["going"] & t["mode"].isNull())))
    total = sums["flights"] + sums["meals"] + sums["hotels"] + sums["ground"]
    return F.struct(*(v.alias(k) for k, v in sums.items()), unknown.cast("long").alias("unknown"), total.alias("total"))


def plan_reports(plans: DataFrame, queries: DataFrame, atlas: Atlas, strict: bool = False) -> DataFrame:
    """query_id, issues (array of code, day, field, blocking) and costs (null without a plan); one row for each query. ``strict`` checks every inner city's state, not the first only.

    A null cell is an absent one. A plan without a row in the query's days has nothing to check but their number.
    """
    both = lambda t: F.when(t["moving"], F.array(t["o"], t["d"])).when(t["lodging"].isNotNull(), F.array(t["lodging"])).otherwise(F.array().cast("array<string>"))
    one = assembled(plans, queries, atlas)
    one = one.withColumn("stops", F.flatten(F.transform("x", both)))
    one = one.withColumn("costs", F.when(F.size("x") > 0, _costs(F.col("x"), F.col("a"))))
    x, a = F.col("x"), F.col("a")
    said = F.aggregate(x, F.lit(0), lambda s, t: s + sum((filled(t[k]).cast("int") for k in DAY_KEYS), F.lit(0)))
    rules = _day_rules(x) + _route_rules(x, a, strict) + _answer_rules(x, a)
    rules += [_if(said < 3 * F.col("_days"), "completeness.absent"), _if(F.col("costs.unknown") > 0, "cost.unknown", blocking=False), _if(F.col("costs.total") > F.col("budget"), "budget.over")]
    empty = F.array().cast(f"array<{ISSUE}>")
    checked = F.when(F.size("x") > 0, F.concat(*(F.coalesce(r, empty) for r in rules))).otherwise(empty)
    counted = F.coalesce(_if(F.col("n") != F.col("_days"), "days.count"), empty)
    issues = F.when(F.col("n").isNull(), F.array(_issue("plan.empty"))).otherwise(F.concat(counted, checked))
    return one.select("query_id", issues.alias("issues"), "costs")


def validate_plans(plans: DataFrame, queries: DataFrame, atlas: Atlas, strict: bool = False) -> DataFrame:
    """All issues of all plans: query_id, code, day, field, blocking."""
    return plan_reports(plans, queries, atlas, strict).select("query_id", F.inline("issues"))


def dominates(new: DataFrame, old: DataFrame) -> DataFrame:
    """query_id, better: fewer blocking issues, or as many, none of a new code, and a total lower by over 0.5.

    Both have query_id, blocking (number), codes (array of blocking codes) and total.
    """
    both = new.join(old.toDF("query_id", "_blocking", "_codes", "_total"), "query_id")
    less = F.col("blocking") < F.col("_blocking")
    tie = (F.col("blocking") == F.col("_blocking")) & (F.size(F.array_except("codes", "_codes")) == 0) & (F.col("total") < F.col("_total") - 0.5)
    return both.select("query_id", (less | tie).alias("better"))
