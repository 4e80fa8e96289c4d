"""The query functions that users call (inventory K): tiered searches, stage counts, costs, budgets.

Relaxations are tiers of one plan: each row gets the strictest tier that it satisfies, and the least
tier that has rows stays. Why a result is empty is told by ``stage_counts``, one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import has_text
from weftline.operators.core import GraphStore, filter_categorical, filter_numeric, filter_relation_connected, filter_set_overlap, lookup_entities, numeric, project_properties
from weftline.operators.retrieval import least_tier

FLIGHT = ("Flight Number", "FlightDate", "Price", "DepTime", "ArrTime", "OriginCityName", "DestCityName")
RESTAURANT = ("Name", "City", "Cuisines", "Average Cost", "Aggregate Rating")
ACCOMMODATION = ("NAME", "city", "room type", "price", "minimum nights", "review rate number", "house_rules", "maximum occupancy")
ATTRACTION = ("Name", "City", "Address", "Phone", "Latitude", "Longitude")


def search_flights(store: GraphStore, origin: str = "", dest: str = "", date: str = "", max_price: float | None = None, limit: int = 50) -> DataFrame:
    """K1: flights of a route on a date; else of the route; else from or to either end; cheapest first.

    ``match_note`` says which; ``suggestion`` lists where the origin flies to unless the match is exact.
    """
    rows = store.view("Flight")
    at = lambda field, text: has_text(F.col(field), text) if text else F.lit(True)
    route = at("OriginCityName", origin) & at("DestCityName", dest)
    loose = (has_text(F.col("OriginCityName"), origin) if origin else F.lit(False)) | (has_text(F.col("DestCityName"), dest) if dest else F.lit(False))
    tier = F.when(route & at("FlightDate", date), 1).when(route, 2).when(loose, 3)
    kept = least_tier(rows.withColumn("tier", tier).where("tier is not null"))
    kept = kept.where(F.col("`Flight Number`").isNotNull() & F.col("FlightDate").isNotNull())
    if max_price is not None:
        kept = filter_numeric(kept, "Price", "<=", max_price)
    first = Window.partitionBy("Flight Number", "FlightDate").orderBy("ord")
    kept = kept.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    note = F.element_at(F.array(F.lit("exact"), F.lit("date_relaxed"), F.lit("dest_relaxed")), F.col("tier"))
    kept = kept.orderBy(F.coalesce(numeric(kept, "Price"), F.lit(0.0)), "ord").limit(limit).withColumn("match_note", note)
    out = project_properties(kept, [*FLIGHT, "match_note"])
    if not origin:
        return out.withColumn("suggestion", F.lit(""))
    reached = rows.where(has_text(F.col("OriginCityName"), origin)).agg(F.array_join(F.slice(F.array_sort(F.collect_set("DestCityName")), 1, 15), ", ").alias("to"))  # one row
    told = F.when(F.col("match_note") == "exact", "").otherwise(F.concat(F.lit(f"Flights from {origin} fly to: "), F.col("to")))
    return out.join(F.broadcast(reached)).withColumn("suggestion", told).drop("to")


def _in_city(rows: DataFrame, field: str, city: str) -> DataFrame:
    return rows.where(F.lower(F.trim(F.col(field))) == city.strip().lower())


def find_restaurants(store: GraphStore, city: str, cuisines: Sequence[str] = (), max_cost: float | None = None) -> tuple[DataFrame, DataFrame]:
    """K2: restaurants of a city that the graph confirms, by cuisine and cost, best rated and then cheapest first; and the stage counts."""
    here = _in_city(store.view("Restaurant"), "City", city)
    linked = filter_relation_connected(here, store, "located_in", "City")
    served = filter_set_overlap(linked, "Cuisines", cuisines) if cuisines else linked
    cheap = filter_numeric(served, "Average Cost", "<=", max_cost) if max_cost is not None else served
    ordered = cheap.orderBy(F.coalesce(numeric(cheap, "Aggregate Rating"), F.lit(0.0)).desc(), F.coalesce(numeric(cheap, "Average Cost"), F.lit(0.0)), "ord")
    return project_properties(ordered, RESTAURANT), stage_counts({"in_city": here, "linked": linked, "cuisine": served, "cost": cheap})


def find_accommodations(store: GraphStore, city: str, max_price: float | None = None, min_review: float | None = None, room_type: str = "", min_occupancy: int | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K3: lodging of a city by price; what was dropped for another city or without an edge to it; and the stage counts."""
    near = lookup_entities(store, "Accommodation", {"city": city}, limit=None)
    linked = filter_relation_connected(_in_city(near, "city", city), store, "located_in", "City", {"name": city})
    dropped = near.join(linked.select("__id__"), "__id__", "left_anti")
    kept = linked
    for field, op, value in (("maximum occupancy", ">=", min_occupancy), ("price", "<=", max_price), ("review rate number", ">=", min_review)):
        kept = kept if value is None else filter_numeric(kept, field, op, value)
    if room_type:
        kept = filter_categorical(kept, "room type", [room_type])
    ordered = kept.orderBy(numeric(kept, "price").asc_nulls_last(), "ord").limit(limit)
    return project_properties(ordered, ACCOMMODATION), project_properties(dropped, ACCOMMODATION), stage_counts({"near": near, "linked": linked, "kept": kept})


def find_attractions(store: GraphStore, city: str = "", exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """K4: different attractions of a city but those named; and the names held back."""
    rows = project_properties(lookup_entities(store, "Attraction", {"City": city} if city else None), ATTRACTION)
    name = F.lower(F.trim("Name"))
    served = name.isin([x.strip().lower() for x in exclude]) if exclude else F.lit(False)
    nth = F.row_number().over(Window.partitionBy(name, F.lower("City")).orderBy("__id__"))
    marked = rows.withColumn("_held", served | (nth > 1))
    return marked.where(~F.col("_held")).drop("_held"), marked.where("_held").select("Name").distinct()


def cities_in_state(store: GraphStore, state: str, code: str) -> DataFrame:
    """K5: names of cities in a state: cities that name it, else ends of ground links, else of flights; the part before a comma."""
    sources = (("City", ("name",)), ("GroundTransportLink", ("origin", "destination")), ("Flight", ("OriginCityName", "DestCityName")))
    out = None
    for tier, (etype, fields) in enumerate(sources, 1):
        if etype not in store.views:
            continue
        for field in fields:
            value = F.col(field)
            hit = F.contains(value, F.lit(f", {code}")) | F.contains(value, F.lit(f",{code}")) | has_text(value, state)
            found = store.view(etype).where(hit).select(F.trim(F.split_part(value, F.lit(","), F.lit(1))).alias("name"), F.lit(tier).alias("tier"))
            out = found if out is None else out.union(found)
    return least_tier(out.where("name != ''").distinct()).select("name").orderBy("name")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each stage has left, and the first that has none."""
    counts = None
    for name, rows in stages.items():
        n = rows.agg(F.count("*").alias(name))
        counts = n if counts is None else counts.join(F.broadcast(n))
    empty = F.coalesce(*(F.when(F.col(s) == 0, F.lit(s)) for s in stages))
    return counts.withColumn("empty_stage", empty)


def trip_cost(flights: Column, meals: Column, stays: Column, legs: Column, people: Column, mode: str = "self-driving") -> Column:
    """K7: a struct of costs from arrays of prices, prices, (price, nights, occupancy) and kilometres."""
    p = F.greatest(F.coalesce(people, F.lit(1)), F.lit(1))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double"))
    one = lambda x: F.greatest(x.cast("int"), F.lit(1))
    night = F.transform(stays, lambda s: F.round(s["price"] * one(s["nights"]) * F.ceil(p / one(s["occupancy"])), 2))
    own = mode == "self-driving"
    leg = F.transform(legs, lambda km: F.floor(km * 0.05 if own else km).cast("double") * F.ceil(p / (5 if own else 4)))
    parts = {"flights": F.round(add(flights) * p, 2), "meals": F.round(add(meals) * p, 2), "hotels": F.round(add(night), 2), "ground": add(leg)}
    return F.struct(*(v.alias(k) for k, v in parts.items()), F.round(sum(parts.values(), F.lit(0.0)), 2).alias("total"))


def check_budget(total: Column, budget: Column, tolerance: float = 0.01) -> Column:
    """K8: a struct of whether the total fits, what remains and what is over."""
    return F.struct((total <= budget + tolerance).alias("within"), F.round(budget - total, 2).alias("remaining"), F.round(F.greatest(total - budget, F.lit(0.0)), 2).alias("overspend"))


def evidence(rows: DataFrame, by: str, order: Sequence[Column], fields: Sequence[str], k: int = 5) -> DataFrame:
    """The first k candidates of each group as one JSON text."""
    w = Window.partitionBy(by).orderBy(*order)
    top = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_rn", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields)))).alias("candidates"))
