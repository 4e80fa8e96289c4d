"""Reference tables of an itinerary batch, lookups in them and plan costs (inventory I)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.parsing import MEALS, amount, filled, first_flight_number, place_city, place_name, route_from, route_to, strip_paren, transport_mode
from weftline.functions.text import stripped
from weftline.operators.containment import containing
from weftline.schema import Schema
from weftline.sources.tables import dropna


@dataclass
class Atlas:
    """restaurants (name, city, cuisines, cost), accommodations (name, city, price, room_type, min_nights, occupancy,
    house_rules), attractions (name, city), flights (number, origin, dest, price), ground (origin, dest, km, valid),
    cities (name, state, covered). All but ground and cities have ``ord``."""

    restaurants: DataFrame
    accommodations: DataFrame
    attractions: DataFrame
    flights: DataFrame
    ground: DataFrame
    cities: DataFrame


def fidelity_gate(rows: DataFrame, reference: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose name lies in a reference name of the same city, reference values over their own where not empty; and the count dropped."""
    ref = reference.select("city", F.lower("name").alias("_whole"), "ord", *(F.col(c).cast("string").alias(f"_{c}") for c in columns))
    asked = rows.select("name", "city").distinct().withColumn("_part", F.lower("name"))
    met = containing(asked, ref, "_part", "_whole", ["city"])
    first = met.groupBy("name", "city").agg(F.min_by(F.struct(*(f"_{c}" for c in columns)), "ord").alias("_ref"))
    joined = rows.join(first, ["name", "city"])
    merged = joined.select(*(F.coalesce(F.nullif(F.col(f"_ref._{c}"), F.lit("")), F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in rows.columns)).distinct()
    dropped = rows.join(first.select("name", "city"), ["name", "city"], "left_anti").agg(F.count("*").alias("dropped"))
    return merged, dropped


def gate_flights(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Flights whose number, origin and destination are in the reference."""
    return rows.join(reference.select("number", "origin", "dest").distinct(), ["number", "origin", "dest"], "left_semi")


def ground_matrix(distances: DataFrame) -> DataFrame:
    """Origin, dest, km, valid of distance rows (origin, destination, duration, distance, ord); the last of equal routes counts."""
    end = lambda c: stripped(strip_paren(stripped(F.col(c))))
    km = amount(F.replace("distance", F.lit("km"), F.lit("")))
    valid = F.coalesce((F.col("duration") != "") & km.isNotNull() & ~F.contains("duration", F.lit("day")), F.lit(False))
    rows = distances.select(end("origin").alias("origin"), end("destination").alias("dest"), km.alias("km"), valid.alias("valid"), "ord")
    return rows.groupBy("origin", "dest").agg(F.max_by("km", "ord").alias("km"), F.max_by("valid", "ord").alias("valid"))


def find_places(cells: DataFrame, places: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``found`` (struct of ``keep``, null if there is none) to cells that have ``name`` and ``city``.

    An exact name and city without regard to case come first (the last such row), then the first row of
    the very city whose name contains the cell's. What is equal is joined by equality; only the rest is
    looked up by q-grams, so a city of many places spreads over many tasks.
    """
    ask = cells.select("name", "city").where((F.col("name") != "-") & (F.col("city") != "-") & (F.col("name") != "")).distinct()
    ask = ask.withColumns({"_part": F.lower("name"), "_in": F.lower("city")})
    row = F.struct(*keep)
    exact = places.groupBy(F.lower("name").alias("_part"), F.lower("city").alias("_in")).agg(F.max_by(row, "ord").alias("found"))
    met = ask.join(exact, ["_part", "_in"], "left")
    rest = met.where("found is null").select("name", "city", "_part")
    inside = containing(rest, places.select("city", F.lower("name").alias("_whole"), "ord", row.alias("row")), "_part", "_whole", ["city"])
    first = inside.groupBy("name", "city").agg(F.min_by("row", "ord").alias("found"))
    return cells.join(met.where("found is not null").select("name", "city", "found").union(first), ["name", "city"], "left")


def covered_cities(atlas: Atlas, state: str | None = None) -> DataFrame:
    """Covered cities, of one state if given, by name."""
    return atlas.cities.where(F.col("covered") & (F.lit(True) if state is None else F.col("state") == state)).orderBy("name")


def place_cells(plans: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Cells that hold one place: query_id, day, field, cell, name, city."""
    cells = plans.select("query_id", "day", F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field", "cell")).where(filled(F.col("cell")))
    return cells.withColumns({"name": place_name(F.col("cell")), "city": place_city(F.col("cell"))})


def rooms(people: Column, occupancy: Column) -> Column:
    return F.ceil(people / F.greatest(F.coalesce(occupancy, F.lit(1)), F.lit(1)))


def leg_ends(plans: DataFrame) -> DataFrame:
    """Days with a transport, and the ends and mode of it: those it names, else those of the current city."""
    t, c = F.col("transportation"), F.col("current_city")
    named = (route_from(t) != "") & (route_to(t) != "")
    end = lambda get: stripped(strip_paren(F.when(named, get(t)).otherwise(get(c))))
    return plans.where(filled(t)).select("query_id", "day", "transportation", end(route_from).alias("origin"), end(route_to).alias("dest"), transport_mode(t).alias("mode"), first_flight_number(t).alias("number"))


def plan_costs(plans: DataFrame, queries: DataFrame, atlas: Atlas) -> DataFrame:
    """I8: query_id, flights, meals, hotels, ground, unknown, total; one row for each query that has a plan.

    Flights and meals cost a price a person; a car takes five at int(km * 0.05), a taxi four at int(km),
    each leg for itself; a hotel night costs its price a room. What can't be resolved counts as unknown.
    """
    size = queries.select("query_id", F.greatest(F.coalesce("people", F.lit(1)), F.lit(1)).alias("people"), F.col("days").alias("_days"))
    plans = plans.join(size, "query_id").where(F.col("day") < F.col("_days"))
    people = plans.select("query_id", "people").distinct()
    legs = leg_ends(plans)
    flight = atlas.flights.groupBy("number").agg(F.min_by("price", "ord").alias("fare"))
    legs = legs.join(flight, "number", "left").join(atlas.ground.where("valid").select("origin", "dest", "km"), ["origin", "dest"], "left").join(people, "query_id")
    routed = (F.col("origin") != "") & (F.col("dest") != "")
    fare = F.when((F.col("mode") == "Flight") & routed, F.col("fare") * F.col("people"))
    drive = F.when((F.col("mode") == "Self-driving") & routed, F.floor(F.col("km") * 0.05) * F.ceil(F.col("people") / 5)).when((F.col("mode") == "Taxi") & routed, F.floor("km") * F.ceil(F.col("people") / 4))
    open_ = F.col("mode").isNull() | (routed & fare.isNull() & drive.isNull())
    item = lambda df, kind, cost, unknown: df.select("query_id", kind.alias("kind"), cost.cast("double").alias("cost"), unknown.alias("unknown"))
    out = item(legs, F.when(F.col("mode") == "Flight", "flights").otherwise("ground"), F.coalesce(fare, drive), open_)
    meals = find_places(place_cells(plans, MEALS), atlas.restaurants, ["cost"]).join(people, "query_id")
    cost = F.col("found.cost") * F.col("people")
    out = out.union(item(meals, F.lit("meals"), cost, cost.isNull()))
    nights = find_places(place_cells(plans, ("accommodation",)), atlas.accommodations, ["price", "occupancy"]).join(people, "query_id")
    cost = F.col("found.price") * rooms(F.col("people"), F.col("found.occupancy"))
    out = out.union(item(nights, F.lit("hotels"), cost, cost.isNull()))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("cost"))), F.lit(0.0)).alias(kind)
    summed = out.groupBy("query_id").agg(*(total(k) for k in ("flights", "meals", "hotels", "ground")), F.count_if("unknown").alias("unknown"))
    filled_in = people.select("query_id").join(summed, "query_id", "left").na.fill(0)
    return filled_in.withColumn("total", F.col("flights") + F.col("meals") + F.col("hotels") + F.col("ground"))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """I4: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def reference_routes(flights: DataFrame) -> DataFrame:
    """Number, routes: the different (origin, dest) of each reference flight, rows with missing values left out."""
    return dropna(flights, ["number", "origin", "dest"]).groupBy("number").agg(F.array_sort(F.collect_set(F.struct("origin", "dest"))).alias("routes"))


def distance_entities(rows: DataFrame, schema: Schema) -> DataFrame | None:
    """Entity candidates (etype, key, props) of distance rows for the first entity type with origin and destination; null if there is none.

    Rows without a full key are left out; no model is asked for what is already a table.
    """
    entity = next((e for e in schema.entities if {"origin", "destination"} <= set(e.names)), None)
    if entity is None:
        return None
    pick = lambda names: F.create_map(*(x for n in names if n in rows.columns for x in (F.lit(n), F.col(n).cast("string"))))
    whole = dropna(rows, [k for k in entity.primary_key if k in rows.columns])
    return whole.select(F.lit(entity.name).alias("etype"), pick(entity.primary_key).alias("key"), pick([n for n in entity.names if n not in entity.primary_key]).alias("props"))
