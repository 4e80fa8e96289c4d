"""Repair and cheapening of itineraries (inventory J2-J4, J6): greedy steps per plan over candidates that Spark has ranked.

Choices are made without replacement and in order, which no join expresses; so each plan meets its own
candidates in one Python group. A group holds one plan's days and the POOL cheapest candidates of each kind,
city, list of cuisines and least number of nights, whatever the tables' sizes: more than a plan has cells
to fill, so no choice is lost.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.parsing import MEALS, filled, plan_days, scalar_cell, split_attractions
from weftline.operators.itinerary import Atlas, find_places, place_cells, plan_costs, rooms
from weftline.operators.rules import ROOMS, dominates, routed, validate_plans
from weftline.session import checkpointed

POOL = 60
CELLS = ["query_id", "day", "days", "current_city", "transportation", "breakfast", "attraction", "lunch", "dinner", "accommodation"]
OFFER = "query_id int, kind string, city string, cell string, cost double, extra string, nights double"


def offers(plans: DataFrame, queries: DataFrame, atlas: Atlas) -> DataFrame:
    """query_id, kind, city, cell, cost, extra, nights: what each plan may choose from, and its own cells that are known.

    Kinds: meal, sight, stay (lodging that meets the query's constraints), flight (cell: "number|origin|dest"),
    drive (routes that can be driven), and known (cells of the plan that name a real place, with their cost).
    """
    days = routed(plans.join(queries.withColumnRenamed("days", "_days"), "query_id"))
    limits = (F.try_element_at("constraint", F.lit(k)).alias(a) for k, a in (("room type", "want"), ("house rule", "rule")))
    cities = days.select("query_id", "people", *limits, F.explode("cities").alias("city")).distinct()
    cell = F.concat_ws(", ", "name", "city")
    none = F.lit(None).cast("string")

    def top(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "kind", "city", "extra", "nights").orderBy(F.col("cost").asc_nulls_last(), "cell")
        return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= POOL).drop("_rn")

    row = lambda df, kind, cell_, cost, extra=none, nights=F.lit(0.0): df.select("query_id", F.lit(kind).alias("kind"), "city", cell_.alias("cell"), cost.cast("double").alias("cost"), extra.alias("extra"), nights.alias("nights"))
    meals = row(cities.join(atlas.restaurants, "city"), "meal", cell, F.col("cost"), F.col("cuisines"))
    sights = row(cities.join(atlas.attractions, "city"), "sight", cell, F.lit(0.0))
    want, rule = F.col("want"), F.col("rule")
    allowed = F.create_map(*(F.lit(x) for kv in ROOMS.items() for x in kv))
    good = F.coalesce(F.when(want == "not shared room", F.col("room_type") != "Shared room").otherwise(F.col("room_type") == F.try_element_at(allowed, want)), F.lit(True))
    fits = good & ~F.coalesce(F.contains(F.coalesce("house_rules", F.lit("")), F.concat(F.lit("No "), rule)), F.lit(False))
    price = F.col("price") * rooms(F.col("people"), F.col("occupancy"))
    stays = row(cities.join(atlas.accommodations, "city").where(fits), "stay", cell, price, none, F.coalesce("min_nights", F.lit(0.0)))
    legs = days.where("moving").select("query_id", F.col("o").alias("origin"), F.col("d").alias("dest")).distinct()
    route = F.concat_ws("|", "origin", "dest")
    flights = row(legs.join(atlas.flights, ["origin", "dest"]).withColumn("city", route), "flight", F.col("number"), F.col("price"))
    drives = row(legs.join(atlas.ground.where("valid"), ["origin", "dest"]).withColumn("city", route), "drive", F.lit("Taxi"), F.col("km"))
    eaten = find_places(place_cells(plans, MEALS), atlas.restaurants, ["cost", "cuisines"]).where("found is not null")
    slept = find_places(place_cells(plans, ("accommodation",)), atlas.accommodations, ["price", "occupancy"]).where("found is not null").join(queries.select("query_id", "people"), "query_id")
    seen = plans.where(filled(F.col("attraction"))).select("query_id", F.explode(split_attractions(F.col("attraction"))).alias("cell"))
    seen = find_places(seen.withColumns({"name": F.trim(F.regexp_replace("cell", r",[^,]*$", "")), "city": F.trim(F.substring_index("cell", ",", -1))}), atlas.attractions, ["name"]).where("found is not null")
    known = row(eaten, "known", F.col("cell"), F.col("found.cost"), F.col("found.cuisines")).union(row(slept, "known", F.col("cell"), F.col("found.price") * rooms(F.col("people"), F.col("found.occupancy")))).union(row(seen, "known", F.col("cell"), F.lit(0.0)))
    ranked = top(meals.union(sights).union(stays).union(flights).union(drives))
    return ranked.union(known.distinct())


class _Desk:
    """One plan and its offers."""

    def __init__(self, plan: pd.DataFrame, offered: pd.DataFrame) -> None:
        self.days = plan.sort_values("day").to_dict("records")
        self.offers = offered.sort_values(["cost", "cell"], na_position="last").to_dict("records")
        self.known = {o["cell"]: o for o in self.offers if o["kind"] == "known"}

    def of(self, kind: str, cities: list[str]) -> list[dict]:
        return [o for o in self.offers if o["kind"] == kind and o["city"] in cities]

    @staticmethod
    def here(day: dict) -> list[str]:
        return list(day["cities"])

    def empty(self, cell: object) -> bool:
        return cell is None or str(cell).strip() in ("", "-")

    def sound(self, cell: str, day: dict) -> bool:
        return cell in self.known and any(c in cell for c in self.here(day))

    def stays(self) -> list[list[dict]]:
        """Neighbouring days, the last left out, that lodge in one city."""
        blocks: list[list[dict]] = []
        for d in self.days[: max(0, int(self.days[0]["_days"]) - 1)]:
            if blocks and blocks[-1][-1]["lodging"] == d["lodging"]:
                blocks[-1].append(d)
            else:
                blocks.append([d])
        return [b for b in blocks if b[0]["lodging"]]

    def meals(self) -> None:
        used: set[str] = set()
        for d in self.days:
            for m in MEALS:
                cell = d[m]
                if self.empty(cell):
                    if d["moving"]:
                        continue
                elif self.sound(cell, d) and cell not in used and ";" not in cell:
                    used.add(cell)
                    continue
                taken = used | {x[k] for x in self.days for k in MEALS}
                new = next((o for o in self.of("meal", self.here(d)) if o["cell"] not in taken), None)
                if new:
                    d[m] = new["cell"]
                    self.known[new["cell"]] = new
                    used.add(new["cell"])

    def sights(self) -> None:
        used: set[str] = set()
        for d in self.days:
            items = [x.strip() for x in str(d["attraction"] or "").split(";") if x.strip() not in ("", "-")]
            kept = []
            for item in items or ([] if d["moving"] else [None]):
                if item is not None and item not in used and self.sound(item, d):
                    kept.append(item)
                else:
                    new = next((o["cell"] for o in self.of("sight", self.here(d)) if o["cell"] not in used and o["cell"] not in items), None)
                    kept += [new] if new else []
                used.update(kept)
            d["attraction"] = "; ".join(kept) + ";" if kept else "-"

    def lodging(self) -> None:
        if len(self.days) >= int(self.days[0]["_days"]):
            self.days[int(self.days[0]["_days"]) - 1]["accommodation"] = "-"
        for block in self.stays():
            fit = [o for o in self.of("stay", [block[0]["lodging"]]) if o["nights"] <= len(block)]
            now = {d["accommodation"] for d in block}
            if fit and (len(now) > 1 or now.isdisjoint(o["cell"] for o in fit)):
                for d in block:
                    d["accommodation"] = fit[0]["cell"]
                self.known[fit[0]["cell"]] = fit[0]

    def transport(self) -> None:
        modes = " ".join(str(d["transportation"]) for d in self.days)
        for d in self.days:
            said = str(d["transportation"] or "")
            if "Flight Number" not in said or not d["moving"]:
                continue
            route = f"{d['o']}|{d['d']}"
            flights = self.of("flight", [route])
            if any(f"Flight Number: {o['cell']}," in said + "," for o in flights):
                continue
            if flights:
                d["transportation"] = f"Flight Number: {flights[0]['cell']}, from {d['o']} to {d['d']}"
            elif self.of("drive", [route]) and "Self-driving" not in modes:
                d["transportation"] = f"Taxi, from {d['o']} to {d['d']}"

    def cuisines(self) -> None:
        for want in self.days[0]["cuisines"]:
            eaten = [self.known.get(d[m]) for d in self.days for m in MEALS]
            if any(o and want.lower() in str(o["extra"]).lower() for o in eaten):
                continue
            slots = sorted(((-(self.known.get(d[m]) or {"cost": 0})["cost"], i, m) for i, d in enumerate(self.days) for m in MEALS if not self.empty(d[m])))
            for _, i, m in slots:
                d = self.days[i]
                taken = {x[k] for x in self.days for k in MEALS}
                new = next((o for o in self.of("meal", [c for c in self.here(d) if c != d["org"]]) if want.lower() in str(o["extra"]).lower() and o["cell"] not in taken), None)
                if new:
                    d[m] = new["cell"]
                    self.known[new["cell"]] = new
                    break

    def cheapen(self) -> None:
        """Cheaper lodging, then the dearest meals, then flights, each of the same city and route, until ``over`` is saved."""
        over, people = float(self.days[0]["over"]), max(1, int(self.days[0]["people"] or 1))
        for block in self.stays():
            old = self.known.get(block[0]["accommodation"])
            fit = [o for o in self.of("stay", [block[0]["lodging"]]) if o["nights"] <= len(block) and old and o["cost"] < old["cost"] - 0.5]
            if over > 0 and fit:
                over -= (old["cost"] - fit[0]["cost"]) * len(block)
                for d in block:
                    d["accommodation"] = fit[0]["cell"]
        needed = [c.lower() for c in self.days[0]["cuisines"]]
        serves = lambda o: {c for c in needed if c in str(o["extra"]).lower()}
        slots = sorted(((-(self.known.get(d[m]) or {"cost": 0})["cost"], i, m) for i, d in enumerate(self.days) for m in MEALS if d[m] in self.known))
        for _, i, m in slots:
            d, old = self.days[i], self.known[self.days[i][m]]
            taken = {x[k] for x in self.days for k in MEALS}
            new = next((o for o in self.of("meal", self.here(d)) if o["cost"] < old["cost"] - 0.5 and o["cell"] not in taken and serves(old) <= serves(o)), None)
            if over > 0 and new:
                over -= (old["cost"] - new["cost"]) * people
                d[m] = new["cell"]
        for d in self.days:
            flights = self.of("flight", [f"{d['o']}|{d['d']}"])
            old = next((o for o in flights if f"Flight Number: {o['cell']}," in str(d["transportation"]) + ","), None)
            if over > 0 and old and flights[0]["cost"] < old["cost"] - 0.5:
                over -= (old["cost"] - flights[0]["cost"]) * people
                d["transportation"] = f"Flight Number: {flights[0]['cell']}, from {d['o']} to {d['d']}"

    def plan(self) -> pd.DataFrame:
        return pd.DataFrame(self.days)[CELLS]


def _each(plans: DataFrame, queries: DataFrame, atlas: Atlas, steps: tuple[str, ...]) -> DataFrame:
    schema = plans.select(*CELLS).schema

    def work(plan: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if not len(plan):
            return pd.DataFrame({f.name: [] for f in schema})
        desk = _Desk(plan, offered)
        for step in steps:
            getattr(desk, step)()
        return desk.plan()

    kept = ["query_id", "people", "org", "cuisines", F.col("days").alias("_days"), *(["over"] if "over" in queries.columns else [])]
    days = routed(plans.select(*CELLS).join(queries.select(*kept), "query_id")).where(F.col("day") < F.col("_days"))
    offered = offers(plans, queries, atlas).withColumnRenamed("query_id", "offer_id")  # the two sides share their lineage
    return days.groupBy("query_id").cogroup(offered.groupBy("offer_id")).applyInPandas(work, schema)


def local_repair(plans: DataFrame, queries: DataFrame, atlas: Atlas) -> DataFrame:
    """Transport, lodging, meals, sights and cuisines put right from candidates of the day's own cities; where there are none the fault stays."""
    numbered = plans.withColumn("days", F.col("day") + 1)
    return _each(numbered, queries, atlas, ("transport", "lodging", "meals", "sights", "cuisines"))


def budget_downgrade(plans: DataFrame, queries: DataFrame, atlas: Atlas, costs: DataFrame) -> DataFrame:
    """Cheaper choices for plans over budget; ``costs`` is plan_costs of the plans. Others stay as they are."""
    over = queries.join(costs.select("query_id", "total"), "query_id").withColumn("over", F.greatest(F.col("total") - F.col("budget"), F.lit(0.0)))
    return _each(plans, over, atlas, ("cheapen",))


def _report(plans: DataFrame, queries: DataFrame, atlas: Atlas) -> DataFrame:
    """query_id, blocking, codes, total of each plan."""
    issues = validate_plans(plans, queries, atlas).where("blocking").groupBy("query_id").agg(F.count("*").alias("blocking"), F.collect_set("code").alias("codes"))
    out = plan_costs(plans, queries, atlas).select("query_id", "total").join(issues, "query_id", "left")
    return out.select("query_id", F.coalesce("blocking", F.lit(0)).alias("blocking"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), "total")


def _adopted(plans: DataFrame, report: DataFrame, new: DataFrame, queries: DataFrame, atlas: Atlas) -> tuple[DataFrame, DataFrame]:
    """Each query's new plan where it dominates the old one, and the reports of what stays. Lineage is cut, as all is read several times."""
    new = checkpointed(new.select(*CELLS))
    fresh = checkpointed(_report(new, queries, atlas))
    better = checkpointed(dominates(fresh, report).where("better").select("query_id"))
    pick = lambda a, b: checkpointed(a.join(better, "query_id", "left_semi").unionByName(b.join(better, "query_id", "left_anti")))
    return pick(new, plans.select(*CELLS)), pick(fresh, report)


def finalize_plans(plans: DataFrame, queries: DataFrame, atlas: Atlas) -> DataFrame:
    """Repaired and then cheapened plans, each step kept only where it dominates what was there."""
    report = checkpointed(_report(plans, queries, atlas))
    for step in (lambda p: local_repair(p, queries, atlas), lambda p: budget_downgrade(p, queries, atlas, plan_costs(p, queries, atlas))):
        plans, report = _adopted(plans, report, step(plans), queries, atlas)
    return plans


#: What a repair request says of prices, and how many issues it lists.
PRICES = "per traveller: flights and meals; per room and night: lodging; per vehicle (car for 5, taxi for 4) and whole kilometre: taxis, cars a twentieth of that"
ISSUES = 40


def constraint_json(queries: DataFrame) -> DataFrame:
    """query_id and ``constraints``: JSON of what a plan must keep, the absent left out."""
    wish = lambda k: F.nullif(F.try_element_at("constraint", F.lit(k)), F.lit(""))
    known = F.create_map(*(F.lit(x) for kv in ROOMS.items() for x in kv))
    one = lambda **parts: F.struct(*(v.alias(k) for k, v in parts.items()))
    given = lambda test, **parts: F.when(test, one(**parts))
    room, rule, travel = wish("room type"), wish("house rule"), wish("transportation")
    barred = F.when(room == "not shared room", F.lit(ROOMS["shared room"]))
    limits = {
        "cuisines_to_taste": given(F.size("cuisines") > 0, each_of=F.col("cuisines"), not_in=F.col("org")),
        "room_type": given(room.isNotNull(), required=F.when(barred.isNull(), F.coalesce(F.try_element_at(known, F.lower(room)), room)), barred=barred),
        "lodging_must_allow": rule,
        "travel_without": F.regexp_replace(travel, "^no ", ""),
        "money": one(at_most=F.col("budget"), counted=F.lit(PRICES)),
        "cities_to_visit": F.col("visiting_city_number"),
    }
    return queries.select("query_id", F.to_json(one(**limits)).alias("constraints"))


def plan_records(queries: DataFrame, plans: DataFrame) -> DataFrame:
    """One record for each query: query_idx and ``plan``, an array of its days in order, empty where there is no plan."""
    day = F.struct("day", F.struct(*CELLS[2:]).alias("cells"))
    made = plans.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(day)), lambda x: x["cells"]).alias("plan"))
    kind = made.schema["plan"].dataType.simpleString()
    return queries.select("query_id").join(made, "query_id", "left").select(F.col("query_id").alias("query_idx"), F.coalesce("plan", F.from_json(F.lit("[]"), kind)).alias("plan"))


def repair_requests(plans: DataFrame, queries: DataFrame, issues: DataFrame) -> DataFrame:
    """What a model needs to repair a plan with blocking ``issues`` (of ``validate_plans``): query_id, constraints, plan and issues (40 at most), as JSON."""
    listed = issues.where("blocking").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("code", "day", "field"))).alias("issues"))
    records = plan_records(queries, plans).select(F.col("query_idx").alias("query_id"), F.to_json("plan").alias("plan"))
    return constraint_json(queries).join(records, "query_id").join(listed, "query_id").select("query_id", "constraints", "plan", F.to_json(F.slice("issues", 1, ISSUES)).alias("issues"))


def model_repair(plans: DataFrame, queries: DataFrame, atlas: Atlas, answers: DataFrame) -> DataFrame:
    """Plans with a model's ``answers`` (query_id, answer text) in their place where those dominate; unreadable ones change nothing."""
    rows = answers.select("query_id", F.posexplode(plan_days(F.col("answer"))).alias("day", "cells"))
    cell = lambda c: scalar_cell(F.try_element_at("cells", F.lit(c))).alias(c)
    new = rows.select("query_id", "day", F.coalesce(F.try_element_at("cells", F.lit("days")).try_cast("int"), F.col("day") + 1).alias("days"), *map(cell, CELLS[3:]))
    return _adopted(plans, checkpointed(_report(plans, queries, atlas)), new, queries, atlas)[0]
