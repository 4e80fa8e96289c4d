"""Itinerary queries over the driver's tables (inventory I, V, J, K) and the SQL that must give the same rows.

Nations are cities and regions states; suppliers, parts and customers are where one eats, sleeps and looks
around; orders are flights. Every customer asks for a trip through its region, and gets a plan with one
of FAULTS faults or none. The tables and plans are made by the same SQL text in both engines; the rules,
costs and look-ups are the library's on one side and plain SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import itinerary, rules
from weftline.operators.core import GraphStore
from weftline.operators.itinerary import Atlas
from weftline.plans import views
from weftline.plans.catalog import query
from weftline.sources.tables import table

FAULTS = 53

#: Reference tables and queries; {names} are the driver's tables.
TABLES = {
    "nations": "SELECT n_nationkey, n_name, n_regionkey, r_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) - 1 AS r FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "cities": "SELECT n_name AS name, r_name AS state, n_nationkey % 6 <> 5 AS covered FROM {nations}",
    "restaurants": """SELECT s_name AS name, n_name AS city, CASE WHEN s_suppkey % 3 = 0 THEN 'Italian, Pizza' WHEN s_suppkey % 3 = 1 THEN 'Mexican' ELSE 'Japanese, Sushi' END AS cuisines,
        CAST(10 + s_suppkey % 40 AS DOUBLE) AS cost, CAST(s_suppkey AS INT) AS ord FROM {supplier} JOIN {nations} ON s_nationkey = n_nationkey""",
    "accommodations": """SELECT 'Inn No. ' || CAST(p_partkey AS STRING) AS name, n_name AS city, CAST(40 + p_partkey % 90 AS DOUBLE) AS price,
        CASE WHEN p_partkey % 3 = 0 THEN 'Shared room' WHEN p_partkey % 3 = 1 THEN 'Private room' ELSE 'Entire home/apt' END AS room_type, CAST(1 + p_partkey % 7 % 3 AS DOUBLE) AS min_nights,
        CAST(1 + p_size % 4 AS DOUBLE) AS occupancy, CASE WHEN p_partkey % 5 = 0 THEN 'No smoking' WHEN p_partkey % 5 = 1 THEN 'No pets & No parties' ELSE '' END AS house_rules, CAST(p_partkey AS INT) AS ord
        FROM {part} JOIN {nations} ON p_partkey % 25 = n_nationkey""",
    "attractions": "SELECT c_name AS name, n_name AS city, CAST(c_custkey AS INT) AS ord FROM {customer} JOIN {nations} ON c_nationkey = n_nationkey",
    "flights": """SELECT 'F' || CAST(o_orderkey AS STRING) AS number, a.n_name AS origin, b.n_name AS dest, CAST(50 + o_orderkey % 300 AS DOUBLE) AS price, CAST(o_orderkey AS INT) AS ord
        FROM {orders} JOIN {nations} a ON o_orderkey % 25 = a.n_nationkey JOIN {nations} b ON o_custkey % 25 = b.n_nationkey""",
    "ground": """SELECT a.n_name AS origin, b.n_name AS dest, CAST(abs(a.n_nationkey - b.n_nationkey) * 37.5 + 10 AS DOUBLE) AS km, (a.n_nationkey + b.n_nationkey) % 11 <> 0 AS valid
        FROM {nations} a JOIN {nations} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey""",
    # A customer's home, three cities of its region, a supplier, an inn and a sight in each, a flight out.
    "asked": """SELECT CAST(c_custkey AS INT) AS query_id, CAST(c_custkey % 53 AS INT) AS fault, CAST(3 + c_custkey % 3 * 2 AS INT) AS days, CAST(1 + c_custkey % 4 AS INT) AS people, h.n_name AS org, c1.r_name AS dest,
        c1.n_name AS c1, c2.n_name AS c2, c3.n_name AS c3, CAST(c1.n_nationkey AS INT) AS k1, CAST(c2.n_nationkey AS INT) AS k2, CAST(c3.n_nationkey AS INT) AS k3
        FROM {customer} JOIN {nations} h ON c_nationkey = h.n_nationkey JOIN {nations} c1 ON c_custkey % 5 = c1.n_regionkey AND CAST(floor(c_custkey / 5) AS INT) % 5 = c1.r
        JOIN {nations} c2 ON c1.n_regionkey = c2.n_regionkey AND (c1.r + 1) % 5 = c2.r JOIN {nations} c3 ON c1.n_regionkey = c3.n_regionkey AND (c1.r + 2) % 5 = c3.r""",
    "trips": """SELECT query_id, org, dest, days, people, CAST(CASE WHEN fault = 45 THEN 100 ELSE 9000 END AS DOUBLE) AS budget, CAST((days - 1) / 2 AS INT) AS visiting_city_number,
        CASE WHEN fault = 23 THEN 'no flight' WHEN fault = 24 THEN 'no self-driving' END AS ban, CASE WHEN fault % 10 = 1 THEN 'not shared room' WHEN fault = 40 THEN 'private room' WHEN fault = 7 THEN 'entire room' END AS room,
        CASE WHEN fault = 41 THEN 'smoking' WHEN fault = 42 THEN 'parties' END AS house, CASE WHEN fault % 9 = 7 THEN 'Italian' WHEN fault = 44 THEN 'Greek,Mexican' ELSE '' END AS wish FROM {asked}""",
    "eat_at": "SELECT city, min(name) AS first_name, max(name) AS last_name FROM {restaurants} GROUP BY city",
    "see_at": "SELECT city, min(name) AS first_name, max(name) AS last_name FROM {attractions} GROUP BY city",
    "sleep_at": "SELECT city, min(name) AS first_name, max(name) AS last_name FROM {accommodations} GROUP BY city",
    "fly_at": "SELECT origin, dest, min(number) AS number FROM {flights} GROUP BY origin, dest",
    "stations": """SELECT s.*, day, CASE WHEN day = s.days - 1 AND day % 2 = 0 THEN org WHEN day < 2 THEN c1 WHEN day < 4 THEN c2 ELSE c3 END AS here, CASE WHEN day = 0 THEN org WHEN day <= 2 THEN c1 WHEN day <= 4 THEN c2 ELSE c3 END AS last_city
        FROM {asked} s JOIN {moments} m ON m.days = s.days""",
    "cells": """SELECT t.*, day > 0 AND day < days - 1 AND day % 2 = 1 AS stays, day = 0 OR day % 2 = 0 AS moves, e.first_name AS eat1, e.last_name AS eat2, v.first_name AS see1, v.last_name AS see2, p.first_name AS bed1, p.last_name AS bed2, f.number AS flight
        FROM {stations} t LEFT JOIN {eat_at} e ON e.city = here LEFT JOIN {see_at} v ON v.city = here LEFT JOIN {sleep_at} p ON p.city = here LEFT JOIN {fly_at} f ON f.origin = last_city AND f.dest = here""",
    "plans": """SELECT query_id, day, CASE WHEN fault = 13 AND day = 1 THEN 7 ELSE day + 1 END AS days,
        CASE WHEN fault = 15 AND day = 1 THEN 'from nowhere' WHEN fault = 16 AND day = 1 THEN '' WHEN fault = 46 AND day = 1 THEN 'Atlantis' WHEN fault = 47 AND day = 1 THEN 'NATION_' || CAST((k1 + 1) % 25 AS STRING)
          WHEN fault = 48 AND day = 3 THEN c1 WHEN fault = 51 AND day = 0 THEN 'from ' || c3 || ' to ' || here WHEN moves THEN 'from ' || last_city || ' to ' || here ELSE here END AS current_city,
        CASE WHEN fault = 44 OR NOT moves THEN '-' WHEN fault = 17 AND day = 0 THEN 'Bus, from ' || last_city || ' to ' || here WHEN fault = 18 AND day = 0 THEN '-' WHEN fault = 21 AND day = 0 THEN 'Taxi' WHEN fault = 19 AND day = 0 THEN 'Flight Number: F0, from ' || last_city || ' to ' || here
          WHEN fault IN (22, 24) AND day = 0 THEN 'Self-driving, from ' || last_city || ' to ' || here
          WHEN flight IS NOT NULL AND (day = 0 OR day = days - 1 OR fault % 2 = 0) THEN 'Flight Number: ' || flight || ', from ' || last_city || ' to ' || here || ', Departure Time: 08:00'
          WHEN fault % 4 = 3 THEN 'Self-driving, from ' || last_city || ' to ' || here ELSE 'Taxi, from ' || last_city || ' to ' || here END AS transportation,
        CASE WHEN fault = 14 AND day = 1 THEN NULL WHEN fault = 44 OR moves THEN '-' WHEN fault = 25 AND day = 1 THEN eat1 || ', ' || here || '; ' || eat2 || ', ' || here WHEN fault = 26 AND day = 1 THEN 'Canteen' WHEN fault = 27 AND day = 1 THEN 'Nowhere, ' || here
          WHEN fault = 28 AND day = 1 THEN eat1 || ', ' || here || ' (' || org || ')' WHEN fault = 30 AND day = 1 THEN '-' WHEN fault = 49 THEN substr(eat1, 3, 14) || ', ' || here WHEN fault = 50 THEN upper(eat1) || ', ' || lower(here)
          WHEN fault = 52 THEN substr(eat1, 17, 2) || ', ' || here ELSE eat1 || ', ' || here END AS breakfast,
        CASE WHEN fault = 44 THEN '-' WHEN fault = 31 AND day = 1 THEN '-' WHEN day = days - 1 THEN '-' WHEN fault = 32 AND day = 1 THEN see1 || ', ' || here WHEN fault = 33 AND day = 1 THEN 'Square; ' || see1 || ', ' || here || ';' WHEN fault = 34 AND day = 1 THEN 'Nowhere, ' || here || ';'
          WHEN fault = 35 AND day = 1 THEN see1 || ', ' || org || ';' WHEN fault = 36 AND day = 1 THEN see2 || ', ' || here || '; ' || see2 || ', ' || here || ';' WHEN moves THEN see1 || ', ' || here || ';' ELSE see2 || ', ' || here || ';' END AS attraction,
        CASE WHEN fault = 44 OR moves THEN '-' WHEN fault = 29 AND day = 1 THEN eat1 || ', ' || here || ' ' ELSE eat2 || ', ' || here END AS lunch,
        CASE WHEN fault = 28 AND day = 1 THEN eat2 || ', ' || org WHEN fault = 29 AND day = 3 THEN eat1 || ', ' || here WHEN fault = 44 OR fault % 3 > 0 OR day = days - 1 THEN '-' WHEN moves THEN 'Nowhere at all, ' || here ELSE '-' END AS dinner,
        CASE WHEN fault = 44 OR day = days - 1 THEN '-' WHEN fault = 37 AND day = 1 THEN '-' WHEN fault = 38 AND day = 1 THEN 'Palace, ' || here WHEN fault = 39 AND day = 1 THEN bed1 || ', ' || org WHEN fault % 3 = 0 THEN bed2 || ', ' || here ELSE bed1 || ', ' || here END AS accommodation
        FROM {cells} WHERE fault <> 10 AND NOT (fault = 12 AND day = days - 1) AND (day < days OR fault = 11)""",
}
_BASE = ("nation", "region", "supplier", "part", "customer", "orders")


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """TABLES as DataFrames over the driver's files."""
    made = {t: table(spark, sf, t) for t in _BASE}
    # The days of a trip, and one past it.
    made["moments"] = made["nation"].where("n_nationkey < 3").select((F.col("n_nationkey") * 2 + 3).cast("int").alias("days")).withColumn("day", F.explode(F.sequence(F.lit(0), F.col("days"))))
    for name, text in TABLES.items():
        made[name] = spark.sql(text, **{t: df for t, df in made.items() if f"{{{t}}}" in text})
    return made


def atlas(made: dict[str, DataFrame]) -> Atlas:
    return Atlas(*(made[t] for t in ("restaurants", "accommodations", "attractions", "flights", "ground", "cities")))


def trips(made: dict[str, DataFrame]) -> DataFrame:
    """The queries that validation expects."""
    limits = F.map_filter(F.create_map(F.lit("transportation"), "ban", F.lit("room type"), "room", F.lit("house rule"), "house"), lambda _, v: v.isNotNull())
    return made["trips"].select("query_id", "org", "dest", "days", "people", "budget", "visiting_city_number", limits.alias("constraint"), F.filter(F.split("wish", ","), lambda x: x != "").alias("cuisines"))


def _sql(*names: str, then: str) -> str:
    """TABLES as common table expressions for DuckDB, those that ``names`` need, and a query over them."""
    need: list[str] = []

    def put(name: str) -> None:
        if name in TABLES and name not in need:
            for other in TABLES:
                if f"{{{other}}}" in TABLES[name]:
                    put(other)
            need.append(name)

    for name in names:
        put(name)
    known = {t: t for t in (*_BASE, "moments", *TABLES)}
    ctes = [f"{t} AS ({TABLES[t].format(**known)})" for t in need]
    moments = "moments AS (SELECT CAST(n_nationkey * 2 + 3 AS INT) AS days, CAST(unnest(range(0, n_nationkey * 2 + 4)) AS INT) AS day FROM nation WHERE n_nationkey < 3)"
    return f"WITH {', '.join([moments, *ctes])}{then}"


_ROUTE = r"'from\s+(.+?)\s+to\s+([^,]+)'"
_FILLED = "trim(coalesce({0}, '')) NOT IN ('', '-')"
_has = _FILLED.format
_PLACE = r"trim(regexp_extract(trim({0}), '^(.*),\s*([^,]+)$', {1}))"
_NAMED = r"regexp_matches(trim({0}), '^.*,\s*[^,]+$')"


def _name(cell: str) -> str:
    return f"CASE WHEN {_NAMED.format(cell)} THEN {_PLACE.format(cell, 1)} ELSE '-' END"


def _city(cell: str) -> str:
    return f"CASE WHEN {_NAMED.format(cell)} THEN trim(regexp_replace({_PLACE.format(cell, 2)}, '\\([^)]*\\).*$', '')) ELSE '-' END"


#: Days with their routes, cells with what they name, and what the reference tables know; after _sql's tables.
_LAID = f""",
d0 AS (SELECT p.*, t.days AS n_days, org, dest, people, budget, visiting_city_number, ban, room, house, wish, trim(regexp_extract(coalesce(current_city, ''), {_ROUTE}, 1)) AS o, trim(regexp_extract(coalesce(current_city, ''), {_ROUTE}, 2)) AS d,
  {_has('transportation')} AS going, trim(regexp_extract(coalesce(transportation, ''), {_ROUTE}, 1)) AS t1, trim(regexp_extract(coalesce(transportation, ''), {_ROUTE}, 2)) AS t2 FROM plans p JOIN trips t USING (query_id) WHERE day < t.days),
d AS (SELECT *, o <> '' OR d <> '' AS moving, trim(coalesce(current_city, '')) AS stay, CASE WHEN going THEN CASE WHEN contains(lower(transportation), 'taxi') THEN 'Taxi' WHEN contains(lower(transportation), 'self-driving') THEN 'Self-driving' WHEN contains(lower(transportation), 'flight') THEN 'Flight' END END AS mode,
  CASE WHEN t1 <> '' AND t2 <> '' THEN t1 ELSE o END AS from_, CASE WHEN t1 <> '' AND t2 <> '' THEN t2 ELSE d END AS to_,
  list_filter(CASE WHEN o <> '' OR d <> '' THEN [o, d] ELSE [trim(coalesce(current_city, ''))] END, lambda c: c <> '') AS cities, CASE WHEN o <> '' OR d <> '' THEN nullif(d, '') ELSE nullif(trim(coalesce(current_city, '')), '') END AS lodging FROM d0),
meals0 AS (SELECT query_id, day, cities, org, people, 0 AS pos, 'breakfast' AS field, breakfast AS cell FROM d UNION ALL SELECT query_id, day, cities, org, people, 1, 'lunch', lunch FROM d UNION ALL SELECT query_id, day, cities, org, people, 2, 'dinner', dinner FROM d),
meals AS (SELECT *, 'restaurant' AS kind, {_name('cell')} AS name, {_city('cell')} AS city FROM meals0 WHERE {_has('cell')}),
sights0 AS (SELECT query_id, day, cities, string_split(attraction, ';') AS parts FROM d WHERE {_has('attraction')}),
sights1 AS (SELECT query_id, day, cities, list_filter(list_transform(parts[1:len(parts) - 1], lambda x: trim(x)), lambda x: x <> '') AS parts FROM sights0),
sights2 AS (SELECT query_id, day, cities, unnest(parts) AS cell, unnest(range(len(parts))) AS pos FROM sights1),
sights AS (SELECT *, 'attraction' AS kind, {_name('cell')} AS name, {_city('cell')} AS city FROM sights2),
beds AS (SELECT query_id, day, people, room, house, accommodation AS cell, 'accommodation' AS kind, {_name('accommodation')} AS name, {_city('accommodation')} AS city FROM d WHERE {_has('accommodation')}),
places AS (SELECT 'restaurant' AS kind, name, city, ord FROM restaurants UNION ALL SELECT 'accommodation', name, city, ord FROM accommodations UNION ALL SELECT 'attraction', name, city, ord FROM attractions),
wanted AS (SELECT kind, name, city FROM meals UNION SELECT kind, name, city FROM sights UNION SELECT kind, name, city FROM beds),
exact AS (SELECT w.kind, w.name, w.city, max(ord) AS ord FROM wanted w JOIN places p ON p.kind = w.kind AND lower(p.name) = lower(w.name) AND lower(p.city) = lower(w.city) WHERE w.name NOT IN ('-', '') AND w.city <> '-' GROUP BY ALL),
inside AS (SELECT w.kind, w.name, w.city, min(ord) AS ord FROM wanted w JOIN places p ON p.kind = w.kind AND p.city = w.city AND contains(lower(p.name), lower(w.name)) WHERE w.name NOT IN ('-', '') AND w.city <> '-' GROUP BY ALL),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM inside WHERE (kind, name, city) NOT IN (SELECT (kind, name, city) FROM exact)),
fare AS (SELECT number, arg_min(origin, ord) AS origin, arg_min(dest, ord) AS dest, arg_min(price, ord) AS price FROM flights GROUP BY number),
legs AS (SELECT d.query_id, day, people, mode, o, d, from_, to_, nullif(regexp_extract(transportation, 'Flight Number:\\s*(F\\d+)', 1), '') AS number FROM d WHERE going),
eaten AS (SELECT m.*, r.cost, r.cuisines FROM meals m LEFT JOIN found f ON f.kind = m.kind AND f.name = m.name AND f.city = m.city LEFT JOIN restaurants r ON r.ord = f.ord),
slept AS (SELECT b.*, a.price, a.room_type, a.min_nights, a.occupancy, a.house_rules, a.ord FROM beds b LEFT JOIN found f ON f.kind = b.kind AND f.name = b.name AND f.city = b.city LEFT JOIN accommodations a ON a.ord = f.ord),
priced AS (
  SELECT query_id, 'meals' AS kind, cost * people AS cost, cost IS NULL AS unknown FROM eaten
  UNION ALL SELECT query_id, 'hotels', price * ceil(people / occupancy), price IS NULL FROM slept
  UNION ALL SELECT l.query_id, CASE WHEN mode = 'Flight' THEN 'flights' ELSE 'ground' END, CASE WHEN from_ = '' OR to_ = '' THEN NULL WHEN mode = 'Flight' THEN price * people WHEN mode = 'Self-driving' THEN floor(km * 0.05) * ceil(people / 5) WHEN mode = 'Taxi' THEN floor(km) * ceil(people / 4) END,
    mode IS NULL OR (from_ <> '' AND to_ <> '' AND CASE WHEN mode = 'Flight' THEN price IS NULL ELSE km IS NULL END) FROM legs l LEFT JOIN fare ON fare.number = l.number LEFT JOIN ground g ON g.origin = from_ AND g.dest = to_ AND g.valid),
costs AS (SELECT d.query_id, coalesce(sum(cost) FILTER (kind = 'flights'), 0.0) AS flights, coalesce(sum(cost) FILTER (kind = 'meals'), 0.0) AS meals, coalesce(sum(cost) FILTER (kind = 'hotels'), 0.0) AS hotels, coalesce(sum(cost) FILTER (kind = 'ground'), 0.0) AS ground, count(*) FILTER (unknown) AS unknown
  FROM (SELECT DISTINCT query_id FROM d) d LEFT JOIN priced USING (query_id) GROUP BY d.query_id)"""

_KEYS = ("days", "current_city", "transportation", "breakfast", "attraction", "lunch", "dinner", "accommodation")
_LACKS = " OR ".join(f"{k} IS NULL" for k in _KEYS)
_SAID = " + ".join(f"CASE WHEN {_has(f'CAST({k} AS VARCHAR)')} THEN 1 ELSE 0 END" for k in _KEYS)


def _day(test: str, code: str, field: str) -> str:
    return f"SELECT query_id, '{code}' AS code, day, {field} AS field FROM d WHERE {test}"


_RULES = f"""{_LAID},
lists AS (SELECT query_id, flatten(list(CASE WHEN moving THEN [o, d] WHEN lodging IS NOT NULL THEN [lodging] ELSE [] END ORDER BY day)) AS l FROM d GROUP BY query_id),
spots AS (SELECT query_id, len(l) AS n, unnest(l) AS city, unnest(range(len(l))) AS pos FROM lists),
marked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - row_number() OVER (PARTITION BY query_id, city ORDER BY pos) AS island FROM spots),
blocks AS (SELECT query_id, n, city, island, min(pos) AS first, count(*) AS length FROM marked GROUP BY ALL),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id, city ORDER BY first) > 1 AS seen FROM blocks),
bad AS (SELECT query_id FROM lists WHERE len(l) < 3 UNION SELECT query_id FROM again WHERE first > 0 AND first < n - 1 AND (length = 1 OR seen)),
known AS (SELECT s.*, c.state, c.covered, c.name, q.dest, q.org, q.days AS n_days, q.visiting_city_number FROM spots s JOIN trips q USING (query_id) LEFT JOIN cities c ON c.name = s.city WHERE s.city <> ''),
away AS (SELECT query_id, min(pos) AS pos FROM known WHERE n_days > 3 AND pos > 0 AND pos < n - 1 AND state <> '' AND state <> dest GROUP BY query_id),
nights AS (SELECT query_id, day, coalesce(accommodation, '-') AS cell, row_number() OVER (PARTITION BY query_id ORDER BY day) - row_number() OVER (PARTITION BY query_id, coalesce(accommodation, '-') ORDER BY day) AS island FROM d),
stays AS (SELECT query_id, cell, island, min(day) AS day, count(*) AS length FROM nights GROUP BY ALL),
single AS (SELECT * FROM eaten WHERE NOT contains(cell, ';')),
served AS (SELECT *, row_number() OVER (PARTITION BY query_id, trim(cell) ORDER BY day, pos) AS nth FROM single WHERE cost IS NOT NULL),
seen AS (SELECT s.*, f.ord, row_number() OVER (PARTITION BY s.query_id, cell ORDER BY day, pos) AS nth FROM sights s LEFT JOIN found f ON f.kind = s.kind AND f.name = s.name AND f.city = s.city WHERE s.name <> '-'),
wishes AS (SELECT query_id, unnest(string_split(wish, ',')) AS wish FROM trips WHERE wish <> '' AND query_id IN (SELECT query_id FROM d)),
issues AS (
  SELECT query_id, 'plan.empty' AS code, CAST(NULL AS INT) AS day, CAST(NULL AS VARCHAR) AS field FROM trips WHERE query_id NOT IN (SELECT query_id FROM plans)
  UNION ALL SELECT query_id, 'days.count', NULL, NULL FROM (SELECT query_id, count(*) AS n FROM plans GROUP BY query_id) JOIN trips USING (query_id) WHERE n <> days
  UNION ALL {_day('days IS DISTINCT FROM day + 1', 'days.seq', "'days'")}
  UNION ALL {_day(_LACKS, 'day.keys', 'NULL')}
  UNION ALL {_day(f"NOT ({_LACKS}) AND NOT moving AND (contains(current_city, 'from ') OR contains(current_city, ' to '))", 'current_city.malformed', "'current_city'")}
  UNION ALL {_day(f"NOT ({_LACKS}) AND NOT moving AND stay = ''", 'current_city.empty', "'current_city'")}
  UNION ALL {_day('going AND mode IS NULL', 'transport.template', "'transportation'")}
  UNION ALL {_day('NOT going AND moving', 'transport.missing', "'transportation'")}
  UNION ALL {_day("going AND ((ban = 'no flight' AND contains(transportation, 'Flight')) OR (ban = 'no self-driving' AND contains(transportation, 'Self-driving')))", 'constraint.transport', "'transportation'")}
  UNION ALL SELECT query_id, 'transport.endpoint_mismatch', day, 'transportation' FROM (SELECT query_id, day, transportation, unnest(cities) AS c FROM d WHERE going) WHERE NOT contains(transportation, c)
  UNION ALL SELECT query_id, 'completeness.meal', day, field FROM meals0 WHERE NOT ({_has('cell')}) AND len(cities) < 2
  UNION ALL {_day(f"NOT ({_has('attraction')}) AND len(cities) < 2", 'completeness.attraction', "'attraction'")}
  UNION ALL {_day(f"{_has('attraction')} AND NOT ends_with(trim(attraction), ';')", 'attraction.format', "'attraction'")}
  UNION ALL {_day(f"NOT ({_has('accommodation')}) AND day <> n_days - 1", 'completeness.accommodation', "'accommodation'")}
  UNION ALL {_day(f"{_has('accommodation')} AND lodging IS NOT NULL AND NOT contains(accommodation, lodging)", 'accom.city_mismatch', "'accommodation'")}
  UNION ALL SELECT l.query_id, 'route.start', NULL, NULL FROM lists l JOIN trips q USING (query_id) LEFT JOIN d ON d.query_id = l.query_id AND d.day = 0 WHERE len(l) >= 2 AND NOT coalesce(CASE WHEN moving THEN o END = q.org, false)
  UNION ALL SELECT query_id, 'route.loop', NULL, NULL FROM lists WHERE len(l) >= 2 AND l[1] <> l[len(l)]
  UNION ALL SELECT query_id, 'route.sequence', NULL, NULL FROM bad
  UNION ALL SELECT query_id, 'route.city_invalid', pos // 2, NULL FROM known WHERE name IS NULL
  UNION ALL SELECT query_id, 'route.state', pos // 2, NULL FROM away
  UNION ALL SELECT query_id, 'city.uncovered', pos // 2, NULL FROM known WHERE pos > 0 AND pos < n - 1 AND NOT covered
  UNION ALL SELECT l.query_id, 'route.city_count', NULL, NULL FROM lists l JOIN trips q USING (query_id) LEFT JOIN (SELECT query_id, count(DISTINCT city) AS k FROM known WHERE city <> org GROUP BY query_id) USING (query_id) WHERE coalesce(k, 0) <> visiting_city_number
  UNION ALL SELECT l.query_id, 'transport.flight_not_in_graph', day, 'transportation' FROM legs l LEFT JOIN fare f ON f.number = l.number WHERE mode = 'Flight' AND NOT coalesce(f.origin = from_ AND f.dest = to_, false)
  UNION ALL SELECT l.query_id, 'transport.ground_not_in_graph', day, 'transportation' FROM legs l LEFT JOIN ground g ON g.origin = o AND g.dest = d AND g.valid WHERE mode IN ('Taxi', 'Self-driving') AND g.km IS NULL
  UNION ALL SELECT query_id, 'transport.mixed', NULL, NULL FROM legs GROUP BY query_id HAVING bool_or(coalesce(mode = 'Self-driving', false)) AND bool_or(coalesce(mode IN ('Flight', 'Taxi'), false))
  UNION ALL SELECT query_id, 'meal.multi_entity', day, field FROM eaten WHERE contains(cell, ';')
  UNION ALL SELECT query_id, 'meal.format', day, field FROM single WHERE name = '-' OR city = '-'
  UNION ALL SELECT query_id, 'meal.not_in_graph', day, field FROM single WHERE name <> '-' AND city <> '-' AND cost IS NULL
  UNION ALL SELECT query_id, 'meal.city_mismatch', day, field FROM served WHERE len(list_filter(cities, lambda c: contains(cell, c))) = 0
  UNION ALL SELECT query_id, 'meal.repeat', day, field FROM served WHERE nth > 1
  UNION ALL SELECT query_id, 'constraint.cuisine', NULL, NULL FROM wishes w WHERE NOT EXISTS (SELECT 1 FROM served s WHERE s.query_id = w.query_id AND s.city <> s.org AND contains(s.cuisines, w.wish))
  UNION ALL SELECT query_id, 'attraction.format', day, 'attraction' FROM sights WHERE name = '-' OR city = '-'
  UNION ALL SELECT query_id, 'attraction.not_in_graph', day, 'attraction' FROM seen WHERE ord IS NULL
  UNION ALL SELECT query_id, 'attraction.city_mismatch', day, 'attraction' FROM seen WHERE len(list_filter(cities, lambda c: contains(cell, c))) = 0
  UNION ALL SELECT query_id, 'attraction.repeat', day, 'attraction' FROM seen WHERE nth > 1
  UNION ALL SELECT query_id, 'accom.not_in_graph', day, 'accommodation' FROM slept WHERE ord IS NULL
  UNION ALL SELECT query_id, 'constraint.room_type', day, 'accommodation' FROM slept WHERE ord IS NOT NULL AND ((room = 'not shared room' AND room_type = 'Shared room') OR (room = 'shared room' AND room_type <> 'Shared room') OR (room = 'private room' AND room_type <> 'Private room') OR (room = 'entire room' AND room_type <> 'Entire home/apt'))
  UNION ALL SELECT query_id, 'constraint.house_rule', day, 'accommodation' FROM slept WHERE contains(house_rules, 'No ' || house)
  UNION ALL SELECT query_id, 'accom.min_nights', day, 'accommodation' FROM stays JOIN slept USING (query_id, day) WHERE length < floor(min_nights)
  UNION ALL SELECT query_id, 'completeness.absent', NULL, NULL FROM (SELECT query_id, n_days, sum({_SAID}) AS said FROM d GROUP BY ALL) WHERE said < 3 * n_days
  UNION ALL SELECT query_id, 'cost.unknown', NULL, NULL FROM costs WHERE unknown > 0
  UNION ALL SELECT query_id, 'budget.over', NULL, NULL FROM costs JOIN trips USING (query_id) WHERE flights + meals + hotels + ground > budget
)"""

_ALL = ("restaurants", "accommodations", "attractions", "flights", "ground", "cities", "trips", "plans")


@query(_sql(*_ALL, then=f"{_RULES} SELECT query_id, code, day, field, code <> 'cost.unknown' AS blocking FROM issues"))
def validate_trips(spark, sf):
    """All issues of all customers' plans."""
    made = tables(spark, sf)
    return rules.validate_plans(made["plans"], trips(made), atlas(made))


@query(_sql(*_ALL, then=f"{_LAID} SELECT *, flights + meals + hotels + ground AS total FROM costs"))
def trip_costs(spark, sf):
    """I8, K7: what all plans cost, by kind."""
    made = tables(spark, sf)
    return itinerary.plan_costs(made["plans"], trips(made), atlas(made))


@query(_sql(*_ALL, then=f"{_LAID} SELECT query_id, flights + meals + hotels + ground AS total, unknown FROM costs"))
def reported_costs(spark, sf):
    """The costs that validation finds in its one pass."""
    made = tables(spark, sf)
    return rules.plan_reports(made["plans"], trips(made), atlas(made)).where("costs is not null").select("query_id", "costs.total", "costs.unknown")


# --- I: reference tables ------------------------------------------------------------------------------


@query(_sql("flights", then=" SELECT number, count(*) AS routes, min(origin || '>' || dest) AS first FROM (SELECT DISTINCT number, origin, dest FROM flights) GROUP BY number"))
def flight_routes(spark, sf):
    """The different routes of each flight number."""
    rows = itinerary.reference_routes(tables(spark, sf)["flights"])
    return rows.select("number", F.size("routes").cast("long").alias("routes"), F.concat_ws(">", F.col("routes")[0]["origin"], F.col("routes")[0]["dest"]).alias("first"))


#: What a reader might have made of the restaurants: names cut short or wrong, some without a cost.
_READ = "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'Grill ' || s_name WHEN s_suppkey % 5 < 3 THEN upper(substr(s_name, 4, 12)) ELSE s_name END AS name, n_name AS city, '?' AS cuisines, CASE WHEN s_suppkey % 2 = 0 THEN '1' END AS cost FROM {supplier} JOIN {nations} ON s_nationkey = n_nationkey"


@query(_sql("nations", "restaurants", then=f""", r AS ({_READ.format(supplier='supplier', nations='nations')}),
met AS (SELECT r.name, r.city, arg_min(f.cuisines, ord) AS cuisines, CAST(arg_min(f.cost, ord) AS VARCHAR) AS cost FROM (SELECT DISTINCT name, city FROM r) r JOIN restaurants f ON f.city = r.city AND contains(lower(f.name), lower(r.name)) GROUP BY ALL)
SELECT DISTINCT r.name, r.city, met.cuisines, met.cost, (SELECT count(*) FROM r WHERE (name, city) NOT IN (SELECT (name, city) FROM met)) AS dropped FROM r JOIN met USING (name, city)"""))
def gated_restaurants(spark, sf):
    """Restaurants that the reference knows, with its values, and how many it doesn't."""
    made = tables(spark, sf)
    read = spark.sql(_READ, supplier=made["supplier"], nations=made["nations"])
    merged, dropped = itinerary.fidelity_gate(read, made["restaurants"], ["cuisines", "cost"])
    return merged.join(F.broadcast(dropped))


@query(_sql("flights", then=", r AS (SELECT number, CASE WHEN ord % 3 = 0 THEN dest ELSE origin END AS origin, dest FROM flights) SELECT r.* FROM r WHERE (number, origin, dest) IN (SELECT (number, origin, dest) FROM flights)"))
def gated_flights(spark, sf):
    """Flights that the reference has on the very route."""
    flights = tables(spark, sf)["flights"]
    return itinerary.gate_flights(flights.select("number", F.when(F.col("ord") % 3 == 0, F.col("dest")).otherwise(F.col("origin")).alias("origin"), "dest"), flights)


@query(_sql("flights", then=" SELECT origin, dest, arg_max(number, ord) AS number FROM flights GROUP BY origin, dest"))
def last_flights(spark, sf):
    """I4: the last flight of each route."""
    return itinerary.last_of(tables(spark, sf)["flights"], ["origin", "dest"], "ord").select("origin", "dest", "number")


_LINKS = "SELECT origin || ' (' || substr(dest, 1, 2) || ')' AS origin, ' ' || dest AS destination, CASE WHEN km > 300 THEN '1 day 2 hours' WHEN valid THEN '2 hours' ELSE '' END AS duration, CASE WHEN km > 700 THEN 'far' ELSE '1,' || CAST(CAST(floor(100 + km) AS INT) AS STRING) || ' km' END AS distance, CAST(km * 2 AS INT) AS ord FROM {ground}"


@query(_sql("ground", then=f", d AS ({_LINKS.format(ground='ground')}) SELECT trim(split_part(origin, '(', 1)) AS origin, trim(destination) AS dest, TRY_CAST(replace(replace(distance, ' km', ''), ',', '') AS DOUBLE) AS km, duration <> '' AND distance <> 'far' AND NOT contains(duration, 'day') AS valid FROM d"))
def ground_links(spark, sf):
    """Distances and validity read from text."""
    return itinerary.ground_matrix(spark.sql(_LINKS, ground=tables(spark, sf)["ground"]))


@query(_sql(*_ALL, then=f"{_LAID} SELECT DISTINCT name, city, cuisines, cost FROM eaten"))
def known_meals(spark, sf):
    """What the reference has of every place where a plan eats."""
    made = tables(spark, sf)
    cells = itinerary.place_cells(made["plans"].join(made["trips"].select("query_id", F.col("days").alias("_n")), "query_id").where("day < _n"), itinerary.MEALS)
    return itinerary.find_places(cells.select("name", "city"), made["restaurants"], ["cuisines", "cost"]).select("name", "city", "found.cuisines", "found.cost").distinct()


@query(_sql("cities", then=" SELECT name, state, covered FROM cities WHERE covered AND state = 'ASIA'"))
def covered_in_state(spark, sf):
    """Covered cities of a state."""
    return itinerary.covered_cities(atlas(tables(spark, sf)), "ASIA")


# --- K: the functions that users call -----------------------------------------------------------------


def _store(spark, sf) -> GraphStore:
    """The tables as typed views with located_in edges; every seventh place has none."""
    made = tables(spark, sf)
    named = lambda df, etype, **columns: df.select(F.concat(F.lit(f"{etype}::"), F.col("ord").cast("string")).alias("__id__"), F.lit(etype).alias("__type__"), F.col("ord").cast("long").alias("ord"), *(c.alias(n) for n, c in columns.items()))
    c = F.col
    views_ = {
        "Flight": named(made["flights"], "Flight", **{"Flight Number": c("number"), "FlightDate": F.concat(F.lit("2022-03-0"), (c("ord") % 9 + 1).cast("string")), "Price": c("price").cast("string"), "DepTime": F.lit("08:00"), "ArrTime": F.lit("09:00"), "OriginCityName": c("origin"), "DestCityName": c("dest")}),
        "Restaurant": named(made["restaurants"], "Restaurant", **{"Name": c("name"), "City": c("city"), "Cuisines": c("cuisines"), "Average Cost": c("cost").cast("string"), "Aggregate Rating": (c("ord") % 5).cast("string")}),
        "Accommodation": named(made["accommodations"], "Accommodation", **{"NAME": c("name"), "city": c("city"), "room type": c("room_type"), "price": c("price").cast("string"), "minimum nights": c("min_nights").cast("string"), "review rate number": (c("ord") % 6).cast("string"), "house_rules": c("house_rules"), "maximum occupancy": c("occupancy").cast("string")}),
        "City": made["cities"].select(F.concat(F.lit("City::"), "name").alias("__id__"), F.lit("City").alias("__type__"), F.substring("name", 8, 9).cast("long").alias("ord"), F.concat("name", F.lit(", "), F.substring("state", 1, 2)).alias("label"), "name", "state"),
    }
    where = lambda df, etype: df.where("ord % 7 <> 0").select(F.concat(F.lit(f"{etype}::"), F.col("ord").cast("string")).alias("src"), F.lit("located_in").alias("relation"), F.concat(F.lit("City::"), "city").alias("dst"))
    return GraphStore(views_, where(made["restaurants"], "Restaurant").union(where(made["accommodations"], "Accommodation")))


@query(_sql("flights", then="""
, f AS (SELECT *, '2022-03-0' || (ord % 9 + 1) AS day, CASE WHEN contains(origin, 'NATION_2') AND contains(dest, 'NATION_1') AND ord % 9 = 4 THEN 1 WHEN contains(origin, 'NATION_2') AND contains(dest, 'NATION_1') THEN 2 ELSE 3 END AS tier FROM flights WHERE contains(origin, 'NATION_2') OR contains(dest, 'NATION_1'))
SELECT 'Flight::' || ord AS __id__, number AS "Flight Number", price, day AS "FlightDate" FROM f WHERE tier = (SELECT min(tier) FROM f) AND price <= 200 ORDER BY price, ord LIMIT 50"""))
def flights_on_a_day(spark, sf):
    """K1: the cheapest flights between two cities on a day."""
    rows = views.search_flights(_store(spark, sf), "NATION_2", "NATION_1", "2022-03-05", 200.0)
    return rows.select("__id__", "Flight Number", F.col("Price").cast("double").alias("price"), "FlightDate")


@query(_sql("restaurants", then=" SELECT name, cost, ord % 5 AS rating FROM restaurants WHERE city = 'NATION_3' AND ord % 7 <> 0 AND len(list_intersect(list_transform(string_split(lower(cuisines), ','), lambda x: trim(x)), ['pizza', 'mexican'])) >= 1 AND cost <= 45"))
def restaurants_of_a_city(spark, sf):
    """K2: a city's restaurants by cuisine and cost."""
    rows, _ = views.find_restaurants(_store(spark, sf), " nation_3 ", ["Pizza", "Mexican"], 45.0)
    return rows.select(F.col("Name").alias("name"), F.col("Average Cost").cast("double").alias("cost"), F.col("Aggregate Rating").cast("long").alias("rating"))


@query(_sql("accommodations", then=", k AS (SELECT * FROM accommodations WHERE city = 'NATION_4' AND ord % 7 <> 0 AND price <= 90 AND occupancy >= 2 AND ord % 6 >= 2 AND contains(lower(room_type), 'private')) SELECT name, price FROM k ORDER BY price, ord LIMIT 50"))
def lodging_of_a_city(spark, sf):
    """K3: a city's lodging by price, review, room and occupancy."""
    rows, _, _ = views.find_accommodations(_store(spark, sf), "NATION_4", 90.0, 2.0, "private", 2)
    return rows.select(F.col("NAME").alias("name"), F.col("price").cast("double").alias("price"))


@query(_sql("cities", then=" SELECT name FROM cities WHERE state = 'ASIA'"))
def cities_of_a_state(spark, sf):
    """K5: the cities that name a state's code."""
    store = _store(spark, sf)
    store.views["City"] = store.view("City").withColumn("name", F.col("label"))
    return views.cities_in_state(store, "ASIA", "AS")


@query("""
WITH l AS (SELECT l_orderkey, CAST(p_retailprice AS DOUBLE) AS price, l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT l_orderkey, round(sum(price) FILTER (n % 3 = 0) * 2, 2) AS flights, round(sum(price) FILTER (n % 3 = 1) * 2, 2) AS meals, sum(floor(price * 0.05)) FILTER (n % 3 = 2) AS ground FROM l GROUP BY l_orderkey)
SELECT l_orderkey, round(coalesce(flights, 0.0) + coalesce(meals, 0.0) + coalesce(ground, 0.0), 2) AS total, round(coalesce(flights, 0.0) + coalesce(meals, 0.0) + coalesce(ground, 0.0), 2) <= 2000.01 AS within FROM s
""")
def order_budgets(spark, sf):
    """K7, K8: an order's lines as a trip for two: every third a flight, a meal or a drive; whether it stays in a budget."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 3 == k, F.col("p_retailprice").cast("double"))))
    lists = rows.groupBy("l_orderkey").agg(of(0).alias("flights"), of(1).alias("meals"), of(2).alias("legs"))
    none = F.array().cast("array<struct<price:double,nights:int,occupancy:int>>")
    total = views.trip_cost(F.col("flights"), F.col("meals"), none, F.col("legs"), F.lit(2))["total"]
    return lists.select("l_orderkey", total.alias("total")).select("l_orderkey", "total", views.check_budget(F.col("total"), F.lit(2000.0))["within"].alias("within"))
