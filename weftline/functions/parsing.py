"""Structure in itinerary texts (inventory G13, G14) as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import stripped

#: The forms of routes, names and flight numbers in a plan's cells.
ROUTE_FORM = r"from\s+(.+?)\s+to\s+([^,]+)(?=[,\s]|$)"
PLACE_FORM = r"^(.*?),\s*([^,]+)(\(\w[\w\s]*\))?$"
FLIGHT_FORM = r"Flight Number:\s*(F\d+)"
BLANK = "-"


def or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def filled(value: Column) -> Column:
    """Whether a cell says something."""
    return ~stripped(or_empty(value)).isin("", BLANK)


def strip_paren(value: Column) -> Column:
    """A text up to its first parenthesis, if that closes."""
    return F.regexp_replace(or_empty(value), r"(?s)^(.*?)\([^)]*\).*$", "$1")


def route_from(value: Column) -> Column:
    return F.regexp_extract(or_empty(value), ROUTE_FORM, 1)


def route_to(value: Column) -> Column:
    return F.regexp_extract(or_empty(value), ROUTE_FORM, 2)


def place_name(value: Column) -> Column:
    """The part before the last comma of "Name, City"; "-" if it isn't one."""
    text = stripped(or_empty(value))
    return F.when(text.rlike(PLACE_FORM), stripped(F.regexp_extract(text, PLACE_FORM, 1))).otherwise(BLANK)


def place_city(value: Column) -> Column:
    text = stripped(or_empty(value))
    return F.when(text.rlike(PLACE_FORM), stripped(strip_paren(stripped(F.regexp_extract(text, PLACE_FORM, 2))))).otherwise(BLANK)


def split_attractions(value: Column) -> Column:
    """Items that end with a semicolon; what follows the last one doesn't count."""
    parts = F.split(or_empty(value), ";")
    return F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), stripped), lambda x: x != "")


def transport_mode(value: Column) -> Column:
    """Taxi before self-driving before flight; null if none is named."""
    text = F.lower(or_empty(value))
    return F.when(F.contains(text, F.lit("taxi")), "Taxi").when(F.contains(text, F.lit("self-driving")), "Self-driving").when(F.contains(text, F.lit("flight")), "Flight")


def first_flight_number(value: Column) -> Column:
    return F.nullif(F.regexp_extract(or_empty(value), FLIGHT_FORM, 1), F.lit(""))


def amount(value: Column) -> Column:
    """A price in text as double; null if it is none."""
    return F.trim(F.regexp_replace(or_empty(value), "[,$]", "")).try_cast("double")


DAY_KEYS = ("days", "current_city", "transportation", "breakfast", "attraction", "lunch", "dinner", "accommodation")
MEALS = ("breakfast", "lunch", "dinner")


def plan_days(raw: Column) -> Column:
    """A model's answer as an array of day maps: a bare list or an object's ``plan``, with text around it; null if there is none."""
    kind = "array<map<string,string>>"
    text = or_empty(raw)
    wrapped = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), f"plan {kind}")["plan"]
    bare = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), kind)
    days = F.coalesce(wrapped, bare)
    return F.when(F.size(days) > 0, days)


def scalar_cell(value: Column) -> Column:
    """A cell as text: a JSON list is unwrapped or joined with "; "; nothing in any form is "-"."""
    text = stripped(or_empty(value))
    items = F.filter(F.transform(F.from_json(text, "array<string>"), lambda x: stripped(F.coalesce(x, F.lit("")))), lambda x: ~x.isin("", "None"))
    flat = F.when(F.startswith(text, F.lit("[")) & items.isNotNull(), F.array_join(items, "; ")).otherwise(text)
    return F.when(flat.isin("", "None", "null", "-;"), BLANK).otherwise(flat)
