"""The nine core operators (inventory A1-A9) over typed entity views and an edge table.

Operators take and return lazy DataFrames. Rows carry ``__id__`` and ``__type__``; ``ord`` is insertion
order, by which every limit is taken. A null value and an absent field are the same: both reject a
substring filter and count as empty text in categorical filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import any_keyword, has_text, to_num, tokens
from weftline.session import checkpointed


@dataclass
class GraphStore:
    """Typed views by entity type, and edges (src, relation, dst)."""

    views: dict[str, DataFrame]
    edges: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)
    #: The same edges laid out by their target, where there are such (weftline.operators.storage).
    edges_by_dst: DataFrame | None = None

    def view(self, etype: str) -> DataFrame:
        if etype not in self.views:
            raise KeyError(f"no entity type {etype!r}; there are {sorted(self.views)}")
        return self.views[etype]

    def steps(self, end: str, relation: str | None = None) -> DataFrame:
        """node_id, next_id: the edges seen from one ``end`` (src or dst), of one relation if given."""
        edges = self.edges_by_dst if end == "dst" and self.edges_by_dst is not None else self.edges
        other = "dst" if end == "src" else "src"
        return (edges if relation is None else edges.where(F.col("relation") == relation)).select(F.col(end).alias("node_id"), F.col(other).alias("next_id"))

    def all_nodes(self) -> DataFrame:
        """__id__ and __type__ of every node."""
        return reduce(DataFrame.unionByName, (v.select("__id__", "__type__") for v in self.views.values()))


def _value(rows: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")


def substring_filter(rows: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    for name, wanted in (filters or {}).items():
        rows = rows.where(has_text(_value(rows, name), str(wanted)))
    return rows


def lookup_entities(store: GraphStore, etype: str, filters: Mapping[str, object] | None = None, limit: int | None = 50) -> DataFrame:
    """A1: rows of a type whose fields contain the given texts, in insertion order. ``limit`` None keeps all."""
    rows = substring_filter(store.view(etype), filters)
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def extract_runtime_slots(rows: DataFrame, text: str, slots: Sequence[str], extractor=None) -> DataFrame:
    """A2: add ``slots``, the map of matched slot names to true. ``extractor`` maps a text column to such a map."""
    if extractor is not None:
        return rows.withColumn("slots", extractor(F.col(text)))
    matched = F.filter(F.array(*(F.when(any_keyword(F.col(text), [w for w in s.split("_") if w]), F.lit(s)) for s in slots)), lambda x: x.isNotNull())
    return rows.withColumn("slots", F.map_from_arrays(matched, F.transform(matched, lambda _: F.lit(True))))


def traverse_relations(store: GraphStore, starts: DataFrame, relation: str | None, direction: str = "out", max_hops: int = 1) -> DataFrame:
    """A3: nodes within ``max_hops`` of each of ``starts`` (start_id): start_id, node_id, __type__, hops (least).

    A start is returned only if a cycle leads back to it. ``relation`` None walks any. An unknown
    direction or start gives nothing. Each hop joins the edges with the nodes that the hop before has
    found for the first time, and no other; the walk ends when there are none. Beyond one hop the new
    nodes of a hop are checkpointed; a single hop stays lazy.
    """
    steps = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}.get(direction, [])
    front = starts.select("start_id", F.col("start_id").alias("node_id")).distinct()
    if not steps or max_hops < 1:
        return front.limit(0).select("start_id", "node_id", F.lit("").alias("__type__"), F.lit(0).alias("hops"))
    found: DataFrame | None = None
    for hop in range(1, max_hops + 1):
        reached = [front.join(store.steps(a, relation), "node_id").select("start_id", F.col("next_id").alias("node_id")) for a, _ in steps]
        new = reduce(DataFrame.union, reached).distinct()
        if found is not None:
            new = new.join(found, ["start_id", "node_id"], "left_anti")
        new = new.withColumn("hops", F.lit(hop))
        if hop < max_hops:
            new = checkpointed(new)
            if new.isEmpty():
                break
            front = new.where("node_id != start_id").select("start_id", "node_id")  # a start has been walked from
        found = new if found is None else found.unionByName(new)
    found = new if found is None else found
    return found.join(store.all_nodes().withColumnRenamed("__id__", "node_id"), "node_id", "left").select("start_id", "node_id", "__type__", "hops")


def project_properties(rows: DataFrame, props: Sequence[str]) -> DataFrame:
    """A4: ids, types and the listed fields; a missing field is null."""
    return rows.select("__id__", "__type__", *(_value(rows, p).alias(p) for p in props if p not in ("__id__", "__type__")))


def filter_categorical(rows: DataFrame, name: str, values: Sequence[str], mode: str = "any") -> DataFrame:
    """A5: rows whose field contains any or all of the texts, or none of them (any other mode)."""
    tests = [has_text(F.coalesce(_value(rows, name).cast("string"), F.lit("")), v) for v in values]
    if mode == "all":
        return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    some = reduce(lambda a, b: a | b, tests, F.lit(False))
    return rows.where(some if mode == "any" else ~some)


def filter_relation_connected(rows: DataFrame, store: GraphStore, via: str, target_etype: str = "", target_filter: Mapping[str, object] | None = None) -> DataFrame:
    """Rows with an out edge ``via`` to a target of the type whose fields contain the texts; each row once."""
    edges = store.steps("dst", via).toDF("dst", "src")
    if target_etype:
        targets = substring_filter(store.view(target_etype), target_filter).select(F.col("__id__").alias("dst"))
    elif target_filter:
        targets = reduce(DataFrame.union, (substring_filter(v, target_filter).select(F.col("__id__").alias("dst")) for v in store.views.values()))
    else:
        targets = store.all_nodes().select(F.col("__id__").alias("dst"))
    hits = edges.join(targets, "dst", "left_semi").select(F.col("src").alias("__id__"))
    return rows.join(hits, "__id__", "left_semi")


_COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
}


def numeric(rows: DataFrame, name: str) -> Column:
    """A field as double: numeric and boolean columns as they are, others by A11; NaN counts as null."""
    kind = dict(rows.dtypes).get(name)
    if kind is not None and (kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")):
        value = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(value), value) if kind in ("float", "double") else value
    return to_num(_value(rows, name))


def filter_numeric(rows: DataFrame, name: str, op: str, value: float) -> DataFrame:
    """Rows whose field compares so; what isn't a number, or an unknown comparison, drops the row."""
    test = _COMPARE.get(op)
    return rows.where(test(numeric(rows, name), F.lit(float(value))) if test else F.lit(False))


def filter_set_overlap(rows: DataFrame, name: str, required: Sequence[str], min_overlap: int = 1, separators: str = "[;,]") -> DataFrame:
    """Rows whose delimited field shares at least so many whole tokens with ``required``."""
    wanted = F.array(*(F.lit(r.strip().lower()) for r in required)).cast("array<string>")
    return rows.where(F.size(F.array_intersect(tokens(_value(rows, name), separators), wanted)) >= min_overlap)


def aggregate_values(rows: DataFrame, name: str, op: str = "sum", group_by: str | None = None) -> DataFrame:
    """Count, sum, min, max or average of a field as ``value``, by ``group`` if asked.

    Without groups, count is of all rows; with groups, of rows with a number, and groups without any
    vanish. Sums and averages go through DECIMAL(38, 6), so they don't depend on row order. An unknown
    op gives null.
    """
    number = numeric(rows, name)
    exact = number.cast("decimal(32,6)")
    made = {"sum": F.sum(exact).cast("double"), "min": F.min(number), "max": F.max(number), "average": F.sum(exact).cast("double") / F.nullif(F.count(number), F.lit(0))}
    if group_by is None:
        return rows.agg((F.count("*").cast("double") if op == "count" else made.get(op, F.lit(None).cast("double"))).alias("value"))
    made["count"] = F.count(number).cast("double")
    kept = rows.where(number.isNotNull())
    return kept.groupBy(_value(rows, group_by).cast("string").alias("group")).agg(made.get(op, F.max(F.lit(None).cast("double"))).alias("value"))


#: Name, signature and meaning of each operator.
OPERATOR_REGISTRY = {
    f.__name__: f
    for f in (lookup_entities, extract_runtime_slots, traverse_relations, project_properties, filter_categorical, filter_relation_connected, filter_numeric, filter_set_overlap, aggregate_values)
}


def render_operator_docs() -> str:
    import inspect

    return "\n".join(f"{name}{inspect.signature(f)}\n    {(f.__doc__ or '').strip()}" for name, f in OPERATOR_REGISTRY.items())
