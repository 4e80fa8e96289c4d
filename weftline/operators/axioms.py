"""Axioms over instances (inventory C6): saturation to a fixpoint, and clashes with the axioms that make them.

Subclass, inverse, domain and range axioms are steps between symbols: a class, or one end of a relation
("its source is an instance of ..."). An inverse joins one relation's source to the other's target and
back. So everything that follows from an assertion is what its symbol reaches. The symbols' closure is
found by semi-naive rounds: only pairs that are new in a round are joined with the steps again, cycles end
by themselves, and each pair keeps the shortest list of axioms that proves it. Instances then meet the
closure in one join, however long the proofs are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schema import Schema
from weftline.session import checkpointed

STEP = "from string, to string, axiom string"


def _class(name: object) -> str:
    return f"class:{name}"


def _end(end: str, relation: object) -> str:
    return f"{end}:{relation}"


def axiom_steps(spark: SparkSession, schema: Schema) -> DataFrame:
    """from, to, axiom: the steps of a schema, a row for each. A relation declared with several domains or ranges allows any of them, so those prove nothing."""
    rows: list[tuple[str, str, str]] = []
    for r in schema.relations:
        if len(r.domains) == 1:
            rows.append((_end("src", r.name), _class(r.domains[0]), f"domain: {r.name} -> {r.domains[0]}"))
        if len(r.ranges) == 1:
            rows.append((_end("dst", r.name), _class(r.ranges[0]), f"range: {r.name} -> {r.ranges[0]}"))
        if r.inverse_of:
            for a, b in ((r.name, r.inverse_of), (r.inverse_of, r.name)):
                rows += [(_end(x, a), _end(y, b), f"inverse: {r.name} <-> {r.inverse_of}") for x, y in (("src", "dst"), ("dst", "src"))]
    for a in schema.axioms:
        p = a.params
        if a.kind == "subclass":
            rows.append((_class(p["sub"]), _class(p["sup"]), f"subclass: {p['sub']} <- {p['sup']}"))
        elif a.kind in ("domain", "range"):
            rows.append((_end("src" if a.kind == "domain" else "dst", p["relation"]), _class(p["class"]), f"{a.kind}: {p['relation']} -> {p['class']}"))
    return spark.createDataFrame(sorted(set(rows)), STEP)


def saturate(steps: DataFrame) -> DataFrame:
    """from, to, proof (array of axioms): all that follows, a symbol from itself by no axiom included. Of equally short proofs the first by text stays."""
    ends = steps.select("from").union(steps.select("to")).distinct()
    known = checkpointed(ends.select("from", F.col("from").alias("to"), F.array().cast("array<string>").alias("proof")))
    new = known
    while not new.isEmpty():
        on = new.withColumnRenamed("to", "_mid").join(steps.withColumnRenamed("from", "_mid"), "_mid")
        longer = on.select("from", "to", F.concat("proof", F.array("axiom")).alias("proof"))
        new = checkpointed(longer.join(known, ["from", "to"], "left_anti").groupBy("from", "to").agg(F.min("proof").alias("proof")))
        known = known.union(new)
    return checkpointed(known)


def _short(proof: Column) -> Column:
    """Orders proofs: fewer axioms first, then by text."""
    return F.struct(F.size(proof).alias("n"), proof.alias("proof"))


def derived_types(nodes: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """node, type, proof: every class of every node, asserted (``nodes``: __id__, __type__) or derived, with its shortest proof."""
    told = nodes.select(F.col("__id__").alias("node"), F.concat(F.lit("class:"), "__type__").alias("from"))
    for end in ("src", "dst"):
        told = told.union(edges.select(F.col(end), F.concat(F.lit(f"{end}:"), "relation")))
    classes = closure.where(F.startswith("to", F.lit("class:")))
    bare = told.distinct()
    own = bare.where(F.startswith("from", F.lit("class:"))).select("node", F.col("from").alias("to"), F.array().cast("array<string>").alias("proof"))
    met = bare.join(classes, "from").select("node", "to", "proof").union(own)
    best = met.groupBy("node", "to").agg(F.min(_short(F.col("proof"))).alias("best"))
    return best.select("node", F.substring("to", len("class:") + 1, 1 << 20).alias("type"), F.col("best.proof").alias("proof"))


def derived_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """src, relation, dst, proof: asserted edges and those of inverse relations."""
    ends = closure.where(F.startswith("from", F.lit("src:")) & ~F.startswith("to", F.lit("class:")))
    turned = F.startswith("to", F.lit("dst:"))
    laws = ends.select(F.substring("from", 5, 1 << 20).alias("relation"), turned.alias("_turned"), F.substring("to", 5, 1 << 20).alias("_as"), "proof")
    met = edges.select("src", "relation", "dst").join(laws, "relation", "left")
    src, dst = (F.when(F.coalesce("_turned", F.lit(False)), F.col(b)).otherwise(F.col(a)) for a, b in (("src", "dst"), ("dst", "src")))
    rows = met.select(src.alias("src"), F.coalesce("_as", "relation").alias("relation"), dst.alias("dst"), F.coalesce("proof", F.array().cast("array<string>")).alias("proof"))
    best = rows.groupBy("src", "relation", "dst").agg(F.min(_short(F.col("proof"))).alias("best"))
    return best.select("src", "relation", "dst", F.col("best.proof").alias("proof"))


def _proved(*proofs: Column, by: Column) -> Column:
    return F.array_distinct(F.concat(*proofs, F.array(by)))


def disjoint_pairs(spark: SparkSession, schema: Schema) -> DataFrame:
    """a, b, axiom: the pairs of classes that must not share a node, a before b."""
    rows = []
    for axiom in schema.axioms:
        if axiom.kind == "disjoint":
            classes = sorted(set(map(str, axiom.params.get("classes", []))))
            rows += [(a, b, f"disjoint: {', '.join(classes)}") for i, a in enumerate(classes) for b in classes[i + 1 :]]
    return spark.createDataFrame(sorted(set(rows)), "a string, b string, axiom string")


def unsatisfiable(spark: SparkSession, schema: Schema, closure: DataFrame | None = None) -> DataFrame:
    """type, axioms: classes that can't have a node, as they follow into two disjoint ones."""
    closure = saturate(axiom_steps(spark, schema)) if closure is None else closure
    up = closure.where(F.startswith("from", F.lit("class:")) & F.startswith("to", F.lit("class:"))).select(*(F.substring(c, 7, 1 << 20).alias(c) for c in ("from", "to")), "proof")
    pairs = disjoint_pairs(spark, schema)
    left, right = up.toDF("type", "a", "_p"), up.toDF("type", "b", "_q")
    met = left.join(pairs, "a").join(right, ["type", "b"])
    found = met.groupBy("type").agg(F.min(_short(_proved(F.col("_p"), F.col("_q"), by=F.col("axiom")))).alias("best"))
    return found.select("type", F.col("best.proof").alias("axioms"))


def clashes(nodes: DataFrame, edges: DataFrame, schema: Schema) -> DataFrame:
    """node, kind, subject, axioms: what instances contradict, with the axioms that together make each clash.

    Kinds: ``disjoint`` (subject "A, B": the node is in both), ``functional`` (subject a relation: more than
    one different target) and ``cardinality`` (subject "class.relation": fewer or more targets than the class
    allows; a node without an edge has none). Repeated nodes and edges count once; null ends are left out.
    """
    spark = edges.sparkSession
    edges = edges.where("src is not null and dst is not null and relation is not null")
    nodes = nodes.where("__id__ is not null and __type__ is not null")
    closure = saturate(axiom_steps(spark, schema))
    types, links = derived_types(nodes, edges, closure), derived_edges(edges, closure)
    pairs = disjoint_pairs(spark, schema)
    both = types.toDF("node", "a", "_p").join(pairs, "a").join(types.toDF("node", "b", "_q"), ["node", "b"])
    apart = both.select("node", F.lit("disjoint").alias("kind"), F.concat_ws(", ", "a", "b").alias("subject"), _proved(F.col("_p"), F.col("_q"), by=F.col("axiom")).alias("axioms"))
    # Targets are different dst; the axioms of all of them count, as any may be derived.
    fan = links.groupBy("src", "relation").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("proof")))).alias("_how"))
    once = [r.name for r in schema.relations if r.functional]
    many = fan.where(F.col("relation").isin(once) & (F.col("n") > 1))
    several = many.select(F.col("src").alias("node"), F.lit("functional").alias("kind"), F.col("relation").alias("subject"), _proved(F.col("_how"), by=F.concat(F.lit("functional: "), "relation")).alias("axioms"))
    out = apart.union(several)
    for axiom in (a for a in schema.axioms if a.kind == "cardinality"):
        p = axiom.params
        least, most = int(p.get("min") or 0), p.get("max")
        told = f"cardinality: {p['class']}.{p['relation']} {least}..{'' if most is None else most}"
        mine = types.where(F.col("type") == str(p["class"])).select("node", "proof")
        counted = mine.join(fan.where(F.col("relation") == str(p["relation"])).select(F.col("src").alias("node"), "n", "_how"), "node", "left")
        n = F.coalesce("n", F.lit(0))
        wrong = counted.where((n < least) | (F.lit(False) if most is None else n > int(most)))
        how = F.coalesce("_how", F.array().cast("array<string>"))
        out = out.union(wrong.select("node", F.lit("cardinality").alias("kind"), F.lit(f"{p['class']}.{p['relation']}").alias("subject"), _proved(F.col("proof"), how, by=F.lit(told)).alias("axioms")))
    return out


def audited(nodes: DataFrame, edges: DataFrame, schema: Schema, most: int = 100) -> Sequence[str]:
    """Clashes as lines for whoever mends the schema, ``most`` at most, first by kind, subject and node."""
    rows = clashes(nodes, edges, schema).orderBy("kind", "subject", "node").limit(most).collect()
    return [f"[{r.kind}] {r.subject}: {r.node}; axioms: {'; '.join(r.axioms)}" for r in rows]
