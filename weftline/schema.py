"""Ontology schemas (inventory C): entity and relation types, axioms, and the checks on them."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # schemas can still be built from dictionaries
    yaml = None

#: The declared attribute types and axiom kinds.
DTYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.DateType(), "bool": T.BooleanType()}
AXIOMS = ("subclass", "disjoint", "domain", "range", "cardinality", "key_functional")


class SchemaError(ValueError):
    """A schema text that can't be read."""


@dataclass(frozen=True)
class Attribute:
    name: str
    dtype: str = "string"


@dataclass
class Entity:
    name: str
    primary_key: list[str]
    attributes: list[Attribute] = field(default_factory=list)
    description: str = ""
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    def canonical_attr(self, name: str) -> str | None:
        """The attribute that a source's name stands for."""
        return name if name in self.names else self.aliases.get(name)

    def struct(self) -> T.StructType:
        """The type of this entity's view."""
        return T.StructType([T.StructField(a.name, DTYPES[a.dtype]) for a in self.attributes])


@dataclass
class Relation:
    name: str
    domains: list[str]
    ranges: list[str]
    functional: bool = False
    inverse_of: str | None = None
    description: str = ""
    derive: dict | None = None


@dataclass
class Axiom:
    kind: str
    params: dict


def _names(value: object) -> list[str]:
    return [str(v).strip() for v in ([value] if isinstance(value, str) else value or []) if str(v).strip()]


@dataclass
class Schema:
    entities: list[Entity] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    axioms: list[Axiom] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def entity(self, name: str) -> Entity | None:
        return next((e for e in self.entities if e.name == name), None)

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == name), None)

    @classmethod
    def from_dict(cls, data: object) -> Schema:
        """Strict: at least one entity, a key for each, a domain and a range for each relation, known kinds."""
        if not isinstance(data, dict) or not isinstance(data.get("entity_types"), dict) or not data["entity_types"]:
            raise SchemaError("a schema is a mapping with at least one entry under entity_types")
        out = cls(meta=data.get("meta") or {})
        for name, body in data["entity_types"].items():
            if not isinstance(body, dict) or not (key := _names(body.get("primary_key"))):
                raise SchemaError(f"entity {name!r} needs a mapping with a primary_key")
            attributes = []
            for a in body.get("attributes") or []:
                if not isinstance(a, dict) or "name" not in a or a.get("dtype", "string") not in DTYPES:
                    raise SchemaError(f"entity {name!r}: an attribute has a name and one of the types {sorted(DTYPES)}, not {a!r}")
                attributes.append(Attribute(str(a["name"]).strip(), a.get("dtype", "string")))
            out.entities.append(Entity(str(name), key, attributes, str(body.get("description", "")), {str(k): str(v) for k, v in (body.get("attribute_aliases") or {}).items()}))
        for name, body in (data.get("relation_types") or {}).items():
            domains, ranges = (_names(body.get(k)) if isinstance(body, dict) else [] for k in ("domain", "range"))
            if not domains or not ranges:
                raise SchemaError(f"relation {name!r} needs a domain and a range")
            derive = body.get("derive") if isinstance(body.get("derive"), dict) else None
            out.relations.append(Relation(str(name), domains, ranges, bool(body.get("functional")), body.get("inverse_of"), str(body.get("description", "")), derive))
        for a in data.get("axioms") or []:
            if not isinstance(a, dict) or a.get("kind") not in AXIOMS:
                raise SchemaError(f"an axiom has one of the kinds {AXIOMS}, not {a!r}")
            out.axioms.append(Axiom(a["kind"], {k: v for k, v in a.items() if k != "kind"}))
        return out

    @classmethod
    def from_yaml(cls, text: str) -> Schema:
        """YAML text, with or without a code fence around it."""
        if yaml is None:
            raise SchemaError("reading YAML needs the yaml package; use from_dict")
        lines = text.strip().splitlines()
        if lines and lines[0].startswith("```"):
            lines = lines[1:-1] if lines[-1].strip() == "```" else lines[1:]
        try:
            return cls.from_dict(yaml.safe_load("\n".join(lines)))
        except yaml.YAMLError as e:
            raise SchemaError(f"not YAML: {e}") from e

    def to_dict(self) -> dict:
        one = lambda names: names[0] if len(names) == 1 else names
        entities = {
            e.name: {"description": e.description, "primary_key": e.primary_key, "attributes": [{"name": a.name, "dtype": a.dtype} for a in e.attributes]} | ({"attribute_aliases": e.aliases} if e.aliases else {}) for e in self.entities
        }
        optional = lambda r: {k: v for k, v in (("functional", r.functional), ("inverse_of", r.inverse_of), ("derive", r.derive), ("description", r.description)) if v}
        relations = {r.name: {"domain": one(r.domains), "range": one(r.ranges)} | optional(r) for r in self.relations}
        return {"meta": self.meta, "entity_types": entities, "relation_types": relations, "axioms": [{"kind": a.kind} | a.params for a in self.axioms]}

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), allow_unicode=True, sort_keys=False)

    def validate(self) -> list[str]:
        """What is named twice, missing or dangling; empty if all is well."""
        out: list[str] = []
        known, relations = {e.name for e in self.entities}, {r.name for r in self.relations}
        for what, names in (("entity", [e.name for e in self.entities]), ("relation", [r.name for r in self.relations])):
            out += [f"{what} {n} is declared twice" for n in sorted({n for n in names if names.count(n) > 1})]
        for e in self.entities:
            out += [f"{e.name}: attribute {n} is declared twice" for n in sorted({n for n in e.names if e.names.count(n) > 1})]
            out += [f"{e.name}: key {k} is no attribute" for k in e.primary_key if k not in e.names]
            out += [f"{e.name}: alias {a} stands for {n}, which is no attribute" for a, n in e.aliases.items() if n not in e.names]
            out += [f"{e.name}: alias {a} is also an attribute" for a in e.aliases if a in e.names]
        for r in self.relations:
            out += [f"{r.name}: {n} is no entity" for n in (*r.domains, *r.ranges) if n not in known]
            if r.inverse_of and r.inverse_of not in relations:
                out.append(f"{r.name}: inverse {r.inverse_of} is no relation")
        for a in self.axioms:
            named = [*_names(a.params.get("classes")), *_names(a.params.get("sub")), *_names(a.params.get("sup")), *_names(a.params.get("class")), *_names(a.params.get("entity"))]
            out += [f"axiom {a.kind}: {n} is no entity" for n in named if n not in known]
            out += [f"axiom {a.kind}: {n} is no relation" for n in _names(a.params.get("relation")) if n not in relations]
        return out

    def render_brief(self) -> str:
        """C4: one line for each entity and relation."""
        lines = [f"{e.name}[{', '.join(e.primary_key)}]: {', '.join(e.names)}" for e in self.entities]
        return "\n".join(lines + [f"{'|'.join(r.domains)} -{r.name}-> {'|'.join(r.ranges)}" for r in self.relations])


@dataclass(frozen=True)
class Finding:
    kind: str
    subject: str
    detail: str


def _ancestors(schema: Schema) -> dict[str, set[str]]:
    """Transitive closure of subclass axioms."""
    up = defaultdict(set)
    for a in schema.axioms:
        if a.kind == "subclass":
            up[a.params["sub"]].add(a.params["sup"])
    closed = {n: set(s) for n, s in up.items()}
    while True:
        more = {n: s.union(*(closed.get(x, set()) for x in s)) for n, s in closed.items()}
        if more == closed:
            return closed
        closed = more


def static_checks(schema: Schema) -> list[Finding]:
    """Subclass cycles; classes under two disjoint ones; domain or range axioms that meet a disjoint declared type."""
    up = _ancestors(schema)
    out = [Finding("cycle", n, "is a subclass of itself") for n in sorted(up) if n in up[n]]
    apart = {frozenset((x, y)) for a in schema.axioms if a.kind == "disjoint" for x in a.params["classes"] for y in a.params["classes"] if x != y}
    for n in sorted(up):
        line = sorted(up[n] | {n})
        out += [Finding("disjointness", n, f"lies under both {x} and {y}") for i, x in enumerate(line) for y in line[i + 1 :] if frozenset((x, y)) in apart]
    for a in schema.axioms:
        if a.kind in ("domain", "range") and (r := schema.relation(a.params["relation"])):
            declared = r.domains if a.kind == "domain" else r.ranges
            out += [Finding(a.kind, r.name, f"{a.params['class']} is disjoint from declared {d}") for d in declared if frozenset((a.params["class"], d)) in apart]
    return out


def check_schema(schema: Schema) -> list[Finding]:
    """Reference errors and logical findings together."""
    return [Finding("reference", "schema", e) for e in schema.validate()] + static_checks(schema)


def findings_to_feedback(findings: list[Finding]) -> str:
    return "\n".join(f"- [{f.kind}] {f.subject}: {f.detail}" for f in findings)


def whitelist_violations(entity: Entity, headers: set[str], corpus_like: bool, most: int = 6) -> list[str]:
    """Attributes of a corpus-like entity that no source has; of another entity, those beyond ``most``."""
    return [n for n in entity.names if n not in headers] if corpus_like else entity.names[most:]


def degraded(schema: Schema, headers: dict[str, set[str]]) -> Schema:
    """Without attributes that no source has and without axioms; a key that lost a part is the first attribute left."""
    out = Schema(meta=schema.meta, relations=list(schema.relations))
    for e in schema.entities:
        kept = [a for a in e.attributes if e.name not in headers or a.name in headers[e.name]]
        names = [a.name for a in kept]
        key = [k for k in e.primary_key if k in names] or names[:1] or e.primary_key
        out.entities.append(Entity(e.name, key, kept, e.description, {k: v for k, v in e.aliases.items() if v in names}))
    return out


def apply_patches(schema: Schema, patches: list[dict]) -> Schema:
    """Add, delete or modify entities and relations by name; a patch that breaks the schema is left out."""
    data = schema.to_dict()
    for p in patches:
        part, name = ("relation_types" if p.get("target") == "relation" else "entity_types"), p.get("name")
        trial = data | {part: dict(data[part])}
        if p.get("action") == "delete":
            trial[part].pop(name, None)
        else:
            trial[part][name] = (trial[part].get(name) or {}) | (p.get("body") or {})
        try:
            if not Schema.from_dict(trial).validate():
                data = trial
        except SchemaError:
            continue
    return Schema.from_dict(data)


def merge_schema(base: Schema, more: Schema) -> Schema:
    """C11: union of attributes and relations, the base's keys first; the base alone if the union has errors."""
    out = Schema(meta=base.meta, axioms=base.axioms + [a for a in more.axioms if a not in base.axioms])
    for e in base.entities:
        extra = more.entity(e.name)
        added = [a for a in extra.attributes if a.name not in e.names] if extra else []
        out.entities.append(Entity(e.name, e.primary_key, e.attributes + added, e.description, (extra.aliases if extra else {}) | e.aliases))
    out.entities += [e for e in more.entities if base.entity(e.name) is None]
    out.relations = base.relations + [r for r in more.relations if base.relation(r.name) is None]
    return base if out.validate() else out


#: The conversation schema's entity types (keys first), what a fact may touch, and relations between entities.
SKELETON_ENTITIES = {
    "人物": ("姓名", "别名", "身份"), "地点": ("名称", "类别"), "组织": ("名称", "类别"), "物品": ("名称", "类别"), "活动": ("名称", "类别"), "主题": ("名称",),
    "会话": ("序号", "日期", "星期"), "原子事实": ("编号", "陈述", "主体", "类型", "日期", "日期粒度", "日期原文", "数值", "主题", "出处"),
}
SKELETON_FACT_RELATIONS = {"归属于": "人物", "涉及人物": "人物", "涉及地点": "地点", "涉及组织": "组织", "涉及物品": "物品", "涉及活动": "活动", "属于主题": "主题", "记录于": "会话"}
SKELETON_RELATIONS = {"亲属": "人物", "朋友": "人物", "同事": "人物", "伴侣": "人物", "居住于": "地点", "就职于": "组织", "就读于": "组织", "喜爱": "活动"}
SKELETON_NUMBERS = ("序号",)


def skeleton() -> dict:
    """The conversation schema as a dictionary: facts point at what they touch, people at each other and at what they do."""
    fact, person = "原子事实", "人物"
    kind = lambda n: {"name": n, "dtype": "int" if n in SKELETON_NUMBERS else "string"}
    entities = {e: {"primary_key": [names[0]], "attributes": [kind(n) for n in names]} for e, names in SKELETON_ENTITIES.items()}
    relations = {r: {"domain": start, "range": end} for start, ends in ((fact, SKELETON_FACT_RELATIONS), (person, SKELETON_RELATIONS)) for r, end in ends.items()}
    owner = next(iter(SKELETON_FACT_RELATIONS))
    axioms = [{"kind": "disjoint", "classes": list(entities)}, {"kind": "domain", "relation": owner, "class": fact}, {"kind": "range", "relation": owner, "class": person}]
    return {"meta": {"version": "skeleton-v1"}, "entity_types": entities, "relation_types": relations, "axioms": axioms}


def load_skeleton(text: str | None = None) -> Schema:
    """The conversation schema, or that of a YAML text, checked; raises SchemaError with all that is wrong."""
    schema = Schema.from_dict(skeleton()) if text is None else Schema.from_yaml(text)
    if errors := schema.validate():
        raise SchemaError("; ".join(errors))
    return schema
