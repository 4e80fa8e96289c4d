"""Sandboxed plan builders (inventory L): checked source text that composes operators on DataFrames.

A function here builds a plan; it never runs for each row. A trial limits its result and is cancelled by
Spark's job tags when its time is up.
"""

from __future__ import annotations

import ast
import json
import math
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.core import OPERATOR_REGISTRY, GraphStore

#: Built-ins that checked source may call.
BUILTINS = ("abs", "all", "any", "bool", "dict", "enumerate", "float", "int", "isinstance", "len", "list", "max", "min", "range", "round", "set", "sorted", "str", "sum", "tuple", "zip")
METHODS = ("where", "filter", "select", "withColumn", "join", "groupBy", "agg", "orderBy", "limit", "distinct", "union", "unionByName", "drop", "alias", "view", "all_nodes", "lower", "upper", "strip", "split", "replace", "startswith", "endswith", "append", "extend", "get", "items", "keys", "values")
BANNED = (ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.AsyncFunctionDef, ast.ClassDef, ast.Await, ast.With, ast.Try, ast.Delete)


class SandboxError(ValueError):
    """Source text that isn't allowed."""


def check_source(source: str) -> ast.Module:
    """L1: parse, and refuse imports, private names and attributes, and calls outside the lists."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        raise SandboxError(f"not Python: {e}") from e
    own = {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}
    allowed = {*BUILTINS, *OPERATOR_REGISTRY, *own, "ceil"}
    for n in ast.walk(tree):
        if isinstance(n, BANNED):
            raise SandboxError(f"line {n.lineno}: {type(n).__name__} isn't allowed")
        if isinstance(n, ast.Attribute) and n.attr.startswith("_") or isinstance(n, ast.Name) and n.id.startswith("__"):
            raise SandboxError(f"line {n.lineno}: private names aren't allowed")
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else None
            method = n.func.attr if isinstance(n.func, ast.Attribute) else None
            column = isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == "F" and not method.endswith("udf")
            if not (name in allowed or method in METHODS or column):
                raise SandboxError(f"line {n.lineno}: a call of {name or method or 'an expression'} isn't allowed")
    return tree


def load_function(source: str, name: str) -> Callable[..., DataFrame]:
    """L2: a function of checked source, with the operators, Spark's functions as F and few built-ins around it."""
    import builtins

    space = {"__builtins__": {b: getattr(builtins, b) for b in BUILTINS}, "ceil": math.ceil, "F": F, **OPERATOR_REGISTRY}
    exec(compile(check_source(source), f"<{name}>", "exec"), space)  # noqa: S102
    if not callable(space.get(name)):
        raise SandboxError(f"the source defines no function {name}")
    return space[name]


def trial_run(function: Callable[..., DataFrame], store: GraphStore, seconds: float = 10, rows: int = 20, **arguments) -> dict:
    """L3: a dry run of at most so many rows and seconds: ok, rows, error. Its Spark jobs are cancelled when time is up."""
    result = function(store, **arguments)
    if not isinstance(result, DataFrame):
        return {"ok": False, "rows": 0, "error": "the function returned no DataFrame"}
    spark, tag = result.sparkSession, f"trial-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        got = [r.asDict(recursive=True) for r in result.limit(rows).collect()]
        json.dumps(got, default=str)
        return {"ok": True, "rows": len(got), "error": ""}
    except Exception as e:  # noqa: BLE001  whatever the plan raised is the trial's outcome
        return {"ok": False, "rows": 0, "error": str(e)[:500]}
    finally:
        timer.cancel()
        spark.removeTag(tag)


def literal_fields(source: str, known: set[str]) -> list[str]:
    """L4: text keys of subscripts and filters that name no known field."""
    found = {n.slice.value for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str)}
    return sorted(found - known)


@dataclass
class Published:
    name: str
    source: str
    docstring: str = ""
    failed: str = ""


@dataclass
class FunctionCatalog:
    """Functions by name, those that failed their trials among them."""

    functions: dict[str, Published] = field(default_factory=dict)

    def publish(self, name: str, source: str, store: GraphStore | None = None, **arguments) -> bool:
        """Add a function if it is allowed and, given a graph, its trial has rows."""
        try:
            function = load_function(source, name)
            trial = trial_run(function, store, **arguments) if store is not None else {"ok": True, "rows": 1, "error": ""}
            failed = trial["error"] or ("" if trial["rows"] else "no rows")
        except SandboxError as e:
            function, failed = None, str(e)
        self.functions[name] = Published(name, source, (function.__doc__ or "") if function else "", failed)
        return not failed

    def load(self, name: str) -> Callable[..., DataFrame]:
        entry = self.functions[name]
        if entry.failed:
            raise SandboxError(f"{name} isn't published: {entry.failed}")
        return load_function(entry.source, name)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps([asdict(p) for p in self.functions.values()], ensure_ascii=False, indent=1))

    @classmethod
    def read(cls, path: str) -> FunctionCatalog:
        return cls({p["name"]: Published(**p) for p in json.loads(Path(path).read_text())})


def compile_function(catalog: FunctionCatalog, name: str, write: Callable[[str], str], store: GraphStore, rounds: int = 3, **arguments) -> bool:
    """Ask ``write`` for a function's source, showing it what failed, until a trial has rows or the rounds are over."""
    failed = ""
    for _ in range(rounds):
        if catalog.publish(name, write(failed), store, **arguments):
            return True
        failed = catalog.functions[name].failed
    return False


def sample_arguments(rows: DataFrame, columns: list[str]) -> dict[str, object]:
    """A value of each column, for trials."""
    one = rows.select(*columns).dropna().first()
    return one.asDict() if one else {}


def parse_action(text: str) -> tuple[str, dict] | None:
    """An action line ``name[{json}]`` or ``name(key=value, ...)``: name and arguments; null if it is none."""
    import re

    m = re.search(r"(?s)([A-Za-z_]\w*)\s*\[(.*)\]\s*$", text.strip()) or re.search(r"(?s)([A-Za-z_]\w*)\s*\((.*)\)\s*$", text.strip())
    if not m:
        return None
    name, body = m[1], m[2].strip()
    try:
        made = json.loads(body or "{}")
        return (name, made) if isinstance(made, dict) else None
    except ValueError:
        pass
    try:
        call = ast.parse(f"f({body})", mode="eval").body
        return name, {k.arg: ast.literal_eval(k.value) for k in call.keywords if k.arg}
    except (SyntaxError, ValueError):
        return None


def run_tools(choose: Callable[[list[dict]], str], tools: dict[str, Callable[..., DataFrame]], steps: int = 10, rows: int = 50) -> list[dict]:
    """A bounded loop: ``choose`` reads the steps so far and names an action or "finish"; results are cut to ``rows``."""
    past: list[dict] = []
    for _ in range(steps):
        action = parse_action(choose(past))
        if action is None or action[0] == "finish":
            break
        name, arguments = action
        try:
            seen = [r.asDict(recursive=True) for r in tools[name](**arguments).limit(rows).collect()]
            past.append({"action": name, "arguments": arguments, "rows": seen})
        except Exception as e:  # noqa: BLE001  errors are observations
            past.append({"action": name, "arguments": arguments, "error": str(e)[:500]})
    return past


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Requests (role, model, messages) with ``request_id``, the hash of their JSON."""
    return requests.withColumn("request_id", F.sha2(F.to_json(F.struct("role", "model", "messages")), 256))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (role, model, messages) not in the cache, by the hash of their JSON; each once."""
    return keyed_requests(requests).dropDuplicates(["request_id"]).join(cache.select("request_id"), "request_id", "left_anti")


def within_budget(misses: DataFrame, ledger: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Misses with ``allowed``: whether the calls of a namespace, those in the ledger first, keep to the limit of its longest known prefix."""
    used = ledger.groupBy("namespace").agg(F.count("*").alias("_used"))
    limit = F.lit(None).cast("long")
    for prefix, most in sorted(limits.items(), key=lambda kv: len(kv[0])):
        limit = F.when(F.startswith("namespace", F.lit(prefix)), F.lit(most)).otherwise(limit)
    place = F.row_number().over(Window.partitionBy("namespace").orderBy("request_id"))
    counted = misses.join(used, "namespace", "left").withColumn("_place", place + F.coalesce("_used", F.lit(0)))
    return counted.withColumn("allowed", F.coalesce(F.col("_place") <= limit, F.lit(True))).drop("_used", "_place")


CALLED = "request_id string, namespace string, role string, model string, content string, prompt_tokens long, completion_tokens long, error string"


def call_models(misses: DataFrame, call: Callable[[str, str, str], tuple[str, int, int]], attempts: int = 5, wait: float = 1.0) -> DataFrame:
    """``call(role, model, messages)`` gives content and both token counts of each request.

    An error is retried after ``wait`` seconds, doubled each time and 60 at most, and the last one is kept in ``error``.
    The rows are both ledger and cache: only those with content belong in the cache. As a task may run twice, write them
    once and read them back; the number of partitions bounds the calls at a time.
    """

    def one(role: str, model: str, messages: str) -> tuple[str | None, int, int, str | None]:
        for k in range(attempts):
            try:
                return (*call(role, model, messages), None)
            except Exception as e:  # noqa: BLE001  the service's error is the row's outcome
                error = str(e)[:500]
                if k + 1 < attempts:
                    time.sleep(min(60.0, wait * 2**k))
        return None, 0, 0, error

    def batches(parts):
        for part in parts:
            got = [one(*r) for r in zip(part["role"], part["model"], part["messages"], strict=True)]
            made = pd.DataFrame(got, columns=["content", "prompt_tokens", "completion_tokens", "error"], index=part.index)
            yield pd.concat([part[["request_id", "namespace", "role", "model"]], made], axis=1)

    return misses.select("request_id", "namespace", "role", "model", "messages").mapInPandas(batches, CALLED)


def answered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with ``content`` from the cache (request_id, content); null where there is none, and a blank one counts as none."""
    filled = cache.where(F.trim("content") != "").groupBy("request_id").agg(F.max("content").alias("content"))
    return keyed_requests(requests).join(filled, "request_id", "left")
