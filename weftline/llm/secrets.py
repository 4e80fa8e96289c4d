"""Secret scan: candidate tokens by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more token characters, dotted parts included, or whatever of 8 or more is
assigned to a word that announces a secret. Candidates begin after an equals sign or a colon, so a name
before them is no part of them. The forest looks at a candidate's length, changes between character
classes, dictionary coverage, the path's kind and the words beside it. It is trained from labelled
findings: by default generated ones (keys in several formats and passwords as secrets; digests,
identifiers, ids, long words, paths and placeholders as false positives), or those given to ``fit_forest``.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ship

TREES, DEPTH, LEAF, TRIED = 40, 9, 4, 5
THRESHOLD = 0.5
TRAIN_FINDINGS = 4000

_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{6,})*={0,2}")
_ASSIGNED = re.compile(r"(?:secret|token|password|passwd|pwd|api[_-]?key|(?:access|private|secret|auth)[_-]key|credentials?)[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?([^\s\"'<>,;(){}]{8,})", re.I)
_BEFORE = re.compile(r"([A-Za-z][A-Za-z_-]*)?(\W{0,6})$")
_AFTER = re.compile(r"\W{0,3}([A-Za-z]+)?")

#: Syllables and words that ordinary identifiers are made of.
DICTIONARY = (
    "able action and app archive array batch block build cache chunk class client code column commit config connect content count create data "
    "default delete description document edge element encode error event example experiment export field file filter final first format function "
    "general global graph handle header height history image import index info input install instance integration item join key label language "
    "last layer length level library limit line link list load local machine main manager map master memory message method model module name network "
    "node number object offset operation option order output package page parameter parse partition path pattern person place plan point position "
    "process product profile project property query random range read record reference region release remote report request resource response result "
    "return revision row sample schema script search section select sequence server service session set setting shard simple size sort source spark "
    "split stage start state status step storage store stream string structure style support system table target task template test text time title token "
    "total transaction transform tree trigger type union unit update upload user util value variable vector version view walk window word work write "
    "ing tion ment ness ous ive ate ent ere the that with this from have"
).split()
#: Words that announce a secret, or something that only looks like one.
SECRET_WORDS = frozenset("secret token password passwd pwd key apikey api_key api-key access auth bearer credential credentials private_key client_secret aws_secret_access_key".split())
BENIGN_WORDS = frozenset("commit sha md5 sha256 hash digest checksum revision uuid id guid order invoice image example sample placeholder dummy integrity etag version serial isbn".split())

_WORDS = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))

FEATURES = ("length", "changes", "digits", "upper", "lower", "marks", "entropy", "hex", "covered", "repeated", "known_prefix", "path_kind", "secret_word", "benign_word", "assigned", "after_word", "groups")
_PREFIX = re.compile(r"(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ)")
_TEST_PATH = re.compile(r"test|spec|example|sample|fixture|mock|docs?/|\.md$|\.lock$", re.I)


def path_kind(path: str | None) -> int:
    """0 unknown, 1 tests, examples and documents, 2 other files."""
    return 0 if not path else 1 if _TEST_PATH.search(path) else 2


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate, by start; assigned values first, and runs that meet none of them."""
    out = [m.span(1) for m in _ASSIGNED.finditer(text)]
    at = 0
    for start, end in [m.span() for m in _RUN.finditer(text)]:
        while at < len(out) and out[at][1] <= start:
            at += 1
        if at == len(out) or out[at][0] >= end:
            out.insert(at, (start, end))
    return out


def finding_features(text: str, start: int, end: int, path: str | None = None) -> list[float]:
    s = text[start:end]
    n = len(s)
    classes = ["d" if c in "0123456789" else "u" if c.isupper() else "l" if c.islower() else "m" for c in s]
    counts = np.unique(np.array(list(s)), return_counts=True)[1] / n
    lowered = s.lower()
    covered = sum(m.end() - m.start() for m in _WORDS.finditer(lowered))
    m = _BEFORE.search(text, max(0, start - 40), start) if start else None
    word, marks = ((m.group(1) or "").lower().strip("_-"), m.group(2)) if m else ("", "")
    after = _AFTER.match(text, end)
    parts = set(re.split(r"[_-]", word)) | {word}
    return [
        n, sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n, classes.count("d") / n, classes.count("u") / n, classes.count("l") / n, classes.count("m") / n,
        float(-(counts * np.log2(counts)).sum()), float(all(c in "0123456789abcdef" for c in lowered)), covered / n, 1 - len(set(lowered)) / n, float(bool(_PREFIX.match(s))), path_kind(path),
        float(bool(parts & SECRET_WORDS)), float(bool(parts & BENIGN_WORDS)), float("=" in marks or ":" in marks), float(bool(after and after.group(1))), s.count("-") + s.count("_"),
    ]


class RandomForest:
    """Bootstrapped Gini trees over random features, kept as flat arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> None:
        self.count, self.depth, self.seed = trees, depth, seed
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.count):
            rows = rng.integers(0, len(x), len(x))
            size = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            work = [(0, rows)]
            while work:
                node, some = work.pop()
                value[node] = y[some].mean()
                if 2 * node + 2 >= size or len(some) < 2 * LEAF or value[node] in (0.0, 1.0):
                    continue
                best = (1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], TRIED, replace=False):
                    order = np.argsort(x[some, f], kind="stable")
                    v, hits = x[some[order], f], np.cumsum(y[some[order]])
                    left = np.arange(1, len(some))
                    spot = (v[1:] > v[:-1]) & (left >= LEAF) & (len(some) - left >= LEAF)
                    if not spot.any():
                        continue
                    a, b = hits[:-1] / left, (hits[-1] - hits[:-1]) / (len(some) - left)
                    gain = value[node] * (1 - value[node]) - (left * a * (1 - a) + (len(some) - left) * b * (1 - b)) / len(some)
                    at = int(np.where(spot, gain, -1).argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), int(f), float((v[at] + v[at + 1]) / 2))
                if best[1] >= 0:
                    feature[node], cut[node] = best[1:]
                    low = x[some, best[1]] <= best[2]
                    work += [(2 * node + 1, some[low]), (2 * node + 2, some[~low])]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > cut[node]))
            total += value[node]
        return total / max(1, len(self.trees))


def generated_findings(count: int = TRAIN_FINDINGS, seed: int = 17) -> list[tuple[str, int, int, str | None, int]]:
    """Labelled findings: text, start, end, path, whether it is a secret."""
    rng = random.Random(seed)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    secrets = (
        lambda: some(hexa, rng.choice((32, 40, 64))), lambda: some(lower + upper + digit + "+/", 40), lambda: "AKIA" + some(upper + digit, 16), lambda: "ghp_" + some(lower + upper + digit, 36),
        lambda: "sk_live_" + some(lower + upper + digit, 24), lambda: some(lower + upper + digit, rng.randint(20, 48)), lambda: "xoxb-" + some(digit, 12) + "-" + some(lower + upper + digit, 24),
        lambda: some(lower + upper + digit + "!@#$%^&*.?", rng.randint(8, 15)), lambda: some(lower + upper, rng.randint(20, 40)), lambda: ".".join(["eyJ" + some(lower + upper + digit, 20), some(lower + upper + digit, 30), some(lower + upper + digit + "_-", 30)]),
    )
    syllables = [w for w in DICTIONARY if len(w) < 5]
    benign = (
        lambda: some(hexa, rng.choice((32, 40, 64))), lambda: "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)), lambda: some(digit, rng.randint(16, 20)), lambda: "_".join(rng.choice(DICTIONARY) for _ in range(4)) + some(digit, 1),
        lambda: "/".join(rng.choice(DICTIONARY) for _ in range(5)) + some(digit, 2), lambda: some("x0", 1) * rng.randint(16, 40) + "0", lambda: "".join(rng.choice(DICTIONARY).title() for _ in range(4)) + some(digit, 2),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-" + "-".join(rng.choice(DICTIONARY) for _ in range(3)), lambda: "".join(rng.choice(DICTIONARY) for _ in range(6)) + some(digit, 1),
        lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(4, 8))), lambda: "".join(some("bcdfghlmnprst", 1) + some("aeiou", 1) + some("nrstl", rng.randint(0, 1)) for _ in range(rng.randint(7, 11))).capitalize(), lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(4, 8))).upper(),
        lambda: ".".join("".join(rng.choice(DICTIONARY) for _ in range(3)) for _ in range(3)), lambda: rng.choice(("changeme", "your_password", "placeholder", "undefined", "required", "xxxxxxxx", "example123", "os.environ", "settings.token", "self.password")),
    )
    out = []
    for _ in range(count):
        good = rng.random() < 0.5
        shape = rng.randrange(len(secrets if good else benign))
        needs = good and shape in (0, 1, 5, 7, 8)  # bare hex, letters, base64 and passwords are secrets only where a word says so
        body = (secrets if good else benign)[shape]()
        if good:  # a format of its own needs no word before it; bare hex and base64 do
            word = rng.choice(sorted(SECRET_WORDS)) if needs or rng.random() < 0.6 else rng.choice(DICTIONARY)
        else:
            word = rng.choice(sorted(BENIGN_WORDS)) if shape in (0, 1) or rng.random() < 0.5 else rng.choice([*DICTIONARY, "token", "key"])
        mark = rng.choice((' = "', "=", ": ", ":", ' "', " ") if not needs else (' = "', "=", ": ", ' = "', ":", " = "))
        front = f"{rng.choice(DICTIONARY)} {word}{mark}"
        paths = (None, None, "src/config.py", "deploy/.env", "app/settings.yml") if good else (None, None, "tests/data.py", "docs/readme.md", "src/lib.py", "package.lock")
        out.append((f'{front}{body}{rng.choice((chr(34), " ", ""))} {rng.choice(DICTIONARY)}', len(front), len(front) + len(body), rng.choice(paths), int(good)))
    return out


def fit_forest(findings: list[tuple[str, int, int, str | None, int]]) -> RandomForest:
    """A forest from labelled findings: text, start, end, path, whether it is a secret."""
    return RandomForest().fit(np.array([finding_features(t, s, e, p) for t, s, e, p, _ in findings], dtype=np.float64), np.array([y for *_, y in findings], dtype=np.float64))


@lru_cache(maxsize=1)
def trained_forest() -> RandomForest:
    return fit_forest(generated_findings())


def scan(docs: DataFrame, threshold: float = THRESHOLD, forest: RandomForest | None = None) -> DataFrame:
    """Secrets in every whole text of ``docs`` (doc_id, text, and path where there is one): one row per finding that stays.

    Returns doc_id, start, end (code points, end exclusive), length, digest (SHA-256 of the finding, which
    itself isn't shown) and score. A null or empty text has none. Repeated rows repeat their findings;
    null ids are ids like any other; other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    forest = forest or trained_forest()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, x = [], []
            for i, (text, path) in enumerate(zip(part.column("text").to_pylist(), part.column("path").to_pylist(), strict=True)):
                for start, end in candidates(text) if text else ():
                    rows.append((i, start, end, end - start, hashlib.sha256(text[start:end].encode("utf-8", "replace")).hexdigest()))
                    x.append(finding_features(text, start, end, path))
            score = forest.score(np.array(x, dtype=np.float64).reshape(-1, len(FEATURES)))
            at, *made = zip(*rows, strict=True) if rows else [()] * 5
            columns = [part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in made[:3]), pa.array(made[3], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "length", "digest", "score"]).filter(pa.array(score >= threshold))

    path = "path" if "path" in docs.columns else F.lit(None).cast("string").alias("path")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", path).mapInArrow(batches, f"doc_id {kind}, start long, end long, length long, digest string, score double")
