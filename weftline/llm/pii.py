"""Personal data by a semi-Markov conditional random field over exact base patterns.

Base spans follow fixed patterns and checks and always stay. The field adds spans that the patterns
miss, such as telephone numbers without a plus sign or cards with dots between groups. It works on runs:
space-joined chunks that each hold a digit or an at sign. A run's tokens are cut into segments, each
either one token outside or an entity of up to MOST_TOKENS tokens; features look at whole segments
(digit count, checksum, group shapes, separators, the word before), so dynamic programming chooses
boundaries and types jointly. Weights are learnt here by maximum likelihood from runs generated with
their labels; no corpus rows are needed. A segment without a digit or at sign can't be an entity, so
text outside runs can't change the result, and whole texts are covered.
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

from weftline.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
TRAIN_RUNS, EPOCHS, RATE, RIDGE = 700, 12, 0.3, 1e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_RUN = re.compile(r"\S+(?:\x20\S*[0-9@]\S*)*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[:\s=]*$")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind's index, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards; linear also where words have no end."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each run."""
    at = 0
    while m := _TRIGGER.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _RUN.match(text, start).end()
        yield start, end
        at = end


Features = tuple[str, ...]
Segment = tuple[int, int, int, Features]  # first token, token after the last, kind, features


def _shape(digit_groups: list[int], marks: set[str], body: str, digits: str, kind: int) -> Features:
    n = len(digits)
    name = KINDS[kind]
    out = [name, f"{name} marks {''.join(sorted(marks))}"]
    if kind == 0:
        local, _, domain = body.partition("@")
        end = domain.rpartition(".")[2]
        out += [f"email dots {min(domain.count('.'), 3)}", f"email end {'letters' if end.isalpha() and 2 <= len(end) <= 10 else 'other'}", f"email local {min(len(local), 3)}"]
    elif kind == 1:
        parts = [p for p in re.split(r"[^0-9]+", body) if p]
        out += [f"ip parts {min(len(parts), 6)}", f"ip range {all(int(p[:6]) <= 255 for p in parts)}"]
    elif kind == 2:
        out += [f"card digits {n if 12 <= n <= 19 else 'other'}", f"card luhn {luhn(digits)}", f"card groups {len(set(digit_groups[:-1])) < 2}"]
    else:
        out += [f"phone digits {n if n <= 16 else 'many'}", f"phone groups {min(len(digit_groups), 6)}", f"phone last {digit_groups[-1] if digit_groups[-1] < 6 else 'long'}", f"phone front {body[0] if body[0] in '+(0' else 'other'}"]
    return tuple(out)


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[Segment]]:
    """Token bounds of a run and its possible entities with their features."""
    bounds = [m.span() for m in _TOKEN.finditer(text, start, end)]
    before = m.group(1).lower() if (m := _WORD_BEFORE.search(text[max(0, start - 24) : start])) else ""
    kinds = ["d" if text[s] in "0123456789" else "a" if text[s].isalpha() else text[s] for s, _ in bounds]
    out: list[Segment] = []
    for i, first in enumerate(kinds):
        if first not in "da+(":
            continue
        digits, groups, marks, ats, letters = "", [], set(), 0, 0
        for j in range(i, min(len(kinds), i + MOST_TOKENS)):
            k = kinds[j]
            if k == "d":
                piece = text[bounds[j][0] : bounds[j][1]]
                digits += piece
                groups.append(len(piece))
            elif k == "a":
                letters += 1
            else:
                marks.add(k if k in "@.-+() /_%" else "?")
                ats += k == "@"
            if "?" in marks or ats > 1 or len(digits) > 24:
                break
            if k not in "da":
                continue
            body = text[bounds[i][0] : bounds[j][1]]
            edges = (
                f"left {kinds[i - 1] if i and kinds[i - 1] in 'da.-+@_' else 'free'}",
                f"right {kinds[j + 1] if j + 1 < len(kinds) and kinds[j + 1] in 'da-@_' else 'free'}",
            )
            near = (f"word {before if i == 0 else ''}",)
            if ats and first in "da" and k in "da" and " " not in marks and "(" not in marks:
                out.append((i, j + 1, 0, _shape(groups, marks, body, digits, 0) + tuple(f"email {x}" for x in edges)))
            elif not ats and not letters and "@" not in marks and "_" not in marks and "%" not in marks:
                for kind, good in ((1, 4 <= len(digits) <= 12 and len(groups) > 2 and first == "d"), (2, 12 <= len(digits) <= 19 and first == "d"), (3, 7 <= len(digits) <= 15)):
                    if good:
                        out.append((i, j + 1, kind, _shape(groups, marks, body, digits, kind) + tuple(f"{KINDS[kind]} {x}" for x in edges + near)))
    return bounds, out


class SemiMarkovField:
    """Weights of segment features; an outside token scores 0."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def score(self, features: Features) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def decode(self, n: int, found: list[Segment]) -> list[tuple[int, int, int]]:
        """Best labelled segmentation of n tokens: its entities."""
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        ending: dict[int, list[tuple[float, Segment]]] = {}
        for s in found:
            if (w := self.score(s[3])) > 0:
                ending.setdefault(s[1], []).append((w, s))
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for w, s in ending.get(j, ()):
                if best[s[0]] + w > best[j]:
                    best[j], back[j] = best[s[0]] + w, s
        out, j = [], n
        while j:
            if back[j]:
                out.append(back[j][:3])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def expected(self, n: int, found: list[Segment]) -> list[float]:
        """Each segment's probability under the field, by forward and backward sums."""
        scores = [self.score(s[3]) for s in found]
        forward, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = back[n] = 0.0
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for w, s in zip(scores, found, strict=True):
            by_end[s[1]].append((s[0], w))
            by_start[s[0]].append((s[1], w))
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + w for i, w in by_end[j])])
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *(back[j] + w for j, w in by_start[i])])
        return [float(np.exp(forward[s[0]] + w + back[s[1]] - forward[n])) for w, s in zip(scores, found, strict=True)]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> SemiMarkovField:
        """Maximise the likelihood of labelled texts by stochastic gradient steps (AdaGrad)."""
        cases = []
        for text, gold in examples:
            want = {(s, e, k) for s, k, e in gold}
            for start, end in runs(text):
                bounds, found = segments(text, start, end)
                cases.append((len(bounds), found, [(bounds[a][0], bounds[b - 1][1], k) in want for a, b, k, _ in found]))
        order, squares = random.Random(5), {}
        for _ in range(epochs):
            order.shuffle(cases)
            for n, found, gold in cases:
                slope: dict[str, float] = {}
                for (_, _, _, features), p, g in zip(found, self.expected(n, found), gold, strict=True):
                    for f in features:
                        slope[f] = slope.get(f, 0.0) + g - p
                for f, d in slope.items():
                    d -= RIDGE * self.weights.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-2) + d * d
                    self.weights[f] = self.weights.get(f, 0.0) + RATE * d / squares[f] ** 0.5
        return self


def generated_examples(count: int = TRAIN_RUNS, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled short texts: entities in several notations, and numbers that are none."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + number(rng.choice((14, 14, 14, 13)))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = rng.choice(("", "", "-", " ", "."))
        return mark.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"0{a}/{number(7)}"))

    entity = (
        lambda: f"{word()}{rng.choice(('', '.', '_'))}{word()}{rng.choice(('', number(2)))}@{word()}.{rng.choice(('com', 'org', 'de', 'co.uk'))}",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        phone,
    )

    def other() -> str:
        wrong = number(16)
        while luhn(wrong):
            wrong = number(16)
        day, month, year = f"{rng.randint(1, 28):02}", f"{rng.randint(1, 12):02}", str(rng.randint(1950, 2030))
        return rng.choice(
            (f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{year}{month}{day}{number(6)}", f"{number(3)},{number(3)}.{number(2)}", number(rng.randint(1, 11)), wrong, f"{number(1)}.{number(2)}.{number(1)}", f"@{word()}", f"{word()}{number(4)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{number(2)}:{number(2)}:{number(2)}", f"{number(4)} {number(4)}", f"{number(3)} {number(2)} {number(5)}", f"{rng.randint(300, 999)}.{number(3)}.{number(3)}.{number(3)}")
        )

    out = []
    for _ in range(count):
        text, spans = f"{word()} ", []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice((0, 1, 2, 3, 3, 9, 9, 9))
            if kind == 3 and rng.random() < 0.4:
                text += rng.choice(("tel ", "phone ", "call ", "tel: "))
            piece = other() if kind == 9 else entity[kind]()
            if kind != 9:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += f"{piece}{rng.choice((' ', ', ', '. '))}{word()} "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained_field() -> SemiMarkovField:
    return SemiMarkovField().fit(generated_examples())


def all_spans(text: str, field: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds: none that overlaps a base span."""
    if not _TRIGGER.search(text):
        return [], []
    base, added = base_spans(text), []
    for start, end in runs(text):
        bounds, found = segments(text, start, end)
        for a, b, kind in field.decode(len(bounds), found) if found else ():
            s, e = bounds[a][0], bounds[b - 1][1]
            added.append((s, kind, e))
    if base and added:
        added = _apart(added, sorted((s, e) for s, _, e in base))
    return base, added


def _apart(added: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Of ``added``, by start, those that meet none of ``taken``, by start; one sweep."""
    out, i, reach = [], 0, -1
    for x in added:
        while i < len(taken) and taken[i][0] < x[2]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= x[0]:
            out.append(x)
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text); one row per input row.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added.
    A null text counts as empty and has no spans. Repeated rows and null ids are rows like any other;
    other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    field = trained_field()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column("text").to_pylist():
                base, added = all_spans(text, field) if text else ([], [])
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
            made = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(made, types.values(), strict=True))], ["doc_id", *types])

    # Arrow passes doc_id on as it is: through pandas a long beside a null would become a double.
    types = dict.fromkeys((f"n_{k}" for k in KINDS), pa.int64()) | {"base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()}
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")
