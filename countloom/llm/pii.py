"""Personal data: fixed patterns, and a semi-Markov conditional random field that finds further forms of the same kinds."""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, text_slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_PHONE = re.compile(r"[0-9][\x20().0-9-]*+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(digits: str) -> bool:
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; each kind leftmost and without overlaps of its own.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four runs of digits joined by single dots, each at
    most 255; card a chain of digits with at most one space or hyphen between two, 14 to 19 digits that pass Luhn; phone
    ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15 digits. What matches a pattern but fails its rule is passed over, and
    the search goes on behind it. Every scan is linear: patterns are built from runs, which are found once.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            found.append((start, EMAIL, done))
        at = text.find("@", max(at + 1, done))

    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        if all(runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] == "." for j in (i, i + 1, i + 2)):
            if all(_octet(text[a:b]) for a, b in runs[i : i + 4]):
                found.append((runs[i][0], IP, runs[i + 3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, count = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
            count += runs[j][1] - runs[j][0]
        if 14 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            found.append((runs[i][0], CARD, runs[j][1]))
        i = j + 1
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at + 1)
        end = at + 1
        if m:
            end = m.end()
            while not "0" <= text[end - 1] <= "9":
                end -= 1
            if end - at >= 4:  # a plus, a digit, at least one character between, a digit
                if 10 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                    found.append((at, PHONE, end))
            else:
                end = at + 1
        at = text.find("+", end)
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# candidates and what is known of them as a whole

_HINT = re.compile(r"[0-9@]|[\[({<] ?[aA][tT] ?[\])}>]| [dD][oO][tT] ")
_AT = re.compile(r" ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at ", re.I)
_DOT = r"(?:\.| ?[\[({<] ?(?:\.|dot) ?[\])}>] ?| dot )"
_LABEL = r"[A-Za-z0-9-]{1,24}"
_NAME = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|{_DOT}(?=[A-Za-z0-9])){{0,31}}$", re.I)
_HOST = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}", re.I)
_MARK = re.compile(_DOT, re.I)
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(rf"[ .()/-]{{1,3}}|{_DOT}", re.I)
_WORD = re.compile(r"([^\W\d_]+)[^\w]{0,3}$")
LONGEST, GROUPS = 64, 8  # of a candidate: characters, and runs of digits


def _kind_of(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c in " \t" else "n" if c.isspace() else c


def _around(text: str, start: int, end: int) -> list[str]:
    before = text[max(0, start - 2) : start]
    after = text[end : end + 2]
    word = _WORD.search(text[max(0, start - 20) : start])
    return [
        "b1" + (_kind_of(before[-1]) if before else "^"), "b2" + "".join(map(_kind_of, before)), "a1" + (_kind_of(after[0]) if after else "$"),
        "a2" + "".join(map(_kind_of, after)), "w" + (word[1].lower() if word else ""),
    ]


def _numeric(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """Candidates made of digit groups: (start, kind, end, features)."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    gaps = []
    for (_, a), (b, _) in zip(groups, groups[1:]):
        gaps.append(text[a:b] if b - a <= 9 and _GAP.fullmatch(text, a, b) else None)
    for i, (start, _) in enumerate(groups):
        digits = 0
        lead = ""
        if start and text[start - 1] in "+(":
            lead = text[start - 2 : start] if text[start - 2 : start] == "+(" else text[start - 1]
        for j in range(i, min(i + GROUPS, len(groups))):
            if j > i and gaps[j - 1] is None or groups[j][1] - start > LONGEST:
                break
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits < 4:
                continue
            end, inner = groups[j][1], gaps[i:j]
            sizes = [b - a for a, b in groups[i : j + 1]]
            flat = "".join(text[a:b] for a, b in groups[i : j + 1])
            shape = "".join(f"{n}{g}" for n, g in zip(sizes, [*inner, ""]))
            same = "same" if len(set(inner)) <= 1 else "mixed"
            if len(sizes) == 4 and max(sizes) <= 3 and all(_MARK.fullmatch(g) for g in inner):
                fits = all(_octet(text[a:b]) for a, b in groups[i : j + 1])
                zero = any(text[a] == "0" and b - a > 1 for a, b in groups[i : j + 1])
                yield start, IP, end, [f"fits{fits}", f"zero{zero}", same, "gap" + inner[0].lower(), f"small{flat[0] == '0'}", *_around(text, start, end)]
            if any(g.strip(" .()/-") for g in inner):
                continue
            if 12 <= digits <= 19 and all(len(g) == 1 and g in " -./" for g in inner):
                yield start, CARD, end, [f"luhn{luhn(flat)}", f"luhn{luhn(flat)}{digits}", "first" + flat[0], same, "gaps" + "".join(sorted(set(inner))), f"groups{len(sizes)}", "sizes" + ".".join(map(str, sizes)), *_around(text, start, end)]
            if 7 <= digits <= 15:
                for k in {0, len(lead)}:
                    whole = text[start - k : end]
                    if whole.count("(") == whole.count(")"):
                        yield start - k, PHONE, end, [f"digits{digits}", "shape" + lead[len(lead) - k :] + shape, "lead" + lead[len(lead) - k :], f"groups{len(sizes)}", f"last{sizes[-1]}", same, "gaps" + "".join(sorted(set("".join(inner)))), *_around(text, start - k, end)]


def _addresses(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """Candidates around each mark that may stand for an at sign."""
    for m in _AT.finditer(text):
        left = _NAME.search(text, max(0, m.start() - 40), m.start())
        right = _HOST.match(text, m.end(), m.end() + 120)
        if not left or not right:
            continue
        marks = [x for x in _MARK.finditer(text, m.end(), right.end())]
        starts = [left.start()] + [x.end() for x in _MARK.finditer(text, left.start(), m.start())]
        for start in starts:
            for n in range(1, len(marks) + 1):
                end = marks[n].start() if n < len(marks) else right.end()
                if end - start > LONGEST:
                    break
                top = text[marks[n - 1].end() : end]
                yield start, EMAIL, end, [
                    "at" + m[0].lower(), "dot" + marks[n - 1][0].lower(), f"marks{n}", f"all{n == len(marks)}", f"own{start == left.start()}", f"top{min(len(top), 7)}", f"letters{top.isalpha()}",
                    "at" + m[0].lower().strip() + "dot" + marks[n - 1][0].lower().strip(), f"digits{any(c.isdigit() for c in text[start : m.start()])}", *_around(text, start, end),
                ]


DIMENSIONS = 1 << 15


def candidates(text: str) -> list[tuple[int, int, int, np.ndarray]]:
    """(start, kind, end, feature places) of all candidate spans, by end; features are of the span as a whole."""
    found = [*_numeric(text), *_addresses(text)]
    hashed = [(a, k, b, np.unique(np.array([zlib.crc32(f"{k} {f}".encode()) % DIMENSIONS for f in ["bias", *fs]]))) for a, k, b, fs in found]
    return sorted(hashed, key=lambda c: (c[2], c[0], c[1]))


class Field:
    """Weights of the features and of two spans that touch, by their kinds. What lies between spans has the score 0."""

    def __init__(self, weights: np.ndarray | None = None, touch: np.ndarray | None = None):
        self.weights = np.zeros(DIMENSIONS) if weights is None else weights
        self.touch = np.zeros((4, 4)) if touch is None else touch

    def scores(self, found: list) -> list[float]:
        return [float(self.weights[c[3]].sum()) for c in found]

    def best(self, found: list) -> list[tuple[int, int, int]]:
        """The spans of the likeliest choice without overlaps; of equal ones that with fewer spans."""
        if not found:
            return []
        scores, ends = self.scores(found), {}
        places = sorted({c[0] for c in found} | {c[2] for c in found})
        free: dict[int, tuple[float, int]] = {}  # the best choice of spans that end before a place, and its last span
        value, back = [0.0] * len(found), [-1] * len(found)
        for i, c in enumerate(found):
            ends.setdefault(c[2], []).append(i)
        now = (0.0, -1)
        for place in places:
            free[place] = now
            for i in ends.get(place, ()):
                a, kind = found[i][0], found[i][1]
                top, last = free[a]
                for p in ends.get(a, ()):  # spans that touch have a weight of their own
                    touched = value[p] + self.touch[found[p][1], kind]
                    if touched > top:
                        top, last = touched, p
                value[i], back[i] = top + scores[i], last
            for i in ends.get(place, ()):
                if value[i] > now[0] + 1e-12:
                    now = (value[i], i)
        out, i = [], now[1]
        while i >= 0:
            out.append(found[i][:3])
            i = back[i]
        return out[::-1]


def _add(x: float, y: float) -> float:
    if x == -np.inf:
        return y
    top = max(x, y)
    return top + float(np.log1p(np.exp(-abs(x - y)))) if y != -np.inf else x


def likelihood(field: Field, found: list, gold: set[tuple[int, int, int]]) -> tuple[float, list[float], np.ndarray]:
    """(log probability of the gold spans, each candidate's probability, expected touches): sums over all choices."""
    scores = field.scores(found)
    places = sorted({c[0] for c in found} | {c[2] for c in found})
    into, outof = {}, {}
    for i, c in enumerate(found):
        into.setdefault(c[2], []).append(i)
        outof.setdefault(c[0], []).append(i)
    forward, left = [0.0] * len(found), {}
    # ``left``: all choices up to a place that leave what ends there out, so that touching spans are counted once
    total = 0.0
    for place in places:
        left[place] = total
        for i in into.get(place, ()):
            a, kind = found[i][0], found[i][1]
            z = left[a]
            for p in into.get(a, ()):
                z = _add(z, forward[p] + field.touch[found[p][1], kind])
            forward[i] = z + scores[i]
        for i in into.get(place, ()):
            total = _add(total, forward[i])
    backward, right, after = [0.0] * len(found), {}, 0.0
    for place in reversed(places):
        right[place] = after
        for i in outof.get(place, ()):
            b, kind = found[i][2], found[i][1]
            z = right[b]
            for q in outof.get(b, ()):
                z = _add(z, backward[q] + scores[q] + field.touch[kind, found[q][1]])
            backward[i] = z
        for i in outof.get(place, ()):
            after = _add(after, backward[i] + scores[i])
    chance = [float(np.exp(f + b - total)) for f, b in zip(forward, backward)]
    touches = np.zeros((4, 4))
    for i, c in enumerate(found):
        for q in outof.get(c[2], ()):
            touches[c[1], found[q][1]] += np.exp(forward[i] + field.touch[c[1], found[q][1]] + scores[q] + backward[q] - total)
    own = sorted(c[:3] for c in found if c[:3] in gold)
    value = sum(s for c, s in zip(found, scores) if c[:3] in gold)
    value += sum(field.touch[x[1], y[1]] for x, y in zip(own, own[1:]) if x[2] == y[0])
    return value - total, chance, touches


def learn(examples: list[tuple[str, set[tuple[int, int, int]]]], rounds: int = 4, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Field:
    """Weights by stochastic gradient ascent of the choices' log probability, steps scaled per feature."""
    field, rng = Field(), np.random.default_rng(seed)
    ready = [(found, gold) for text, gold in examples if (found := candidates(text)) and gold <= {c[:3] for c in found}]
    seen, seen_touch = np.full(DIMENSIONS, 1e-2), np.full((4, 4), 1e-2)
    for _ in range(rounds):
        for k in rng.permutation(len(ready)):
            found, gold = ready[k]
            _, chance, touches = likelihood(field, found, gold)
            step = np.zeros(DIMENSIONS) if len(found) > 50 else {}
            for c, p in zip(found, chance):
                g = (c[:3] in gold) - p
                if abs(g) > 1e-6:
                    if isinstance(step, dict):
                        for f in c[3].tolist():
                            step[f] = step.get(f, 0.0) + g
                    else:
                        step[c[3]] += g
            places = np.array(sorted(step), np.int64) if isinstance(step, dict) else np.flatnonzero(step)
            if len(places):
                g = np.array([step[p] for p in places.tolist()]) - decay * field.weights[places]
                seen[places] += g * g
                field.weights[places] += rate * g / np.sqrt(seen[places])
            own = sorted(gold)
            for x, y in zip(own, own[1:]):
                if x[2] == y[0]:
                    touches[x[1], y[1]] -= 1.0
            if touches.any():
                seen_touch += touches * touches
                field.touch -= rate * touches / np.sqrt(seen_touch)
    return field


# examples

def disguises(kind: int, span: str, rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Other ways to write a span of a kind, and near misses that are none: (text, whether it is of the kind)."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    digits = "".join(c for c in span if c.isdigit())
    if kind == EMAIL:
        at, dot = pick(("(at)", "."), ("[at]", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("{at}", "{dot}"), (" [at] ", " [dot] "), ("<at>", "."))
        name, host = span.split("@", 1)
        return [(name + at + host.replace(".", dot), True), (name + pick(" at ", "@", "@ ") + host.replace(".", pick(" ", "")), False)]
    if kind == IP:
        parts = span.split(".")
        dot = pick("[.]", " dot ", "(.)", "[dot]", " [.] ", "(dot)")
        parts_off = [str(int(rng.integers(256, 999))) if i == int(rng.integers(4)) or i == 0 else p for i, p in enumerate(parts)]
        return [(dot.join(parts), True), (dot.join(parts_off), False), (".".join(parts[:3]), False)]
    if kind == CARD:
        gap = pick(".", "/")
        cut = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        return [(gap.join(cut), True), (gap.join([wrong[i : i + 4] for i in range(0, len(wrong), 4)]), False), (wrong, False)]
    tail = digits[-10:]
    a, b, c = tail[:3], tail[3:6], tail[6:]
    form = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-10] or 1} {a} {b} {c}", f"({a}){b}-{c}", f"({a}) {b} {c}")
    miss = pick(f"{1900 + int(a) % 130}-{1 + int(b) % 12:02d}-{1 + int(c) % 28:02d}", f"{1 + int(c) % 28:02d}/{1 + int(b) % 12:02d}/{1900 + int(a) % 130}", f"{a}{b}.{c}", f"{tail}", f"{a}{b}", f"{int(a)}.{int(b)}.{int(c)}", f"{1900 + int(a) % 130}-{1900 + int(b) % 130}")
    return [(form, True), (miss, False)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings of fixed-pattern spans and of other candidates: (kind, or -1, before, span, after)."""
    for part in text_slices(batches):
        out = set()
        for text in part.column("text").to_pylist():
            if not text or not _HINT.search(text):
                continue
            base = base_spans(text)
            taken = [(a, b) for a, _, b in base]
            for a, k, b in base:
                if b - a <= LONGEST and not any(x < b and a < y and (x, y) != (a, b) for x, y in taken):
                    out.add((k, text[max(0, a - 24) : a], text[a:b], text[b : b + 16]))
            for a, b in _apart({c[:3] for c in candidates(text)}, taken):
                out.add((-1, text[max(0, a - 24) : a], text[a:b], text[b : b + 16]))
        if out:
            columns = list(zip(*sorted(out)))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=["kind", "before", "span", "after"])


def _apart(found: set, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest of the candidates that meet no taken span, without overlaps."""
    out: list[tuple[int, int]] = []
    taken, k = sorted(taken), 0
    for a, _, b in sorted(found, key=lambda c: (c[0], -c[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


def train(docs: DataFrame, quota: int = 500, text_col: str = "text") -> Field:
    """Learn from at most ``quota`` surroundings of each kind, and as many of other candidates, those of smallest hash.

    The fixed patterns of the documents themselves are the labels. Each span is also written in other forms of its kind
    and as a near miss, in its place, since the fixed patterns find the plain forms anyway. Runs one task on the sample.
    Without any span the weights stay zero, and nothing is added to the fixed patterns.
    """
    d = columns_of(docs, text_col)
    found = d.select(d[text_col].cast("string").alias("text")).mapInArrow(_examples, "kind int, before string, span string, after string").distinct()
    rank = F.expr("row_number() OVER (PARTITION BY kind ORDER BY h, before, span, after)")
    few = found.withColumn("h", F.xxhash64("before", "span", "after")).withColumn("rank", rank).where(F.col("rank") <= quota)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat([pd.DataFrame({"kind": [], "before": [], "span": [], "after": []}), *frames]).sort_values(["kind", "before", "span", "after"])
        rng, examples = np.random.default_rng(11), []
        for kind, before, span, after in part.itertuples(index=False):
            kind, at = int(kind), len(before)
            examples.append((before + span + after, {(at, kind, at + len(span))} if kind >= 0 else set()))
            for text, of_kind in disguises(kind, span, rng) if kind >= 0 else ():
                examples.append((before + text + after, {(at, kind, at + len(text))} if of_kind else set()))
        field = learn(examples)
        yield pd.DataFrame({"field": [pickle.dumps((field.weights.astype(np.float32), field.touch))]})

    row = few.select("kind", "before", "span", "after").repartition(1).mapInPandas(run, "field binary").head()
    weights, touch = pickle.loads(row["field"]) if row else (None, None)
    return Field(None if weights is None else weights.astype(np.float64), touch)


def find_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(fixed-pattern spans, all spans) of a text; what the field adds meets no fixed-pattern span."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    taken, k, free = sorted((a, b) for a, _, b in base), 0, []
    reach = 0  # spans of different kinds may overlap: the furthest end so far
    spans = []
    for a, b in taken:
        if a < reach:
            spans[-1] = (spans[-1][0], max(b, reach))
        else:
            spans.append((a, b))
        reach = spans[-1][1]
    for c in sorted(candidates(text), key=lambda c: c[0]):
        while k < len(spans) and spans[k][1] <= c[0]:
            k += 1
        if k == len(spans) or spans[k][0] >= c[2]:
            free.append(c)
    return base, sorted(base + field.best(sorted(free, key=lambda c: (c[2], c[0], c[1]))))


def find_private(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The four counts and the hash are of the fixed patterns (``base_spans``); ``spans`` has them and what the field adds,
    as kind:start:end in code points, end exclusive, by start and then kind; n_spans counts these. A null text is empty.
    Ids may be null or repeat; further columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # one number per feature place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = ([], [])
        for part in text_slices(batches):
            found = [find_spans(t, shared.value) if t else nothing for t in part.column("text").to_pylist()]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
            hashes = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.record_batch(
                [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array([joined(every) for _, every in found], pa.string()), pa.array([len(every) for _, every in found], pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"],
            )

    d = columns_of(docs, id_col, text_col)
    d = d.select(d[id_col].cast("long").alias("doc_id"), d[text_col].cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")
