"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns and checks. Around the digits and
signs that they leave over, a semi-Markov field scores whole candidate segments: features of the
span as a whole (digits, separators, groups, checksum, neighbours) times weights per type. A
dynamic program over segments of bounded length chooses boundaries and types together; tokens
outside cost nothing. Segments are kept where they beat the empty labelling by ``margin``.

The weights are trained here by maximum likelihood (forward and backward sums over all
segmentations) on stretches around base spans of a bounded sample of documents. Copies in which
an international prefix or the separators are changed teach the forms that the patterns miss;
numbers that are no personal data teach the rest.

Each text is handled whole where it is read. Null texts count as empty. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm import common

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS, GAP_CHARS = 20, 64, 12
SAMPLE_DOCS, EPOCHS, MARGIN = 1500, 12, 2.0
#: Bounds of the training set: examples per type, stretches without personal data, and their length.
PER_KIND, NEGATIVES, TRAIN_CHARS = 60, 240, 400

# Fixed patterns of the base spans. A run of digits that fails from its first digit fails from
# every later one, so looking back for a digit changes nothing but the time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[A-Za-z0-9À-￿]+|[^\S\n]+|.|\n")
_TRIGGER = re.compile(r"[0-9@](?:[^\n]{0,12}?[0-9@])*")
_CUE = re.compile(r"(?i)\b(mail|e-mail|email|contact|ip|host|addr|address|card|visa|account|phone|tel|call|fax|mobile)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order. Emails are found from their signs: the local part is
    the longest run before one, so a failing run is read once, not from each of its letters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def features(span: str, before: str, after: str) -> list[float]:
    """Features of a whole segment and of the characters and cue words around it."""
    digits = _digits(span)
    n, groups = len(digits), re.findall(r"[0-9]+", span)
    letters, signs = sum(c.isalpha() for c in span), span.count("@")
    dots, dashes, spaces = span.count("."), span.count("-"), span.count(" ")
    left, right = before[-1:], after[:1]
    cue = _CUE.findall(before[-24:].lower())
    word = cue[-1] if cue else ""
    return [
        1.0, float(signs == 1), float(signs == 1 and letters > 3 and re.search(r"@[\w-]+(\.[\w-]+)+$", span) is not None),
        float(n < 7), float(7 <= n <= 9), float(n == 10), float(n == 11), float(12 <= n <= 13), float(14 <= n <= 19), float(n > 19),
        float(letters == 0), float(letters > 0 and signs == 0), float(span[0] == "+"), float(span[0] == "("),
        float(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span) is not None and all(map(_small, groups))),
        float(dots == 0), float(dots in (1, 2)), float(dots > 3), float(dashes in (1, 2, 3)), float(spaces in (1, 2, 3)), float(spaces > 3),
        float(n >= 12 and luhn(digits)), float(n >= 12 and not luhn(digits)),
        float(len(groups) == 1), float(len(groups) == 4 and {len(g) for g in groups} == {4}),
        float(len(groups) in (3, 4) and len(groups[-1]) == 4 and len(groups[-2]) == 3),
        float(re.search(r"[^A-Za-z0-9@._%+() -]", span) is not None), float(re.search(r"[ ().-]{3,}", span) is not None),
        float(re.fullmatch(r"(19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)?[0-9]{2}", span) is not None),
        float(left.isalnum()), float(left in "+@.-_%/=#" and left != ""), float(right.isalnum()), float(right in "@-_%/=" and right != ""),
        float(word in ("mail", "e-mail", "email", "contact")), float(word in ("ip", "host", "addr", "address")),
        float(word in ("card", "visa", "account")), float(word in ("phone", "tel", "call", "fax", "mobile")),
    ]


N_FEATURES = len(features("1", "", ""))


class Lattice:
    """Tokens of a stretch and its candidate segments with their features, or, given weights, scores:
    those of a long stretch are computed in blocks, so features never pile up."""

    def __init__(self, text: str, start: int, end: int, closed: list[tuple[int, int]],
                 weights: np.ndarray | None = None) -> None:
        self.bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
        tokens = [text[a:b] for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
        self.n, self.segments, rows, done = len(tokens), [], [], []
        for i, first in enumerate(tokens):
            if not (first[0].isalnum() or first in "+("):
                continue
            seen, signs = 0, 0
            for j in range(i, min(self.n, i + MAX_TOKENS)):
                if tokens[j] == "\n" or self.bounds[j + 1] - self.bounds[i] > MAX_CHARS:
                    break
                if any(a < self.bounds[j + 1] and self.bounds[j] < b for a, b in closed):
                    break
                seen += len(_digits(tokens[j]))
                signs += tokens[j] == "@"
                if tokens[j][-1].isalnum() and (seen >= 4 or signs):
                    a, b = self.bounds[i], self.bounds[j + 1]
                    self.segments.append((i, j + 1))
                    rows.append(features(text[a:b], text[max(0, a - 24):a], text[b:b + 4]))
            if weights is not None and len(rows) >= 2048:
                done.append(np.array(rows) @ weights.T)
                rows = []
        self.x = np.array(rows, dtype=np.float64).reshape(len(rows), N_FEATURES)
        if weights is not None:
            self.scores = np.concatenate([*done, self.x @ weights.T])

    def best(self, margin: float) -> list[tuple[int, int, int]]:
        """The best segmentation: (start, kind, end) in the text."""
        scores = self.scores - margin
        value, back = [0.0] * (self.n + 1), [None] * (self.n + 1)
        by_end: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(self.segments):
            by_end.setdefault(j, []).append(k)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1]
            for k in by_end.get(j, ()):
                kind = int(scores[k].argmax())
                if value[self.segments[k][0]] + scores[k, kind] > value[j]:
                    value[j], back[j] = value[self.segments[k][0]] + scores[k, kind], (k, kind)
        out, j = [], self.n
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            k, kind = back[j]
            out.append((self.bounds[self.segments[k][0]], kind, self.bounds[j]))
            j = self.segments[k][0]
        return out[::-1]

    def marginals(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each candidate segment with each type, by forward and backward sums."""
        scores = self.x @ weights.T
        total = np.logaddexp.reduce(scores, axis=1)
        begins, ends = [[] for _ in range(self.n + 1)], [[] for _ in range(self.n + 1)]
        for k, (i, j) in enumerate(self.segments):
            begins[i].append((j, total[k]))
            ends[j].append((i, total[k]))
        forward, backward = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for i, s in ends[j])])
        for i in range(self.n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[j] + s for j, s in begins[i])])
        i, j = np.array(self.segments).T
        return np.exp(forward[i][:, None] + scores + backward[j][:, None] - forward[self.n])


def stretches(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a line around digits and signs, cut at words that cannot belong to a segment."""
    for m in _TRIGGER.finditer(text):
        if any(a <= m.start() and m.end() <= b for a, _, b in spans):
            continue
        start, end = m.span()
        while start > 0 and m.start() - start < 24 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and end - m.end() < 24 and not text[end].isspace():
            end += 1
        yield start, end


def variants(text: str, start: int, kind: int, end: int) -> Iterator[str]:
    """A base span in other clothes; the patterns miss these forms."""
    span = text[start:end]
    yield span
    if kind == 3:
        bare = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
        yield bare
        yield re.sub(r"\(([0-9]+)\) ", r"\1-", bare)
        yield re.sub(r"[() -]+", ".", bare).strip(".")
    if kind == 2 and span.isdigit() and len(span) == 16:
        yield ".".join(span[i:i + 4] for i in range(0, 16, 4))


def train(texts: list[str], epochs: int = EPOCHS) -> np.ndarray:
    """Weights per type and feature from texts whose base spans are the truth."""
    cases: list[tuple[Lattice, np.ndarray]] = []
    counts = {}
    for text in texts:
        spans = base_spans(text)
        for start, kind, end in spans:
            if counts.get(kind, 0) >= PER_KIND:
                continue
            counts[kind] = counts.get(kind, 0) + 1
            left, right = text[max(0, start - 16):start].rpartition("\n")[2], text[end:end + 16].partition("\n")[0]
            if re.search("[0-9@]", left + right):
                continue
            for form in variants(text, start, kind, end):
                case = Lattice(f"{left}{form}{right}", 0, len(left) + len(form) + len(right), [])
                want = np.zeros((len(case.segments), len(KINDS)))
                for k, (i, j) in enumerate(case.segments):
                    if (case.bounds[i], case.bounds[j]) == (len(left), len(left) + len(form)):
                        want[k, kind] = 1
                if want.any():
                    cases.append((case, want))
        for start, end in stretches(text, spans):
            if counts.get("none", 0) < NEGATIVES and end - start <= TRAIN_CHARS and not any(a < end and start < b for a, _, b in spans):
                case = Lattice(text, start, end, [])
                if case.segments:
                    counts["none"] = counts.get("none", 0) + 1
                    cases.append((case, np.zeros((len(case.segments), len(KINDS)))))
    for text in _NOT_PERSONAL:
        case = Lattice(text, 0, len(text), [])
        if case.segments:
            cases.append((case, np.zeros((len(case.segments), len(KINDS)))))
    weights, squares = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-2)
    weights[:, 0] = -4
    for _ in range(epochs):
        for case, want in cases:
            gradient = (want - case.marginals(weights)).T @ case.x - 1e-3 * weights
            squares += gradient ** 2
            weights += 0.3 * gradient / np.sqrt(squares)
    return weights


#: Numbers that are no personal data.
_NOT_PERSONAL = (
    "on 2024-01-15 at 10:30", "version 3.11.4 of", "pages 1204-1219", "total 1,234,567.89 EUR", "ISBN 978-3-16-148410-0",
    "sha 9f86d081884c7d659a2feaa0c55ad015", "order 20240115123", "0.123456789", "lat 52.520008 lon 13.404954", "id 1234567890",
    "12/31/1999 23:59:59", "1990-2000", "room 404-12", "x = 10000000", "timestamp 1700000000", "3.14159265358979",
)


def find(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``keep`` columns and ``spans``: array of (start, end, kind, base), by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    fields = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def of(body: str) -> list[dict]:
        spans = base_spans(body)
        found = [(s, k, e, True) for s, k, e in spans]
        closed = [(s, e) for s, _, e in spans]
        for start, end in stretches(body, spans):
            near = [x for x in closed if x[0] < end and start < x[1]]
            case = Lattice(body, start, end, near, shared.value)
            if case.segments:
                found += [(s, k, e, False) for s, k, e in case.best(margin)]
        return [{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, k, e, b in sorted(set(found))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [of(t or "") for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(spans, pa.list_(fields))], ["_row", "spans"])

    rows = common.packed(docs, keep, _text=text)
    schema = common.with_fields(rows.select("_row"), "spans array<struct<start:int,end:int,kind:string,base:boolean>>")
    return rows.mapInArrow(run, schema).select("_row.*", "spans")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> np.ndarray:
    """Trains on the ``sample`` documents of least hash of key and text that hold a digit or an at sign."""
    marked = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("_t"), F.xxhash64(key, text).alias("_h"))
    # hashes are compared first, so that tasks send numbers and only the chosen texts travel
    last = marked.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if last is None:
        return train([])
    return train([r[0] for r in marked.where(F.col("_h") <= last).dropDuplicates(["_h"]).orderBy("_h").select("_t").collect()])


def digests(docs: DataFrame) -> DataFrame:
    said = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    found = find(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        common.sha256_hex(said(base)).alias("base_sha256"), said(F.col("spans")).alias("spans"))
