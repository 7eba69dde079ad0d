"""Secret scan: fixed token patterns, and strings whose characters look random.

The patterns give the base spans. The method adds strings that no pattern names: in every run of hexadecimal or
base-64 characters a window slides one character at a time; the counts of its characters, and with them its
Shannon entropy, are updated by the one that leaves and the one that enters. Windows above the limit of their
class merge into spans. An allow-list suppresses what is known to look random without being secret: words,
plain numbers, placeholder text, alphabets, declared digests and parts of addresses. It never touches base spans.
A listed word suppresses its path segment, not the whole run. Known spans are cut out of a run and the windows of
what remains are judged; a remainder of half a window or more is judged as one window, unless it names an assignment.

Defined cases: null texts count as empty; empty texts have no spans; a null ``doc_id`` and repeated rows are kept,
one result row per input row; other columns are ignored. Whole texts are scanned, of any length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices, texts

# The base patterns and their shortest secret.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class Class:
    """Candidate runs of one character class: window length and least entropy in bits per character."""
    kind: str
    run: str
    window: int
    bits: float


CLASSES = (
    Class("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    Class("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
# What a suppressed candidate holds, or what stands right before it.
ALLOWED = re.compile(r"(?i)example|sample|placeholder|dummy|x{6,}|0123456789|abcdefgh|qwertyui")
ALLOWED_BEFORE = re.compile(
    r"""(?i)(?:sha-?\d+|md5|checksum|digest|commit|etag|uuid)[\s:=\"'-]{0,3}$|(?:https?:|www\.)\S*$|/$""")


def random_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose entropy reaches ``bits``; counts change by one step at a time."""
    if len(run) < window:
        return []
    part = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    found: list[tuple[int, int]] = []
    for i, char in enumerate(run):
        if i >= window:
            gone = run[i - window]
            c = counts[gone]
            total += part[c - 1] - part[c]
            counts[gone] = c - 1
        c = counts.get(char, 0)
        total += part[c + 1] - part[c]
        counts[char] = c + 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def declared(text: str, start: int) -> bool:
    """Whether what stands before the run says that it is no secret: a digest or a part of an address."""
    return bool(ALLOWED_BEFORE.search(text, max(0, start - 100), start))


def allowed(part: str) -> bool:
    """Whether the characters are known not to be a secret: it needs letters and digits, and no listed word."""
    return mere(part) or bool(ALLOWED.search(part))


def mere(part: str) -> bool:
    """Whether letters or digits are missing."""
    return not any(c.isdigit() for c in part) or not any(c.isalpha() for c in part)


def listed_segments(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The path segments of a run that hold a listed word."""
    out = []
    for m in ALLOWED.finditer(text, start, end):
        a, b = text.rfind("/", start, m.start()) + 1 or start, text.find("/", m.end(), end)
        out.append((a, end if b < 0 else b))
    return out


def without(start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What remains of [start, end) when the spans of ``known`` are cut out."""
    left = []
    for a, b in sorted(known):
        if b > start and a < end:
            if a > start:
                left.append((start, a))
            start = max(start, b)
    return left + [(start, end)] if start < end else left


RUNS = tuple(re.compile(c.run) for c in CLASSES)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(word in low for word in WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b, _ in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def run_spans(text: str, start: int, end: int, rule: Class, known: list[tuple[int, int]],
              names: set[int]) -> list[tuple[int, int]]:
    """The random stretches of a run outside the ``known`` spans in it; ``names`` has the starts of assignments."""
    run = text[start:end]
    if mere(run) or declared(text, start):
        return []
    listed = listed_segments(text, start, end)
    if not known and not listed:
        return [(a + start, b + start) for a, b in random_windows(run, rule.window, rule.bits)]
    edges = {x for k in known for x in k}
    across = None
    out = []
    for a, b in without(start, end, known + listed):
        part, size = text[a:b], b - a
        if size >= rule.window:
            if not listed or not mere(part):
                out += [(x + a, y + a) for x, y in random_windows(part, rule.window, rule.bits)]
        elif size >= rule.window // 2 and b not in names and (a in edges or b in edges) and not allowed(part):
            if across is None:
                across = [(x + start, y + start) for x, y in random_windows(run, rule.window, rule.bits)]
            bits = rule.bits * math.log2(size) / math.log2(rule.window)
            if any(x < b and a < y for x, y in across) and random_windows(part, size, bits):
                out.append((a, b))
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed, then end; code points, end exclusive."""
    spans = base_spans(text)
    names = {a for a, _, kind in spans if kind == "assign"}
    for rule, runs in zip(CLASSES, RUNS, strict=True):
        known = apart(spans)
        ends = [b for _, b in known]
        for m in runs.finditer(text):
            inside = known[bisect_right(ends, m.start()):bisect_left(known, (m.end(),))]
            spans += [(a, b, rule.kind) for a, b in run_spans(text, *m.span(), rule, inside, names)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: array of (start, end, kind)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scan(batches):
        for b in slices(batches):
            spans = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in find_spans(t.as_py())] for t in b[1]]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(spans, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret removed]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); ``n_chars`` follows where the
    table has it. Texts without a span, null ones too, and all other columns stay as they are."""
    def clean(batches):
        at = None
        for b in slices(batches):
            at = b.schema.get_field_index("text") if at is None else at
            out = []
            for text in b[at].to_pylist():
                pieces, end = [], 0
                for a, z, _ in find_spans(text or ""):
                    if a >= end:
                        pieces += [text[end:a], mark]
                    end = max(end, z)
                out.append("".join(pieces) + text[end:] if pieces else text)
            yield b.set_column(at, b.schema.field(at), pa.array(out, pa.string()))

    cleaned = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(
            F.contains("text", F.lit(mark)), F.char_length("text")).otherwise(F.col("n_chars")).cast(
                docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def _is(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(F.size(F.filter(spans, _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_joined(F.filter(spans, _is(*BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"))
