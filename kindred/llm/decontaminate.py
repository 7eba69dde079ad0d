"""Benchmark decontamination by templates.

Words become canonical tokens: numbers, names (capitalised words), units and quantities turn into typed
placeholders, everything else into its lower-case form without surrounding punctuation. Windows of eight tokens are
hashed on both sides and joined; each placeholder keeps its surface as a slot. A document matches an item if it holds
enough of the item's windows and the slots are consistent: equal surfaces of the item became equal surfaces of the
document, and the other way round. So a question whose names and numbers were exchanged is found too. Both are judged
for each occurrence: windows whose place in the document less that in the item is the same, up to a quarter or half of
the item's length. One occurrence that passes is enough, and so are all windows of the document together.

Verbatim copies need no template: windows of the case-folded words themselves, without placeholders and whatever they
consist of, go through the same join, so a copy in another case is found, and one of mostly names or numbers. Each
character of a script that is written without spaces is a word.

The items' window hashes fill a bit table of fixed size that goes to every task; document windows that miss it are
never shuffled. The table is bounded whatever the size of the benchmark; the join behind it is left to Spark.

Defined cases: null texts count as empty; without enough literal words only verbatim copies match; an item of one word,
or one that merely counts (1 2 3 4 ...), never matches; items shorter than a window are one window as long as
themselves; repeated rows and repeated item ids count once; a null ``doc_id`` or ``item_id`` is a value of its own;
other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import keys_of, row_key, slices, texts, with_row_key

WINDOW = 8
LITERALS = 0.4
COVERAGE = 0.5
CONSISTENCY = 0.75
BITS = 22
CACHE = 1 << 18
# Words of texts that are hashed together.
TOGETHER = 1 << 17

# Words that count as units of measure.
UNITS = frozenset("""
    mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres mg g kg gram grams kilogram
    kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute
    minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent
    degree degrees watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb mph kmh
    """.split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|€|\$)?")
QUANTITY = re.compile(r"[+-]?\d[\d.,]*[a-z°]{1,3}")
PUNCTUATION = " \t\n.,;:!?\"'`()[]{}<>*#&|~_=«»„“”‘’…¿¡。，、；：！？（）「」『』《》【】"
# Scripts without spaces between words: Thai to Tibetan, Burmese, Khmer, Chinese and Japanese.
UNSPACED = ("\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
            "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff")
UNSPACED_CHAR = re.compile(f"[{UNSPACED}]")
UNSPACED_PARTS = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
KINDS = {"<number>": 1, "<name>": 2, "<unit>": 3, "<quantity>": 4}
BASE = np.uint64(0x9E3779B97F4A7C15)
PLAIN_SEED = 0x517CC1B7


def canonical(word: str) -> tuple[str, str]:
    """(token, surface); the token is a placeholder, a lower-case word, or empty for mere punctuation."""
    bare = word.strip(PUNCTUATION)
    if not bare:
        return "", ""
    low = bare.lower()
    if NUMBER.fullmatch(bare):
        return "<number>", low
    if QUANTITY.fullmatch(low):
        return "<quantity>", low
    if low in UNITS:
        return "<unit>", low
    if bare[0].isupper() and len(bare) > 1:
        return "<name>", low
    return low, low


class Codes:
    """Words to 64-bit codes, as templates and plain. The low three bits of a template code are 0 for literal words and
    the kind for placeholders."""

    DROP, SPLIT = 7, 15

    def __init__(self):
        self.known: dict[str, int] = {}
        self.codes = np.zeros((2, 1 << 12), np.uint64)

    def new(self, word: str) -> int:
        at = self.known[word] = len(self.known) + 1
        if at >= self.codes.shape[1]:
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)], axis=1)
        token, _ = canonical(word)
        if UNSPACED_CHAR.search(word) and len(word) > 1:
            self.codes[:, at] = self.SPLIT
        elif not token:
            self.codes[:, at] = self.DROP
        else:
            self.codes[0, at] = xxhash.xxh64_intdigest(token) & ~7 | KINDS.get(token, 0)
            self.codes[1, at] = xxhash.xxh64_intdigest(word.strip(PUNCTUATION).casefold())
        return at

    def of(self, words: list[str], text: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The words that are more than punctuation, which text each is of, their template and their plain codes."""
        if len(self.known) >= CACHE:
            self.known.clear()
        get, new = self.known.get, self.new
        at = np.array([get(w) or new(w) for w in words], np.int64)
        template = self.codes[0, at]
        split = np.flatnonzero(template == self.SPLIT)
        if len(split):
            parts, counts, done = [], np.ones(len(words), np.int64), 0
            for i in split.tolist():
                own = UNSPACED_PARTS.findall(words[i])
                parts += words[done:i] + own
                counts[i], done = len(own), i + 1
            return self.of(parts + words[done:], np.repeat(text, counts))
        real = template != self.DROP
        if not real.all():
            words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
            text, at, template = text[real], at[real], template[real]
        return words, text, template, self.codes[1, at]


def windows(codes: np.ndarray, lengths: Iterable[int], seed: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the hashes of all windows of so many tokens; each token goes into all lengths at once."""
    lengths, mixed = set(lengths), np.full(len(codes), seed, np.uint64)
    for k in range(max(lengths, default=0)):
        mixed = mixed[:max(0, len(codes) - k)]
        mixed *= BASE
        mixed += codes[k:]
        if k + 1 in lengths:
            yield k + 1, mixed


def literal_windows(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which windows of template codes, given by their places, hold enough literal words."""
    before = np.concatenate([[0], np.cumsum((codes & np.uint64(7)) == 0)])
    return before[at + length] - before[at] >= max(2, LITERALS * length)


def counts_up(words: list[str]) -> bool:
    """Whether the words are whole numbers, each one more than the one before."""
    bare = [w.strip(PUNCTUATION) for w in words]
    return all(w.isdecimal() for w in bare) and all(int(b) - int(a) == 1 for a, b in zip(bare, bare[1:], strict=False))


def _surfaces(words: list[str]) -> str:
    """The surface of each placeholder of a window, kind first; empty strings for literal words; joined by blanks."""
    out = []
    for token, surface in map(canonical, words):
        out.append(f"{token[1]}{token[2]}:{surface}" if token in KINDS else "")
    return " ".join(out)


def _batches(rows: list[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [field.split() for field in ddl.split(", ")]
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows[at:at + 10_000], strict=True), fields, strict=True)],
            names=[name for name, _ in fields])


def _item_rows(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Windows of every item as rows, templates and plain ones; a shorter item is one window."""
    codes = Codes()
    for batch in slices(batches):
        rows = []
        for row, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split = text.split()
            words, _, template, folded = codes.of(split, np.zeros(len(split), np.int64))
            length = min(size, len(words))
            if length < 2 or counts_up(words):
                continue
            for plain, coded, seed in ((False, template, 1), (True, folded, PLAIN_SEED)):
                (_, hashes), = windows(coded, [length], seed)
                places = np.arange(len(hashes))
                places = places if plain else places[literal_windows(coded, places, length)]
                rows += [(row, key, plain, i, length, len(words), len(places), int(hashes[i].astype(np.int64)),
                          "" if plain else _surfaces(words[i:i + length])) for i in places.tolist()]
        yield from _batches(rows, ROWS)


def _text_rows(batches, lengths: list[int], bits: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Those windows of every text whose hash is in the bit table, as rows. Texts are hashed many at a time, and only
    windows that hit the table are looked at one by one."""
    codes = Codes()
    shift = np.uint64(64 - bits)
    for batch in slices(batches):
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        held, of, n = [], [], 0
        for at, text in enumerate(batch.column(2).to_pylist()):
            held.append(text.split())
            of.append(at)
            n += len(held[-1])
            if n < TOGETHER and at < len(keys) - 1:
                continue
            words, text_of, template, folded = codes.of(
                [w for words in held for w in words], np.repeat(np.array(of), [len(w) for w in held]))
            held, of, n, rows = [], [], 0, []
            for plain, coded, seed in ((False, template, 1), (True, folded, PLAIN_SEED)):
                for length, hashes in windows(coded, lengths, seed):
                    hit = np.flatnonzero(table[hashes >> shift])
                    hit = hit[text_of[hit] == text_of[hit + length - 1]]
                    if not plain:
                        hit = hit[literal_windows(coded, hit, length)]
                    places = hit - np.searchsorted(text_of, text_of[hit])
                    rows += [(*keys[t], p, h, "" if plain else _surfaces(words[i:i + length])) for t, p, h, i in zip(
                        text_of[hit].tolist(), places.tolist(), hashes[hit].astype(np.int64).tolist(), hit.tolist(), strict=True)]
            yield from _batches(rows, HITS)


ROWS = "row long, id long, plain boolean, place int, length int, words int, total int, hash long, slots string"
HITS = "row long, id long, place int, hash long, slots string"
FOUND = "array<struct<places:array<int>,item_places:array<int>,slots:string,item_slots:string>>"
JUDGED = "row long, doc_id long, item_id long, coverage double, consistency double, same double"


def _slots_agree(found: list[dict]) -> tuple[float, float]:
    """Consistency of the slots of matched windows, and the share of slots left as they are."""
    pairs = {pair for f in found for pair in zip(f["item_slots"].split(" "), f["slots"].split(" "), strict=True) if pair[1]}
    if not pairs:
        return 1.0, 1.0
    kept = min(len({a for a, _ in pairs}), len({b for _, b in pairs}))
    return kept / len(pairs), sum(a == b for a, b in pairs) / len(pairs)


def occurrences(found: list[dict], words: int) -> Iterator[tuple[int, list[dict]]]:
    """(number of the item's windows held, matched windows) of each stretch of the document that may be one copy.

    Stretches are ranges of shifts (place in the document less place in the item) half as wide as the item's ``words``
    and overlapping by half, so that shifts a quarter apart share one, and copies side by side do not; and ranges of
    two shifts, for items that repeat their own templates.
    """
    places = [np.array(f["places"]) for f in found]
    for step in {max(1, words // 4), 1}:
        held: dict[int, set[int]] = {}
        within: dict[int, set[int]] = {}
        for n, f in enumerate(found):
            for at in f["item_places"]:
                for shift in np.unique((places[n] - at) // step).tolist():
                    for group in (shift - 1, shift):
                        held.setdefault(group, set()).add(at)
                        within.setdefault(group, set()).add(n)
        for group, item_places in held.items():
            yield len(item_places), [found[n] for n in within[group]]


def _judge(batches, coverage: float, consistency: float) -> Iterator[pa.RecordBatch]:
    """The best values of all stretches that pass, if any does; the whole document is one of them."""
    names = ["row", "doc_id", "item_id", "coverage", "consistency", "same"]
    types = [*[pa.int64()] * 3, *[pa.float64()] * 3]
    for batch in slices(batches):
        out = []
        for r in batch.to_pylist():
            whole = len({at for f in r["found"] for at in f["item_places"]}), r["found"]
            # Where the slots of all windows agree, as without slots, no stretch is better than the whole.
            agree = r["plain"] or _slots_agree(r["found"])[0] == 1
            stretches = [whole] if agree else [whole, *occurrences(r["found"], r["words"])]
            good = [(n / r["total"], *_slots_agree(f)) for n, f in stretches if n / r["total"] >= coverage]
            good = [g for g in good if g[1] >= consistency]
            if good:
                best = [max(g) for g in zip(*good, strict=True)]
                out.append((r["row"], r["doc_id"], r["item_id"], *best[:2], None if r["plain"] else best[2]))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, coverage: float = COVERAGE,
            consistency: float = CONSISTENCY, bits: int = BITS) -> DataFrame:
    """``row`` (key of the text), ``doc_id``, ``item_id``, ``coverage`` (share of the item's windows), ``consistency``
    of the slots and ``same`` (share of slots left as they are, null where no template matches), for every document
    and item that match; one row each for a match of templates and of plain words."""
    spark = docs.sparkSession
    items = texts(items, "item_id").dropDuplicates()
    items = items.select(row_key(), F.col("doc_id").alias("id"), "text")
    wanted = items.mapInArrow(lambda b: _item_rows(b, size), ROWS)
    # Bounded whatever the benchmark: at most 2 ** bits slots, and window lengths up to ``size``.
    slots = wanted.select(F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("slot")).distinct().toArrow()
    table = np.zeros(1 << bits, bool)
    table[slots["slot"].to_numpy()] = True
    lengths = sorted({r[0] for r in wanted.select("length").distinct().collect()} or {size})
    packed = spark.sparkContext.broadcast(np.packbits(table).tobytes())

    def look(batches):
        bit_table = np.unpackbits(np.frombuffer(packed.value, np.uint8)).astype(bool)
        yield from _text_rows(batches, lengths, bits, bit_table)

    held = texts(docs).select(row_key(), F.col("doc_id").alias("id"), "text").mapInArrow(look, HITS)
    # One row for each window of a text or item, with all its places.
    held = held.groupBy("row", F.col("id").alias("doc_id"), "hash", "slots").agg(F.collect_set("place").alias("places"))
    wanted = wanted.groupBy(
        F.col("row").alias("item"), F.col("id").alias("item_id"), "plain", "words", "total", "hash",
        F.col("slots").alias("item_slots")).agg(F.collect_set("place").alias("item_places"))
    grouped = held.join(wanted, "hash").groupBy("row", "doc_id", "item", "item_id", "plain", "words", "total").agg(
        F.collect_list(F.struct("places", "item_places", "slots", "item_slots")).cast(FOUND).alias("found"))
    # No stretch holds more windows of the item than the whole document.
    likely = F.size(F.array_distinct(F.flatten("found.item_places"))) / F.col("total") >= coverage
    return grouped.where(likely).mapInArrow(lambda b: _judge(b, coverage, consistency), JUDGED)


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each contaminated document and item: ``doc_id``, ``item_id``, ``coverage``, ``consistency``,
    ``reparameterised`` (whether names, numbers or units were exchanged)."""
    return matches(docs, items, **options).groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"),
        (F.coalesce(F.max("same"), F.lit(1.0)) < 1).alias("reparameterised"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without those that match an item, columns unchanged."""
    bad = matches(docs, items, **options).select("row", "doc_id").distinct()
    keyed, names = with_row_key(docs)
    return keyed.join(keys_of(bad, names), names, "left_anti").select(docs.columns)
