"""Benchmark decontamination by templates: passages of benchmark items in documents, also with other numbers or names.

Words are cut at ASCII white space and freed of the marks around them. A number (with its separators, sign, %) becomes the
placeholder <num>, a unit after a number <unit>, a word with a capital that doesn't begin a sentence and isn't all in
capitals <name>; other words are lower-cased. Windows of WINDOW such tokens with at least LITERALS that are no placeholders are
joined by hash, and all windows also by their lower-cased words as they are, so that a verbatim copy goes on through numbers and names; the join's pairs are aligned by document, item and distance of the positions. In an aligned run
the slots are compared: a value of the item must always stand for one value of the document and the other way round, in each type; then
the run is the item's text, re-parameterised or (all equal) as it is. Where a window contradicts those before it the run is split, and
each longest consistent part counts for itself. A document is contaminated by an item if a consistent run is RUN windows
long, or for an item of fewer windows all but one of them, or if it has as much of the item's windows with enough literals alone. An item of
fewer than WINDOW words is one sequence, found where its words stand as they are (an item of one word wherever that word is).

What is sent: the windows of documents that may be in the benchmark. A bitmap of fixed size (BITS) of the benchmark's window
hashes goes to the tasks; windows that fall on a set bit are the candidates of an exact hash join, which Spark
plans by size. A benchmark that outgrows the bitmap makes more candidates, never other results. Items of equal text are one, of the
smallest id, so that a text that many items share isn't joined with each of them: membership() has which item stands for which,
and n_items in the result how many it stands for.

Null and empty texts match nothing. Rows of the same doc_id are one document in
the result; a null id is kept as null. An empty table gives an empty result. Very long texts are read whole. Only doc_id, item_id and text are
read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import fresh, small_batches, staged, texts, without

WINDOW, LITERALS, RUN = 8, 3, 6
#: Bits of the bitmap (4 MB) and of one of Spark's bitmaps.
BITS, PART = 1 << 25, 4096 * 8
WORDS_KEPT, CHUNK = 300_000, 2 << 20
#: Units.
UNITS = frozenset(
    b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds tonne tonnes ton tons "
    b"ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % euro euros dollar dollars cent cents usd eur gbp "
    b"mph kmh km/h m/s hz khz mhz ghz w kw mw v volt volts amp amps j joule joules kb mb gb tb byte bytes bit bits degree degrees celsius fahrenheit kelvin".split()
)
_AROUND = b" .,;:!?\"'()[]{}<>*#$&|_~`"
_END = re.compile(rb"[.!?][\"')\]]*$")
_NUMBER = re.compile(rb"[+-]?\d[\d.,:/_-]*%?$")
_GLUED = re.compile(rb"([+-]?\d[\d.,]*)([a-z%/]+)$")
NUM, UNIT, NAME = 1, 2, 3
_PLACES = np.array([0, *(xxhash.xxh64_intdigest(x) for x in (b"<num>", b"<unit>", b"<name>"))], np.uint64)
_EMPTY = np.uint64(xxhash.xxh64_intdigest(b""))
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_FACTOR, k, 1 << 64) for k in range(WINDOW)], np.uint64)


class Templates:
    """Texts to tokens of templates: for each distinct word its hash, its kind and whether it ends a sentence."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.kinds: list[int] = []

    def add(self, word: bytes) -> int:
        bare = word.strip(_AROUND)
        plain = bare.decode("utf-8", "replace")
        low = bare.lower() if bare.isascii() else plain.lower().encode("utf-8", "replace")
        kind = 0
        if _NUMBER.match(bare) or ((m := _GLUED.match(low)) and m[2] in UNITS):
            kind = NUM
        elif low in UNITS and len(low) > 1:
            kind = UNIT
        elif plain[:1].isupper() and len(plain) > 1 and not plain.isupper():
            kind = NAME
        n = self.known[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(low))
        self.kinds.append(kind | (4 if _END.search(word) else 0))
        return n

    def windows(self, docs: list[bytes], short: tuple[int, ...] | None = None) -> tuple:
        """For each window its document, position, hash, length, whether it has enough literals and is hashed as it is; the documents' words; all tokens'
        kinds, one text after the other. Windows have WINDOW words, or any length in short; without short, texts of fewer words are
        one window. Windows with slots and enough literals are there twice, as template and as they are."""
        if len(self.known) > WORDS_KEPT:
            self.clear()
        split = [d.split() for d in docs]
        for w in set().union(*split).difference(self.known):
            self.add(w)
        sizes = np.array([len(ws) for ws in split], np.int64)
        n = int(sizes.sum())
        k = np.fromiter((self.known[w] for ws in split for w in ws), np.int64, n)
        first = np.concatenate(([0], np.cumsum(sizes)))
        kinds = np.array(self.kinds, np.int64)[k] if n else k
        begins = np.zeros(n, bool)
        begins[first[:-1][sizes > 0]] = True
        begins[1:] |= kinds[:-1] >= 4
        kind = kinds & 3
        kind[(kind == NAME) & begins] = 0
        # "in" and "second" are units after a number only
        owner = np.repeat(np.arange(len(docs)), sizes)
        alone = np.ones(n, bool)
        alone[1:] = (kind[:-1] != NUM) | (owner[1:] != owner[:-1])
        kind[(kind == UNIT) & alone] = 0
        raw = np.array(self.hashes, np.uint64)[k] if n else np.zeros(0, np.uint64)
        h = np.where(kind > 0, _PLACES[kind], raw)
        literal = np.concatenate(([0], np.cumsum(kind == 0)))
        found = []
        for size in sorted({WINDOW, *(range(1, WINDOW) if short is None else short)}):
            m = n - size + 1
            if m <= 0:
                continue
            at = np.flatnonzero(owner[:m] == owner[size - 1 :])
            if size < WINDOW and short is None:
                at = at[sizes[owner[at]] == size]
                at = at[[bool((raw[a : a + size] != _EMPTY).any()) for a in at.tolist()]] if len(at) else at
            literals = literal[at + size] - literal[at]
            good = (literals >= LITERALS) & (size == WINDOW)
            held = [(at, raw, good, True)]
            if size == WINDOW:
                held.append((at[good & (literals < size)], h, good[good & (literals < size)], False))
            for a, of, enough, plain in held:
                with np.errstate(over="ignore"):
                    total = sum(of[j : j + m] * _POWERS[j] for j in range(size))
                    total ^= total >> np.uint64(29)
                found.append((a, total[a], np.full(len(a), size), enough, np.full(len(a), plain)))
        if not found:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))]
        at, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        return owner[at], at - first[owner[at]], *rest, split, kind


def slots_of(words: list[bytes], kinds: np.ndarray) -> list[str]:
    """Values of the placeholders, each with its type."""
    return [f"{int(k)}:{w.strip(_AROUND).lower().decode('utf-8', 'replace')}" for w, k in zip(words, kinds.tolist(), strict=True) if k]


#: Columns of windows: their slots, whether they have enough literals, are hashed as they are, and their words.
_COLUMNS = "h long, {} long, pos long, slots array<string>, good boolean, plain boolean, length long"


def _emit(of: str, batches, keep=None, short=None):
    t = Templates()
    schema = pa.schema([("h", pa.int64()), (of, pa.int64()), ("pos", pa.int64()), ("slots", pa.list_(pa.string())), ("good", pa.bool_()), ("plain", pa.bool_()), ("length", pa.int64())])
    for batch in batches:
        ids, done = batch.column(of).to_pylist(), 0
        for held in _chunks(texts(batch)):
            *columns, split, kind = t.windows(held, short)
            if keep is not None:
                hit = keep(columns[2])
                # of a short item's places in a text the first will do
                few = hit[columns[3][hit] < WINDOW]
                if len(few):
                    _, at = np.unique(np.stack((columns[0][few].astype(np.uint64), columns[2][few])), axis=1, return_index=True)
                    hit = np.concatenate((hit[columns[3][hit] >= WINDOW], few[at]))
                columns = [c[hit] for c in columns]
            doc, pos, h, length, good, plain = columns
            first = np.concatenate(([0], np.cumsum([len(ws) for ws in split])))
            slots = [slots_of(split[d][p : p + n], kind[first[d] + p : first[d] + p + n]) for d, p, n in zip(doc.tolist(), pos.tolist(), length.tolist(), strict=True)]
            out = pa.array(h.view(np.int64)), pa.array([ids[done + d] for d in doc.tolist()], pa.int64()), pa.array(pos, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(good), pa.array(plain), pa.array(length, pa.int64())
            yield pa.RecordBatch.from_arrays(list(out), schema=schema)
            done += len(held)


def consistent(windows: list[list[tuple[str, str]]]) -> list[tuple[int, int]]:
    """The longest parts [begin, end) of aligned windows, each given by its pairs of slots (item, document), in which a value
    of the item stands for one value of the document and the other way round. None lies within another."""
    there, back, n = {}, {}, Counter()
    out, begin = [], 0
    for k, pairs in enumerate(windows):
        pairs = set(pairs)
        if len({i for i, _ in pairs}) < len(pairs) or len({d for _, d in pairs}) < len(pairs):
            out.append((begin, k))
            there, back, n, begin = {}, {}, Counter(), k + 1
            continue
        if any(there.get(i, d) != d or back.get(d, i) != i for i, d in pairs):
            out.append((begin, k))
            while any(there.get(i, d) != d or back.get(d, i) != i for i, d in pairs):
                for i, d in set(windows[begin]):
                    n[i, d] -= 1
                    if not n[i, d]:
                        del n[i, d], there[i], back[d]
                begin += 1
        for i, d in pairs:
            there[i], back[d] = d, i
            n[i, d] += 1
    out.append((begin, len(windows)))
    return [(a, b) for a, b in out if b > a]


def _parts(batches):
    """For each consistent part of an aligned run its windows, those with enough literals, begin, slots and those changed."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "run", "good", "begin", "slots", "changed")])
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            doc, item, begin, held = (batch.column(c)[k].as_py() for c in ("doc_id", "item_id", "begin", "windows"))
            windows = [list(zip(w["islots"], w["slots"], strict=True)) for w in held]
            for a, b in consistent(windows):
                pairs = set().union(*windows[a:b])
                rows.append((doc, item, b - a, sum(w["good"] for w in held[a:b]), begin + a, len(pairs), sum(i != d for i, d in pairs)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def _chunks(each):
    held, size = [], 0
    for text in each:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def classes(items: DataFrame) -> DataFrame:
    """text, item_id, n_items: each text once, the smallest id of its items and their number."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))


def membership(items: DataFrame) -> DataFrame:
    """item_id, of: for each item the one of equal text that stands for it in contamination()."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return own.join(classes(items).select(F.col("text").alias("_t"), F.col("item_id").alias("of")), F.col("text").eqNullSafe(F.col("_t"))).select("item_id", "of")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates. Rows are told apart by id and text, so a clean text stays though another text of its
    id, or of no id, goes."""
    place = fresh(docs, "place")[0]
    placed = docs.withColumn(place, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    found = staged(contamination(placed.select(F.col(place).alias("doc_id"), "text"), items).select("doc_id"), "contaminated")
    return without(placed, found, place).select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_items (equal ones), and of the longest consistent run: run (windows), item_windows, begin (word of the document),
    slots, changed (slots with another value than the item's). A row for each contaminated document and item."""
    known = classes(items)
    bench = known.select("item_id", "text")
    bench = staged(small_batches(bench).mapInArrow(lambda b: _emit("item_id", b), _COLUMNS.format("item_id")), "benchmark-windows")
    sizes = bench.groupBy("item_id").agg(F.countDistinct("pos").alias("item_windows"), F.countDistinct(F.when(F.col("good"), F.col("pos"))).alias("good_windows"))
    short = tuple(r.length for r in bench.filter(F.col("length") < WINDOW).select("length").distinct().collect())
    # the bitmap: at most BITS / PART rows of 4 KB
    bit = F.pmod("h", F.lit(BITS))
    parts = bench.groupBy((bit / F.lit(PART)).cast("long").alias("part")).agg(F.bitmap_construct_agg((bit % F.lit(PART)).cast("long")).alias("bitmap")).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        bitmap[r.part * (PART // 8) : (r.part + 1) * (PART // 8)] = np.frombuffer(bytes(r.bitmap), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def candidates(batches):
        bits = np.frombuffer(shared.value, np.uint8)

        def keep(h):
            at = (h & np.uint64(BITS - 1)).astype(np.int64)
            return np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)

        yield from _emit("doc_id", batches, keep, short)

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(candidates, _COLUMNS.format("doc_id")).select("h", "doc_id", "pos", "slots", "plain")
    pairs = found.join(bench.select("h", "item_id", "good", F.col("pos").alias("ipos"), F.col("slots").alias("islots")), "h")
    # equal as they are: each value stands for itself, whatever the case and place of its words make of it
    pairs = pairs.withColumn("slots", F.when(F.col("plain"), F.col("islots")).otherwise(F.col("slots"))).filter(F.size("slots") == F.size("islots"))
    pairs = pairs.withColumn("shift", F.col("pos") - F.col("ipos")).dropDuplicates(["doc_id", "item_id", "shift", "ipos"])
    line = Window.partitionBy("doc_id", "item_id", "shift").orderBy("ipos")
    runs = pairs.withColumn("island", F.col("ipos") - F.row_number().over(line)).groupBy("doc_id", "item_id", "shift", "island")
    # a run has no more windows than its item
    runs = runs.agg(F.min("pos").alias("begin"), F.array_sort(F.collect_list(F.struct("ipos", "islots", "slots", "good"))).alias("windows")).select("doc_id", "item_id", "begin", "windows")
    runs = small_batches(runs).mapInArrow(_parts, "doc_id long, item_id long, run long, good long, begin long, slots long, changed long")
    enough = lambda n, of: F.col(n) >= F.greatest(F.lit(1), F.least(F.lit(RUN), F.col(of) - 1))
    runs = runs.join(sizes, "item_id").filter(enough("run", "item_windows") | enough("good", "good_windows"))
    best = runs.groupBy("doc_id", "item_id", "item_windows").agg(F.max(F.struct("run", -F.col("begin"), F.col("slots").cast("int").alias("slots"), F.col("changed").cast("int").alias("changed"))).alias("m"))
    best = best.join(known.groupBy("item_id").agg(F.max("n_items").alias("n_items")), "item_id", "left")
    return best.select("doc_id", "item_id", "n_items", F.col("m.run").alias("run"), "item_windows", (-F.col("m.col2")).alias("begin"), F.col("m.slots").alias("slots"), F.col("m.changed").alias("changed"))
