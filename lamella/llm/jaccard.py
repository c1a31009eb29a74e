"""Near duplicates: an exact Jaccard join of shingle sets by vertical partitioning, and its connected components.

Sets are distinct runs of WORDS words (of fewer words, the whole sequence), as 64-bit hashes. Texts of equal sets are one
class, found by a hash of the set, so copies never meet in pairs; further steps are on classes.

A global order of shingles, rare ones first, is cut into fragments: ranges of the order that come equally often. How often a
shingle comes is read from a table of SLOTS counts, summed over all documents: of fixed size, whatever the corpus. Shingles
of one slot count together, which moves them in the order but changes no link, as any order gives the same ones.

Two sets of Jaccard T or more share a shingle within the first n - ceil(T n) + 1 of each. More exactly: at the first shingle
that they share, both still have as many shingles to come (itself included) as the overlap that their two sizes need. Each
fragment has the prefix shingles of its range with their places in their sets, counts for the pairs of sets that pass this
test how many they share in it, and the counts are summed for each pair. Pairs found so are verified the same way, with
whole sets cut into PARTS ranges, overlaps counted in each and summed.

Not all pairs are counted. First, within each list (the sets that have a shingle, by bands of size) only pairs with the list's
centre: the set in which the shingle comes earliest, so the one with the least that is rare, to which the others of a group
of near copies are closest. All these pairs are verified. Then, exactly: of lists with further pairs that pass the test (those of two
sets have none), where they still have sets of several components, all such pairs of different components. A pair of the same
component needs no count, as a link couldn't change the result; so groups of thousands of near copies cost no pairs, and no link
between components is missed. Where slots come more than SPLIT times above the mean, lists are dealt to several tasks: each has a
centre, and the centres meet the least of them; in the second pass the component with most sets is cut into blocks that only
meet the blocks of others.

Null texts, empty texts and texts without words have an empty set, no links and are their own component. Rows of equal id are
rows of their own; the component's id is the smallest id among its rows, null if all are null. Equal texts are linked. An
empty table gives an empty result. Long texts are taken whole. Only doc_id and text are read. Classes and rows are told apart by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import discard, fresh, met, sieve, small_batches, staged, texts, without
from lamella.llm.components import components

WORDS, T = 5, (75, 100)
#: Counts of the order, and of one row of them; steps of a doubling in the order; batches after which a task passes on its counts.
SLOTS, BLOCK, STEPS, FLUSH = 1 << 24, 1 << 16, 12, 60
#: Shingles of a fragment; prefixes that a task cuts at a time; pairs of a group of verification; ranges in it; sets of a list's block.
PER_FRAGMENT, TOGETHER, PER_GROUP, PARTS, SPLIT = 500_000, 500_000, 400, 4, 4000
#: Lists up to so many sets are compared all at once.
SHORT = 48
WORDS_KEPT = 150_000
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_FACTOR, k, 1 << 64)) for k in range(WORDS)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 16, np.uint64)

    def word_hashes(self, text: bytes) -> np.ndarray:
        ws = text.lower().split()
        known = self.known
        k = np.fromiter(map(known.get, ws, (-1,) * len(ws)), np.int64, len(ws)) if ws else np.zeros(0, np.int64)
        for j in np.flatnonzero(k < 0).tolist():
            w = ws[j]
            n = known.get(w)
            if n is None:
                n = known[w] = len(known)
                if n == len(self.hashes):
                    self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
                self.hashes[n] = xxhash.xxh64_intdigest(w)
            k[j] = n
        return self.hashes[k]

    def set_of(self, text: bytes) -> np.ndarray:
        """The distinct shingles' hashes, ascending."""
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        h = self.word_hashes(text)
        n = len(h)
        if not n:
            return h
        with np.errstate(over="ignore"):
            if n < WORDS:
                total = np.array([sum(h[j] * _POWERS[j] for j in range(n)) + np.uint64(n)], np.uint64)
            else:
                total = sum(h[j : n - WORDS + 1 + j] * _POWERS[j] for j in range(WORDS))
            return np.unique(_mixed(total))


def class_of(shingles: np.ndarray) -> int:
    """The class of texts with this set, as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix(n):
    """How many shingles of a set of n can be the first that it shares with a set of Jaccard T or more."""
    return n - (T[0] * n + T[1] - 1) // T[1] + 1


def needed(na, nb):
    """The least overlap that makes T."""
    return (T[0] * (na + nb) + T[0] + T[1] - 1) // (T[0] + T[1])


def needed_column(na, nb):
    return F.floor((T[0] * (na + nb) + T[0] + T[1] - 1) / F.lit(T[0] + T[1]))


def slot(h: np.ndarray) -> np.ndarray:
    return (h // np.uint64((1 << 64) // SLOTS)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """How often, in steps of a STEPS-th of a doubling; shingles come in the order of this, then of their hashes."""
    return np.minimum(255, np.round(STEPS * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


class Order:
    """The global order, its fragments, and by how many tasks a list is read."""

    def __init__(self, levels: np.ndarray, per_fragment: int, split: int):
        self.levels, self.per_fragment = levels, per_fragment
        often = 2 ** (np.arange(256) / STEPS)
        self.mass = np.bincount(levels, minlength=256) * often
        self.below = np.cumsum(self.mass) - self.mass
        excess = often - 2 * self.mass.sum() / SLOTS  # what a slot has by chance isn't in one list
        self.salts = np.maximum(1, np.ceil(excess / split)).astype(np.int64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Ascending positions in the order."""
        return np.sort((self.levels[slot(shingles)].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8)))

    def fragment(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fragment of each key and among how many tasks its list is dealt."""
        at, part = (keys >> np.uint64(56)).astype(np.int64), (keys & np.uint64((1 << 56) - 1)) / 2.0**56
        return ((self.below[at] + self.mass[at] * part) / self.per_fragment).astype(np.int64), self.salts[at]


POSTING = np.dtype([("key", "<u8"), ("u", "<i8"), ("n", "<u4"), ("pos", "<u4")])
SETS = "kind int, doc_id long, place long, u long, n long, counts binary"


def located(docs: DataFrame) -> DataFrame:
    """place, doc_id and text of docs: rows of the same place have the same id and text."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def sets(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, place, class and size of each row's set; kind 1: a block (n) of the counts of shingles, classes counted once in a
    batch of rows."""

    def passed_on(count):
        rows = []
        for k, of in enumerate(count.reshape(-1, BLOCK)):
            if top := int(of.max()):
                rows.append((k, zlib.compress(of.astype(np.uint8 if top < 256 else np.uint16).tobytes(), 1)))
        for j in range(0, len(rows), 32):
            ks, blobs = zip(*rows[j : j + 32], strict=True)
            none = pa.nulls(len(ks), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * len(ks), pa.int32()), none, none, none, pa.array(ks, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "doc_id", "place", "u", "n", "counts"]
            )
        count[:] = 0

    def run(batches):
        s, count, read = Shingler(), None, 0
        for batch in batches:
            if count is None:
                count = np.zeros(SLOTS, np.uint16)
            us, ns, seen, held = [], [], set(), []
            for text in texts(batch):
                x = s.set_of(text)
                u = class_of(x)
                us.append(u)
                ns.append(len(x))
                if len(x) and u not in seen:
                    seen.add(u)
                    held.append(slot(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(us), pa.int32()), batch.column("doc_id"), batch.column("place"), pa.array(us, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(len(us), pa.binary())],
                names=["kind", "doc_id", "place", "u", "n", "counts"],
            )
            if held:
                at, often = np.unique(np.concatenate(held), return_counts=True)
                count[at] += np.minimum(often, 1000).astype(np.uint16)  # FLUSH batches can't overflow it
            read += 1
            if read % FLUSH == 0:
                yield from passed_on(count)
        if count is not None:
            yield from passed_on(count)
        _free()

    return small_batches(located(docs), 1000).mapInArrow(run, SETS)


def _summed(batches):
    """n, levels of each block of counts: a block's counts come one after the other and only their sum is held."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("n").to_pylist(), batch.column("counts"), strict=True):
            raw = zlib.decompress(blob.as_py())
            more = np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.uint16)
            total[k] = total.get(k, np.uint32(0)) + more.astype(np.uint32)
    for k, of in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(level(of).tobytes(), 1)], pa.binary())], names=["n", "levels"])


def order_of(per_row: DataFrame) -> np.ndarray:
    """The level of each slot: SLOTS bytes, whatever the corpus."""
    levels = np.zeros(SLOTS, np.uint8)
    for r in per_row.filter("kind = 1").select("n", "counts").repartition("n").mapInArrow(_summed, "n long, levels binary").collect():
        levels[r.n * BLOCK : (r.n + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(r.levels)), np.uint8)
    return levels


def _postings(docs: DataFrame, shared) -> DataFrame:
    """fragment, salts, salt, blob of POSTING: the prefixes of sets."""

    per_fragment, split = PER_FRAGMENT, SPLIT

    def run(batches):
        order, s, parts, size, seen = Order(np.frombuffer(shared.value, np.uint8), per_fragment, split), Shingler(), [], 0, set()
        for batch in batches:
            for text in texts(batch):
                x = s.set_of(text)
                if not len(x) or (u := class_of(x)) in seen:
                    continue
                seen.add(u)
                p = np.zeros(prefix(len(x)), POSTING)
                p["key"], p["u"], p["n"], p["pos"] = order.keys(x)[: len(p)], u, len(x), np.arange(len(p))
                parts.append(p)
                size += len(p)
            if size >= TOGETHER:
                yield from _cut(np.concatenate(parts), order)
                parts, size, seen = [], 0, set()
        if parts:
            yield from _cut(np.concatenate(parts), order)
        _free()

    return small_batches(docs, 1000).select("text").mapInArrow(run, "fragment long, salts long, salt long, blob binary")


def _cut(p: np.ndarray, order: Order) -> Iterator[pa.RecordBatch]:
    fragment, salts = order.fragment(p["key"])
    salt = p["u"] % salts
    by = np.lexsort((p["key"], salt, salts, fragment))
    p, fragment, salts, salt = p[by], fragment[by], salts[by], salt[by]
    first = np.flatnonzero(np.append(True, (np.diff(fragment) != 0) | (np.diff(salts) != 0) | (np.diff(salt) != 0)))
    ends = np.append(first[1:], len(p))
    for k in range(0, len(first), 256):
        at = first[k : k + 256]
        blobs = [p[i:j].tobytes() for i, j in zip(at.tolist(), ends[k : k + 256].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(fragment[at]), pa.array(salts[at]), pa.array(salt[at]), pa.array(blobs, pa.binary())], names=["fragment", "salts", "salt", "blob"])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(keys))


FOUND = "kind int, a long, b long, na long, nb long, n long"


def _centres(key, table):
    """Of a fragment: kind 0, pairs of lists' centres and members that pass the test, with how many lists they share so; kind 1, sets that
    may be in further pairs (a: shingle, b: class, na: place in the set, nb: size), all of a list that is dealt to several tasks;
    kind 2, of such lists the centre (as in kind 1, n: band)."""
    _free()
    dealt = key[1].as_py() > 1
    p = np.concatenate([np.frombuffer(b.as_py(), POSTING) for b in table["blob"]])
    p = p[np.lexsort((p["u"], p["key"]))]
    p = p[np.append(True, (p["key"][1:] != p["key"][:-1]) | (p["u"][1:] != p["u"][:-1]))]
    if not dealt:
        first, end = _groups(p["key"])
        p = p[np.repeat(end - first > 1, end - first)]
    k, u, n, pos = (p[x].astype(np.int64) for x in ("key", "u", "n", "pos"))
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)
    by = np.lexsort((u, pos / np.maximum(n, 1), band, k))
    first = np.append(True, (np.diff(k[by]) != 0) | (np.diff(band[by]) != 0)) if len(p) else np.zeros(0, bool)
    centre = by[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(p) else by
    c, m = centre[~first], by[~first]
    ok = np.minimum(n[c] - pos[c], n[m] - pos[m]) >= needed(n[c], n[m])
    c, m = c[ok], m[ok]
    pairs = np.zeros(len(m), np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<i8"), ("nb", "<i8")]))
    pairs["a"], pairs["na"], pairs["b"], pairs["nb"] = u[c], n[c], u[m], n[m]
    pairs, often = _counted(pairs)
    heads = by[first] if dealt else by[:0]
    if not dealt:
        star = np.zeros(len(p), bool)
        star[by[first]] = True
        more = _further(k, n, n - pos, band, star)
        k, u, n, pos = k[more], u[more], n[more], pos[more]
    column = lambda x, y, z: pa.array(np.concatenate((x, y, z)), pa.int64())
    zero = np.zeros(len(k), np.int64)
    return pa.table(
        [
            pa.array(np.repeat([0, 1, 2], [len(pairs), len(k), len(heads)]), pa.int32()),
            column(pairs["a"], k, k[heads]),
            column(pairs["b"], u, u[heads]),
            column(pairs["na"], pos, pos[heads]),
            column(pairs["nb"], n, n[heads]),
            column(often, zero, band[heads]),
        ],
        names=["kind", "a", "b", "na", "nb", "n"],
    )


def _further(k, n, left, band, star) -> np.ndarray:
    """Which sets of lists (ordered by key) may pass the test with another that isn't their centre, nor they its."""
    out = np.zeros(len(k), bool)
    first, end = _groups(k)
    short = end - first <= SHORT
    stop = np.repeat(np.where(short, end, 0), end - first)
    for d in range(1, SHORT):
        i = np.flatnonzero(np.arange(len(k)) + d < stop)
        if not len(i):
            break
        j = i + d
        passes = (np.minimum(left[i], left[j]) >= needed(n[i], n[j])) & (np.minimum(n[i], n[j]) * T[1] >= np.maximum(n[i], n[j]) * T[0])
        passes &= (band[i] != band[j]) | ~(star[i] | star[j])
        out[i[passes]] = True
        out[j[passes]] = True
    for a, b in zip(first[~short].tolist(), end[~short].tolist(), strict=True):  # whether it may with one of the least size there
        least = np.maximum(int(n[a:b].min()), -(-n[a:b] * T[0] // T[1]))
        out[a:b] = left[a:b] >= needed(least, n[a:b])
    return out


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    new = np.append(True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))
    at = np.flatnonzero(new)
    return pairs[at], np.diff(np.append(at, len(pairs)))


PAIRS = "a long, b long, na long, nb long, n long"


def _across(key, table):
    """Of a fragment's lists (key, u, n, pos, label, block): pairs of different labels that pass the test, with how many lists they share so.
    Where the group is a pair of different blocks, pairs across these only."""
    t = table.sort_by([("key", "ascending"), ("u", "ascending")])
    k, u, n, pos, label, block = (t[x].to_numpy() for x in ("key", "u", "n", "pos", "label", "block"))
    across, left = key[1].as_py() != key[2].as_py(), n - pos
    kind = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<i8"), ("nb", "<i8")])
    out, kept, size = [], [], 0

    def found(i, j):
        nonlocal out, size
        ok = (label[i] != label[j]) & (np.minimum(left[i], left[j]) >= needed(n[i], n[j])) & (np.minimum(n[i], n[j]) * T[1] >= np.maximum(n[i], n[j]) * T[0])
        if across:
            ok &= block[i] != block[j]
        j, i = j[ok], (i[ok] if isinstance(i, np.ndarray) else np.full(int(ok.sum()), i))
        if len(j):
            pairs, low = np.zeros(len(j), kind), u[i] < u[j]
            pairs["a"], pairs["b"] = np.where(low, u[i], u[j]), np.where(low, u[j], u[i])
            pairs["na"], pairs["nb"] = np.where(low, n[i], n[j]), np.where(low, n[j], n[i])
            out.append(pairs)
            size += len(pairs)
            if size > 500_000:
                kept.append(_counted(np.concatenate(out)))
                out, size = [], 0

    first, end = _groups(k)
    short = end - first <= SHORT
    stop = np.repeat(np.where(short, end, 0), end - first)
    for d in range(1, SHORT):
        i = np.flatnonzero(np.arange(len(k)) + d < stop)
        if not len(i):
            break
        found(i, i + d)
    for a, b in zip(first[~short].tolist(), end[~short].tolist(), strict=True):
        # each set meets those of its own size or less, down to T of it
        by = a + np.lexsort((u[a:b], n[a:b]))
        sizes = n[by]
        most = left[by] * (T[0] + T[1]) // T[0] - sizes  # a partner can't be larger: it would need more than what is left
        low = np.searchsorted(sizes, -(-sizes * T[0] // T[1]))
        high = np.minimum(np.searchsorted(sizes, most, side="right"), np.arange(len(by)))
        for x in np.flatnonzero(high > low).tolist():
            found(by[x], by[low[x] : high[x]])
    if out:
        kept.append(_counted(np.concatenate(out)))
    p = np.concatenate([x for x, _ in kept]) if kept else np.zeros(0, kind)
    c = np.concatenate([x for _, x in kept]) if kept else np.zeros(0, np.int64)
    return pa.table([pa.array(p["a"]), pa.array(p["b"]), pa.array(p["na"]), pa.array(p["nb"]), pa.array(c)], names=["a", "b", "na", "nb", "n"])


def _overlaps(key, table):
    """Of a group and a range of the order: for each of its pairs the overlap of the two sets' segments."""
    kinds = table["kind"].to_numpy()
    segments = {}
    for r in np.flatnonzero(kinds == 0).tolist():
        segments[table["a"][r].as_py()] = np.frombuffer(table["blob"][r].as_py(), "<u8")
    asked = table.select(["a", "b", "na", "nb"]).take(pa.array(np.flatnonzero(kinds == 1)))
    a, b = asked["a"].to_numpy(), asked["b"].to_numpy()
    none = np.zeros(0, np.uint64)
    n = [len(np.intersect1d(segments.get(x, none), segments.get(y, none), assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return pa.table([asked["a"], asked["b"], asked["na"], asked["nb"], pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "n"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs(a, b, na, nb). Sets are computed again from the text of each class's row, found by its place."""
    pairs = staged(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    groups = max(1, n // PER_GROUP)
    # a set with many pairs is dealt out with shares of its partners, to as many groups
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PER_GROUP)).alias("shares"))
    dealt = pairs.join(many, "a").withColumn("g", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("shares"))), F.lit(groups)))
    dealt = staged(dealt.select("a", "b", "na", "nb", "g"), "pairs-dealt")
    wanted = dealt.select(F.col("a").alias("u"), "g").unionByName(dealt.select(F.col("b").alias("u"), "g")).groupBy("u").agg(F.collect_set("g").alias("gs"))
    # at most `groups` numbers for a set, for most sets one
    wanted = staged(wanted.join(classes.select("u", "place"), "u"), "sets-wanted")

    def segments(batches):
        s = Shingler()
        edges = (np.arange(1, PARTS, dtype=np.uint64) << np.uint64(62)) // np.uint64(PARTS) << np.uint64(2)
        for batch in batches:
            rows = []
            for text, u, gs in zip(texts(batch), batch.column("u").to_pylist(), batch.column("gs").to_pylist(), strict=True):
                x = s.set_of(text)
                cut = np.split(x, np.searchsorted(x, edges))
                for g in gs:
                    rows += [(g, f, u, part.astype("<u8").tobytes()) for f, part in enumerate(cut)]
                    if len(rows) > 4000:
                        yield _segments_batch(rows)
                        rows = []
            if rows:
                yield _segments_batch(rows)
        _free()

    rows = sieve(located(docs), wanted.select("place"), "place").filter("maybe")
    chosen = rows.groupBy("place").agg(F.first("text").alias("text")).join(wanted, "place")  # repeated rows: one of each, before the shuffle
    parts = small_batches(chosen, 1000).select("text", "u", "gs").mapInArrow(segments, "g long, f int, a long, blob binary")
    rows = parts.select("g", "f", F.lit(0).alias("kind"), "a", F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), "blob")
    asked = dealt.select("g", F.explode(F.array(*[F.lit(f) for f in range(PARTS)])).alias("f"), F.lit(1).alias("kind"), "a", "b", "na", "nb", F.lit(None).cast("binary").alias("blob"))
    partial = rows.unionByName(asked).groupBy("g", "f").applyInArrow(_overlaps, PAIRS)
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    linked = staged(total.filter(F.lit(T[1]) * F.col("n") >= F.lit(T[0]) * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b"), "links")
    discard(pairs, dealt, wanted)
    return linked


def _free() -> None:
    """Arrow keeps what it has freed; a worker is to give it back before its next task."""
    pa.default_memory_pool().release_unused()


def _segments_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["g", "f", "a", "blob"])


def _first_pairs(found: DataFrame) -> DataFrame:
    """Centres and members, with how many lists they share."""
    pairs = found.filter("kind = 0").select("a", "b", "na", "nb", "n")
    # lists dealt to several tasks: their centres with the least of them
    heads = found.filter("kind = 2").select(F.col("a").alias("key"), F.col("n").alias("band"), F.col("b").alias("u"), F.col("nb").alias("size"), (F.col("nb") - F.col("na")).alias("rest"))
    least = heads.groupBy("key", "band").agg(F.min(F.struct((-F.col("rest") / F.col("size")).alias("at"), "u", "size", "rest")).alias("c"))
    met = heads.join(least, ["key", "band"]).filter((F.col("u") != F.col("c.u")) & (F.least("rest", "c.rest") >= needed_column(F.col("size"), F.col("c.size"))))
    pairs = pairs.unionByName(met.select(F.col("c.u").alias("a"), F.col("u").alias("b"), F.col("c.size").alias("na"), F.col("size").alias("nb"), F.lit(1).cast("long").alias("n")))
    # two centres of different lists can be each other's member
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), "n")
    return pairs.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))


def _second_pairs(lists: DataFrame) -> DataFrame:
    """Of lists(key, u, n, pos, label): pairs of different labels that pass the test in a list at least."""
    per_label = lists.groupBy("key", "label").agg(F.count("*").alias("sets"), F.min("n").alias("least"))
    stats = per_label.groupBy("key").agg(F.max_by("label", "sets").alias("main"), F.max("sets").alias("most"), F.sum("sets").alias("size"), F.min("least").alias("least"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = lists.join(stats, "key")
    # too late in its set for a partner of the least size that the list has
    mixed = mixed.filter(F.col("n") - F.col("pos") >= needed_column(F.greatest("least", F.ceil(F.col("n") * F.lit(T[0]) / F.lit(T[1]))), F.col("n")))
    blocks = lambda n: F.ceil(n / F.lit(SPLIT))
    mixed = mixed.withColumn("mine", F.when(F.col("size") <= SPLIT, 0).otherwise(blocks(F.col("most")))).withColumn("others", F.when(F.col("size") <= SPLIT, 1).otherwise(blocks(F.col("size") - F.col("most"))))
    of_main = (F.col("label") == F.col("main")) & (F.col("mine") > 0)
    mixed = mixed.withColumn("block", F.when(of_main, F.pmod(F.xxhash64("u"), F.col("mine"))).otherwise(F.col("mine") + F.pmod(F.xxhash64("u"), F.col("others"))))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.when(of_main, F.col("mine")).otherwise(F.lit(0)), F.col("mine") + F.col("others") - 1)))
    mixed = staged(mixed.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "key", "u", "n", "pos", "label", "block"), "mixed")
    few = max(8, -(-mixed.count() // PER_FRAGMENT))
    across = mixed.withColumn("fragment", F.pmod(F.xxhash64("key"), F.lit(few))).groupBy("fragment", "x", "y").applyInArrow(_across, PAIRS)
    out = staged(across.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n")), "pairs-across")
    discard(mixed)
    return out


def _matched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, place, u, n of each row; for each class of texts with words u, rows, and of the component's first row doc_id, place)."""
    per_row = staged(sets(docs), "sets")
    rows = per_row.filter("kind = 0").select("doc_id", "place", "u", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    classes = rows.filter("n > 0").groupBy("u").agg(first.alias("m"), F.count("*").alias("rows")).select("u", "rows", "m.doc_id", "m.place")
    classes = staged(classes, "classes")
    shared = docs.sparkSession.sparkContext.broadcast(order_of(per_row).tobytes())
    found = staged(_postings(docs, shared).groupBy("fragment", "salts", "salt").applyInArrow(_centres, FOUND), "fragments")
    shared.unpersist()
    one = verified(_first_pairs(found).select("a", "b", "na", "nb"), classes, docs)
    label = components(one)
    # lists with several components: all pairs between these
    lists = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("u"), F.col("nb").alias("n"), F.col("na").alias("pos"))
    lists = staged(lists.join(label.withColumnRenamed("node", "u"), "u", "left").withColumn("label", F.coalesce("label", "u")), "lists")
    discard(found, label)
    pairs = _second_pairs(lists)
    discard(lists)
    two = verified(pairs.select("a", "b", "na", "nb"), classes, docs)
    label = components(one.unionByName(two))
    least = classes.join(label.withColumnRenamed("node", "u"), "u").groupBy("label").agg(first.alias("m"))
    of_node = label.join(least, "label").select(F.col("node").alias("u"), "m")
    of_class = classes.join(of_node, "u", "left").select("u", "rows", F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("m.doc_id")).alias("doc_id"), F.coalesce("m.place", "place").alias("place"))
    of_class = staged(of_class, "components")
    discard(pairs, one, two, classes, label)
    return rows, of_class


def _joined(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """doc_id, place, n of rows with words, and of the component's first row component_id, component_place."""
    of_class = of_class.select("u", "rows", F.col("doc_id").alias("component_id"), F.col("place").alias("component_place"))
    return met(rows.filter("n > 0"), of_class, "u", rows.count()).drop("u")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    rows, of_class = _matched(docs)
    some = _joined(rows, of_class).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each component one row stays, that of the smallest doc_id (null last; of different texts under it,
    any one). Rows are told apart by id and text, so another text of the same id is judged by itself; rows without words stay."""
    rows, of_class = _matched(docs)
    place = fresh(docs, "place")[0]
    others = staged(_joined(rows, of_class).filter(F.col("place") != F.col("component_place")).select("place").distinct(), "duplicates")
    repeated = staged(rows.filter("n > 0").groupBy("place").count().filter("count > 1").select("place"), "repeated")
    kept = without(docs.withColumn(place, F.xxhash64(F.col("doc_id").cast("long"), "text")), others, place)
    single = without(kept, repeated, place)
    several = kept.join(repeated.withColumnRenamed("place", place), place, "left_semi").dropDuplicates([place])
    return single.unionByName(several.select(*kept.columns)).select(*docs.columns)
