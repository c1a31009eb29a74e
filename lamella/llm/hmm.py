"""A hidden Markov language model over whole texts.

Tokens are ASCII lower-cased words and an end per text. States emit classes of words, a class its words by their share:
P(word | state) = P(class | state) (c + 1) / (sum of c + 1 in the class). The TOP most frequent words of the training rows and the end are
classes of their own, other known words are classed by their last two letters into BUCKETS, words that no training row has are one
class. So the model's table is bounded, while the counts c are exact, of all words of all training rows.

Baum-Welch: every round runs the scaled forward and backward recursions over all training texts, whole, many side by
side; expected counts of states, transitions and (state, class) pairs are summed over partitions, and the few thousand sums make
the next table. The score is the scaled forward recursion's exact log10 likelihood of the text.

Texts are read once. Each block of rows becomes a row: its distinct words with their training counts, and its texts as
numbers of these. Only the words are shuffled, to be counted and to meet their counts; counts go back as one row for each block, so
a word meets its count once for each block, not for each time it stands in a text, and no group is larger than a block.

Null and empty texts are the end alone. Rows with a null id are training rows. Equal texts score alike, repeated rows
count as often as they stand. Without training rows every word is unknown and scores are 0. An empty table gives an empty
result. Only doc_id and text are read, other columns don't matter. Long texts are scored whole.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import discard, small_batches, staged, texts

STATES, ROUNDS, TOP, BUCKETS, SMOOTH, SEED = 6, 4, 2048, 256, 20.0, 11
#: What a round must add to the log likelihood of a token, for another to follow.
GAIN = 1e-5
#: Classes: the words of their own, buckets, the end, unknown words.
END, UNKNOWN = TOP + BUCKETS, TOP + BUCKETS + 1
CLASSES = UNKNOWN + 1
#: Bytes of text of a block; tokens of texts that go through a recursion side by side, and of a stretch of its steps.
BLOCK, TOGETHER, WINDOW = 8 << 20, 200_000, 1 << 14
_LN10 = float(np.log(10))

BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, n array<int>, words array<string>, train array<long>, ids binary"


def _planes(ids: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 byte by byte: the upper bytes, mostly 0, compress to little."""
    if len(ids) and int(ids.max()) >> 24:
        raise ValueError("a block has 2 ** 24 distinct words or more: set BLOCK lower")
    b = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(b[:, :3].T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(3, -1)
    ids = b[2].astype(np.int32)
    for low in (b[1], b[0]):  # in place: a block's numbers are held once
        ids <<= 8
        ids |= low
    return ids


def _gathered(batches):
    """doc_ids, held_out, texts of blocks of about BLOCK bytes."""
    ids, held, kept, size = [], [], [], 0
    for batch in batches:
        for k, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts(batch), strict=True):
            ids.append(k)
            held.append(h)
            kept.append(text)
            size += len(text)
            if size >= BLOCK:
                yield ids, np.array(held, bool), kept
                ids, held, kept, size = [], [], [], 0
    if ids:
        yield ids, np.array(held, bool), kept


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of rows of docs(doc_id, text): distinct words, how often training rows have them, texts as numbers of words."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for doc_ids, held, held_texts in _gathered(batches):
            numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
            ids, sizes = [], []
            for text in held_texts:
                ws = text.lower().split()
                ids.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
                sizes.append(len(ws))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            met = np.bincount(flat, minlength=len(numbers))
            in_train = met - np.bincount(np.concatenate([x for x, h in zip(ids, held, strict=True) if h] or [np.zeros(0, np.int32)]), minlength=len(numbers))
            order = np.argsort(-met, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            words = pa.array(list(numbers), pa.binary()).cast(pa.string()).take(pa.array(order))
            one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq], pa.int64()), one(pa.array(doc_ids, pa.int64())), one(pa.array(held)), one(pa.array(sizes, pa.int32())), one(words), one(pa.array(in_train[order], pa.int64())), pa.array([_planes(rank[flat])], pa.binary())],
                names=["block", "doc_id", "held_out", "n", "words", "train", "ids"],
            )
            seq += 1

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(run, BLOCKS)


CODED = "doc_id array<long>, held_out array<boolean>, n array<int>, known array<int>, base array<double>, within array<double>, classes binary"


def coded(block: DataFrame, found: DataFrame, totals: dict) -> DataFrame:
    """Blocks with their words' counts and classes: for each text its known tokens, base score, the part of its score that
    words have within their classes, and the classes of its tokens."""
    rows, log_all, class_log = totals["rows"], totals["log_all"], totals["class_log"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _from_planes(batch.column("ids")[k].as_py())
                f = batch.column("found")[k].values
                at, c, cls = (f.field(x).to_numpy(zero_copy_only=False) for x in ("k", "c", "class"))
                size = 1 + max(int(at.max()) if len(at) else -1, int(ids.max()) if len(ids) else -1)  # words that none found are unknown
                counts, classes = np.zeros(size, np.int64), np.full(size, UNKNOWN, np.uint16)
                counts[at], classes[at] = c, cls
                log_c = np.log10(counts + 1.0)
                within = log_c - class_log[classes]
                within[classes == UNKNOWN] = 0.0
                n = batch.column("n")[k].values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                x = np.zeros(len(ids) + 1)  # one more, where empty texts at the end begin

                def summed(of, ids=ids, n=n, ends=ends, x=x):
                    np.take(of, ids, out=x[:-1], mode="clip")
                    return np.where(n > 0, np.add.reduceat(x, ends - n), 0.0)

                known = summed((counts > 0).astype(np.float64)).astype(np.int64) + (rows > 0)
                base = summed(log_c) + np.log10(rows + 1.0) - (n + 1) * log_all
                obs = np.insert(classes[ids], ends, END if rows else UNKNOWN)
                one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(k, 1), batch.column("held_out").slice(k, 1), one(pa.array(n + 1, pa.int32())), one(pa.array(known, pa.int32())), one(pa.array(base)), one(pa.array(summed(within))), pa.array([obs.astype("<u2", copy=False).tobytes()], pa.binary())],
                    names=["doc_id", "held_out", "n", "known", "base", "within", "classes"],
                )

    # a block's words go back as one row, no longer than the block
    back = found.groupBy("block").agg(F.collect_list(F.struct("k", "c", "class")).alias("found"))
    none = F.array().cast("array<struct<k:int,c:bigint,class:int>>")
    return block.select("block", "doc_id", "held_out", "n", "ids").join(back, "block", "left").withColumn("found", F.coalesce("found", none)).select("doc_id", "held_out", "n", "ids", "found").mapInArrow(run, CODED)


class Model:
    """start (K), move (K x K), emit (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)
        self.likes: list[float] = []

    def groups(self, n: np.ndarray):
        """Texts by falling length, in groups of about TOGETHER tokens."""
        order = np.argsort(-n, kind="stable")
        cut = np.cumsum(n[order]) // TOGETHER
        for g in np.unique(cut):
            yield order[cut == g]

    def steps(self) -> int:
        """Steps from one scaling to the next. A step leaves of a text's sum the lowest emission at least, so sums stay above 1e-150,
        far from the least double."""
        low = float(np.log10(self.emit[self.emit > 0].min()))
        return max(1, min(16, int(-150 / min(low, -1e-9))))

    def ahead(self, obs: np.ndarray, lengths: np.ndarray, begin: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Log likelihoods of a group of texts by falling length, whose observations stand in obs from begin, step by step side by
        side. Into kept goes of each window of steps what backward needs."""
        active = np.append(np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right"), 0)
        until = np.cumsum(active)
        every, total, t1, a = self.steps(), np.zeros(len(lengths)), 0, self.start
        while t1 < len(active) - 1:
            t0 = t1
            t1 = min(max(t0 + 1, int(np.searchsorted(until, until[t0] - active[t0] + WINDOW, "right"))), len(active) - 1)
            sizes = active[t0:t1]
            at = np.concatenate(([0], np.cumsum(sizes)))
            tokens = np.arange(at[-1]) - np.repeat(at[:-1], sizes)  # which text's
            seen = obs[begin[tokens] + np.repeat(np.arange(t0, t1), sizes)]
            emit, scales, cuts = self.emit[seen], {}, at.tolist()
            alpha = np.empty_like(emit)
            for t, lo, hi in zip(range(t0, t1), cuts[:-1], cuts[1:], strict=True):
                now, e = alpha[lo:hi], emit[lo:hi]
                if t:
                    np.matmul(a[: hi - lo], self.move, out=now)
                    np.multiply(now, e, out=now)
                else:
                    np.multiply(a, e, out=now)
                if t % every == 0:
                    s = now.sum(1)
                    now /= s[:, None]
                    total[: hi - lo] += np.log(s)
                    scales[t - t0] = s[:, None]
                a = now
            over = np.arange(active[t1], active[t0])  # texts that end here
            last = at[lengths[over] - 1 - t0] + over
            ends = alpha[last].sum(1)
            total[over] += np.log(ends)
            if kept is not None:
                kept.append((seen, alpha, at, scales, last, ends))
        return total

    def forward(self, obs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log likelihoods of the texts whose observations stand in obs one after the other, n each."""
        first, out = np.cumsum(n) - n, np.zeros(len(n))
        for g in self.groups(n):
            out[g] = self.ahead(obs, n[g], first[g])
        return out

    def expected(self, obs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, moves, (class, state); and the log likelihood."""
        k = len(self.start)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        like = 0.0
        first, from_next = np.cumsum(n) - n, np.ascontiguousarray(self.move.T)
        for g in self.groups(n):
            kept: list = []
            like += float(self.ahead(obs, n[g], first[g], kept).sum())
            back = np.ones((0, k))  # emission times backward of the step behind
            while kept:
                seen, alpha, at, scales, last, ends = kept.pop()
                emit, cuts, sizes = self.emit[seen], at.tolist(), np.diff(at)
                # under the scales of forward, so that forward times backward sums to 1 at each token
                beta = np.empty_like(alpha)
                beta[last] = 1 / ends[:, None]
                moves += alpha[cuts[-2] : cuts[-2] + len(back)].T @ back
                for t in range(len(sizes) - 1, -1, -1):
                    lo, hi = cuts[t], cuts[t + 1]
                    b = beta[lo:hi]
                    np.matmul(back, from_next, out=b[: len(back)])
                    back = emit[lo:hi]
                    np.multiply(back, b, out=back)
                    if t in scales:
                        back /= scales[t]
                before = np.arange(cuts[1], cuts[-1]) - np.repeat(sizes[:-1], sizes[1:])
                moves += alpha[before].T @ emit[cuts[1] :]
                gamma = np.multiply(alpha, beta, out=beta)
                if not kept:
                    starts += gamma[: cuts[1]].sum(0)
                seen = seen.astype(np.int64)
                for s in range(k):
                    emits[:, s] += np.bincount(seen, gamma[:, s], minlength=CLASSES)
        return starts, moves * self.move, emits, like


def _observations(batch, k: int, train: bool) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n")[k].values.to_numpy().astype(np.int64)
    obs = np.frombuffer(batch.column("classes")[k].as_py(), "<u2")
    if train:
        held = batch.column("held_out")[k].values.to_numpy(zero_copy_only=False)
        obs, n = obs[np.repeat(~held, n)], n[~held]
    return obs, n


def _with_unknown(emit: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Emissions whose columns sum to 1. Training texts have no unknown words: in each state these keep the share of the base."""
    emit = emit.copy()
    emit[UNKNOWN] = 0.0
    emit *= (1 - share[UNKNOWN]) / np.maximum(emit.sum(0), 1e-300)
    emit[UNKNOWN] = share[UNKNOWN]
    return emit


def first_model(share: np.ndarray) -> Model:
    """States that stay, each preferring classes at random."""
    rng = np.random.default_rng(SEED)
    emit = share[:, None] * np.exp(1.0 * rng.standard_normal((CLASSES, STATES)))
    emit = _with_unknown(emit, share)
    move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
    np.fill_diagonal(move, 0.9 if STATES > 1 else 1.0)
    return Model(np.full(STATES, 1 / STATES), move, emit)


def trained(rows: DataFrame, share: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    """Baum-Welch over all training texts of coded(): `rounds` at most, fewer where the log likelihood of a token rises by less than
    `gain`. The model has in `likes` that of each round's texts, before the round."""
    model = first_model(share)
    likes: list[float] = []
    for _ in range(rounds):
        now = model

        def expect(batches, now=now):
            total = None
            for batch in batches:
                for k in range(batch.num_rows):
                    obs, n = _observations(batch, k, True)
                    if len(n):
                        starts, moves, emits, like = now.expected(obs, n)
                        found = starts, moves, emits, np.array([like, n.sum()], float)
                        total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
            if total is None:
                return
            flat = np.concatenate([x.ravel() for x in total])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["at", "x"])

        sums = rows.select("held_out", "n", "classes").mapInArrow(expect, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # at most K + K * K + classes * K + 2 rows
        flat = np.zeros(STATES + STATES * STATES + CLASSES * STATES + 2)
        for r in sums:
            flat[r.at] = r.x
        if not flat.any():
            break
        flat, (like, tokens) = flat[:-2], flat[-2:]
        likes.append(float(like / tokens))
        if len(likes) > 1 and likes[-1] - likes[-2] < gain:
            break
        starts, moves, emits = np.split(flat, [STATES, STATES + STATES * STATES])
        emits = emits.reshape(CLASSES, STATES) + SMOOTH * share[:, None]
        moves = moves.reshape(STATES, STATES) + 1.0 / STATES
        model = Model((starts + 1) / (starts + 1).sum(), moves / moves.sum(1, keepdims=True), _with_unknown(emits, share))
    model.likes = likes
    return model


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                obs, n = _observations(batch, k, False)
                like = model.forward(obs, n) / _LN10 + batch.column("within")[k].values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[k].values, batch.column("held_out")[k].values, pa.array(n), batch.column("known")[k].values.cast(pa.int64()), batch.column("base")[k].values, pa.array(like)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return rows.mapInArrow(run, SCORED)


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text); the model
    learns from rows whose crc32(doc_id) mod 7 is not 2."""
    block = staged(blocks(docs), "hmm-blocks")
    words = block.select("block", F.posexplode(F.arrays_zip("words", "train"))).select("block", F.col("pos").alias("k"), F.col("col.words").alias("word"), F.col("col.train").alias("train"))
    counts = staged(words.filter("train > 0").groupBy("word").agg(F.sum("train").alias("c")), "hmm-counts")
    rows = block.select(F.explode("held_out").alias("h")).filter("not h").count()
    top = counts.orderBy(F.desc("c"), "word").limit(TOP).select("word").collect()  # a bounded list
    listed = pa.table({"word": pa.array([r.word for r in top], pa.string()), "own": pa.array(range(len(top)), pa.int32())})
    own = staged(docs.sparkSession.createDataFrame(listed), "hmm-top")  # a list of tuples would go through Python workers, which stay
    bucket = F.lit(TOP) + F.pmod(F.crc32(F.right("word", F.lit(2))), F.lit(BUCKETS)).cast("int")
    classed = staged(counts.join(F.broadcast(own), "word", "left").select("word", "c", F.coalesce("own", bucket).alias("class")), "hmm-classes")
    sums = classed.groupBy("class").agg(F.sum(F.col("c") + 1).alias("mass"), F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row per class
    n = sum(r.c for r in sums) + rows
    everything = n + sum(r.v for r in sums) + (rows > 0) + 1
    mass = np.zeros(CLASSES)
    for r in sums:
        mass[r["class"]] = r.mass
    mass[END], mass[UNKNOWN] = (rows + 1 if rows else 0), 1
    totals = {"rows": rows, "log_all": float(np.log10(everything)), "class_log": np.log10(np.maximum(mass, 1))}
    found = words.select("block", "k", "word").join(classed, "word").select("block", "k", "c", "class")
    rows_coded = staged(coded(block, found, totals), "hmm-coded")
    discard(block, counts, classed, own)
    model = trained(rows_coded, mass / mass.sum(), rounds)
    return scored(rows_coded, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
