"""Toxicity by multiple-instance learning: documents are bags of sentences, only documents have labels.

A sentence's score is a logistic function of the words in it; a document is toxic unless none of its sentences is:
P = 1 - (1 - leak) * prod(1 - p_s), a noisy-or. The weights are trained on document labels by gradient descent on the
likelihood of P, so blame settles on the sentences that set labelled documents apart, and these can be pointed out
afterwards. Sentences without any word of the vocabulary have p_s = 0. The leak is the share of labels that no sentence
explains; it is the score of a clean or empty text.

The fit uses a bounded sample: the SAMPLE labelled documents whose id has the smallest hash. Its vocabulary: the words,
among those in MIN_DOCS toxic sample documents at least, that are RATIO times as frequent in toxic documents as in others and
whose surplus is Z standard errors at least; the VOCABULARY of largest surplus. Scores are for whole texts of all rows.

Sentences end at words that end in . ! or ? (quotes and brackets may follow) and at line feeds. Words are ASCII
lower-cased, without marks around them. Null and empty texts score the leak and have no offending sentence. Repeated rows
and equal texts score alike. Labels with a null are left out, above 0 they say toxic; of several labels for an id the largest counts. Of
several rows of a sampled id one is learned from, that whose text has the smallest hash. Without any label of
both kinds every score is the share of toxic labels (0 without labels), below 0.5 unless most labels are toxic. An empty
table gives an empty result. Only doc_id and text of documents, doc_id and toxic of labels are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import small_batches, texts

SAMPLE, VOCABULARY, MIN_DOCS, RATIO, Z = 20_000, 512, 5, 4.0, 4.0
STEPS, RATE, RIDGE = 300, 0.2, 1e-3
#: Distinct words that a worker remembers, and bytes of text that it takes at a time.
WORDS_KEPT, CHUNK = 300_000, 2 << 20
_AROUND = b" .,;:!?\"'()[]{}<>*#$%&|-_~`"
_END = re.compile(rb"[.!?][\"')\]]*$")
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+|\n")


@dataclass
class Model:
    words: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -3.0
    leak: float = 0.0


class Bags:
    """Texts to instances: for each word of the vocabulary that a text has, the sentence it stands in."""

    def __init__(self, words: dict[bytes, int]):
        self.words, self.known = words, {b"\n": 1}

    def code(self, token: bytes) -> int:
        """Twice (the word's number + 1, or 0), plus 1 if a sentence ends."""
        n = self.words.get(token.strip(_AROUND), -1)
        return 2 * (n + 1) + (1 if _END.search(token) else 0)

    def instances(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, sentence in it, word, each pair of sentence and word once; ordered by document and sentence."""
        if len(self.known) > WORDS_KEPT:
            self.known = {b"\n": 1}
        found: list[np.ndarray] = []
        for k, d in enumerate(docs):
            tokens = d.lower().replace(b"\n", b" \x00 ").split()
            known = self.known
            codes = np.fromiter(map(known.get, tokens, (-1,) * len(tokens)), np.int64, len(tokens)) if tokens else np.zeros(0, np.int64)
            for j in np.flatnonzero(codes < 0).tolist():
                t = tokens[j]
                c = known.get(t)
                if c is None:
                    c = known[t] = 1 if t == b"\x00" else self.code(t)
                codes[j] = c
            hits = np.flatnonzero(codes > 1)
            if len(hits):
                sentence = np.cumsum(codes & 1) - (codes & 1)
                found.append(np.unique(np.stack([np.full(len(hits), k), sentence[hits], codes[hits] // 2 - 1]), axis=1))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(found, axis=1))  # type: ignore[return-value]


def sentence_scores(model: Model, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, sentence and score of each sentence that has a word of the vocabulary."""
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(sentence) != 0)) if len(doc) else np.zeros(0, bool)
    at = np.cumsum(new) - 1
    z = model.bias + np.bincount(at, model.weights[word], minlength=int(new.sum()))
    return doc[new], sentence[new], 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(model: Model, n: int, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    return 1 - (1 - model.leak) * np.exp(clean)


def train(words: list[bytes], label: np.ndarray, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray) -> Model:
    """Weights by gradient steps (with momentum and scaled by past gradients) on the documents' log likelihood."""
    n, share = len(label), float(label.mean()) if len(label) else 0.0
    if not words or share in (0.0, 1.0):
        return Model(leak=share)
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(sentence) != 0)) if len(doc) else np.zeros(0, bool)
    at, owner = np.cumsum(new) - 1, doc[new]
    unseen = np.setdiff1d(np.arange(n), owner)
    leak = float(np.clip(label[unseen].mean() if len(unseen) else 0.0, 1e-6, 0.45))
    model = Model({w: k for k, w in enumerate(words)}, np.ones(len(words)), -1.0, leak)
    first, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        z = model.bias + np.bincount(at, model.weights[word], minlength=len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.clip(noisy_or(model, n, owner, p), 1e-9, 1 - 1e-9)
        # d log L / d z_s = p_s * (1 - P) / P where toxic, - p_s where not
        slope = np.where(label[owner] == 1, p * (1 - total[owner]) / total[owner], -p)
        g = np.append(np.bincount(word, slope[at], minlength=len(words)) / n - RIDGE * model.weights / len(words), slope.sum() / n)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weights, model.bias = model.weights + move[:-1], float(model.bias + move[-1])
    return model


def held_out_rows(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labels of rows whose crc32(doc_id) mod 5 is not 0."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna()
    lab = lab.filter(~held_out_rows(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows of two numbers: broadcast below
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab), "doc_id")
    # repeated ids: which row of each is learned from (a row of two numbers for each sampled id, at most `sample`, broadcast)
    one = rows.select("doc_id", F.xxhash64("text").alias("least")).groupBy("doc_id").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    several = one.filter("n > 1").select(F.col("doc_id").alias("several"), "least")
    rows = rows.join(F.broadcast(several), F.col("doc_id") == F.col("several"), "left").filter(F.col("several").isNull() | (F.xxhash64("text") == F.col("least")))

    def count(batches):
        for batch in batches:
            seen: list[dict[bytes, int]] = [{}, {}]
            n = [0, 0]
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                n[toxic] += 1
                of = seen[toxic]
                for w in {t.strip(_AROUND) for t in set(text.lower().split())}:
                    of[w] = of.get(w, 0) + 1
            words = sorted(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b"", *words], pa.binary()), pa.array([n[0]] + [seen[0].get(w, 0) for w in words], pa.int64()), pa.array([n[1]] + [seen[1].get(w, 0) for w in words], pa.int64())], names=["word", "clean", "toxic"]
            )

    counts = rows.select("text", "toxic").mapInArrow(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    docs_n = labelled_counts(lab)
    if not min(docs_n):
        return Model(leak=float(docs_n[1] > 0))
    rate = F.col("toxic") / F.lit(docs_n[1])
    base = (F.col("clean") + 0.5) / F.lit(docs_n[0] + 1)
    surplus = (rate - base) / F.sqrt(base / F.lit(docs_n[1]))
    chosen = counts.filter((F.col("word") != F.lit(b"")) & (F.col("toxic") >= MIN_DOCS) & (rate >= RATIO * base) & (surplus >= Z)).orderBy(surplus.desc(), "word").limit(VOCABULARY)
    words = [bytes(r.word) for r in chosen.select("word").collect()]
    numbers = {w: k for k, w in enumerate(words)}

    def bags(batches):
        b = Bags(numbers)
        for batch in batches:
            held = list(texts(batch))
            doc, sentence, word = b.instances(held)
            order = np.searchsorted(doc, np.arange(len(held) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([sentence[i:j] for i, j in zip(order, order[1:], strict=False)], pa.list_(pa.int64())), pa.array([word[i:j] for i, j in zip(order, order[1:], strict=False)], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "sentence", "word"],
            )

    found = rows.select("doc_id", "text", "toxic").mapInArrow(bags, "doc_id long, toxic int, sentence array<long>, word array<long>")
    # equal rows of an id are one
    got = sorted(found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("sentence").alias("sentence"), F.first("word").alias("word")).collect(), key=lambda r: r.doc_id)
    sizes = [len(r.word) for r in got]
    flat = lambda name: np.array([x for r in got for x in r[name]], np.int64)
    return train(words, np.array([min(1, r.toxic) for r in got]), np.repeat(np.arange(len(got)), sizes), flat("sentence"), flat("word"))


def labelled_counts(lab: DataFrame) -> tuple[int, int]:
    n = {r.toxic: r["count"] for r in lab.groupBy("toxic").count().collect()}
    return n.get(0, 0), sum(v for k, v in n.items() if k)


SCORES = "doc_id long, held_out boolean, score double, predicted int, n_offending long, offending array<struct<sentence:long,begin:long,end:long,score:double>>"


def sentence_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the sentences, numbered as Bags does; those without a word have equal ends."""
    spans, begin, end = [], None, 0
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t != b"\n":
            begin = m.start() if begin is None else begin
            end = m.end()
        if t == b"\n" or _END.search(t) or t == b"\x00":
            spans.append((begin if begin is not None else m.start(), end if begin is not None else m.start()))
            begin = None
    if begin is not None:
        spans.append((begin, end))
    return spans


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORES of docs(doc_id, text): the document's score and its sentences of score 0.5 or more, with byte offsets."""

    def run(batches):
        b = Bags(model.words)
        for batch in batches:
            scores, offending = [], []
            for held in chunks(texts(batch)):
                doc, sentence, p = sentence_scores(model, *b.instances(held))
                scores.append(noisy_or(model, len(held), doc, p))
                of: list[list[dict]] = [[] for _ in held]
                for k in np.flatnonzero(p >= 0.5).tolist():
                    of[doc[k]].append({"sentence": int(sentence[k]), "score": float(p[k])})
                for text, found in zip(held, of, strict=True):
                    if found:
                        spans = sentence_spans(text)
                        for x in found:
                            x["begin"], x["end"] = spans[x["sentence"]]
                offending += of
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([len(x) for x in offending], pa.int64()), pa.array(offending, pa.list_(pa.struct([("sentence", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["doc_id", "score", "predicted", "n_offending", "offending"],
            )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(run, SCORES.replace("held_out boolean, ", ""))
    return out.select("doc_id", F.coalesce(held_out_rows(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_offending", "offending")


def chunks(each):
    held, size = [], 0
    for text in each:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5."""
    small = small_batches(docs)
    schema, names = docs.schema, docs.columns

    def run(batches):
        b = Bags(model.words)
        for batch in batches:
            kept = []
            for held in chunks(texts(batch)):
                doc, _, p = sentence_scores(model, *b.instances(held))
                kept.append(noisy_or(model, len(held), doc, p) < 0.5)
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return small.select(*names).mapInArrow(run, schema)
