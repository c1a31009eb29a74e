"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against a
brute-force version or an exact round trip."""

import base64
import collections
import functools
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(4)
VOCAB = ["the", "of", "and", "tion", "Reading", "über", "élan", "ñandú", "x1", "don't", "a,b", "end.", "why?", "日本", "🙂", "12", "<|endoftext|>", "</s>"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]


def sentence(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@functools.cache
def corpus():
    base = [sentence(rng.randrange(1, 90)) for _ in range(60)]
    texts = [*base, *base[:8], None, "", "   \n\t ", base[9].upper(), "word", "one two three four", "\x0b\x0c mixed\x1fup\x85 spaces", "q" * 3000, " ".join(["same"] * 400), sentence(4000), base[10] + " tail", base[11] + "\n" + base[12]]
    rows = [(k, t, "en", f"s{k % 3}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[20], "en", "s0", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Rows in several partitions, with columns whose names operators use inside."""
    df = spark.createDataFrame(corpus(), DOCS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("u", "n", "k", "size", "maybe", "Slot", "bits", "held_out", "words", "block", "mix_id", "digest", "other")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").encode().lower().decode()


# ---- common


def test_sieve(spark, docs):
    from lamella.llm.common import sieve, without

    ids = spark.createDataFrame([(3,), (5,)], "doc_id long")
    assert {r.doc_id for r in sieve(docs, ids, flag="perhaps").filter("perhaps").collect()} >= {3, 5}
    left = without(docs, ids)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in corpus() if r[0] not in (3, 5))


def test_components(spark):
    from lamella.llm.components import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (60, 61)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1


def test_warc(spark):
    from lamella.llm.warc import archive_pages

    rows = [(1, "http://a/x y", "<p>ä</p>"), (2, "http://b", "<p>ä</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "x" * 300_000), (6, "http://f", "HTTP/1.1 \r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://f", "HTTP/1.1 \r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://g", "<p>ä</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).repartition(3)
    got = archive_pages(pages).collect()
    assert len(got) == len(rows)
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    by = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    for r in got:
        h = next((x[2] or "") for x in rows if x[0] == r.page_id)
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert by[2, "response", None] == 1 and by[1, "revisit", 2] == 1 and by[None, "revisit", 2] == 1
    assert by[6, "response", None] == 1 and by[6, "revisit", 6] == 1
    assert by[4, "response", None] == 1 and by[3, "revisit", 4] == 1 and by[5, "response", None] == 1
    small = archive_pages(pages, least=10).filter("page_id = 3").first()
    assert small.record_type == "response"
    assert archive_pages(pages.limit(0)).count() == 0


def test_arc_versions():
    from lamella.llm.warc import Stream, arc_line, arc_records, arc_version_block, warc_date

    for version in (1, 2):
        data = arc_version_block(version, "f.arc") + arc_line(version, "http://a", "20010203040506", "text/html", 0, "f.arc", "-", 5) + b"\nab\n\n" + b"\n" + arc_line(version, "http://b", "2001", "text/html; charset=x", 9, "f.arc", "-", 0) + b"\n"
        for packed in (data, gzip.compress(data)):
            r = list(arc_records(Stream(io.BytesIO(packed), block=7)))
            assert [(x["URL"], x["content"], x["version"]) for x in r] == [("http://a", b"\nab\n\n", version), ("http://b", b"", version)]
    assert warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc_date("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(arc_records(Stream(io.BytesIO(data[:-30]))))


# ---- 2


def test_hidden_markov(docs, none):
    from lamella.llm.hmm import score_texts

    rows = corpus()
    tokens = [[*lower(t).encode().split(), b"\n"] for _, t, *_ in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, *_ in rows]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((k, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for (k, *_), t, h in zip(rows, tokens, held, strict=True))
    got = score_texts(docs, rounds=2).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert score_texts(none).count() == 0


def test_recursions_against_all_paths():
    from lamella.llm import hmm

    r = np.random.default_rng(2)
    k = 3
    start, move, emit = r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.random((hmm.CLASSES, k))
    m = hmm.Model(start, move, emit)
    lengths = np.array([4, 1, 3])
    obs = np.array([0, 1, 2, 1, 2, 0, 0, 1])
    first = np.cumsum(lengths) - lengths
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for x, n, like in zip(first, lengths, m.forward(obs, lengths), strict=True):
        total, paths = 0.0, []
        for path in np.ndindex(*[k] * n):
            p = start[path[0]] * np.prod([move[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.prod([emit[obs[x + t], s] for t, s in enumerate(path)])
            total += p
            paths.append((path, p))
        assert abs(math.log(total) - like) < 1e-9
        for path, p in paths:
            starts[path[0]] += p / total
            for t, s in enumerate(path):
                emits[obs[x + t], s] += p / total
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / total
    for got, want in zip(m.expected(obs, lengths)[:3], (starts, moves, emits), strict=True):
        assert np.allclose(got, want)


def test_recursions_of_long_texts(monkeypatch):
    """Texts that end in different windows of steps, against a plain recursion of one text after the other: the same counts, at less than half of its time."""
    import time

    from lamella.llm import hmm

    r = np.random.default_rng(4)
    k = hmm.STATES
    emit = r.dirichlet(np.full(hmm.CLASSES, 0.1), k).T + 1e-12  # some classes are next to impossible in some states
    m = hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), emit)
    lengths = np.array([1, 12000, 700, 1, 3001, 33, 2])
    obs = r.integers(0, hmm.CLASSES, lengths.sum()).astype("<u2")

    def plain():
        starts, moves, emits, likes = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k)), []
        for x, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
            e = m.emit[obs[x : x + n]]
            alpha, c = np.empty((n, k)), np.empty(n)
            for t in range(n):
                a = (alpha[t - 1] @ m.move if t else m.start) * e[t]
                c[t] = a.sum()
                alpha[t] = a / c[t]
            likes.append(np.log(c).sum())
            beta = np.ones(k)
            for t in range(n - 1, -1, -1):
                emits[obs[x + t]] += alpha[t] * beta
                if t:
                    back = e[t] * beta / c[t]
                    moves += np.outer(alpha[t - 1], back) * m.move
                    beta = m.move @ back
                else:
                    starts += alpha[0] * beta
        return starts, moves, emits, likes

    def timed(f):
        begin = time.process_time()
        return f(), time.process_time() - begin

    (*want, likes), slow = timed(plain)
    for window, together in ((hmm.WINDOW, hmm.TOGETHER), (64, hmm.TOGETHER), (1, 5000)):
        monkeypatch.setattr(hmm, "WINDOW", window)
        monkeypatch.setattr(hmm, "TOGETHER", together)
        assert np.allclose(m.forward(obs, lengths), likes, rtol=1e-12)
        *got, like = m.expected(obs, lengths)
        assert abs(like - sum(likes)) < 1e-8 * abs(like)
        assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(got, want, strict=True))
    monkeypatch.undo()
    assert min(timed(lambda: m.expected(obs, lengths))[1] for _ in range(3)) < slow / 2


def test_numbers_of_blocks():
    """Numbers come back from their planes, without being held several times."""
    import tracemalloc

    from lamella.llm import hmm

    for ids in (np.zeros(0, np.int64), np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1]), np.arange(1_000_000)):
        data = hmm._planes(ids)
        tracemalloc.start()
        back = hmm._from_planes(data)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(back, ids) and peak < 8 * len(ids) + 10_000


def test_no_python_rows(docs, monkeypatch):
    """The list of frequent words becomes a table without a stage of Python workers, which would stay beside those that code blocks."""
    from pyspark.core.rdd import RDD

    from lamella.llm.hmm import score_texts

    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: pytest.fail("rows went through Python workers"))
    assert score_texts(docs, rounds=1).count() == len(corpus())


# ---- 3


def test_statistics(docs, none):
    from lamella.llm.declist import statistics

    def brute(t):
        w = words(t)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in statistics(docs).collect())
    assert got == collections.Counter((k, *brute(t)) for k, t, *_ in corpus())
    assert statistics(none).count() == 0


def test_decision_list(spark, none):
    from lamella.llm.declist import FEATURES, grow_list, judge

    r = random.Random(1)
    rows = []
    for _ in range(600):
        f = {x: r.random() for x in FEATURES}
        rows.append((f, f["symbol_share"] > 0.8 or (f["repeat_share"] > 0.6 and f["n_words"] < 0.3)))
    rules = grow_list(rows)

    def hits(f):
        return any(all((f[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)

    assert rules and sum(hits(f) == m for f, m in rows) > 0.93 * len(rows)
    assert grow_list([(f, False) for f, _ in rows]) == [] and grow_list([]) == []
    good = [(k, " ".join(r.choice(VOCAB[20:]) for _ in range(80))) for k in range(200)]
    bad = [(k + 200, " ".join(r.choice(VOCAB[20:]) + "###" for _ in range(80))) for k in range(60)]
    d = spark.createDataFrame([*good, *bad, (900, None), (901, "few words")], "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(900, None), (None, 0)], "doc_id long, quality int")
    out, rules = judge(d, lab)
    kept = {x.doc_id for x in out.filter("kept").collect()}
    assert kept == set(range(200)) and rules
    unlabelled, rules = judge(d, lab.limit(0))
    assert rules == [] and unlabelled.filter("kept = base_failed").count() == 0
    assert judge(none, lab)[0].count() == 0


# ---- 4


def test_decontamination(spark, none):
    from lamella.llm.decontam import contamination

    item = "A train leaves Paris at 9 with 120 people and reaches Lyon after 4 hours so how many people per hour did the train from Paris carry when 120 stayed"
    other = "Every shingle of this item is its own and none of it has any number or any name in it at all so it only matches itself"
    items = spark.createDataFrame([(1, item), (2, other), (3, other), (4, "too short"), (5, None)], "item_id long, text string")
    again = item.replace("120", "75").replace("Paris", "Rome").replace(" 9 ", " 11 ")
    uneven = item.replace("with 120", "with 75")
    rows = [(10, "Before it. " + item + " after it"), (11, "so " + again), (12, "so " + uneven), (13, other.upper()), (14, sentence(300)), (15, None), (16, ""), (17, item[:40]), (10, item), (None, other)]
    got = {(r.doc_id, r.item_id): r.changed for r in contamination(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)), items.withColumn("h", F.lit(1))).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 1), (13, 2), (None, 2)} and got[10, 1] == 0 and got[11, 1] > 0  # 12: consistent up to its last words
    assert contamination(none, items).count() == 0 and contamination(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).count() == 0


def test_decontamination_split_runs(spark):
    from lamella.llm.decontam import consistent, contamination

    item = "A train leaves Paris at 9 with 120 people and reaches Lyon after 4 hours so how many people per hour did the train from Paris carry when 120 stayed"
    uneven = item.replace("with 120", "with 75")
    broken = item.replace("120 stayed", "75 " + "and then it goes on in quite another way than before")
    mixed = " ".join(w if k % 2 else w + str(k) for k, w in enumerate(item.split()))
    rows = [(1, uneven), (2, broken), (3, item.replace("120", "75")), (4, mixed)]
    got = {r.doc_id: r for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].changed == 1 and got[1].run == 21 and got[1].begin == 0
    assert got[2].changed == 0 and got[2].run == 21 and got[2].begin == 0
    assert got[3].changed == 1 and got[3].run == 23
    same, other = ("1:2", "1:2"), ("1:2", "1:3")
    assert consistent([[same], [same], [other], [other], [same, other], [same]]) == [(0, 2), (2, 4), (5, 6)] and consistent([]) == []


def test_decontamination_short_and_numbers(spark):
    from lamella.llm.decontam import contamination

    items = [(1, "Which number comes next after 2 4 8 16 32 64 128 256 in this list of numbers"), (2, "What is 7 times 8"), (3, "1 2 3 5 8 13 21 34 55 89"), (4, "Berlin leads the league by 9 points now"), (5, "*** ##")]
    rows = [(k, f"so they said {t}, and went on") for k, t in items[:4]]
    rows += [(11, items[0][1].replace("16 32", "17 33")), (12, "What is 7 times 9"), (13, "1 2 3 4 5 6 7 8 9 10 11"), (14, "*** ## and more"), (None, "What is 7 times 8? What is 7 times 8?"), (15, items[0][1].upper())]
    got = {(r.doc_id, r.item_id): r for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (None, 2), (15, 1)} and not any(r.changed for r in got.values())
    assert got[1, 1].run == got[1, 1].item_windows == 11 and got[2, 2].run == 1 and got[2, 2].begin == 3


# ---- 5


def test_toxicity(spark, none):
    from lamella.llm.toxicity import fit, keep_clean, score

    r = random.Random(2)
    plain = [w for w in VOCAB[20:]]
    rows, lab = [], []
    for k in range(500):
        parts = [" ".join(r.choice(plain) for _ in range(8)) + "." for _ in range(5)]
        if k % 4 == 0:
            parts[r.randrange(5)] = f"you are a {r.choice(['Blargh', 'snorf'])}, really."
        rows.append((k, " ".join(parts)))
        lab.append((k, int(k % 4 == 0)))
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "you blargh")], "doc_id long, text string").withColumn("toxic", F.lit(0)).repartition(3)
    model = fit(d, spark.createDataFrame([*lab, (900, None), (None, 1)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in score(d, model).collect()}
    assert sum(got[k].predicted == t for k, t in lab if got[k].held_out) == sum(got[k].held_out for k, _ in lab)
    assert got[900].predicted == got[901].predicted == 0 and got[None].predicted == 1 and all(0 <= x.score <= 1 for x in got.values())
    text = dict(rows)[0]
    found = [text.encode()[o.begin : o.end].decode() for o in got[0].offending]
    assert len(found) == 1 and found[0].startswith("you are a") and found[0].endswith("really.")
    assert {x.doc_id for x in keep_clean(d, model).collect()} == {k for k, x in got.items() if not x.predicted}
    assert score(none, model).count() == 0
    assert score(d, fit(d, spark.createDataFrame([], "doc_id long, toxic int"))).filter("predicted = 1").count() == 0


# ---- 6


def test_cube_mix(docs, none):
    from lamella.llm.balance import mix, mixed

    got = mix(docs).collect()
    rows = corpus()
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == collections.Counter((k, s, len(words(t))) for k, t, _, s, _ in rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: dict = {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        total = sum(weight[s] for s in order if s not in capped)
        new = {s: 2.0 * sizes[s] for s in order if s not in capped and left * weight[s] / total > 2 * sizes[s]}
        if not new:
            break
        capped |= new
    target = {s: capped.get(s, left * weight[s] / total) for s in order}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.35 * max((len(words(t)) for _, t, _, x, _ in rows if x == s)))
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in rs)
    assert key(got) == key(mix(docs.repartition(5)).collect())
    out = mixed(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert mix(none).count() == 0 and mixed(none).count() == 0


def test_flight_keeps_sums():
    from lamella.llm.balance import flight, landing

    r = random.Random(5)
    sizes, p = [float(r.randrange(1, 900)) for _ in range(3000)], [0.3] * 3000
    q = flight(sizes, p, random.Random(1))
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(q) - 900) < 1e-3 and abs(sum(a * b for a, b in zip(sizes, q, strict=True)) - 0.3 * sum(sizes)) < 1
    assert all(x in (0.0, 1.0) for x in landing(sizes, q, 0, 0))
    mean = np.mean([flight([1.0, 5.0, 9.0, 2.0], [0.2, 0.5, 0.7, 0.4], random.Random(k)) for k in range(4000)], axis=0)
    assert np.allclose(mean, [0.2, 0.5, 0.7, 0.4], atol=0.03)


# ---- 7


def test_licences(spark, none):
    from lamella.llm.licences import ANCHORS, SENTENCES, scan

    assert all(any(a in s for a in ANCHORS) for s in SENTENCES) and all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in SENTENCES)
    ids = {v: k for k, v in SENTENCES.items()}
    full = ". ".join(ids[x].upper() for x in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")) + "."
    rows = [(1, "Text.\nReleased under the MIT License."), (2, f"x.\n{full}\ny"), (3, "the licence is unknown"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (6, "Licensed under CC BY-NC 4.0."), (7, ids["mit-grant"] + ".\nother words.\n" + ids["mit-notice"])]
    got = sorted((r.doc_id, r.rule, r.n_found) for r in scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))).collect())
    assert got == [(1, "mit-reference", 1), (2, "mit-full", 1), (6, "apache-reference", 1), (6, "cc-by-nc-reference", 1), (6, "cc-by-nc-reference", 1)]
    assert scan(none).count() == 0


# ---- 8


def shingles(t):
    w = lower(t).encode().split()
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i) if i is not None else least[r]
    return collections.Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def near_copies():
    r = random.Random(8)
    rows = []
    for g in range(12):
        base = [r.choice(VOCAB[20:]) for _ in range(r.choice((6, 30, 120, 400)))]
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 18) + 1)):
                w[r.randrange(len(w))] = r.choice(VOCAB[20:])
            rows.append((1000 - len(rows) * 3, " ".join(w) + (" " + " ".join(r.choice(VOCAB[20:]) for _ in range(r.randrange(len(w) // 3 + 1))) if g % 2 else "")))
    return rows


def test_jaccard(spark, docs, none, monkeypatch):
    from lamella.llm import jaccard

    same = [(r[0], r[1]) for r in corpus()]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == brute_components(same)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "PER_FRAGMENT", 300)
    monkeypatch.setattr(jaccard, "SPLIT", 2)
    monkeypatch.setattr(jaccard, "PER_GROUP", 3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == brute_components(rows)
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    assert kept == {c for _, _, c in got}
    assert jaccard.near_duplicates(none).count() == 0


def test_bound():
    from lamella.llm.jaccard import needed, prefix

    r = random.Random(3)
    for _ in range(3000):
        n = r.randrange(1, 60)
        a = set(r.sample(range(90), n))
        b = set(a)
        for _ in range(r.randrange(0, n // 4 + 1)):
            b.discard(r.choice(sorted(b))) if len(b) > 1 and r.random() < 0.5 else b.add(r.randrange(90))
        o = len(a & b)
        if 100 * o >= 75 * (len(a) + len(b) - o):
            assert o >= needed(len(a), len(b))
            pa, pb = (set(sorted(x)[: prefix(len(x))]) for x in (a, b))
            assert len(pa & pb) >= max(1, needed(len(a), len(b)) - max(len(a) - len(pa), len(b) - len(pb)))


# ---- 9, 10

ODD = ["", " ", "  a", "▁", "▁ ▁x", "<s></s><unk><0x41>", "日本語 中文", "😀😀", "\x00a", "ab" * 4000, " " * 3000, "\n\t\x0b", "\xa0x　y", "ÀÉ Straße÷x þÿ ẞ", "a.b, c. d.. é, É. 'S it's,", "<|endoftext|> <|ENDOFTEXT|>.", "ﬁ İI Ώ."]


def test_transducer(docs, none):
    import sentencepiece

    from lamella.llm.transducer import Transducer, Pieces, count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path).collect())
    n = [len(library.encode(t or "")) for _, t, *_ in corpus()]
    assert got == collections.Counter((k, len((t or "").encode()), c, c > 4096) for (k, t, *_), c in zip(corpus(), n, strict=True))
    t = Transducer(Pieces(path))
    r = random.Random(6)
    odd = [*ODD, "".join(r.choice("etaoin") for _ in range(9000)), *("".join(r.choice(["the", "ing", " ", "  ", "\n", "é", "▁", "​", "日", "🤖", "...", "A"]) for _ in range(40)) for _ in range(60))]
    assert t.count([x.encode() for x in odd]).tolist() == [len(library.encode(x)) for x in odd]
    assert count_tokens(none, path).count() == 0


def test_packing():
    from lamella.llm.bitpack import BLOCK, Reader, Writer, bits_for, pack, unpack

    r = np.random.default_rng(7)
    for bits in (1, 3, 8, 11, 16, 17, 31, 32):
        x = r.integers(0, 2**bits, 5003).astype("<u4")
        assert np.array_equal(unpack(pack(x, bits), len(x), bits), x) and len(pack(x, bits)) == (5003 * bits + 7) // 8
    assert [bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]

    class File(io.BytesIO):
        def close(self):
            pass

    f = File()
    w = Writer(f, 17)
    texts = [r.integers(0, 1 << 17, n).astype("<u4") for n in (0, 5, BLOCK, 3 * BLOCK + 7, 1)]
    for k, x in enumerate(texts):
        w.add(None if k == 2 else k, x)
    w.close()
    reader, whole = Reader(f), np.concatenate(texts)
    assert all(np.array_equal(reader.document(k), x) for k, x in enumerate(texts)) and reader.null_ids.tolist() == [2]
    for a, b in ((0, 0), (3, 9), (BLOCK - 1, BLOCK + 1), (70_000, 200_000), (len(whole) - 1, len(whole))):
        assert np.array_equal(reader.ids(a, b), whole[a:b])
    with pytest.raises(ValueError):
        Reader(io.BytesIO(f.getvalue()[:-3]))


def test_token_files(docs, none, monkeypatch):
    from tokenizers import Tokenizer

    from lamella.llm import bitpack

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = {}
    for k, t, *_ in corpus():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        rows.setdefault(k, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = bitpack.token_files(docs, path).collect()
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == k) for k in rows}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert bitpack.token_files(none, path).count() == 0
    e = bitpack.WordEncoder(path, kept=40)
    for part in (ODD, VOCAB, ODD):
        assert all(np.array_equal(x, library.encode(t, add_special_tokens=False).ids) for t, x in zip(part, e.encode([t.encode() for t in part]), strict=True))


def test_licences_of_wrapped_standard_texts(spark):
    import textwrap

    from lamella.llm.licences import SENTENCES, STANDARD, anchors, scan

    assert all(any(a in k for a in anchors()) for k in {**SENTENCES, **STANDARD})
    by = {}
    for k, i in SENTENCES.items():
        by[i] = max(k, by.get(i, ""), key=len)
    full = lambda *ids: ". ".join(by[i] for i in ids) + "."
    bsd = [by[i] for i in ("bsd-permission", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    texts = {
        "mit-full": full("mit-grant", "mit-notice", "mit-warranty", "mit-liability"),
        "bsd-3": f"{bsd[0]}:\n\n1. {bsd[1]}.\n\n2. {bsd[2]}.\n\n3. {bsd[3]}.\n\n{bsd[4]}.",
        "bsd-2": f"{bsd[0]}:\n\n1. {bsd[1]}.\n\n2. {bsd[2]}.\n\n{bsd[4]}.",
        "gpl3-header": gpl,
        "gpl2-header": gpl.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2"),
        "mpl2-reference": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed",
        "unlicense-reference": "This is free and unencumbered software released into the public domain.",
        "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    }
    fill = lambda t, w: "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))
    comment = lambda t: "\n".join(" * " + line for line in t.split("\n"))
    for form in (lambda t: t, lambda t: fill(t, 72), lambda t: fill(t, 30), lambda t: comment(fill(t, 72))):
        rows = [(k, "Some words before\n\n" + form(t)) for k, t in enumerate(texts.values())]
        got = {r.doc_id: r.rule for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == dict(enumerate(texts))
    lines = "words without an end\nMIT License\nother words"
    assert [(r.rule, r.n_known) for r in scan(spark.createDataFrame([(1, lines)], "doc_id long, text string")).collect()] == [("mit-heading", 1)]
