"""Decontamination and noisy-or toxicity against plain versions of themselves."""

import math
import random
import re

import numpy as np

MARKS = " .,;:!?\"'()[]{}<>*#$&|_~`"


# ---- 4


def tokens(text):
    """(as it is, kind, value) of each word."""
    from lamella.llm.decontam import UNITS

    units = {u.decode() for u in UNITS}
    out, begins = [], True
    for w in (text or "").split():
        bare = w.strip(MARKS)
        low = bare.lower()
        glued = re.match(r"([+-]?\d[\d.,]*)([a-z%/]+)$", low)
        if re.match(r"[+-]?\d[\d.,:/_-]*%?$", bare) or glued and glued[2] in units:
            kind = "num"
        elif low in units and len(low) > 1:
            kind = "unit" if out and out[-1][1] == "num" else None
        elif bare[:1].isupper() and len(bare) > 1 and not bare.isupper():
            kind = None if begins else "name"
        else:
            kind = None
        out.append((low, kind, f"{kind}:{low}"))
        begins = bool(re.search(r"[.!?][\"')\]]*$", w))
    return out


def fits(windows):
    pairs = {p for w in windows for p in w}
    return len({i for i, _ in pairs}) == len(pairs) == len({d for _, d in pairs})


def plain_contamination(docs, items):
    """{(doc, item): longest run that is enough}, by trying every shift and every part of a run."""
    same = {}
    for k, t in items:
        if t is not None:
            same[t] = min(same.get(t, k), k)
    found = {}
    for d, text in docs:
        a = tokens(text)
        for t, k in same.items():
            b = tokens(t)
            if len(b) < 8:
                words = [x[0] for x in b]
                if any(words) and any([x[0] for x in a[j : j + len(b)]] == words for j in range(len(a) - len(b) + 1)):
                    found[d, k] = 1
                continue
            form = lambda x: [(None if y[1] else y[0], y[1]) for y in x]
            rich = [sum(y[1] is None for y in b[i : i + 8]) >= 3 for i in range(len(b) - 7)]
            enough = lambda n, of: n >= max(1, min(6, of - 1))
            for shift in range(-len(b), len(a)):
                run = []
                for i in range(len(b) - 6):
                    x, y = a[max(0, i + shift) : max(0, i + shift + 8)], b[i : i + 8]
                    equal = i + shift >= 0 and len(x) == len(y) == 8
                    if equal and [z[0] for z in x] == [z[0] for z in y]:
                        run.append(([(z[2], z[2]) for z in y if z[1]], rich[i]))
                    elif equal and rich[i] and form(x) == form(y):
                        run.append(([(z[2], w[2]) for z, w in zip(y, x, strict=True) if z[1]], True))
                    else:
                        for p in range(len(run)):
                            for q in range(p + 1, len(run) + 1):
                                if fits([w for w, _ in run[p:q]]) and (enough(q - p, len(rich)) or enough(sum(g for _, g in run[p:q]), sum(rich))):
                                    found[d, k] = max(found.get((d, k), 0), q - p)
                        run = []
    return found


def made(r):
    """Items with many numbers, names and units, and documents with copies of them, whole, broken and re-parameterised."""
    words = "in second min what is the sum of how many apples per hour does train leave reach then left than before after each other total more list next comes which".split()
    names, units = ["Paris", "Rome", "Anna", "Bob"], ["km", "kg", "hours", "minutes", "in", "second"]

    def word():
        x = r.random()
        return str(r.randrange(2, 40)) if x < 0.35 else r.choice(names) if x < 0.45 else f"{r.randrange(2, 9)} {r.choice(units)}" if x < 0.55 else r.choice(words)

    items = [(k, " ".join(word() for _ in range(r.choice((4, 9, 12, 18, 24))))) for k in range(14)]
    items.append((20, items[3][1]))
    docs = []
    for k in range(70):
        w = r.choice(items)[1].split()
        how = r.randrange(5)
        if how == 1:  # a value that stands for one value
            old = r.choice([x for x in w if x.isdigit()] or ["-"])
            w = ["77" if x == old else x for x in w]
        elif how == 2:  # one of several
            at = r.randrange(len(w))
            w[at] = "88" if w[at].isdigit() else w[at]
        elif how == 3:
            w = w[: r.randrange(1, len(w) + 1)]
        elif how == 4:
            w = [r.choice(names) if x in names else x for x in w]
        docs.append((k, " ".join([word() for _ in range(r.randrange(6))] + w + [word() for _ in range(r.randrange(6))])))
    return items, docs + [(100, None), (101, ""), (None, items[5][1])]


def test_decontamination_brute(spark):
    from lamella.llm.decontam import contamination, membership

    for seed in (1, 2):
        items, docs = made(random.Random(seed))
        of = spark.createDataFrame(items, "item_id long, text string")
        got = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), of).collect()
        want = plain_contamination(docs, items)
        assert {(r.doc_id, r.item_id): r.run for r in got} == want and len(want) > 40
        assert {r.n_items for r in got if r.item_id == 3} <= {2} and {r.item_id: r.of for r in membership(of).collect()}[20] == 3


def test_cases_of_the_review(spark):
    """A number-heavy item copied as it is; a long item with only its last number changed; units that are common words."""
    from lamella.llm.decontam import contamination

    items = [(1, "alpha beta gamma delta 1 2 3 4 5 6 7 8 9 iota kappa lambda sigma"), (2, " ".join(f"word{k}x" if k % 5 else str(100 + k) for k in range(1, 42)) + " with 120 and 120"), (3, "put it in the second box in a row and in the end")]
    docs = [(1, "so " + items[0][1] + " end"), (2, items[1][1][:-3] + "75"), (3, "well, " + items[2][1]), (4, items[2][1].replace(" in ", " at "))]
    got = {(r.doc_id, r.item_id) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_without_contaminated(spark):
    """Rows are judged by id and text: clean rows of a null or a repeated id stay."""
    from lamella.llm.decontam import without_contaminated

    item = "one clear question about seven quiet birds that nobody has ever asked anywhere before today"
    docs = [(None, item), (None, "quite clean"), (1, item + " more"), (1, "also clean"), (2, "clean"), (2, "clean"), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS other", "3 AS h")
    left = without_contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([x for x in docs if item not in (x[1] or "")], key=str)
    assert without_contaminated(df.limit(0), spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 0


# ---- 5


def test_noisy_or_plain():
    """Scores and gradient of bags against their definition."""
    from lamella.llm.toxicity import Model, noisy_or, sentence_scores

    r = random.Random(3)
    bags = [[sorted({r.randrange(5) for _ in range(r.randrange(1, 4))}) for _ in range(r.randrange(0, 4))] for _ in range(40)]
    model = Model({bytes([k]): k for k in range(5)}, np.array([0.5, -1.0, 2.0, 0.0, 1.5]), -1.2, 0.03)
    doc, sentence, word = (np.array(x) for x in zip(*[(d, s, w) for d, b in enumerate(bags) for s, ws in enumerate(b) for w in ws], strict=True))
    d, _, p = sentence_scores(model, doc, sentence, word)
    got = noisy_or(model, len(bags), d, p)
    for k, b in enumerate(bags):
        clean = math.prod(1 - 1 / (1 + math.exp(1.2 - sum(model.weights[w] for w in ws))) for ws in b)
        assert abs(got[k] - (1 - 0.97 * clean)) < 1e-9


def test_training_raises_likelihood():
    """The trained weights are a better explanation of the labels than any of many near them."""
    from lamella.llm.toxicity import noisy_or, sentence_scores, train

    r = random.Random(4)
    rows, label = [], []
    for d in range(400):
        toxic = d % 3 == 0
        for s in range(3):
            ws = {r.randrange(2, 6)} | ({r.randrange(2)} if toxic and s == 1 else set())
            rows += [(d, s, w) for w in sorted(ws)]
        label.append(int(toxic))
    doc, sentence, word = (np.array(x) for x in zip(*rows, strict=True))
    label = np.array(label)
    model = train([bytes([k]) for k in range(6)], label, doc, sentence, word)

    def likelihood():
        at, _, p = sentence_scores(model, doc, sentence, word)
        q = np.clip(noisy_or(model, len(label), at, p), 1e-9, 1 - 1e-9)
        return float(np.mean(np.where(label == 1, np.log(q), np.log(1 - q))))

    best, weights = likelihood(), model.weights
    assert min(weights[:2]) > max(weights[2:]) + 1
    for k in range(6):
        model.weights = weights.copy()
        model.weights[k] += 1.5 if k >= 2 else -3.0
        assert likelihood() < best
    model.weights = np.zeros(6)
    assert likelihood() < best


def test_toxicity_edges(spark):
    """Labels above 1, repeated rows and ids, long texts, empty tables."""
    from lamella.llm.toxicity import fit, keep_clean, score

    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)) + ("." if k % 3 else ". you gnarf now.")) for k in range(300)]
    rows += [(3, "another text of the same id")] * 5 + [(5, "x " * 300_000 + "gnarf.")]
    lab = [(k, 0 if k % 3 else 2) for k in range(300)] + [(3, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS least", "0 AS several", "0 AS toxic")
    model = fit(d, spark.createDataFrame(lab, "doc_id long, toxic int"))
    got = score(d, model).collect()
    assert all(x.predicted == (x.doc_id % 3 == 0) for x in got if x.doc_id not in (3, 5))
    assert sorted(x.predicted for x in got if x.doc_id == 3) == [0, 0, 0, 0, 0, 1] and sorted(x.predicted for x in got if x.doc_id == 5) == [0, 1]
    again = fit(d.repartition(5), spark.createDataFrame(lab, "doc_id long, toxic int"))
    assert again.words == model.words and np.allclose(again.weights, model.weights)
    assert keep_clean(d, model).columns == d.columns and keep_clean(d.limit(0), model).count() == 0
