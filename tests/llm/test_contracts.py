"""The columns that SQL can express of queries that it can't express as a whole, and learned verdicts against a plain reading of the rules."""

import math

import pytest

from tests.conftest import DATA

#: The words of a text, null as empty.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def rows(duck, sql):
    return {r[0]: r[1:] for r in duck.sql(sql).fetchall()}


def test_statistics_and_base(spark, duck):
    from lamella.llm.queries import QUERIES

    want = rows(
        duck,
        f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
        g AS (SELECT doc_id, k, [w[k], w[k + 1], w[k + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM t)),
        r AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM r, (SELECT unnest(range(3)) AS j) GROUP BY 1),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
        d AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY 1)
        SELECT t.doc_id, len(w), list_sum(list_transform(w, lambda x: length(x)))::BIGINT, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), coalesce(d.n, 0)::BIGINT, coalesce(c.n, 0) FROM t LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)""",
    )
    got = QUERIES["op3_decision_list"](spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        n, chars, symbols, lines, repeats = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars or 0, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)


def test_kept_is_what_the_rules_say(spark):
    from lamella.llm.common import table
    from lamella.llm.declist import judge, statistics

    more = DATA.replace("sf0.001", "sf0.01")  # the labels of the smallest tables are too few for a rule
    docs, labels = table(spark, more, "documents"), table(spark, more, "labels")
    out, rules = judge(docs, labels)
    assert rules
    stats = {r.doc_id: r.asDict() for r in statistics(docs).collect()}
    holds = lambda c, s: s[c.feature] > c.threshold if c.above else s[c.feature] <= c.threshold
    for r in out.collect():
        s = stats[r.doc_id]
        assert r.kept == (not r.base_failed and not any(all(holds(c, s) for c in rule) for rule in rules))


def test_mix_targets(spark, duck):
    from lamella.llm.queries import QUERIES

    sizes = rows(duck, f"SELECT doc_id, len({WORDS}), source FROM documents")
    of: dict = {}
    for n, s in sizes.values():
        of[s] = of.get(s, 0) + n
    order = sorted(of, key=lambda s: (s is None, s))
    weight, capped, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set(), 1.5 * sum(of.values())
    while True:
        left = total - sum(2 * of[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and level * weight[s] > 2 * of[s]}
        if not more:
            break
        capped |= more
    taken: dict = {}
    for r in QUERIES["op6_cube_mix"](spark, DATA).collect():
        n, s = sizes[r.doc_id]
        assert (r["size"], r.source_size) == (n, of[s]) and 0 <= r.taken <= 2 * n
        assert math.isclose(r.target, 2 * of[s] if s in capped else level * weight[s], rel_tol=1e-9)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - (2 * of[s] if s in capped else level * weight[s])) <= 0.02 * of[s] + 50 for s in order)


def test_base_scores(spark, duck):
    from lamella.llm.queries import QUERIES

    import zlib

    texts = rows(duck, "SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM documents")
    counts: dict = {}
    for k, (ws,) in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in [*ws, "\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in QUERIES["op2_hidden_markov"](spark, DATA).collect():
        ws = [*texts[r.doc_id][0], "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)


def test_likelihood_rises(spark):
    """Each round of Baum-Welch explains the training texts better than the one before."""
    import numpy as np

    from lamella.llm import hmm

    rng = np.random.default_rng(3)
    obs = [rng.integers(0, 40, rng.integers(3, 30)).astype("<u2") for _ in range(60)]
    n = [len(x) for x in obs]
    schema = "held_out array<boolean>, n array<int>, classes binary"
    df = spark.createDataFrame([([False] * 30, n[:30], np.concatenate(obs[:30]).tobytes()), ([False] * 30, n[30:], np.concatenate(obs[30:]).tobytes())], schema)
    share = np.full(hmm.CLASSES, 1e-6)
    share[:40] = 1.0
    model = hmm.trained(df, share / share.sum(), rounds=8, gain=-1.0)
    assert len(model.likes) == 8 and all(b > a - 1e-6 for a, b in zip(model.likes, model.likes[1:], strict=False)) and model.likes[-1] > model.likes[0]
    assert len(hmm.trained(df, share / share.sum(), rounds=8, gain=10.0).likes) == 2
    with pytest.raises(ValueError):
        hmm._planes(np.array([1 << 24]))
