"""Each stage of the pipeline with nulls, empty and long texts, repeated rows and ids, ties, clashing columns, and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
CLASH = ("u", "n", "rows", "place", "place_", "maybe", "other", "slot", "label", "mix_id", "mix_nth", "h", "pos", "toxic", "score", "digest", "held_out")
r = random.Random(9)
WORDS = ["".join(r.choice("abcdefghijk") for _ in range(r.randrange(3, 9))) for _ in range(400)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


A, B, LONG = prose(120), prose(80), prose(30_000)
ROWS = [
    (5, A, "en", "s0", 1), (3, A, "en", "s1", 1), (3, A, "en", "s1", 1), (None, A, "en", "s0", 1),  # copies, a repeated row, one without an id
    (3, B, "de", None, 1), (7, B + " more", "de", "s1", 1), (None, B.upper(), "de", "s0", 1),  # another text of the id 3, near copies of it
    (8, None, "fr", "s0", None), (9, "", "fr", "s0", 0), (9, "", "fr", "s0", 0), (None, None, None, None, None), (None, "  \n ", None, "s1", 4),
    (11, LONG, "en", "s0", 1), (12, LONG + " end", "en", "s0", 1), (13, "word", "en", "s2", 4), (14, prose(200), "en", "s2", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASH})


def held(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)


def test_near_duplicates(spark, docs):
    out = STAGES["near_duplicates"](spark, docs, DATA)
    assert out.columns == docs.columns
    # one of the copies of A (the least id), of B and of the long text; every row without words stays
    none = [(i, t) for i, t, *_ in ROWS if not (t or "").split()]
    assert held(out) == sorted([(3, A), (3, B), (11, LONG), (13, "word"), (14, ROWS[-1][1]), *none], key=str)


def test_toxicity(spark, docs):
    out = STAGES["toxicity"](spark, docs, DATA)
    assert out.columns == docs.columns and held(out) == sorted(((i, t) for i, t, *_ in ROWS), key=str)


def test_decontamination(spark, docs):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    more = spark.createDataFrame([(3, f"so {item} it was", "en", "s0", 1), (None, item, "en", "s0", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in CLASH})
    out = STAGES["decontamination"](spark, docs.unionByName(more), DATA)
    assert out.columns == docs.columns and held(out) == sorted(((i, t) for i, t, *_ in ROWS), key=str)


def test_mix_and_ids(spark, docs):
    out = STAGES["mix"](spark, docs, DATA)
    assert out.columns == docs.columns and set(held(out)) <= {(i, t) for i, t, *_ in ROWS}
    ids = STAGES["token_ids"](spark, docs, DATA).collect()
    assert sorted(str(x.doc_id) for x in ids) == sorted(str(i) for i, *_ in ROWS)
    starts = sorted((x.start, x.n_tokens) for x in ids)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), DATA)
    assert out.count() == 0 and (name == "token_ids" or out.columns == docs.columns)
