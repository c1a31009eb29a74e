"""The registered queries against their SQL, and the pipeline against what each stage must keep."""

import pytest

from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA
from lamella.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == duck_rows(duck, ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline as p
    from lamella.llm.common import staged, table
    from lamella.llm.decontam import contamination
    from lamella.llm.jaccard import near_duplicates
    from lamella.llm.toxicity import fit, score

    docs = table(spark, DATA, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = staged(p.STAGES[0][1](spark, docs, DATA), "a")
    assert a.columns == docs.columns and ids(a) == ids(score(docs, fit(docs, table(spark, DATA, "labels"))).filter("predicted = 0"))
    b = staged(p.STAGES[1][1](spark, a, DATA), "b")
    assert b.columns == docs.columns and ids(b) == {r.component_id for r in near_duplicates(a).collect()}
    c = staged(p.STAGES[2][1](spark, b, DATA), "c")
    assert ids(c) == ids(b) - ids(contamination(b, table(spark, DATA, "benchmark")))
    d = staged(p.STAGES[3][1](spark, c, DATA), "d")
    assert d.columns == docs.columns and ids(d) <= ids(c)
    assert p.STAGES[4][1](spark, d, DATA).count() == d.count() == p.run(spark, DATA).count()
