"""The pipeline's stages on the small tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import toxicity
from evidentia.llm.queries import REG
from evidentia.plans.common import table
from tests.llm.cases import docs_table, no_docs, odd_docs
from tests.llm.test_minhash import brute, sets_of
from tests.llm.test_packing import fill_is_right

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = corpus_pipeline.keep_good(spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, r in labels.items() if r.quality == 1) >= 0.95 * sum(r.quality == 1 for r in labels.values())
    assert sum(i in kept for i, r in labels.items() if r.quality == 0) <= 0.4 * sum(r.quality == 0 for r in labels.values())
    clean = corpus_pipeline.drop_toxic(spark, good, SF).cache()
    net = toxicity.fit(good, table(spark, SF, "labels"))
    flagged = {r.doc_id for r in toxicity.score_rows(good, net).collect() if r.flagged}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == kept - flagged
    single = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    root = brute(sets_of([(r.doc_id, r.text) for r in clean.collect()]))
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i in root if root[i] == i)
    packed = corpus_pipeline.pack(spark, single, SF).collect()
    fill_is_right(packed, 2048)
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("score-", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, no_docs(spark), SF).count() == 0
    single = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8, 9)] + [(True, 0)] * 2


def test_near_copies_by_their_own_words(spark):
    """Rows that share a doc_id are no copies for that, and rows without one may be."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(0), "en"), (1, text(1), "en"), (2, text(0) + " more", "en"), (3, text(1), "fr"), (1, text(1), "en"), (None, text(2), "en"), (None, text(2), "fr")]
    rows += [(None, text(3), "en"), (4, text(3), "en"), (5, "", "en"), (5, "", "en"), (5, None, "en"), (5, " ", "en"), (6, "", "en"), (None, "", "en"), (None, "", "en")]
    got = corpus_pipeline.drop_near_copies(spark, docs_table(spark, rows).withColumn("row", F.lit(1)), SF).collect()
    key = lambda r: str(r)
    expected = [(1, text(0)), (1, text(1)), (None, text(2)), (4, text(3)), (5, ""), (5, " "), (6, ""), (None, ""), (None, "")]
    assert sorted([(r.doc_id, r.text or "") for r in got], key=key) == sorted(expected, key=key)


def test_registered():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in REG.queries}
    assert "pipeline" in queries and set(REG.queries) <= set(queries) and set(REG.sql) <= set(sql)
