import os

import pytest

import corpus_pipeline
from webloom.llm import simhash
from webloom.llm.common import cut, read_table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = read_table(spark, SF, "documents")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns, name
        n.append(docs.count())
        if name == "simhash near-dedup":
            assert simhash.similar(docs).count() == 0 and docs.select("text").distinct().count() == n[-1]
    assert n[0] > n[1] >= n[2] >= n[3] > 0 and n[1] > 0.7 * n[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == n[-1] and corpus_pipeline.run(spark, SF).count() == n[-1]


def test_stages_on_an_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_mixing_of_repeated_ids(spark):
    """Rows that share an id, null ones too, are not multiplied by each other."""
    rows = [(None if i % 2 else i % 3, f"text {i} " + "w " * (i % 5), "en", "s", 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixed(spark, docs, SF)
    texts = {r[1] for r in rows}
    per = {r.text: r["count"] for r in out.groupBy("text").count().collect()}
    assert set(per) <= texts and max(per.values()) <= 2 and out.columns == docs.columns
