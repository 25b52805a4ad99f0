"""Co-training reads every unlabelled document."""

from pyspark.sql import functions as F

from ledgergraph.llm import quality_model

COLUMNS = "doc_id bigint, text string, source string, lang string, n_chars bigint"


def test_documents_beyond_any_sample_teach(spark):
    ids = [r[0] for r in spark.range(1000, 10000).orderBy(F.xxhash64("id"), "id").collect()]
    text = {1: "alpha alpha alpha alpha", 0: "beta beta beta beta"}
    source = {1: "good", 0: "bad"}
    rows = [(i, text[i % 2], source[i % 2], "en", 20) for i in range(400)]
    rows += [(i, text[i % 2], source[i % 2], "en", 20) for i in ids[:8000]]
    rows += [(i, "zeta zeta zeta zeta", "good", "en", 20) for i in ids[8000:]]  # of the largest id hashes
    rows += [(20000, "zeta zeta zeta zeta", "new", "en", 20), (20001, "omega omega omega omega", "new", "en", 20)]
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(20000, None), (20001, None)], "doc_id bigint, quality int")
    found = {r.doc_id: r.content_score for r in quality_model.classify_quality(spark, docs, labels).where("doc_id >= 20000").collect()}
    assert found[20000] > found[20001] + 0.05
