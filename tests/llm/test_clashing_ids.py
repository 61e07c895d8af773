"""The near-duplicate stage of the pipeline where ids repeat."""

import corpus_pipeline
from test_llm import prose


def test_texts_of_one_id_are_judged_apart(spark, sf_dir):
    a, b, c, d = prose(31, 60), prose(32, 60), prose(33, 60), prose(34, 60)
    rows = [(3, a, "en"), (7, a, "en"), (7, b, "en"), (9, c, "de"), (9, c, "de"), (11, c + " x", "de"), (None, d, "fr"), (None, d, "fr"), (12, d, "fr"), (13, None, None), (14, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()), key=repr)
    assert kept == sorted([(3, a, "en"), (7, b, "en"), (9, c, "de"), (None, d, "fr"), (None, d, "fr"), (12, d, "fr"), (13, None, None), (14, "", "x")], key=repr)
