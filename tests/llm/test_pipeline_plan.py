import corpus_pipeline


def test_a_language_is_predicted_once(spark):
    docs = spark.createDataFrame([(i, f"the quick brown fox {i}" if i % 2 else f"el perro come pan {i}", "en" if i % 2 else "es", "web", 20) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars int")
    plan = corpus_pipeline.keep_identified(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
