from perigee.llm import language


def test_a_mixture_alone_is_no_reason_to_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    model = language.fit(docs)
    some = {}
    for r in docs.select("lang", "text").collect():
        some.setdefault(r["lang"], " ".join(r["text"].split()[:40]))
    mixed = " ".join(some[x] for x in sorted(some)[:4])
    lang, score, _ = language.predict([mixed.encode()], model)
    assert lang[0] != "und" and score[0] < 0.5
    df = spark.createDataFrame([(1, mixed), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in language.keep_identified(df, model, least_score=0.5).collect()] == [1]
