import corpus_pipeline
from strandline.llm import jaccard, language, packing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_their_operators(spark):
    docs = queries.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    first = corpus_pipeline.decided_language(spark, docs, SF)
    model = language.fit(queries.learning(docs))
    want = {r["doc_id"] for r in docs.collect() if not model.predict(r["text"])[2]}
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == want
    second = corpus_pipeline.not_toxic(spark, first, SF)
    chain = toxicity.fit(queries.learning(first), queries.table(spark, SF, "labels"))
    want = {r["doc_id"] for r in first.collect() if chain.score([r["text"]], toxicity.THRESHOLD)[0][0] < toxicity.THRESHOLD}
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == want
    third = corpus_pipeline.one_of_each_group(spark, second, SF)
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.similar_documents(second).collect()}
    assert {r["doc_id"] for r in third.collect()} == set(classes.values())
    assert {r["doc_id"] for r in packing.pack(third, queries.WORD_TOKENIZER).collect()} == set(classes.values())


def test_run_gives_whole_documents(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    for _, part in out.groupby("doc_id"):
        assert part["length"].sum() == part["doc_tokens"].iat[0]
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
