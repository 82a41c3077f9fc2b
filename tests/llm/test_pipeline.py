import corpus_pipeline as C

from variloom.llm import queries


def test_stages(spark, sf):
    docs = C.table(spark, sf, "documents")
    before = docs.count()
    counts = []
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert before > counts[0] > counts[1] >= counts[2] == counts[3]
    pieces = C.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() == counts[3]
    assert not docs.where(docs.text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9]")).count()


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
