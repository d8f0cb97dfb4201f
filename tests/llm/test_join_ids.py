"""The n-gram join on ids that repeat, and on ids of other types."""

from docspark.llm import ngram_join

A, B, C = ("one two three four five six seven eight", "a quite other text that has nothing in common", "and a third one with words of its own only")


def test_one_id_on_several_texts(spark):
    docs = spark.createDataFrame([(7, A, "x"), (7, B, "x"), (9, C, "x"), (9, C, "y"), (11, B, "z")], "doc_id long, text string, rows string")
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect())
    assert kept == sorted([(7, A), (7, B), (9, C)])
    got = sorted((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"], r["n_linked_docs"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == [(7, 7, 1, 0, 0), (7, 7, 2, 0, 1), (9, 9, 2, 0, 1), (9, 9, 2, 0, 1), (11, 7, 2, 0, 1)]


def test_text_ids(spark):
    near = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([("a2", near), ("a1", near + " end"), ("b", C), (None, C)], "doc_id string, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {"a1": ("a1", 1), "a2": ("a1", 1), "b": ("b", 0), None: (None, 0)}
    assert sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(docs).collect()) == ["None", "a1", "b"]
    assert ngram_join.ngram_join(docs).schema["class_id"].dataType.simpleString() == "string"


def test_query_against_sql(same_as_oracle):
    from docspark.llm import queries

    same_as_oracle(queries.op5_ngram_join, queries.ORACLE_SQL["op5_ngram_join"])
