"""Languages of which all documents are long."""

from quernel.llm.language_id import identify, learn


def test_language_of_long_documents_alone(spark):
    words = {"aa": "bana kada mala tara saba", "ee": "bene kede mele tere sebe"}
    rows = [(i, " ".join(w.split()[(i + k) % 5] for k in range(4500)), lang) for i in range(12) for lang, w in words.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = learn(docs)
    assert field is not None and set(field.labels) == set(words)
    short = spark.createDataFrame([(1, "mala bana tara"), (2, "mele bene tere")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(short, field).collect()} == {1: "aa", 2: "ee"}
