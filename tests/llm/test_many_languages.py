"""More languages than the model has room for: the most frequent ones are learned, the others never predicted."""

from pyspark.sql import functions as F

from graphloom.llm import language_id


def test_the_most_frequent_languages_are_learned(spark, make_docs):
    rows = [(i, f"wort{i % 300} haus{i % 300}", f"l{i % 300:03d}") for i in range(600)] + [(1000 + i, "the house of words", "en") for i in range(9)]
    docs = make_docs(rows)
    labelled = docs.where("lang IS NOT NULL").select("doc_id", "lang", "text")
    langs, _, _ = language_id.train(labelled, max_languages=3)
    assert langs == ["en", "l000", "l001"]
    got = language_id.predict(docs, F.lit(True)).collect()
    assert len(got) == 609 and len({r.lang_pred for r in got}) <= language_id.MAX_LANGUAGES
    assert {r.lang_pred for r in got if r.doc_id >= 1000} == {"en"}
