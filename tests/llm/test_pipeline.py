"""The stages over a small corpus with planted cases."""

import random

import pyarrow as pa
import pytest

from graphloom.llm.arrow_batches import small_batches

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, make_docs, prose, odd_texts, tmp_path):
    rng = random.Random(3)
    rows = [(i, t, "en", "src1") for i, t in enumerate(odd_texts)]
    for i in range(60):
        text = prose(60, i)
        rows.append((100 + i, f"{text} scum moron" if i % 3 == 0 else text, rng.choice(["en", "de"]), f"src{i % 4}"))
    rows += [(500 + i, rows[11][1], "en", "src0") for i in range(3)] + [(600, f"{prose(30, 900)} a@b.org", "en", "src0")]
    labels = [(i, 1, int("scum" in (t or ""))) for i, t, *_ in rows]
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert name == "packing" or now.columns == docs.columns
        now.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "pii":
            assert "[EMAIL]" in now.where("doc_id = 600").first().text
    assert ids["toxicity"] == {i for i, t, *_ in rows if "scum" not in (t or "")}
    assert ids["near_dup"] == ids["toxicity"] - {500, 501, 502}
    assert ids["pii"] == ids["near_dup"] and ids["mixing"] <= ids["pii"] and ids["packing"] == ids["mixing"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(final) == key(now)


def test_empty(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_in_small_batches(spark, make_docs):
    """In what a stage runs itself; the session's setting is put back, also after an error."""
    docs = make_docs([(i, "word " * 400) for i in range(6000)]).select("doc_id", "text").coalesce(1)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    with small_batches(spark):
        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 4_500_000
    assert spark.conf.get(bound) == before
    corpus_pipeline.pack_tokens(spark, docs, "").count()
    assert spark.conf.get(bound) == before
    try:
        spark.conf.set(bound, "1m")
        with pytest.raises(KeyError), small_batches(spark):
            assert spark.conf.get(bound) == "1m"
            raise KeyError
        assert spark.conf.get(bound) == "1m"
    finally:
        spark.conf.set(bound, before)


def test_stages_keep_columns_of_any_name(spark, make_docs, prose, tmp_path):
    """Columns with names that the stages could use come out as they went in."""
    names = ["_mix_row", "_mix_file", "_mix_n", "_mix_take", "_pii_spans", "_pii_id", "_pii_key", "text_key", "all_spans", "__________"]
    rows = [(i, prose(40, i) + (" call +49 30 1234567890" if i % 3 else "") + (" scum moron" if i % 5 == 0 else ""), "en", "src1") for i in range(30)]
    docs = make_docs(rows)
    for n in names:
        docs = docs.withColumn(n, docs.doc_id.cast("string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[n] == str(r.doc_id) for r in kept for n in names)
    assert "[PHONE]" in " ".join(r.text for r in corpus_pipeline.redact_personal_data(spark, now, "").collect())
