"""The pipeline's stages on awkward documents and on the small table."""

import random
import re

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = " ".join(f"word{k} other{k}" for k in range(60))


def test_stages_keep_columns_and_handle_awkward_rows(spark):
    near = CLEAN.replace("word30", "changed")
    rows = [(1, CLEAN, "en", "s", 1), (2, near, "en", "s", 1), (3, CLEAN, None, None, None), (4, None, None, None, None), (5, "", "en", "s", 0), (None, CLEAN, None, None, None), (1, CLEAN, "en", "s", 1), (6, CLEAN[::-1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for (name, stage), empty in ((s, e) for s in corpus_pipeline.STAGES for e in (False, True)):
        out = stage(spark, docs.limit(0) if empty else docs, FOLDER)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if empty:
            assert out.count() == 0
    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "3", "6", "None"]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, kept, FOLDER).collect()) == [1, 6]


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and 0.5 * len(docs) < len(rows) < len(docs)
    secret = [r for r in rows if re.search("[0-9a-f]{40}", docs[r.doc_id])]
    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline._vocabulary())
    assert secret and all(not re.search("[0-9a-f]{16}", lib.decode(list(r.ids))) and "[secret]" in lib.decode(list(r.ids)) for r in secret)


def test_near_dedup_shuffles_less_than_the_texts(spark):
    """Texts that are alone in their class, in groups that share passages: before, each text was shuffled, and what stands for it several times."""
    rng = random.Random(21)
    make = lambda n: [f"word{rng.randrange(99_999)}" for _ in range(n)]
    rows = []
    for _ in range(20):
        passage = make(200)
        rows += [" ".join(passage + make(400)) for _ in range(40)]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in enumerate(rows)], SCHEMA)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before = shuffled()
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, FOLDER)
    kept.write.format("noop").mode("overwrite").save()
    spent = sum(v - before.get(k, 0) for k, v in shuffled().items())
    assert kept.count() == len(rows) and 0 < spent < 0.8 * sum(map(len, rows)), spent
