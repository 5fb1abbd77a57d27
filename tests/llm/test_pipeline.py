"""The pipeline's stages on small documents, stage by stage against what they should do."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tableprobe.llm import queries
from tableprobe.llm.common import prepare, saved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, epochs int, text_was_null boolean"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    prepare(spark)
    path = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(3, 8))) for _ in range(500)]
    rows, labels = [], []
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for i in range(200):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(30, 90)))
        if i % 4 == 0:
            text += " idiot moron"
        if i % 10 == 1:
            text += " " + passage
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [[300, rows[3][1], "en", "s0", 1], [300, rows[3][1], "en", "s0", 1], [301, rows[5][1] + " end", None, None, 1]]
    rows += [[None, None, None, None, None], [302, "", "en", "s1", 0], [303, "   ", None, "s2", 3]]
    spark.createDataFrame([(*r, "r", 1, True) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mix", "bpe"]
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), name)
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == kept["start"].columns and docs.where("row <> 'r' OR epochs <> 1 OR NOT text_was_null").count() == 0
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in kept.items()}
    # toxic ones go, the others stay but for a few at most, as the classifier learns from 160 rows
    clean = {i for i in ids["start"] if i is None or i >= 200 or i % 4}
    assert set(ids["toxicity"]) <= clean and len(clean - set(ids["toxicity"])) <= 5
    assert {None, 302, 303} <= set(ids["toxicity"]) and ids["toxicity"].count(300) == ids["start"].count(300)
    # copies and near copies go
    assert set(ids["toxicity"]) - set(ids["near_dedup"]) == {300, 301} & set(ids["toxicity"]) and len(ids["near_dedup"]) == len(set(ids["near_dedup"]))
    # the passage stays once, what is not repeated stays as it is
    before = {r.doc_id: r for r in kept["near_dedup"].collect()}
    after = {r.doc_id: r for r in kept["suffix_dedup"].collect()}
    assert before.keys() == after.keys()
    first = min(i for i in before if i is not None and i < 200 and i % 10 == 1)
    for i, r in after.items():
        if i is not None and i < 200 and i % 10 == 1 and i != first:
            assert len(r.text) < len(before[i].text) - 200 and before[i].text.startswith(r.text) and r.n_chars == len(r.text)
        else:
            assert (r.text, r.n_chars) == (before[i].text, before[i].n_chars)
    # the mix repeats or drops whole documents
    assert {(r.doc_id, r.text) for r in kept["mix"].collect()} <= {(r.doc_id, r.text) for r in after.values()}
    assert None not in ids["mix"] and 0 < len(ids["mix"])
    assert sorted(ids["bpe"]) == sorted(ids["mix"])
    texts = {r.doc_id: r.text for r in after.values()}
    for r in kept["bpe"].select("doc_id", "decoded_sha256", "n_tokens", F.size("ids").alias("n")).collect():
        assert r.n == r.n_tokens
        want = spark.range(1).select(F.sha2(F.lit(texts[r.doc_id]).cast("binary"), 256)).first()[0] if r.doc_id % 50 == 1 else r.decoded_sha256
        assert r.decoded_sha256 == want


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), "again")
    both = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, both.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0


def test_repeated_rows_are_all_mixed(spark, folder):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 4 + [(2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.mix(spark, docs, folder).count() == 4


def test_registered(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")]
    assert len(names) == 14 and sorted(queries.QUERIES) == sorted(n for n in names if n != "pipeline")


def test_steps_give_memory_back_when_they_end(monkeypatch):
    from tableprobe.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and calls == [1]
