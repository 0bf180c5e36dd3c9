"""The pipeline's stages in order, each on its predecessor's rows."""

from __future__ import annotations

import random

import corpus_pipeline
from wearhouse.llm import neardup
from tests.llm.test_operators import prose


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    rng = random.Random(17)
    item = prose(rng, 14).replace("\n", " ")
    docs, labels = [], []
    for i in range(200):
        words = prose(rng, 80).split(" ")
        if i % 6 == 0:
            words.insert(rng.randrange(len(words)), "horrid")
            words.insert(rng.randrange(len(words)), "horrid")
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    copy = docs[1][1]
    docs += [(300, copy, "en", "s", 1), (301, copy.replace("\n", " \n ", 1) + " tail", "en", "s", 1), (302, prose(rng, 30) + " " + item, "en", "s", 1)]
    docs += [(303, None, None, None, None), (304, "", "", "", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    rows, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, d)
        out.write.parquet(f"{d}/stage{k}")
        out = spark.read.parquet(f"{d}/stage{k}")
        if name != "packing":
            assert out.columns == rows.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        rows = out
    clean = {i for i in range(200) if i % 6} | {303, 304}
    assert kept[0] == clean | {300, 301, 302}  # every toxic document goes
    assert 300 not in kept[1] and kept[1] >= clean | {302}  # nothing is left of a copy
    assert kept[3] == clean - ({301} - kept[2]) | (kept[2] & {301})  # the contaminated one goes
    assert kept[4] == kept[3]
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, rows.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    base = [prose(rng, 60) for _ in range(10)]
    rows = [(10 * k + j, b + " end" * j) for k, b in enumerate(base) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()}
    assert kept == {10 * k for k in range(10)}


def test_near_copies_do_not_outlive_the_dedups(spark):
    """Near copies lose most lines to line dedup; what would be left of them is
    like nothing any more, so they go on whole and near dedup takes them."""
    rng = random.Random(23)
    rows, copies = [], set()
    for k in range(20):
        base = prose(rng, 240).split("\n")
        rows.append((100 * k, "\n".join(base)))
        for j in range(1, 4):
            lines = list(base)
            for _ in range(j):  # one word of one line in twenty is another one
                i = rng.randrange(len(lines))
                words = lines[i].split(" ")
                words[rng.randrange(len(words))] = "anotherword"
                lines[i] = " ".join(words)
            rows.append((100 * k + j, "\n".join(lines)))
            copies.add(100 * k + j)
    shared = prose(rng, 24)
    rows += [(5000 + k, prose(rng, 120) + "\n" + shared) for k in range(10)]  # boilerplate makes no copy
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.dedup_lines(spark, docs, "")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(texts[i] == t for i, t in rows if i in copies and i in texts)  # whole, or gone
    assert sum(shared in texts[5000 + k] for k in range(10)) == 1
    kept = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, cut, "").collect()}
    assert kept == {100 * k for k in range(20)} | {5000 + k for k in range(10)}
