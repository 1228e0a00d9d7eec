import zlib

import corpus_pipeline
from orbitalis.llm.storage import materialize
from orbitalis.llm.tokens import encoder, vocabulary_path
from tests.llm.test_operators import DATA, brute_classes


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        now = materialize(stage(spark, now, DATA), name)
        assert now.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        assert set(kept[name]) <= set(before)
        if name == "near_duplicates":
            assert set(kept[name]) == {c for _, _, c in brute_classes(sorted(before.items()))}
        if name != "secrets":
            assert all(before[i] == t for i, t in kept[name].items())
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    assert len(good - set(kept["quality"])) <= 0.02 * len(good)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).toPandas()
    last = kept["secrets"]
    ids = dict(zip(last, encoder(vocabulary_path()).encode(list(last.values())), strict=True))
    assert set(packed.doc_id) == set(last)
    for doc, rows in packed.groupby("doc_id"):
        raw = ids[doc] + (1).to_bytes(4, "little")
        assert rows.length.sum() == len(raw) // 4
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])


def test_run_gives_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


def test_stages_judge_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, empty texts, extra columns, files and other frames."""
    import random

    from orbitalis.llm import decontaminate, parity_join, pu_classifier
    from tests.llm.fixtures import frame, prose

    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join(a.split()[:-2] + ["other"])
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(25))
    rows = [(1, a), (1, b), (None, c), (None, near), (5, a), (5, a), (7, None), (7, None), (None, ""), (8, item + " " + prose(rng, 50)), (8, prose(rng, 50))]
    df = frame(spark, rows).repartition(3)
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        one = sorted(parity_join.one_of_each(docs).select("doc_id", "text").collect(), key=repr)
        texts = [t for _, t in one if t]
        assert len(one) == 8 and texts.count(a) == 1 and near not in texts and {b, c} <= set(texts)
        assert (1, a) in [tuple(r) for r in one] and [tuple(r) for r in one].count((7, None)) == 2
        classes = {tuple(r) for r in parity_join.similarity_classes(docs).collect()}
        assert {x[2] for x in classes if x[1] == 56 and x[0] in (None, 5)} <= {1, None}
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        clean = decontaminate.without_leaks(docs, bench)
        assert clean.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in clean.collect() if r["doc_id"] == 8) == [(8, rows[-1][1])] and clean.count() == len(rows) - 1
        assert decontaminate.without_leaks(docs, bench.where("false")).count() == len(rows)
        labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
        kept = pu_classifier.good_rows(docs, labels)
        assert kept.count() == pu_classifier.score(docs, labels).where("predicted = 1").count() and kept.columns == docs.columns
        for f in (parity_join.one_of_each, lambda d: decontaminate.without_leaks(d, bench), lambda d: pu_classifier.good_rows(d, labels)):
            assert f(docs.where("false")).count() == 0


def test_columns_of_any_name_survive_the_stages(spark, tmp_path):
    from pyspark.sql import functions as F

    names = ["_row", "_copy", "row", "copy", "key", "doc", "shard", "sequence_id", "text2", "rank", "cls", "_metadata2", "a.b"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    docs.write.parquet(str(tmp_path / "docs"))
    for now in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, DATA), name)
            assert now.columns == docs.columns
            assert [tuple(r) for r in now.select(*(f"`{n}`" for n in names)).distinct().collect()] == [tuple(range(len(names)))]
        assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() >= now.count() > 10
