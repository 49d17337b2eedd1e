import corpus_pipeline
from impactlens.llm import pii_weak, quality_crf
from impactlens.llm.common import read_table

from . import test_odd_sketch, test_packing, test_pii_weak

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    before, columns = {r.doc_id: r.asDict() for r in docs.collect()}, docs.columns
    model = quality_crf.fit(docs, read_table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r.asDict() for r in out.collect()}
        if name == "quality":
            scores = dict(zip(before, model.scores([r["text"] for r in before.values()])))
            assert rows == {i: r for i, r in before.items() if scores[i] >= quality_crf.THRESHOLD}
            assert len(rows) >= 0.6 * len(before)
        elif name == "near_dedup":
            groups = test_odd_sketch.brute([(i, r["text"]) for i, r in before.items()], 5)
            assert rows == {i: r for i, r in before.items() if groups[i][1] == i}
        elif name == "private_data":
            again = pii_weak.fit(docs)
            for i, r in before.items():
                text = pii_weak.redacted(r["text"], again)
                assert rows[i] == r | {"text": text, "n_chars": len(text)}
                assert test_pii_weak.plain(text) == []
            assert len(rows) == len(before)
        else:
            test_packing.check([(i, r["text"]) for i, r in before.items()], out.collect())
            return
        assert out.columns == columns
        before, docs = rows, out


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id for r in read_table(spark, SF, "documents").collect()}
    kept = {r.doc_id for r in got}
    assert kept <= docs and len(kept) >= 0.5 * len(docs)
    assert {"sequence_id", "offset", "length"} <= set(got[0].asDict())


def test_odd_tables(spark):
    """Nulls, repeated rows and no rows go through every stage."""
    schema = read_table(spark, SF, "documents").schema
    text = "This is a plain line of text, with words.\nAnd here comes one more of them."
    rows = [(None, text, "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1),
            (3, text, "en", "s", 1), (4, text + " a@b.co", "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
            if name == "near_dedup" and data:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3]
