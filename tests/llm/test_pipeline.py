"""The pipeline: each stage on what the one before kept."""

import corpus_pipeline
from layerkit.llm.common import table
from tests.llm.test_shingle_links import check_kept
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.01"


def test_stages_end_to_end(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    labels = {r.doc_id: r for r in table(spark, FOLDER, "labels").collect()}
    after = {n: {r.doc_id for r in kept[n]} for n in ("toxicity", "quality", "near_duplicates")}
    assert after["toxicity"] > after["quality"] > after["near_duplicates"]
    clean = {i for i, r in labels.items() if not r.toxic}
    assert clean <= after["toxicity"]
    good = {i for i, r in labels.items() if r.quality} & after["toxicity"]
    assert len(good - after["quality"]) <= 0.02 * len(good)
    check_kept(kept["near_duplicates"], [(r.doc_id, r.text) for r in kept["quality"]])
    check_packing(kept["packing"], [(r.doc_id, r.text) for r in kept["near_duplicates"]], 2048)


def test_odd_documents_pass(spark, docs):
    from tests.llm.conftest import ODD

    for rows in (ODD, []):
        frame = docs(rows)
        for name, function in corpus_pipeline.STAGES[:-1]:
            frame = function(spark, frame, FOLDER)
            assert frame.columns == docs([]).columns
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).collect()
        assert {r.doc_id for r in packed} <= {i for i, _ in ODD}


def test_run_is_the_stages(spark):
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
