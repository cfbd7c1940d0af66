import corpus_pipeline
import pytest
from test_tokens import check_packing

from tidemark.llm import common, pii, simhash, toxicity
from tidemark.sources.storage import exists
from tidemark.llm.decontamination import op1_decontamination


def test_stages_on_documents(spark, documents, sf):
    docs, before = documents, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns, name
        after = corpus_pipeline.materialize(after, "test-stage")
        before, kept = {r.doc_id for r in docs.collect()}, {r.doc_id for r in after.collect()}
        assert kept <= before
        if name == "toxicity":
            scores = {r.doc_id: r._score for r in toxicity.with_score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert kept == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
        if name == "simhash_dedup":
            found = simhash.simhash_components(docs).collect()
            assert kept == {r.component_id for r in found}
        if name == "decontamination":
            assert before - kept == {r.doc_id for r in op1_decontamination(spark, sf).collect()} & before
        if name == "pii":
            assert kept == before
            again = pii.find_pii(after).collect()
            assert sum(r.n_email + r.n_card + r.n_phone + r.n_ip for r in again) == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.collect()], 2048)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.fixture
def tables(spark, odd, nothing, tmp_path):
    """Folders of odd and of empty tables with everything that the stages read."""
    labels = [(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (4, None, None)]
    items = [(1, "lorem ipsum dolor sit amet lorem ipsum"), (2, None), (None, "short")]
    for name, docs, rows, own in (("odd", odd, labels, items), ("none", nothing, [], [])):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame(own, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    return tmp_path


def test_stages_on_odd_and_empty_tables(spark, odd, nothing, tables):
    for name, docs in (("odd", odd), ("none", nothing)):
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tables / name))
            assert after.columns == docs.columns, stage_name
            if stage_name != "pii":
                # Values of all columns, whatever they are called, come through.
                assert after.exceptAll(docs).count() == 0, stage_name
            assert name == "odd" or after.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tables / name)).count() >= (name == "odd")


def test_run_on_odd_and_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, str(tables / "none")).count() == 0
    out = corpus_pipeline.run(spark, str(tables / "odd"))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() >= 0


def test_runs_beside_each_other_keep_their_tables(spark, tables, monkeypatch):
    """Tables of other work, and those of a second run inside the first, outlive a stage's clean-up."""
    made = []

    def first(spark, docs, sf_dir):
        inner = common.materialize(docs.limit(3), "inner")
        made.append(inner._tidemark_path)
        if len(made) == 1:
            monkeypatch.setattr(corpus_pipeline, "STAGES", [("second", first), ("third", lambda s, d, f: d)])
            made.append(corpus_pipeline.run(spark, sf_dir))
        return inner

    other = common.materialize(spark.range(5), "other")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), ("copy", lambda s, d, f: d)])
    outer = corpus_pipeline.run(spark, str(tables / "odd"))
    assert outer.count() == 3 and other.count() == 5
    assert not any(exists(spark, p) for p in made if isinstance(p, str))


def test_scratch_folders_by_thread(spark):
    import threading

    kept = {}

    def work(name):
        with common.scratch(spark, name):
            kept[name] = common.materialize(spark.range(4), "table")
            barrier.wait(60)
            barrier.wait(60)
            kept[name + "-rows"] = kept[name].count() if name == "slow" else 4
            if name == "slow":
                return

    barrier = threading.Barrier(2)
    slow = threading.Thread(target=work, args=("slow",))
    slow.start()
    work("fast")
    slow.join()
    assert kept["slow-rows"] == 4
    assert not exists(spark, kept["slow"]._tidemark_path) and not exists(spark, kept["fast"]._tidemark_path)
