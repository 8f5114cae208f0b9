import importlib.util

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="corpus_pipeline.py is not there")


def test_stages_on_documents(spark):
    import corpus_pipeline as c
    from lodestone.llm import decontaminate, pii
    from tests_llm_helpers import brute_force, check_packing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left, by_stage = docs.columns, docs, {}
    for name, stage in c.STAGES:
        left = c.materialize(spark, stage(spark, left, sf), name)
        by_stage[name] = left
        if name != c.STAGES[-1][0]:
            assert left.columns == columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = by_stage["quality_rules"]
    assert clean.join(labels.where("quality = 0"), "doc_id").count() <= 1
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    groups = brute_force(rows, 80)
    assert {r.doc_id for r in by_stage["near_dedup"].collect()} == {i for i, (_, root) in groups.items() if i == root}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    for r in by_stage["decontamination"].collect():
        assert not any(b.text in r.text for b in items)
    hits = {r.doc_id for r in decontaminate.leaks(spark, by_stage["near_dedup"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in by_stage["near_dedup"].collect()} - hits == {r.doc_id for r in by_stage["decontamination"].collect()}
    for r in by_stage["pii"].collect():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
    check_packing(by_stage["packing"].collect(), [(r.doc_id, r.text) for r in by_stage["pii"].collect()])


def test_odd_tables(spark, crowded, empty, folder):
    import corpus_pipeline as c

    items = spark.createDataFrame([(1, "nothing that any of the texts holds at all"), (2, None)], "item_id long, text string")
    sf = folder(documents=crowded, benchmark=items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in c.STAGES:
        # Each stage on the odd table itself, and on none.
        assert stage(spark, docs, sf).count() > 0
        assert stage(spark, empty, sf).count() == 0
    assert c.run(spark, sf).count() > 0


def test_cleanup(spark):
    from lodestone.llm import base

    kept = base.materialize(spark, spark.range(5).toDF("a"), "kept")
    path = base._written[-1]
    assert kept.count() == 5 and base.cleanup(spark) >= 1 and base._written == []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def test_shared_folder_has_to_be_named_on_a_cluster(spark, monkeypatch):
    import pytest

    from lodestone.llm import base

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.shared_dir(Session())


def test_tables_of_words_are_bounded_and_let_go():
    from lodestone.llm import base

    made = []
    one, other = base.Memo(lambda k: made.append(k) or len(k), 2000), base.Memo(len)
    other["x"]
    for k in range(100):
        assert one[f"word{k}"] == len(f"word{k}")
    assert len(one) <= 10 and one.held <= 2000
    assert one["y" * 1000] == 1000 and "y" * 1000 not in one
    base.claim(one)
    assert len(one) and not other
    base.Memo.known.remove(one)
    base.Memo.known.remove(other)
