import corpus_pipeline
import pytest

from tests.llm.conftest import ODD
from tests.llm.test_dedup import brute, cleaned


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output on the small tables, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"file://{at}/{name}")
        out[name] = docs, spark.read.parquet(f"file://{at}/{name}")
        docs = out[name][1]
    return out


def test_stages_return_documents(stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert after.count() <= before.count()


def test_filters_keep_clean_documents(stages, spark, sf):
    before, after = stages["language_id"]
    assert before.exceptAll(after).count() == 0
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = before.join(labels.where("toxic = 0"), "doc_id").count()
    assert after.join(labels.where("toxic = 0"), "doc_id").count() >= 0.95 * clean


def test_lines_and_near_duplicates_equal_brute_force(stages):
    before, after = stages["line_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert sorted((r.doc_id, r.text) for r in after.collect()) == cleaned(rows, 4, 50)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = stages["near_dedup"]
    roots = brute([(r.doc_id, r.text) for r in before.collect()], 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, r in roots.items() if r[2])


def test_everything_is_packed(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}


def test_odd_and_empty_tables(spark, sf, odd, none):
    from pyspark.sql import functions as F

    odd, none = (d.withColumns({"n_lines": F.lit("mine"), "N_deleted": F.lit("yours"), "posterior": F.lit("his"), "score": F.lit(None).cast("int")}) for d in (odd, none))
    untouched = [c for c in odd.columns if c not in ("text", "n_chars")]
    for docs in (odd, none):
        before, rows = docs, docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns
        assert docs.select(*untouched).exceptAll(before.select(*untouched)).count() == 0 and docs.count() <= rows
        kept = [r.doc_id for r in docs.collect()]
        assert kept.count(1) == kept.count(2) == min(rows, 1)  # copies, the later one without its line by now, and that row repeated whole
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_run_is_the_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"][1].count()


def test_sweeping_leaves_nothing(spark):
    import os

    from askgrid.llm import workspace

    kept = workspace.written(spark.range(3), "kept")
    assert kept.count() == 3 and os.path.isdir(workspace.own_dir(spark).removeprefix("file://"))
    workspace.sweep(spark)
    assert not os.path.exists(workspace.own_dir(spark).removeprefix("file://"))
