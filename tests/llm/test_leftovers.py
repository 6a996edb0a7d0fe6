"""What an operator leaves in the shared folder: only what its result reads."""

import os

import pytest

import corpus_pipeline
from trajspark.llm import ball_kmeans, jaccard_join, personal_data, shared, spelling_variants, substring_dedup
from trajspark.scratch import shared_dir

SF = "/root/testdata/sf0.001"
CASES = {
    "op3": (lambda d, v: jaccard_join.jaccard_join(d), {"everyone", "known"}),
    "op9": (lambda d, v: substring_dedup.substring_dedup(d), {"seeds", "classes", "repeats"}),
    "op11": (lambda d, v: personal_data.personal_data(d), {"hits", "personal"}),
    "op12": (lambda d, v: spelling_variants.spelling_variants(d), {"variants"}),
    "op13": (lambda d, v: ball_kmeans.ball_kmeans(v), {"assigned"}),
}


@pytest.mark.parametrize("name", CASES)
def test_only_what_is_read(spark, name):
    run, kept = CASES[name]
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = run(shared.table(spark, SF, "documents"), shared.table(spark, SF, "embeddings"))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == kept
    assert found.count() > 0


def test_pipeline_keeps_the_last_stage_only(spark):
    """A stage's table goes once the next one is written."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = corpus_pipeline.run(spark, SF)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left & {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES} == {"source-mix"}
    assert found.count() > 0
