import os

import pytest

import stihora.plans as plans
from stihora.operators import relations as R
from stihora.plans.registry import tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_all_splits_are_arranged(spark):
    rows = spark.read.parquet(f"{DATA}/poem_splits.parquet").select("split", "poem_id", "author").dropna().collect()
    got = plans.queries()["w13_no_neighbours"](spark, DATA).collect()
    assert sorted((r.split, r.poem_id, r.author) for r in got) == sorted({(r.split.strip().lower(), r.poem_id, r.author) for r in rows})


def test_all_parts_of_speech_get_candidates(spark):
    slots = R.content(tokens(spark, DATA)).filter("author is not null").count()
    assert plans.queries()["w11_least_used"](spark, DATA).count() == slots


def test_all_parts_of_speech_are_streamed(spark):
    assert plans.queries()["r5_least_used_stream"](spark, DATA).count() == R.content(tokens(spark, DATA)).count()
