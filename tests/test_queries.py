import glob
import math
import os

import pytest

import stihora.plans as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    want = duck.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    b = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert a == b


#: Queries without SQL: their columns, those that are never null, those that tell rows apart, and columns between 0 and 1.
SHAPES = {
    "a20_bootstrap": ("mean low high", "mean low high", "", "mean low high"),
    "a25_cross_validation": (None, "", "", "accuracy macro_f1"),
    "g8_communities": ("id community", "id community", "id", ""),
    "g9_community_report": ("community n_authors n_words", "community n_authors n_words", "community", ""),
    "j18_best_aligned_source": (None, "", "", ""),
    "k1_character_classifier": ("n accuracy", "n accuracy", "", "accuracy"),
    "k3_author_judge": (None, "", "", "accuracy"),
    "k4_author_predictions": ("example_id predicted top_probability target_probability", "example_id", "example_id", "top_probability target_probability"),
    "k6_k_means": ("label vec_id cluster distance", "vec_id cluster distance", "vec_id", ""),
    "k7_embeddings": (None, "", "", ""),
    "l5_prompts": ("poem_id target prompt", "poem_id target prompt", "poem_id target", ""),
    "r5_least_used_stream": (None, "", "", ""),
    "s7_model_round_trip": ("poem_id predicted", "poem_id predicted", "poem_id", ""),
    "w9_line_quota_exact": ("author poem_id line_no norm", "author poem_id line_no norm", "poem_id line_no", ""),
    "w10_exclusive_claims": ("author poem_id line_no norm cluster", "author poem_id cluster", "author cluster", ""),
    "w11_least_used": ("poem_id place picked", "poem_id place picked", "", ""),
}


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_has_its_shape(spark, name):
    columns, filled, key, shares = SHAPES[name]
    df = plans.queries()[name](spark, DATA)
    assert columns is None or sorted(df.columns) == sorted(columns.split())
    rows = df.collect()
    assert rows
    assert all(r[c] is not None for r in rows for c in filled.split())
    assert not key or len({tuple(r[c] for c in key.split()) for r in rows}) == len(rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in shares.split() if c in df.columns and r[c] is not None)


def test_the_exact_line_quota_equals_a_plain_pass(spark):
    from stihora.plans.graph_queries import norm_lines

    seen, used, want = set(), {}, set()
    for r in sorted(norm_lines(spark, DATA).collect(), key=lambda r: (r.author, r.poem_id, r.line_no)):
        if (r.author, r.norm) not in seen and used.get((r.author, r.poem_id), 0) < 2:
            seen.add((r.author, r.norm))
            used[r.author, r.poem_id] = used.get((r.author, r.poem_id), 0) + 1
            want.add((r.poem_id, r.line_no))
    assert {(r.poem_id, r.line_no) for r in plans.queries()["w9_line_quota_exact"](spark, DATA).collect()} == want


def test_exclusive_claims_take_no_poem_twice(spark):
    rows = plans.queries()["w10_exclusive_claims"](spark, DATA).collect()
    assert len({(r.author, r.poem_id) for r in rows}) == len(rows)
