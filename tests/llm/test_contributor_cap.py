import random

import pytest

from stihora.llm.contributor_cap import at_cutoff, contributors, over_cap


def brute(rows, cap):
    out, by = set(), {}
    for c, r, q in rows:
        if c is not None:
            by.setdefault(c, []).append((q is None, -(q or 0), r))
    for own in by.values():
        out |= {r for _, _, r in sorted(own)[cap:]}
    return out


@pytest.mark.parametrize("bins,rank", [(1024, 50_000), (4, 5)])
def test_records_beyond_the_cap_equal_a_plain_ranking(spark, bins, rank):
    rng = random.Random(bins)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([None, 0.5, 0.5, 0.7, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "contributor string, record long, quality double")
    got = [r.record for r in over_cap(df, 37, bins=bins, rank_at_most=rank).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 37)


def test_only_borderline_bins_are_left_to_be_ranked(spark):
    rows = [("a", i, i / 1000) for i in range(1000)] + [("b", i, 0.5) for i in range(1000, 1010)]
    df = spark.createDataFrame([(*r, 100) for r in rows], "contributor string, record long, quality double, need long")
    out, borderline = at_cutoff(df, 50)
    out, borderline = [r.record for r in out.collect()], borderline.collect()
    assert 0 < len(borderline) <= 20 and {r.contributor for r in borderline} == {"a"}
    assert len(out) + len(borderline) - borderline[0].need == 900 and max(out) < min(r.record for r in borderline)


def test_record_ids_of_any_size_are_told_apart(spark):
    top = 2**62
    df = spark.createDataFrame([("a", top - i, None) for i in range(60)] + [("a", -top + i, None) for i in range(3)], "contributor string, record long, quality double")
    got = {r.record for r in over_cap(df, 10, bins=4, rank_at_most=2).collect()}
    assert got == {top - i for i in range(53)}


def test_ties_go_to_the_smaller_record(spark):
    df = spark.createDataFrame([("a", i, 0.5) for i in range(30)] + [("a", 50, None)], "contributor string, record long, quality double")
    assert sorted(r.record for r in over_cap(df, 28, bins=3, rank_at_most=4).collect()) == [28, 29, 50]


def test_an_empty_table_or_one_without_contributors_gives_no_rows(spark):
    schema = "contributor string, record long, quality double"
    assert over_cap(spark.createDataFrame([], schema), 1).count() == 0
    assert over_cap(spark.createDataFrame([(None, 1, 0.1), (None, 2, 0.2)], schema), 0).count() == 0


def test_spellings_of_one_name_are_one_contributor(spark):
    known = spark.createDataFrame([(1, "Дарвен Житопој", "Darven Zhitopoj")], "author_id long, author string, author_latin string")
    names = ["Дарвен Житопој", "ЖИТОПОЈ, Дарвен", "  дарвен житопој ", "Zhitopoj, Darven", "Дaрвен Жито​пој", "Друг Некој", None, " ", "—"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, author string")
    got = {r.i: r.contributor for r in contributors(df, "author", known, ["author", "author_latin"], "author_id").collect()}
    assert {got[i] for i in range(5)} == {"id:1"} and got[5].startswith("name:") and got[6] is got[7] is got[8] is None
