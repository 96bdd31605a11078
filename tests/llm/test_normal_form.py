from stihora.llm.normal_form import consistent_form, repair_characters, repairs

CASES = {
    1: ("ќе доаѓа", "ќе доаѓа"),
    2: ("река тече，", "река тече,"),
    3: ("сл​уша", "слуша"),
    4: ("ce плачe", "се плаче"),
    5: ("rеquiem", "requiem"),
    6: ("Ａве", "Аве"),
    7: ("сè", "сѐ"),
}
FINE = ["XIV-ти век", "пра́зна", "„déjà vu“ — …", "№ 4/7", "  река ", "jazz λόγος", "", None]


def test_each_kind_of_difference_is_repaired_and_nothing_else(spark):
    rows = [(k, a) for k, (a, _) in CASES.items()] + [(100 + i, x) for i, x in enumerate(FINE)]
    got = {r.id: r for r in consistent_form(spark.createDataFrame(rows, "id long, text string"), ["id"]).collect()}
    assert {k: got[k].form for k in CASES} == {k: b for k, (_, b) in CASES.items()}
    assert all(got[k].changed for k in CASES)
    assert not any(got[100 + i].changed for i in range(len(FINE)))
    assert [got[100 + i].form for i in range(len(FINE))] == FINE


def test_the_form_is_stable():
    for a, b in CASES.values():
        assert repair_characters(b) == b and not any(repairs(t) for t in b.split())


def test_unknown_results_stay_where_only_known_ones_are_wanted(spark):
    df = spark.createDataFrame([(1, "нива нивa Бевcив")], "id long, text string")
    row = consistent_form(df, ["id"], known_only=True).head()
    assert row.form == "нива нива Бевcив" and row.unknown == 1
    row = consistent_form(df, ["id"]).head()
    assert row.form == "нива нива Бевсив" and row.unknown == 1


def test_emoji_keep_their_joiner_and_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "\U0001f469‍\U0001f467 река", "x")] * 2, "id long, text string, form string")
    rows = consistent_form(df, ["id"]).collect()
    assert len(rows) == 2 and not rows[0].changed


def test_an_empty_table_gives_no_rows(spark):
    assert consistent_form(spark.createDataFrame([], "id long, text string"), ["id"]).count() == 0
