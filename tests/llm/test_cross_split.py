import random

from stihora.llm.cross_split import near_duplicates_across, overlap_report, text_classes


def test_near_copies_across_splits_are_found_and_others_are_not(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("абвгдежзијклм") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = {i: [rng.choice(words) for _ in range(rng.randint(40, 90))] for i in range(60)}
    texts = {i: " ".join(w) for i, w in base.items()}
    sides = {i: (i % 2 == 0, i % 2 == 1) for i in base}
    want = set()
    for k in range(20):  # one word in six changed
        i = 100 + k
        w = list(base[k])
        for at in rng.sample(range(len(w)), len(w) // 6):
            w[at] = rng.choice(words)
        texts[i] = " ".join(w).upper().replace(" ", ",\n")
        sides[i] = (k % 2 == 1, k % 2 == 0)
        want.add((k, i))
    texts |= {200: None, 201: None, 202: "", 203: " — ", 204: "—", 300: "река", 301: "Рекa!"}
    sides |= {200: (True, False), 201: (False, True), 202: (True, False), 203: (False, True), 204: (True, False), 300: (True, False), 301: (False, True), 400: (True, True)}
    want |= {(300, 301), (400, 400)}
    records = spark.createDataFrame(list(texts.items()) + [(0, texts[0])], "id long, text string")
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in sides.items()], "id long, train boolean, held_out boolean")
    got = [(r.a, r.b) for r in near_duplicates_across(records, df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_copies_of_one_text_pair_across_the_split_only(spark):
    records = spark.createDataFrame([(i, "една иста песна за реката и гората") for i in range(30)], "id long, text string")
    sides = spark.createDataFrame([(i, i < 25, i >= 25) for i in range(30)], "id long, train boolean, held_out boolean")
    assert near_duplicates_across(records, sides).count() == 25 * 5


def test_very_many_copies_are_paired_with_the_first_of_the_other_side(spark):
    records = spark.createDataFrame([(i, "една иста песна за реката и гората") for i in range(30)], "id long, text string")
    sides = spark.createDataFrame([(i, i < 25, i >= 25) for i in range(30)], "id long, train boolean, held_out boolean")
    got = {(r.a, r.b) for r in near_duplicates_across(records, sides, copies_at_most=10).collect()}
    assert got == {(0, i) for i in range(25, 30)} | {(i, 25) for i in range(25)}
    assert {(r.cls, r.n_copies) for r in text_classes(records).collect()} == {(0, 30)}


def test_classes_have_their_links(spark):
    text = "една иста песна за реката и гората што спие под снегот"
    rows = [(1, text), (2, text.upper()), (3, text.replace("снегот", "ѕвездите")), (4, "сосема друга"), (5, None)]
    sides = spark.createDataFrame([(1, True, False), (2, False, False), (3, False, True), (4, True, False)], "id long, train boolean, held_out boolean")
    got = {tuple(r) for r in text_classes(spark.createDataFrame(rows, "id long, text string"), sides).collect()}
    assert got == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)}


def test_a_large_family_of_near_copies_is_paired_whole(spark):
    base = [f"збор{chr(1072 + i % 30)}{chr(1072 + i // 30)}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"друг{chr(1072 + i % 30)}{chr(1072 + i // 30)}", *base[i % 40 + 1 :]])) for i in range(240)]
    sides = spark.createDataFrame([(i, i % 4 > 0, i % 4 == 0) for i in range(240)], "id long, train boolean, held_out boolean")
    assert near_duplicates_across(spark.createDataFrame(rows, "id long, text string"), sides).count() == 60 * 180


def test_empty_tables_give_no_rows(spark):
    assert near_duplicates_across(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "id long, train boolean, held_out boolean")).count() == 0


def test_only_exact_copies_are_represented_by_the_first(spark):
    text = "една иста песна за реката и гората"
    records = spark.createDataFrame([(i, text.replace(" ", " " * (1 + i))) for i in range(16)], "id long, text string")
    sides = spark.createDataFrame([(i, i < 12, i >= 12) for i in range(16)], "id long, train boolean, held_out boolean")
    got = {(r.a, r.b) for r in near_duplicates_across(records, sides, copies_at_most=3).collect()}
    assert got == {(a, b) for a in range(12) for b in range(12, 16)}


def test_the_report_counts_all_copies(spark):
    text = "една иста песна за реката и гората што спие под снегот"
    near = text.replace("снегот", "ѕвездите")
    texts = [(0, near), (1, text), (2, text)] + [(i, text) for i in range(10, 1210)] + [(3000, "друго"), (3001, "сосема трето"), (3002, None)]
    splits = [(0, "train"), (1, "train"), (2, "train"), (2, "test")] + [(i, "val") for i in range(10, 1210)] + [(3000, "val"), (3001, "train"), (3002, "train"), (3002, "val"), (4000, "val")]
    texts.append((4000, text))
    texts.append((4000, near))  # two texts of one record: no partner counts twice
    records = spark.createDataFrame(texts, "id long, text string")
    sides = spark.createDataFrame(splits, "id long, split string")
    sources = spark.createDataFrame([(i, "a") for i in range(1300)], "id long, source string")
    got = {(r.split, r.source): (r.n_records, r.n_pairs) for r in overlap_report(records, sides, sources).collect()}
    assert got == {("val", "a"): (1200, 3600), ("test", "a"): (1, 3), ("val", None): (2, 4)}
