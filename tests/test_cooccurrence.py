import itertools
import random
from collections import Counter

import pytest

import stihora.plans as plans
from stihora.operators import joins as J
from stihora.operators import relations as R

WORDS = ["Река", "реката", "реките", "течеше", "пееја", "небото", "убаво", "игра", "и", "да", "Σοφός", "song", "𐐀𐐀𐐀𐐀", "гледаше", "куќа", "тоте", "камен", "песна"]


@pytest.fixture
def songs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " А ", "x", rng.choice(["\n", "\r\n", "\r", " "]).join(f" {rng.choice(WORDS)}, {rng.choice(WORDS)}! " for _ in range(rng.randint(1, 8))), 1) for i in range(40)]
    rows += [(1, "А", "x", "Камен песна", 2), (50, " ", "x", "Камен песна", 1), (51, "А", "x", " \n", 1), (52, "А", "x", None, 1), (None, "А", "x", "камен песна", 1)]
    spark.createDataFrame(rows, "poem_id long, author string, song_title string, song_text string, ingested_at long").write.parquet(f"{tmp_path}/stripped_songs.parquet")
    return str(tmp_path)


def brute_force(spark, d):
    """Pairs by the token table, as in the SQL."""
    from stihora.plans.registry import tokens

    found: dict = {}
    for r in R.content(tokens(spark, d)).collect():
        found.setdefault(r.poem_id, set()).add(f"{r.lemma}|{r.pos}")
    return dict(Counter(p for terms in found.values() for p in itertools.combinations(sorted(terms, key=str.encode), 2)))


def test_pairs_need_no_row_for_each_token(spark, songs, monkeypatch):
    import stihora.storage as storage

    rows, kept = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df: (out := kept(df), rows.append(out.count()))[0])
    got = {(r.a, r.b): r.n for r in plans.queries()["j7_cooccurrence"](spark, songs).collect()}
    assert got == brute_force(spark, songs) and len(got) > 50
    assert rows and max(rows) <= 42  # one for each poem, not for each of its terms


def test_terms_equal_those_of_the_expressions(spark):
    rng = random.Random(7)
    words = [w.lower() for w in WORDS] + ["".join(rng.choices("абвгдеѓќуишкнтомр", k=rng.randint(1, 9))) for _ in range(2000)]
    words += [f"{start}{end}" for start in ("", "а", "аб", "абвг") for ends in (R.VERB_END, R.ADJ_END, R.ADV_END, R.ARTICLE, R.PLURAL) for end in ends.strip("()$").split("|")]
    for r in R.rule_tagged(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        assert R.rule_term(r.word) == (f"{r.lemma}|{r.pos}" if r.pos in R.CONTENT_POS else None)


def test_rare_terms_and_small_pieces_are_counted_alike(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    docs = [sorted({f"t{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(0, 30))}) for _ in range(300)]
    want = Counter(p for t in docs for p in itertools.combinations(t, 2))
    kind = pa.list_(pa.string())
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[k : k + 50], kind), pa.nulls(50, kind)], names=["x", "y"]) for k in range(0, 300, 50)]
    for head, terms, pairs, rows in ((1024, 10**6, 10**6, 10**5), (7, 400, 90, 13), (1, 1, 1, 1)):
        for name, v in (("HEAD", head), ("TERMS_AT_A_TIME", terms), ("PAIRS_AT_A_TIME", pairs), ("ROWS_AT_A_TIME", rows)):
            monkeypatch.setattr(J, name, v)
        got = Counter()
        for batch in J._counted_pairs(batches):
            for r in batch.to_pylist():
                got[r["a"], r["b"]] += r["n"]
        assert got == want
    assert list(J._counted_pairs([])) == []


def test_pairs_are_made_once_for_both_orders(spark, songs):
    both = plans.queries()["j8_symmetric"](spark, songs)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = brute_force(spark, songs)
    got = [((r.a, r.b), r.n) for r in both.collect()]
    assert len(got) == 2 * len(want) and dict(got) == want | {(b, a): n for (a, b), n in want.items()}
