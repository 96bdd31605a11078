import math
import random

import pytest
from pyspark.sql import functions as F

from stihora.functions import numeric as N
from stihora.operators import candidates as C
from stihora.operators import evaluation as E
from stihora.operators import generation as G
from stihora.operators import graph as H
from stihora.operators import joins as J
from stihora.operators import relations as R
from stihora.operators import sampling as P
from stihora.operators import sequential as Q
from stihora.operators import stylometry as S
from stihora.operators import tfidf as I

POEM = "сонце грее над гора\nптица пее\n\nреката тече\nкон морето сина"


def value(spark, column):
    return spark.range(1).select(column.alias("y")).head().y


def test_line_stats(spark):
    row = S.line_stats(spark.createDataFrame([(1, "а", POEM), (2, "а", "")], "poem_id long, author string, text string")).orderBy("poem_id").collect()
    assert tuple(row[0])[2:] == (11, 4, 2, 4) and tuple(row[1])[2:] == (0, 0, 0, 0)


def test_poem_features(spark):
    poems = spark.createDataFrame([(1, "а", POEM), (2, "а", " ")], "poem_id long, author string, text string")
    tags = ["NOUN", "VERB", "NOUN", "NOUN", "VERB", "NOUN", "VERB", "NOUN", "ADJ"]
    tokens = spark.createDataFrame([(1, "а", 1, i, f"w{i}", t) for i, t in enumerate(tags)], "poem_id long, author string, line_no int, tok_no int, lemma string, pos string")
    one, none = S.poem_features(poems, tokens).orderBy("poem_id").collect()
    assert (one.share_noun, one.share_verb, one.share_adj, one.share_adv, one.mattr) == pytest.approx((5 / 9, 3 / 9, 1 / 9, 0, 1))
    assert (one.tokens_per_line, one.lines_per_stanza) == (2.75, 2.0)
    assert (none.share_noun, none.mattr, none.tokens_per_line, none.n_content) == (0, 0, 0, 0)
    pairs = S.pos_bigrams(tokens).filter("pos = 'NOUN' and next_pos = 'VERB'")
    assert pairs.count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_mattr_equals_its_definition(spark, seed):
    rng = random.Random(seed)
    seqs = {g: [rng.choice("абвгд") for _ in range(rng.randint(1, 30))] for g in "xyz"}
    df = spark.createDataFrame([(g, i, w) for g, s in seqs.items() for i, w in enumerate(s)], "g string, i int, lemma string")
    got = {r.g: r.mattr for r in S.mattr(df, "g", ["i"], window=7, by_range=seed == 2).collect()}
    for g, s in seqs.items():
        w = min(7, len(s))
        assert got[g] == pytest.approx(sum(len(set(s[i : i + w])) / w for i in range(len(s) - w + 1)) / (len(s) - w + 1))


def test_percentiles_and_bands(spark):
    df = spark.createDataFrame([("А", 0.1), ("В", 0.2), ("Б", 0.3), ("Ц", 0.2)], "author string, v double")
    got = {r.author: r.percentile for r in S.percentiles(df, "v", "v").collect()}
    assert got["А"] == 0 and got["Б"] == 100 and got["В"] < got["Ц"]
    assert [value(spark, S.band(F.lit(x))) for x in (0.0, 20.0, 50.0, 70.0, 100.0)] == ["low", "low", "mid", "high", "high"]
    assert S.percentiles(df.limit(1), "v", "v").head().percentile == 0


def test_tfidf(spark):
    docs = {0: "нива сокол сокол нива", 1: "нива река нива", 2: "нива облак"}
    df = spark.createDataFrame([(k, w) for k, t in docs.items() for w in t.split()], "d int, w string")
    rows = I.tfidf(df, "d", "w").collect()
    top = max((r for r in rows if r.d == 0), key=lambda r: r.weight)
    assert top.w == "сокол" and {r.w for r in rows if r.d == 1} == {"нива", "река"}
    for d in docs:
        assert sum(r.weight**2 for r in rows if r.d == d) == pytest.approx(1)
    a, b = 2 * (math.log(4 / 2) + 1), 2 * (math.log(4 / 4) + 1)
    assert top.weight == pytest.approx(a / math.hypot(a, b))


def test_splits(spark):
    sizes = {"a": 100, "b": 3, "c": 2, "d": 1, "e": 25}
    df = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "poem_id string, author string")
    n = {(r.author, r.split): r["count"] for r in P.split(df, "author", "poem_id").groupBy("author", "split").count().collect()}
    assert [n.get(("a", s)) for s in ("train", "val", "test")] == [80, 10, 10]
    assert [n.get(("b", s)) for s in ("train", "val", "test")] == [1, 1, 1]
    assert n[("c", "train")] == 2 and n[("d", "train")] == 1 and n[("e", "val")] == 2
    again = P.split(df.repartition(7), "author", "poem_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, P.split(df, "author", "poem_id").collect()))


def test_dense_ids_are_gapless_and_ordered(spark):
    ids = random.Random(4).sample(range(1000), 200)
    rows = R.dense_ids(spark.createDataFrame([(i,) for i in ids], "k int").repartition(5), ["k"]).orderBy("k").collect()
    assert [r.dense_id for r in rows] == list(range(200))


def test_latest_and_required(spark):
    df = spark.createDataFrame([(1, "а", 1), (1, "б", 2), (2, " ", 1), (None, "в", 1)], "id long, t string, at int")
    assert sorted(map(tuple, R.latest(df, ["id"], "at").collect())) == [(1, "б", 2), (2, " ", 1)]
    assert R.required(df, "t").count() == 3


def test_cooccurrence_is_by_poem(spark):
    df = spark.createDataFrame([(1, "сокол"), (1, "небо"), (1, "небо"), (2, "камен"), (2, "река")], "p int, t string")
    got = {(r.a, r.b): r.n for r in J.symmetric(J.cooccurrence(df, "p", "t")).collect()}
    assert got == {("небо", "сокол"): 1, ("сокол", "небо"): 1, ("камен", "река"): 1, ("река", "камен"): 1}


def test_scoped_corrections(spark):
    tokens = spark.createDataFrame([(42, "река тече", "Река", "река", "NOUN", "A=b"), (42, "друго", "река", "река", "NOUN", "A=b"), (43, "x", "река", "река", "NOUN", "A=b"), (43, "x", "збор", "збор", "ADV", "A=b"), (43, "x", "фин", "фин", "ADV", "A=b")], "poem_id long, line string, word string, lemma string, pos string, feats string")
    rules = spark.createDataFrame([
        (1, "река", "NOUN", "VERB", None, None, None, None), (2, "Река", "NOUN", None, "речен", "poem", 42, None), (3, "река", "NOUN", "DROP", None, "row", 42, "река тече"), (4, "збор", "ADV", "ADJ", None, "global", None, None), (5, "збор", "ADV", "NOUN", "збора", "", None, None),
    ], "rule_id long, word string, pos string, correction string, lemma_fix string, scope string, poem_id long, context string")
    out = J.scoped_lookup(tokens, rules, "word", "pos", ["correction", "lemma_fix"], context="line")
    got = sorted((r.poem_id, r.word, r.pos, r.lemma, r.feats) for r in J.apply_corrections(out).collect())
    assert got == [(42, "река", "NOUN", "речен", "A=b"), (43, "збор", "NOUN", "збора", ""), (43, "река", "VERB", "река", ""), (43, "фин", "ADV", "фин", "A=b")]


def test_required_partner(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert J.require_match(left.filter("k = 1"), right, ["k"]).count() == 1
    with pytest.raises(Exception, match="no partner for 2"):
        J.require_match(left, right, ["k"]).collect()


def test_copied_lines(spark):
    lines = lambda rows: spark.createDataFrame([("p", i, t.split()) for i, t in enumerate(rows)] or [], "id string, line_no int, words array<string>")
    src = lines(["сонце грее над темната гора", "птица пее во зелената шума"])
    novelty = lambda rows: J.copied_lines(lines(rows), src, "id").head().novelty
    assert novelty(["сонце грее над темната гора", "птица пее во зелената шума"]) == 0
    assert novelty(["сонце грее над темната ноќ", "птица пее во зелената ноќ"]) == 0
    assert novelty(["дожд паѓа цела ноќ", "ветер дува од север"]) == 1
    assert J.copied_lines(lines(["сонце гори"]), lines(["сонце грее"]), "id").head().novelty == 1
    assert J.copied_lines(lines(["сонце грее"]), lines(["сонце грее"]), "id").head().novelty == 0
    assert novelty([""]) == 0


def test_cosine_pairs_over_tiles_equal_brute_force(spark):
    rng = random.Random(3)
    vec = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(40)}
    df = spark.createDataFrame([(i, v, i % 2) for i, v in vec.items()], "k long, v array<double>, b int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    want = {(i, j) for i in vec for j in vec if i < j and i % 2 == j % 2 and cos(vec[i], vec[j]) >= 0.5}
    got = [(r.a, r.b) for r in J.cosine_pairs(df, "k", "v", "b", 0.5, rows=5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_alignment_is_greedy(spark):
    df = spark.createDataFrame([(1, ["а", "б", "а", "х"], ["б", "а", "в", "а", "б"]), (2, [], ["а"])], "k int, w array<string>, s array<string>")
    rows = {r.k: r for r in J.align_words(df, "w", "s", ["k"]).collect()}
    assert list(rows[1].places) == [1, 4, -1, -1] and rows[1].n_aligned == 2 and rows[2].n_words == 0


def test_the_best_aligned_stream_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    some = lambda n: ["абвгде"[rng.randrange(6)] for _ in range(n)]
    texts = spark.createDataFrame([(i, f"g{i % 3}", some(i % 9)) for i in range(40)] + [(99, "other", some(3)), (98, "g1", None)], "k long, g string, words array<string>")
    streams = spark.createDataFrame([(i, f"g{i % 4}", some(i % 12)) for i in range(60)] + [(97, "g1", None)], "s long, g string, stream array<string>")
    pairs = J.align_words(texts.join(streams, "g"), "words", "stream", ["k", "s"]).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r.n_aligned, r.s)):
        want.setdefault(r.k, (r.s, r.n_words, r.n_aligned))
    for tiles in ({}, {"n_texts": 3, "n_streams": 4}):
        assert {r.k: (r.s, r.n_words, r.n_aligned) for r in J.best_aligned(texts, streams, "g", "k", "s", **tiles).collect()} == want


def test_insert_absent_is_idempotent(spark):
    parts = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "b", "z")], "k int, part string, v string")
    target = spark.createDataFrame([(2, "old")], "k int, v string")
    new = J.insert_absent(target, parts, ["k"], "part")
    assert [(r.k, r.v) for r in new.collect()] == [(1, "x")]
    assert J.insert_absent(target.unionByName(new.select("k", "v")), parts, ["k"], "part").count() == 0


def test_scores(spark):
    assert value(spark, N.gaussian_score(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(math.exp(-2))
    assert value(spark, N.one_sided_score(F.lit(0.7), F.lit(0.8), F.lit(0.1))) == pytest.approx(math.exp(-0.5))
    assert value(spark, N.rescaled(F.lit(0.6), 0.2)) == pytest.approx(0.5)
    m = lambda **k: F.create_map(*(F.lit(x) for p in k.items() for x in p))
    assert value(spark, N.map_cosine(m(a=2), m(a=1))) == pytest.approx(1)
    assert value(spark, N.map_cosine(m(a=1), m(b=1))) == 0


def test_best_matches(spark):
    f1 = lambda rows: tuple(J.best_matches(spark.createDataFrame([("p", g, s, x) for g, s, x in rows], "p string, gen_no int, src_no int, sim double"), "p").head())[1:]
    assert f1([(0, 0, 1.0), (0, 1, 0.0)]) == pytest.approx((1, 0.5, 2 / 3))
    assert f1([(0, 0, 0.0)]) == (0, 0, 0)


@pytest.mark.parametrize("units,want", [([[1, 1], [2, 2], [3, 3]], 1.0), ([[1, 2], [2, 1]], -0.5), ([[3, 3], [4]], None)])
def test_alpha(spark, units, want):
    df = spark.createDataFrame([(i, float(x)) for i, u in enumerate(units) for x in u], "u int, v double")
    got = E.interval_alpha(df, "u", "v").head().alpha
    assert math.isnan(got) if want is None else got == pytest.approx(want)


def test_spread_and_leave_one_out(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.5), ("b", 0.7)], "g string, v double")
    assert tuple(E.spread(df, "g", "v").head()) == pytest.approx((0.4, 0.1, 0.2))
    bags = spark.createDataFrame([("x", 1, "NV", 2), ("x", 2, "NV", 1), ("x", 2, "AN", 1), ("y", 3, "NV", 1)], "a string, p int, i string, n long")
    got = {r.p: r.cosine for r in E.leave_one_out(bags, "a", "p", "i").collect()}
    assert got == pytest.approx({1: 1 / math.sqrt(2), 2: 1 / math.sqrt(2), 3: 0.0})


def test_identification_shares(spark):
    df = spark.createDataFrame([("A", "A", 1.0), ("A", "B", 0.0), ("B", "A", 1.0), ("B", "A", 0.0)], "t string, p string, c double").withColumn("run", F.lit("sft"))
    got = {r.t: (r.c, r.share_predicted) for r in E.identification(df, "t", "p", "run", ["c"]).collect()}
    assert got == {"A": (0.5, 0.75), "B": (0.5, 0.25)}


def test_reward(spark):
    df = spark.createDataFrame([(1.0, 1, 1, 1.0, 0.5, 0.5, 1.0), (1.0, 0, 1, 1.0, 0.5, 0.5, 1.0)], "cyrillic double, no_chat int, nonempty int, line_uniqueness double, style double, novelty double, content double")
    a, b = E.reward(df).collect()
    assert a.reward == pytest.approx(0.5 + 0.125) and b.reward == 0


def test_pagerank_sums_to_one_and_agrees_with_a_dense_solution(spark):
    import numpy as np

    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 1.0), ("b", "d", 3.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = {r.id: r["rank"] for r in H.pagerank(df, nodes, rounds=40).collect()}
    m = np.zeros((5, 5))
    for s, t, w in edges:
        i, j = "abcde".index(s), "abcde".index(t)
        m[i, j] += w
        m[j, i] += w
    p = np.where(m.sum(1, keepdims=True) > 0, m / np.maximum(m.sum(1, keepdims=True), 1e-12), 0.2)
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.03 + 0.85 * r @ p
    assert sum(got.values()) == pytest.approx(1) and [got[x] for x in "abcde"] == pytest.approx(r.tolist(), abs=1e-4)


def test_communities_of_two_cliques(spark):
    edges = [(a + x, a + y, 1.0) for a in "pq" for i, x in enumerate("1234") for y in "1234"[i + 1 :]] + [("p1", "q1", 0.1)]
    got = {r.id: r.community for r in H.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert len({got[f"p{i}"] for i in range(1, 5)}) == 1 and len({got[f"q{i}"] for i in range(1, 5)}) == 1 and got["p1"] != got["q1"]


def test_surface_forms(spark):
    own = spark.createDataFrame([("A", "жена", "NOUN", "Definite=Def|Gender=Fem|Number=Sing", "жената")], "author string, lemma string, pos string, feats string, surface string")
    pooled = spark.createDataFrame([("жена", "NOUN", "Definite=Def|Gender=Fem|Number=Sing", "жената"), ("жена", "NOUN", "Definite=Def|Gender=Neut|Number=Plur", "женине")], "lemma string, pos string, feats string, surface string")
    asked = {
        "Definite=Def|Gender=Fem|Number=Sing": ("жената", "exact"), "Definite=Def|Gender=Neut|Number=Plur": ("женине", "cross_author"), "Definite=Def|Gender=Fem|Mood=Sub|Number=Sing": ("жената", "relaxed"),
        "Degree=Cmp|Number=Dual": ("жената", "nearest_attested"), "": ("жената", "nearest_attested"),
    }
    wanted = spark.createDataFrame([("A", "жена", "NOUN", f) for f in asked] + [("A", "река", "NOUN", "")], "author string, lemma string, pos string, feats string")
    got = {(r.lemma, r.feats): (r.surface, r.tier) for r in C.surface_forms(wanted, own, pooled).collect()}
    assert got == {("жена", f): v for f, v in asked.items()} | {("река", ""): ("река", "unresolved")}


def test_gerunds(spark):
    verbs = spark.createDataFrame([("бара", 40), ("брани", 20), ("бране", 1)], "lemma string, n long")
    got = {r.word: (r.lemma, r.known) for r in C.gerund_lemmas(spark.createDataFrame([("барајќи",), ("бранејќи",), ("велејќи",)], "word string"), verbs).collect()}
    assert got == {"барајќи": ("бара", True), "бранејќи": ("брани", True), "велејќи": ("вели", False)}


def test_thresholds_are_relaxed_step_by_step(spark):
    df = spark.createDataFrame([("a", x) for x in (0.9, 0.62, 0.56, 0.1)] + [("b", 0.1)] + [("c", None)] * 3, "slot string, sem double")
    assert {r.slot: r.threshold for r in C.relaxed_threshold(df, "slot").collect()} == {"a": 0.55, "b": 0.45, "c": 0.65}


def test_quota_with_and_without_a_second_chance(spark):
    rows = [("A", 1, 1, "x"), ("A", 1, 2, "y"), ("A", 1, 3, "z"), ("A", 2, 1, "z"), ("A", 2, 2, "x"), ("A", 2, 3, "w")]
    df = spark.createDataFrame(rows, "author string, poem_id int, line_no int, norm string")
    got = lambda exact: sorted((r.poem_id, r.norm) for r in Q.quota_lines(df, "author", "poem_id", "norm", ["line_no"], exact=exact).collect())
    assert got(False) == [(1, "x"), (1, "y"), (2, "w")] and got(True) == [(1, "x"), (1, "y"), (2, "w"), (2, "z")]


def test_spans_of_repeated_words(spark):
    df = spark.createDataFrame([(1, "ветер ветер удри", ["ветер", "ветер", "удри", "нема"])], "k int, line string, words array<string>")
    assert list(Q.word_spans(df, ["k"], "line", "words").head().spans) == [0, 6, 12, -1]


def test_least_used_candidates_take_turns(spark):
    cs = [("а", 0.9), ("б", 0.9), ("в", 0.5)]
    df = spark.createDataFrame([(1, i, cs) for i in range(5)], "poem_id int, place int, candidates array<struct<lemma: string, score: double>>")
    assert [r.picked for r in Q.least_used(df, "poem_id", "place").orderBy("place").collect()] == ["а", "б", "в", "а", "б"]


def test_order_without_neighbours(spark):
    df = spark.createDataFrame([("p", i, "abc"[i % 3]) for i in range(12)], "panel string, item int, system string")
    rows = Q.order_without_neighbours(df, "panel", "item", "system").orderBy("place").collect()
    assert sorted(r.item for r in rows) == list(range(12)) and all(a.system != b.system for a, b in zip(rows, rows[1:]))


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "i int, x double")
    r = E.bootstrap_interval(df, "x", draws=200).head()
    assert r.low < r["mean"] < r.high and r.high - r.low < 1.5


def test_retries_and_errors_as_rows(spark):
    tried = []

    def flaky() -> str:
        tried.append(1)
        if len(tried) < 3:
            raise G.RetryableError("429")
        return "done"

    assert G.RetryPolicy().run(flaky, sleep=lambda s: None) == "done" and len(tried) == 3
    with pytest.raises(G.RetryableError):
        G.RetryPolicy(attempts=2).run(lambda: (_ for _ in ()).throw(G.RetryableError("500")), sleep=lambda s: None)
    df = spark.createDataFrame([(1, "а"), (2, None)], "k int, p string")
    rows = {r.k: r for r in G.complete(df, "k", "p", lambda p: p.upper()).collect()}
    assert rows[1].text == "А" and rows[2].text is None and rows[2].error.startswith("AttributeError")


def test_tiers_stop_where_there_are_enough(spark):
    slots = spark.createDataFrame([(1,), (2,)], "slot int")
    first = lambda s: s.filter("slot = 1").crossJoin(spark.range(3)).select("slot", F.col("id").alias("c"))
    second = lambda s: s.crossJoin(spark.range(2)).select("slot", (F.col("id") + 10).alias("c"))
    got = sorted(map(tuple, J.tiered(slots, [first, second], "slot", 3).collect()))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 10, 1), (2, 11, 1)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "v int")
    r = E.nearest_rank(df, "v", {"p50": 0.5, "p99": 0.99}, {"over": 90}).head()
    assert (r.n, r.largest, r.p50, r.p99, r.over) == (100, 100, 51, 100, 10)


def test_documents_with_many_terms_are_paired_by_tiles(spark):
    import itertools
    import random
    from collections import Counter

    rng = random.Random(3)
    docs = [rng.sample(range(40), n) for n in (0, 1, 5, 23, 40)]
    want = Counter(p for t in docs for p in itertools.combinations(sorted(f"t{x:02d}" for x in t), 2))
    df = spark.createDataFrame([(i, f"t{x:02d}") for i, t in enumerate(docs) for x in t] * 2 + [(1, None)], "doc long, term string")
    assert {(r.a, r.b): r.n for r in J.cooccurrence(df, "doc", "term", tile=7).collect()} == dict(want)


def test_similar_sets_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(8)
    sets = {f"g{i}": set(rng.sample(range(60), rng.randint(1, 25))) for i in range(40)}
    sets |= {f"h{i}": set(list(sets[f"g{i}"])[:-1] or [1]) for i in range(10)}
    for least in (0.15, 0.5, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        df = spark.createDataFrame([(g, x) for g, s in sets.items() for x in s] + [(None, 1), ("g1", None)], "g string, x long")
        assert {(r.a, r.b) for r in J.jaccard_pairs(df, "g", "x", least).collect()} == want


def test_a_cluster_needs_a_shared_folder():
    from stihora.storage import shared_dir

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Nothing:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Nothing

                    return Context

    with pytest.raises(ValueError):
        shared_dir(Session)
