import os
import random

import numpy as np
import pytest

from stihora.llm import language

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.read.parquet(f"{DATA}/lang_samples.parquet").collect()
    random.Random(1).shuffle(rows)
    return [(r.lang, r.text) for r in rows[:140]], [(r.lang, r.text) for r in rows[140:]]


@pytest.fixture(scope="module")
def model(parts):
    return language.fit(parts[0])


def test_held_out_accuracy(parts, model):
    found = language.languages_of([t for _, t in parts[1]], model)
    assert np.mean([rows[0][1] == lang for rows, (lang, _) in zip(found, parts[1])]) >= 0.95


#: One sentence each in languages that the model does not know.
FOREIGN = {
    "fr": "Les nuages passent lentement au-dessus de la ville endormie et personne ne regarde le ciel quand la pluie commence à tomber sur les toits rouges.",
    "pl": "Wieczorem siedzieliśmy przy oknie i patrzyliśmy na padający śnieg, który powoli przykrywał ulice naszego starego miasta oraz wszystkie drzewa w parku. Nikt nie mówił ani słowa, bo każdy myślał o czymś innym, a zegar na ścianie odmierzał powoli długie godziny.",
    "uk": "Увечері ми сиділи біля вікна і дивилися, як падає сніг, що повільно вкривав вулиці нашого старого міста та всі дерева в парку.",
    "es": "Por la noche nos sentamos junto a la ventana y miramos la nieve que caía despacio sobre las calles de nuestra vieja ciudad y los árboles del parque.",
    "it": "La sera sedevamo vicino alla finestra e guardavamo la neve che cadeva lentamente sulle strade della nostra vecchia città e sugli alberi del parco.",
    "nl": "In de avond zaten wij bij het raam en keken naar de sneeuw die langzaam op de straten van onze oude stad en op alle bomen in het park viel.",
}


def test_texts_in_unknown_languages_are_rejected_and_others_are_not(spark, parts):
    trusted = spark.read.parquet(f"{DATA}/lang_samples.parquet").select("lang", "text").unionByName(spark.read.parquet(f"{DATA}/eval_items.parquet").select("lang", "text"))
    model = language.fit_on_tables(trusted, spark.read.parquet(f"{DATA}/documents.parquet"))
    assert {k: rows[0][1] for k, rows in zip(FOREIGN, language.languages_of(list(FOREIGN.values()), model))} == dict.fromkeys(FOREIGN)
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    found = language.languages_of(docs, model)
    assert sum(bool(rows) and rows[0][1] is None for rows in found) <= len(docs) * 0.01
    # a foreign passage does not make a text mixed, nor does it hide its language
    own = " ".join(t for lang, t in parts[0] if lang == "de")[:400]
    rows = language.languages_of([own + "\n" + FOREIGN["pl"]], model)[0]
    assert [r[1] for r in rows] == ["de"]
    df = spark.createDataFrame([(1, FOREIGN["fr"], None), (2, FOREIGN["fr"], "de")], "doc_id long, text string, lang string")
    assert language.label_issues(df, model).count() == 0


def test_estimated_cosines_agree_with_exact_ones(parts, model):
    from stihora.llm.arrays import codepoints

    for _, text in parts[1][:20]:
        cp, off = codepoints([text])
        s, e, _ = language.raw_words(cp, off)
        words = model.words(cp, s, e)
        every = np.arange(len(s))
        vector = np.zeros(language.DIMENSIONS)
        for i in words.which:
            np.add.at(vector, words.grams[i], words.weights[i])
        want = (model.centroids @ vector) / np.linalg.norm(vector)
        got = model.cosines(words, every)
        assert np.allclose(got, [want[model.owner == i].max() for i in range(len(model.languages))], atol=1e-4)
        near, _ = model.nearest(words, every)
        assert np.allclose(near / np.linalg.norm(vector), got, atol=1e-4)


def test_steps_in_common_equal_a_plain_path():
    rng = np.random.default_rng(2)
    lens = rng.integers(0, 15, 12)
    off = np.concatenate([[0], np.cumsum(lens)])
    scores = rng.random((off[-1], 3))
    got = language.segments(scores, off, 0.4)
    for a, b in zip(off[:-1], off[1:]):
        if a == b:
            continue
        best, back = scores[a].copy(), []
        for t in range(a + 1, b):
            top = int(best.argmax())
            take = [i if best[i] >= best[top] - 0.4 else top for i in range(3)]
            back.append(take)
            best = np.array([best[i] if take[i] == i else best[top] - 0.4 for i in range(3)]) + scores[t]
        path = [int(best.argmax())]
        for take in reversed(back):
            path.append(take[path[-1]])
        assert got[a:b].tolist() == path[::-1]


def test_issues(spark, parts, model):
    by = {}
    for lang, text in parts[1]:
        by.setdefault(lang, text)
    rows = [(1, by["de"], None), (2, by["de"], " ?? "), (3, by["de"], "en"), (4, by["de"], "de_DE"), (5, by["de"], "German"), (6, by["de"] + "\n" + by["en"], "de"), (7, None, None), (8, " — 4/7", ""), (9, by["mk"], "mkd"), (9, by["mk"], "mkd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.issue, r.lang) for r in language.label_issues(df, model).collect() if (r.doc_id, r.issue) != (6, "wrong"))
    assert got == [(1, "missing", "de"), (2, "missing", "de"), (3, "wrong", "de"), (6, "mixed", "de"), (6, "mixed", "en")]


def test_documents_without_words_have_no_language(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 — 7"), (4, "夜の川")], "doc_id long, text string")
    assert [(r.lang, r.confidence, r.n_words) for r in language.identify(df, model).collect()] == [(None, None, 0)] * 4
    assert language.identify(df.limit(0), model).count() == 0


def test_a_wrong_label_counts_in_a_long_text_of_two_languages(spark, parts, model):
    by = {lang: " ".join(t for x, t in parts[1] if x == lang).split()[:60] for lang in ("de", "en")}
    texts = [" ".join(by["de"][:n] + by["en"][:m]) for n in range(30, 61) for m in range(30, 61)]
    found = [rows[0] for rows in language.languages_of(texts, model)]
    # most words are German, but both languages are nearly as close
    even = [t for t, r in zip(texts, found) if r[1] == "de" and r[2] < 0.6 and r[6] == "en"]
    assert even
    got = language.label_issues(spark.createDataFrame([(i, t, "en") for i, t in enumerate(even)], "doc_id long, text string, lang string"), model)
    assert {r.doc_id for r in got.filter("issue = 'wrong' and lang = 'de'").collect()} == set(range(len(even)))
