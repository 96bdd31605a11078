import random

import pytest

from stihora.llm.leakage import leaked_items


@pytest.mark.parametrize("words", [2_000_000, 0])
def test_passages_are_found_by_either_way(spark, words):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("абвгдежзијклмн") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(50) for i in range(8)}
    docs = {i: text(100) for i in range(30)}
    want = set()
    docs[0][20:20] = items[0][10:22]
    docs[1][0:0] = items[1][3:12]  # nine words are no case
    changed = [w if i % 8 else rng.choice(vocabulary) for i, w in enumerate(items[2])]
    docs[2] += changed
    docs[3] = [w for i, w in enumerate(items[3][:30]) if i % 9 != 5]
    docs[4] = items[4][:] + text(10) + items[5][:]
    want = {(0, 0), (2, 2), (3, 3), (4, 4), (4, 5)}
    rows = [(i, (" — " if i % 2 else "\n").join(w).upper(), 1) for i, w in docs.items()] + [(90, None, 1), (91, "", 1), (92, "…", 1), (0, "\n".join(docs[0]).upper(), 1)]
    got = leaked_items(
        spark.createDataFrame(rows, "doc_id long, text string, item_id long"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, "")], "item_id long, text string"),
        broadcast_words=words,
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)


@pytest.mark.parametrize("n,item,replaced,dropped", [(10, 20, 1, 0), (12, 24, 2, 0), (12, 24, 1, 1), (16, 32, 2, 0), (20, 40, 3, 0), (20, 40, 0, 2), (11, 22, 0, 1)])
def test_every_changed_stretch_at_the_limit_is_found(n, item, replaced, dropped):
    import numpy as np

    from stihora.llm.leakage import GRAM, WINDOW, fingerprints, stretches

    rng = random.Random(n + replaced)
    found = 0
    for trial in range(200):
        words = np.array([rng.getrandbits(60) for _ in range(item)], np.uint64)
        at = rng.randint(0, item - n)
        part = list(words[at : at + n])
        # the ends of a stretch are words of it
        for x in rng.sample(range(1, n - 1), replaced):
            part[x] = np.uint64(rng.getrandbits(60))
        gone = rng.sample([x for x in range(1, n - 1) if part[x] in words], dropped)
        part = [w for x, w in enumerate(part) if x not in gone]
        doc = np.array([rng.getrandbits(60) for _ in range(30)] + part + [rng.getrandbits(60) for _ in range(30)], np.uint64)
        both = np.concatenate([words, doc])
        h, start, text = fingerprints(both, np.array([0, item, len(both)]), GRAM, WINDOW)
        places = {}
        for x, s, t in zip(h.tolist(), start.tolist(), text.tolist()):
            places.setdefault(x, ([], []))[t].append(s - item * t)
        hits = [(b, a) for x, y in places.values() for a in x for b in y]
        got = stretches(words, doc, hits) if hits else None
        found += got is not None and got[0] == n - replaced - dropped and got[1] == 30
    assert found == 200


def test_shorter_or_more_changed_stretches_are_no_cases():
    import numpy as np

    from stihora.llm.leakage import stretches

    rng = random.Random(2)
    words = np.array([rng.getrandbits(60) for _ in range(24)], np.uint64)
    junk = lambda n: [rng.getrandbits(60) for _ in range(n)]
    nine = np.array(junk(5) + list(words[3:12]) + junk(5), np.uint64)
    assert stretches(words, nine, [(5, 3)]) is None
    often = np.array(junk(5) + [w if i % 4 else rng.getrandbits(60) for i, w in enumerate(words)] + junk(5), np.uint64)
    assert stretches(words, often, [(6, 1)]) is None


def test_empty_tables_give_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(docs, items).count() == 0 and leaked_items(docs, items, broadcast_words=-1).count() == 0
