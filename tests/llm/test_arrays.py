import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stihora.llm.arrays import gram_hashes, longest_common, window_minima, word_hashes

short = st.lists(st.integers(0, 9), max_size=90)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            new[j + 1] = row[j] + 1 if x == y else max(row[j + 1], new[j])
        row = new
    return row[-1]


@given(short, short)
@settings(max_examples=60, deadline=None)
def test_longest_common_equals_the_plain_table(a, b):
    assert longest_common(np.array(a, np.int64), np.array(b, np.int64)) == plain_lcs(a, b)


@given(st.lists(st.lists(st.integers(0, 12), max_size=25), max_size=5), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_window_minima_equal_the_plain_definition(texts, w):
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    want = set()
    for i, t in enumerate(texts):
        for s in range(max(1, len(t) - w + 1)) if t else ():
            part = t[s : s + w]
            want.add(int(off[i]) + s + max(j for j, x in enumerate(part) if x == min(part)))
    got = window_minima(np.array([x for t in texts for x in t], np.uint64), off, w)
    assert set(got.tolist()) == want


def test_words_fold_case_marks_look_alikes_and_invisible_characters():
    words, off = word_hashes(["Ве́ќе ќе", "вe​ќе，ЌE", None, "", " — "])
    assert off.tolist() == [0, 2, 4, 4, 4, 4]
    assert words[0] == words[2] and words[1] == words[3]


def test_grams_do_not_cross_texts():
    words, off = word_hashes(["a b c", "d", "e f"])
    h, start, goff = gram_hashes(words, off, 2)
    assert goff.tolist() == [0, 2, 2, 3] and start.tolist() == [0, 1, 4] and len(set(h.tolist())) == 3


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["река", "lux", "нива"]) for _ in range(rng.randint(0, 9))) for _ in range(50)]
    one, _ = word_hashes(texts)
    each = np.concatenate([word_hashes([t])[0] for t in texts])
    assert (one == each).all()
