import base64
import os
import random

import pytest

from stihora.llm import tokenizer

PATH = os.path.join(tokenizer.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def test_ids_equal_those_of_the_vocabularys_own_library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    letters = "aab  '''sstrevemlldLL \n\t .,!?1²३жЖ夜\U0001f642​́　\x1c<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["а" * 5000, "<|endoftext|>"]
    ids, off, _ = tokenizer.encode_batch(texts, tokenizer.vocabulary(PATH))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [own.encode_ordinary(t) for t in texts]


def test_round_trip_and_offsets(spark):
    texts = ["Ноќе тече река — it's déjà vu \U0001f642!", "", None, "  \n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in tokenizer.encode_documents(df, offsets=True).collect()}
    assert [tokenizer.decode_ids(rows[i].ids) for i in range(4)] == [t or "" for t in texts]
    assert rows[1].ids == [] and rows[2].ids == []
    for i, t in enumerate(texts):
        assert all(0 <= o < len(t) for o in rows[i].offsets) and list(rows[i].offsets) == sorted(rows[i].offsets)


@pytest.mark.parametrize("n", [10, 11, 12])
def test_self_similar_texts_get_their_own_ids(n):
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    texts = [word, word.translate({97: "b", 98: "a"})]
    ids, off, _ = tokenizer.encode_batch(texts, tokenizer.vocabulary(PATH))
    assert [tokenizer.decode_ids(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:])] == texts


def test_the_vocabulary_is_shipped_with_the_job(spark, tmp_path):
    import shutil

    own = tmp_path / "ranks"
    shutil.copy(PATH, own)
    df = tokenizer.encode_documents(spark.createDataFrame([(1, "река и гора")], "doc_id long, text string"), vocabulary_path=str(own))
    own.unlink()
    assert tokenizer.decode_ids(df.head().ids) == "река и гора"


def test_an_empty_table_gives_no_rows(spark):
    assert tokenizer.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
