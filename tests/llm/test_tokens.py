import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from lexweave.llm import tokens  # noqa: E402

ALPHABET = "aaabe \n\r\t.,'sdmtlvre1230²½éßñœžЖд中文🙂 ​́\x1c\x1f\x85\xa0§—|<>endoftext"


@pytest.fixture(scope="module")
def both():
    ranks = tokens.read_ranks()
    return tokens.CorpusEncoder(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + [None, "", "<|endoftext|>", "a" * 5000, "ab" * 3000]
    assert both[0].encode(texts).to_pylist() == [both[1].encode_ordinary(t) if t else [] for t in texts]


def test_table(spark, both):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "  \n", None), (None, "é" * 3000, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_documents(df).collect()), key=str)
    assert got == sorted(((i, both[1].encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert tokens.encode_documents(df.limit(0)).count() == 0
