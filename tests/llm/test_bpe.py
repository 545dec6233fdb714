"""Encoding against plain merging, against the public library, and through edits."""

import base64
import random

import pytest
from quirelight.llm import bpe

from quirelight.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [
    "", " ", "   ", "a", "foo\n bar", " \n x", "a  b   c  ", " lead", "trail ", "\n\n x \n\n  y", "<|endoftext|> is plain", "é à ü ß", "👍🏽 ok 👍" * 3, "a" * 5000, "word\t \tnext",
    "I'll don't WE'RE", "12345 67,89 %$#", "日本語 のテキスト", "\x00\x01 ​   x", "x" * 70 + " " + "y" * 70, "line one\nline two\r\nthree\n\n\nfour", "mañana\nÄpfel\n",
]


@pytest.fixture(scope="module")
def ranks():
    try:
        return bpe.parse_ranks(open(FILE, "rb").read())
    except OSError:
        pytest.skip("no vocabulary here")


@pytest.fixture(scope="module")
def memo(ranks):
    return bpe._Memo(bpe.PrefixBpe(ranks))


def test_against_library(ranks, memo):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    alphabet = ["a", "b", "e", " ", " ", "\n", ".", "the", "ing", "é", "1", "'s", "\t", "Z", "中"]
    for text in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]:
        assert bpe.encode_text(text, memo) == library.encode_ordinary(text), repr(text)
    assert bpe.encode_text(None, memo) == []


def test_against_merging(memo):
    rng = random.Random(1)
    for _ in range(200):
        data = "".join(rng.choice("abcdethinors") for _ in range(rng.randrange(1, 14))).encode()
        assert memo.bpe.piece(data) == memo.bpe.merge(data)


def test_append_and_edit(memo):
    one, two = b"interferometer", b"interferometry and more"
    table = memo.bpe.last_tokens(one)
    assert memo.bpe.extend(one + b"s", list(table)) == memo.bpe.last_tokens(one + b"s")
    kept, ids = memo.bpe.reencode(one, list(table), two)
    assert kept == memo.bpe.last_tokens(two) and ids == memo.bpe.merge(two)


def test_full_memo(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    small = bpe._Memo(bpe.PrefixBpe(ranks))
    assert bpe.encode_text("a b c d e f g a b c", small) == bpe.encode_text("a b c d e f g a b c", bpe._Memo(bpe.PrefixBpe(ranks)))


def test_corpus(spark, ranks):
    docs = spark.createDataFrame([(1, "The cat"), (2, None), (3, ""), (1, "The cat"), (4, "x" * 200_000)], "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as ids")
    rows = bpe.encode_corpus(docs, FILE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(list(r.ids))
    assert len(rows) == 5 and by[2] == [[]] and by[3] == [[]] and by[1][0] == by[1][1] and len(by[1]) == 2
    inverse = {n: t for t, n in ranks.items()}
    assert b"".join(inverse[i] for i in by[1][0]) == b"The cat"
    assert b"".join(inverse[i] for i in by[4][0]) == b"x" * 200_000
    assert bpe.encode_corpus(docs.limit(0), FILE).count() == 0
    assert base64.b64decode("YQ==") in ranks
