from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe


@pytest.fixture(scope="module")
def both():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Codec(f.read()), Tokenizer.from_file(bpe.default_vocabulary())


def test_random_texts_match_the_library(both):
    own, lib = both
    random.seed(5)
    parts = [*" \t\n\r\x0b\x1c\x85\xa0 　sdtrevml'019½Ⅷaé日😀́_-.,​", "<|endoftext|>", "  ", "'ll", "the", " of"]
    for _ in range(3000):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 20)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids, repr(s)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        assert own.digest(s) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_a_very_long_piece_stays_fast(both):
    own, lib = both
    s = "ab" * 60_000
    assert own.encode(s) == lib.encode(s, add_special_tokens=False).ids


def test_forgetting_changes_nothing(both, monkeypatch):
    own, _ = both
    text = "one two three four five six seven eight nine ten " * 3
    want = own.digest(text)
    own.known.clear()
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert own.digest(text) == want


def test_table(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (2, "hello world", 3), (2, "hello world", 3)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_digests(df, bpe.default_vocabulary()).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2, 2]
    assert bpe.encode_digests(df.limit(0), bpe.default_vocabulary()).count() == 0
    ids = bpe.tokenize(df, bpe.default_vocabulary()).where("doc_id = 2").first()
    assert ids["decoded"] == "hello world" and len(ids["ids"]) == 2
