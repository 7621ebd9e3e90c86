"""Both pre-tokenizers, both merging trees, and vocabularies with other added tokens."""

from __future__ import annotations

import hashlib
import json
import random

from tokenizers import Tokenizer

from plumbline.llm import bpe


def vocabulary():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def test_plain_pattern_equals_the_full_one():
    own = bpe.Codec(vocabulary())
    random.seed(6)
    parts = [*" \t\n\r\x0b\x0c\x1c\x1f\x00\x7f", "  ", *"sdtlaZ019_'!?-.,()", "'ll", "é", "ß", "Ж", "日", "ª", "ʰ", "ǅ", "½", "Ⅷ", "٣", "\x85", "\xa0", "́", "​", "_a", "a_", "__"]
    for _ in range(20_000):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert own.pieces(s) == own.split(s), repr(s)


def test_one_node_and_tree_agree_with_the_library():
    own, lib = bpe.Codec(vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    random.seed(7)
    for n in [*range(1, 80), 200, 1100, 3000]:
        s = "".join(random.choice("abeinrstéöx") for _ in range(n))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids
        symbols = [own.byte_id[b] for b in s.encode()]
        if len(symbols) > 1:
            assert own._in_tree(list(symbols)) == own._in_one_node(list(symbols)) == ids


def test_added_tokens_of_any_form(tmp_path):
    spec = json.loads(vocabulary())
    top = max(spec["model"]["vocab"].values())
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] = [{"id": top + 1, "content": "[MASK]", **plain}, {"id": top + 2, "content": "[MASK]s", **plain}]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own, lib = bpe.Codec(path.read_text(encoding="utf-8")), Tokenizer.from_file(str(path))
    for s in ("a [MASK]", "[MASK]s and <b>", "[MASK][MASK]", "none", ""):
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids
        assert own.digest(s)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello", 5, "x")], "doc_id long, text string, n_tokens int, decoded_sha256 string")
    assert bpe.encode_digests(df, bpe.default_vocabulary()).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
