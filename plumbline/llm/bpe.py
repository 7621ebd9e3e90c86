"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks (operator 10).

The leaves of the tree hold the ranks of adjacent symbol pairs; its root yields the leftmost pair of the
lowest rank. A merge changes three leaves, each in logarithmic time, until no mergeable pair remains; so a
piece of n bytes takes O(n log n), however long it is. A node has FAN children, whose minimum is one call; a
piece that one node can hold is merged in it. Pieces seen before come from a table of bounded size.
Runs as a map over Arrow batches: no shuffle, and a lost executor costs only its own splits.

Defined results: null text is empty (no ids); repeated rows are encoded each; added tokens in the text are
single ids, as the library does without add_special_tokens; very long texts are encoded whole; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from unicodedata import category

from pyspark.sql import DataFrame, SparkSession

from .shared import table

#: How many pieces a worker remembers in each of two generations; when the younger is full, it replaces the older,
#: so that pieces in use stay. Only speed depends on it.
REMEMBERED = 300_000
#: Above any leaf of the tree.
NONE = 1 << 62
#: Children of a node.
FAN = 32
#: The pre-tokenizer's pattern, a fixed value of byte-level BPE; \s is spelled out as Unicode's white space.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The same for texts of ASCII and letters, whose white space is ASCII's; \s has four control characters too many.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
CONTROLS = "\x1c\x1d\x1e\x1f"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """Symbol of a vocabulary file -> byte: printable Latin-1 stands for itself, the rest for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for the text of a vocabulary file of the `tokenizers` library (byte-level BPE)."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.bytes = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.rank, self.made = {}, []
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a], vocab[b]] = k
            self.made.append(vocab[a + b])
        self.added = {}
        for x in spec["added_tokens"]:
            if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]:
                raise ValueError(f"added token {x['content']!r}: only plain ones are supported")
            self.added[x["content"]] = x["id"]
            self.bytes[x["id"]] = x["content"].encode()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(PATTERN).findall
        self.plain = re.compile(PLAIN).findall
        self.letters: dict[str, bool] = {}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces. Where every character is ASCII (but for four controls) or a letter, the standard
        library's faster engine has the same classes."""
        letters = self.letters
        for c in set(text):
            if (fine := letters.get(c)) is None:
                fine = letters[c] = c not in CONTROLS if c < "\x80" else category(c)[0] == "L" and c.isalnum()
            if not fine:
                return self.split(text)
        return self.plain(text)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        byte_id = self.byte_id
        ids = [byte_id[b] for b in data]
        return ids if len(ids) < 2 else self._in_one_node(ids) if len(ids) <= FAN + 1 else self._in_tree(ids)

    def _in_one_node(self, ids: list[int]) -> list[int]:
        """The tree of a piece that has a root only: its leaves are the pairs, and close up at each merge."""
        rank, made = self.rank.get, self.made
        leaves = [rank(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while leaves and (r := min(leaves)) != NONE:
            i = leaves.index(r)
            x = ids[i] = made[r]
            del ids[i + 1], leaves[i]
            if i:
                leaves[i - 1] = rank((ids[i - 1], x), NONE)
            if i < len(leaves):
                leaves[i] = rank((x, ids[i + 1]), NONE)
        return ids

    def _in_tree(self, ids: list[int]) -> list[int]:
        """Leaf i holds rank * n + i of the pair that begins at i, so ties in rank go to the left; level k + 1 holds the
        minima of FAN nodes of level k each, and an update climbs only as far as a node changes."""
        rank, made, n = self.rank.get, self.made, len(ids)
        levels = [[NONE if (r := rank(p)) is None else r * n + i for i, p in enumerate(zip(ids, ids[1:], strict=False))]]
        while len(levels[-1]) > 1:
            low = levels[-1]
            levels.append([min(low[s : s + FAN]) for s in range(0, len(low), FAN)])
        root, pairs = levels[-1], list(zip(levels, levels[1:], strict=False))

        def put(i: int, v: int) -> None:
            levels[0][i] = v
            for low, high in pairs:
                i //= FAN
                v = min(low[i * FAN : (i + 1) * FAN])
                if high[i] == v:
                    return
                high[i] = v

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := root[0]) != NONE:
            r, i = divmod(top, n)
            j = after[i]
            k = after[i] = after[j]
            x = ids[i] = made[r]
            ids[j] = -1
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                r = rank((x, ids[k]))
                put(i, NONE if r is None else r * n + i)
            else:
                put(i, NONE)
            q = before[i]
            if q >= 0:
                r = rank((ids[q], x))
                put(q, NONE if r is None else r * n + q)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            out += [self.added[part]] if part in self.added else [i for p in self.pieces(part) for i in self.merge(p.encode())]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode(errors="replace")

    def _learn(self, piece: str) -> tuple[str, bytes]:
        if (got := self.older.get(piece)) is None:
            ids = self.merge(piece.encode())
            got = (",".join([str(i) for i in ids]), b"".join([self.bytes[i] for i in ids]))
        if len(self.known) >= REMEMBERED:
            self.older = dict(self.known)
            self.known.clear()
        self.known[piece] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from the ids)."""
        known, learn, added = self.known.get, self._learn, self.added
        got: list[tuple[str, bytes]] = []
        for part in self.special.split(text) if any(a in text for a in added) else [text]:
            if part in added:
                got.append((str(added[part]), part.encode()))
            else:
                got += [known(p) or learn(p) for p in self.pieces(part)]
        ids = ",".join([x[0] for x in got])
        decoded = b"".join([x[1] for x in got]).decode(errors="replace")
        return ids.count(",") + bool(got), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def codec_for(key: str, shared) -> Codec:
    """The codec of a broadcast vocabulary; a worker process builds it once."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row. vocabulary: path of the vocabulary file.

    The driver reads the file and broadcasts it: its size is that of one vocabulary, whatever the corpus."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    shared, key = spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from plumbline.llm.bpe import codec_for

        codec = codec_for(key, shared)
        for b in batches:
            got = [codec.digest(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array, decoded): the ids themselves and the text read back from them."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    shared, key = spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from plumbline.llm.bpe import codec_for

        codec = codec_for(key, shared)
        for b in batches:
            ids = [codec.encode(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_vocabulary())
