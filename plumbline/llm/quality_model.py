"""Quality classifier from weak labels (operator 8).

Two questions make a document good: is it of quality, and is it free of abuse? To each, labellers vote good, bad or
nothing on every document: to the first five measures of the text, to the second two lexicons (words, and their stems,
that stand almost only in documents labelled toxic), to either its column of the labels table. For each question
expectation-maximisation over the counts of all vote patterns, of all documents, estimates the labellers' accuracies and
the share of good documents. The posteriors (their product) of a bounded sample of all documents, labelled or not, then
train a hashed linear scorer (follow-the-regularised-leader, so that only telling features keep a weight), and the
scorer judges every document.

The labels table is a labeller like the others, whose accuracy is estimated from a prior of TRUST that weighs as much
as all labels together: it tells which class is which, and is outvoted where the other labellers are sure.

Bounds: vote patterns are at most 3^labellers; the lexicons are subsets of the hashed features; SAMPLE documents, with
SAMPLE_BYTES of hashed features together, are fitted on at most. Word and vote counts are over all documents, and every
measure and score is of the whole text.

Defined results: null and empty texts get a score from the bias alone and are kept as the scorer says; repeated rows
get the same score; a document that any row of labels calls bad is bad; without usable labels there are no lexicons
and the measures' posteriors train alone; very long texts are read whole; an empty table gives an empty result; other
columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, small, table
from .shingle_forest import word_and_stem_hashes, word_hashes

#: Documents that are fitted on at most, and their features' bytes; features of a document are hashed to BITS bits.
SAMPLE, SAMPLE_BYTES, BITS = 20_000, 256 << 20, 18
#: Bytes of a word's stem.
STEM = 4
ALPHA, BETA, L1, L2, EPOCHS, STEPS = 1.0, 1.0, 3.0, 0.02, 6, 60_000
THRESHOLD = 0.5
#: Shares of distinct words and pairs fall as a text gets longer, so they are means over blocks of so many.
VARIETY_BLOCK, PAIR_BLOCK, RUN = 1_000, 2_000, 8
#: Mean of the prior of the labels table's accuracy, before any vote is seen.
TRUST = 0.99
#: The lexicons: an entry's documents are toxic to this share at least; so many entries in all are expected by luck, so
#: a text that holds HITS of them is voted bad, one that holds fewer gets no vote, and one that holds none is good.
LEXICON_SHARE, LEXICON_LUCK, HITS = 0.8, 10.0, 2
LABELLERS = ("labels", "case", "symbols", "word_length", "variety", "repeats")
#: The labellers of abuse.
ABUSE = ("labels", "words", "stems")

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 white space, 5 other ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[9, 10, 13, 32]] = 1, 2, 3, 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "!#$%&*<>=@\\^_`{|}~+"]] = True


def distinct_share(x: np.ndarray, block: int) -> float:
    """The share of distinct values in each run of `block` of them, averaged over the whole of x (by length)."""
    if len(x) > block:
        x = x ^ ((np.arange(len(x), dtype=np.uint64) // np.uint64(block)) * np.uint64(0x9E3779B97F4A7C15))
    return len(np.unique(x)) / max(1, len(x))


def pair_share(words: np.ndarray) -> float:
    """The share of distinct word pairs within blocks; in a text of several blocks, that of distinct RUN-word runs
    over the whole text if it is less, which tells what comes again at any distance."""
    share = distinct_share(words[1:] ^ (words[:-1] * np.uint64(3)), PAIR_BLOCK)
    if len(words) <= PAIR_BLOCK:
        return share
    runs = np.zeros(len(words) - RUN + 1, dtype=np.uint64)
    for i in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - RUN + 1 + i]
    return min(share, distinct_share(runs, len(runs)))


def measures(text: str, words: np.ndarray) -> dict[str, float]:
    """What the labellers look at; words: the hashes of the words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kind = np.bincount(_KIND[data], minlength=6) if len(data) else np.zeros(6, dtype=int)
    n, letters = max(1, len(data)), max(1, kind[1] + kind[2])
    return {
        "upper": kind[1] / letters, "odd": float(_ODD[data].sum()) / n, "space": kind[4] / n, "digit": kind[3] / n,
        "length": (n - kind[4]) / max(1, len(words)), "words": float(len(words)),
        "variety": distinct_share(words, VARIETY_BLOCK), "pairs": pair_share(words),
    }


def votes(m: dict[str, float]) -> list[int]:
    """The measures' labellers, in the order of LABELLERS[1:]: 1 good, -1 bad, 0 nothing."""
    short = m["words"] < 20
    return [
        0 if short else -1 if m["upper"] > 0.5 else 1 if m["upper"] < 0.15 else 0,
        -1 if m["odd"] > 0.04 else 1 if m["odd"] < 0.01 else 0,
        0 if short else -1 if not 2.5 <= m["length"] <= 14 else 1 if 3.5 <= m["length"] <= 11 else 0,
        0 if short else -1 if m["variety"] < 0.15 else 1 if m["variety"] > 0.35 else 0,
        0 if short else -1 if m["pairs"] < 0.5 else 1 if m["pairs"] > 0.8 else 0,
    ]


def features(text: str) -> tuple[np.ndarray, list[int]]:
    """(distinct hashed feature ids, votes): words, their stems, and each measure as one of a few steps."""
    words, stems, m = _hashed(text)
    return _ids(words, stems, m), votes(m)


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(distinct ids of words, of stems, measures)."""
    w, stems = word_and_stem_hashes(text, STEM)
    top = np.uint64(64 - BITS)
    ids = lambda h: np.unique((h >> top).astype(np.int32))
    return ids(w), ids(stems * np.uint64(0x9E3779B97F4A7C15)), measures(text, w)


def _ids(words: np.ndarray, stems: np.ndarray, m: dict[str, float]) -> np.ndarray:
    steps = [hash_step(i, int(min(24, 24 * v))) for i, v in enumerate((m["upper"], min(1.0, 8 * m["odd"]), m["space"], m["digit"], min(1.0, m["length"] / 24), m["variety"], m["pairs"], math.log2(1 + m["words"]) / 24))]
    return np.unique(np.concatenate((words, stems, np.array(steps, dtype=np.int32))))


def hash_step(measure: int, step: int) -> int:
    """Steps have ids of their own behind the words'."""
    return (1 << BITS) + measure * 32 + step


SIZE = (1 << BITS) + 8 * 32


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    accuracy: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5
    fitted_on: int = 0

    def score(self, ids: np.ndarray) -> float:
        """The probability that a document is good."""
        z = float(self.weights[ids].sum()) + self.bias
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def label_votes(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, gold, quality, abuse): -1 if any row says low quality or toxic (of the columns: that), 1 if all that is
    said is good, 0 in the columns if nothing is."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    said = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").where(F.col(id_col).isNotNull())
    return said.groupBy(id_col).agg(
        F.min(F.when(bad, -1).otherwise(1)).alias("gold"),
        F.coalesce(F.min(F.when(F.col("quality") == 0, -1).when(F.col("quality").isNotNull(), 1)), F.lit(0)).alias("quality"),
        F.coalesce(F.min(F.when(F.col("toxic") == 1, -1).when(F.col("toxic").isNotNull(), 1)), F.lit(0)).alias("abuse"),
    )


def lexicons_of(docs: DataFrame, gold: DataFrame, id_col: str = "doc_id") -> np.ndarray:
    """(words, stems) x hashed id: which vote toxic. Those whose labelled documents are toxic to LEXICON_SHARE or more,
    and too many for luck (the divergence from the share of toxic documents, times their number, against LEXICON_LUCK
    over all ids). Counted over all labelled documents; a task sends one row an id at most."""
    out = np.zeros((2, 1 << BITS), dtype=bool)
    said = dict(gold.where("abuse <> 0").groupBy("abuse").count().collect())
    if not said.get(-1) or not said.get(1):
        return out
    share, n = said[-1] / (said[-1] + said[1]), F.col("bad") + F.col("good")
    if share >= LEXICON_SHARE:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for x, g in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for which, ids in enumerate(_hashed(x.as_py() or "")[:2]):
                    seen[which, int(g > 0), ids] += 1
        which, at = np.nonzero(seen.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(seen[which, 0, at]), pa.array(seen[which, 1, at])], names=["which", "id", "bad", "good"])

    labelled = docs.join(small(gold.where("abuse <> 0").select(id_col, "abuse")), id_col).select("text", "abuse")
    counts = labelled.mapInArrow(run, "which int, id int, bad bigint, good bigint").groupBy("which", "id").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p = F.col("bad") / n
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    sure = n * (p * F.log(p / share) + rest) >= math.log((1 << BITS) / LEXICON_LUCK)
    for r in counts.where((p >= LEXICON_SHARE) & sure).select("which", "id").collect():
        out[r["which"], r["id"]] = True
    return out


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, trust: float = TRUST) -> tuple[np.ndarray, float]:
    """EM over (votes, count): P(vote | class, it votes) as array (labeller, class, vote + 1), 1 for no vote, and P(good).

    Labellers are taken as independent given the class, which those of one kind of junk are not: alone, EM would take
    the largest kind for the class. So what the labels table (the first labeller) says of its documents is the prior of
    every other labeller, as heavy as all documents; the table's own accuracy in a class has a prior of mean `trust`, as
    heavy as all labels. EM starts from the labelled documents, or from majority votes if they are of one class."""
    v = np.array([p for p, _ in patterns], dtype=int)
    n = np.array([c for _, c in patterns], dtype=float)
    is_ = np.array([v == vote for vote in (-1, 0, 1)]).astype(float)  # vote, pattern, labeller
    count = lambda w: np.einsum("vpl,p->lv", is_, w)
    good, bad = n * (v[:, 0] > 0), n * (v[:, 0] < 0)
    labels, told = float((good + bad).sum()), bool(good.any() and bad.any())
    known = np.stack([count(bad), count(good)], axis=1)  # labeller, class, vote
    known[0] = 0
    if told:
        q, share = None, float(good.sum()) / labels
    else:
        q, share = 1 / (1 + np.exp(-v.sum(axis=1).astype(float))), 0.0
    for _ in range(rounds):
        if q is None:
            prior, table_ = share, known + 0.5
        else:
            prior = float((n * q).sum() / n.sum())
            table_ = np.stack([count(n * (1 - q)), count(n * q)], axis=1) + 0.5 + (n.sum() / labels * known if told else 0.0)
        prior = min(0.999, max(0.001, prior))
        for c, wrong, right in ((1, 0, 2), (0, 2, 0)):
            said = table_[0, c, 0] + table_[0, c, 2]
            table_[0, c, right] = said * (table_[0, c, right] + trust * labels) / (said + labels)
            table_[0, c, wrong] = said - table_[0, c, right]
        table_[:, :, 1] = 0
        table_ /= table_.sum(axis=2, keepdims=True)
        table_[:, :, 1] = 1
        new = posterior(v, table_, prior)
        if q is not None and np.abs(new - q).max() < 1e-7:
            break
        q = new
    return table_, prior


def posterior(v: np.ndarray, table_: np.ndarray, prior: float) -> np.ndarray:
    odds = np.full(len(v), math.log(prior / (1 - prior)))
    for j in range(v.shape[1]):
        odds += np.log(table_[j, 1, v[:, j] + 1] + 1e-12) - np.log(table_[j, 0, v[:, j] + 1] + 1e-12)
    return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def train(rows: list[tuple[np.ndarray, float]], epochs: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer by FTRL-proximal, on (feature ids, P(good)) in the given order.

    Words and stems may only count against a document, so that a long text cannot outweigh what is bad in it.
    Small samples are gone through more often, up to STEPS documents in all."""
    epochs = epochs or max(EPOCHS, min(60, STEPS // max(1, len(rows))))
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    word = 1 << BITS

    def weight(z: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        return np.where((at < word) & (w > 0), 0.0, w)

    for _ in range(epochs):
        for ids, y in rows:
            at = np.append(ids, SIZE)
            zi, ni = z[at], n[at]
            w = weight(zi, ni, at)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
            g = p - y
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weight(z, n, np.arange(SIZE + 1))
    return w[:SIZE].astype(np.float32), float(w[SIZE])


def _hit_vote(hits: int, none: int) -> int:
    return none if not hits else -1 if hits >= HITS else 0


def vote(docs: DataFrame, gold: DataFrame, lexicons: np.ndarray, share: float, id_col: str = "doc_id") -> DataFrame:
    """(turn, votes, ids bytes): every document with the votes of LABELLERS, then of ABUSE; ids, the features, of a share
    of them by hash of id and text, in whose order (turn) they are fitted on."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    million, empty = 1_000_000, not lexicons.any()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, ids = [], []
            for x, turn in zip(b.column(2), b.column(1).to_pylist(), strict=True):
                words, stems, m = _hashed(x.as_py() or "")
                fine = 0 if m["words"] < 20 else 1
                got.append([*votes(m), *([0, 0] if empty else [_hit_vote(int(lex[at].sum()), fine) for lex, at in zip(shared.value, (words, stems), strict=True)])])
                ids.append(_ids(words, stems, m).tobytes() if turn % million < share * million else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(got, pa.list_(pa.int8())), pa.array(ids, pa.binary())], names=["id", "turn", "votes", "ids"])

    turn = F.pmod(F.xxhash64(F.lit("fit"), id_col, "text"), F.lit(1 << 62)).alias("turn")
    own = docs.select(F.col(id_col).alias("id"), turn, "text").mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, turn bigint, votes array<tinyint>, ids binary")
    k, said = len(LABELLERS), lambda c: F.array(F.coalesce(c, F.lit(0)).cast("tinyint"))
    every = F.concat(said("quality"), F.slice("votes", 1, k - 1), said("abuse"), F.slice("votes", k, len(ABUSE) - 1)).alias("votes")
    return own.join(small(gold.withColumnRenamed(id_col, "id")), "id", "left").select("turn", every, "ids")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    gold = label_votes(labels.select(F.col(labels.columns[0] if id_col not in labels.columns else id_col).alias(id_col), "quality", "toxic"), id_col)
    base, run = docs.select(id_col, "text"), Scratch(spark, "votes")
    n = base.count()
    if not n:
        return Model(np.zeros(SIZE, dtype=np.float32), 1.0)
    gold = run.keep(gold, "gold")
    voted = run.keep(vote(base, gold, lexicons_of(base, gold, id_col), 1.0 if n <= sample else 0.95 * sample / n, id_col), "votes")
    patterns = [(tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    chosen = voted.where("ids IS NOT NULL")
    size = chosen.agg(F.sum(F.length("ids"))).first()[0] or 0
    if size > most_bytes:
        chosen = chosen.where(F.pmod(F.xxhash64("turn"), F.lit(1_000_000)) < int(900_000 * most_bytes / size))
    # feature ids travel as bytes: a list of Python numbers would take ten times the driver's memory
    rows = chosen.orderBy("turn").limit(sample).collect()
    rows.sort(key=lambda r: (r["turn"], len(r["ids"])))
    k = len(LABELLERS)
    v = np.array([r["votes"] for r in rows], dtype=int).reshape(len(rows), k + len(ABUSE))
    quality, prior = estimate([(p[:k], c) for p, c in patterns])
    abuse, clean = estimate([(p[k:], c) for p, c in patterns])
    good = posterior(v[:, :k], quality, prior) * posterior(v[:, k:], abuse, clean)
    weights, bias = train([(np.frombuffer(r["ids"], dtype=np.int32), float(y)) for r, y in zip(rows, good, strict=True)])
    run.clear()
    right = accuracies(quality, prior) | {f"abuse_{name}": x for name, x in accuracies(abuse, clean, ABUSE).items()}
    return Model(weights, bias, right, prior * clean, len(rows))


def accuracies(table_: np.ndarray, prior: float, names: tuple[str, ...] = LABELLERS) -> dict[str, float]:
    """The share of each labeller's votes that are right."""
    said = lambda j, c: float(table_[j, c, 0] + table_[j, c, 2])
    return {name: float(prior * table_[j, 1, 2] + (1 - prior) * table_[j, 0, 0]) / max(1e-9, prior * said(j, 1) + (1 - prior) * said(j, 0)) for j, name in enumerate(names)}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """docs with quality_score (probability of good), in place; no shuffle. The weights' size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = b.schema.get_field_index("text")
            got = pa.array([m.score(features(x.as_py() or "")[0]) for x in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "quality_score"])

    schema = docs.drop("quality_score").schema.add("quality_score", "double")
    return docs.drop("quality_score").mapInArrow(run, schema)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "quality_score", (F.col("quality_score") >= THRESHOLD).alias("kept"))
