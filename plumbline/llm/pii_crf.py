"""Personal data by a skip-chain conditional random field (operator 7).

Detectors with checks (base spans) find what is certain. Looser patterns add mentions that a check refused or that a
format hides: phones without a plus, long numbers that fail Luhn's test, dotted quads with a part above 255, addresses
without a dot in the domain or with a spelled-out (at). All mentions of a document are nodes of a field: neighbours in
the text are linked by a chain, and mentions with the same or similar content by skip edges, however far apart (to the
one before and to the first certain one), so that evidence for one mention reaches all its repeats. Base spans are
observed; loopy message passing, until it is still, gives the other mentions' marginals, and those that are surely an
entity become spans too.

Weights are trained by pseudo-likelihood on a bounded sample. The base spans are the labels, and some are hidden: a
hidden twin of a base span has its label but none of the format that its detector goes by. It hangs on the span by a
skip edge, as a loose repeat would, while the same without the edge is none; or it stands alone where a cue word
announces it. Loose mentions that repeat a base span have its label; all others are taken for none.

Texts are read by linear scans; only documents with a digit or an @ build a field. A map over Arrow batches:
no shuffle. A text of n mentions has at most 4 n edges.

Defined results: null text is empty and has no spans; repeated rows get the same spans; added spans never
overlap base spans or one another; very long texts are read whole (of a fitted one, MENTIONS mentions are looked at,
whole groups of repeats in order of hash); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Documents with mentions that are fitted on at most; message rounds; how sure an added span must be.
SAMPLE, ROUNDS, SURE = 4_000, 200, 0.9
#: Mentions of a fitted document that are looked at, at most; what agreement weighs before data are seen; the share of
#: base spans with a hidden twin.
MENTIONS, AGREE, HIDDEN = 200, 1.0, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms of the contract's patterns: what follows a run is never part of it, so nothing is given back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]|[0-9]")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_SPELLED = re.compile(r" ?[\[(](?:at|AT|At)[\])] ?")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?")
_CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write)\b"), "ip": re.compile(r"(?i)\b(ip|host|server|address)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|account|iban)\b"), "phone": re.compile(r"(?i)\b(phone|tel|call|fax|mobile)\b"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the local part is the whole run before an @."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            cursor = m.end()
            at = text.find("@", cursor)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's detectors, sorted; overlaps between kinds stay."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Mention:
    start: int
    end: int
    label: int  # of an observed one, else OTHER
    observed: bool
    features: list[int]
    content: str
    twin: bool = False  # made for training: it has no place in the text, so no neighbours there


def _loose(text: str) -> Iterator[tuple[int, int]]:
    """What may be an entity though no detector says so, in order of kind: numbers of seven digits or dotted quads, then
    addresses of any domain around an @ or a spelled-out one."""
    for m in _LOOSE.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 7 or _QUAD.fullmatch(m.group()):
            yield m.span()
    cursor = 0
    for m in re.finditer("@", text) if "@" in text else ():
        yield from _around(text, *m.span(), cursor)
        cursor = m.end()
    cursor = 0
    for m in _SPELLED.finditer(text) if "t)" in text or "t]" in text or "T)" in text or "T]" in text else ():
        yield from _around(text, *m.span(), cursor)
        cursor = m.end()


def _around(text: str, left: int, right: int, cursor: int) -> Iterator[tuple[int, int]]:
    start = left
    while start > cursor and text[start - 1] in _LOCAL:
        start -= 1
    if start < left and (m := _HOST.match(text, right)):
        yield start, m.end()


def content_of(raw: str) -> str:
    """What makes two mentions repeats: an address with a plain @ and small letters, or the last nine digits."""
    if "@" in raw or _SPELLED.search(raw):
        return _SPELLED.sub("@", raw).lower().strip(".")
    if raw.count(".") == 3:
        return "quad:" + raw
    return "".join(c for c in raw if "0" <= c <= "9")[-9:]


def mentions(text: str, base: list[tuple[int, int, int]] | None = None) -> list[Mention]:
    """The nodes of a document's field, in order. Base spans win over looser ones that touch them, the first of looser
    ones over others."""
    base = base_spans(text) if base is None else base
    rows = [(s, e, k, True) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    last, i = [], 0
    for s, e in sorted(_loose(text)):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not any(a < e and s < z for a, z in taken[max(0, i - 4) : i + 4]) and (not last or last[-1] <= s):
            rows.append((s, e, OTHER, False))
            last.append(e)
    out = []
    for s, e, k, sure in sorted(rows):
        raw = text[s:e]
        on = _features(text, s, e, raw, "".join(c for c in raw if "0" <= c <= "9"))
        # a loose address has no full form, so the sign alone says nothing
        out.append(Mention(s, e, k, sure, on if sure else [f for f in on if FEATURES[f] != "at"], content_of(raw)))
    return out


#: Names of the node features; the last is the bias.
FEATURES = ("at", "dots3", "separated", "plus", "paren", "n7", "n10", "n14", "n20", "luhn", "cue_email", "cue_ip", "cue_card", "cue_phone", "letter_next", "bias")
#: Of these, what detectors go by; a hidden twin lacks it.
FORMAT = frozenset(FEATURES.index(x) for x in ("at", "dots3", "separated", "plus", "paren", "luhn"))
CUES = frozenset(FEATURES.index(f"cue_{k}") for k in KINDS)


def _features(text: str, s: int, e: int, raw: str, digits: str) -> list[int]:
    n, before = len(digits), text[max(0, s - 24) : s]
    on = [
        "@" in raw, raw.count(".") == 3, " " in raw or "-" in raw, raw.startswith("+"), "(" in raw, n < 10, 10 <= n < 14, 14 <= n < 20, n >= 20,
        n >= 8 and luhn(digits), *(bool(_CUES[k].search(before)) for k in KINDS), text[s - 1 : s].isalpha() or text[e : e + 1].isalpha(), True,
    ]
    return [k for k, x in enumerate(on) if x]


def edges(nodes: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): neighbours in the text; each mention to the one before it and to the first observed one of equal
    content, or of equal last seven digits."""
    placed = [k for k, m in enumerate(nodes) if not m.twin]
    chain = list(zip(placed, placed[1:], strict=False))
    skip, seen, sure = [], {}, {}
    for k, m in enumerate(nodes):
        key = _alike(m.content)
        if key in seen:
            skip.append((seen[key], k))
        if key in sure and sure[key] != seen[key]:
            skip.append((sure[key], k))
        seen[key] = k
        if m.observed:
            sure.setdefault(key, k)
    return chain, skip


def _alike(content: str) -> str:
    return content if not content.isdigit() or len(content) < 7 else content[-7:]


def hidden_twins(nodes: list[Mention]) -> list[Mention]:
    """nodes as they are trained on: loose repeats of a base span have its label, and by hash of its content half of the
    base spans get a twin of that label without the format: one that repeats the span, beside another that doesn't and is
    none, or one that stands alone after the span's cue."""
    of: dict[str, int] = {}
    for m in nodes:
        if m.observed:
            of.setdefault(_alike(m.content), m.label)
    out: list[Mention] = []
    for m in nodes:
        out.append(m if m.observed else Mention(m.start, m.end, of.get(_alike(m.content), OTHER), False, m.features, m.content))
        h = zlib.crc32(m.content.encode("utf-8", "surrogatepass"))
        if m.observed and h % 1000 < HIDDEN * 1000:
            cued, bare = CUES & set(m.features), [f for f in m.features if f not in FORMAT]
            if not cued or h % 2:
                plain = [f for f in bare if f not in CUES]
                out.append(Mention(m.start, m.end, m.label, False, plain, m.content, True))
                out.append(Mention(m.start, m.end, OTHER, False, plain, f"alone:{m.content}", True))
            else:
                out.append(Mention(m.start, m.end, m.label, False, bare, f"alone:{m.content}", True))
    return out


def bounded(nodes: list[Mention], most: int | None = None) -> list[Mention]:
    """At most so many mentions: whole groups of repeats by order of hash, the last one cut; in order of the text."""
    most = MENTIONS if most is None else most
    if len(nodes) <= most:
        return nodes
    order = sorted(range(len(nodes)), key=lambda k: (zlib.crc32(_alike(nodes[k].content).encode("utf-8", "surrogatepass")), k))
    return [nodes[k] for k in sorted(order[:most])]


@dataclass
class Field:
    """node: feature x label; chain: label x label; skip: weight of agreement."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, m: Mention) -> np.ndarray:
        if m.observed:
            out = np.full(OTHER + 1, -30.0)
            out[m.label] = 0.0
            return out
        return self.node[m.features].sum(axis=0)

    def marginals(self, nodes: list[Mention], rounds: int = ROUNDS) -> np.ndarray:
        """By loopy sum-product in log space, all messages at once, half-damped."""
        u = np.array([self.unary(m) for m in nodes])
        chain, skip = edges(nodes)
        both = np.array(chain + skip, dtype=int).reshape(-1, 2)
        if not len(both):
            return _soft(u)
        pair = np.array([self.chain] * len(chain) + [self.skip] * len(skip))
        source, target = np.concatenate((both[:, 0], both[:, 1])), np.concatenate((both[:, 1], both[:, 0]))
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(both)) + len(both), np.arange(len(both))))
        msg = np.zeros((len(source), OTHER + 1))
        for _ in range(rounds):
            total = u.copy()
            np.add.at(total, target, msg)
            out = (total[source] - msg[back])[:, :, None] + pair
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            still = np.abs(new - msg).max() < 1e-6
            msg = 0.5 * msg + 0.5 * new
            if still:
                break
        np.add.at(u, target, msg)
        return _soft(u)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: list[list[Mention]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximises the pseudo-likelihood: each mention's label given its features and its neighbours' labels."""
    L = OTHER + 1
    field = Field(np.zeros((len(FEATURES), L)), np.zeros((L, L)), np.zeros((L, L)))
    x, y, links, base = [], [], ([], []), 0
    for nodes in docs:
        for m in nodes:
            row = np.zeros(len(FEATURES))
            row[m.features] = 1
            x.append(row)
            y.append(m.label)
        for kind, es in enumerate(edges(nodes)):
            links[kind].extend((base + a, base + b) for a, b in es)
        base += len(nodes)
    if not x:
        field.node[-1, OTHER] = 5.0
        return field
    x, y, n = np.array(x), np.array(y), len(x)
    hot = np.eye(L)[y]
    ends = [np.array(e, dtype=int).reshape(-1, 2) for e in links]
    agree = AGREE
    for _ in range(rounds):
        logit = x @ field.node
        c, s = ends
        np.add.at(logit, c[:, 1], field.chain[y[c[:, 0]]])
        np.add.at(logit, c[:, 0], field.chain[:, y[c[:, 1]]].T)
        np.add.at(logit, s[:, 1], agree * hot[s[:, 0]])
        np.add.at(logit, s[:, 0], agree * hot[s[:, 1]])
        gap = hot - _soft(logit)
        step = np.zeros((L, L))
        np.add.at(step, y[c[:, 0]], gap[c[:, 1]])
        np.add.at(step.T, y[c[:, 1]], gap[c[:, 0]])
        up = float((gap[s[:, 1]] * hot[s[:, 0]]).sum() + (gap[s[:, 0]] * hot[s[:, 1]]).sum())
        field.node += rate * (x.T @ gap / n * 4 - decay * field.node)
        field.chain += rate * (step / n - decay * field.chain)
        agree = max(0.0, agree + rate * (up / max(1, len(s)) - 0.05 * (agree - AGREE)))
    field.skip = agree * np.eye(L)
    return field


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> Field:
    """Trained on at most `sample` documents with mentions, chosen by hash; the driver holds their mentions."""
    turn = F.xxhash64(F.lit("crf"), id_col, "text")
    some = docs.select(turn.alias("turn"), "text").where(F.col("text").rlike("[0-9@]"))
    n = some.count()
    part = some if n <= sample else some.where(F.pmod("turn", F.lit(1_000_000)) < int(950_000 * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(m.label, m.observed, m.features, m.content) for m in bounded(mentions(x.as_py() or ""))] for x in b.column(1)]
            kind = pa.list_(pa.struct([("label", pa.int32()), ("observed", pa.bool_()), ("features", pa.list_(pa.int32())), ("content", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("label", "observed", "features", "content"), m, strict=True)) for m in r] for r in rows], kind)], names=["turn", "nodes"])

    rows = part.mapInArrow(run, "turn bigint, nodes array<struct<label:int,observed:boolean,features:array<int>,content:string>>").where("size(nodes) > 0").orderBy("turn").limit(sample).collect()
    return train([hidden_twins([Mention(0, 0, m["label"], m["observed"], list(m["features"]), m["content"]) for m in r["nodes"]]) for r in rows])


def spans(text: str, field: Field, sure: float = SURE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end), sorted."""
    if "@" not in text and not re.search("[0-9]", text):
        return [], []
    base = base_spans(text)
    nodes = mentions(text, base)
    if all(m.observed for m in nodes):
        return base, base
    p = field.marginals(nodes)
    more = [(m.start, int(q.argmax()), m.end) for m, q in zip(nodes, p, strict=True) if not m.observed and q.argmax() != OTHER and q.max() >= sure]
    return base, sorted(base + more)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(x.as_py() or "", shared.value) for x in b.column(1)]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(OTHER)]
            sha = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([written(every) for _, every in got], pa.string()), pa.array([len(every) - len(base) for base, every in got], pa.int64())], names=names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
