"""What the field adds: repeats of certain spans in looser forms, and nothing on texts without any."""

from __future__ import annotations

import random

import pytest

from plumbline.llm import pii_crf as P


@pytest.fixture(scope="module")
def field(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def added(text, field):
    base, every = P.spans(text, field)
    assert set(base) <= set(every)
    more = sorted(set(every) - set(base))
    for (a, _, b), (c, _, _) in zip(sorted(every), sorted(every)[1:], strict=False):
        assert b <= c or (a, _, b) in base, "added spans overlap nothing"
    return [(P.KINDS[k], text[s:e]) for s, k, e in more]


def test_loose_repeats_are_found_however_far(field):
    pad = " filler" * 3000
    assert added(f"call +1 (555) 0199-4477 today.{pad} again: 1 555 0199 4477,{pad} or 555-0199-4477", field) == [("phone", "1 555 0199 4477"), ("phone", "555-0199-4477")]
    assert added(f"write a.b@mail.example.com,{pad} or a.b(at)mail.example.com", field) == [("email", "a.b(at)mail.example.com")]


def test_every_one_of_many_repeats(field):
    text = "+1 (555) 123-4567 " + " ".join(f"word{chr(97 + i % 26)} 1 555 123 4567" for i in range(120))
    assert added(text, field) == [("phone", "1 555 123 4567")] * 120


def test_nothing_is_added_without_a_certain_mention(field):
    rng = random.Random(4)
    for text in ("the number 5551234567 of parts", "5@10 and x@localhost", "v 10.0.0.700 or 300.1.1.1", "4000111122223333", "ids 1234567, 7654321 and 9999999 1234567", "a(at)b", "mail @ noon"):
        assert added(text, field) == [], text
    for _ in range(300):
        assert added(" ".join(rng.choice(["part", "no", "lot"]) + " " + "".join(rng.choices("0123456789", k=rng.randint(7, 13))) for _ in range(6)), field) == []


def test_other_numbers_beside_a_certain_one_stay(field):
    assert added("call +1 (555) 0199-4477 or order 20260117 in lot 77123984", field) == []


def test_table_counts_what_is_added(spark, field):
    rows = [(1, "+1 (555) 0199-4477 then 1 555 0199 4477"), (2, "1 555 0199 4477"), (3, None)]
    got = {r["doc_id"]: (r["n_phone"], r["n_added"], r["spans"]) for r in P.find(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert got == {1: (1, 1, "phone:0:18,phone:24:39"), 2: (0, 0, ""), 3: (0, 0, "")}


def test_messages_cross_a_star_and_reach_rest():
    nodes = [P.Mention(0, 1, 3, True, [15], "501994477")] + [P.Mention(i, i + 1, P.OTHER, False, [15], "501994477") for i in range(1, 40)]
    chain, skip = P.edges(nodes)
    assert len(chain) == 39 and len(skip) == 39 + 38 and all((0, k) in skip for k in range(1, 40))


def test_bounds_keep_whole_groups_and_linear_time():
    text = " ".join(f"n {1000000 + i % 50}" for i in range(5000))
    nodes = P.mentions(text)
    some = P.bounded(nodes, 250)
    assert len(some) == 250 and [m.start for m in some] == sorted(m.start for m in some)
    assert len({m.content for m in some}) == 3 and len(nodes) == 5000
    for t in ("a" * 200_000 + "@", "@" * 100_000, "a(at)" * 40_000, "1.1.1.1." * 30_000, "(at)" * 50_000, "a@" * 100_000):
        P.mentions(t)


def test_fit_does_not_depend_on_ids(spark):
    rows = [(None, f"mail u{i}@host.example.com or +1 (555) 010-{1000 + i} no 99887{i:04d}") for i in range(60)]
    f = P.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=20)
    assert f.skip[0, 0] > 0
