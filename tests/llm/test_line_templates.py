from __future__ import annotations

from plumbline.llm import line_templates as L

LONG = "alpha beta " + " ".join(f"w{chr(97 + i)}" for i in range(24))


def run(spark, data, **more):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in L.dedup_lines(spark, df, **more).collect()}


def test_recurring_lines_go_from_all_but_the_first(spark):
    got = run(spark, [(1, f"own a\n{LONG}\nx"), (2, f"{LONG}\nown b"), (3, "own c")])
    assert got == {1: f"own a\n{LONG}\nx", 2: "own b", 3: "own c"}
    assert run(spark, [(1, f"own a\n{LONG}\nx"), (2, f"{LONG}\nown b")], keep_first=False) == {1: "own a\nx", 2: "own b"}


def test_digits_are_fields_and_short_lines_need_three_documents(spark):
    lines = [f"page {i} of {i + 7} pages" for i in range(3)]
    assert run(spark, [(i, f"{x}\nrest") for i, x in enumerate(lines)]) == {0: f"{lines[0]}\nrest", 1: "rest", 2: "rest"}
    assert run(spark, [(i, f"{x}\nrest") for i, x in enumerate(lines[:2])]) == {0: f"{lines[0]}\nrest", 1: f"{lines[1]}\nrest"}
    assert run(spark, [(i, "too short\nrest") for i in range(5)])[4] == "too short\nrest"


def test_one_third_may_vary_but_not_the_leading_tokens(spark):
    words = LONG.split(" ")
    other = " ".join([*words[:-3], "new", "tail", "here"])
    lead = " ".join(["gamma", *words[1:]])
    assert run(spark, [(1, LONG), (2, other), (3, lead)]) == {1: LONG, 2: "", 3: lead}


def test_nulls_repeats_blank_and_long(spark):
    big = "\n".join(f"row {i} has its own words {i * 7}" for i in range(3000))
    got = run(spark, [(1, None), (2, ""), (3, "\n\n"), (4, f"{LONG}\n{LONG}"), (5, big)])
    assert got == {1: None, 2: "", 3: "\n\n", 4: f"{LONG}\n{LONG}", 5: big}
    assert run(spark, [(None, LONG), (None, LONG)]) == {None: LONG}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, LONG, "a", 9, 8), (2, LONG, "b", 9, 8)], "doc_id long, text string, paths string, gone int, k1 int")
    rows = L.dedup_lines(spark, df).collect()
    assert {(r["doc_id"], r["n_dropped"], r["paths"], r["k1"]) for r in rows} == {(1, 0, "a", 8), (2, 1, "b", 8)}
    assert L.dedup_lines(spark, df.limit(0)).count() == 0
