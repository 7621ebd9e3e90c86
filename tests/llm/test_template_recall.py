"""Recall and precision of the template tree on planted templates."""

from __future__ import annotations

import random

from plumbline.llm import line_templates as L


def test_planted_templates_go_and_other_lines_stay(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    templates = [[word() for _ in range(rng.randint(5, 30))] for _ in range(40)]
    own, planted, rows = {}, {}, []
    for d in range(120):
        lines = []
        for k in rng.sample(range(len(templates)), 6):
            # digits in two fields behind the leading tokens; of a long line, the words of its last third as well
            fields = [templates[k][at] + str(rng.randint(0, 9999)) if at in (2, 3) else w for at, w in enumerate(templates[k])]
            if len(fields) >= 18:
                third = (len(fields) - 2) // 3
                fields[-third:] = [word() for _ in range(third)]
            lines.append((" ".join(fields), k))
        lines += [(" ".join(word() for _ in range(rng.randint(4, 25))), None) for _ in range(6)]
        rng.shuffle(lines)
        rows.append((d, "\n".join(x for x, _ in lines)))
        own[d] = [x for x, k in lines if k is None]
        for x, k in lines:
            if k is not None:
                planted.setdefault(k, []).append((d, x))
    kept = {r["doc_id"]: r["text"].split("\n") for r in L.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(x in kept[d] for d, xs in own.items() for x in xs), "a line of its own was dropped"
    due = [(d, x) for k, at in planted.items() for d, x in at if len({e for e, _ in at}) >= 3 and d != min(e for e, _ in at)]
    gone = sum(x not in kept[d] for d, x in due)
    assert gone >= 0.99 * len(due) and len(due) > 400
