"""Command line: python -m plumbline study|query|queries|checks ..."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    study = sub.add_parser("study", help="the daily study over a panel in Parquet, or over the built-in demo panel")
    study.add_argument("--panel")
    study.add_argument("--config", help="settings as JSON; see StudyConfig")
    study.add_argument("--markdown", action="store_true")
    q = sub.add_parser("query", help="one query over a folder of tables, written as Parquet or shown")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--out")
    sub.add_parser("queries", help="the names of all queries")
    c = sub.add_parser("checks", help="findings of the data checks on a panel in Parquet")
    c.add_argument("panel")
    a = p.parse_args(args)

    from .plans import checks, daily, evaluation, minute, studies

    known = {k: f for m in (daily, evaluation, minute, checks, studies) for k, f in m.QUERIES.items()}
    if a.command == "queries":
        print("\n".join(sorted(known)))
        return 0
    from .session import build_session

    spark = build_session()
    if a.command == "query":
        if a.name not in known:
            p.error(f"no query {a.name}")
        df = known[a.name](spark, a.tables)
        df.write.parquet(a.out) if a.out else df.show(20, truncate=False)
    elif a.command == "study":
        from .plans.pipeline import StudyConfig, run_study
        from .sources.stores import demo_panel

        r = run_study(spark.read.parquet(a.panel) if a.panel else demo_panel(spark), StudyConfig.load(json.loads(a.config) if a.config else {}))
        print(r.to_markdown() if a.markdown else r.to_json())
    else:
        from .operators.quality import findings
        from .sources.stores import normalize_panel

        rows = findings(normalize_panel(spark.read.parquet(a.panel))).collect()
        print(json.dumps([r.asDict() for r in rows], default=str))
        return int(any(r["severity"] == "hard" for r in rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
