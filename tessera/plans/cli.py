"""python -m tessera.plans.cli FOLDER [--query TEXT] [--json]: analyse a source tree."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .analysis import Analysis, Options, run_analysis


def progress_line(event: dict) -> str:
    mark = {"start": "…", "end": "✓", "error": "✗"}[event["phase"]]
    took = f" {event['duration_ms']}ms" if event["duration_ms"] is not None else ""
    return f"{mark} {event['node']:<20}{took}{' ' + event['detail'] if event['detail'] else ''}"


def summary_text(a: Analysis) -> str:
    lines = [f"score {a.score['score']}", f"stack {a.stack['framework'] or '-'} / {a.stack['buildTool'] or '-'}", f"findings {len(a.report['findings'])}"]
    lines += [f"{r['score']:>4} {r['path']}" for r in a.retrieval]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("--query")
    p.add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    a = run_analysis(spark, args.folder, Options.from_environment(query=args.query, listener=None if args.json else lambda e: print(progress_line(e))))
    print(json.dumps({"report": a.report, "queryPlan": a.plan, "retrieval": a.retrieval}, ensure_ascii=False, indent=2) if args.json else summary_text(a))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
