"""Headless check of a file: ``python -m lathework.check FILE [--rules FILE] [--min-score N] [--exceptions DIR] [--json] [--no-header]``.

Prints the score and the rules' results and writes the failing cells when asked
to.  The exit code is 1 when a rule fails beyond its allowance or the score is
under the least one, 2 when the file or the rules cannot be read.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import profile, scorecard
from .sources import readers, sinks


def rules_of(text: str) -> list[profile.Rule]:
    """Rules from JSON: a list of objects with the fields of ``Rule``; lists become tuples."""
    return [profile.Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in json.loads(text)]


def check(spark: SparkSession, path: str, rules: list[profile.Rule] | None = None, min_score: float | None = None, header: bool | None = None, exceptions: str | None = None) -> dict:
    """The result as a dict: rows, columns, score, band, reason, rules, failures."""
    order = "_row_id"
    df = spark.read.parquet(path) if path.endswith(".parquet") else readers.read_json(spark, path, path.endswith("l")) if path.endswith((".json", ".jsonl")) else readers.read_delimited(spark, path, header=header, order=order)
    if order not in df.columns:
        from pyspark.sql import functions as F

        df = df.withColumn(order, F.monotonically_increasing_id())
    columns = [c for c in df.columns if c != order]
    found = scorecard.score(df, columns).first()
    out = {"rows": df.count(), "columns": len(columns), "score": found["score"], "band": found["band"], "reason": found["reason"], "rules": [], "failures": []}
    known = [r for r in rules or [] if r.column in columns]
    out["skipped"] = [r.column for r in rules or [] if r.column not in columns]
    results = {r["rule"]: r for r in profile.check_rules(df, known).collect()} if known else {}
    for i, rule in enumerate(known):
        r = results[f"r{i}"]
        out["rules"].append({"kind": rule.kind, "column": rule.column, "failures": r["failures"], "rows": r["rows"], "passed": r["passed"]})
        if not r["passed"]:
            out["failures"].append(f"{rule.kind} {rule.column}: {r['failures']} of {r['rows']}")
    if min_score is not None and (found["score"] is None or found["score"] < min_score):
        out["failures"].append(f"score {found['score']} is under {min_score}")
    if exceptions:
        sinks.write(scorecard.exceptions(df, scorecard.find(df, columns), order), exceptions)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lathework.check")
    p.add_argument("file")
    p.add_argument("--rules")
    p.add_argument("--min-score", type=float)
    p.add_argument("--exceptions")
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-header", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        rules = rules_of(open(a.rules, encoding="utf-8").read()) if a.rules else []
        out = check(spark, a.file, rules, a.min_score, False if a.no_header else None, a.exceptions)
    except (OSError, ValueError, TypeError) as error:
        print(f"cannot check: {error}", file=sys.stderr)
        return 2
    if a.json:
        print(json.dumps(out, indent=2))
    else:
        score = "n/a" if out["score"] is None else f"{out['score']:.1f}"
        print(f"{a.file}: {out['rows']} rows, {out['columns']} columns")
        print(f"Score {score} ({out['band'] or 'n/a'})" + (f" - {out['reason']}" if out["reason"] else ""))
        for r in out["rules"]:
            print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['kind']} {r['column']} ({r['failures']} of {r['rows']})")
        for f in out["failures"]:
            print(f"Failed: {f}", file=sys.stderr)
    return 1 if out["failures"] else 0


if __name__ == "__main__":
    sys.exit(main())
