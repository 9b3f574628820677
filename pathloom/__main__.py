"""python -m pathloom INPUT OUTPUT [--limit K] [--dry-run] [--report FOLDER]: judges the analyses under INPUT. Options come from
JUDGE_MODEL and so on, the provider from JUDGE_URL. Exit code 0: clean, 1: something failed or was rejected, 130: interrupted."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import calls, runner
from .operators.reports import JudgeOptions


def main(args: list[str], environ: dict[str, str]) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--report")
    given = parser.parse_args(args)
    try:
        options, rubric = JudgeOptions.from_env(environ), calls.Rubric()
        if not given.dry_run and not (options.api_key and environ.get("JUDGE_URL")):
            raise ValueError("set JUDGE_API_KEY and JUDGE_URL")
        send = calls.over_http(environ.get("JUDGE_URL", ""), {"x-api-key": options.api_key}, options.timeout)
        spark = SparkSession.builder.getOrCreate()
        counts = runner.run_batch(spark, given.input, given.output, options, rubric, send, given.limit, given.dry_run)
        for status, n in sorted(counts.items()):
            print(f"{status}: {n}")
        if given.report:
            runner.export(spark, given.input, given.output, options, rubric, given.report, given.limit)
        return calls.exit_code(counts, "not_attempted_interrupted" in counts)
    except KeyboardInterrupt:
        return calls.exit_code({}, interrupted=True)
    except (ValueError, TypeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], dict(os.environ)))
