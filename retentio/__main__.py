"""Command line: ``python -m retentio <command> ...`` (no server).

  analyze     [--input CSV] [--model DIR]          one-row analysis as JSON (demo rows without --input)
  report      --input CSV --out DIR [--model DIR]   full report folder
  risk-export --input CSV --out DIR [--level high|medium|low] [--model DIR]
  stats       --input CSV --out DIR                 write a statistics version for streams
  score       --records DIR --stats DIR --out DIR [--rejected DIR] [--model DIR]
  train       --input CSV --model-out DIR [--label Churn]
  benchmarks                                        benchmark profile and directions
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="retentio")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("--input")
    a.add_argument("--model")
    r = sub.add_parser("report")
    r.add_argument("--input", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--model")
    x = sub.add_parser("risk-export")
    x.add_argument("--input", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--level", default="high")
    x.add_argument("--model")
    s = sub.add_parser("stats")
    s.add_argument("--input", required=True)
    s.add_argument("--out", required=True)
    sc = sub.add_parser("score")
    sc.add_argument("--records", required=True)
    sc.add_argument("--stats", required=True)
    sc.add_argument("--out", required=True)
    sc.add_argument("--rejected")
    sc.add_argument("--model")
    t = sub.add_parser("train")
    t.add_argument("--input", required=True)
    t.add_argument("--model-out", required=True)
    t.add_argument("--label", default="Churn")
    sub.add_parser("benchmarks")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from retentio.plans import lifecycle as L
    from retentio.session import builder, ensure_checkpoint_dir
    owned = SparkSession.getActiveSession() is None
    spark = builder(app="retentio-cli").getOrCreate()
    ensure_checkpoint_dir(spark)
    try:
        if args.cmd == "analyze":
            res, _ = L.analyze_batch(spark, args.input, L.load_model(args.model))
            print(res.toJSON().first())
        elif args.cmd == "report":
            print(L.full_report(spark, args.input, args.out, L.load_model(args.model)))
        elif args.cmd == "risk-export":
            print(L.risk_export(spark, args.input, args.out, args.level, L.load_model(args.model)))
        elif args.cmd == "stats":
            from retentio.operators.clean import normalise_missing
            from retentio.operators.stats import compute_stats
            from retentio.sources.customers import read_customers_csv
            from retentio.streaming.scoring import save_stats
            save_stats(compute_stats(normalise_missing(read_customers_csv(spark, args.input))), spark, args.out)
            print(args.out)
        elif args.cmd == "score":
            out = L.score_records(spark, args.records, args.stats, args.out, args.out + "-checkpoint",
                                  args.rejected, L.load_model(args.model))
            print(json.dumps({"scored": out.count(), "out": os.path.abspath(args.out)}))
        elif args.cmd == "train":
            for row in L.train(spark, args.input, args.model_out, args.label).collect():
                print(json.dumps(row.asDict()))
        elif args.cmd == "benchmarks":
            from retentio.sources.customers import benchmarks
            for row in benchmarks(spark).collect():
                print(json.dumps(row.asDict(), ensure_ascii=False))
    finally:
        if owned:  # never stop a session the caller owns
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
