"""Command line: python -m docloom COMMAND ..., each a thin call of library functions.

convert    ground-truth JSON folder -> validated JSON lines
evaluate   predicted JSON lines against a ground-truth folder -> metrics as JSON
report     predicted JSON lines against a ground-truth folder -> precision, recall, f1 by token label and by entity
rectangles XML rectangles and token JSON lines -> labelled JSON lines
split      JSON lines -> the same with a split column
predict    folder of page images -> predicted JSON lines (--engine and --predictor: module:factory)
export     tables attributes, pages, documents of a folder -> validated attributes as csv or one JSON a document
training   tables tokens, attributes, documents of a folder -> training JSON lines
"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, inputs in (("convert", ["folder", "output"]), ("evaluate", ["predictions", "truth"]), ("report", ["predictions", "truth"]), ("rectangles", ["xml", "tokens", "output"]), ("split", ["examples", "output"]), ("predict", ["folder", "output"]), ("export", ["tables", "output"]), ("training", ["tables", "output"])):
        sub = commands.add_parser(name)
        for x in inputs:
            sub.add_argument(x)
        if name == "evaluate":
            sub.add_argument("--iou", type=float, default=0.5)
        if name == "split":
            sub.add_argument("--seed", type=int, default=42)
            sub.add_argument("--fractions", type=float, nargs=3, default=(0.7, 0.15, 0.15))
        if name == "predict":
            sub.add_argument("--engine")
            sub.add_argument("--predictor")
        if name == "export":
            sub.add_argument("--format", choices=("csv", "json"), default="csv")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .operators import export, flow, search, split
    from .schemas import alias_table
    from .sources import boundary, readers, writers

    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if args.command == "convert":
        n = writers.write_jsonl(readers.validated(readers.read_json_folder(spark, args.folder)), args.output)
    elif args.command == "evaluate":
        print(json.dumps(flow.evaluate_records(readers.read_jsonl(spark, args.predictions), readers.read_json_folder(spark, args.truth), args.iou), indent=2, sort_keys=True))
        return 0
    elif args.command == "report":
        print(json.dumps(flow.record_report(readers.read_jsonl(spark, args.predictions), readers.read_json_folder(spark, args.truth)), indent=2, sort_keys=True))
        return 0
    elif args.command == "rectangles":
        tokens = spark.read.json(args.tokens)
        n = writers.write_jsonl(export.rectangle_records(tokens, readers.read_rectangles(spark, args.xml)), args.output)
    elif args.command == "predict":
        engine, predictor = (boundary.named_factory(x) if x else None for x in (args.engine, args.predictor))
        n = writers.write_jsonl(flow.predicted_records(spark, args.folder, engine, predictor), args.output)
    elif args.command == "export":
        t = readers.read_tables(spark, args.tables, "attributes", "pages", "documents")
        rows = search.export_rows(t["attributes"], t["pages"], t["documents"])
        n = writers.write_csv(rows, args.output) if args.format == "csv" else writers.write_jsonl(writers.as_json_documents(rows), args.output)
    elif args.command == "training":
        t = readers.read_tables(spark, args.tables, "tokens", "attributes", "documents")
        n = writers.write_jsonl(export.training_records(t["tokens"], t["attributes"], t["documents"], alias_table(spark)), args.output)
    else:
        rows = readers.token_examples(readers.read_jsonl(spark, args.examples))
        n = writers.write_jsonl(split.hash_split(rows, "document_id", tuple(args.fractions), args.seed), args.output)
    print(json.dumps({"records": n}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
