"""Command line: filter, tokenize, validate, estimate, mix, order, pack, stream, project, search, synth, query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heddle.functions import curriculum, quality
from heddle.operators import estimates, mixing, packing, search, synth
from heddle.plans import pipeline
from heddle.sources import files, hub, tokenbin


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="heddle", description=__doc__)
    sub = parser.add_subparsers(dest="step", required=True)
    p = sub.add_parser("filter")
    p.add_argument("raw")
    p.add_argument("out")
    p.add_argument("--min-score", type=float, default=0.0)
    p.add_argument("--max-records", type=int)
    p = sub.add_parser("tokenize")
    p.add_argument("filtered")
    p.add_argument("out")
    p.add_argument("vocabulary")
    p = sub.add_parser("validate")
    p.add_argument("tokens")
    p = sub.add_parser("estimate")
    p.add_argument("raw")
    p = sub.add_parser("mix", help="two sets of JSON lines into one, with a share of the second")
    p.add_argument("corpus")
    p.add_argument("distilled")
    p.add_argument("out")
    p.add_argument("--ratio", type=float, default=0.20)
    p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("order", help="JSON lines by their complexity, easy ones first")
    p.add_argument("raw")
    p.add_argument("out")
    p.add_argument("--reverse", action="store_true")
    p = sub.add_parser("pack", help="token lists of a table into sequences of one length")
    p.add_argument("tokens")
    p.add_argument("out")
    p.add_argument("--length", type=int, default=2048)
    p = sub.add_parser("stream", help="token lists of a table into one file of int32")
    p.add_argument("tokens")
    p.add_argument("out")
    p = sub.add_parser("project", help="a public corpus that lies here as Parquet, to the document columns")
    p.add_argument("corpus")
    p.add_argument("out")
    p.add_argument("--starred", action="store_true", help="a corpus without licenses")
    p.add_argument("--per-language", type=int, default=300_000)
    p = sub.add_parser("search", help="filter settings against a table of labelled texts: (content, good)")
    p.add_argument("labelled")
    p.add_argument("space", help="JSON: a list of least lengths and one of least scores")
    p.add_argument("--trials", type=int, help="so many random points instead of the grid")
    p = sub.add_parser("synth")
    p.add_argument("out")
    p.add_argument("--kind", choices=("topics", "db"), default="topics")
    p.add_argument("--n", type=int, default=100)
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("tables")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"heddle-{a.step}").getOrCreate()
    if a.step == "filter":
        pipeline.filter_all(spark, a.raw, a.out, min_score=a.min_score, max_records=a.max_records).show(truncate=False)
    elif a.step == "tokenize":
        print("written" if pipeline.tokenize_all(spark, a.filtered, a.out, a.vocabulary) else "already there")
    elif a.step == "validate":
        pipeline.validate_tokens(spark, a.tokens).show(truncate=False)
    elif a.step == "estimate":
        docs = files.read_jsonl(spark, a.raw).where("not malformed")
        estimates.estimate_tokens(docs, "content", ["file"]).show(truncate=False)
    elif a.step == "mix":
        sides = [files.read_jsonl(spark, path).where("not malformed").drop("malformed").withColumn("id", F.sha2(F.concat_ws(":", "content", "path"), 256)) for path in (a.corpus, a.distilled)]
        mixed = mixing.mix(*sides, "id", a.ratio, a.seed)
        files.write_jsonl(mixing.seeded_shuffle(mixed, "id", a.seed).drop("id", "file", "line_no"), a.out)
        mixing.mix_stats(mixed).show()
    elif a.step == "order":
        docs = files.read_jsonl(spark, a.raw).where("not malformed").drop("malformed")
        placed = mixing.curriculum_rank(docs.withColumn("complexity", curriculum.code_complexity("content")), "complexity", ["file", "line_no"], a.reverse)
        files.write_jsonl(placed.orderBy("curriculum_rank").drop("file", "line_no"), a.out)
    elif a.step == "pack":
        packing.pack(spark.read.parquet(a.tokens), "ids", ["hash"], a.length).write.parquet(a.out)
    elif a.step == "stream":
        print(tokenbin.write_stream(spark.read.parquet(a.tokens), "ids", ["hash"], a.out), "ids written")
    elif a.step == "project":
        docs = spark.read.parquet(a.corpus)
        made = hub.project_starred(docs, per_language=a.per_language) if a.starred else hub.project_documents(docs, a.per_language)
        files.write_jsonl(made, a.out)
    elif a.step == "search":
        rows = spark.read.parquet(a.labelled).select("good", F.length("content").alias("n"), quality.textbook_quality("content", F.lit("")).alias("s"))
        space = json.loads(a.space)
        points = search.random_points(space, a.trials) if a.trials else search.grid(space)
        right = lambda p: F.avg((((F.col("n") >= p["least"]) & (F.col("s") >= p["score"])) == F.col("good")).cast("int"))
        search.over_table(rows, points, right, "maximize").orderBy("rank").show(truncate=False)
    elif a.step == "synth":
        made = synth.synthetic_instances(spark, a.n) if a.kind == "topics" else synth.db_call_examples(spark, a.n)
        files.write_jsonl(made, a.out)
    else:
        from heddle.plans.queries import QUERIES

        QUERIES[a.name](spark, a.tables).show(truncate=False)


if __name__ == "__main__":
    main()
