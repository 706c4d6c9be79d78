"""``python -m lexweave ingest XML NORM URI INDEX RECORDING`` and ``ask INDEX QUESTION VECTOR``, over a local or submitted session.

RECORDING is a Parquet folder of (key, vector) made by ``record_embeddings``;
VECTOR is the question's vector as JSON.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.chunking import ARTICLE, CHUNKERS
from .plans.ask import ask
from .plans.index import Index
from .plans.ingest import ingest
from .sources.lawxml import read_law_xml
from .sources.models import recorded_embedder


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexweave")
    commands = parser.add_subparsers(dest="command", required=True)
    add = commands.add_parser("ingest")
    for name in ("xml", "norm", "uri", "index", "recording"):
        add.add_argument(name)
    add.add_argument("--chunker", choices=sorted(CHUNKERS), default=ARTICLE)
    add.add_argument("--model", default="recorded")
    add.add_argument("--dim", type=int, default=1024)
    find = commands.add_parser("ask")
    for name in ("index", "question", "vector"):
        find.add_argument(name)
    find.add_argument("-k", type=int, default=5)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    index = Index(spark, args.index)
    if args.command == "ingest":
        embed = recorded_embedder(spark.read.parquet(args.recording), args.model)
        rows = ingest(index, read_law_xml(spark, args.xml), F.lit(args.norm), F.lit(args.uri), embed, args.model, args.dim, args.chunker)
        print(f"{rows.count()} chunks")
        return
    question = spark.createDataFrame([(1, args.question, [float(x) for x in json.loads(args.vector)])], "query_id int, pregunta string, vector array<double>")
    for row in ask(question, index.chunks(), args.k).orderBy("rank").collect():
        print(f"{row['rank']}. {row.legal_ref}  {row.content.splitlines()[0]}")


if __name__ == "__main__":
    main()
