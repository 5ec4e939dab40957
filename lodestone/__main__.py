"""Command line: `infer` answers queries over documents, `evaluate` scores predictions, `graph` merges triples."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import functions as F

from lodestone.functions.metrics import PROFILES
from lodestone.operators import tools
from lodestone.plans import pipelines
from lodestone.session import session
from lodestone.sources import readers, writers

log = logging.getLogger("lodestone")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("lodestone", description=__doc__)
    kinds = out.add_subparsers(dest="kind", required=True)
    infer = kinds.add_parser("infer")
    infer.add_argument("queries", help="JSON lines with query_id, text and language")
    infer.add_argument("docs", help="JSON lines with doc_id and text")
    infer.add_argument("out")
    infer.add_argument("--language", default="auto", help="auto takes each row's own")
    infer.add_argument("--limit", type=int, help="first documents by doc_id")
    evaluate = kinds.add_parser("evaluate")
    evaluate.add_argument("items", help="JSON lines with file, found, truth, answer and expected")
    evaluate.add_argument("out", help="folder of the averages")
    evaluate.add_argument("--profile", choices=sorted(PROFILES), default="full")
    graph = kinds.add_parser("graph")
    graph.add_argument("triples", help="JSON lines of triples")
    graph.add_argument("out")
    return out


def main(args: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(args)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(message)s", datefmt="%Y-%m-%dT%H:%M:%S", level=logging.INFO)
    spark = spark or session("lodestone")
    if a.kind == "infer":
        queries = readers.jsonl(spark, a.queries, "query_id long, text string, language string")
        docs = tools.first_rows(readers.jsonl(spark, a.docs, "doc_id long, text string"), "doc_id", a.limit)
        writers.jsonl(pipelines.infer(tools.in_language(queries, a.language, "language"), docs), a.out)
    elif a.kind == "evaluate":
        items = readers.jsonl(spark, a.items, "file string, found array<string>, truth array<string>, answer string, expected string")
        names = list(PROFILES[a.profile])
        scored = pipelines.evaluate(items, names)
        averages = scored.groupBy("file").agg(*[F.avg(n).alias(n) for n in [*names, "ROUGELScore"]])
        averages.show(truncate=False)
        writers.jsonl(averages, a.out)
    else:
        t = readers.jsonl(spark, a.triples, "doc_id long, pos long, head string, head_type string, relation string, tail string, tail_type string")
        built = pipelines.build_graph(t)
        writers.graph(built["entities"], built["triples"], a.out)
        writers.jsonl(built["entities"], f"{a.out}/entities.json")
    log.info("written to %s", a.out)


if __name__ == "__main__":
    main()
