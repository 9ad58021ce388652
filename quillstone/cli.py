"""Command line: ``python -m quillstone.cli ROOT PROJECT VERB ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from quillstone.api import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description="Document intelligence on Spark")
    p.add_argument("root"), p.add_argument("project")
    verbs = p.add_subparsers(dest="verb", required=True)
    add = lambda name, *args: [v := verbs.add_parser(name), [v.add_argument(*a[0], **a[1]) for a in args]][0]
    add("ingest", (["folder"], {}), (["--geography"], {"required": True}), (["--doc-type"], {"default": "report"}), (["--language"], {"default": "en"}))
    add("extract"), add("resolve"), add("network"), add("stats"), add("contradictions")
    add("graph", (["question"], {}), (["--hops"], {"type": int, "default": 2}), (["--at"], {}))
    add("search", (["question"], {}), (["--top-k"], {"type": int, "default": 8}), (["--top-n"], {"type": int, "default": 3}))
    add("find", (["name"], {}))
    add("export", (["folder"], {}))
    add("wipe", (["tables"], {"nargs": "*"}))
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | dict | None:
    e = Engine(spark, args.root, args.project)
    return {
        "ingest": lambda: e.ingest(args.folder, geography=args.geography, doc_type=args.doc_type, language=args.language), "extract": e.extract, "resolve": e.resolve, "network": e.network, "stats": e.corpus_stats, "contradictions": e.contradictions,
        "graph": lambda: e.graph_query(args.question, args.hops, args.at), "search": lambda: e.search(args.question, args.top_k, args.top_n), "find": lambda: e.find_entity(args.name), "export": lambda: e.export(args.folder), "wipe": lambda: e.wipe(*args.tables),
    }[args.verb]()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    out = run(SparkSession.builder.appName("quillstone").getOrCreate(), args)
    if isinstance(out, DataFrame):
        out.show(50, truncate=100)
    elif out is not None:
        print(out)


if __name__ == "__main__":
    main()
