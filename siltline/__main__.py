"""python -m siltline compile|parse|verify-pack|run|lake|queries ... : the engine from a shell."""

from __future__ import annotations

import argparse
import json
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("siltline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def compile_(args) -> int:
    """Checks a specification and prints its parser hash."""
    from siltline.operators.parser import Program, SpecError

    try:
        print(Program(read(args.spec)).parser_hash)
    except SpecError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def parse(args) -> int:
    """Parses standard input line by line; 1 if any line fails."""
    from siltline.operators.parser import Program

    program, failed = Program(read(args.spec)), 0
    for raw in sys.stdin.buffer:
        out = program.parse(raw.rstrip(b"\r\n"), args.ingest_ms)
        failed += out["status"] != "ok"
        print(json.dumps(out, ensure_ascii=False))
    return int(failed > 0)


def load(args):
    from siltline.operators import packs

    return packs.load(read(args.pack), {args.key: bytes.fromhex(args.public)})


def verify_pack(args) -> int:
    from siltline.operators.packs import Refused

    try:
        print(load(args).digest)
    except Refused as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    return 0


def run(args) -> int:
    """Interprets what is in a drop folder; with --follow until it is stopped. The pack is read anew for each batch."""
    from siltline.sources import frames
    from siltline.streaming import pipeline

    def pack():
        p = load(args)
        return pipeline.Pack(p.families, {k: v.spec for k, v in p.programs.items()}, p.mappings)

    files = frames.files(session(), args.drop, stream=True)
    pipeline.run(files, args.out, pack, args.framing, {"processingTime": "5 seconds"} if args.follow else None).awaitTermination()
    return 0


def lake(args) -> int:
    """Findings of ``verify``, or all versions of one event of ``get``."""
    from pyspark.sql import functions as F

    from siltline.sources import lake as store

    spark = session()
    versions = store.read_versions(spark, args.path)
    if args.what == "get":
        for line in versions.where(F.col("event_id").cast("string") == args.event).orderBy("normalization_version").toJSON().toLocalIterator():
            print(line)
        return 0
    found = store.verify(spark, args.path, versions.drop("normalization_version").schema).collect()
    for r in found:
        print(json.dumps(r.asDict()))
    return int(bool(found))


def queries(args) -> int:
    from siltline import catalogue

    if not args.name:
        print("\n".join(catalogue.QUERIES))
        return 0
    for line in catalogue.QUERIES[args.name](session(), args.tables).toJSON().toLocalIterator():
        print(line)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="siltline", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, f, *arguments: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for a in arguments:
            p.add_argument(a)
        p.set_defaults(f=f)
        return p

    command("compile", compile_, "spec")
    command("parse", parse, "spec").add_argument("--ingest-ms", type=int)
    command("verify-pack", verify_pack, "pack", "key", "public")
    p = command("run", run, "drop", "out", "pack", "key", "public")
    p.add_argument("--framing", default="newline")
    p.add_argument("--follow", action="store_true")
    p = command("lake", lake)
    p.add_argument("what", choices=("verify", "get"))
    p.add_argument("path")
    p.add_argument("event", nargs="?")
    p = command("queries", queries)
    p.add_argument("name", nargs="?")
    p.add_argument("tables", nargs="?")
    args = top.parse_args(argv)
    return args.f(args)


if __name__ == "__main__":
    sys.exit(main())
