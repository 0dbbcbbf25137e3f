"""Command line: records of transcripts, delivery of history, state, the data dictionary."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone
from pathlib import Path


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracewright")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("records", help="gated records of all transcripts below a folder, as Parquet")
    run.add_argument("--root", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--now", help="ISO time that clock checks use; the present if absent")
    run.add_argument("--salt-dir", help="folder of the pseudonymization salt; labels stay readable without one")
    run.add_argument("--tier", default="full")
    run.add_argument("--tool-dir", default="tool", help="name of the folder that the classifier's own sessions run in")
    for name, said in (("backfill", "imports all history once"), ("resurvey", "sends sessions of 7 to 30 days ago again, with what became of their commits"), ("status", "the state of settings, import and server")):
        command = sub.add_parser(name, help=said)
        command.add_argument("--settings", required=True, help="folder with config.json, the salt and the ledgers")
        command.add_argument("--root", default=".", help="folder of the transcripts")
        command.add_argument("--skip", action="store_true", help="backfill: declines the import")
    hook = sub.add_parser("hook", help="sends the session that a host names on standard input")
    hook.add_argument("--settings", required=True)
    enrich = sub.add_parser("enrich", help="labels and sends the session that variables name")
    enrich.add_argument("--prefix", default="TRACEWRIGHT_", help="of the variables")
    enrich.add_argument("--old-prefix", default="TW_")
    sub.add_parser("dictionary", help="the fields of a record, as Markdown")
    args = parser.parse_args(argv)
    if args.command == "dictionary":
        from tracewright.operators.gate import documentation

        print(documentation())
        return
    from pyspark.sql import SparkSession

    if args.command in ("hook", "enrich"):
        from tracewright.plans import commands
        from tracewright.sources import hooks

        spark, now = SparkSession.builder.getOrCreate(), datetime.now(timezone.utc)
        if args.command == "hook":
            print(commands.finish(spark, sys.stdin.read(), now, Path(args.settings)))
        else:
            print(commands.enrich(spark, hooks.of_environment(os.environ, (args.prefix, args.old_prefix)), now))
        return
    if args.command in ("backfill", "resurvey", "status"):
        from tracewright.plans import commands

        spark, now, settings = SparkSession.builder.getOrCreate(), datetime.now(timezone.utc), Path(args.settings)
        if args.command == "backfill":
            print(commands.backfill(spark, args.root, now, settings, skip=args.skip))
        elif args.command == "resurvey":
            print(commands.resurvey(spark, args.root, now, settings))
        else:
            print("\n".join(commands.report(spark, settings)))
        return

    from tracewright.functions import vocab as V
    from tracewright.plans.pipeline import records
    from tracewright.sources.config import load_salt

    tier = args.tier.lower() if args.tier.lower() in V.TIERS else "off"
    now = datetime.fromisoformat(args.now) if args.now else datetime.now(timezone.utc)
    salt = load_salt(Path(args.salt_dir)) if args.salt_dir else None
    spark = SparkSession.builder.getOrCreate()
    records(spark, args.root, now, salt=salt, usage=V.TIERS[tier][1], ship_facts=V.TIERS[tier][2], tool_dir=args.tool_dir).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
