"""python -m sparkloom STORE COMMAND ...: a small command line over a store of Parquet tables."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("stats", help="rows of each table")
    load = sub.add_parser("load", help="read raw export tables of a folder into the store")
    load.add_argument("folder")
    search = sub.add_parser("search", help="updates whose title or description holds a text")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    session = sub.add_parser("session", help="the newest updates of a session")
    session.add_argument("session_id")
    session.add_argument("--limit", type=int, default=10)
    out = sub.add_parser("export", help="write an export document")
    out.add_argument("path")
    out.add_argument("--compression", choices=["none", "gzip", "zstd"])
    look = sub.add_parser("preview", help="metadata of an export document")
    look.add_argument("path")
    move = sub.add_parser("migrate", help="copy all tables to another store")
    move.add_argument("target")
    move.add_argument("--dry-run", action="store_true")
    work = sub.add_parser("workspace", help="add a session to a workspace")
    work.add_argument("workspace_id")
    work.add_argument("session_id")
    work.add_argument("--role", default="related")
    check = sub.add_parser("checkpoint", help="keep a copy of a session's updates, or put one back")
    check.add_argument("action", choices=["create", "restore"])
    check.add_argument("checkpoint_id")
    check.add_argument("session_id", nargs="?")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from sparkloom.functions.validate import limit_arg, uuid_arg
    from sparkloom.operators import context
    from sparkloom.sources import export, tables
    from sparkloom.sources.store import Store

    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, show = Store(spark, a.store), lambda df: [print(r) for r in df.toJSON().toLocalIterator()]
    if a.command == "stats":
        print(json.dumps(store.stats()))
    elif a.command == "load":
        for name, df in (("session", tables.sessions), ("update", tables.updates), ("embedding", tables.embeddings), ("workspace_session", tables.workspace_sessions), ("edge", tables.edges)):
            store.write(name, df(spark, a.folder))
    elif a.command == "search":
        found = context.keyword_search(store.read("update"), a.query).orderBy(*context.newest_first()).limit(limit_arg(a.limit))
        show(found.select("session_id", "update_id", "ts", "title"))
    elif a.command == "session":
        own = store.read("update", session_id=uuid_arg(a.session_id))
        show(context.hot_context(own, limit_arg(a.limit)).select("update_id", "ts", "update_type", "title"))
    elif a.command == "export":
        export.write_export(store.read("session"), store.read("update"), a.path, compression=a.compression)
    elif a.command == "preview":
        print(json.dumps(export.preview(spark, a.path)))
    elif a.command == "migrate":
        print(json.dumps(store.copy_to(Store(spark, a.target), a.dry_run)))
    elif a.command == "workspace":
        store.add_to_workspace(uuid_arg(a.workspace_id, "workspace_id"), uuid_arg(a.session_id), a.role)
    elif a.action == "create":
        store.checkpoint(a.checkpoint_id, uuid_arg(a.session_id or ""))
    else:
        store.restore(a.checkpoint_id)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
