"""Commands: load text, view, vacuum and compare databases.

    python -m stratakv.cli load FILE DB [--value-is-key]
    python -m stratakv.cli view DB [--keys | --times | --stats]
    python -m stratakv.cli vacuum DB
    python -m stratakv.cli diff DB DB
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources import text
from .sources.store import Database


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="stratakv")
    sub = top.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load")
    load.add_argument("file")
    load.add_argument("db")
    load.add_argument("--value-is-key", action="store_true")
    view = sub.add_parser("view")
    view.add_argument("db")
    how = view.add_mutually_exclusive_group()
    for name in ("keys", "times", "stats"):
        how.add_argument(f"--{name}", action="store_true")
    sub.add_parser("vacuum").add_argument("db")
    compare = sub.add_parser("diff")
    compare.add_argument("a")
    compare.add_argument("b")
    x = top.parse_args(args)
    spark = spark or SparkSession.builder.appName("stratakv").getOrCreate()
    if x.command == "load":
        db = Database.open(spark, x.db)
        db.apply(text.load(spark, x.file, x.value_is_key).dropDuplicates(["key"]))
        print(db.sync().version)
    elif x.command == "view":
        db = Database.open(spark, x.db)
        live = db.at().full()
        if x.stats:
            print(db.metrics())
            for r in db.integrity().toLocalIterator():
                print(r.check, r.detail, "fatal" if r.fatal else "")
            return 0
        rows = text.dump_keys(live) if x.keys else text.dump_times(live) if x.times else text.dump(live)
        for r in rows.orderBy("rank").toLocalIterator():
            print(*[v for k, v in r.asDict().items() if k != "rank"])
        n, keys, values = text.trailer(live).first()
        print(f"{n} keys, {keys} key bytes, {values} value bytes")
    elif x.command == "vacuum":
        print(Database.open(spark, x.db).vacuum())
    else:
        print(Database.open(spark, x.a).diff(Database.open(spark, x.b)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
