from __future__ import annotations

import datetime

from weftgraph.streaming import changes


def at(minute: int) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_facts_follow_changes_and_survive_a_restart(spark, tmp_path):
    feed, store, mark = (str(tmp_path / n) for n in ("feed", "store", "mark"))
    put = lambda rows: spark.createDataFrame(rows, changes.CHANGES).write.mode("append").parquet(feed)
    run = lambda: changes.keep_facts(changes.read_changes(spark, feed), store, mark).awaitTermination()
    put([("a.py", "import os", at(1)), ("b.py", "import json", at(1)), ("a.py", "import sys, re", at(2)), (None, "x", at(1))])
    run()
    put([("b.py", None, at(3)), ("c.ts", "import x from './y'", at(3))])
    run()
    run()
    got = {r.path: [n.name for i in r.imports for n in i.names] or [i.module for i in r.imports] for r in changes.current(spark, store).collect()}
    assert got == {"a.py": ["sys", "re"], "c.ts": ["default"]}


def test_rates_leave_out_what_is_late(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("a.py", "", at(1)), ("b.py", "", at(2)), ("c.ts", "", at(15))], changes.CHANGES).write.parquet(feed)
    q = changes.language_rates(changes.read_changes(spark, feed)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start.minute, r.lang, r.n) for r in spark.table("rates").collect()} == {(0, "python", 2), (10, "ts", 1)}
