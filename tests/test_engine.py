"""The key-value engine: fixtures with known answers, matrices, oracles in plain Python, and the store's life."""

import random

import compare
import pytest
from pyspark.sql import functions as F

from stratakv import catalog, cli, logs
from stratakv.functions import clock, generators, scalar
from stratakv.model import ConflictError, KVError, Mode
from stratakv.operators import batch, extents, metrics, mutate, scan, search, space, workload
from stratakv.plans import ordered, visible
from stratakv.sources.store import Database

SMALL = "/root/testdata/sf0.001"


def relation(spark, pairs):
    return spark.createDataFrame([(k, v, i, i) for i, (k, v) in enumerate(pairs, 1)], "key string, value string, hlc long, seq long")


@pytest.fixture(scope="module")
def five(spark):
    return relation(spark, [(k, f"v:{k}") for k in ("aaa", "bbb", "ccc", "ddd", "eee")])


def keys(df):
    return [r.key for r in df.orderBy("rank").collect()]


def test_scans(five):
    assert keys(scan.ascend(five, "bbc")) == ["ccc", "ddd", "eee"] and keys(scan.ascend(five, "zzz")) == []
    assert keys(scan.descend(five, "ccx")) == ["ccc", "bbb", "aaa"] and keys(scan.descend(five)) == ["eee", "ddd", "ccc", "bbb", "aaa"]
    assert keys(scan.ascend_range(five, "bbb", "ddd")) == ["bbb", "ccc"] and keys(scan.ascend_range(five, "", "ccc")) == ["aaa", "bbb"]
    assert keys(scan.descend_range(five, "ddd", "bbb")) == ["ddd", "ccc"] and keys(scan.descend_range(five, "", "bbb")) == ["eee", "ddd", "ccc"]


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        (Mode.GTE, {"key003": "key003", "key002a": "key003", "key999": None, "": "key001"}),
        (Mode.GT, {"key003": "key004", "key002a": "key003", "key010": None, "": "key001"}),
        (Mode.LTE, {"key003": "key003", "key003a": "key003", "key000": None, "": "key010"}),
        (Mode.LT, {"key003": "key002", "key003a": "key003", "key001": None, "": "key010"}),
    ],
)
def test_find(spark, mode, want):
    ten = relation(spark, [(f"key{i:03d}", f"val{i:03d}") for i in range(1, 11)])
    probes = spark.createDataFrame([(k,) for k in want], "key string")
    assert {r.key: r.hit_key for r in search.find_many(ten, probes, mode).collect()} == want
    for k, hit in want.items():
        rows = search.find(ten, mode, k).collect()
        assert [r.key for r in rows] == ([hit] if hit else []) and all(r.exact == (r.key == k) for r in rows)
    assert search.find(ten, Mode.EXACT, "").count() == 0


@pytest.mark.parametrize(("begin", "end", "n"), [(True, True, 3), (True, False, 2), (False, True, 2), (False, False, 1)])
def test_delete_range_bounds(spark, begin, end, n):
    letters = relation(spark, [(c, c) for c in "abcde"])
    assert mutate.delete_range(letters, "b", "d", begin, end).count() == n
    assert mutate.delete_range(letters, "c", "c", begin, end).count() == (begin and end)


def test_delete_many_ranges(spark):
    rng = random.Random(3)
    live = relation(spark, [(f"{i:03d}", "") for i in range(200)])
    ranges = [(f"{a:03d}", f"{a + rng.randrange(12):03d}") for a in rng.choices(range(190), k=15)]
    got = {r.key for r in mutate.delete_ranges(live, spark.createDataFrame(ranges, "begin string, end string")).collect()}
    assert got == {f"{i:03d}" for i in range(200) if any(a <= f"{i:03d}" < b for a, b in ranges)}


def test_running_values_cross_ranges(spark):
    rng = random.Random(1)
    values = [rng.randrange(-50, 50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(7)
    rows = ordered.running(df, ["i"], {"s": ("sum", "v"), "m": ("max", "v")}).orderBy("i").collect()
    assert [r.s for r in rows] == [sum(values[: i + 1]) for i in range(500)] and [r.m for r in rows] == [max(values[: i + 1]) for i in range(500)]


def test_clock_rules(spark):
    rng = random.Random(2)
    events = [(i, rng.randrange(1, 40) << 16, rng.randrange(1, 50) << 16 if rng.random() < 0.3 else None) for i in range(300)]
    got = clock.stamp(spark.createDataFrame(events, "i long, pt long, m long"), "i", "pt", received="m").orderBy("i").collect()
    h = None
    for r, (_, pt, m) in zip(got, events, strict=True):
        h = max(x for x in (pt, None if h is None else h + 1, None if m is None else m + 1) if x is not None)
        assert r.hlc == h


def test_batches(spark):
    b = batch.Batch().set("k1", "a").set("k1", "b").delete("k2")
    assert len(b) == 3
    with pytest.raises(KVError):
        b.set("", "x")
    ops = spark.createDataFrame([(1, i, k, "v", False, 65536) for i, k in enumerate(["x1", "x1", "x2"])] + [(2, i, k, "v", False, 65536) for i, k in enumerate(["k1", "k2", "k3"])], "batch_id long, pos long, key string, value string, tomb boolean, pt long")
    got = {r.batch_id: r.endx - r.begin for r in batch.intervals(batch.stamped(ops, "pt")).collect()}
    assert got == {1: 2, 2: 1}


def test_merge(spark):
    live = relation(spark, [("a", "1"), ("b", None)])
    probes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    ops = {r.key: (r.value, r.tomb) for r in mutate.merge_with(live, probes, lambda old, exists: (f"{old}{exists}", exists, not exists)).collect()}
    assert ops == {"a": ("1True", False), "b": ("NoneTrue", False), "c": (None, True)}


def test_counters_equal_a_recount(spark):
    rng = random.Random(4)
    ops = [(i, f"k{rng.randrange(20)}", rng.choice([None, "", "s", "L" * 65]), rng.random() < 0.3, i) for i in range(1, 400)]
    log = spark.createDataFrame([(s, k, None if t else v, t, h) for s, k, v, t, h in ops], "seq long, key string, value string, tomb boolean, hlc long")
    assert tuple(metrics.counters(log).first()) == tuple(metrics.big_small(visible.live(log)).first())


def test_store(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"))
    for k, v in (("a", "1"), ("b", None), ("c", ""), ("d", "x" * 200)):
        db.put(k, v)
    assert (db.at().get("b").value, db.at().get("c").value, db.at().get("d").value, db.at().get("e")) == (None, "", "x" * 200, None)
    db.delete("a")
    assert db.at(4).get("a").value == "1" and db.at().get("a") is None and len(db.at()) == 3
    low, high = db.commit(batch.Batch().set("k", "1").set("k", "2").delete("b"))
    assert high - low == 3 and db.at().get("k").value == "2" and db.at().get("b") is None
    lazy = db.at().find(Mode.GTE | Mode.LAZY_LARGE, "d")
    assert lazy.large and lazy.value is None and db.at().fetch(lazy) == "x" * 200
    before = sorted(map(tuple, db.at().full().select("key", "value").collect()))
    db.sync()
    assert sorted(map(tuple, db.at().full().select("key", "value").collect())) == before and db.integrity().count() == 0
    stale = db.manifest(1)
    with pytest.raises(ConflictError):
        db.apply(db._rows([(0, "z", "1", False)]), stale)
    with pytest.raises(KVError):
        db.merge("k", lambda old, exists: ("x", True, True))
    db.merge("k", lambda old, exists: (str(int(old) + 1), True, False))
    assert db.at().get("k").value == "3"
    with pytest.raises(RuntimeError), db.update(atomic=True) as tx:
        tx.put("gone", "1")
        assert tx.get("gone").value == "1"
        raise RuntimeError
    assert db.at().get("gone") is None
    assert db.delete_range("a", "d", True, False)[0] == 1 and db.delete_range("", "zzz", True, True) == (0, True) and len(db.at()) == 0
    assert db.close()["live"] == 0 and db.close() is None


def test_extent_operations_follow_a_list(spark):
    rng = random.Random(9)
    tree, df = extents.Tree([[50, 0, 0], [30, 1000, 0]]), None
    df = spark.createDataFrame([(1, 50, 0, 0), (2, 30, 1000, 0)], "ord long, len long, poff long, tag int")
    for i in range(5):
        at, n, poff = rng.randrange(70), rng.randrange(1, 9), 5000 + 100 * i
        if i % 3 == 2:
            tree.delete(at, n)
            df = extents.delete(df, at, n)
        elif i % 3 == 1:
            tree.set_tag(at, 7)
            df = extents.set_tag(df, at, 7)
        else:
            tree.insert(at, poff, n)
            df = extents.insert(df, at, poff, n)
        df = spark.createDataFrame(df.collect(), df.schema)
        assert [list(r) for r in df.orderBy("ord").select("len", "poff", "tag").collect()] == tree.extents
    probes = spark.createDataFrame([(i,) for i in range(0, 95, 6)], "loff long")
    assert all(r.poff == tree.locate(r.loff) for r in extents.locate(df, probes).collect())
    with pytest.raises(KVError):
        extents.delete(df, 60, 1000)


def test_zipf_prefers_small_ranks(spark):
    counts = spark.range(20000).select(generators.zipf(generators.uniform(F.col("id")), 1000).alias("r")).groupBy("r").count().orderBy("r").collect()
    assert counts[0]["count"] > counts[1]["count"] > counts[5]["count"] and counts[0].r == 0 and max(r.r for r in counts) < 1000


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("b\na\n")
    assert cli.main(["load", str(tmp_path / "t.txt"), str(tmp_path / "x"), "--value-is-key"], spark) == 0
    cli.main(["view", str(tmp_path / "x")], spark)
    assert "a ::: a\nb ::: b\n2 keys, 2 key bytes, 2 value bytes" in capsys.readouterr().out
    cli.main(["diff", str(tmp_path / "x"), str(tmp_path / "x")], spark)


@pytest.mark.parametrize("name", ["kv_live_dump", "kv_counters_incremental", "get_multi", "find_lt_bulk", "find_edges", "scan_short_50", "merge_conditional", "batch_sub_batches", "hlc_receive", "vacuum_vlog_stats", "diff_first", "extent_delete", "stream_upsert", "space_write", "space_update", "space_read_many", "space_cursor", "space_usage_check", "key_fingerprint"])
def test_queries_equal_their_oracles(spark, name):
    assert compare.difference(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], SMALL) == ""


def test_the_entry_module():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_atomic_update_keeps_what_others_wrote(spark, tmp_path):
    path = str(tmp_path / "db")
    mine, other = Database.open(spark, path), Database.open(spark, path)
    mine.put("a", "1")
    with pytest.raises(RuntimeError, match="stop"), mine.update(atomic=True) as tx:
        tx.put("b", "2")
        assert tx.get("b").value == "2" and other.at().get("b") is None
        other.put("c", "3")
        raise RuntimeError("stop")
    assert [r.key for r in mine.at().ascend().collect()] == ["a", "c"]
    with pytest.raises(ConflictError), mine.update(atomic=True) as tx:
        tx.put("d", "4")
        other.put("e", "5")
    assert mine.at().get("d") is None and mine.at().get("e").value == "5"
    before = mine.manifest().version
    with mine.update(atomic=True) as tx:
        tx.put("f", "6")
        tx.delete("a")
    assert mine.manifest().version == before + 1 and mine.at().get("a") is None and mine.at().get("f").value == "6"


def test_a_late_operation_loses_in_the_store(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"))
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string, tomb boolean, pos long, hlc long")
    db.apply(rows(("k", "new", False, 0, 500), ("m", "x", False, 1, 400)))
    db.apply(rows(("k", "late", False, 0, 300), ("m", None, True, 1, 450)))
    assert db.at().get("k").value == "new" and db.at().get("m") is None and db.manifest().hlc == 500


def test_a_space_is_its_bytes(spark, tmp_path):
    """Texts of several cells, through every operation and a garbage collection, against plain bytes."""
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    want = b"".join((t or "").encode() for t in texts)
    s = space.Space.empty(spark).append(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", "text").save(str(tmp_path / "a"))
    big = random.Random(6).randbytes(200_000)
    s, want = s.insert(70_001, big), want[:70_001] + big + want[70_001:]
    s, want = s.collapse(60_000, 30_000), want[:60_000] + want[90_000:]
    s, want = s.overwrite(59_000, b"xyz" * 900), want[:59_000] + b"xyz" * 900 + want[61_700:]
    s = s.save(str(tmp_path / "b")).set_tag(50, 7)
    s, want = s.update(50, b"hello", 30), want[:50] + b"hello" + want[80:]
    assert extents.get_tag(s.extents, 50).first().tag == 7
    s, want = s.write(s.size() - 2, b"longer tail"), want[:-2] + b"longer tail"
    s = s.save(str(tmp_path / "c"))
    assert s.integrity(metrics.block_usage(s.extents), len(want)).count() == 0 and s.read(59_990, 40) == want[59_990:60_030]
    old, s = s, s.collect_garbage()
    assert s.extents.agg(F.min("poff")).first()[0] >= old.end and s.physical_end() > old.physical_end()
    assert b"".join(bytes(r.data) for r in s.content(5000).orderBy("id").collect()) == want
    lost = space.Space(s.extents, s.chunks.where("false"), s.end)
    assert lost.integrity().where("fatal").count() == s.extents.count()
    for wrong in (lambda: s.insert(len(want) + 1, b"x"), lambda: s.collapse(len(want), 1), lambda: s.read(-1, 1), lambda: s.update(0, b"", len(want) + 1)):
        with pytest.raises(KVError):
            wrong()


def test_an_empty_space(spark, tmp_path):
    s = space.Space.empty(spark)
    assert s.size() == 0 and s.read(0, 0) == b"" and s.content(10).count() == 0 and s.collect_garbage() is s
    s = s.write(0, b"abc").allocate(1, 2).truncate(4)
    assert s.save(str(tmp_path / "s")).read(0, 4) == b"a\0\0b"


def test_crc32c_of_known_texts(spark):
    rows = spark.createDataFrame([("123456789", 0xE3069283), ("", 0), (None, None)], "t string, c long")
    assert all(r.c == r.got for r in rows.withColumn("got", scalar.crc32c(F.col("t"))).collect())


def test_a_run_of_extents_stays_in_the_address_space(spark, tmp_path):
    """Runs a billion bytes apart left the 47 bits of an address after 703 685 extents, and were holes from there."""
    l = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    more = l.where("l_orderkey < 30000").withColumn("l_orderkey", F.col("l_orderkey") + 150_000)
    l.union(more).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert compare.difference(catalog.QUERIES["extent_merge"](spark, str(tmp_path)), catalog.ORACLES["extent_merge"], str(tmp_path)) == ""


def test_an_appended_row_is_one_extent_over_borders(spark, tmp_path):
    """Rows across the borders of cells and blocks; a block is emptied and what stays keeps its bytes."""
    rows = [(i, bytes([i % 251]) * 100_001) for i in range(90)]
    s = space.Space.empty(spark).append(spark.createDataFrame([*rows, (90, b"long" * 70_000)], "i long, b binary"), "i", "b").save(str(tmp_path / "a"))
    want = b"".join(b for _, b in rows) + b"long" * 70_000
    assert [r.len for r in s.extents.where("ord <= 90").collect()] == [100_001] * 90 and s.extents.agg(F.max("len")).first()[0] <= 128 << 10
    assert s.integrity(metrics.block_usage(s.extents), len(want)).count() == 0
    s, want = s.collapse(100, 4_194_304 - 50).save(str(tmp_path / "b")), want[:100] + want[4_194_354:]
    s = s.collect_garbage(1).save(str(tmp_path / "c"))
    assert s.integrity().count() == 0 and b"".join(bytes(r.data) for r in s.content(90_000).orderBy("id").collect()) == want


def test_a_cursor_over_a_space_of_several_cells(spark):
    folder = "/root/testdata/sf0.1"
    assert compare.difference(catalog.QUERIES["space_cursor"](spark, folder), catalog.ORACLES["space_cursor"], folder) == ""


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_by_bisection_are_dealt_evenly(spark):
    rng = random.Random(11)
    cuts = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(40)})
    rows = [(rng.randrange(10), rng.randrange(10)) for _ in range(300)] + [(None, 1)]
    df = spark.createDataFrame(rows, "a long, b long")
    for got in (ordered.dealt(df, ["a", "b"], cuts).collect(), ordered.dealt(df, "a", [c[0] for c in cuts]).collect()):
        assert len(got) == 301
    assert all(r._range == (0 if r.a is None else sum(c <= (r.a, r.b) for c in cuts)) for r in ordered.dealt(df, ["a", "b"], cuts).collect())
    assert all(r._range == (0 if r.a is None else sum(c[0] <= r.a for c in cuts)) for r in ordered.dealt(df, "a", [c[0] for c in cuts]).collect())
    names = ordered._names(12, 4)
    hashed = [r.p for r in spark.createDataFrame([(n,) for n in names], "n int").select(F.pmod(F.hash("n"), F.lit(4)).alias("p")).collect()]
    assert len(set(names)) == 12 and names == sorted(names) and all(hashed.count(p) == 3 for p in range(4)) and len(set(ordered._names(4, 4))) == 4


@pytest.mark.parametrize("name", ["space_read_frag", "extent_insert", "extent_tags", "extent_tree_diff", "extent_delete", "extent_pdelete", "batch_sub_batches", "extent_pquery", "batch_hlc_interval", "extent_place", "extent_query"])
def test_lines_are_sorted_once(spark, name):
    """What follows the order of the lines reads it from files; before, each step sorted all lines again."""
    df = catalog.QUERIES[name](spark, SMALL)
    assert "l_linenumber" not in plan_of(df) and compare.difference(df, catalog.ORACLES[name], SMALL) == ""


def test_edits_and_queries_of_extents_with_gaps_and_empty_ones(spark):
    """Ordinals with gaps and extents without bytes, over several ranges, against a list."""
    rng = random.Random(12)
    rows = [(3 * i + 5, rng.choice([0, 1, 7, 30]), extents.HOLE if i % 11 == 3 else 100_000 + 64 * i, i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "ord long, len long, poff long, tag int").repartition(5)
    tree = lambda: extents.Tree([[n, p, t] for _, n, p, t in rows if n])
    total = tree().total
    same = lambda got, want: [list(r) for r in got.orderBy("ord").select("ord", "len", "poff", "tag").collect()] == [[i, *e] for i, e in enumerate(want.extents, 1)]
    for at, n in ((0, 1), (total // 2, 93), (total - 5, 5), (0, total), (rng.randrange(total - 400), 400), (total, 0)):
        t = tree()
        t.delete(at, n)
        assert same(extents.delete(df, at, n), t)
    for at in (0, 1, total // 3, total - 1):
        t = tree()
        t.insert(at, 77, 12, 3)
        assert same(extents.insert(df, at, 77, 12, 3), t)
        t = tree()
        t.set_tag(at, 9)
        assert same(extents.set_tag(df, at, 9), t) and extents.get_tag(extents.set_tag(df, at, 9), at).first().tag == 9
    probes = spark.createDataFrame([(i,) for i in range(-3, total + 4, 5)], "loff long")
    assert all(r.poff == (tree().locate(r.loff) if r.loff >= 0 else -1) for r in extents.locate(df, probes).collect())
    cut = extents.query(df, total // 2, 200).collect()
    assert sum(r.len for r in cut) == 200 and extents.query(df, total - 1, 2).count() == 0


def test_an_edit_of_numbered_extents_moves_no_row(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("ord"), F.lit(10).cast("long").alias("len"), (F.col("id") * 64).alias("poff"), F.lit(0).alias("tag"))
    for out in (extents.insert(df, 5003, 7, 20), extents.delete(df, 5003, 707), extents.delete_byte(df, 5003), extents.set_tag(df, 5003, 9)):
        plan = plan_of(out)
        assert "Window" not in plan and "Sort" not in plan and "Repartition" not in plan


def test_two_trees_are_compared_in_one_aggregation(spark):
    a = spark.createDataFrame([(1, 5, 0, 0), (2, 0, 9, 0), (3, 0, 9, 0), (4, 6, 64, 1)], "ord long, len long, poff long, tag int")
    b = spark.createDataFrame([(1, 5, 0, 0), (2, 6, 64, 2)], "ord long, len long, poff long, tag int")
    out = space.difference(a, b)
    assert plan_of(out).count("Aggregate [") == 1
    assert sorted(map(tuple, out.collect())) == [("a", 5, 0, 9, 0), ("a", 5, 0, 9, 0), ("a", 5, 6, 64, 1), ("b", 5, 6, 64, 2)]


def test_sub_batches_are_walked_without_a_batch_in_memory(spark):
    rng = random.Random(13)
    ops = [(b, 7 * i, rng.choice([None, *range(1 + 9 * b)])) for b in range(-1, 4) for i in range(250)]
    df = spark.createDataFrame([(b, p, None if k is None else f"k{k}") for b, p, k in ops], "batch_id long, pos long, key string").repartition(6)
    want, seen, number, batch_id = {}, set(), 0, None
    for b, p, k in ops:
        if b != batch_id:
            seen, number, batch_id = set(), 0, b
        if k in seen:
            seen, number = set(), number + 1
        seen.add(k)
        want[b, p] = number
    got = batch.sub_batches(df)
    assert "FlatMapGroupsInPandas" not in plan_of(got) and "MapInPandas" in plan_of(batch.starts(df))
    assert {(r.batch_id, r.pos): r.sub_batch for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 3, 64, 150])
def test_short_scans_meet_blocks(spark, n):
    live = relation(spark, [(f"{i:04d}", f"v{i}") for i in range(0, 500, 2)]).select("key", "value")
    probes = spark.createDataFrame([(f"{i:04d}", i) for i in (0, 1, 7, 100, 377, 498, 499)], "key string, id long")
    out = scan.short_scans(live, probes, n)
    assert "_block" in plan_of(out)
    want = {(f"{p:04d}", p, j, f"{i:04d}", f"v{i}") for p in (0, 1, 7, 100, 377, 498, 499) for j, i in enumerate(range(p + p % 2, 500, 2)) if j < n}
    assert {(r.probe, r.id, r.step, r.key, r.value) for r in out.collect()} == want


def test_ranges_of_a_search_come_from_both_sides(spark, monkeypatch):
    """All ranges end in the first hundredth of the keys; before, every later key fell into one task's range."""
    seen, dealt = [], ordered.dealt
    monkeypatch.setattr(ordered, "dealt", lambda df, columns, cuts, out="_range": seen.append(cuts) or dealt(df, columns, cuts, out))
    live = relation(spark, [(f"{i:05d}", "") for i in range(10_000)])
    ranges = spark.createDataFrame([(f"{i:05d}", f"{i + 2:05d}") for i in range(0, 100, 5)], "begin string, end string")
    got = {r.key for r in mutate.delete_ranges(live, ranges).collect()}
    assert got == {f"{i:05d}" for i in range(100) if i % 5 < 2}
    assert max(int(c[-1]) for c in seen) > 6000


@pytest.mark.parametrize("make", [logs.docs, logs.orders, logs.pages])
def test_a_clock_of_milliseconds_meets_no_other_row(spark, make):
    """store_round_trip, store_old_version, integrity_clean: texts were sorted twice for their clock."""
    log = make(spark, SMALL)
    assert "Window" not in plan_of(log)
    want = clock.stamp(log.select("seq", clock.physical(F.col("seq") * 1000).alias("pt")), "seq", "pt").select("seq", "hlc")
    assert log.select("seq", "hlc").exceptAll(want).count() == 0 and log.count() == want.count()


def test_scans_of_a_mix_need_no_ranks(spark):
    live = relation(spark, [(f"{i:03d}", "") for i in range(100)])
    ops = spark.createDataFrame([(f"{i:03d}", "scan") for i in range(0, 120)] + [("x", "set")], "key string, op string")
    for rows, ok in ((50, 50), (100, 0), (99, 1), (500, 0)):
        out = workload.run_mix(live, ops, rows)
        assert "Window" not in plan_of(out) and {r.op: (r.n, r.ok) for r in out.collect()} == {"scan": (120, ok), "set": (1, 1)}
    assert compare.difference(catalog.QUERIES["ycsb_e"](spark, SMALL), catalog.ORACLES["ycsb_e"], SMALL) == ""


def test_a_dump_of_keys_reads_values_once(spark):
    df = catalog.QUERIES["text_dump_keys"](spark, SMALL)
    assert "max_by" not in plan_of(df) and compare.difference(df, catalog.ORACLES["text_dump_keys"], SMALL) == ""
