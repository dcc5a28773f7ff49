"""The registered queries of the engine's operators, each with an independent DuckDB statement where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import logs
from . import oracles as O
from .functions import clock, scalar
from .model import Mode
from .operators import batch, diff, extents, metrics, mutate, scan, search, space, values, workload
from .plans import files, ordered, visible
from .sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _live(spark, d):
    return visible.live(logs.events(spark, d))


EV, PR = O.with_(O.EVENTS), O.with_(O.EVENTS, O.PROBES)
OR, DO, PA = O.with_(O.ORDERS), O.with_(O.DOCS), O.with_(O.PAGES)
ROWS = "select row_number() over (order by key) as rank, key, value, hlc, seq from live"


@query("kv_live_dump", EV + ROWS)
def kv_live_dump(spark, d):
    return scan.ascend(_live(spark, d)).select("rank", "key", "value", "hlc", "seq")


@query("kv_len", EV + "select count(*) as n from live")
def kv_len(spark, d):
    return metrics.length(_live(spark, d))


@query("kv_len_big_small", DO + "select count(*) filter (strlen(value) > 64) as big, count(*) filter (value is null or strlen(value) <= 64) as small from live")
def kv_len_big_small(spark, d):
    return metrics.big_small(visible.live(logs.docs(spark, d)))


@query("kv_counters_incremental", EV + "select cast(count(*) filter (strlen(value) > 64) as bigint) as big, cast(count(*) filter (value is null or strlen(value) <= 64) as bigint) as small from live")
def kv_counters_incremental(spark, d):
    return metrics.counters(logs.events(spark, d))


@query("kv_states", EV + "select case when tomb then 'tombstone' when value is null then 'nil' when value = '' then 'empty' when strlen(value) > 64 then 'large' else 'inline' end as state, count(*) as n from lev group by 1")
def kv_states(spark, d):
    return logs.events(spark, d).groupBy(scalar.state(F.col("value"), F.col("tomb")).alias("state")).agg(F.count("*").alias("n"))


@query("kv_key_range", EV + "select min(key) as min_key, max(key) as max_key from live")
def kv_key_range(spark, d):
    return metrics.key_range(_live(spark, d))


@query("kv_at_version", O.with_(O.EVENTS) + "select key, value, hlc, seq from lev where seq <= (select max(event_id) // 2 from events) qualify row_number() over (partition by key order by hlc desc, seq desc) = 1 and not tomb")
def kv_at_version(spark, d):
    half = logs.table(spark, d, "events").agg(F.expr("max(event_id) div 2")).first()[0]
    return visible.live(logs.events(spark, d), half).select("key", "value", "hlc", "seq")


@query("get_multi", PR + "select p.key, l.value, l.hlc, l.key is not null as found from probes p left join live l on p.key = l.key")
def get_multi(spark, d):
    return search.get_many(_live(spark, d), logs.probes(spark, d)).select("key", "value", "hlc", "found")


@query("get_one", EV + "select key, value, hlc, true as exact from live where key = (select min(key) from live)")
def get_one(spark, d):
    live = _live(spark, d)
    return search.get(live, live.agg(F.min("key")).first()[0]).select("key", "value", "hlc", "exact")


_MODES = {"gte": (Mode.GTE, "min", ">="), "gt": (Mode.GT, "min", ">"), "lte": (Mode.LTE, "max", "<="), "lt": (Mode.LT, "max", "<")}
_PROBE = "u000050x"

for _n, (_mode, _agg, _op) in _MODES.items():

    @query(f"find_{_n}", EV + f"select key, value, hlc, key = '{_PROBE}' as exact from live where key = (select {_agg}(key) from live where key {_op} '{_PROBE}')")
    def _one(spark, d, mode=_mode):
        return search.find(_live(spark, d), mode, _PROBE).select("key", "value", "hlc", "exact")

    @query(f"find_{_n}_bulk", PR + f"select p.key, l.key as hit_key, l.value as hit_value, l.hlc as hit_hlc, coalesce(l.key = p.key, false) as exact from (select key, (select {_agg}(l.key) from live l where l.key {_op} p.key) as hit from probes p) p left join live l on l.key = p.hit")
    def _bulk(spark, d, mode=_mode):
        return search.find_many(_live(spark, d), logs.probes(spark, d), mode)


@query("find_exact_bulk", PR + "select p.key, l.key as hit_key, l.value as hit_value, l.hlc as hit_hlc, l.key is not null as exact from probes p left join live l on l.key = p.key")
def find_exact_bulk(spark, d):
    return search.find_many(_live(spark, d), logs.probes(spark, d), Mode.EXACT)


_EDGES = ("", "a", "u", "u000010", "u000010x", "u999999", "z")


@query(
    "find_edges",
    EV
    + ", e as (select unnest(['" + "','".join(_EDGES) + "']) as key) "
    + " union all ".join(
        f"select '{n}' as mode, e.key, {agg}(l.key) as hit_key, coalesce({agg}(l.key) = e.key, false) as exact from e left join live l on " + (f"(e.key = '' or l.key {op} e.key)" if agg == "max" else f"l.key {op} e.key") + " group by e.key"
        for n, (_, agg, op) in _MODES.items()
    ),
)
def find_edges(spark, d):
    live = _live(spark, d)
    probes = spark.createDataFrame([(k,) for k in _EDGES], "key string")
    out = None
    for n, (mode, _, _) in _MODES.items():
        one = search.find_many(live, probes, mode).select(F.lit(n).alias("mode"), "key", "hit_key", "exact")
        out = one if out is None else out.unionByName(one)
    return out


@query("find_skip_values", PR + "select p.key, l.key as hit_key, cast(null as varchar) as hit_value, l.hlc as hit_hlc, coalesce(l.key = p.key, false) as exact from (select key, (select min(l.key) from live l where l.key >= p.key) as hit from probes p) p left join live l on l.key = p.hit")
def find_skip_values(spark, d):
    return search.find_many(_live(spark, d), logs.probes(spark, d), Mode.GTE | Mode.SKIP_VALUES)


@query("find_lazy_large", DO + "select key, case when strlen(value) <= 64 then value end as value, strlen(value) > 64 as large, case when strlen(value) > 64 then sha256(value) end as vref, hlc from live")
def find_lazy_large(spark, d):
    return search._columns(visible.live(logs.docs(spark, d)), Mode.GTE | Mode.LAZY_LARGE, None)


@query("find_iterator", EV + f"select row_number() over (order by key desc) as rank, key, value from live where key <= '{_PROBE}'")
def find_iterator(spark, d):
    return ordered.rank(search.find_iterator(_live(spark, d), Mode.LTE, _PROBE), ["key"], descending=True).select("rank", "key", "value")


_P, _Q = "0000000300", "0000000700"


@query("ascend_from", OR + f"select row_number() over (order by key) as rank, key, value from live where key >= '{_P}'")
def ascend_from(spark, d):
    return scan.ascend(visible.live(logs.orders(spark, d)), _P).select("rank", "key", "value")


@query("descend_from", OR + f"select row_number() over (order by key desc) as rank, key, value from live where key <= '{_Q}'")
def descend_from(spark, d):
    return scan.descend(visible.live(logs.orders(spark, d)), _Q).select("rank", "key", "value")


@query("ascend_range", OR + f"select row_number() over (order by key) as rank, key, value from live where key >= '{_P}' and key < '{_Q}'")
def ascend_range(spark, d):
    return scan.ascend_range(visible.live(logs.orders(spark, d)), _P, _Q).select("rank", "key", "value")


@query("descend_range", OR + f"select row_number() over (order by key desc) as rank, key, value from live where key > '{_P}' and key <= '{_Q}'")
def descend_range(spark, d):
    return scan.descend_range(visible.live(logs.orders(spark, d)), _Q, _P).select("rank", "key", "value")


@query("scan_all_desc", OR + "select row_number() over (order by key desc) as rank, key, value from live")
def scan_all_desc(spark, d):
    return scan.descend(visible.live(logs.orders(spark, d))).select("rank", "key", "value")


@query("scan_prefix", PA + "select row_number() over (order by key) as rank, key, cast(strlen(value) as bigint) as n_bytes from live where starts_with(key, 'https://')")
def scan_prefix(spark, d):
    rows = scan.ascend_range(visible.live(logs.pages(spark, d)), "https://", "https:/0")
    return rows.select("rank", "key", scalar.n_bytes(F.col("value")).alias("n_bytes"))


@query("scan_first_n", OR + f"select row_number() over (order by key) as rank, key, value from live where key >= '{_P}' order by key limit 25")
def scan_first_n(spark, d):
    return scan.first_n(visible.live(logs.orders(spark, d)), 25, _P).select("rank", "key", "value")


@query("scan_take_while", OR + f"select key, value from live where key < (select min(key) from live where value = '1-URGENT')")
def scan_take_while(spark, d):
    return scan.take_while(visible.live(logs.orders(spark, d)), F.col("value") != "1-URGENT").select("key", "value")


@query("scan_short_50", OR + ", r as (select *, row_number() over (order by key) as rank from live), s as (select key as probe, rank from r where seq % 10 = 0) select s.probe, cast(r.rank - s.rank as int) as step, r.key, r.value from s join r on r.rank between s.rank and s.rank + 49")
def scan_short_50(spark, d):
    live = files.kept(ordered.rank(visible.live(logs.orders(spark, d)).select("key", "value", "seq"), ["key"]), "ranked")
    return scan.short_scans(live.drop("seq"), live.where("seq % 10 = 0").select("key"), 50).select("probe", F.col("step").cast("int").alias("step"), "key", "value")


@query("iter_next_prev", EV + "select row_number() over (order by key) as rank, key, lag(key) over (order by key) as prev_key, lead(key) over (order by key) as next_key from live")
def iter_next_prev(spark, d):
    return scan.neighbours(_live(spark, d)).select("rank", "key", "prev_key", "next_key")


@query("iter_delete_old", EV + "select key, value from live where hlc >= (select min(hlc) + (max(hlc) - min(hlc)) // 2 from live)")
def iter_delete_old(spark, d):
    """A scan that deletes what is older than the middle of the clock, then what is left."""
    log = logs.events(spark, d)
    live = visible.live(log)
    low, high, last = live.agg(F.min("hlc"), F.max("hlc"), F.max("seq")).first()
    victims = live.where(F.col("hlc") < low + (high - low) // 2)
    ops = mutate.deletes(victims).select("key", "value", "tomb", F.lit(high + 1).alias("hlc"), F.lit(last + 1).alias("seq"))
    return visible.live(log.select("key", "value", "tomb", "hlc", "seq").unionByName(ops)).select("key", "value")


@query("put_overwrite", EV + "select key, count(*) as writes, max(hlc) as last_hlc, min(hlc) as first_hlc from lev where not tomb group by key having count(*) > 1")
def put_overwrite(spark, d):
    return logs.events(spark, d).where("not tomb").groupBy("key").agg(F.count("*").alias("writes"), F.max("hlc").alias("last_hlc"), F.min("hlc").alias("first_hlc")).where("writes > 1")


@query("delete_revive", EV + "select key, count(*) as revived from (select key, tomb, lag(tomb) over (partition by key order by hlc) as before from lev) where before and not tomb group by key")
def delete_revive(spark, d):
    w = Window.partitionBy("key").orderBy("hlc")
    return logs.events(spark, d).withColumn("before", F.lag("tomb").over(w)).where("before and not tomb").groupBy("key").agg(F.count("*").alias("revived"))


@query("nil_vs_empty", EV + "select key, value is null as is_nil, cast(coalesce(strlen(value), 0) as bigint) as n_bytes from live")
def nil_vs_empty(spark, d):
    return _live(spark, d).select("key", F.col("value").isNull().alias("is_nil"), F.coalesce(scalar.n_bytes(F.col("value")), F.lit(0)).alias("n_bytes"))


for _n, (_b, _e) in {"cc": (True, True), "co": (True, False), "oc": (False, True), "oo": (False, False)}.items():

    @query(f"delete_range_{_n}", OR + f"select key, value from live where not (key {'>=' if _b else '>'} '{_P}' and key {'<=' if _e else '<'} '{_Q}')")
    def _deleted(spark, d, b=_b, e=_e):
        live = visible.live(logs.orders(spark, d))
        gone = mutate.delete_range(live, _P, _Q, b, e)
        return live.join(gone.select("key"), "key", "left_anti").select("key", "value")


@query("delete_range_skip_large", DO + "select key, cast(strlen(value) as bigint) as n_bytes from live where strlen(value) > 64 or not (key >= 'src1' and key <= 'src3') or value is null and not (key >= 'src1' and key <= 'src3')")
def delete_range_skip_large(spark, d):
    live = visible.live(logs.docs(spark, d))
    gone = mutate.delete_range(live, "src1", "src3", True, True, include_large=False)
    return live.join(gone.select("key"), "key", "left_anti").select("key", scalar.n_bytes(F.col("value")).alias("n_bytes"))


@query("delete_many_ranges", OR + ", r as (select printf('%010d', s_suppkey * 40) as b, printf('%010d', s_suppkey * 40 + s_suppkey % 30) as e from supplier) select key from live where not exists (select 1 from r where key >= b and key < e)")
def delete_many_ranges(spark, d):
    live = visible.live(logs.orders(spark, d))
    s = F.col("s_suppkey")
    ranges = logs.table(spark, d, "supplier").select(logs.numbered("", s * 40, 10).alias("begin"), logs.numbered("", s * 40 + s % 30, 10).alias("end"))
    return live.join(mutate.delete_ranges(live, ranges).select("key"), "key", "left_anti").select("key")


@query("clear_small", DO + "select key, cast(strlen(value) as bigint) as n_bytes from live where strlen(value) > 64")
def clear_small(spark, d):
    live = visible.live(logs.docs(spark, d))
    return live.join(mutate.clear(live, False).select("key"), "key", "left_anti").select("key", scalar.n_bytes(F.col("value")).alias("n_bytes"))


@query("merge_sum", EV + "select key, cast(sum(amount) as bigint) as total, count(*) as n from (select *, max(case when tomb then seq end) over (partition by key) as cut from lev) where not tomb and (cut is null or seq > cut) group by key")
def merge_sum(spark, d):
    return mutate.merge_sum(logs.events(spark, d).select("key", "seq", "amount", "tomb"))


@query(
    "merge_conditional",
    O.with_(O.EVENTS.strip(), "o as (select key, amount, tomb, row_number() over (partition by key order by seq) as n from lev), f as (select key, n, case when tomb then null else amount end as acc from o where n = 1 union all select o.key, o.n, case when o.tomb then null when f.acc is null or o.amount > f.acc then o.amount else f.acc end from f join o on o.key = f.key and o.n = f.n + 1)", recursive=True)
    + "select key, acc as best from f qualify row_number() over (partition by key order by n desc) = 1",
)
def merge_conditional(spark, d):
    """Keep the larger of old and new; a delete forgets."""
    step = lambda acc, op: F.when(op["tomb"], F.lit(None).cast("long")).when(acc.isNull() | (op["amount"] > acc), op["amount"]).otherwise(acc)
    return mutate.merge_fold(logs.events(spark, d).select("key", "seq", "amount", "tomb"), F.lit(None).cast("long"), step).select("key", F.col("acc").alias("best"))


@query("merge_delete", EV + "select key, value from live where value is not null and strlen(value) % 2 = 0")
def merge_delete(spark, d):
    """A merge that deletes nil values and values of odd length and leaves the others, by a Python function."""
    live = _live(spark, d)
    ops = mutate.merge_with(live, live.select("key"), lambda old, exists: (None, False, old is None or len(old.encode()) % 2 == 1))
    return live.join(ops.where("tomb").select("key"), "key", "left_anti").select("key", "value")


@query("batch_last_wins", O.with_(O.LINE) + "select batch_id, key, value, pos from ops qualify row_number() over (partition by batch_id, key order by pos desc) = 1")
def batch_last_wins(spark, d):
    return batch.last_wins(logs.line(spark, d)).select("batch_id", "key", "value", "pos")


_SUB = O.with_(
    O.LINE.strip(),
    """o as (select *, row_number() over (partition by batch_id order by pos) as n from ops),
p as (select *, coalesce(lag(n) over (partition by batch_id, key order by n), 0) as p from o),
nx as (select batch_id, n, p, min(n) filter (p > 0) over (partition by batch_id order by n rows between 1 following and unbounded following) as nextdup from p),
st as (select batch_id, cast(1 as bigint) as s from (select distinct batch_id from p) union all select st.batch_id, (select min(p.n) from p where p.batch_id = st.batch_id and p.p >= st.s) as s from st where (select min(p.n) from p where p.batch_id = st.batch_id and p.p >= st.s) is not null)""",
    recursive=True,
)


@query("batch_sub_batches", _SUB + "select p.batch_id, p.pos, p.key, (select count(*) from st where st.batch_id = p.batch_id and st.s <= p.n) - 1 as sub_batch from p")
def batch_sub_batches(spark, d):
    ops = files.kept(logs.line(spark, d).select("batch_id", "pos", "key"), "ops")
    return batch.sub_batches(ops).select("batch_id", "pos", "key", "sub_batch")


@query("batch_hlc_interval", _SUB + ", t as (select batch_id, s, row_number() over (order by batch_id, s) as i, ((batch_id + 1) * 65536000) as pt from st), h as (select batch_id, i + max(pt - i) over (order by i) as hlc from t) select batch_id, min(hlc) as begin, max(hlc) + 1 as endx from h group by batch_id")
def batch_hlc_interval(spark, d):
    ops = files.kept(logs.line(spark, d).select("batch_id", "pos", "key"), "ops")
    ops = batch.sub_batches(ops).withColumn("pt", (F.col("batch_id") + 1) * 65536000)
    return batch.intervals(batch.ticks(ops, "pt", start=0))


@query("hlc_local", O.with_("e as (select event_id, row_number() over (order by event_id) as n, ((epoch_us(ts) * 1000 + 65535) // 65536) * 65536 as pt from events), f as (select event_id, n, pt as hlc from e where n = 1 union all select e.event_id, e.n, greatest(e.pt, f.hlc + 1) from f join e on e.n = f.n + 1)", recursive=True) + "select event_id, hlc from f")
def hlc_local(spark, d):
    e = logs.table(spark, d, "events").select("event_id", clock.physical(clock.micros(F.col("ts"))).alias("pt"))
    return clock.stamp(e, "event_id", "pt").select("event_id", "hlc")


@query("hlc_receive", O.with_("e as (select event_id, row_number() over (order by event_id) as n, ((epoch_us(ts) * 1000 + 65535) // 65536) * 65536 as pt, case when event_type = 'click' then (epoch_us(ts) + user_id * 1000000) * 1000 end as m from events), f as (select event_id, n, greatest(pt, coalesce(m + 1, pt)) as hlc from e where n = 1 union all select e.event_id, e.n, greatest(e.pt, f.hlc + 1, coalesce(e.m + 1, e.pt)) from f join e on e.n = f.n + 1)", recursive=True) + "select event_id, hlc from f")
def hlc_receive(spark, d):
    us = clock.micros(F.col("ts"))
    e = logs.table(spark, d, "events").select("event_id", clock.physical(us).alias("pt"), F.when(F.col("event_type") == "click", (us + F.col("user_id") * 1000000) * 1000).alias("m"))
    return clock.stamp(e, "event_id", "pt", received="m").select("event_id", "hlc")


@query("hlc_decode", EV + "select seq, hlc - hlc % 65536 as pt, hlc % 65536 as lc, make_timestamp(hlc // 1000) as at from lev")
def hlc_decode(spark, d):
    h = F.col("hlc")
    return logs.events(spark, d).select("seq", clock.logical_time(h).alias("pt"), clock.counter(h).alias("lc"), clock.to_timestamp(h).cast("timestamp_ntz").alias("at"))


@query("vlog_split", DO + "select vref, count(*) as refs, any_value(n_bytes) as n_bytes from (select sha256(value) as vref, cast(strlen(value) as bigint) as n_bytes from live where strlen(value) > 64) group by vref")
def vlog_split(spark, d):
    slim, store = values.split(visible.live(logs.docs(spark, d)))
    refs = slim.where("vref is not null").groupBy("vref").agg(F.count("*").alias("refs"))
    return store.join(refs, "vref").select("vref", "refs", "n_bytes")


@query("vlog_dedup", O.with_("w as (select coalesce(source, '') as key, text as value, doc_id as seq from documents)") + "select seq, key, sha256(value) as vref, coalesce(sha256(value) = lag(case when strlen(value) > 64 then sha256(value) end) over (partition by key order by seq), false) as reused from w qualify strlen(value) > 64")
def vlog_dedup(spark, d):
    log = logs.docs(spark, d).withColumn("key", F.split("key", "/")[0])
    return values.rewrites(log).select("seq", "key", "vref", "reused")


@query("vlog_resolve", DO + "select key, sha256(value) as digest, hlc from live")
def vlog_resolve(spark, d):
    slim, store = values.split(visible.live(logs.docs(spark, d)))
    return values.resolve(slim, store).select("key", scalar.digest(F.col("value")).alias("digest"), "hlc")


@query("vacuum_vlog_stats", DO + ", v as (select sha256(value) as h, cast(any_value(strlen(value)) as bigint) + 56 as n, bool_or(seq % 3 <> 0) as used from live where strlen(value) > 64 group by 1) select cast(sum(n) as bigint) as old_bytes, cast(sum(n) filter (used) as bigint) as new_bytes, cast(sum(n) filter (not used) as bigint) as reclaimed_bytes, count(*) filter (used) as entries_kept, count(*) filter (not used) as entries_dropped from v")
def vacuum_vlog_stats(spark, d):
    """What a vacuum frees after every third document has been deleted."""
    slim, store = values.split(visible.live(logs.docs(spark, d)))
    return values.vacuum_stats(store, slim.where("seq % 3 <> 0"))


@query("write_amp", EV + ", b as (select case when tomb then 0 else coalesce(strlen(value), 0) end as v, strlen(key) as k, tomb, value from lev) select count(*) as writes, cast(sum(k + coalesce(strlen(value), 0)) as bigint) as logical_bytes, sum(1 + case when tomb or v > 64 then 10 else 1 end + k + case when tomb or v > 64 then 16 else v end + 12 + case when strlen(value) > 64 then strlen(value) + 56 else 0 end) / sum(k + coalesce(strlen(value), 0)) as write_amp from b")
def write_amp(spark, d):
    return metrics.written(logs.events(spark, d)).select("writes", "logical_bytes", "write_amp")


@query("compact_stats", EV + ", b as (select 1 + case when tomb then 10 else 1 end + strlen(key) + case when tomb then 16 else coalesce(strlen(value), 0) end + 12 as n from lev), c as (select 1 + 1 + strlen(key) + coalesce(strlen(value), 0) + 12 as n from live) select (select count(*) from lev) as old_records, cast((select sum(n) from b) as bigint) as old_bytes, (select count(*) from live) as new_records, cast((select sum(n) from c) as bigint) as new_bytes, cast((select sum(n) from b) - (select sum(n) from c) as bigint) as reclaimed_bytes")
def compact_stats(spark, d):
    return metrics.compaction(logs.events(spark, d))


_CUTS = O.with_(O.EVENTS) + ", c as (select max(event_id) as m from events), a as (select key, value, hlc from lev, c where seq <= m // 2 qualify row_number() over (partition by key order by hlc desc) = 1 and not tomb), b as (select key, value, hlc from lev qualify row_number() over (partition by key order by hlc desc) = 1 and not tomb)"


def _two(spark, d):
    log = logs.events(spark, d)
    half = logs.table(spark, d, "events").agg(F.expr("max(event_id) div 2")).first()[0]
    return visible.live(log, half), visible.live(log)


@query("diff_full", _CUTS + " select key, a.value as a_value, b.value as b_value, case when b.hlc is null then 'removed' when a.hlc is null then 'added' when a.value is distinct from b.value then 'changed' else 'touched' end as kind from a full join b using (key) where a.hlc is null or b.hlc is null or a.hlc <> b.hlc or a.value is distinct from b.value")
def diff_full(spark, d):
    return diff.full(*_two(spark, d)).select("key", "a_value", "b_value", "kind")


@query("diff_first", _CUTS + ", x as (select *, row_number() over (order by key) as rank from a), y as (select *, row_number() over (order by key) as rank from b) select rank, case when x.key <> y.key then 'key' when x.value is distinct from y.value then 'value' else 'hlc' end as what, x.key as a_key, y.key as b_key from x join y using (rank) where x.key <> y.key or x.value is distinct from y.value or x.hlc <> y.hlc order by rank limit 1")
def diff_first(spark, d):
    return diff.first(*_two(spark, d))


@query("merge_two_sources", O.with_(O.EVENTS) + ", c as (select max(event_id) as m from events), s as (select * from lev, c where seq <= m // 2 qualify row_number() over (partition by key order by hlc desc) = 1), t as (select * from lev, c where seq > m // 2 qualify row_number() over (partition by key order by hlc desc) = 1) select coalesce(t.key, s.key) as key, case when t.key is not null then t.value else s.value end as value from t full join s on t.key = s.key where not case when t.key is not null then t.tomb else s.tomb end")
def merge_two_sources(spark, d):
    log = logs.events(spark, d)
    half = logs.table(spark, d, "events").agg(F.expr("max(event_id) div 2")).first()[0]
    old, new = visible.latest(log, half), visible.latest(log.where(F.col("seq") > half))
    return visible.union_by_precedence(new, old).where("not tomb").select("key", "value")


EX = O.with_(O.EXTENTS)


def _extents(spark, d):
    """The extents as files: finding their order needs every line to be sorted, once."""
    return files.kept(logs.extents(spark, d), "extents")


@query("extent_place", EX + "select ord, loff, len, poff from pl")
def extent_place(spark, d):
    return extents.placed(_extents(spark, d)).select("ord", "loff", "len", "poff")


@query("extent_insert", EX + ", p as (select ord * 4 as k, least(len, 1003 - loff) as len, poff from pl where loff < 1003 union all select ord * 4 + 2, len - greatest(0, 1003 - loff), poff + greatest(0, 1003 - loff) from pl where loff + len > 1003 union all select (select min(ord) * 4 + 1 from pl where loff + len > 1003), 500, 77) select row_number() over (order by k) as ord, cast(len as bigint) as len, cast(poff as bigint) as poff from p")
def extent_insert(spark, d):
    return extents.insert(_extents(spark, d), 1003, 77, 500).select("ord", "len", "poff")


@query("extent_delete", EX + ", p as (select ord * 4 as k, least(len, 1003 - loff) as len, poff from pl where loff < 1003 union all select ord * 4 + 1, loff + len - greatest(loff, 1710), poff + greatest(loff, 1710) - loff from pl where loff + len > 1710) select row_number() over (order by k) as ord, cast(len as bigint) as len, cast(poff as bigint) as poff from p where len > 0")
def extent_delete(spark, d):
    return extents.delete(_extents(spark, d), 1003, 707).select("ord", "len", "poff")


@query("extent_query", EX + "select ord, poff + greatest(loff, 5000) - loff as poff, least(loff + len, 9001) - greatest(loff, 5000) as len from pl where loff < 9001 and loff + len > 5000")
def extent_query(spark, d):
    return extents.query(_extents(spark, d), 5000, 4001)


@query("extent_pquery", EX + ", q as (select c_custkey * 997 as loff from customer) select q.loff, coalesce(pl.poff + q.loff - pl.loff, -1) as poff from q left join pl on pl.loff <= q.loff and q.loff < pl.loff + pl.len")
def extent_pquery(spark, d):
    return extents.locate(_extents(spark, d), logs.table(spark, d, "customer").select((F.col("c_custkey") * 997).alias("loff")))


@query("extent_tags", EX + ", p as (select ord * 4 as k, least(len, 2222 - loff) as len, poff, 0 as tag from pl where loff < 2222 union all select ord * 4 + 1, len - greatest(0, 2222 - loff), poff + greatest(0, 2222 - loff), case when loff <= 2222 then 9 else 0 end from pl where loff + len > 2222) select row_number() over (order by k) as ord, cast(len as bigint) as len, cast(poff as bigint) as poff, tag from p where len > 0")
def extent_tags(spark, d):
    return extents.set_tag(_extents(spark, d), 2222, 9).select("ord", "len", "poff", "tag")


@query("extent_merge", EX + ", t as (select len, (ord - 1) // 5 as run, row_number() over (order by ord) as ord from ex), m as (select run, ord, cast(sum(len) over (partition by run order by ord) as bigint) as upto, len from t), g as (select run, (upto - 1) // 60 as grp, cast(sum(len) as bigint) as len, count(*) as parts, cast(min(upto - len) as bigint) as lo from m group by all) select cast(run * 1000000000 + lo as bigint) as poff, len, parts from g")
def extent_merge(spark, d):
    """Extents of five continue each other in both spaces: runs of five, in pieces of at most 60 bytes by where their bytes fall.

    Runs lie 64 KB apart, as an address has 47 bits; the result numbers them as the statement does, a billion apart.
    """
    e = _extents(spark, d)
    run = F.floor((F.col("ord") - 1) / 5)
    before = F.coalesce(F.sum("len").over(Window.partitionBy(run).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    touching = e.withColumn("poff", F.shiftleft(run, 16) + before).withColumn("tag", F.lit(0))
    at = F.col("poff")
    return extents.merged(files.kept(touching, "touching"), 60).select((F.shiftright(at, 16) * 1_000_000_000 + at.bitwiseAND(F.lit(65535))).alias("poff"), "len", "parts")


@query("block_usage", EX + "select poff // 4194304 as block, cast(sum(len) as bigint) as live_bytes from ex group by 1")
def block_usage(spark, d):
    return metrics.block_usage(logs.extents(spark, d, placed=False))


@query("block_histogram", EX + "select b // 65536 as bucket, count(*) as blocks from (select cast(sum(len) as bigint) as b from ex group by poff // 4194304) group by 1")
def block_histogram(spark, d):
    return metrics.usage_histogram(logs.extents(spark, d, placed=False))


@query("garbage_metrics", EX + ", b as (select cast(sum(len) as bigint) as n from ex group by poff // 4194304) select cast(sum(n) as bigint) as live_bytes, cast(sum(4194304 - n) as bigint) as garbage_bytes, count(*) as blocks_in_use, count(*) filter (n < 2097152) as blocks_under from b")
def garbage_metrics(spark, d):
    return metrics.garbage(logs.extents(spark, d, placed=False))


@query("gc_victims", EX + ", b as (select poff // 4194304 as block, cast(sum(len) * 1000 as bigint) as live_bytes from ex group by 1) select block, live_bytes, cast(case when live_bytes < 524288 then 1 when live_bytes < 1048576 then 2 when live_bytes < 2097152 then 3 else 4 end as int) as round from b where live_bytes < 4194304 - 262144")
def gc_victims(spark, d):
    return metrics.gc_victims(logs.extents(spark, d, placed=False).withColumn("len", F.col("len") * 1000))


@query("space_read_frag", EX + ", q as (select c_custkey as id, c_custkey * 797 as loff, 100 + c_custkey % 400 as length from customer) select id, count(*) as pieces, any_value(length) as bytes from q join pl on pl.loff < q.loff + q.length and pl.loff + pl.len > q.loff where q.loff + q.length <= (select sum(len) from ex) group by id")
def space_read_frag(spark, d):
    c = F.col("c_custkey")
    return extents.fragments(_extents(spark, d), logs.table(spark, d, "customer").select(c.alias("id"), (c * 797).alias("loff"), (100 + c % 400).alias("length")))


#: The customers' names end to end, as hexadecimal digits, and a space's content in rows of 64 bytes.
SP = "with h as (select hex(encode(string_agg(c_name, '' order by c_custkey))) as h from customer), "
WIDE = " select unnest(range(0, cast(ceil(length(h) / 128) as bigint))) as id, unnest(list_transform(range(0, cast(ceil(length(h) / 128) as bigint)), lambda i: substr(h, cast(i * 128 + 1 as bigint), 128))) as bytes from f"


def _space(spark, d):
    return _kept(space.Space.empty(spark).append(logs.table(spark, d, "customer"), "c_custkey", "c_name"))


def _kept(s):
    """The space as files, so that what follows doesn't plan or run its history again."""
    return s.save(files.folder(s.extents.sparkSession, "space"))


def _content(s):
    return s.content(64).select("id", F.hex("data").alias("bytes"))


@query("space_append", SP + "f as (select h from h)" + WIDE)
def space_append(spark, d):
    return _content(_space(spark, d))


@query("space_insert", SP + "f as (select substr(h, 1, 2006) || repeat('6162', 400) || substr(h, 2007) as h from h)" + WIDE)
def space_insert(spark, d):
    return _content(_kept(_space(spark, d).insert(1003, b"ab" * 400)))


@query("space_collapse", SP + "f as (select substr(h, 1, 1000) || substr(h, 2409) as h from h)" + WIDE)
def space_collapse(spark, d):
    return _content(_kept(_space(spark, d).collapse(500, 704)))


@query("space_write", SP + "f as (select substr(h, 1, 14) || repeat('78', 40) || substr(h, 95, length(h) - 100) || repeat('79', 10) || repeat('7A', 5) as h from h)" + WIDE)
def space_write(spark, d):
    """Inside, over the end, and at the end."""
    s = _kept(_space(spark, d).write(7, b"x" * 40))
    s = _kept(s.write(s.size() - 3, b"y" * 10))
    return _content(_kept(s.write(s.size(), b"z" * 5)))


@query("space_update", SP + "f as (select substr(h, 1, 36) || repeat('75', 50) || substr(h, 55) as h from h)" + WIDE.replace(" as bytes", " as bytes, 18 as tag_at, 5 as tag"))
def space_update(spark, d):
    """The second name by fifty bytes; the tag stays at its place."""
    s = _kept(_kept(_space(spark, d).set_tag(18, 5)).update(18, b"u" * 50, 9))
    tagged = extents.placed(s.extents).where("tag <> 0").agg(F.first("loff").cast("int").alias("tag_at"), F.first("tag").alias("tag"))
    return _content(s).crossJoin(tagged)  # one row


@query("space_overwrite", SP + "f as (select substr(h, 1, 200) || repeat('6F', 77) || substr(h, 355) as h from h)" + WIDE)
def space_overwrite(spark, d):
    return _content(_kept(_space(spark, d).overwrite(100, b"o" * 77)))


@query("space_allocate_truncate", SP + "f as (select substr(substr(h, 1, 20) || repeat('00', 300) || substr(h, 21), 1, 2000) as h from h)" + WIDE)
def space_allocate_truncate(spark, d):
    return _content(_kept(_kept(_space(spark, d).allocate(10, 300)).truncate(1000)).truncate(5000))


@query("space_defrag", SP + "f as (select h from h)" + WIDE.replace(" as bytes", " as bytes, cast(1 as bigint) as pieces") + " where length(h) > 2000")
def space_defrag(spark, d):
    """A range's bytes stay and come to lie in one piece (here: read in one)."""
    s = _kept(_space(spark, d).defrag(90, 900))
    one = s.read_many(spark.createDataFrame([(0, 90, 900)], "id int, loff long, length long")).select("pieces")
    return _content(s).crossJoin(one)  # one row


@query("space_gc", SP + "f as (select substr(h, 1, 200) || substr(h, 401) as h from h)" + WIDE.replace(" as bytes", " as bytes, true as moved"))
def space_gc(spark, d):
    """Every block is nearly empty: all extents move behind the old end, and the content stays."""
    s = _kept(_space(spark, d).collapse(100, 100))
    g = _kept(s.collect_garbage())
    return _content(g).crossJoin(g.extents.agg((F.min("poff") >= s.end).alias("moved")))  # one row


@query("space_read_many", SP + "q as (select c_custkey as id, c_custkey * 7 as loff, c_custkey % 90 as n from customer) select id, substr(h, cast(2 * loff + 1 as bigint), cast(2 * n as bigint)) as bytes from q, h where 2 * (loff + n) <= length(h)")
def space_read_many(spark, d):
    c = F.col("c_custkey")
    got = _space(spark, d).read_many(logs.table(spark, d, "customer").select(c.alias("id"), (c * 7).alias("loff"), (c % 90).alias("length")))
    return got.select("id", F.hex("data").alias("bytes"))


@query("space_cursor", "with e as (select cast(sum(strlen(c_name)) over (order by c_custkey) as bigint) as next, strlen(c_name) as n from customer), q as (select c_custkey * 20 as loff from customer) select q.loff, e.next is not null as valid, e.next - n as at, q.loff - e.next + n as diff, case when e.next is not null then q.loff end as poff, e.next as next from q left join e on q.loff < e.next and q.loff >= e.next - n")
def space_cursor(spark, d):
    return _space(spark, d).positions(logs.table(spark, d, "customer").select((F.col("c_custkey") * 20).alias("loff"))).drop("tag")


@query("space_usage_check", SP + "b as (select cast(length(h) // 2 as bigint) as n from h) select 'block_usage' as \"check\", '0' as detail, false as fatal from b where n > 10 union all select 'extent_total', cast(n - 10 as varchar), false from b where n > 10")
def space_usage_check(spark, d):
    """Tracked usage and size from before a collapse differ from what the mapping now says."""
    s = _space(spark, d)
    tracked = metrics.block_usage(s.extents)
    return s.collapse(20, 10).integrity(tracked, s.size())


@query("extent_pdelete", EX + ", p as (select ord * 4 as k, least(len, 1003 - loff) as len, poff from pl where loff < 1003 union all select ord * 4 + 1, loff + len - greatest(loff, 1004), poff + greatest(loff, 1004) - loff from pl where loff + len > 1004) select row_number() over (order by k) as ord, cast(len as bigint) as len, cast(poff as bigint) as poff from p where len > 0")
def extent_pdelete(spark, d):
    return extents.delete_byte(_extents(spark, d), 1003).select("ord", "len", "poff")


@query("extent_tree_diff", EX + ", y as (select ord, case when ord % 100 = 0 then len + 1 else len end as len, poff from ex), py as (select cast(sum(len) over (order by ord) - len as bigint) as loff, len, poff from y), px as (select loff, len, poff from pl) select 'a' as side, * from (select * from px except all select * from py) union all select 'b', * from (select * from py except all select * from px)")
def extent_tree_diff(spark, d):
    e = _extents(spark, d)
    longer = e.withColumn("len", F.col("len") + (F.col("ord") % 100 == 0).cast("long"))
    return space.difference(e, longer).drop("tag")


@query("key_fingerprint", EV + ", c as (select distinct key from lev), x as (select key, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, strlen(key) + 1), lambda i: cast(ascii(substr(key, i, 1)) as bigint))), lambda c, b: list_reduce(list_prepend(xor(c, b), [cast(0 as bigint) for z in range(8)]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 2197175160) else v >> 1 end)), cast(4294967295 as bigint)) as crc from c) select key, crc, greatest(xor(crc & 65535, crc >> 16), 1) as fingerprint, greatest(xor(crc & 65535, crc >> 16), 1) & 1023 as part from x")
def key_fingerprint(spark, d):
    rows = logs.events(spark, d).select("key").distinct().withColumn("crc", scalar.crc32c(F.col("key")))
    mark = scalar.fingerprint(F.col("crc"))
    return rows.select("key", "crc", mark.alias("fingerprint"), scalar.partition(mark).alias("part"))


@query("extent_sequences")
def extent_sequences(spark, d):
    """Operation sequences on many trees, one for each supplier; a Python list oracle covers it in the tests."""
    l = logs.table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(*[c for c in logs.LINE])
    pos = F.row_number().over(w)
    kind = F.when(F.col("l_linenumber") % 5 == 4, "delete").when(F.col("l_linenumber") % 5 == 3, "tag").otherwise("insert")
    q = F.col("l_quantity").cast("long")
    ops = l.withColumn("pos", pos.cast("long")).select(F.col("l_suppkey").alias("tree"), "pos", kind.alias("op"), (F.col("l_partkey") % F.greatest(F.col("pos") * 4, F.lit(1))).alias("loff"), (F.col("l_partkey") * 4096).alias("poff"), q.alias("len"), F.when(F.col("l_linenumber") % 5 == 3, 7).otherwise(0).alias("tag"))
    return extents.apply(ops)


for _m in workload.MIXES:
    _case = " ".join(f"when roll < {sum(list(workload.MIXES[_m].values())[: _i + 1])} then '{_op}'" for _i, _op in enumerate(workload.MIXES[_m]))

    @query(
        f"ycsb_{_m}",
        OR
        + f", o as (select l_linenumber, l_orderkey * 10 + l_linenumber as op_id, printf('%010d', l_partkey * 9) as key from lineitem), w as (select key, (op_id * 7919) % 100 as roll from o), x as (select key, case {_case} end as op from w), r as (select key, row_number() over (order by key) as rank from live) select op, count(*) as n, count(*) filter (ok) as ok from (select x.op, case when op = 'get' then exists (select 1 from live l where l.key = x.key) when op = 'scan' then coalesce((select min(rank) from r where r.key >= x.key) + 50 <= (select count(*) from live), false) else true end as ok from x) group by op"
        if _m != "e"
        else OR
        + f", o as (select l_orderkey * 10 + l_linenumber as op_id, printf('%010d', l_partkey * 9) as key from lineitem), w as (select key, (op_id * 7919) % 100 as roll from o), x as (select key, case {_case} end as op from w), r as (select key, row_number() over (order by key) as rank from live), k as (select distinct key from x), s as (select k.key, min(r.rank) as rank from k left join r on r.key >= k.key group by k.key) select op, count(*) as n, count(*) filter (ok) as ok from (select x.op, case when op = 'scan' then coalesce(s.rank + 50 <= (select count(*) from live), false) else true end as ok from x join s using (key)) group by op",
    )
    def _ycsb(spark, d, mix=_m):
        l = logs.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op_id"), logs.numbered("", F.col("l_partkey") * 9, 10).alias("key"))
        return workload.run_mix(visible.live(logs.orders(spark, d)), workload.drawn(l, mix))


@query("latency_cdf", "with b as (select least(cast(floor(value * 40) as bigint), 10000) as bucket, count(*) as n from events group by 1) select bucket, n, cast(sum(n) over (order by bucket) as bigint) as cum, round(100.0 * sum(n) over (order by bucket) / sum(n) over (), 6) as pct from b")
def latency_cdf(spark, d):
    return metrics.latency_cdf(logs.table(spark, d, "events").select((F.col("value") * 40).alias("us")), "us")


@query("hexkey", "select o_orderkey, rpad(lpad(lower(to_hex(o_orderkey)), 16, '0'), 27, '!') as key27, lpad(lower(to_hex(o_orderkey)), 16, '0') as key8 from orders")
def hexkey(spark, d):
    n = F.col("o_orderkey")
    return logs.table(spark, d, "orders").select("o_orderkey", scalar.hex_key(n, 27).alias("key27"), scalar.hex_key(n, 8).alias("key8"))


@query("underscore_format", "select o_orderkey, replace(format('{:,}', o_orderkey * 12345), ',', '_') as text from orders")
def underscore_format(spark, d):
    return logs.table(spark, d, "orders").select("o_orderkey", scalar.underscored(F.col("o_orderkey") * 12345).alias("text"))


@query("kv128_size", DO + "select key, cast(1 + case when value is null then 1 when strlen(value) > 64 then 10 when strlen(value) + 2 > 127 then 2 else 1 end + strlen(key) + case when value is null then 0 when strlen(value) > 64 then 16 else strlen(value) end + 12 as bigint) as n_bytes, cast(24 + strlen(key) + coalesce(strlen(value), 0) as bigint) as approximate from live")
def kv128_size(spark, d):
    k, v = F.col("key"), F.col("value")
    return visible.live(logs.docs(spark, d)).select("key", scalar.record_bytes(k, v, F.lit(False)).alias("n_bytes"), scalar.approximate_bytes(k, v).alias("approximate"))


@query("text_dump", EV + "select row_number() over (order by key) as rank, case when value is null then key else key || ' ::: ' || value end as line from live")
def text_dump(spark, d):
    return text.dump(_live(spark, d))


@query("text_dump_keys", DO + "select row_number() over (order by key) as rank, key, cast(coalesce(strlen(value), 0) as bigint) as n_bytes, sha256(coalesce(value, '')) as digest from live")
def text_dump_keys(spark, d):
    return text.dump_keys(visible.live(logs.docs(spark, d)))


@query("text_trailer", EV + "select count(*) as n, cast(coalesce(sum(strlen(key)), 0) as bigint) as key_bytes, cast(coalesce(sum(strlen(value)), 0) as bigint) as value_bytes from live")
def text_trailer(spark, d):
    return text.trailer(_live(spark, d))


def _stored(spark, d):
    from .sources.store import Database

    db = Database.open(spark, files.folder(spark, "store"))
    db.put_all(visible.live(logs.docs(spark, d)).select("key", "value"))
    return db


@query("store_round_trip", DO + "select key, sha256(value) as digest from live where seq % 7 <> 0")
def store_round_trip(spark, d):
    """Written, partly deleted, compacted, read back."""
    db = _stored(spark, d)
    db.apply(mutate.deletes(logs.docs(spark, d).where("seq % 7 = 0")))
    db.sync()
    return db.at().full().select("key", scalar.digest(F.col("value")).alias("digest"))


@query("store_old_version", DO + "select key, sha256(value) as digest from live")
def store_old_version(spark, d):
    """What version 1 shows after later commits."""
    db = _stored(spark, d)
    db.apply(mutate.deletes(logs.docs(spark, d).where("seq % 7 = 0")))
    return db.at(1).full().select("key", scalar.digest(F.col("value")).alias("digest"))


@query("integrity_clean", "select 'x' as \"check\", 'x' as detail, false as fatal where false")
def integrity_clean(spark, d):
    db = _stored(spark, d)
    db.sync()
    return db.integrity()


@query("integrity_corrupt", DO + "select 'resolved_values' as \"check\", h as detail, true as fatal from (select sha256(value) as h, min(seq) as s from live where strlen(value) > 64 group by 1) where s % 5 = 0")
def integrity_corrupt(spark, d):
    """Values whose first document's number divides by five are lost; the check names each."""
    live = visible.live(logs.docs(spark, d))
    slim, store = values.split(live)
    first = live.where(scalar.is_large(F.col("value"))).groupBy(scalar.digest(F.col("value")).alias("vref")).agg(F.min("seq").alias("s"))
    left = store.join(first.where("s % 5 = 0"), "vref", "left_anti")
    return metrics.integrity(slim.select("key", "value", F.lit(False).alias("tomb"), "vref"), left)


@query("stream_upsert", EV + "select key, value, hlc, seq from live")
def stream_upsert(spark, d):
    """The events log in eight files through the stateful stream, drained, then the newest row of each key."""
    from .streaming import feed

    folder = files.folder(spark, "stream")
    log = logs.events(spark, d).select("seq", "key", "value", "tomb", "hlc")
    log.repartition(8, "seq").write.mode("overwrite").parquet(f"{folder}/log")
    name = f"upserts_{uuid.uuid4().hex}"
    stream = feed.read(spark, f"{folder}/log", 2)
    q = feed.upserts(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{folder}/{name}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return visible.live(spark.read.parquet(f"{folder}/{name}")).select("key", "value", "hlc", "seq")


__all__ = ["ORACLES", "QUERIES"]
