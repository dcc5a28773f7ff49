"""DuckDB pieces that the queries' SQL shares: op-logs and what is visible of them."""

EVENTS = """
ev as (select event_id as seq, printf('u%06d', user_id) as key, case when event_type in ('error','view') then null else props end as value,
  event_type = 'error' as tomb, ((epoch_us(ts) * 1000 + 65535) // 65536) * 65536 as pt, cast(floor(value * 100) as bigint) as amount,
  row_number() over (order by event_id) as i from events),
lev as (select seq, key, value, tomb, amount, i + max(pt - i) over (order by i) as hlc from ev),
live as (select key, value, hlc, seq from lev qualify row_number() over (partition by key order by hlc desc, seq desc) = 1 and not tomb)"""


def _plain(source: str) -> str:
    return f"""
ev as (select *, row_number() over (order by seq) as i, ((seq * 1000000 + 65535) // 65536) * 65536 as pt from ({source})),
lev as (select seq, key, value, false as tomb, i + max(pt - i) over (order by i) as hlc from ev),
live as (select key, value, hlc, seq from lev qualify row_number() over (partition by key order by hlc desc, seq desc) = 1)"""


DOCS = _plain("select doc_id as seq, coalesce(source, '') || '/' || printf('%08d', doc_id) as key, text as value from documents")
ORDERS = _plain("select o_orderkey as seq, printf('%010d', o_orderkey) as key, o_orderpriority as value from orders")
PAGES = _plain("select page_id as seq, url as key, html as value from pages")
LINE = """
ln as (select *, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq from lineitem),
ops as (select l_orderkey % 97 as batch_id, seq as pos, seq, printf('%08d', l_orderkey) || '/' || l_linenumber as key, l_returnflag as value from ln)"""
EXTENTS = """
ln as (select *, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as ord from lineitem),
ex as (select ord, cast(l_quantity as bigint) as len, l_partkey * 4096 as poff from ln),
pl as (select *, cast(sum(len) over (order by ord) - len as bigint) as loff from ex)"""
PROBES = "probes as (select printf('u%06d', c_custkey) as key from customer)"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} "
