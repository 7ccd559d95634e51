"""Named queries over the driver's tables, with the SQL that gives the same rows.

Typed tables are queried as they are. `lines_*` queries render `events` as log lines first (JSON lines, logfmt or
access-log text) and read them back, so they go through the line sources and dynamically typed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import query
from .sources.lines import LogLines, from_lines
from .sources.tables import from_parquet

#: name: (table, query text, SQL)
TABLE_QUERIES: dict[str, tuple[str, str, str]] = {
    "project": ("events", "select event_id, event_type, value", "select event_id, event_type, value from events"),
    "select_star": ("nation", "select *", "select * from nation"),
    "filter_and": ("events", 'select event_id, value where event_type = "error" and value > 100', "select event_id, value from events where event_type = 'error' and value > 100"),
    "filter_or": ("events", 'select event_id where event_type = "error" or value > 200', "select event_id from events where event_type = 'error' or value > 200"),
    "not_cmp": ("events", "select event_id where not value > 100", "select event_id from events where not coalesce(value > 100, false)"),
    "not_group": ("events", 'select event_id where not (value > 100 or event_type = "click")', "select event_id from events where not coalesce(value > 100 or event_type = 'click', false)"),
    "comparisons": (
        "part",
        "select p_partkey where p_size >= 10 and p_size <= 40 and p_size != 20 and p_size <> 30 and p_retailprice < 1500",
        "select p_partkey from part where p_size between 10 and 40 and p_size not in (20, 30) and p_retailprice < 1500",
    ),
    "missing_field": ("events", "select event_id where nothing != 1 or value > 300", "select event_id from events where value > 300"),
    "not_missing": ("events", "select event_id where not nothing = 1 and value > 300", "select event_id from events where value > 300"),
    "text_to_number": ("lineitem", 'select l_orderkey, l_linenumber where concat(l_linenumber, "") = 2', "select l_orderkey, l_linenumber from lineitem where l_linenumber = 2"),
    "bool_compare": ("part", 'select p_partkey where contains(p_name, "ring") = true and starts_with(p_name, "s") = "false"', "select p_partkey from part where contains(p_name, 'ring') and not starts_with(p_name, 's')"),
    "incomparable": ("nation", 'select n_nationkey where n_name != 5 and not n_name = 5', "select n_nationkey from nation"),
    "like": ("part", 'select p_partkey, p_name where p_name like "%a%"', "select p_partkey, p_name from part where p_name like '%a%'"),
    "like_prefix": ("customer", 'select c_custkey where c_name like "Customer%1"', "select c_custkey from customer where c_name like 'Customer%1'"),
    "like_underscore": ("customer", 'select c_custkey where c_name like "%_%"', "select c_custkey from customer where contains(c_name, '_')"),
    "not_like": ("part", 'select p_partkey where p_name not like "%a%e%"', "select p_partkey from part where p_name not like '%a%e%'"),
    "like_field": ("supplier", 'select s_suppkey where s_name like concat("%", s_suppkey)', "select s_suppkey from supplier where s_name like concat('%', s_suppkey)"),
    "truthy": ("labels", "select doc_id, quality where toxic", "select doc_id, quality from labels where toxic <> 0"),
    "not_truthy": ("labels", "select doc_id where not toxic", "select doc_id from labels where not coalesce(toxic <> 0, false)"),
    "arith": ("events", "select event_id, user_id + value - 1.5 as x", "select event_id, cast(user_id as double) + value - 1.5 as x from events"),
    "arith_parens": ("events", "select event_id, user_id - (value - 1) as x where (value + 1) > 50", "select event_id, cast(user_id as double) - (value - 1) as x from events where value + 1 > 50"),
    "text_fns": ("part", "select p_partkey, substr(p_name, 0, 4) as s, len(p_name) as n, upper(p_brand) as b", "select p_partkey, substring(p_name, 1, 4) as s, length(p_name) as n, upper(p_brand) as b from part"),
    "substr_negative": ("part", "select p_partkey, substr(p_name, -3) as s, substring(p_name, 2, 0) as e", "select p_partkey, right(p_name, 3) as s, '' as e from part"),
    "trim_lower": ("customer", 'select c_custkey, lower(trim(concat("  ", c_mktsegment, " "))) as m', "select c_custkey, lower(trim(concat('  ', c_mktsegment, ' '))) as m from customer"),
    "affixes": (
        "part",
        'select p_partkey, contains(p_name, "ring") as c, starts_with(p_name, "small") as s, ends_with(p_name, "g") as e',
        "select p_partkey, contains(p_name, 'ring') as c, starts_with(p_name, 'small') as s, ends_with(p_name, 'g') as e from part",
    ),
    "replace_concat": (
        "customer",
        'select c_custkey, replace(c_mktsegment, "A", "-") as r, concat(c_name, ":", c_mktsegment) as cc',
        "select c_custkey, replace(c_mktsegment, 'A', '-') as r, c_name || ':' || c_mktsegment as cc from customer",
    ),
    "coalesce": ("customer", 'select c_custkey, coalesce(nothing, c_mktsegment, "none") as s', "select c_custkey, coalesce(c_mktsegment, 'none') as s from customer"),
    "num": ("lineitem", 'select l_orderkey, l_linenumber, num(concat(l_linenumber, "ms")) as x', "select l_orderkey, l_linenumber, cast(l_linenumber as double) as x from lineitem"),
    "abs_floor_ceil": (
        "supplier",
        "select s_suppkey, abs(s_acctbal) as a, floor(s_acctbal) as f, ceil(s_acctbal) as c",
        "select s_suppkey, abs(s_acctbal) as a, cast(floor(s_acctbal) as double) as f, cast(ceil(s_acctbal) as double) as c from supplier",
    ),
    "round": ("lineitem", "select l_orderkey, l_linenumber, round(l_extendedprice, 1) as r", "select l_orderkey, l_linenumber, round(l_extendedprice, 1) as r from lineitem"),
    "duration_ms": ("lineitem", 'select l_orderkey, l_linenumber, duration_ms(concat(l_linenumber, "s")) as ms', "select l_orderkey, l_linenumber, cast(l_linenumber * 1000 as double) as ms from lineitem"),
    "now": ("region", "select r_regionkey where now() > 1700000000", "select r_regionkey from region"),
    "ts": ("events", "select event_id, ts(ts) as t", "select event_id, epoch(ts) as t from events"),
    "ts_cmp": ("events", "select event_id where ts(ts) > 1706000000 - 1h + 3600", "select event_id from events where epoch(ts) > 1706000000"),
    "format_time": (
        "events",
        "select event_id, format_time(ts) as w",
        "select event_id, replace(strftime(make_timestamp(cast(round(epoch(ts) * 1000) * 1000 as bigint)), '%Y-%m-%dT%H:%M:%S.%g'), '.000', '') || 'Z' as w from events",
    ),
    "format_time_zone": (
        "orders",
        'select o_orderkey, format_time(o_orderdate, "+02:00") as w',
        "select o_orderkey, strftime(o_orderdate + interval 2 hour, '%Y-%m-%dT%H:%M:%S') || '+02:00' as w from orders",
    ),
    "group_stats": (
        "events",
        "select event_type, count(*) as n, round(avg(value), 2) as a, min(value) as lo, max(value) as hi group by event_type",
        "select event_type, count(*) as n, round(avg(value), 2) as a, min(value) as lo, max(value) as hi from events group by event_type",
    ),
    "count_value": ("events", "select event_type, count(value) as n, count(nothing) as z group by event_type", "select event_type, count(value) as n, cast(0 as bigint) as z from events group by event_type"),
    "count_distinct": ("events", "select event_type, count_distinct(user_id) as u group by event_type", "select event_type, count(distinct user_id) as u from events group by event_type"),
    "sum_mean": ("orders", "select o_orderpriority, round(sum(o_totalprice), 2) as s, round(mean(o_totalprice), 2) as a group by o_orderpriority", "select o_orderpriority, round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 2) as a from orders group by o_orderpriority"),
    "first_last": (
        "events",
        "select event_type, first(user_id) as f, last(user_id) as l group by event_type",
        "select event_type, arg_min(user_id, event_id) as f, arg_max(user_id, event_id) as l from events group by event_type",
    ),
    "global_agg": ("events", "select count(*) as n, count_distinct(user_id) as u, max(value) as m", "select count(*) as n, count(distinct user_id) as u, max(value) as m from events"),
    "empty_global": ("events", 'select count(*) as n where event_type = "nope"', "select count(*) as n from events where event_type = 'nope' having count(*) > 0"),
    "compound_key": (
        "lineitem",
        "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q group by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by l_returnflag, l_linestatus",
    ),
    "expression_key": ("customer", "select lower(c_mktsegment) as s, count(*) as n group by lower(c_mktsegment)", "select lower(c_mktsegment) as s, count(*) as n from customer group by 1"),
    "alias_key": ("customer", "select upper(c_mktsegment) as s, count(*) as n group by upper(c_mktsegment) as seg having seg like \"%U%\"", "select upper(c_mktsegment) as s, count(*) as n from customer group by 1 having s like '%U%'"),
    "having": ("orders", "select o_custkey, count(*) as n group by o_custkey having count(*) > 12", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12"),
    "having_unselected": ("orders", "select o_custkey group by o_custkey having sum(o_totalprice) > 2000000", "select o_custkey from orders group by o_custkey having sum(o_totalprice) > 2000000"),
    "bucket": ("events", "select bucket(ts, 1h) as b, count(*) as n group by bucket(ts, 1h)", "select floor(epoch(ts) / 3600) * 3600 as b, count(*) as n from events group by 1"),
    "window_text": (
        "events",
        "select format_time(bucket(ts, 1h)) as w, count(*) as n group by bucket(ts, 1h)",
        "select strftime(to_timestamp(floor(epoch(ts) / 3600) * 3600) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as w, count(*) as n from events group by 1",
    ),
    "top_k": ("orders", "select o_orderkey, o_totalprice order by o_totalprice desc limit 10", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10"),
    "order_unselected": ("events", "select event_id order by value limit 20", "select event_id from events order by value nulls last, event_id limit 20"),
    "order_by_alias": ("events", "select event_id, value + 1 as v order by v desc limit 7", "select event_id, value + 1 as v from events order by v desc nulls last, event_id limit 7"),
    "order_by_agg": ("events", "select event_type group by event_type order by count(*) desc limit 2", "select event_type from events group by event_type order by count(*) desc limit 2"),
    "group_limit": ("events", "select event_type, count(*) as n group by event_type limit 2", "select event_type, count(*) as n from events group by event_type order by min(event_id) limit 2"),
    "comment": ("region", "select r_name -- the name\nwhere r_regionkey < 3 -- some", "select r_name from region where r_regionkey < 3"),
}


def as_json_lines(events: DataFrame) -> LogLines:
    user = F.struct(F.col("user_id").alias("id"))
    row = F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("event_type").alias("level"), "value", user.alias("user"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return from_lines(events.select(F.to_json(row).alias("value")))


def as_logfmt(events: DataFrame) -> LogLines:
    line = F.concat_ws(
        " ",
        F.concat(F.lit("event_id="), "event_id"),
        F.concat(F.lit("level="), "event_type"),
        F.concat(F.lit('msg="a \\"'), "event_type", F.lit('\\" event"')),
        F.concat(F.lit("value="), F.col("value").cast("string")),
        F.concat(F.lit("user_id="), "user_id"),
        F.when(F.col("event_type") == "error", F.lit("failed")),
    )
    return from_lines(events.select(line.alias("value")))


def as_mixed_lines(events: DataFrame) -> LogLines:
    """Values that are numbers in some lines and texts of equal width that spell numbers in others; keys with quotes."""
    text = F.lpad(F.col("event_id").cast("string"), 12, "0")
    value = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.col("event_id").cast("string"))
    line = F.concat(F.lit('{"say \\"hi\\"":'), F.col("event_id"), F.lit(',"what?":"'), F.col("event_type"), F.lit('","v":'), value, F.lit(',"user":'), F.col("user_id"), F.lit("}"))
    return from_lines(events.select(line.alias("value")))


def as_access_log(events: DataFrame) -> LogLines:
    line = F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(256)), F.lit(' - - [x] "GET /'), "event_type", F.lit('" '), "event_id", F.lit(" "), F.col("value").cast("string"))
    return from_lines(events.select(line.alias("value")), r'^(?<ip>\S+) \S+ \S+ \[[^\]]*\] "(?<method>[A-Z]+) /(?P<level>\w+)" (?<event_id>\d+) (?<value>\S+)$')


#: name: (rendering, query text, what the result is cast to, SQL)
LINE_QUERIES: dict[str, tuple[Callable[[DataFrame], LogLines], str, str, str]] = {
    "lines_json_path": (as_json_lines, "select event_id, k where k >= 50", "event_id bigint, k bigint", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) >= 50"),
    "lines_json_nested": (as_json_lines, "select event_id, user.id where user.id < 20", "event_id bigint, `user.id` bigint", 'select event_id, user_id as "user.id" from events where user_id < 20'),
    "lines_json_group": (
        as_json_lines,
        "select level, count(*) as n, count_distinct(user.id) as u, round(avg(value), 2) as a, min(value) as lo, max(value) as hi group by level",
        "level string, n bigint, u bigint, a double, lo double, hi double",
        "select event_type as level, count(*) as n, count(distinct user_id) as u, round(avg(value), 2) as a, min(value) as lo, max(value) as hi from events group by 1",
    ),
    "lines_json_window": (
        as_json_lines,
        'select format_time(bucket(ts, 1d)) as w, count(*) as n where level != "view" group by bucket(ts, 1d)',
        "w string, n bigint",
        "select strftime(to_timestamp(floor(epoch(ts) / 86400) * 86400) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as w, count(*) as n from events where event_type <> 'view' group by 1",
    ),
    "lines_json_star": (as_json_lines, "select *", "event_id bigint, ts string, level string, value double, user string, k bigint", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as ts, event_type as level, value, '{\"id\":' || user_id || '}' as user, cast(json_extract(props, '$.k') as bigint) as k from events"),
    "lines_mixed_extremes": (as_mixed_lines, "select user, min(v) as lo, max(v) as hi, count(v) as n group by user", "user bigint, lo bigint, hi bigint, n bigint", "select user_id as user, min(event_id) as lo, max(event_id) as hi, count(*) as n from events group by 1"),
    "lines_odd_keys": (as_mixed_lines, "select *", "say_hi bigint, what string, v bigint, user bigint", "select event_id as say_hi, event_type as what, event_id as v, user_id as user from events"),
    "lines_duplicate_label": (as_json_lines, "select lower(level) as x, k as x, event_id", "x bigint, event_id bigint", "select cast(json_extract(props, '$.k') as bigint) as x, event_id from events"),
    "lines_json_top": (as_json_lines, "select event_id, value order by value desc limit 10", "event_id bigint, value double", "select event_id, value from events order by value desc nulls last, event_id limit 10"),
    "lines_logfmt": (as_logfmt, "select event_id, msg, value where value > 100 and not failed", "event_id bigint, msg string, value double", "select event_id, 'a \"' || event_type || '\" event' as msg, value from events where value > 100 and event_type <> 'error'"),
    "lines_logfmt_group": (as_logfmt, "select level, failed, count(*) as n, first(user_id) as f, last(user_id) as l group by level, failed", "level string, failed boolean, n bigint, f bigint, l bigint", "select event_type as level, case when event_type = 'error' then true end as failed, count(*) as n, arg_min(user_id, event_id) as f, arg_max(user_id, event_id) as l from events group by 1, 2"),
    "lines_pattern": (as_access_log, 'select event_id, method, value where level = "error" and value > 50', "event_id bigint, method string, value double", "select event_id, 'GET' as method, value from events where event_type = 'error' and value > 50"),
    "lines_pattern_group": (as_access_log, "select level, count(*) as n, round(sum(value), 2) as s group by level order by n desc", "level string, n bigint, s double", "select event_type as level, count(*) as n, round(sum(value), 2) as s from events group by 1"),
}


def _table_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, text, _ = TABLE_QUERIES[name]
    return lambda spark, sf_dir: query(text, from_parquet(spark, f"{sf_dir}/{table}.parquet"))


def _line_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    render, text, types, _ = LINE_QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = from_parquet(spark, f"{sf_dir}/events.parquet")
        out = query(text, render(events))
        # Columns whose names SQL would have to quote are renamed.
        names = [re.sub(r"[^\w.]+", "_", c).strip("_") for c in out.columns]
        wanted = {n.strip("`"): t for n, t in (x.rsplit(" ", 1) for x in types.split(", "))}
        return out.select(*[_plain(out, c, wanted[n]).alias(n) for c, n in zip(out.columns, names, strict=True)])

    return run


def _plain(df: DataFrame, column: str, wanted: str):
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] != "variant":
        return c.cast(wanted)
    if wanted == "string":
        kind = F.schema_of_variant(c)
        return F.when(kind == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c))
    return F.try_variant_get(c, "$", wanted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _table_query(n) for n in TABLE_QUERIES} | {n: _line_query(n) for n in LINE_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {n: q[2] for n, q in TABLE_QUERIES.items()} | {n: q[3] for n, q in LINE_QUERIES.items()}


FLAGSHIP = "select format_time(bucket(ts, 1h)) as w, count(*) as n, round(avg(value), 2) as avg_value where value > 10 group by bucket(ts, 1h) order by n desc"
