"""Registered queries of the engine, each beside the SQL it is checked against.

Sums and means of doubles are rounded alike on both sides; every order-dependent
result has unique sort keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.catalog import Catalog
from docmill.find import Find, bulk_write, dereference
from docmill.frontends import jdql
from docmill.frontends.methods import run_method
from docmill.operators.sinks import documents_frame
from docmill.pipeline import Aggregation, aggregate

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import docmill.plans.families  # noqa: F401 - registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import docmill.plans.families  # noqa: F401

    return dict(_SQL)


def pipe(name: str, source: str, pipeline: list[dict], sql: str | None) -> None:
    """A query that is one pipeline over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate(source, pipeline, Catalog.from_directory(spark, sf_dir))

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def query(name: str, sql: str | None = None):
    """A query that is a function of the catalog."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(Catalog.from_directory(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def _r(x, n=2) -> dict:
    return {"$round": [x, n]}


def _f(x) -> dict:
    """Thousandths, cut off the short decimals on which two roundings could differ."""
    return {"$floor": {"$add": [{"$multiply": [x, 1000]}, 0.1234567]}}


_CUT = dt.datetime(1998, 9, 2)
_DISC = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}

# -- aggregation --------------------------------------------------------------------
pipe(
    "pricing_summary", "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": _CUT}}},
        {"$group": {"_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_base": {"$sum": "$l_extendedprice"}, "sum_disc": {"$sum": _DISC},
                    "sum_charge": {"$sum": {"$multiply": [_DISC, {"$add": [1, "$l_tax"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "avg_disc": {"$avg": "$l_discount"}, "n": {"$count": {}}}},
        {"$project": {"_id": 0, "rf": "$_id.rf", "ls": "$_id.ls", "sum_qty": _r("$sum_qty"), "sum_base": _r("$sum_base"), "sum_disc": _r("$sum_disc", 1), "sum_charge": _r("$sum_charge", 1), "avg_qty": _r("$avg_qty", 4), "avg_disc": _r("$avg_disc", 4), "n": 1}},
        {"$sort": {"rf": 1, "ls": 1}},
    ],
    """select l_returnflag rf, l_linestatus ls, round_even(sum(l_quantity), 2) sum_qty, round_even(sum(l_extendedprice), 2) sum_base,
       round_even(sum(l_extendedprice * (1 - l_discount)), 1) sum_disc, round_even(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) sum_charge,
       round_even(avg(l_quantity), 4) avg_qty, round_even(avg(l_discount), 4) avg_disc, count(*) n
       from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
)
pipe("group_null_key", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}}}, {"$project": {"_id": 0}}], "select count(*) n, min(o_totalprice) lo, max(o_totalprice) hi from orders")
pipe("group_stddev", "orders", [{"$group": {"_id": "$o_orderpriority", "p": {"$stdDevPop": "$o_totalprice"}, "s": {"$stdDevSamp": "$o_totalprice"}}}, {"$project": {"p": _r("$p", 3), "s": _r("$s", 3)}}],
     "select o_orderpriority _id, round_even(stddev_pop(o_totalprice), 3) p, round_even(stddev_samp(o_totalprice), 3) s from orders group by 1")
pipe("group_first_last", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}],
     "select o_custkey _id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last from orders group by 1")
pipe("group_push", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}, {"$project": {"n": {"$size": "$keys"}, "second": {"$arrayElemAt": ["$keys", 1]}, "last": {"$arrayElemAt": ["$keys", -1]}}}],
     "select o_custkey _id, cast(count(*) as int) n, (list(o_orderkey order by o_orderkey))[2] as second, max(o_orderkey) as last from orders group by 1")
pipe("group_add_to_set", "orders", [{"$group": {"_id": "$o_custkey", "s": {"$addToSet": "$o_orderstatus"}}}, {"$project": {"n": {"$size": "$s"}, "least": {"$first": "$s"}}}], "select o_custkey _id, cast(count(distinct o_orderstatus) as int) n, min(o_orderstatus) least from orders group by 1")
pipe("group_median", "lineitem", [{"$group": {"_id": "$l_returnflag", "m": {"$median": {"input": "$l_quantity", "method": "approximate"}}, "p": {"$percentile": {"input": "$l_quantity", "p": [0.9], "method": "approximate"}}}}, {"$project": {"m": 1, "p90": {"$first": "$p"}}}],
     "select l_returnflag _id, quantile_disc(l_quantity, 0.5) m, quantile_disc(l_quantity, 0.9) p90 from lineitem group by 1")
pipe("group_top", "orders", [{"$group": {"_id": "$o_custkey", "top": {"$top": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}}}, "low": {"$bottom": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": -1}}}}}],
     "select o_custkey _id, (list(o_orderkey order by o_totalprice desc, o_orderkey))[1] top, (list(o_orderkey order by o_totalprice, o_orderkey))[1] low from orders group by 1")
pipe("group_top_n", "orders", [{"$group": {"_id": "$o_orderpriority", "t": {"$topN": {"output": "$o_orderkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "n": 3}}, "m": {"$maxN": {"input": "$o_totalprice", "n": 2}}}}, {"$project": {"third": {"$arrayElemAt": ["$t", 2]}, "second_max": {"$arrayElemAt": ["$m", 1]}}}],
     "select o_orderpriority _id, (list(o_orderkey order by o_totalprice desc, o_orderkey))[3] third, (list(o_totalprice order by o_totalprice desc))[2] second_max from orders group by 1")
pipe("count_stage", "lineitem", [{"$match": {"l_quantity": {"$gt": 45}}}, {"$count": "n"}], "select count(*) n from lineitem where l_quantity > 45")
pipe("sort_by_count", "documents", [{"$sortByCount": "$lang"}], "select lang _id, count(*) count from documents group by 1")
pipe("bucket_price", "part", [{"$bucket": {"groupBy": "$p_retailprice", "boundaries": [0, 1000, 1500, 2000], "default": 9999, "output": {"n": {"$sum": 1}, "hi": {"$max": "$p_size"}}}}],
     "select case when p_retailprice >= 0 and p_retailprice < 1000 then 0 when p_retailprice >= 1000 and p_retailprice < 1500 then 1000 when p_retailprice >= 1500 and p_retailprice < 2000 then 1500 else 9999 end _id, count(*) n, max(p_size) hi from part group by 1")
pipe("bucket_auto", "customer", [{"$bucketAuto": {"groupBy": "$c_acctbal", "buckets": 5}}, {"$project": {"_id": 0, "lo": "$_id.min", "count": 1}}],
     "with t as (select c_acctbal, ntile(5) over (order by c_acctbal, c_custkey) b from customer) select min(c_acctbal) lo, count(*) count from t group by b")
pipe("facet", "part", [{"$facet": {"brands": [{"$group": {"_id": "$p_brand", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 1}}}], "big": [{"$match": {"p_size": {"$gte": 40}}}, {"$count": "n"}]}}, {"$project": {"brands": {"$size": "$brands"}, "big": {"$arrayElemAt": ["$big.n", 0]}}}],
     "select cast((select count(*) from (select p_brand from part group by 1 having count(*) > 1)) as int) brands, (select count(*) from part where p_size >= 40) big")

# -- shaping ------------------------------------------------------------------------
pipe("match_logic", "orders", [{"$match": {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$gt": 200000}}, {"$nor": [{"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, {"o_totalprice": {"$lt": 100000}}]}]}}, {"$project": {"o_orderkey": 1}}],
     "select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice > 200000) or not (o_orderpriority in ('1-URGENT', '2-HIGH') or o_totalprice < 100000)")
pipe("match_ne_nin", "customer", [{"$match": {"c_mktsegment": {"$ne": "BUILDING", "$nin": ["MACHINERY"]}, "c_nationkey": {"$mod": [3, 1]}}}, {"$project": {"c_custkey": 1}}], "select c_custkey from customer where c_mktsegment <> 'BUILDING' and c_mktsegment <> 'MACHINERY' and c_nationkey % 3 = 1")
pipe("match_regex", "part", [{"$match": {"p_type": {"$regex": "^(small|large)", "$options": "i"}}}, {"$project": {"p_partkey": 1, "p_type": 1}}], "select p_partkey, p_type from part where regexp_matches(p_type, '^(small|large)', 'i')")
pipe("match_expr", "lineitem", [{"$match": {"$expr": {"$gt": [{"$multiply": ["$l_discount", 100]}, {"$multiply": ["$l_tax", 120]}]}}}, {"$group": {"_id": "$l_linenumber", "n": {"$sum": 1}}}], "select l_linenumber _id, count(*) n from lineitem where l_discount * 100 > l_tax * 120 group by 1")
pipe("match_bits", "orders", [{"$match": {"o_orderkey": {"$bitsAllSet": 5, "$bitsAllClear": 2}}}, {"$project": {"o_orderkey": 1}}], "select o_orderkey from orders where (o_orderkey & 5) = 5 and (o_orderkey & 2) = 0")
pipe("match_text", "documents", [{"$match": {"text": {"$text": {"$search": "\"MIT License\" -zzz"}}}}, {"$project": {"doc_id": 1}}], "select doc_id from documents where contains(lower(text), 'mit license') and not contains(lower(text), 'zzz')")
pipe("match_json_schema", "customer", [{"$match": {"$jsonSchema": {"required": ["c_name"], "properties": {"c_acctbal": {"type": "number", "minimum": 0}, "c_mktsegment": {"enum": ["BUILDING", "AUTOMOBILE"]}, "c_name": {"pattern": "[05]$"}}}}}, {"$project": {"c_custkey": 1}}],
     "select c_custkey from customer where c_name is not null and c_acctbal >= 0 and c_mktsegment in ('BUILDING', 'AUTOMOBILE') and regexp_matches(c_name, '[05]$')")
pipe("match_array", "embeddings", [{"$match": {"embedding": {"$elemMatch": {"$gt": 0.4}, "$size": 64}}}, {"$count": "n"}], "select n from (select count(*) n from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x > 0.4)) > 0) where n > 0")
pipe("project_nested", "supplier", [{"$project": {"s_suppkey": 1, "who.name": "$s_name", "who.at.nation": "$s_nationkey"}}, {"$project": {"s_suppkey": 1, "n": "$who.at.nation", "m": {"$toUpper": "$who.name"}}}], "select s_suppkey, s_nationkey n, upper(s_name) m from supplier")
pipe("add_fields_unset", "nation", [{"$addFields": {"tag": {"$concat": ["$n_name", "-", {"$toString": "$n_regionkey"}]}, "twice": {"$multiply": ["$n_nationkey", 2]}}}, {"$unset": ["n_regionkey"]}], "select n_nationkey, n_name, n_name || '-' || n_regionkey tag, n_nationkey * 2 twice from nation")
pipe("replace_root", "region", [{"$replaceRoot": {"newRoot": {"k": "$r_regionkey", "v": {"$strLenCP": "$r_name"}}}}], "select r_regionkey k, cast(length(r_name) as int) v from region")
pipe("unwind_words", "documents", [{"$project": {"doc_id": 1, "w": {"$split": ["$text", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}], "select doc_id, unnest(string_split(text, ' ')) w, cast(unnest(range(len(string_split(text, ' ')))) as bigint) i from documents")
pipe("unwind_all_words", "documents", [{"$project": {"doc_id": 1, "w": {"$split": ["$text", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}, {"$group": {"_id": "$w", "n": {"$sum": 1}, "places": {"$sum": "$i"}}}],
     "select w _id, count(*) n, cast(sum(i) as bigint) places from (select unnest(string_split(text, ' ')) w, unnest(range(len(string_split(text, ' ')))) i from documents) group by 1")
pipe("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 10}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
pipe("redact", "customer", [{"$redact": {"$cond": [{"$gte": ["$c_acctbal", 5000]}, "$$KEEP", "$$PRUNE"]}}, {"$project": {"c_custkey": 1}}], "select c_custkey from customer where c_acctbal >= 5000")
pipe("sample", "orders", [{"$sample": {"size": 7}}, {"$count": "n"}], "select 7::bigint n")
pipe("documents_stage", "region", [{"$documents": [{"a": 1, "b": "x"}, {"a": 2}]}, {"$project": {"a": 1, "b": {"$ifNull": ["$b", "none"]}}}], "select * from (values (1::bigint, 'x'), (2::bigint, 'none')) t(a, b)")
pipe("coll_stats", "nation", [{"$collStats": {"count": {}}}], "select 'nation' ns, count(*) count from nation")

# -- joins --------------------------------------------------------------------------
pipe("lookup_equality", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$o"}, "total": _r({"$sum": "$o.o_totalprice"})}}],
     "select c_custkey, cast(count(o_orderkey) as int) n, round_even(coalesce(sum(o_totalprice), 0), 2) total from customer left join orders on o_custkey = c_custkey group by 1")
pipe("lookup_anti", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$size": 0}}}, {"$project": {"c_custkey": 1}}], "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
pipe("lookup_unwind", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$project": {"n_name": 1, "r": "$r.r_name"}}], "select n_name, r_name r from nation join region on r_regionkey = n_regionkey")
pipe("lookup_pipeline", "customer",
     [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey", "b": "$c_acctbal"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$b", 20]}]}]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"o_orderkey": 1}}], "as": "o"}},
      {"$project": {"c_custkey": 1, "n": {"$size": "$o"}, "best": {"$max": "$o.o_orderkey"}}}],
     """select c_custkey, cast(count(o_orderkey) as int) n, max(o_orderkey) best from customer left join (
        select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders join customer on o_custkey = c_custkey and o_totalprice > c_acctbal * 20) t
        on o_custkey = c_custkey and rn <= 2 group by 1""")  # fmt: skip
pipe("lookup_uncorrelated", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$group": {"_id": "$n_regionkey", "n": {"$sum": 1}}}], "as": "all"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$all"}}}], "select r_regionkey, (select cast(count(distinct n_regionkey) as int) from nation) n from region")
pipe("union_with", "nation", [{"$project": {"name": "$n_name"}}, {"$unionWith": {"coll": "region", "pipeline": [{"$project": {"name": "$r_name"}}]}}], "select n_name as name from nation union all select r_name from region")


@query("graph_lookup", """with recursive e as (select n_nationkey k, n_nationkey // 2 p from nation), r as (select k root, p cur, 0 d from e union select r.root, e.p, d + 1 from r join e on e.k = r.cur where d < 2)
       select root n_nationkey, cast(count(distinct cur) as int) n from r join nation on n_nationkey = cur group by 1""")
def _(c):
    c["tree"] = c["nation"].select("n_nationkey", F.floor(F.col("n_nationkey") / 2).cast("int").alias("parent"))
    return Aggregation("tree", c).graph_lookup({"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "n_nationkey", "as": "up", "maxDepth": 2, "depthField": "d"}).project({"n_nationkey": 1, "n": {"$size": "$up"}}).df()


# -- windows and series --------------------------------------------------------------
def _window(output: dict, keep: list[str], source="events", by="$user_id", sort=None, extra: dict | None = None) -> list[dict]:
    return [{"$setWindowFields": {"partitionBy": by, "sortBy": sort or {"ts": 1, "event_id": 1}, "output": output}}, {"$project": {"event_id": 1, **{k: 1 for k in keep}, **(extra or {})}}]


_W = "over (partition by user_id order by ts, event_id"
pipe("window_ranks", "events", _window({"rn": {"$documentNumber": {}}, "rk": {"$rank": {}}, "dr": {"$denseRank": {}}}, ["rn", "rk", "dr"], sort={"event_type": 1}) + [{"$group": {"_id": "$rk", "n": {"$sum": 1}, "d": {"$max": "$dr"}}}],
     "with t as (select rank() over (partition by user_id order by event_type) rk, dense_rank() over (partition by user_id order by event_type) dr from events) select rk _id, count(*) n, max(dr) d from t group by 1")
pipe("window_shift", "events", _window({"prev": {"$shift": {"output": "$event_id", "by": -1, "default": -1}}, "next": {"$shift": {"output": "$event_id", "by": 2}}}, ["prev", "next"]), f"select event_id, coalesce(lag(event_id) {_W}), -1) prev, lead(event_id, 2) {_W}) as next from events")
pipe("window_rows", "events", _window({"s": {"$sum": "$value", "window": {"documents": [-2, 0]}}, "a": {"$avg": "$value", "window": {"documents": ["unbounded", "current"]}}, "m": {"$max": "$value", "window": {"documents": [0, 3]}}}, ["m"], extra={"s": _r("$s", 4), "a": _f("$a")}),
     f"select event_id, max(value) {_W} rows between current row and 3 following) m, round_even(sum(value) {_W} rows between 2 preceding and current row), 4) s, cast(floor(avg(value) {_W} rows between unbounded preceding and current row) * 1000 + 0.1234567) as bigint) a from events")
pipe("window_range", "events", _window({"n": {"$count": {}, "window": {"range": [-1, 0], "unit": "day"}}}, ["n"], sort={"ts": 1}), "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) n from events")
pipe("window_first_last", "events", _window({"f": {"$first": "$event_id", "window": {"documents": [-3, 3]}}, "l": {"$last": "$event_id", "window": {"documents": [-3, 3]}}}, ["f", "l"]), f"select event_id, first(event_id) {_W} rows between 3 preceding and 3 following) f, last(event_id) {_W} rows between 3 preceding and 3 following) l from events")
pipe("window_dispersion", "events", _window({"sd": {"$stdDevPop": "$value"}, "cv": {"$covariancePop": ["$event_id", "$value"]}}, [], extra={"sd": _r("$sd", 4), "cv": _r("$cv", 1)}), "select event_id, round_even(stddev_pop(value) over (partition by user_id), 4) sd, round_even(covar_pop(event_id, value) over (partition by user_id), 1) cv from events")
pipe("window_push", "events", _window({"p": {"$push": "$event_id", "window": {"documents": [-1, 1]}}, "k": {"$minN": {"input": "$event_id", "n": 2}, "window": {"documents": [-2, 2]}}}, [], extra={"n": {"$size": "$p"}, "k": {"$sum": "$k"}}),
     f"with t as (select event_id, list(event_id) {_W} rows between 1 preceding and 1 following) p, list(event_id) {_W} rows between 2 preceding and 2 following) k from events) select event_id, cast(len(p) as int) n, cast(list_sum(list_sort(k)[1:2]) as double) k from t")
pipe("window_locf", "events", [{"$addFields": {"v": {"$cond": [{"$eq": ["$event_type", "purchase"]}, "$value", None]}}}] + _window({"v": {"$locf": "$v"}}, ["v"]), f"select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) {_W} rows between unbounded preceding and current row) v from events")
pipe("window_derivative", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"d": {"$derivative": {"input": "$o_totalprice"}, "window": {"documents": [-1, 0]}}}}}, {"$project": {"o_orderkey": 1, "d": _f("$d")}}],
     "select o_orderkey, cast(floor(case when lag(o_orderkey) over w is null then null else (o_totalprice - lag(o_totalprice) over w) / (o_orderkey - lag(o_orderkey) over w) end * 1000 + 0.1234567) as bigint) d from orders window w as (partition by o_custkey order by o_orderkey)")
pipe("window_integral", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"i": {"$integral": {"input": "$o_totalprice"}}}}}, {"$project": {"o_orderkey": 1, "i": {"$floor": {"$add": ["$i", 0.1234567]}}}}],
     "with t as (select o_custkey, (o_orderkey - lag(o_orderkey) over w) * (o_totalprice + lag(o_totalprice) over w) / 2 x from orders window w as (partition by o_custkey order by o_orderkey)), s as (select o_custkey, coalesce(sum(x), 0) i from t group by 1) select o_orderkey, cast(floor(i + 0.1234567) as bigint) i from orders join s using (o_custkey)")
pipe("window_moving_average", "events", _window({"e": {"$expMovingAvg": {"input": "$value", "N": 3}}}, [], extra={"e": _f("$e")}),
     """with recursive t as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) i from events),
        r as (select event_id, user_id, i, value e from t where i = 1 union all select t.event_id, t.user_id, t.i, t.value * 0.5 + r.e * 0.5 from r join t on t.user_id = r.user_id and t.i = r.i + 1) select event_id, cast(floor(e * 1000 + 0.1234567) as bigint) e from r""")  # fmt: skip
_HOURLY = [{"$group": {"_id": {"$dateTrunc": {"date": "$ts", "unit": "hour", "binSize": 6}}, "n": {"$sum": 1}}}]
pipe("densify_fill", "events",
     [{"$match": {"event_type": "signup"}}, *_HOURLY, {"$densify": {"field": "_id", "range": {"step": 6, "unit": "hour", "bounds": "full"}}}, {"$fill": {"sortBy": {"_id": 1}, "output": {"n": {"value": 0}}}}],
     """with t as (select time_bucket(interval 6 hour, ts, timestamp '2000-01-01') h, count(*) n from events where event_type = 'signup' group by 1),
        g as (select unnest(generate_series((select min(h) from t), (select max(h) from t), interval 6 hour)) h) select g.h _id, coalesce(n, 0) n from g left join t using (h)""")  # fmt: skip
pipe("fill_linear", "events", [{"$group": {"_id": {"$dateDiff": {"startDate": dt.datetime(2024, 1, 1), "endDate": "$ts", "unit": "day"}}, "n": {"$sum": 1}}}, {"$match": {"_id": {"$mod": [3, 0]}}}, {"$densify": {"field": "_id", "range": {"step": 1, "bounds": "full"}}}, {"$fill": {"sortBy": {"_id": 1}, "output": {"n": {"method": "linear"}}}}, {"$project": {"_id": 1, "n": _r("$n", 4)}}],
     """with t as (select date_diff('day', timestamp '2024-01-01', ts) d, count(*) n from events group by 1 having d % 3 = 0), g as (select unnest(range((select min(d) from t), (select max(d) from t) + 1)) d)
        select g.d _id, round_even(a.n + coalesce((b.n - a.n) * (g.d - a.d) / 3.0, 0), 4) n from g join t a on a.d = g.d - g.d % 3 left join t b on b.d = a.d + 3 and g.d > a.d""")  # fmt: skip
pipe("densify_partition", "events", [{"$group": {"_id": {"u": "$user_id", "d": {"$dayOfMonth": "$ts"}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "u": "$_id.u", "d": "$_id.d", "n": 1}}, {"$densify": {"field": "d", "partitionByFields": ["u"], "range": {"step": 1, "bounds": "partition"}}}, {"$group": {"_id": "$u", "days": {"$sum": 1}, "n": {"$sum": "$n"}}}],
     "select user_id _id, cast(max(day(ts)) - min(day(ts)) + 1 as bigint) as days, count(*) n from events group by 1")

# -- expressions ----------------------------------------------------------------------
pipe("expr_math", "orders", [{"$project": {"o_orderkey": 1, "a": {"$mod": ["$o_orderkey", 7]}, "b": _r({"$sqrt": "$o_totalprice"}, 5), "c": {"$trunc": ["$o_totalprice", -2]}, "d": _r({"$log": ["$o_totalprice", 2]}, 6), "e": _r({"$divide": ["$o_totalprice", 3]}, 3), "f": {"$ceil": "$o_totalprice"}, "g": {"$abs": {"$subtract": ["$o_custkey", "$o_orderkey"]}}, "h": _r({"$atan2": ["$o_custkey", "$o_orderkey"]}, 6)}}],
     "select o_orderkey, o_orderkey % 7 a, round_even(sqrt(o_totalprice), 5) b, trunc(o_totalprice / 100) * 100 c, round_even(ln(o_totalprice) / ln(2), 6) d, round_even(o_totalprice / 3, 3) e, cast(ceil(o_totalprice) as bigint) f, abs(o_custkey - o_orderkey) g, round_even(atan2(o_custkey, o_orderkey), 6) h from orders")
pipe("expr_trigonometry", "part", [{"$project": {"p_partkey": 1, **{k: _r({f"${k}": {"$divide": ["$p_size", 60]}}, 8) for k in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")}, "rad": _r({"$degreesToRadians": "$p_size"}, 8), "deg": _r({"$radiansToDegrees": "$p_size"}, 6)}}],
     "select p_partkey, " + ", ".join(f"round_even({k}(p_size / 60.0), 8) as {k}" for k in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")) + ", round_even(radians(p_size), 8) rad, round_even(degrees(p_size), 6) deg from part")
pipe("expr_compare", "orders", [{"$project": {"o_orderkey": 1, "c": {"$cmp": ["$o_custkey", "$o_orderkey"]}, "s": {"$switch": {"branches": [{"case": {"$lt": ["$o_totalprice", 50000]}, "then": "low"}, {"case": {"$lt": ["$o_totalprice", 150000]}, "then": "mid"}], "default": "high"}}, "i": {"$in": ["$o_orderstatus", ["F", "P"]]}, "n": {"$not": [{"$eq": ["$o_orderstatus", "F"]}]}}}],
     "select o_orderkey, cast(sign(o_custkey - o_orderkey) as int) c, case when o_totalprice < 50000 then 'low' when o_totalprice < 150000 then 'mid' else 'high' end s, o_orderstatus in ('F', 'P') i, o_orderstatus <> 'F' n from orders")
pipe("expr_strings", "part", [{"$project": {"p_partkey": 1, "a": {"$toUpper": "$p_name"}, "b": {"$substrCP": ["$p_name", 2, 4]}, "c": {"$indexOfCP": ["$p_type", "E"]}, "d": {"$strLenBytes": "$p_name"}, "e": {"$trim": {"input": {"$concat": ["  ", "$p_brand", " "]}}}, "f": {"$replaceAll": {"input": "$p_type", "find": " ", "replacement": "_"}}, "g": {"$replaceOne": {"input": "$p_type", "find": " ", "replacement": ""}}, "h": {"$regexMatch": {"input": "$p_type", "regex": "STEEL$"}}, "i": {"$arrayElemAt": [{"$split": ["$p_type", " "]}, 0]}, "j": {"$strcasecmp": ["$p_brand", "brand#3"]}}}],
     "select p_partkey, upper(p_name) a, substr(p_name, 3, 4) b, cast(instr(p_type, 'E') - 1 as int) c, cast(strlen(p_name) as int) d, trim(p_brand) e, replace(p_type, ' ', '_') f, regexp_replace(p_type, ' ', '') g, regexp_matches(p_type, 'STEEL$') h, string_split(p_type, ' ')[1] i, case when lower(p_brand) < 'brand#3' then -1 when lower(p_brand) > 'brand#3' then 1 else 0 end j from part")
pipe("expr_regex", "documents", [{"$project": {"doc_id": 1, "m": {"$regexFind": {"input": "$text", "regex": "[0-9]{3,}"}}, "n": {"$size": {"$regexFindAll": {"input": "$text", "regex": "[0-9]+"}}}}}, {"$project": {"doc_id": 1, "n": 1, "m": "$m.match"}}],
     "select doc_id, cast(len(regexp_extract_all(text, '[0-9]+')) as int) n, nullif(regexp_extract(text, '[0-9]{3,}'), '') m from documents")
pipe("expr_dates", "events", [{"$project": {"event_id": 1, "y": {"$year": "$ts"}, "mo": {"$month": "$ts"}, "d": {"$dayOfMonth": "$ts"}, "w": {"$dayOfWeek": "$ts"}, "dy": {"$dayOfYear": "$ts"}, "h": {"$hour": "$ts"}, "mi": {"$minute": "$ts"}, "s": {"$second": "$ts"}, "iw": {"$isoWeek": "$ts"}, "iy": {"$isoWeekYear": "$ts"}, "id": {"$isoDayOfWeek": "$ts"}, "t": {"$dateToString": {"date": "$ts", "format": "%Y/%m/%d %H:%M"}}}}],
     "select event_id, cast(year(ts) as int) y, cast(month(ts) as int) mo, cast(day(ts) as int) d, cast(dayofweek(ts) + 1 as int) w, cast(dayofyear(ts) as int) dy, cast(hour(ts) as int) h, cast(minute(ts) as int) mi, cast(second(ts) as int) s, cast(week(ts) as int) iw, cast(isoyear(ts) as int) iy, cast(isodow(ts) as int) id, strftime(ts, '%Y/%m/%d %H:%M') t from events")
pipe("expr_date_math", "orders", [{"$project": {"o_orderkey": 1, "a": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 2}}, "b": {"$dateSubtract": {"startDate": "$o_orderdate", "unit": "day", "amount": 3}}, "w": {"$dateTrunc": {"date": "$o_orderdate", "unit": "week"}}, "m": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "y": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": dt.datetime(2000, 1, 1), "unit": "year"}}, "k": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": dt.datetime(2000, 1, 1), "unit": "week"}}, "p": {"$dateFromParts": {"year": {"$year": "$o_orderdate"}, "month": 14, "day": 1}}}}],
     "select o_orderkey, o_orderdate + interval 2 month a, o_orderdate - interval 3 day b, cast(date_trunc('week', o_orderdate + interval 1 day) - interval 1 day as timestamp) w, cast(date_trunc('month', o_orderdate) as timestamp) m, date_diff('year', o_orderdate, timestamp '2000-01-01') y, date_diff('day', date_trunc('week', o_orderdate + interval 1 day), date_trunc('week', timestamp '2000-01-02')) // 7 k, make_timestamp(cast(year(o_orderdate) + 1 as bigint), 2, 1, 0, 0, 0) p from orders")
pipe("expr_arrays", "embeddings", [{"$project": {"vec_id": 1, "f": {"$size": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0]}}}}, "n": _r({"$sqrt": {"$reduce": {"input": "$embedding", "initialValue": 0.0, "in": {"$add": ["$$value", {"$multiply": ["$$this", "$$this"]}]}}}}, 4), "m": {"$maxN": {"input": "$embedding", "n": 1}}, "r": {"$size": {"$range": [0, 10, 3]}}, "i": {"$indexOfArray": [["a", "b", "c"], "c"]}, "l": {"$last": "$embedding"}}}, {"$addFields": {"m": _r({"$toDouble": {"$first": "$m"}}, 6), "l": _r({"$toDouble": "$l"}, 6)}}],
     "select vec_id, cast(len(list_filter(embedding, lambda x: x > 0)) as int) f, round_even(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) n, round_even(cast(list_max(embedding) as double), 6) m, 4 r, 2 i, round_even(cast(embedding[-1] as double), 6) l from embeddings")
pipe("expr_sets", "documents", [{"$project": {"doc_id": 1, "a": {"$setUnion": [["$lang"], ["en", "de"]]}, "b": {"$setIsSubset": [["$lang"], ["en", "fr"]]}, "c": {"$setDifference": [["en", "de"], ["$lang"]]}, "d": {"$setEquals": [["$lang", "$lang"], ["$lang"]]}, "e": {"$setIntersection": [["en", "de"], ["$lang"]]}, "g": {"$allElementsTrue": [[{"$eq": ["$lang", "en"]}, True]]}}}, {"$addFields": {"a": {"$size": "$a"}, "c": {"$size": "$c"}, "e": {"$size": "$e"}}}],
     "select doc_id, case when lang in ('en', 'de') then 2 else 3 end a, lang in ('en', 'fr') b, case when lang in ('en', 'de') then 1 else 2 end c, true d, case when lang in ('en', 'de') then 1 else 0 end e, lang = 'en' g from documents")
pipe("expr_convert", "orders", [{"$project": {"o_orderkey": 1, "a": {"$toString": "$o_orderkey"}, "b": {"$toInt": "$o_totalprice"}, "c": {"$convert": {"input": "$o_orderpriority", "to": "int", "onError": -1}}, "d": {"$toInt": {"$substrCP": ["$o_orderpriority", 0, 1]}}, "e": {"$type": "$o_totalprice"}, "f": {"$isNumber": "$o_orderstatus"}, "g": {"$toLong": {"$toDate": {"$toLong": "$o_orderdate"}}}}}],
     "select o_orderkey, cast(o_orderkey as varchar) a, cast(trunc(o_totalprice) as int) b, -1 c, cast(substr(o_orderpriority, 1, 1) as int) d, 'double' e, false f, epoch_ms(o_orderdate) g from orders")
pipe("expr_let_objects", "customer", [{"$project": {"c_custkey": 1, "v": {"$let": {"vars": {"x": {"$add": ["$c_custkey", 1]}}, "in": {"$multiply": ["$$x", "$$x"]}}}, "o": {"$mergeObjects": [{"a": 1, "b": 2}, {"b": "$c_nationkey"}]}, "k": {"$size": {"$objectToArray": {"p": "$c_name", "q": "$c_name"}}}}}, {"$project": {"c_custkey": 1, "v": 1, "b": "$o.b", "k": 1}}],
     "select c_custkey, (c_custkey + 1) * (c_custkey + 1) v, c_nationkey b, 2 k from customer")
pipe("json_props", "events", [{"$match": {"event_type": "purchase"}}, {"$group": {"_id": {"$toInt": {"$arrayElemAt": [{"$regexFindAll": {"input": "$props", "regex": "[0-9]+"}}, 0]}}, "n": {"$sum": 1}}}], "select cast(regexp_extract(props, '[0-9]+') as int) _id, count(*) n from events where event_type = 'purchase' group by 1")

# -- find, updates, front ends ----------------------------------------------------------


@query("find_fluent", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and not (o_totalprice < 100000) and o_orderpriority in ('1-URGENT', '5-LOW') order by o_totalprice desc, o_orderkey limit 20")
def _(c):
    return Find("orders", c).f("o_orderstatus").eq("O").f("o_totalprice").not_().lt(100000).f("o_orderpriority").in_(["1-URGENT", "5-LOW"]).sort("-o_totalprice", "o_orderkey").limit(20).project("o_orderkey", "o_totalprice").df()


@query("find_distinct", "select distinct c_mktsegment as value from customer where c_acctbal > 0")
def _(c):
    return Find("customer", c).f("c_acctbal").gt(0).distinct("c_mktsegment")


@query("find_keyset_page", "select o_orderkey from orders where o_totalprice < 200000 or (o_totalprice = 200000 and o_orderkey > 5) order by o_totalprice desc, o_orderkey limit 15")
def _(c):
    return Find("orders", c).sort("-o_totalprice", "o_orderkey").after({"o_totalprice": 200000.0, "o_orderkey": 5}, 15).select("o_orderkey")


@query("update_inc_set", "select n_nationkey + case when n_regionkey = 1 then 100 else 0 end n_nationkey, case when n_regionkey = 1 then 'x' else n_name end n_name, n_regionkey from nation")
def _(c):
    return Find("nation", c).f("n_regionkey").eq(1).update({"$inc": {"n_nationkey": 100}, "$set": {"n_name": "x"}})


@query("update_arrays", "select n_regionkey _id, cast(len(list_filter(list(n_nationkey), lambda x: x <> 3)) + 1 as int) n from nation group by 1")
def _(c):
    grouped = aggregate("nation", [{"$group": {"_id": "$n_regionkey", "ks": {"$addToSet": "$n_nationkey"}}}], c)
    return aggregate(Find(Find(grouped).update({"$pull": {"ks": 3}})).update({"$push": {"ks": 99}}), [{"$project": {"n": {"$size": "$ks"}}}])


@query("delete_rows", "select p_partkey from part where p_size > 5")
def _(c):
    return Find("part", c).f("p_size").lte(5).delete().select("p_partkey")


@query("bulk_write", "select r_regionkey, case when r_regionkey = 0 then 'zero' else r_name end r_name from region where r_regionkey <> 2 union all select 77, 'new'")
def _(c):
    new = documents_frame(c.spark, [{"r_regionkey": 77, "r_name": "new"}]).select(F.col("r_regionkey").cast("int"), "r_name")
    return bulk_write(c["region"], [("insert", new), ("update", {"r_regionkey": 0}, {"$set": {"r_name": "zero"}}), ("delete", {"r_regionkey": 2})])


@query("merge_stage", "select n_nationkey, case when n_regionkey = 1 then 'M' else n_name end n_name, n_regionkey from nation union all select 1000 + r_regionkey, r_name, null from region")
def _(c):
    c["target"] = c["nation"]
    aggregate("nation", [{"$match": {"n_regionkey": 1}}, {"$project": {"n_nationkey": 1, "n_name": {"$literal": "M"}}}, {"$merge": {"into": "target", "on": "n_nationkey"}}], c)
    aggregate("region", [{"$project": {"n_nationkey": {"$toInt": {"$add": [1000, "$r_regionkey"]}}, "n_name": "$r_name"}}, {"$merge": {"into": "target", "on": "n_nationkey"}}], c)
    return c["target"]


@query("out_stage", "select c_mktsegment _id, count(*) n from customer group by 1")
def _(c):
    aggregate("customer", [{"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}, {"$out": "segments"}], c)
    return c["segments"]


@query("dereference", "select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey")
def _(c):
    return dereference(c["customer"], "c_nationkey", c["nation"], "n_nationkey", "nation").select("c_custkey", "nation.n_name")


@query("jdql_group", "select o_orderpriority, count(*) as n, round_even(sum(o_totalprice), 1) as total from orders where o_totalprice between 1000 and 300000 and o_orderpriority like '%H%' group by 1 having count(*) > 3")
def _(c):
    out = jdql.run("SELECT o_orderpriority, COUNT(o_orderkey) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice BETWEEN :lo AND 300000 AND o_orderpriority LIKE '%H%' GROUP BY o_orderpriority HAVING COUNT(o_orderkey) > 3 ORDER BY n DESC", c, {"lo": 1000})
    return out.withColumn("total", F.bround("total", 1))


@query("jdql_select", "select c_custkey, c_name from customer where c_nationkey not in (1, 2) and (c_acctbal < 0 or c_mktsegment = 'BUILDING')")
def _(c):
    return jdql.run("SELECT c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (1, 2) AND (c_acctbal < 0 OR c_mktsegment = ?1)", c, ["BUILDING"])


@query("method_name", "select p_partkey, p_size, p_brand from part where (p_size > 40 and p_brand like 'Brand#1%') or p_size between 3 and 4")
def _(c):
    return run_method(c["part"], "findByP_sizeGreaterThanAndP_brandStartsWithOrP_sizeBetweenOrderByP_sizeDesc", 40, "Brand#1", 3, 4).select("p_partkey", "p_size", "p_brand")


@query("map_reduce", "select w as word, count(*) n from (select unnest(regexp_extract_all(text, '[^ \n]+')) w from documents) group by 1")
def _(c):
    from docmill.sources.udf import map_reduce

    return map_reduce(c["documents"].select("text"), _word_counts, _add_up, "word string, n bigint")


def _word_counts(row: dict):
    import re

    return [(w, 1) for w in re.findall("[^ \n]+", row["text"] or "")]


def _add_up(key, values):
    return sum(values)


@query("tumbling_window", "select time_bucket(interval 1 day, ts) window_start, event_type, count(*) n, round_even(sum(value), 3) total from events group by 1, 2")
def _(c):
    from docmill.streaming.windows import windowed

    out = windowed(c["events"], "ts", "1 day", {"n": {"$sum": 1}, "total": {"$sum": "$value"}}, {"event_type": "$event_type"})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.bround("total", 3).alias("total"))


@query("session_window", """with t as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 1 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end s from events),
       u as (select user_id, ts, sum(s) over (partition by user_id order by ts) k from t) select user_id, min(ts) window_start, count(*) n from u group by user_id, k""")
def _(c):
    from docmill.streaming.windows import sessions

    return sessions(c["events"], "ts", "1 hour", {"n": {"$sum": 1}}, {"user_id": "$user_id"}).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("change_diff", "select 'replace' op, count(*) n from nation where n_regionkey = 1 union all select 'delete', count(*) from nation where n_regionkey = 2")
def _(c):
    from docmill.streaming.changes import diff

    after = Find(Find("nation", c).f("n_regionkey").eq(1).update({"$set": {"n_name": "y"}})).f("n_regionkey").eq(2).delete()
    return diff(c["nation"], after, "n_nationkey").groupBy(F.col("operationType").alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("near_query", "select c_custkey from customer where 2 * 6371 * asin(sqrt(power(sin(radians(10 - c_nationkey) / 2), 2) + cos(radians(c_nationkey)) * cos(radians(10)) * power(sin(radians(20 - c_nationkey * 2) / 2), 2))) <= 700")
def _(c):
    pts = c["customer"].select("c_custkey", F.struct(F.lit("Point").alias("type"), F.array(F.col("c_nationkey").cast("double") * 2, F.col("c_nationkey").cast("double")).alias("coordinates")).alias("at"))
    return Find(pts).f("at").near({"$geometry": {"type": "Point", "coordinates": [20, 10]}, "$maxDistance": 700}).df().select("c_custkey")


@query("geo_within", "select c_custkey from customer where c_nationkey between 3 and 9 and c_custkey % 10 between 2 and 5")
def _(c):
    pts = c["customer"].select("c_custkey", F.array(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 10).cast("double")).alias("at"))
    return Find(pts).f("at").geo_within({"$box": [[3, 2], [9, 5]]}).df().select("c_custkey")
