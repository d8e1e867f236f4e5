"""More registered queries: whole families of operators, several to a query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F


from docmill.find import Find, bulk_write, dereference, update
from docmill.frontends import jdql
from docmill.frontends.methods import run_method
from docmill.frontends.repository import Repository
from docmill.functions.expr import FUNCTIONS
from docmill.operators.sinks import documents_frame
from docmill.pipeline import Aggregation, aggregate
from docmill.plans.catalogue import _r, _window, pipe, query

_W = "over (partition by user_id order by ts, event_id"
FUNCTIONS["twice"] = lambda x: x * 2

# -- scalar expressions ---------------------------------------------------------------
pipe("expr_logic", "orders",
     [{"$project": {"o_orderkey": 1, "a": {"$and": [{"$gt": ["$o_totalprice", 50000]}, {"$lte": ["$o_custkey", 90]}]}, "b": {"$or": [{"$eq": ["$o_orderstatus", "F"]}, {"$gte": ["$o_totalprice", 250000]}]}, "c": {"$ne": ["$o_orderstatus", "O"]},
                    "d": {"$toBool": "$o_custkey"}, "e": {"$toDouble": {"$toDecimal": "$o_totalprice"}}, "f": {"$isArray": [["$o_custkey"]]}, "g": {"$lt": [{"$rand": {}}, 1]}, "h": {"$ifNull": [{"$nullExpr": {}}, "$o_custkey"]}, "i": {"$sampleRate": 1.1}}}],
     "select o_orderkey, o_totalprice > 50000 and o_custkey <= 90 a, o_orderstatus = 'F' or o_totalprice >= 250000 b, o_orderstatus <> 'O' c, o_custkey <> 0 d, o_totalprice e, true f, true g, o_custkey h, true i from orders")
pipe("expr_math_more", "part",
     [{"$project": {"p_partkey": 1, "a": {"$pow": ["$p_size", 2]}, "b": _r({"$exp": {"$divide": ["$p_size", 25]}}, 6), "c": _r({"$ln": "$p_size"}, 8), "d": _r({"$acosh": {"$add": ["$p_size", 1]}}, 8), "e": _r({"$degreesToRadian": "$p_size"}, 8), "f": _r({"$log10": "$p_retailprice"}, 8),
                    "g": {"$floor": {"$divide": ["$p_retailprice", 7]}}, "h": {"$round": ["$p_retailprice", 1]}, "i": {"$trunc": {"$multiply": ["$p_retailprice", -1]}}}}],
     "select p_partkey, power(p_size, 2) a, round_even(exp(p_size / 25), 6) b, round_even(ln(p_size), 8) c, round_even(acosh(p_size + 1), 8) d, round_even(radians(p_size), 8) e, round_even(log10(p_retailprice), 8) f, cast(floor(p_retailprice / 7) as bigint) g, round_even(p_retailprice, 1) h, trunc(-p_retailprice) i from part")
pipe("expr_arrays_more", "nation",
     [{"$addFields": {"l": {"$concatArrays": [["$n_nationkey", "$n_regionkey"], [7, 3]]}}},
      {"$project": {"n_nationkey": 1, "a": {"$sum": {"$map": {"input": "$l", "as": "x", "in": {"$multiply": ["$$x", 2]}}}}, "b": {"$first": {"$reverseArray": "$l"}}, "c": {"$sum": {"$slice": ["$l", 1, 2]}}, "d": {"$arrayElemAt": [{"$sortArray": {"input": "$l", "sortBy": -1}}, 0]},
                    "e": {"$sum": {"$firstN": {"input": "$l", "n": 2}}}, "f": {"$sum": {"$lastN": {"input": "$l", "n": 3}}}, "g": {"$arrayElemAt": [{"$minN": {"input": "$l", "n": 2}}, 1]}, "h": {"$size": {"$zip": {"inputs": ["$l", [1, 2]]}}}, "i": {"$anyElementTrue": [[{"$gt": ["$n_nationkey", 20]}, {"$eq": ["$n_regionkey", 1]}]]},
                    "j": {"$slice": ["$l", -1]}, "k": {"$arrayElemAt": [{"$arrayElemAt": [{"$zip": {"inputs": ["$l", [1, 2]]}}, 1]}, 0]}}},
      {"$addFields": {"j": {"$first": "$j"}}}],
     """with t as (select n_nationkey, n_regionkey, [n_nationkey, n_regionkey, 7, 3] l from nation) select n_nationkey, cast(2 * list_sum(l) as double) a, 3 b, cast(n_regionkey + 7 as double) c, greatest(n_nationkey, n_regionkey, 7) d, cast(n_nationkey + n_regionkey as double) e,
        cast(n_regionkey + 10 as double) f, list_sort(l)[2] g, 2 h, n_nationkey > 20 or n_regionkey = 1 i, 3 j, n_regionkey k from t""")  # fmt: skip
pipe("expr_array_statistics", "nation",
     [{"$addFields": {"l": ["$n_nationkey", "$n_regionkey", 7, 4]}},
      {"$project": {"n_nationkey": 1, "a": _r({"$avg": "$l"}, 6), "b": {"$min": "$l"}, "c": {"$max": ["$n_nationkey", 5]}, "d": _r({"$stdDevPop": "$l"}, 6), "e": _r({"$stdDevSamp": "$l"}, 6), "f": {"$median": {"input": "$l", "method": "approximate"}}, "g": {"$first": {"$percentile": {"input": "$l", "p": [0.75], "method": "approximate"}}}, "h": {"$sum": ["$n_nationkey", "$n_regionkey"]}}}],
     """with t as (select n_nationkey, n_regionkey, [n_nationkey, n_regionkey, 7, 4] l from nation) select n_nationkey, round_even(list_avg(l), 6) a, list_min(l) b, greatest(n_nationkey, 5) c, round_even(list_stddev_pop(l), 6) d, round_even(list_stddev_samp(l), 6) e,
        list_sort(l)[2] f, list_sort(l)[3] g, cast(n_nationkey + n_regionkey as double) h from t""")  # fmt: skip
pipe("expr_strings_more", "documents",
     [{"$project": {"doc_id": 1, "a": {"$indexOfBytes": ["$text", "the"]}, "b": {"$strLenCP": {"$ltrim": {"input": "$text", "chars": "abcdefgh "}}}, "c": {"$strLenCP": {"$rtrim": {"input": "$text", "chars": ". "}}}, "d": {"$toLower": {"$substr": ["$text", 3, 12]}}, "e": {"$substrBytes": ["$source", 1, 3]},
                    "f": {"$strLenBytes": "$text"}, "g": {"$regexMatch": {"input": "$text", "regex": {"$regex": "x"} and "[0-9]{2}"}}, "h": {"$size": {"$split": ["$text", "."]}}}}],
     "select doc_id, cast(case when contains(text, 'the') then strlen(split_part(text, 'the', 1)) else -1 end as int) a, cast(length(ltrim(text, 'abcdefgh ')) as int) b, cast(length(rtrim(text, '. ')) as int) c, lower(substr(text, 4, 12)) d, substr(source, 2, 3) e, cast(strlen(text) as int) f, regexp_matches(text, '[0-9]{2}') g, cast(len(string_split(text, '.')) as int) h from documents")
pipe("expr_dates_more", "events",
     [{"$project": {"event_id": 1, "p": {"$dateToParts": {"date": "$ts"}}, "q": {"$dateToParts": {"date": "$ts", "iso8601": True}}, "ms": {"$millisecond": "$ts"}, "w": {"$week": "$ts"}, "f": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$ts", "format": "%Y-%m-%d %H:%M"}}, "format": "%Y-%m-%d %H:%M"}},
                    "i": {"$isoDateFromParts": {"isoWeekYear": {"$isoWeekYear": "$ts"}, "isoWeek": {"$isoWeek": "$ts"}, "isoDayOfWeek": {"$isoDayOfWeek": "$ts"}}}, "z": {"$hour": {"date": "$ts", "timezone": "Asia/Tokyo"}}, "q4": {"$dateTrunc": {"date": "$ts", "unit": "quarter"}}}},
      {"$project": {"event_id": 1, "ms": 1, "w": 1, "f": 1, "i": 1, "z": 1, "q4": 1, "d": "$p.day", "mi": "$p.minute", "iw": "$q.isoWeek", "id": "$q.isoDayOfWeek"}}],
     """select event_id, cast(extract(millisecond from ts) as int) % 1000 ms, cast(strftime(ts, '%U') as int) w, date_trunc('minute', ts) f, cast(date_trunc('day', ts) as timestamp) i, cast(hour(ts + interval 9 hour) as int) z, cast(date_trunc('quarter', ts) as timestamp) q4,
        cast(day(ts) as int) d, cast(minute(ts) as int) mi, cast(week(ts) as int) iw, cast(isodow(ts) as int) id from events""")  # fmt: skip
pipe("expr_literals", "region",
     [{"$project": {"r_regionkey": 1, "a": {"$intExpr": 4}, "b": {"$doubleExpr": 2.5}, "c": {"$string": "s"}, "d": {"$bool": True}, "e": {"$year": {"$date": dt.datetime(2020, 5, 6)}}, "f": {"$gt": [{"$year": "$$NOW"}, 2000]}, "g": {"$size": {"$arrayExpr": ["$r_regionkey", 2]}}, "m": {"$mapExpr": {"k": "$r_name"}}, "n": {"$doc": {"x": 5}},
                    "h": {"$field": "r_name"}, "i": {"$parse": {"$add": ["$r_regionkey", 1]}}, "j": {"$expr": {"$multiply": ["$r_regionkey", 3]}}, "k": {"$match": {"r_regionkey": {"$gte": 2}}}, "o": {"$project": {"r_name": 1}}, "l": {"$function": {"body": "twice", "args": ["$r_regionkey"], "lang": "py"}}, "now": {"$gt": [{"$now": {}}, dt.datetime(2001, 1, 1)]}}},
      {"$project": {"r_regionkey": 1, "a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, "i": 1, "j": 1, "k": 1, "l": 1, "now": 1, "m": "$m.k", "n": "$n.x", "o": "$o.r_name"}}],
     "select r_regionkey, 4 a, 2.5::double b, 's' c, true d, 2020 e, true f, 2 g, r_name h, r_regionkey + 1 i, r_regionkey * 3 j, r_regionkey >= 2 k, r_regionkey * 2 l, true now, r_name m, 5 n, r_name o from region")
pipe("expr_objects_more", "nation",
     [{"$project": {"n_nationkey": 1, "m": {"$arrayToObject": [[{"k": "key", "v": "$n_nationkey"}, {"k": "reg", "v": "$n_regionkey"}]]}, "s": {"$binarySize": "$n_name"}, "o": {"$toObjectId": "5ab9cbfa31c2ab715d42129e"}, "t": {"$year": {"$toDate": "5ab9cbfa31c2ab715d42129e"}}, "b": {"$gt": [{"$bsonSize": {"a": "$n_name"}}, 5]}}},
      {"$project": {"n_nationkey": 1, "s": 1, "o": 1, "t": 1, "b": 1, "r": "$m.reg"}}],
     "select n_nationkey, cast(strlen(n_name) as int) s, '5ab9cbfa31c2ab715d42129e' o, 2018 t, true b, n_regionkey r from nation")

# -- predicates -----------------------------------------------------------------------
pipe("match_exists_type", "events", [{"$match": {"value": {"$exists": True, "$type": "double"}, "missing": {"$exists": False}, "event_type": {"$type": ["string", "null"]}, "$comment": "all of them"}}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}}}], "select event_type _id, count(*) n from events where value is not null group by 1")
pipe("match_bits_any", "orders", [{"$match": {"o_orderkey": {"$bitsAnySet": [0, 3], "$bitsAnyClear": 6}}}, {"$project": {"o_orderkey": 1}}], "select o_orderkey from orders where (o_orderkey & 9) <> 0 and (o_orderkey & 6) <> 6")
pipe("match_regex_options", "documents", [{"$match": {"text": {"$regex": "^the .*  # a comment\n \\.$", "$options": "imx"}}}, {"$project": {"doc_id": 1}}], "select doc_id from documents where regexp_matches(text, '(?im)^the.*\\.$')")
pipe("match_all_in_array", "documents", [{"$project": {"doc_id": 1, "w": {"$split": ["$text", " "]}}}, {"$match": {"w": {"$all": ["the", "of"]}}}, {"$project": {"doc_id": 1}}], "select doc_id from documents where list_contains(string_split(text, ' '), 'the') and list_contains(string_split(text, ' '), 'of')")


@query("match_where", "select count(*) n from orders where o_totalprice > 1000 * o_custkey")
def _(c):
    orders = c["orders"].select("o_custkey", "o_totalprice")
    return aggregate(orders, [{"$match": {"$where": lambda k, p: p > k * 1000}}, {"$count": "n"}], c)


def _points(c):
    return c["customer"].select("c_custkey", F.struct(F.lit("Point").alias("type"), F.array(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 50).cast("double")).alias("coordinates")).alias("at"))


@query("geo_shapes", """with t as (select c_custkey, c_nationkey * 1.0 x, c_custkey % 50 * 1.0 y from customer)
       select c_custkey, (x - 10) ** 2 + (y - 20) ** 2 <= 36 center, 2 * 6371 * asin(sqrt(power(sin(radians(20 - y) / 2), 2) + cos(radians(y)) * cos(radians(20)) * power(sin(radians(10 - x) / 2), 2))) <= 0.1 * 6371 sphere,
       x >= 0.5 and x < 20.5 and y >= 0.5 and y < 20.5 and x > y polygon from t""")
def _(c):
    out = _points(c)
    for name, shape in (("center", {"$center": [[10, 20], 6]}), ("sphere", {"$centerSphere": [[10, 20], 0.1]}), ("polygon", {"$polygon": [[0.5, 0.2], [20.5, 0.2], [20.5, 20.2]]})):
        out = aggregate(out, [{"$addFields": {name: {"$match": {"at": {"$geoWithin": shape}}}}}], c)
    return out.drop("at")


@query("geo_intersects", "select c_custkey from customer where c_nationkey between 3 and 9 and c_custkey % 50 between 2 and 15")
def _(c):
    box = {"type": "Polygon", "coordinates": [[[2.5, 1.5], [9.5, 1.5], [9.5, 15.5], [2.5, 15.5], [2.5, 1.5]]]}
    return Find(_points(c)).f("at").geo_intersects({"$geometry": box}).df().select("c_custkey")


_KM = "2 * 6371 * asin(sqrt(power(sin(radians(10 - c_custkey % 50) / 2), 2) + cos(radians(c_custkey % 50)) * cos(radians(10)) * power(sin(radians(20 - c_nationkey) / 2), 2)))"


@query("geo_near", f"select c_custkey, round_even({_KM}, 6) km from customer where {_KM} between 100 and 900")
def _(c):
    near = {"near": {"type": "Point", "coordinates": [20, 10]}, "key": "at", "distanceField": "km", "minDistance": 100, "maxDistance": 900}
    return aggregate(_points(c), [{"$geoNear": near}, {"$project": {"c_custkey": 1, "km": _r("$km", 6)}}], c)


@query("near_sphere", f"select c_custkey from customer where {_KM} <= 700")
def _(c):
    return Find(_points(c)).f("at").near_sphere({"$geometry": {"type": "Point", "coordinates": [20, 10]}, "$maxDistance": 700}).df().select("c_custkey")


@query("collation", "select c_custkey from customer where lower(c_mktsegment) = 'building'")
def _(c):
    return Find("customer", c).where({"c_mktsegment": "bUiLdInG"}).collation({"locale": "en", "strength": 2}).project("c_custkey").df()


# -- grouping -------------------------------------------------------------------------
pipe("group_n", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_orderpriority", "f": {"$firstN": {"input": "$o_orderkey", "n": 3}}, "l": {"$lastN": {"input": "$o_orderkey", "n": 3}}, "m": {"$minN": {"input": "$o_totalprice", "n": 2}}, "b": {"$bottomN": {"output": "$o_orderkey", "sortBy": {"o_totalprice": 1, "o_orderkey": 1}, "n": 2}}}},
     {"$project": {"f": {"$arrayElemAt": ["$f", 2]}, "l": {"$arrayElemAt": ["$l", 0]}, "m": {"$arrayElemAt": ["$m", 1]}, "b": {"$arrayElemAt": ["$b", 0]}}}],
     "select o_orderpriority _id, (list(o_orderkey order by o_orderdate, o_orderkey))[3] f, (list(o_orderkey order by o_orderdate desc, o_orderkey desc))[3] l, (list(o_totalprice order by o_totalprice))[2] m, (list(o_orderkey order by o_totalprice desc, o_orderkey desc))[2] b from orders group by 1")
pipe("group_merge_objects", "orders", [{"$sort": {"o_orderkey": 1}}, {"$addFields": {"d": {"p": "$o_orderpriority", "k": "$o_orderkey"}}}, {"$group": {"_id": "$o_custkey", "d": {"$mergeObjects": "$d"}}}, {"$project": {"p": "$d.p", "k": "$d.k"}}],
     "select o_custkey _id, arg_max(o_orderpriority, o_orderkey) p, max(o_orderkey) k from orders group by 1")
pipe("bucket_outputs", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20, 60], "output": {"a": {"$avg": "$p_retailprice"}, "lo": {"$min": "$p_retailprice"}, "s": {"$addToSet": "$p_brand"}, "sd": {"$stdDevPop": "$p_retailprice"}}}}, {"$project": {"a": _r("$a", 4), "lo": 1, "s": {"$size": "$s"}, "sd": _r("$sd", 4)}}],
     "select case when p_size < 10 then 0 when p_size < 20 then 10 else 20 end _id, round_even(avg(p_retailprice), 4) a, min(p_retailprice) lo, cast(count(distinct p_brand) as int) s, round_even(stddev_pop(p_retailprice), 4) sd from part group by 1")


@query("group_accumulator", "select o_orderpriority _id, cast(sum(o_custkey % 7) as double) s from orders group by 1")
def _(c):
    from docmill.sources.udf import register_accumulator

    register_accumulator("sum_of_sevenths", lambda state, x: state + x % 7, lambda: 0.0)
    return aggregate("orders", [{"$group": {"_id": "$o_orderpriority", "s": {"$accumulator": {"function": "sum_of_sevenths", "args": ["$o_custkey"]}}}}], c)


# -- windows and series -----------------------------------------------------------------
pipe("window_sets", "events", _window({"s": {"$addToSet": "$event_type", "window": {"documents": [-4, 0]}}, "f": {"$firstN": {"input": "$event_id", "n": 2}, "window": {"documents": [-3, 1]}}, "l": {"$lastN": {"input": "$event_id", "n": 2}, "window": {"documents": [-3, 1]}}, "x": {"$maxN": {"input": "$value", "n": 2}, "window": {"documents": [-3, 1]}}}, [], extra={"s": {"$size": "$s"}, "f": {"$last": "$f"}, "l": {"$first": "$l"}, "x": {"$arrayElemAt": ["$x", -1]}}),
     f"with t as (select event_id, list(event_type) {_W} rows between 4 preceding and current row) s, list(event_id) {_W} rows between 3 preceding and 1 following) e, list(value) {_W} rows between 3 preceding and 1 following) v from events) select event_id, cast(len(list_distinct(s)) as int) s, e[least(2, len(e))] f, e[greatest(len(e) - 1, 1)] l, list_reverse_sort(v)[least(2, len(v))] x from t")
pipe("window_tops", "events", _window({"t": {"$top": {"output": "$event_id", "sortBy": {"value": -1, "event_id": 1}}, "window": {"documents": [-5, 0]}}, "b": {"$bottom": {"output": "$event_id", "sortBy": {"value": -1, "event_id": 1}}, "window": {"documents": [-5, 0]}}, "n": {"$topN": {"output": "$event_id", "sortBy": {"value": 1, "event_id": 1}, "n": 2}, "window": {"documents": [-5, 0]}}, "m": {"$bottomN": {"output": "$event_id", "sortBy": {"value": 1, "event_id": 1}, "n": 2}, "window": {"documents": [-5, 0]}}}, ["t", "b"], extra={"n": {"$last": "$n"}, "m": {"$last": "$m"}}),
     f"with t as (select event_id, list({{'v': value, 'e': event_id}}) {_W} rows between 5 preceding and current row) l from events), u as (select event_id, list_sort(l) up, list_sort(list_transform(l, lambda x: {{'v': -x.v, 'e': x.e}})) down from t) select event_id, down[1].e t, down[-1].e b, up[least(2, len(up))].e n, up[-1].e m from u")
pipe("window_numeric_range", "orders", [{"$setWindowFields": {"partitionBy": "$o_orderpriority", "sortBy": {"o_custkey": 1}, "output": {"n": {"$count": {}, "window": {"range": [-5, 5]}}, "lo": {"$min": "$o_totalprice", "window": {"range": [-5, 5]}}}}}, {"$project": {"o_orderkey": 1, "n": 1, "lo": 1}}],
     "select o_orderkey, count(*) over w n, min(o_totalprice) over w lo from orders window w as (partition by o_orderpriority order by o_custkey range between 5 preceding and 5 following)")
pipe("window_samples", "events", _window({"cs": {"$covarianceSamp": ["$event_id", "$value"]}, "ss": {"$stdDevSamp": "$value"}, "lo": {"$min": "$value", "window": {"documents": [-2, 2]}}, "md": {"$median": {"input": "$value", "method": "approximate"}, "window": {"documents": [-2, 2]}}, "pc": {"$percentile": {"input": "$value", "p": [0.8], "method": "approximate"}, "window": {"documents": [-4, 0]}}}, ["lo", "md"], extra={"cs": _r("$cs", 1), "ss": _r("$ss", 4), "pc": {"$first": "$pc"}}),
     f"with t as (select event_id, round_even(covar_samp(event_id, value) over (partition by user_id), 1) cs, round_even(stddev_samp(value) over (partition by user_id), 4) ss, list(value) {_W} rows between 2 preceding and 2 following) l, list(value) {_W} rows between 4 preceding and current row) k from events) select event_id, cs, ss, list_min(l) lo, list_sort(l)[cast(ceil(0.5 * len(l)) as int)] md, list_sort(k)[cast(ceil(0.8 * len(k)) as int)] pc from t")
_SPARSE = [{"$addFields": {"v": {"$cond": [{"$eq": ["$event_type", "purchase"]}, "$value", None]}}}]
pipe("window_linear_fill", "events", _SPARSE + [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"f": {"$linearFill": "$v"}}}}, {"$project": {"event_id": 1, "f": _r("$f", 5)}}],
     """with t as (select event_id, user_id, case when event_type = 'purchase' then value end v, case when event_type = 'purchase' then event_id end k from events),
        u as (select event_id, v, last_value(v ignore nulls) over p x0, last_value(k ignore nulls) over p k0, first_value(v ignore nulls) over n x1, first_value(k ignore nulls) over n k1 from t
              window p as (partition by user_id order by event_id rows between unbounded preceding and current row), n as (partition by user_id order by event_id rows between current row and unbounded following))
        select event_id, round_even(coalesce(v, x0 + (x1 - x0) * (event_id - k0) / (k1 - k0)), 5) f from u""")  # fmt: skip
pipe("fill_locf", "events", _SPARSE + [{"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": {"method": "locf"}}}}, {"$project": {"event_id": 1, "v": 1}}],
     "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) v from events")
pipe("densify_months", "orders", [{"$group": {"_id": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "n": {"$sum": 1}}}, {"$densify": {"field": "_id", "range": {"step": 1, "unit": "month", "bounds": [dt.datetime(1990, 1, 1), dt.datetime(2001, 1, 1)]}}}, {"$fill": {"output": {"n": {"value": 0}}}}],
     "with t as (select cast(date_trunc('month', o_orderdate) as timestamp) m, count(*) n from orders group by 1), g as (select unnest(generate_series(timestamp '1990-01-01', timestamp '2000-12-01', interval 1 month)) m) select m _id, coalesce(n, 0) n from g full join t using (m)")

# -- joins ------------------------------------------------------------------------------
pipe("lookup_array_field", "region", [{"$addFields": {"ks": ["$r_regionkey", {"$add": ["$r_regionkey", 1]}]}}, {"$lookup": {"from": "nation", "localField": "ks", "foreignField": "n_regionkey", "as": "m"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$m"}}}],
     "select r_regionkey, cast((select count(*) from nation where n_regionkey in (r_regionkey, r_regionkey + 1)) as int) n from region")


@query("graph_lookup_restricted", """with recursive e as (select n_nationkey k, n_nationkey // 2 p, n_regionkey g from nation), r as (select k root, p cur from e union select r.root, e.p from r join e on e.k = r.cur where e.g <> 2)
       select root n_nationkey, cast(count(distinct k) filter (where g <> 2) as int) n from r join e on e.k = r.cur group by 1""")
def _(c):
    c["tree"] = c["nation"].select("n_nationkey", "n_regionkey", F.floor(F.col("n_nationkey") / 2).cast("int").alias("parent"))
    spec = {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "n_nationkey", "as": "up", "restrictSearchWithMatch": {"n_regionkey": {"$ne": 2}}}
    return Aggregation("tree", c).graph_lookup(spec).project({"n_nationkey": 1, "n": {"$size": "$up"}}).df()


@query("dereference_list", "select r_regionkey, cast(count(n_name) as int) n, min(n_name) least from region left join nation on n_nationkey in (r_regionkey, r_regionkey * 3) group by 1")
def _(c):
    rows = c["region"].select("r_regionkey", F.array_distinct(F.array("r_regionkey", F.col("r_regionkey") * 3)).alias("refs"))
    out = dereference(rows, "refs", c["nation"], "n_nationkey", "docs")
    return out.select("r_regionkey", F.size("docs").alias("n"), F.array_min(F.transform("docs", lambda d: d["n_name"])).alias("least"))


# -- updates ------------------------------------------------------------------------------
@query("update_scalars", "select n_nationkey * case when n_regionkey = 1 then 3 else 1 end n_nationkey, case when n_regionkey = 1 then null else n_name end label, case when n_regionkey = 1 then 0 else n_regionkey end as n_regionkey, case when n_regionkey = 1 then 12 else 8 end bits, case when n_regionkey = 1 then 9 else 7 end top from nation")
def _(c):
    rows = c["nation"].withColumns({"label": F.col("n_name"), "bits": F.lit(8), "top": F.lit(7)}).drop("n_name")
    return update(rows, {"n_regionkey": 1}, {"$mul": {"n_nationkey": 3}, "$unset": {"label": ""}, "$bit": {"bits": {"or": 4}}, "$max": {"top": 9}, "$min": {"n_regionkey": 0}})


@query("update_rename_date", "select n_nationkey, case when n_nationkey < 5 then n_name end moved, case when n_nationkey >= 5 then n_name end n_name, n_nationkey < 5 stamped from nation")
def _(c):
    rows = c["nation"].withColumns({"moved": F.lit(None).cast("string"), "at": F.lit("1999-01-01").cast("timestamp")}).drop("n_regionkey")
    out = update(rows, {"n_nationkey": {"$lt": 5}}, {"$rename": {"n_name": "moved"}, "$currentDate": {"at": True}})
    return out.withColumn("stamped", F.col("at") > "2000-01-01").drop("at")


@query("update_array_operators", """with t as (select n_regionkey k, list_sort(list(n_nationkey)) l from nation group by 1)
       select k, cast(len(list_filter(l, lambda x: x not in (3, 4))) as int) pulled, cast(l[2] as bigint) popped, cast(list_sum(list_transform(l, lambda x: x + case when x > 10 then 100 else 0 end)) as bigint) certain, cast(list_sum(l) + len(l) as bigint) every, cast(len(l) + 2 as int) added from t""")
def _(c):
    rows = c["nation"].groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("l"))
    rows = rows.withColumns({n: F.col("l") for n in ("pulled", "popped", "certain", "every", "added")}).drop("l")
    out = update(rows, {}, {"$pullAll": {"pulled": [3, 4]}, "$pop": {"popped": -1}, "$inc": {"certain.$[big]": 100, "every.$[]": 1}, "$addToSet": {"added": {"$each": [77, 78, 77]}}}, [{"big": {"$gt": 10}}])
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.select("k", F.size("pulled").alias("pulled"), F.get("popped", F.lit(0)).alias("popped"), total("certain").alias("certain"), total("every").alias("every"), F.size("added").alias("added"))


@query("update_positional", "with t as (select n_regionkey k, list_sort(list(n_nationkey)) l from nation group by 1) select k, cast(list_sum(l) - coalesce(list_filter(l, lambda x: x >= 8)[1], 0) as bigint) s from t")
def _(c):
    rows = c["nation"].groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("l"))
    out = update(rows, {"l": {"$gte": 8}}, {"$set": {"l.$": 0}})
    return out.select("k", F.aggregate("l", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("s"))


@query("update_upsert", "select r_regionkey, r_name, 0 as n from region union all select 99, 'fresh', 3")
def _(c):
    rows = c["region"].withColumn("n", F.lit(0))
    return Find(rows).f("r_regionkey").eq(99).update({"$set": {"r_name": "fresh"}, "$inc": {"n": 3}}, upsert=True)


@query("find_one_and_change", "select n_nationkey, case when n_nationkey = 24 then 'last' else n_name end n_name from nation where n_nationkey <> (select min(n_nationkey) from nation where n_regionkey = 1)")
def _(c):
    rows = c["nation"].select("n_nationkey", "n_name", "n_regionkey")
    _, left = Find(rows).f("n_regionkey").eq(1).sort("n_nationkey").find_one_and_delete()
    _, out = Find(left).f("n_nationkey").gte(0).sort("-n_nationkey").find_one_and_update({"$set": {"n_name": "last"}})
    return out.drop("n_regionkey")


@query("store_and_remove", "select r_regionkey, case when r_regionkey = 1 then 'stored' else r_name end r_name from region where r_regionkey <> 3 union all select 50, 'added'")
def _(c):
    repository = Repository(c, "regions", "r_regionkey")
    c["regions"] = c["region"]
    new = lambda k, n: documents_frame(c.spark, [{"r_regionkey": k, "r_name": n}]).select(F.col("r_regionkey").cast("int"), "r_name")
    repository.save(new(1, "stored"))
    repository.insert(new(50, "added"))
    repository.deleteByR_regionkey(3)
    return repository.all()


# -- find and front ends ------------------------------------------------------------------
@query("find_page", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 12 offset 24")
def _(c):
    return Find("orders", c).sort("-o_totalprice", "o_orderkey").page(3, 12).select("o_orderkey")


@query("find_or_nor", "select p_partkey from part where (p_size < 5 or p_brand = 'Brand#11') and not (p_retailprice > 1500 or p_type like 'SMALL%')")
def _(c):
    part = lambda: Find("part", c)
    return part().or_(part().f("p_size").lt(5), part().f("p_brand").eq("Brand#11")).nor(part().f("p_retailprice").gt(1500), part().f("p_type").regex("^SMALL")).df().select("p_partkey")


@query("jdql_statistics", "select min(o_totalprice) lo, max(o_totalprice) hi, round_even(avg(o_custkey), 4) as mean, count(*) n from orders where o_orderpriority is not null and not (o_orderstatus = 'P')")
def _(c):
    out = jdql.run("SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, AVG(o_custkey) AS mean, COUNT(o_orderkey) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND NOT (o_orderstatus = 'P')", c)
    return out.withColumn("mean", F.bround("mean", 4))


@query("jdql_empty", "select 0.0::double total, 0.0::double lo, 0::bigint n")
def _(c):
    return jdql.run("SELECT SUM(o_totalprice) AS total, MIN(o_totalprice) AS lo, COUNT(o_orderkey) AS n FROM orders WHERE o_totalprice < 0", c)


@query("method_endings", """select 'ends' as kind, count(*) n from part where p_type like '%BRASS' or p_type like '%STEEL' union all select 'contains', count(*) from part where p_type like '%PLATED%' union all select 'not', count(*) from part where p_brand <> 'Brand#11'
       union all select 'in', count(*) from part where p_size in (1, 2, 3) union all select 'case', count(*) from part where lower(p_brand) = 'brand#12' union all select 'less', count(*) from part where p_size <= 10 and p_retailprice < 1200 union all select 'null', count(*) from part where p_name is null""")
def _(c):
    part, rows = c["part"], None
    calls = {"ends": ("findByP_typeEndsWithOrP_typeEndsWith", "BRASS", "STEEL"), "contains": ("findByP_typeContains", "PLATED"), "not": ("findByP_brandNot", "Brand#11"), "in": ("findByP_sizeIn", [1, 2, 3]), "case": ("findByP_brandIgnoreCase", "BRAND#12"), "less": ("findByP_sizeLessThanEqualAndP_retailpriceLessThan", 10, 1200), "null": ("findByP_nameNull",)}
    for kind, call in calls.items():
        row = run_method(part, *call).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        rows = row if rows is None else rows.unionAll(row)
    return rows


@query("bulk_write_mixed", "select r_regionkey, case when r_regionkey = 0 then 'a' when r_regionkey = 4 then 'b' else r_name end r_name from region where r_regionkey not in (1, 2)")
def _(c):
    return bulk_write(c["region"], [("update", {"r_regionkey": 0}, {"$set": {"r_name": "a"}}), ("delete", {"r_regionkey": {"$in": [1, 2]}}), ("update", {"r_regionkey": {"$gte": 4}}, {"$set": {"r_name": "b"}})])


@query("bulk_write_modes", """select * from (select n_nationkey, case when n_nationkey = 3 then 'one' when n_nationkey = 5 then 'replaced' when n_regionkey = 4 then 'many' else n_name end n_name, case when n_nationkey = 5 then null else n_regionkey end n_regionkey from nation)
       where n_nationkey <> (select max(n_nationkey) from nation where n_regionkey = 2) union all select 70, 'upserted', null""")
def _(c):
    return bulk_write(c["nation"], [
        ("update_many", {"n_regionkey": 4}, {"$set": {"n_name": "many"}}), ("update_one", {"n_nationkey": {"$gte": 3}}, {"$set": {"n_name": "one"}}, {"sort": {"n_nationkey": 1}}), ("replace_one", {"n_nationkey": 5}, {"n_name": "replaced"}),
        ("delete_one", {"n_regionkey": 2}, {"sort": {"n_nationkey": -1}}), ("update_one", {"n_nationkey": 70}, {"$set": {"n_name": "upserted"}}, {"upsert": True}),
    ])


# -- sources --------------------------------------------------------------------------------
@query("round_trip_formats", "select 'json' as format, count(*) n, cast(sum(n_nationkey) as bigint) s from nation union all select 'csv', count(*), cast(sum(n_nationkey) as bigint) from nation union all select 'orc', count(*), cast(sum(n_nationkey) as bigint) from nation union all select 'dump', count(*), cast(sum(n_nationkey) as bigint) from nation")
def _(c):
    import uuid

    from docmill.catalog import Catalog
    from docmill.sources.io import read, write
    from docmill.storage import shared_dir

    base, nation, out = f"{shared_dir(c.spark)}/formats-{uuid.uuid4().hex}", c["nation"], None
    for kind in ("json", "csv", "orc", "dump"):
        if kind == "dump":
            Catalog(c.spark, {"nation": nation}).dump(f"{base}/dump")
            back = Catalog.restore(c.spark, f"{base}/dump", ["nation"])["nation"]
        else:
            write(nation, f"{base}/{kind}", kind)
            back = read(c.spark, f"{base}/{kind}", kind, nation.schema)
        row = back.agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("s")).select(F.lit(kind).alias("format"), "n", "s")
        out = row if out is None else out.unionAll(row)
    return out


@query("sequence_numbers", "select o_orderkey, 100 + 5 * (row_number() over (order by o_orderdate, o_orderkey) - 1) seq from orders")
def _(c):
    from docmill.sources.io import sequenced

    return sequenced(c["orders"].select("o_orderkey", "o_orderdate"), "seq", ["o_orderdate", "o_orderkey"], 100, 5).select("o_orderkey", "seq")


@query("stamped_versions", "select n_nationkey, 1 v, true fresh from nation")
def _(c):
    from docmill.sources.io import stamped

    out = stamped(c["nation"], "created", "changed", "v")
    return out.select("n_nationkey", "v", (F.col("changed") >= F.col("created")).alias("fresh"))


@query("capped", "select event_id from events order by ts desc limit 40")
def _(c):
    from docmill.sources.io import capped

    return capped(c["events"], "ts", 40).select("event_id")


@query("unexpired", "select count(*) n from events")
def _(c):
    c["sessions"] = c["events"].withColumn("ts", F.when(F.col("ts").isNotNull(), F.current_timestamp())).unionAll(c["events"].withColumn("ts", F.lit("2001-01-01").cast("timestamp")))
    return c.expire("sessions", "ts", 3600).agg(F.count(F.lit(1)).alias("n"))


# -- streams ----------------------------------------------------------------------------------
def _streamed(c, out, name: str, mode: str):
    """A stream run to its end into a table in memory."""
    import uuid

    table = f"{name}_{uuid.uuid4().hex}"
    started = out.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start()
    started.awaitTermination()
    if started.exception():
        raise started.exception()
    return c.spark.table(table)


def _event_stream(c):
    return c.spark.readStream.schema(c["events"].schema).parquet(f"{c.directory}/events.parquet*")


@query("stream_tumbling", "select time_bucket(interval 1 day, ts) window_start, event_type, count(*) n from events group by 1, 2")
def _(c):
    from docmill.streaming.windows import windowed

    out = windowed(_event_stream(c), "ts", "1 day", {"n": {"$sum": 1}}, {"event_type": "$event_type"})
    return _streamed(c, out, "tumbling", "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("sliding_window", "with t as (select time_bucket(interval 6 hour, ts) b, value from events) select b - to_hours(6 * cast(k as int)) window_start, count(*) n from t, range(4) r(k) group by 1")
def _(c):
    from docmill.streaming.windows import windowed

    out = windowed(c["events"], "ts", "1 day", {"n": {"$sum": 1}}, {}, slide="6 hours")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("stream_pipeline", "select event_type, round_even(sum(value), 2) total from events where value > 50 group by 1")
def _(c):
    out = aggregate(_event_stream(c), [{"$match": {"value": {"$gt": 50}}}, {"$project": {"event_type": 1, "value": 1}}], c)
    return _streamed(c, out, "filtered", "append").groupBy("event_type").agg(F.bround(F.sum("value"), 2).alias("total"))


@query("change_pipeline", "select n_nationkey k from nation where n_regionkey = 1 and n_nationkey > 2")
def _(c):
    import uuid

    from docmill.storage import shared_dir
    from docmill.streaming.changes import diff, watch

    nation = c["nation"].withColumnRenamed("n_nationkey", "_id")
    after = Find(nation).f("n_regionkey").eq(1).update({"$set": {"n_name": "y"}})
    log = f"{shared_dir(c.spark)}/log-{uuid.uuid4().hex}"
    diff(nation, after).write.parquet(log)
    stream = watch(c.spark, log, nation.schema, [{"$match": {"operationType": "replace", "fullDocument._id": {"$gt": 2}}}])
    return _streamed(c, stream, "changes", "append").select(F.col("fullDocument._id").alias("k"))
