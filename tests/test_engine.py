"""Semantics on small documents: nulls, missing fields, arrays, windows, updates."""

import datetime as dt

import pytest

from docmill.catalog import Catalog
from docmill.find import Find, update
from docmill.frontends import jdql
from docmill.frontends.methods import parse_method
from docmill.functions.paths import UnsupportedOperator
from docmill.pipeline import Aggregation, aggregate, from_documents


def rows(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def items(spark):
    return from_documents(spark, [{"_id": 1, "a": 5, "s": "Abc", "tags": ["x", "y"]}, {"_id": 2, "a": None, "s": "b", "tags": []}, {"_id": 3, "a": 7, "s": None, "tags": None}, {"_id": 4, "a": 5, "s": "abd", "tags": ["y", None]}])


@pytest.mark.parametrize(
    ("filter_", "ids"),
    [
        ({"a": 5}, [1, 4]), ({"a": None}, [2]), ({"a": {"$ne": 5}}, [2, 3]), ({"a": {"$nin": [5, 7]}}, [2]), ({"a": {"$in": [None, 7]}}, [2, 3]), ({"a": {"$gt": None}}, []),
        ({"tags": "y"}, [1, 4]), ({"tags": {"$ne": "x"}}, [2, 3, 4]), ({"tags": {"$size": 0}}, [2]), ({"tags": {"$all": ["x", "y"]}}, [1]), ({"s": {"$regex": "^ab", "$options": "i"}}, [1, 4]),
        ({"$nor": [{"a": 5}, {"s": "b"}]}, [3]), ({"a": {"$not": {"$gte": 6}}}, [1, 2, 4]), ({"s": {"$exists": False}}, [3]), ({"a": {"$gte": 5, "$lt": 7}}, [1, 4]), ({"missing": None}, [1, 2, 3, 4]),
        ({"a": {"$type": "null"}}, [2]), ({"tags": {"$elemMatch": {"$in": ["x"]}}}, [1]), ({"a": {"$mod": [4, 1]}}, [1, 4]), ({"a": {"$bitsAllSet": [0, 2]}}, [1, 3, 4]), ({"a": "text"}, []),
    ],
)
def test_predicates(items, filter_, ids):
    assert [r["_id"] for r in Find(items).where(filter_).sort("_id").df().collect()] == ids


def test_unknown_operators_are_refused(items):
    with pytest.raises(UnsupportedOperator):
        Find(items).where({"a": {"$nope": 1}}).df()
    with pytest.raises(UnsupportedOperator):
        aggregate(items, [{"$nope": {}}])


def test_group_keeps_nulls_and_order(items):
    out = Aggregation(items).sort({"_id": -1}).group("$a").push("s", "$s").sum("n").first("f", "$_id").end().df()
    assert rows(out, "_id", "s", "n", "f") == sorted([(5, ["abd", "Abc"], 2, 4), (None, ["b"], 1, 2), (7, [None], 1, 3)], key=str)


def test_empty_count_has_no_row(items):
    assert aggregate(items, [{"$match": {"a": 99}}, {"$count": "n"}]).collect() == []
    assert aggregate(items, [{"$match": {"a": 99}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]).collect() == []


def test_unwind(items):
    plain = aggregate(items, [{"$unwind": "$tags"}])
    kept = aggregate(items, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}])
    assert plain.count() == 4 and kept.count() == 6
    assert rows(kept, "_id", "tags", "i")[0] == (1, "x", 0)


def test_lookup_null_matches_null_and_arrays(spark):
    left = from_documents(spark, [{"_id": 1, "k": "x"}, {"_id": 2, "k": None}, {"_id": 3, "k": "z"}])
    c = Catalog(spark, {"r": from_documents(spark, [{"k": "x", "v": 1}, {"k": None, "v": 2}, {"k": "x", "v": 3}])})
    out = aggregate(left, [{"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "as": "m"}}], c)
    assert {r["_id"]: sorted(x["v"] for x in r["m"]) for r in out.collect()} == {1: [1, 3], 2: [2], 3: []}


def test_graph_lookup_ends_on_cycles(spark):
    c = Catalog(spark, {"e": from_documents(spark, [{"n": "a", "to": "b"}, {"n": "b", "to": "c"}, {"n": "c", "to": "a"}])})
    out = aggregate("e", [{"$graphLookup": {"from": "e", "startWith": "$to", "connectFromField": "to", "connectToField": "n", "as": "r", "depthField": "d"}}], c)
    found = {r["n"]: sorted((x["n"], x["d"]) for x in r["r"]) for r in out.collect()}
    assert found["a"] == [("a", 2), ("b", 0), ("c", 1)]


def test_bucket_needs_default_outside(items):
    with pytest.raises(Exception, match="bucket"):
        aggregate(items, [{"$bucket": {"groupBy": "$a", "boundaries": [0, 6]}}]).collect()


def test_bucket_auto_keeps_ties_together(spark):
    df = from_documents(spark, [{"v": v} for v in (1, 1, 1, 2, 3, 4)])
    out = aggregate(df, [{"$bucketAuto": {"groupBy": "$v", "buckets": 3}}]).collect()
    assert sum(r["count"] for r in out) == 6 and out[0]["count"] == 3 and out[0]["_id"]["max"] == out[1]["_id"]["min"]


def test_series_functions(spark):
    df = from_documents(spark, [{"x": i, "v": v} for i, v in enumerate([10.0, None, 30.0, None, 20.0])])
    out = aggregate(df, [{"$setWindowFields": {"sortBy": {"x": 1}, "output": {"f": {"$linearFill": "$v"}, "c": {"$locf": "$v"}, "e": {"$expMovingAvg": {"input": "$v", "alpha": 0.5}}}}}])
    got = {r["x"]: (r["f"], r["c"], r["e"]) for r in out.collect()}
    assert got == {0: (10.0, 10.0, 10.0), 1: (20.0, 10.0, None), 2: (30.0, 30.0, 20.0), 3: (25.0, 30.0, None), 4: (20.0, 20.0, 20.0)}


def test_dates(spark):
    df = from_documents(spark, [{"d": dt.datetime(2019, 12, 31, 23, 59)}])
    out = aggregate(df, [{"$project": {"y": {"$dateDiff": {"startDate": "$d", "endDate": dt.datetime(2020, 1, 1), "unit": "year"}}, "w": {"$week": "$d"}, "t": {"$dateTrunc": {"date": "$d", "unit": "week"}}, "s": {"$dateToString": {"date": "$d", "format": "%Y-%m"}}}}]).first()
    assert (out["y"], out["w"], out["t"], out["s"]) == (1, 52, dt.datetime(2019, 12, 29), "2019-12")


def test_updates(spark):
    df = from_documents(spark, [{"_id": 1, "n": 1, "a": [1, 5, 9]}, {"_id": 2, "n": None, "a": [2]}])
    out = {r["_id"]: r for r in update(df, {}, {"$inc": {"n": 2}, "$push": {"a": 7}}).collect()}
    assert (out[1]["n"], out[2]["n"], out[2]["a"]) == (3, 2, [2, 7])
    out = {r["_id"]: r["a"] for r in update(df, {"a": {"$gt": 4}}, {"$set": {"a.$[big]": 0}}, [{"big": {"$gt": 4}}]).collect()}
    assert out == {1: [1, 0, 0], 2: [2]}
    out = {r["_id"]: r["a"] for r in update(df, {"a": {"$gt": 4}}, {"$set": {"a.$": 0}}).collect()}
    assert out == {1: [1, 0, 9], 2: [2]}


@pytest.mark.parametrize(("matched", "name"), [("replace", None), ("keepExisting", "old"), ("merge", "old")])
def test_merge_modes(spark, matched, name):
    c = Catalog(spark, {"t": from_documents(spark, [{"_id": 1, "v": 1, "name": "old"}]).select("_id", "v", "name")})
    new = from_documents(spark, [{"_id": 1, "v": 2}, {"_id": 5, "v": 5}])
    aggregate(new, [{"$merge": {"into": "t", "whenMatched": matched}}], c)
    got = {r["_id"]: (r["v"], r["name"]) for r in c["t"].collect()}
    assert got[5] == (5, None) and got[1] == ((1 if matched == "keepExisting" else 2), name)


def test_text_front_ends(items):
    q = jdql.parse("SELECT s, COUNT(a) AS n FROM t WHERE NOT (a IS NULL) GROUP BY s HAVING COUNT(a) >= 1 ORDER BY s DESC")
    assert q.group == ["s"] and q.columns[1] == ("a", "COUNT", "n") and q.order == [(("s", None), -1)]
    with pytest.raises(jdql.ParseError):
        jdql.parse("SELECT a FROM t WHERE a >")
    assert jdql.run("SELECT SUM(a) AS t FROM x WHERE a > 100", items).first()["t"] == 0.0
    m = parse_method("findByStatusAndAgeGreaterThanOrderByNameDesc", ["status", "age", "name"])
    assert [c.operator for c in m.alternatives[0]] == ["$eq", "$gt"] and m.order == (("name", -1),)


def test_geometry():
    from docmill.functions.geometry import meet

    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    assert meet(square, {"type": "Point", "coordinates": [2, 2]})
    assert meet(square, {"type": "LineString", "coordinates": [[-1, 2], [9, 2]]})
    assert not meet(square, {"type": "Point", "coordinates": [5, 2]})


def test_stream_of_changes(spark, tmp_path):
    from docmill.streaming.changes import apply_changes, diff, watch

    before = from_documents(spark, [{"_id": 1, "v": 1}, {"_id": 2, "v": 2}])
    after = from_documents(spark, [{"_id": 1, "v": 9}, {"_id": 3, "v": 3}])
    events = diff(before, after)
    assert sorted(r["_id"] for r in apply_changes(before, events).collect()) == [1, 3]
    events.write.parquet(str(tmp_path / "log"))
    stream = watch(spark, str(tmp_path / "log"), before.schema, [{"$match": {"operationType": "insert"}}])
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["fullDocument"]["_id"] for r in spark.table("seen").collect()] == [3]


@pytest.mark.parametrize(
    ("filter_", "pushed"),
    [
        ({"a": {"$gt": 5}}, "GreaterThan(a,5)"), ({"a": 5}, "EqualTo(a,5)"), ({"a": {"$in": [5, 7]}}, "In(a, [5,7])"), ({"a": None}, "IsNull(a)"), ({"a": {"$ne": None}}, "IsNotNull(a)"),
        ({"$or": [{"a": {"$lte": 5}}, {"s": "b"}]}, "Or(LessThanOrEqual(a,5),EqualTo(s,b))"), ({"$expr": {"$gte": ["$a", 6]}}, "GreaterThanOrEqual(a,6)"),
        ({"$expr": {"$and": [{"$lt": [5, "$a"]}, {"$eq": ["$s", "b"]}]}}, "EqualTo(s,b)"), ({"$expr": {"$lt": ["$a", 6]}}, "Or(LessThan(a,6),IsNull(a))"),
    ],
)
def test_filters_reach_the_scan(spark, items, tmp_path, filter_, pushed):
    items.select("_id", "a", "s").write.parquet(str(tmp_path / "t"))
    out = aggregate(spark.read.parquet(str(tmp_path / "t")), [{"$match": filter_}])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan[plan.index("PushedFilters") :], plan
    assert sorted(r["_id"] for r in out.collect()) == sorted(r["_id"] for r in aggregate(items, [{"$match": filter_}]).collect())


def test_expression_filters_order_null_first(items):
    ids = lambda spec: sorted(r["_id"] for r in aggregate(items, [{"$match": {"$expr": spec}}]).collect())
    assert ids({"$lt": ["$a", 6]}) == [1, 2, 4] and ids({"$gt": [6, "$a"]}) == [1, 2, 4] and ids({"$gte": ["$a", 6]}) == [3]
    assert ids({"$not": [{"$lt": ["$a", 6]}]}) == [3] and ids({"$eq": ["$a", 5]}) == [1, 4] and ids({"$and": [{"$lte": ["$a", 5]}, {"$ne": ["$s", "b"]}]}) == [1, 4]


def test_series_in_partitions_keep_other_columns(spark):
    df = from_documents(spark, [{"k": k, "x": i, "v": float(i * 10 + k), "o": {"p": [k]}} for k in (0, 1, 2) for i in range(4)])
    out = aggregate(df, [{"$setWindowFields": {"partitionBy": "$k", "sortBy": {"x": 1}, "output": {"e": {"$expMovingAvg": {"input": "$v", "N": 3}}}}}])
    want = {}
    for k in (0, 1, 2):
        state = None
        for i in range(4):
            state = i * 10 + k if state is None else (i * 10 + k) * 0.5 + state * 0.5
            want[k, i] = (state, [k])
    assert {(r["k"], r["x"]): (r["e"], r["o"]["p"]) for r in out.collect()} == want


def test_array_to_object_and_empty_aggregates(items):
    out = aggregate(items, [{"$project": {"o": {"$arrayToObject": [[{"k": "a", "v": 1}]]}, "p": {"$arrayToObject": {"$literal": [["x", "y"]]}}}}]).first()
    assert (out["o"], out["p"]) == ({"a": 1}, {"x": "y"})
    got = jdql.run("SELECT MIN(a) AS lo, MAX(a) AS hi, COUNT(a) AS n FROM x WHERE a > 100", items).first()
    assert (got["lo"], got["hi"], got["n"]) == (0.0, 0.0, 0)


def test_bulk_write_order(items):
    from docmill.find import bulk_write

    rows = items.select("_id", "a")
    steps = [("nope", {}), ("update_many", {"a": 5}, {"$set": {"a": 6}})]
    with pytest.raises(UnsupportedOperator):
        bulk_write(rows, steps)
    with pytest.raises(UnsupportedOperator) as e:
        bulk_write(rows, steps, ordered=False)
    assert sorted(r["_id"] for r in e.value.collection.where("a = 6").collect()) == [1, 4]
