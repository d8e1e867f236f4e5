"""Line dedup on long texts, and the mix by a brute-force queue."""

import re
import time
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_line_dedup_is_linear_in_lines(spark):
    from docmill.llm.line_dedup import dedup_lines

    def seconds(n):
        lines = [f"line number {i}" for i in range(n)]
        docs = spark.createDataFrame([(1, "a shared long line"), (2, "\n".join([*lines, "A shared long line "]))], "doc_id long, text string")
        began = time.perf_counter()
        got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
        assert (got[2]["n_dropped"], got[2]["text"]) == (1, "\n".join(lines))
        return time.perf_counter() - began

    seconds(10)
    assert seconds(160_000) < 8 * seconds(40_000) + 5


def test_line_dedup_bitmaps_with_gaps(spark):
    from docmill.llm.line_dedup import dedup_lines

    shared = {0, 63, 64, 200, 511}
    first = "\n".join(f"shared line {i}" for i in sorted(shared))
    second = [f"shared line {i}" if i in shared else f"own line number {i}" for i in range(700)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame([(1, first), (2, "\n".join(second))], "doc_id long, text string")).collect()}
    assert got[1]["text"] == first and got[2]["text"] == "\n".join(x for i, x in enumerate(second) if i not in shared)
    assert got[2]["n_dropped"] == len(shared)


def targets(size):
    """Resharing until no source is above its cap."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(size.values()), set(size), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * size[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_of_copies_ties_and_nulls(spark):
    from docmill.llm.mixing import fair_mix, mixed_documents

    rows = [(i, "w " * (1 + i % 7), ["a", "b", None, "é"][i % 4], i) for i in range(80)]
    rows += [(500, "six words are in this text", "a", 1)] * 1000 + [(600, "same text", "b", 1), (600, "same text", "b", 2), (601, None, "b", 0), (None, "no id", None, 0), (None, "no id", None, 0), (602, "", "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, u int").repartition(5)
    got = fair_mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    by_source = defaultdict(int)
    for _, t, s, _ in rows:
        by_source[s] += size(t)
    want, taken = targets(by_source), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _, _ in rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == by_source[r["source"]] and r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - want[s]) <= 7 for s in want), (taken, want)  # within a document
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter((r["doc_id"], r["text"], r["source"], r["u"]) for r in mixed.collect())
    per = Counter()
    for r in got:
        per[r["doc_id"], r["size"]] += r["taken"]
    words = Counter()
    for (d, t, _, _), n in times.items():
        words[d, size(t)] += n * size(t)
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in per.items() if v}
    assert max(n for (d, *_), n in times.items() if d != 500) <= 4
    again = Counter((r["doc_id"], r["size"], r["taken"]) for r in fair_mix(docs.repartition(3)).collect())
    assert again == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_mix_with_clashing_names_and_no_rows(spark):
    from docmill.llm.mixing import fair_mix, mixed_documents

    schema = "doc_id long, text string, source string, size string, mark int, row int, done int, copies int, task int"
    one = spark.createDataFrame([(1, "a b", "s", "x", 1, 2, 3, 4, 5)], schema)
    assert [r["taken"] for r in fair_mix(one).collect()] == [2] and fair_mix(one.limit(0)).count() == 0
    assert [tuple(r) for r in mixed_documents(one).collect()] == [(1, "a b", "s", "x", 1, 2, 3, 4, 5)]
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["target"], r["taken"]) for r in fair_mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)} and mixed_documents(blank).count() == 0
