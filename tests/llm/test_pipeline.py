"""The stages of the corpus pipeline on odd documents, each by brute force on its input."""

import re
from collections import Counter

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SENTENCE = " ".join(f"plain word{i} of an ordinary sentence" for i in range(12))
ROWS = [
    (1, SENTENCE + ".\nA line that others share too.", "en", "a", 1), (2, SENTENCE + ".\nA LINE that others share too. ", "en", "b", 1), (2, SENTENCE + ".\nA LINE that others share too. ", "en", "b", 1),
    (3, " ".join(f"other text{i}" for i in range(40)), None, None, None), (3, " ".join(f"third kind{i}" for i in range(40)), "de", "a", 3), (4, None, "en", "a", 0), (5, "", None, "a", 0), (6, " \n ", "en", "a", 3),
    (None, " ".join(f"without id{i}" for i in range(40)), "en", "b", 2), (7, " ".join(f"without id{i}" for i in range(40)), "en", "b", 2), (8, "a line that others share too.", "en", "b", 2), (9, "x" * 20_000, "en", "b", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_by_brute_force(spark, folder):
    import corpus_pipeline as p

    stage = dict(p.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "jaccard_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stage["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns and not Counter(map(tuple, kept.collect())) - Counter(ROWS)
    assert all(len(WORD.findall(r["text"] or "")) >= 20 for r in kept.collect())
    # Line dedup keeps a row per document and drops the shared line of all but the first.
    lined = [tuple(r) for r in stage["line_dedup"](spark, docs, folder).collect()]
    shared = "a line that others share too."
    want = [(d, t if t is None or d in (1, None) else "\n".join(x for x in t.split("\n") if x.strip().lower() != shared and (d != 2 or x != SENTENCE + ".")), *rest) for d, t, *rest in ROWS]
    drop = lambda rows: Counter((r[0], r[1], r[2], r[3]) for r in rows)
    other = [r for r in want if r[0] not in (7, None)]
    assert drop(r for r in lined if r[0] not in (7, None)) == drop(other)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lined)
    # Of each group of near duplicates the least doc_id stays, by text.
    left = [tuple(r) for r in stage["jaccard_dedup"](spark, docs, folder).collect()]
    name = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(ROWS):
            for j, b in enumerate(ROWS):
                x, y = shingles(a[1]), shingles(b[1])
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    name[i] = name[j] = min(name[i], name[j])
    groups = {}
    for i, r in enumerate(ROWS):
        key = name[i] if shingles(r[1]) else ("blank", i)
        if key not in groups or (r[0] is None, r[0] or 0) < (groups[key][0] is None, groups[key][0] or 0):
            groups[key] = r
    assert Counter(left) == Counter(groups.values())
    mixed = stage["mix_sources"](spark, docs, folder)
    assert mixed.columns == docs.columns and all(r["text"].strip() for r in mixed.collect())
    packed = stage["pack_sequences"](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r[0] for r in ROWS)


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    import corpus_pipeline as p

    out = p.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert sorted(map(str, out.collect())) == sorted(map(str, p.run(spark, folder).collect()))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
