"""License scanning: base places by brute force, notices with edits, long texts."""

import re
import time

import numpy as np

from docmill.llm import license_scan as ls

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT, GPL = max(ls.TEMPLATES["mit"], key=len), ls.TEMPLATES["gpl"][0]


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in ls.scan_licenses(docs).collect()}


def labels(row):
    return {s["label"] for s in row["spans"] or []}


def test_base_places_by_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = ["gnu", "general", "public", "license", "Apache", "LICENSE", "cc", "by", "MIT", "the", "é", "by-sa", "x1"]
    texts = [" ".join(rng.choice(pool, 60)) for _ in range(40)] + [None, "", "CC BY", "cc-by cc by, Cc.By", "gnu general public license" * 2, "MIT License\nMIT LICENSE"]
    got = scan(spark, texts)
    for d, t in enumerate(texts):
        words, places, found = WORDS.findall((t or "").translate(LOW)), [], set()
        for phrase, label in ls.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            found |= {label} if at else set()
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base"]) == (len(words), len(places), min(places, default=None), max(places, default=None), sorted(found)), t


def test_notices_with_inserted_lost_and_changed_words(spark):
    words = MIT.split()
    filler = [f"filler{i}" for i in range(40)]
    half = len(words) // 2
    texts = {
        "exact": " ".join(["before", *words, "after"]),
        "twelve inserted": " ".join([*words[:half], *filler[:12], *words[half:]]),
        "thirty inserted": " ".join([*words[:half], *filler[:30], *words[half:]]),
        "five lost": " ".join([*words[:half], *words[half + 5 :]]),
        "three changed": " ".join([*words[:20], "x", *words[21:70], "y", *words[71:120], "z", *words[121:]]),
        "inserted thrice": " ".join([*words[:30], *filler[:5], *words[30:80], *filler[5:12], *words[80:110], *filler[12:15], *words[110:]]),
    }
    got = scan(spark, list(texts.values()))
    for d, name in enumerate(texts):
        best = max((s for s in got[d]["spans"] or [] if s["label"] == "mit"), key=lambda s: s["end"] - s["start"], default=None)
        assert best is not None and best["score"] >= ls.VERIFY and best["end"] - best["start"] >= 0.9 * len(words), name
    assert got[0]["spans"][0]["start"] == 1


def test_what_is_no_notice(spark):
    words = ls.license_words(GPL.encode())
    shuffled = " ".join(w.decode() for w in np.random.default_rng(0).permutation(words))
    halves = " ".join(w.decode() for w in [*words[len(words) // 2 :], *words[: len(words) // 2]])
    texts = [shuffled, halves, GPL[: len(GPL) // 2], "permission is granted to be here", "the software the software the software " * 50, "a b"]
    got = scan(spark, texts)
    assert [labels(got[d]) for d in range(len(texts))] == [set()] * len(texts)


def test_every_template_is_found_by_itself(spark):
    notices = [(label, n) for label, group in ls.TEMPLATES.items() for n in group]
    got = scan(spark, [f"one two {n} three" for _, n in notices])
    for d, (label, n) in enumerate(notices):
        assert any(s["label"] == label and s["start"] == 2 and s["score"] == 1.0 for s in got[d]["spans"]), n


def test_chain_of_grams_in_order():
    places = {("a", "b", "c"): [0, 3], ("b", "c", "d"): [1], ("c", "d", "a"): [2]}
    assert ls.chain("a b c d a b c".split(), places) == 4 and ls.chain("c d a x a b c d".split(), places) == 2
    assert ls.chain([], places) == 0 and ls.chain("a b c a b c".split(), places) == 2


def test_linear_in_finds(spark):
    def seconds(n):
        began = time.perf_counter()
        row = scan(spark, ["released under the mit license. " * n])[0]
        assert row["n_base"] == n and row["last_word"] == 5 * n - 2 and labels(row) == {"mit"}
        return time.perf_counter() - began

    seconds(10)
    assert seconds(40_000) < 8 * seconds(10_000) + 5


def test_repeated_rows_nulls_and_names(spark):
    docs = spark.createDataFrame([(1, MIT, "r"), (1, MIT, "r"), (None, MIT, None), (None, None, None), (1, "other text", "s")], "doc_id long, text string, spans string")
    got = ls.scan_licenses(docs).collect()
    assert len(got) == 5 and sum("mit" in labels(r) for r in got) == 3 and ls.scan_licenses(docs.limit(0)).count() == 0
