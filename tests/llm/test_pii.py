"""Base spans of every kind by brute force, and texts with very many finds."""

import hashlib
import re
import time

import numpy as np

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_spans_by_brute_force(spark):
    from docmill.llm.pii_bootstrap import detect_pii, digests

    rng = np.random.default_rng(4)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.25", "1.2.3.256", "1.2.3.4.5", "000.1.2.3", "+1 (555) 010-2030", "+12", "+49 30 123456789012345", "a.b@c.d", "x@y", "@", "é", "word", "12 34", "5500 0055 5555 5559", "\n", " ", ",", "+", ".", "-", "me@ma-il.example.org"]
    texts = ["".join(rng.choice(pieces, 40)) for _ in range(60)] + [" ".join(rng.choice(pieces, 40)) for _ in range(60)] + [None, "", "+" * 50, "1" * 3000, "1.1.1.1" * 200, "a@b.c" * 200]
    got = {r["doc_id"]: r for r in digests(detect_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rounds=0)).collect()}
    for d, t in enumerate(texts):
        want = base(t)
        assert {k: got[d][f"n_{k}"] for k in KINDS} == {k: sum(w[0] == k for w in want) for k in KINDS}, t
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[d]["spans"] == text and got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_linear_in_finds(spark):
    from docmill.llm.pii_bootstrap import detect_pii, digests

    def seconds(n):
        began = time.perf_counter()
        docs = spark.createDataFrame([(1, "".join(f"call a{i}@b.example now 12{i} or 10.0.0.{i % 256} " for i in range(n)))], "doc_id long, text string")
        row = digests(detect_pii(docs, rounds=1)).first()
        assert (row["n_email"], row["n_ip"]) == (n, n)
        return time.perf_counter() - began

    seconds(10)
    assert seconds(24_000) < 8 * seconds(6_000) + 5


def test_long_words_beside_an_identifier_and_rows_alike(spark):
    from docmill.llm.pii_bootstrap import detect_pii

    long = "x" * 300
    given = [(i, f"{long}{long[:200]} {long} +1 (555) 010-20{30 + i} {long} y") for i in range(6)] + [(9, f"{long}{long[:200]} {long} 555 0102 {long} y")] * 2 + [(10, f"other{long} {long[:90]} 555 0199 z"), (None, None)]
    got = [(r["doc_id"], [tuple(a) for a in r["added"] or []]) for r in detect_pii(spark.createDataFrame([(*g, "clash") for g in given], "doc_id long, text string, row string")).collect()]
    at = 500 + 1 + 300 + 1
    assert len(got) == len(given) and sorted(x for x in got if x[1]) == [(9, [("phone", at, at + 8)])] * 2
