"""The language model: its sampler against exact conditionals, its scores by brute force."""

import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from docmill.llm import hpy_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1


def exact(c, others, d, theta, base):
    """P(t | rest) by the recurrence of the seatings, the parent's probability by table."""
    s = np.full((c + 1, c + 1), -np.inf)
    s[1, 1] = 0.0
    for n in range(2, c + 1):
        for t in range(1, n + 1):
            s[n, t] = np.logaddexp(s[n - 1, t - 1], s[n - 1, t] + np.log(n - 1 - d * t) if t < n else -np.inf)
    p = np.array([s[c, t] + sum(np.log((theta + d * (others + i)) * base(i)) for i in range(1, t)) for t in range(1, c + 1)])
    p = np.exp(p - p.max())
    return p / p.sum()


def drawn(c, others, d, parent, n=60_000):
    many = parent.at(np.zeros(n, dtype=int))
    t = lm.seat(np.full(n, c), np.full(n, others), many, lm.Stirling(d), 1.0, np.random.default_rng(c))
    return np.bincount(t, minlength=c + 1)[1 : c + 1] / n


@pytest.mark.parametrize(("c", "others", "d", "base"), [(2, 0, 0.5, 0.9), (6, 3, 0.7, 0.3), (12, 40, 0.7, 0.05), (30, 5, 0.3, 0.2), (64, 100, 0.6, 0.01)])
def test_seating_is_drawn_from_its_conditional(c, others, d, base):
    flat = lm.Parent(np.array([base]), np.ones(1), np.zeros(1, dtype=bool), 0.0, False)
    assert np.abs(drawn(c, others, d, flat) - exact(c, others, d, 1.0, lambda i: base)).sum() / 2 < 0.02


@pytest.mark.parametrize("fresh", [True, False])
def test_the_parent_grows_with_new_tables(fresh):
    mass, total, d1 = 0.4 if fresh else 7.4, 50.0, 0.6
    parent = lm.Parent(np.array([mass]), np.array([total]), np.array([fresh]), d1, True)
    want = exact(9, 12, 0.5, 1.0, lambda i: (mass + i - (d1 if fresh else 0)) / (total + i))
    assert np.abs(drawn(9, 12, 0.5, parent) - want).sum() / 2 < 0.02


@pytest.mark.parametrize(("c", "others", "d", "base"), [(90, 30, 0.5, 0.05), (150, 400, 0.7, 0.02), (120, 0, 0.8, 0.5), (100, 3, 0.4, 0.001)])
def test_large_parties_are_close_to_their_conditional(c, others, d, base):
    flat = lm.Parent(np.array([base]), np.ones(1), np.zeros(1, dtype=bool), 0.0, False)
    assert np.abs(drawn(c, others, d, flat) - exact(c, others, d, 1.0, lambda i: base)).sum() / 2 < 0.05


def test_a_sweep_agrees_with_single_customers():
    """The mean tables of a small restaurant, against customers moved one by one."""
    counts, base, d, theta = np.array([7, 3, 5, 1]), np.array([0.2, 0.1, 0.4, 0.3]), 0.6, 1.0
    rng = np.random.default_rng(1)
    tables = [[int(c)] for c in counts]
    mean = np.zeros(4)
    for turn in range(6000):
        for w in range(4):
            for _ in range(counts[w]):
                k = rng.choice(len(tables[w]), p=np.array(tables[w]) / sum(tables[w]))
                tables[w][k] -= 1
                if not tables[w][k]:
                    del tables[w][k]
                weight = np.array([*[n - d for n in tables[w]], (theta + d * sum(map(len, tables))) * base[w]])
                k = rng.choice(len(weight), p=weight / weight.sum())
                if k == len(tables[w]):
                    tables[w].append(0)
                tables[w][k] += 1
        if turn >= 500:
            mean += [len(t) for t in tables]
    state, totals, ours = np.ones(4, dtype=np.int64), np.array([4.0]), np.zeros(4)
    flat = lm.Parent(base, np.ones(4), np.zeros(4, dtype=bool), 0.0, False)
    stirling = lm.Stirling(d)
    for turn in range(6000):
        lm.sweep(np.zeros(4, dtype=np.int64), counts, state, totals, flat, stirling, theta, rng)
        assert totals[0] == state.sum()
        ours += state if turn >= 500 else 0
    assert np.abs(mean - ours).max() / 5500 < 0.06


def tokens(text):
    return [*WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), ""]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_scores_by_brute_force(spark):
    """One training text of distinct words: every party has one customer, so the seating
    is certain and all probabilities follow from the counts."""
    train = next(d for d in range(1, 99) if not held(d))
    others = [d for d in range(100, 130) if held(d)]
    text = " ".join(f"w{i}" for i in range(12))
    given = [(train, text.upper())] + list(zip(others, ["w0 w1 w2", "w2 w1", "new w3 w4 new", "", None, "w11", "W0 É w1"]))
    got = by_id(lm.score_texts(spark.createDataFrame(given, "doc_id long, text string"), waves=2))
    seen = tokens(text)
    pairs, words = Counter(pairwise([" ", *seen])), Counter(seen)
    context = Counter(v for v, _ in pairs)
    d, theta, n, v = 0.95, lm.THETA, len(seen), len(words)
    for doc, t in given:
        base = score = 0.0
        for a, w in pairwise([" ", *tokens(t)]):
            base += np.log10((words[w] + 0.5) / (n + 0.5 * (v + 1)))
            above = ((1 - d) * (w in words) + (theta + d * v) / (v + 1)) / (theta + n)
            here = context[a]  # one customer and one table, or none
            score += np.log10(((1 - d) * pairs[a, w] + (theta + d * here) * above) / (theta + here))
        r = got[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(doc), len(tokens(t)), sum(w in words for w in tokens(t)), n)
        assert abs(r["base_score"] - base) < 1e-9 and abs(r["score"] - score) < 1e-5


def test_model_learns_and_reruns_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    given = [(d, " ".join(f"w{k}" for k in np.cumsum(rng.zipf(1.7, 80)) % 50)) for d in range(80)]
    given += [(None, "a b c"), (None, None), (5, given[5][1]), (107, ""), (170, "x" * 4000), (171, "w1 w2 " * 400), (172, "\x00 \x1c é")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in given], "doc_id long, text string, score string, n_known int")
    first = lm.score_texts(docs)
    assert sorted(map(str, first.collect())) == sorted(map(str, lm.score_texts(docs).collect())) and first.count() == len(given)
    better = {r["held_out"]: r for r in lm.perplexity(first).collect()}
    assert all(better[h]["perplexity"] < better[h]["base_perplexity"] for h in (True, False))
    for r in first.collect():
        assert 0 >= r["score"] > -1e6 and r["n_known"] <= r["n_tokens"]
    # Contexts split over several ranges give nearly the same scores.
    monkeypatch.setattr(lm, "HOT_TOKENS", 300)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 2000)
    split = by_id(lm.score_texts(docs, waves=1).where("doc_id is not null"))
    whole = by_id(first.where("doc_id is not null"))
    assert lm.frequent_contexts(docs)[1] and all(abs(split[d]["score"] - whole[d]["score"]) < 0.02 * abs(whole[d]["score"]) + 0.3 for d in whole)
    assert all(abs(split[d]["base_score"] - whole[d]["base_score"]) < 1e-9 for d in whole)


def test_without_training_texts(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = [d for d in range(50) if held(d)][:3]
    none = by_id(lm.score_texts(spark.createDataFrame([(d, "a b") for d in out], "doc_id long, text string"), waves=1))
    assert all((r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0) for r in none.values())


def test_turns_carry_only_the_parties_that_are_reseated(spark, monkeypatch):
    """A party of one customer has one table for good: once it is seated, neither it nor
    its words go between ranges until the seating is read off."""
    train = next(d for d in range(1, 99) if not held(d))
    text = " ".join(f"w{i}" for i in range(20_000)) + " again and again and again"
    docs, sent = spark.createDataFrame([(train, text)], "doc_id long, text string"), {}
    write = lm.materialize

    def spy(df, name):
        out = write(df, name)
        rows = out.collect() if name in ("lm-contexts", "lm-words") else []
        sent.setdefault(name, []).append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray)) and r["kind"] in (getattr(lm, k) for k in ("TABLES", "SENT", "REPLY"))))
        return out

    monkeypatch.setattr(lm, "materialize", spy)
    lm.train(docs)
    first, *turns = sent["lm-contexts"]
    assert first > 6 * 20_000 and len(turns) == lm.BURN_IN + lm.SAMPLES
    assert max(turns) < first / 50 and max(sent["lm-words"][:-1]) < first / 50
    assert sent["lm-words"][-1] > 20_000  # all words are read off in the end


def test_packed_numbers_and_ranks():
    rng = np.random.default_rng(3)
    for top in (1, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**48 - 1):
        x = np.append(rng.integers(0, top, 50, endpoint=True), [0, top])
        assert (lm._wide(lm._small(x)) == x).all() and (lm._unpack(lm._pack(x)) == x).all()
        assert all((a == b).all() for a, b in zip(lm._ranks(x), np.unique(x, return_inverse=True), strict=True))
    empty = np.zeros(0, dtype=np.int64)
    assert not len(lm._wide(lm._small(empty))) and not len(lm._unpack(lm._pack(empty))) and not len(lm._ranks(empty)[0])
