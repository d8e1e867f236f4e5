"""Packing: the heuristic replayed by brute force, each limit closing a sequence, and
conversations whose answers alone bear loss."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from docmill.llm import packing


def replay(demand, capacity):
    """Item by item: the one that fits with the largest dot product, the first of equals."""
    left, bins, b = set(range(len(demand))), {}, 0
    order = {tuple(d): k for k, d in enumerate(sorted({tuple(d) for d in demand}))}
    while left:
        room = np.array(capacity)
        while True:
            fits = [i for i in left if (np.array(demand[i]) <= room).all()]
            if not fits:
                break
            score = lambda i: (np.array(demand[i]) / capacity) @ (room / capacity)
            best = max(score(i) for i in fits)
            pick = min((i for i in fits if score(i) == best), key=lambda i: (order[tuple(demand[i])], i))
            bins[pick] = b
            room = room - demand[pick]
            left.remove(pick)
        b += 1
    return [bins[i] for i in range(len(demand))]


@pytest.mark.parametrize("seed", range(6))
def test_heuristic_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    length = rng.integers(1, 64, 60)
    demand = np.stack([length, np.ones_like(length), rng.integers(0, length + 1) % 40], axis=1)
    bins, places = packing.pack_vectors(demand, np.array([64, 5, 40]))
    assert bins.tolist() == replay(demand.tolist(), np.array([64, 5, 40]))
    for b in set(bins.tolist()):
        mine = demand[bins == b]
        assert (mine.sum(axis=0) <= [64, 5, 40]).all() and sorted(places[bins == b]) == list(range(len(mine)))


@pytest.mark.parametrize(("demand", "closing"), [([(50, 1, 0)] * 4, 0), ([(5, 1, 1)] * 8, 1), ([(20, 1, 20)] * 4, 2)])
def test_each_limit_closes_a_sequence(demand, closing):
    capacity = np.array([100, 4, 40])
    bins, _ = packing.pack_vectors(np.array(demand), capacity)
    for b in set(bins.tolist()):
        used = np.array(demand)[bins == b].sum(axis=0)
        assert used[closing] == capacity[closing] and all(used[k] < capacity[k] for k in range(3) if k != closing)


def test_turns_are_cut_at_either_limit():
    ids = lambda n, k: (np.arange(n, dtype="<u4") + k).tobytes()
    turns = [(ids(30, 0), False), (ids(25, 100), True), (ids(5, 200), False), (ids(50, 300), True)]
    pieces = packing.cut_turns(turns, 40, 20)
    assert b"".join(x for _, x, _ in pieces) == b"".join(t for t, _ in turns)
    assert all(len(x) // 4 <= 40 and loss <= 20 for _, x, loss in pieces) and sum(loss for *_, loss in pieces) == 75
    assert [start for start, *_ in pieces] == np.cumsum([0, *[len(x) // 4 for _, x, _ in pieces]])[:-1].tolist()
    assert packing.cut_turns([], 40, 20) == []


def test_conversations(spark):
    from tokenizers import Tokenizer

    from docmill.llm.queries import tokenizer_path

    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of talk {c} " + "words and more " * (c % 9 + 40 * (c == 3))) for c in range(40) for t in range(2 + c % 4)]
    rows += [(None, 0, "user", "no id"), (50, 0, "assistant", None), (51, 0, None, "nobody"), (51, 0, "assistant", ""), (52, 0, "user", "same"), (52, 0, "user", "same")]
    talks = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = packing.pack_conversations(talks, tokenizer_path(), 256, 4, 120).collect()
    tokenizer, want, sequences = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[c] += [(i, role == "assistant") for i in ids]
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for c, mine in pieces.items():
        assert sum(r["length"] for r in mine) == len(want[c]) == mine[0]["doc_tokens"]
        for r in mine:
            part = want[c][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array([i for i, _ in part], dtype="<u4").tobytes()) == r["ids_crc32"] and r["loss"] == sum(b for _, b in part)
    full = set()
    for mine in sequences.values():
        used = (sum(r["length"] for r in mine), len(mine), sum(r["loss"] for r in mine))
        assert used[0] <= 256 and used[1] <= 4 and used[2] <= 120
        full |= {k for k, most in enumerate((256, 4, 120)) if used[k] == most}
        mine.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
    assert {1, 2} <= full  # segments and loss close sequences
    assert packing.pack_conversations(talks.limit(0), tokenizer_path()).count() == 0


def test_sequences_hold_their_pieces(spark):
    from docmill.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(1, "some words"), (2, "other words here"), (2, "other words here"), (None, None)], "doc_id long, text string")
    packed = packing.pack_documents(docs, tokenizer_path()).collect()
    rows = packing.sequence_ids(docs, tokenizer_path()).collect()
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in packed) == sum(len(r["ids"]) // 4 for r in rows)
    for p in packed:
        ids = next(r["ids"] for r in rows if r["sequence_id"] == p["sequence_id"])
        assert zlib.crc32(ids[4 * p["offset"] : 4 * (p["offset"] + p["length"])]) == p["ids_crc32"]
