"""The ten operators against brute force on a fixture of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "One early Morning the quiet River carried seven small boats past Émile and his old mill by the bridge near town"
TEXTS = {
    1: BASE + ".\nA shared line of text\nMail bob@mail.example.com or +1 (555) 010-2030 today",
    2: BASE + ".\n  a SHARED line of text \nServer 10.0.0.256 and 10.0.0.25 and card 4111 1111 1111 1111",
    3: BASE + " again",
    4: None, 5: "", 6: "\n\n", 7: "word", 8: "short text",
    9: "spam spam " * 40, 10: "x" * 5000, 11: "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.",
    12: "ümlaut Über É " * 30, 13: BASE + " again", 14: "a@b.c@d.e 1.2.3.4.5.6.7.8 " * 3, 15: " ".join(f"w{i}" for i in range(6000)), 16: "<|endoftext|> it's A b　c don't",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ["en", None, "de"][d % 3], [f"s{d % 2}", None][d % 5 == 0], 0, "clash") for d, t in TEXTS.items()]
    rows.append(rows[0])  # a repeated row
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def full(d):
    return TEXTS[d] or ""


def test_line_dedup(docs, empty):
    from docmill.llm.line_dedup import dedup_lines

    got, first = by_id(dedup_lines(docs)), {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for d in sorted(TEXTS):
        for line in full(d).split("\n"):
            first.setdefault(key(line), d)
    for d in TEXTS:
        lines = full(d).split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        assert (got[d]["n_lines"], got[d]["n_dropped"], got[d]["text"] or "") == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert dedup_lines(empty).count() == 0


def test_quality(docs, empty):
    from docmill.llm.line_crf import PRIOR, fit, line_features, quality, viterbi

    got = by_id(quality(docs, PRIOR))
    for d in TEXTS:
        words, windows = WORD.findall(full(d)), defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_repeat_words"], got[d]["base_failed"]) == (len(words), sum(map(len, words)), len(covered), failed), d
        assert not (failed and got[d]["kept"])
    assert got[15]["kept"] and quality(empty, PRIOR).count() == 0
    assert viterbi([3.0, -1.0, 3.0], 1.5) == [True, True, True] and viterbi([3.0, -9.0], 1.0) == [True, False]
    scores, stay = [0.4, -1.2, 0.3, 2.0], 0.7  # best of all labellings
    best = max(range(16), key=lambda m: sum(s for i, s in enumerate(scores) if m >> i & 1) + stay * sum((m >> i & 1) == (m >> i + 1 & 1) for i in range(3)))
    assert viterbi(scores, stay) == [bool(best >> i & 1) for i in range(4)]
    good, bad = b"A plain sentence of words ends here.", b"BUY!! NOW!! $$$ *** ### &&&"
    w, _ = fit([np.array([line_features(t, t.split(), False)] * 3) for t in (good, bad)] * 4, [1, 0] * 4)
    assert np.dot(w, line_features(good, good.split(), False)) > 0 > np.dot(w, line_features(bad, bad.split(), False))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    from docmill.llm.packing import pack_documents, pack_vectors
    from docmill.llm.queries import tokenizer_path

    tokenizer, pieces, sequences = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, tokenizer_path()).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d in TEXTS:
        ids = np.array([*tokenizer.encode(full(d), add_special_tokens=False).ids, 1], dtype="<u4")
        mine = sorted(pieces[d], key=lambda r: r["start"])[:: 2 if d == 1 else 1]  # row 1 is there twice
        assert [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine] == [r["ids_crc32"] for r in mine]
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))] and sum(r["length"] for r in rows) <= 2048
    bins, _ = pack_vectors(np.array([[60, 1, 5], [40, 1, 90], [40, 1, 0], [60, 1, 20]]), np.array([100, 2, 100]))
    assert len(set(bins.tolist())) == 2
    assert pack_documents(empty, tokenizer_path()).count() == 0


def test_word_tokenizer_equals_the_whole_tokenizer():
    from tokenizers import Tokenizer

    from docmill.llm.packing import tokenize
    from docmill.llm.queries import tokenizer_path

    texts = [t or "" for t in TEXTS.values()] + [
        "Ǆ Ñandú J̌ x̌ ß İstanbul ΑΣ'S don't WE'LL 12½² a\x85b\xa0c\td\x1ce", "<|ENDOFTEXT|>x <|endoftext|>", "It's 'S'D ''ll \xad·ª", "a\x00b\x7f", "ĲÆŒ ŉ ŁÓDŹ ÝØ ſ K'S", "日本 語 \u2003x",
    ]
    whole = Tokenizer.from_file(tokenizer_path())
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokenize([t.encode() for t in texts], tokenizer_path()) == want


def test_media_of_copies_and_shared_passages(spark, monkeypatch):
    from docmill.llm import media_chunks

    monkeypatch.setattr(media_chunks, "HOT_SHARE", 8)
    passage = "".join(f"word{i * 7919 % 1000} " for i in range(3000))
    given = [(i, "the same text") for i in range(40)] + [(100 + i, f"head {i} " + passage + f" tail {i}") for i in range(12)]
    given += [(None, passage), (None, passage), (None, None), (200, "a"), (200, "a "), (200, "a "), (201, passage * 3)]
    containers = media_chunks.media_containers(spark.createDataFrame(given, "doc_id long, text string"))
    got = media_chunks.read_media(containers, with_payload=True).collect()
    payload = lambda t: (t or "").encode() + b" " * (-len(t or "") % 192 if t else 192)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in got), key=order) == sorted(((d, len(t or ""), payload(t)) for d, t in given), key=order)
    stored = containers.where("stored").collect()
    assert len({bytes(r["medium"]) for r in stored}) == len({payload(t) for _, t in given})
    # The shared passage's chunks are kept once.
    kept = {bytes(r["medium"]): sum(n for n, own in zip(r["lengths"], r["own"], strict=True) if own) for r in stored}
    assert sum(kept.values()) < 3 * len(passage)


def test_pii(docs, empty, spark):
    from docmill.llm.pii_bootstrap import bootstrap, detect_pii, digests

    got = by_id(digests(detect_pii(docs)))
    assert [got[d][k] for d, k in ((1, "n_email"), (1, "n_phone"), (2, "n_ip"), (2, "n_card"), (5, "n_email"))] == [1, 1, 1, 1, 0]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for d in TEXTS:
        spans = [x for x in got[d]["spans"].split(",") if x.startswith("email")]
        assert spans == [f"email:{m.start()}:{m.end()}" for m in email.finditer(full(d))], d
    assert got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[14]["n_ip"] == 6
    assert digests(detect_pii(empty)).count() == 0
    seen = [(f"90000000{i}", "phone", ["L call me"]) for i in range(4)] + [("77-1234", None, ["L call me", "R now please"]), ("55-0000", None, ["L of the"])]
    found = bootstrap(spark.createDataFrame(seen, "value string, kind string, patterns array<string>")).collect()
    assert [(r["value"], r["kind"]) for r in found] == [("77-1234", "phone")]


def test_pii_discovers_beside_few_seeds_and_along_chains(spark):
    from docmill.llm.pii_bootstrap import bootstrap

    def found(rows):
        return dict(bootstrap(spark.createDataFrame(rows, "value string, kind string, patterns array<string>")).collect())

    seeds = [(f"90000000{i}", "phone", ["L call me"]) for i in range(6)]
    one, two = ("77-1234", None, ["L call me", "R now please"]), ("88-1234", None, ["L call me"])
    assert found([*seeds[:4], one, ("55-0000", None, ["L of the"])]) == {"77-1234": "phone"}
    assert found([*seeds, one, two]) == {"77-1234": "phone", "88-1234": "phone"}
    # Each step's finds are the next step's seeds: four steps beyond the first pattern.
    chain = [(f"1{step}{i}-5678", None, [f"L p{step}", f"L p{step + 1}"]) for step in range(5) for i in range(4)]
    assert set(found([(f"90000000{i}", "phone", ["L p0"]) for i in range(4)] + chain)) == {v for v, _, _ in chain}
    # A pattern of two kinds, and one of any text, find nothing.
    mixed = [(f"1.1.1.{i}", "ip", ["L call me"]) for i in range(6)]
    anything = [(f"{i}-4444", None, ["L call me"]) for i in range(40)]
    assert found([*seeds, *mixed, one]) == {} and found([*seeds, *anything]) == {}


def test_pii_of_several_words(spark):
    from docmill.llm.pii_bootstrap import detect_pii

    given = [f"please call me +1 (555) 010-20{i} tonight" for i in range(30, 38)] + [f"kindly write to bob{i}@example.com for details" for i in range(8)]
    unseen = {"phone": ["(030) 123 456 789", "555 010 203", "(743) 555-3824", "12 34"], "email": ["bob at example dot com", "eve [at] mail [dot] example [dot] org"]}
    frame = {"phone": "please call me {} tonight", "email": "kindly write to {} for details"}
    want = {}
    for kind, values in unseen.items():
        for v in values:
            want[len(given)] = [(kind, frame[kind].index("{"), frame[kind].index("{") + len(v))]
            given.append(frame[kind].format(v))
    given.append("a list 12, 13 14\n15 of numbers")
    got = {r["doc_id"]: [tuple(x) for x in r["added"] or []] for r in detect_pii(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    assert {d: x for d, x in got.items() if x} == want


def test_jaccard(docs, empty, spark):
    from docmill.llm.jaccard_join import jaccard_components, trie_links

    sets = {}
    for d in TEXTS:
        w = WORD.findall(full(d).translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    name = {d: d for d in TEXTS}
    for _ in TEXTS:
        for a in TEXTS:
            for b in TEXTS:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    got = by_id(jaccard_components(docs))
    assert {d: (got[d]["n_shingles"], got[d]["component_id"]) for d in TEXTS} == {d: (len(sets[d]), name[d]) for d in TEXTS}
    assert jaccard_components(empty).count() == 0
    rng = np.random.default_rng(3)  # the tree against all pairs
    grams = [np.unique(np.concatenate([np.arange(40 * k, 40 * k + 40), rng.integers(1000, 9000, rng.integers(0, 14))])).astype(np.uint64) for k in rng.integers(0, 4, 60)]

    def components(links):
        label = list(range(60))
        for _ in range(60):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    pairs = [(i, j) for i in range(60) for j in range(i) if 4 * len(np.intersect1d(grams[i], grams[j])) >= 3 * len(np.union1d(grams[i], grams[j]))]
    found = trie_links(grams)
    assert components(found) == components(pairs) and len(found) < 60


def test_large_families(spark, monkeypatch):
    """Small blocks force pivots and crossing blocks; the components stay exact."""
    from docmill.llm import jaccard_join as j

    words = [f"v{i}" for i in range(60)]
    texts = [" ".join([*words[: 60 - k % 7], *[f"z{k}"] * (k % 3)]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(docs).collect()}
    monkeypatch.setattr(j, "BLOCK", 5)
    assert {r["doc_id"]: r["component_id"] for r in j.jaccard_components(docs).collect()} == whole


def test_every_link_of_near_copies(spark, monkeypatch):
    """Each pair of similar sets is given once, in one block and across blocks."""
    from docmill.llm import jaccard_join as j

    words = [f"v{i}" for i in range(60)]
    texts = [" ".join([*words[: 60 - k % 12], *[f"z{k}"] * (k % 3)]) for k in range(40)] + [None, "", "lone"]
    docs = spark.createDataFrame([*enumerate(texts), (50, texts[7]), (None, texts[8])], "doc_id bigint, text string")
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts[:40])]
    first = {frozenset(g): d for d, g in reversed(list(enumerate(grams)))}
    want = {(a, b) for g, a in first.items() for h, b in first.items() if a < b and 4 * len(g & h) >= 3 * len(g | h)}
    count = Counter(d for pair in want for d in pair)
    assert len(want) > 3 * len(first)
    for block in (j.BLOCK, 5):
        monkeypatch.setattr(j, "BLOCK", block)
        assert sorted(map(tuple, j.jaccard_links(docs).collect())) == sorted(want)
        got = by_id(j.jaccard_components(docs))
        assert {d: got[d]["n_links"] for d in range(43)} == {d: count[got[d]["class_id"]] for d in range(43)}
        thin = by_id(j.jaccard_components(docs, count_links=False))
        assert "n_links" not in thin[0] and {d: thin[d]["component_id"] for d in thin} == {d: got[d]["component_id"] for d in got}


def test_media(docs, empty):
    from docmill.llm.media_chunks import cut, encode, gear_hashes, media_containers, read_media

    got = by_id(read_media(media_containers(docs)))
    for d in TEXTS:
        b = full(d).encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (got[d]["n_bytes"], got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert got[d]["media_sha256"] == hashlib.sha256(encode(p)).hexdigest()
    assert got[3]["feature"] == got[13]["feature"] and read_media(media_containers(empty)).count() == 0
    from docmill.llm.media_chunks import GEAR

    data, h = bytes(range(256)) * 20, 0
    rolled = [h := ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF for b in data]
    assert rolled == gear_hashes(data).tolist() and cut(data)[-1] == len(data)


def test_mixing(docs, empty):
    from docmill.llm.mixing import fair_mix, mixed_documents

    got = fair_mix(docs).collect()
    assert len(got) == len(TEXTS) + 1 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert fair_mix(empty).count() == 0 and mixed_documents(empty).count() == 0
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed_documents(docs).collect()) == sum(r["taken"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, fair_mix(docs).collect()))


def test_sharding(docs, empty):
    from docmill.llm.sharding import hilbert_index, hilbert_shards

    got = hilbert_shards(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1 and hilbert_shards(empty).count() == 0
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hilbert_index(grid, 3)
    path = grid[np.argsort(place)]
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_licenses(docs, empty):
    from docmill.llm.license_scan import scan_licenses

    got = by_id(scan_licenses(docs))
    assert (got[11]["n_base"], got[11]["first_word"], got[11]["last_word"], got[11]["base"]) == (2, 6, 15, ["gpl", "mit"])
    assert {s["label"] for s in got[11]["spans"]} == {"gpl", "mit"} and got[3]["spans"] is None and got[4]["n_words"] == 0
    assert scan_licenses(empty).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_dedup", "mix_sources", "pack_sequences"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert docs.count() > 100
