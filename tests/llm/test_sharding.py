"""Shards by the Hilbert curve against ranks worked out row by row."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string"


def fixture():
    rows = [(i, "wörd " * (i * 7 % 90), ["en", None, "de", "fr"][i % 4], ["hot", "hot", f"s{i % 9}", None][i % 4]) for i in range(230)]
    return [*rows, rows[3], rows[3], (5, None, "en", "hot"), (5, "", "en", "hot"), (None, "no id", None, None), (None, None, None, None)]


def size(text):
    return len((text or "").encode()) + 1


def levels(values, bits):
    """Each value's level: its rows begin at a share of all rows, nulls first."""
    n, out, before = Counter(values), {}, 0
    for v in sorted(n, key=lambda v: (v is not None, v or "")):
        out[v] = min(2**bits - 1, before * 2**bits // len(values))
        before += n[v]
    return out


def test_ranks_by_brute_force(spark):
    from docmill.llm import sharding as s

    rows = fixture()
    by_source, by_lang = (levels([r[k] for r in rows], s.BITS) for k in (3, 2))
    points = [(by_source[r[3]], by_lang[r[2]], min(2**s.BITS - 1, math.floor(math.log2(size(r[1])) * 1.5))) for r in rows]
    places = s.hilbert_index(np.array(points), s.BITS).tolist()
    whole = sorted((p, r[0] is not None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())) for p, r in zip(places, rows, strict=True))
    got = sorted(s.hilbert_shards(spark.createDataFrame(rows, COLUMNS)).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["place"] for r in got] == [w[0] for w in whole]
    # Rows of one place go by doc_id, nulls first; what has one doc_id may lie either way.
    assert [(r["place"], r["doc_id"]) for r in got] == [(w[0], w[2] if w[1] else None) for w in whole]
    assert sorted((r["place"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == whole
    counts = [sum(r["shard"] == k for r in got) for k in range(16)]
    assert counts == [len(rows) // 16 + (k < len(rows) % 16) for k in range(16)]
    assert [r["slot"] for r in got] == [i for n in counts for i in range(n)]


def test_more_shards_than_rows(spark):
    from docmill.llm.sharding import hilbert_shards

    got = hilbert_shards(spark.createDataFrame(fixture()[:5], COLUMNS)).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, 0) for k in range(5)]


def test_written_shards_hold_every_row_once(spark, tmp_path):
    """Repeated rows, and a null beside an empty text under one doc_id, have a slot each."""
    from docmill.llm.sharding import hilbert_shards, write_shards

    docs = spark.createDataFrame([(*r, i, "mine") for i, r in enumerate(fixture())], f"{COLUMNS}, slot int, place string")
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "lang", "source", "slot_", "place", "shard", "slot"}
    rows = back.collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["slot_"]) for r in rows) == Counter((*r, i) for i, r in enumerate(fixture()))
    want = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in hilbert_shards(docs).collect())
    assert Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in rows) == want
    one = [r["slot"] for r in spark.read.parquet(str(tmp_path / "out" / "shard=3")).coalesce(1).collect()]
    assert one == sorted(one)


@pytest.mark.parametrize("extra", ["", ", shard string, size string, n string"])
def test_empty(spark, tmp_path, extra):
    from docmill.llm.sharding import hilbert_shards, write_shards

    docs = spark.createDataFrame([], COLUMNS + extra)
    assert hilbert_shards(docs).count() == 0
    write_shards(docs, str(tmp_path / "out"))
