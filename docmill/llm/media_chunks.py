"""Media columns stored as content-defined chunks.

A payload becomes an 8-bit grey image of width 192 (binary PGM).  A rolling gear
hash over the image's bytes sets chunk borders by content, so that equal passages
give equal chunks wherever they stand.  Equal media are stored once, by the least
(doc_id, text hash) that has them; chunk digests of different media are deduplicated
by Spark joins: of all holders of a digest the smallest medium owns it.  A stored
medium keeps its ordered chunk list and the bytes of the chunks it owns; chunks owned
elsewhere are fetched from their owner on reading.  Reading rebuilds each image from
its ordered list, checks every chunk digest and the whole image's digest, decodes the
samples and computes the features from them; all rows of a medium share the result.

Texts and containers are most of what goes to disk.  Block sorting packs a single
short text closer than dictionary coders do, at some 10 MB a second and core.

Only digests are shuffled for deduplication, each text once and compressed for
storing, and only foreign chunks' bytes for reading.  Media with more than a 1024th
of all rows (so at most 1024 of them) are joined back by broadcast; every other table
is shuffled, at any size.

Defined cases: null or empty text is a payload of 192 spaces; equal texts give equal
values; repeated rows give a row each; a null doc_id is the least; an empty table
gives no rows; no chunk is dropped or capped.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, row_count, texts

WIDTH = 192
LEAST, MOST = 256, 16384
MASK = np.uint32(0xFFC00000)  # ten bits: a border every 1024 bytes beyond LEAST on average
SPACE = b" "
DIGEST = 16


def gear_table() -> np.ndarray:
    """256 fixed pseudo-random words, from a digest of each byte value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], dtype=np.uint32)


GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash h = 2h + gear[byte] after each byte, modulo 2**32.

    A byte's weight leaves the word after 32 steps, so the hash is a sum over the
    last 32 bytes, built here by doubling the span it covers five times.
    """
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in range(5):
        span = 1 << k
        if len(h) > span:
            h[span:] += h[:-span] << np.uint32(span)
    return h


def cut(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    marks = np.flatnonzero((gear_hashes(data) & MASK) == 0)
    ends, start = [], 0
    for at in (marks + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def payload_of(text: bytes) -> bytes:
    return text + SPACE * (-len(text) % WIDTH if text else WIDTH)


def encode(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(medium: bytes) -> bytes:
    magic, size, depth, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not an 8-bit grey image")
    return samples


def features(payload: bytes) -> str:
    """Mean, deviation, entropy and an average hash of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    columns = x.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64).reshape(16, -1).sum(axis=1)
    bits = sum(1 << i for i, c in enumerate(columns.tolist()) if 16 * c >= int(columns.sum()))
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};ahash={bits:04x}"


def digest_of(medium: bytes) -> bytes:
    """The 128 bits that name a medium in tables."""
    return hashlib.sha256(medium).digest()[:DIGEST]


def _chunks(medium: bytes) -> tuple[list[bytes], list[int]]:
    ends = cut(medium)
    starts = [0, *ends[:-1]]
    view = memoryview(medium)
    return [hashlib.blake2b(view[a:b], digest_size=DIGEST).digest() for a, b in zip(starts, ends, strict=True)], ends


NO_ID = -(2**63)
HOT_SHARE = 1024
STORED = "medium binary, copies bigint, chunk_list array<binary>, lengths array<int>, own array<boolean>, foreign array<binary>, lent array<binary>, data binary"
_BYTES = pa.list_(pa.binary())
_STORED = (pa.binary(), pa.int64(), _BYTES, pa.list_(pa.int32()), pa.list_(pa.bool_()), _BYTES, _BYTES, pa.binary())


def _emitted(rows: Iterator[tuple[int, tuple]], schema: str, types: tuple, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes from (size, row) pairs."""
    names, held, size = [c.split()[0] for c in schema.split(", ")], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for n, row in rows:
        held.append(row)
        size += n
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def media_containers(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: for every document ``doc_id, medium`` (digest), ``n_bytes``;
    and for every distinct medium, with ``stored``, also ``copies`` (its documents),
    ``chunk_list`` (ordered digests), ``lengths, own`` (per chunk whether its bytes are
    here), ``foreign`` (chunks to fetch), ``lent`` (chunks that others need) and
    ``data`` (the owned bytes, compressed)."""
    given = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(batch):
                media = [encode(payload_of(t)) for t in raw]
                found = [pa.array([digest_of(m) for m in media], pa.binary()), pa.array([len(t) for t in raw], pa.int64()), pa.array([_chunks(m)[0] for m in media], _BYTES)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), part.column("hash"), *found], ["doc_id", "id", "hash", "medium", "n_bytes", "chunks"])

    lists = materialize(given.mapInArrow(digest, "doc_id bigint, id bigint, hash bigint, medium binary, n_bytes bigint, chunks array<binary>"), "chunk-digests")
    first = F.min(F.struct("id", "hash", "chunks")).alias("first")
    distinct = materialize(lists.groupBy("medium").agg(first, F.count(F.lit(1)).alias("copies")), "chunk-media")
    held = distinct.select("medium", F.explode(F.array_distinct("first.chunks")).alias("digest"))
    owners = held.groupBy("digest").agg(F.min("medium").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    mine = F.col("medium") == F.col("owner")
    shared = held.join(owners, "digest").groupBy("medium").agg(F.collect_list(F.when(~mine, F.col("digest"))).alias("foreign"), F.collect_list(F.when(mine, F.col("digest"))).alias("lent"))
    none = F.array().cast("array<binary>")
    keepers = distinct.join(shared, "medium", "left").select("first.id", "first.hash", "medium", "copies", F.coalesce("foreign", none).alias("foreign"), F.coalesce("lent", none).alias("lent"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array([bz2.compress(t) for t in raw], pa.binary())], ["id", "hash", "text"])

    # The medium's digest is not known before the Python pass, so texts meet their
    # lists by doc_id and text hash; other media of that key are told apart below.
    joined = given.mapInArrow(squeeze, "id bigint, hash bigint, text binary").join(keepers.hint("shuffle_hash"), ["id", "hash"]).drop("id", "hash")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                medium = encode(payload_of(bz2.decompress(x["text"]) if x["text"] else b""))
                if digest_of(medium) != x["medium"]:
                    continue
                chunks, ends = _chunks(medium)
                starts = [0, *ends[:-1]]
                known, own = set(x["foreign"]), []
                for c in chunks:  # a chunk that the medium repeats is kept once
                    own.append(c not in known)
                    known.add(c)
                data = bz2.compress(b"".join(medium[a:b] for a, b, o in zip(starts, ends, own, strict=True) if o))
                yield len(data), (x["medium"], x["copies"], chunks, [b - a for a, b in zip(starts, ends, strict=True)], own, x["foreign"], x["lent"], data)

    kept = materialize(joined.mapInArrow(lambda batches: _emitted(stored(batches), STORED, _STORED), STORED), "media-containers")
    documents = lists.select("doc_id", "medium", "n_bytes", F.lit(False).alias("stored"))
    return documents.unionByName(kept.withColumn("stored", F.lit(True)), allowMissingColumns=True)


def _owned(row_list, lengths, own, data) -> dict[bytes, bytes]:
    raw, at, out = bz2.decompress(data) if data else b"", 0, {}
    for c, n, o in zip(row_list, lengths, own, strict=True):
        if o:
            out[c] = raw[at : at + n]
            at += n
    return out


VALUES = "medium binary, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string"
_VALUES = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary())


def read_media(containers: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rebuild every medium from its chunk list, verify and decode it; one row per
    document with the values of its medium."""
    documents, stored = containers.where("not stored").select("doc_id", "medium", "n_bytes"), containers.where("stored")

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[bytes, bytes] = {}
            for x in batch.to_pylist():
                owned = _owned(x["chunk_list"], x["lengths"], x["own"], x["data"])
                rows.update((c, owned[c]) for c in x["lent"])
            yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.binary()), pa.array(rows.values(), pa.binary())], ["digest", "bytes"])

    # Repeated rows may store the same chunks; one copy is lent.
    lent = stored.where(F.size("lent") > 0).select("chunk_list", "lengths", "own", "lent", "data").mapInArrow(lend, "digest binary, bytes binary").dropDuplicates(["digest"])
    borrowed = stored.where(F.size("foreign") > 0).select("medium", F.explode("foreign").alias("digest")).distinct().join(lent, "digest")
    borrowed = borrowed.groupBy("medium").agg(F.collect_list(F.struct("digest", "bytes")).alias("borrowed"))
    columns = ["medium", "chunk_list", "lengths", "own", "data"]
    schema = VALUES + (", payload binary" if with_payload else "")
    types = _VALUES if with_payload else _VALUES[:-1]

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                known = _owned(x["chunk_list"], x["lengths"], x["own"], x["data"])
                known |= {b["digest"]: b["bytes"] for b in x.get("borrowed") or ()}
                medium = b"".join(known[c] for c in x["chunk_list"])
                if any(hashlib.blake2b(known[c], digest_size=DIGEST).digest() != c for c in set(x["chunk_list"])) or digest_of(medium) != x["medium"]:
                    raise ValueError(f"the medium {x['medium'].hex()} does not match its digest")
                payload = decode(medium)
                row = (x["medium"], len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(medium), hashlib.sha256(medium).digest(), features(payload), payload)
                yield len(payload) * with_payload + 300, row[: len(types)]

    def rebuild(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: _emitted(rebuilt(batches), schema, types), schema)

    alone = rebuild(stored.where(F.size("foreign") == 0).select(columns))
    joined = rebuild(stored.where(F.size("foreign") > 0).select(columns).join(borrowed, "medium"))
    values = materialize(alone.unionAll(joined).dropDuplicates(["medium"]), "media-values")
    often = max(HOT_SHARE, row_count(documents) // HOT_SHARE)
    hot = F.broadcast(stored.where(F.col("copies") > often).select("medium").distinct())  # at most HOT_SHARE rows
    rare = documents.join(hot, "medium", "left_anti").join(values, "medium")
    common = documents.join(hot, "medium", "left_semi").join(F.broadcast(values.join(hot, "medium", "left_semi")), "medium")
    names = [c.split()[0] for c in schema.split(", ")][1:]
    found = rare.unionByName(common).select("doc_id", "n_bytes", *names)
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
