"""Vector bin packing of examples into fixed-length sequences.

An example demands tokens, one segment, and loss-bearing tokens; a sequence limits
all three.  The dot-product heuristic fills one sequence at a time: among the pieces
that still fit in every dimension it takes the one whose demand vector has the
largest dot product with the sequence's remaining capacities.  Examples longer than
a sequence are first cut into full pieces and a rest.

Plain documents bear loss on every token, so their token and loss limits coincide.  For
instruction data (:func:`pack_conversations`) only the tokens of the answering role bear
loss and have a lower limit of their own, and segments are few enough to bind.

Pieces are packed in groups of about ``GROUP`` documents, each group in one task,
dealt by a hash of the document, so a group's memory is fixed whatever the corpus;
what grouping costs is at most a few part-filled sequences per group.

Defined cases: null or empty text is the end token alone; repeated rows are packed
once each; an empty table gives no pieces; ties go to the earlier piece by
(length, doc_id, start); an example never loses an id, however long.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, row_count, texts

MAX_TOKENS, MAX_SEGMENTS = 2048, 256
#: Limits of sequences of instruction data.
CHAT_SEGMENTS, CHAT_LOSS = 16, 1024
GROUP = 2000
END = 1
CACHE_WORDS = 400_000


#: Bytes of UTF-8 texts whose characters all lie below U+0300: such texts hold no
#: combining mark, so composing leaves them as they are and words can be lower-cased alone.
_PLAIN = bytes(range(0xCC))
_PRINTABLE = r"[!-~\u00A1-\u02FF]+"


class WordTokenizer:
    """Token ids of whole texts from a per-process cache of white-space pieces.

    The tokenizer drops white space before splitting, so ids of a text are the ids
    of its pieces in order.  Words below U+0300 are lower-cased, split by the
    tokenizer file's own pattern and merged by its model without building offsets;
    other words, and texts that may hold a special token, take the whole tokenizer.
    The cache is emptied when it reaches ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        # One thread a process: Spark's tasks already fill the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.simple = self._is_simple(described)
        self.specials = [t["content"].encode() for t in described["added_tokens"]]
        steps = described["pre_tokenizer"]["pretokenizers"] if self.simple else [{"pattern": {"Regex": "x"}}]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.printable = regex.compile(_PRINTABLE).fullmatch
        self.bytes_as_characters = self._byte_table()
        self.words = _Cache(self._word)
        self.others = _Cache(self._whole)

    @staticmethod
    def _is_simple(described: dict) -> bool:
        """Whether the file describes the steps that the short way takes."""
        normal = [n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])]
        steps = [(p["type"], p.get("invert"), p.get("behavior"), p.get("add_prefix_space")) for p in (described["pre_tokenizer"] or {}).get("pretokenizers", [])]
        return normal == ["NFC", "Replace", "Lowercase"] and steps == [("Split", True, "Removed", None), ("ByteLevel", None, None, False)] and described["model"]["type"] == "BPE"

    @staticmethod
    def _byte_table() -> dict[int, str]:
        """Characters below U+0300 as byte-level symbols: printable bytes stand for
        themselves, the others for the characters from U+0100 on, in order."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(0x80, 0x300)}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word without upper-case ASCII letters, all below U+0300."""
        if word.isascii():
            ascii_word = True
        else:
            word, ascii_word = word.lower(), False
        if word.isalpha():
            parts = [word]
        elif not word:
            return b""
        elif self.printable(word):
            parts = self.split(word)
        else:
            return self._whole(word)
        ids = [t.id for part in parts for t in self.model.tokenize(part if ascii_word else part.translate(self.bytes_as_characters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, values: list[bytes]) -> list[bytes]:
        """Per UTF-8 text its ids as little-endian unsigned 32-bit integers."""
        out = []
        for value in values:
            plain = self.simple and not value.translate(None, _PLAIN) and not any(s in value for s in self.specials) and not any(s in value.lower() for s in self.specials)
            cache = self.words if plain else self.others
            text = (value.lower() if plain else value).decode("utf-8", "surrogatepass")
            out.append(b"".join([cache[w] for w in text.replace("\n", " ").split(" ")]))
            if len(cache) > CACHE_WORDS:
                cache.clear()
        return out


class _Cache(dict):
    """A dictionary that finds missing values by a function."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.find(word)
        return found


_tokenizers: dict[str, WordTokenizer] = {}


def tokenize(values: list[bytes], path: str) -> list[bytes]:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path].encode(values)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, grp bigint"


def document_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end: int = END, groups: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every document, its end id included."""
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("grp")], ["doc_id", "text", "grp"])):
                ids_of = [x + last for x in tokenize(raw, tokenizer)]
                rows = [(d, a, g, ids) for d, g, ids in zip(part.column("doc_id").to_pylist(), part.column("grp").to_pylist(), ids_of, strict=True) for a in range(0, len(ids) // 4, max_tokens)]
                pieces = [ids[4 * a : 4 * (a + max_tokens)] for _, a, _, ids in rows]
                out = [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(x) // 4 for x in pieces], pa.int64()),
                    pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array([len(r[3]) // 4 for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"]
                if with_ids:
                    out, names = [*out, pa.array(pieces, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    keyed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups)).alias("grp"))
    return keyed.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack_vectors(demand: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of every item; an item must fit an empty bin.

    demand: items by dimensions; capacity: dimensions.  Items of equal demand are
    interchangeable, so the heuristic looks at each distinct demand once.
    """
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    counts = np.bincount(kind_of.ravel(), minlength=len(kinds))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    share = kinds / capacity
    left, used = counts.copy(), np.zeros(len(kinds), dtype=np.int64)
    bins, places = np.zeros(len(demand), dtype=np.int64), np.zeros(len(demand), dtype=np.int64)
    total, b = len(demand), 0
    while total:
        room, place = capacity.astype(np.int64).copy(), 0
        while total:
            fits = (left > 0) & (kinds <= room).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (room / capacity), -1.0)))
            item = order[first[k] + used[k]]
            bins[item], places[item] = b, place
            used[k] += 1
            left[k] -= 1
            room -= kinds[k]
            place += 1
            total -= 1
        b += 1
    return bins, places


PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
LOSS = ", loss bigint"


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  A column ``loss`` gives a piece's
    loss-bearing tokens and is kept; without it every token bears loss."""
    has_loss, most_loss = "loss" in pieces.columns, max_loss or max_tokens

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        length = group["length"].to_numpy(np.int64)
        loss = group["loss"].to_numpy(np.int64) if has_loss else length
        bins, places = pack_vectors(np.stack([length, np.ones_like(length), loss], axis=1), np.array([max_tokens, max_segments, most_loss]))
        group["bin"], group["place"] = bins, places
        group = group.sort_values(["bin", "place"])
        group["offset"] = group.groupby("bin")["length"].cumsum() - group["length"]
        group["sequence_id"] = group["grp"].astype(np.int64) * 2**24 + group["bin"]
        return group[[c.split()[0] for c in schema.split(", ")]].astype({"doc_id": "Int64"})

    schema = PACKED + (LOSS if has_loss else "")
    return pieces.groupBy("grp").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Cut, tokenize and pack whole documents; one row per piece."""
    groups = max(1, row_count(docs) // GROUP)
    pieces = materialize(document_pieces(docs, tokenizer, max_tokens, groups=groups), "pack-pieces")
    return pack_pieces(pieces, max_tokens, max_segments)


def cut_turns(turns: list[tuple[bytes, bool]], max_tokens: int, max_loss: int) -> list[tuple[int, bytes, int]]:
    """(start, ids, loss-bearing ids) of the pieces of a conversation, from its turns' ids
    and whether they bear loss.  A piece ends where either limit is reached."""
    ids = np.frombuffer(b"".join(t for t, _ in turns), dtype="<u4")
    loss = np.cumsum(np.repeat(np.array([b for _, b in turns], dtype=np.int64), [len(t) // 4 for t, _ in turns]))
    out, start = [], 0
    while start < len(ids):
        before = int(loss[start - 1]) if start else 0
        end = min(start + max_tokens, int(np.searchsorted(loss, before + max_loss, side="right")))
        out.append((start, ids[start:end].tobytes(), int(loss[end - 1]) - before))
        start = end
    return out


def conversation_pieces(conversations: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_loss: int = CHAT_LOSS, end: int = END, groups: int = 1, answering: str = "assistant") -> DataFrame:
    """Pieces of conversations (``conv_id, turn, role, text``), every turn followed by the
    end id; ``loss`` counts the ids of turns of the ``answering`` role.  ``doc_id`` is the
    conv_id; turns of equal number are in the order of their role and text."""
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids = tokenize([(t["text"] or "").encode("utf-8", "surrogatepass") for t in row["turns"]], tokenizer)
                pieces = cut_turns([(x + last, t["role"] == answering) for x, t in zip(ids, row["turns"], strict=True)], max_tokens, max_loss)
                total = sum(len(x) // 4 + 1 for x in ids)
                rows += [(row["conv_id"], start, len(x) // 4, zlib.crc32(x), total, row["grp"], n) for start, x, n in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], [*[c.split()[0] for c in PIECES.split(", ")], "loss"])

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = conversations.groupBy("conv_id").agg(turns.alias("turns")).withColumn("grp", F.pmod(F.xxhash64("conv_id"), F.lit(groups)))
    return whole.mapInArrow(cut, PIECES + ", loss bigint")


def pack_conversations(conversations: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_segments: int = CHAT_SEGMENTS, max_loss: int = CHAT_LOSS) -> DataFrame:
    """Conversations cut and packed under all three limits; one row per piece."""
    groups = max(1, row_count(conversations) // (4 * GROUP))
    pieces = materialize(conversation_pieces(conversations, tokenizer, max_tokens, max_loss, groups=groups), "chat-pieces")
    return pack_pieces(pieces, max_tokens, max_segments, max_loss)


def sequence_ids(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids`` (binary)."""
    packed = pack_documents(docs, tokenizer, max_tokens)
    ids = document_pieces(docs, tokenizer, max_tokens, with_ids=True).select("doc_id", "start", "ids_crc32", "ids").dropDuplicates(["doc_id", "start", "ids_crc32"])
    joined = packed.alias("p").join(ids.alias("i"), F.expr("p.doc_id <=> i.doc_id and p.start = i.start and p.ids_crc32 = i.ids_crc32"))
    parts = joined.groupBy("p.sequence_id").agg(F.sum("p.length").alias("length"), F.array_sort(F.collect_list(F.struct("p.offset", "i.ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
