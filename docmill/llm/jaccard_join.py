"""N-gram Jaccard self-join by prefix trees: exact links and connected components.

Documents are sets of word 5-gram hashes in one global order (the hash order).

1. Equal sets are one class, whatever their number.
2. A set can only link if three quarters of it also occur in other sets.  Gram
   postings, packed as arrays by hash range, are counted once; a gram that several
   sets of one slice share is posted once for the slice, so a gram held by a third of
   all documents costs a posting per slice.  This leaves the candidates.
3. Candidates' grams are ordered by how many candidates hold them, the rarest first.
   Two linked sets share a gram of their prefixes in that order (the first quarter
   plus one), so passages that many documents quote stay out of the prefixes.
   Candidates joined by prefix grams, through the least class of each gram rather
   than in pairs, form families.
4. Each family's sets are stored in a prefix tree.  Every set traverses the tree
   once: overlaps are accumulated along shared paths, and a subtree is left when its
   remaining lengths cannot reach the threshold.  Families over ``BLOCK`` sets are cut
   by size class and hash into blocks, and all pairs of blocks of equal or neighbouring
   size class are traversed too, so every link between different sets is found once.
5. Where only components are asked for, a subtree is also left when its sets already
   belong to the same component; blocks then share pivot sets, and pairs of blocks are
   traversed only as far as their components still differ.

Defined cases: null or empty text has an empty set, links with nothing and is its own
component; fewer than five words are one gram; repeated rows and ties fall into one
class; a null doc_id is last in order; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import LAST_ID, broadcast_if_small, materialize, texts
from docmill.llm.components import connected_components

N = 5
NUM, DEN = 3, 4  # similarity of NUM/DEN or more
BLOCK = 1000
PIVOTS = 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_sets(raw: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text."""
    words_of = [t.lower().split() for t in raw]
    counts = [len(w) for w in words_of]
    total = sum(counts)
    code = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*words_of)}
    ids = np.fromiter((code[w] for words in words_of for w in words), dtype=np.uint64, count=total)
    out, at = [], 0
    rolled = np.zeros(max(0, total - n + 1), dtype=np.uint64)
    for k in range(n if len(rolled) else 0):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _M1 + ids[k : total - n + 1 + k]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * _M2
    rolled ^= rolled >> np.uint64(29)
    for words, c in zip(words_of, counts, strict=True):
        if c >= n:
            out.append(np.unique(rolled[at : at + c - n + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=c)] if c else [], dtype=np.uint64))
        at += c
    return out


def _mark(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _by_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Borders of the hash ranges in sorted hashes."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def set_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, mark): the size and a 128-bit mark of every set, with a
    hash of the text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(batch):
                sets = gram_sets(raw)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_mark(s) for s in sets], pa.binary())], ["doc_id", "key", "n_shingles", "mark"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(mark, "doc_id bigint, key bigint, n_shingles bigint, mark binary")


POSTED = "rng int, slice bigint, a binary, b binary, c binary"


def _candidates(docs: DataFrame, ranges: int) -> DataFrame:
    """Marks of the sets of which NUM/DEN or more may occur in other sets."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in texts(batch):
                sets = {_mark(s): s for s in gram_sets(raw) if len(s)}
                if not sets:
                    continue
                marks, arrays = list(sets), list(sets.values())
                sizes = np.array([len(s) for s in arrays])
                h = np.concatenate(arrays)
                who = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
                order = np.argsort(h, kind="stable")
                h, who = h[order], who[order]
                first = np.concatenate([[True], h[1:] != h[:-1]])
                many = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
                local = np.repeat(many, np.diff(np.append(np.flatnonzero(first), len(h))))
                known = np.bincount(who[local], minlength=len(sizes))
                h, who = h[first], np.where(many, np.uint16(65535), who[first]).astype(np.uint16)
                key = xxhash.xxh3_64_intdigest(b"".join(marks)) >> 1
                borders = _by_range(h, ranges)
                rows = [(-1, key, b"".join(marks), sizes.astype("<u4").tobytes(), known.astype("<u4").tobytes())]
                rows += [(r, key, _pack48(h[a:b]), who[a:b].tobytes(), b"") for r, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["rng", "slice", "a", "b", "c"])

    def count(table: pa.Table) -> pa.Table:
        """Of one hash range: per slice, how many grams of each set other slices hold."""
        hashes = [_unpack48(x) for x in table.column("a").to_pylist()]
        slices, who = table.column("slice").to_pylist(), [np.frombuffer(x, dtype=np.uint16) for x in table.column("b").to_pylist()]
        h, at = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        shared = np.zeros(len(h), dtype=bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        rows = []
        borders = np.searchsorted(at, np.arange(len(hashes) + 1))
        for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
            found = who[i][shared[a:b]]
            ids, counts = np.unique(found[found != 65535], return_counts=True)
            if len(ids):
                rows.append((0, slices[i], b"", ids.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["rng", "slice", "a", "b", "c"])

    def choose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["rng"] == -1)
        sizes, shared = np.frombuffer(head["b"], dtype="<u4").astype(np.int64), np.frombuffer(head["c"], dtype="<u4").astype(np.int64)
        for r in rows:
            if r["rng"] == 0:
                shared[np.frombuffer(r["b"], dtype="<u2")] += np.frombuffer(r["c"], dtype="<u4").astype(np.int64)
        marks = [head["a"][16 * i : 16 * i + 16] for i in np.flatnonzero(DEN * shared >= NUM * sizes)]
        return pa.table([pa.array(marks, pa.binary())], names=["mark"])

    posted = materialize(docs.select("doc_id", "text").mapInArrow(post, POSTED), "gram-postings")
    counted = posted.where("rng >= 0").groupBy("rng").applyInArrow(count, POSTED)
    # Equal slices (of equal texts) have equal headers; a duplicate header or count
    # only repeats its rows, and the marks are made distinct.
    heads = posted.where("rng = -1").dropDuplicates(["slice"])
    return heads.unionAll(counted).groupBy("slice").applyInArrow(choose, "mark binary").distinct()


def _prefixes(sets: DataFrame, ranges: int) -> DataFrame:
    """(mark, grams) with the prefix of each set, rarest grams first."""

    def post(table: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]), return_counts=True)
        borders, key = _by_range(h, ranges), table.column("slice")[0].as_py()
        rows = [(r, key, h[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)) if b > a]
        return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["rng", "slice", "h", "n"])

    def total(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, dtype=np.uint64) for x in table.column("h").to_pylist()]
        h, place = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([np.frombuffer(x, dtype="<u4") for x in table.column("n").to_pylist()]), minlength=len(h))
        at = np.cumsum([0, *[len(x) for x in hashes]])
        sums = [np.minimum(n[place[a:b]], 2**32 - 1).astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table([table.column("rng").cast(pa.int32()), table.column("slice"), table.column("h"), pa.array(sums, pa.binary())], names=["rng", "slice", "h", "n"])

    def cut(mine: pa.Table, counts: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in counts.column("h").to_pylist()])
        n = np.concatenate([np.frombuffer(x, dtype="<u4") for x in counts.column("n").to_pylist()])
        by = np.argsort(h)
        h, n, out = h[by], n[by], []
        for x in mine.column("grams").to_pylist():
            grams = np.frombuffer(x, dtype=np.uint64)
            order = np.lexsort((grams, n[np.searchsorted(h, grams)]))
            rare = grams[order[: len(grams) - -(-NUM * len(grams) // DEN) + 1]]
            # A gram that no other candidate holds cannot lead anywhere.
            out.append(rare[n[np.searchsorted(h, rare)] > 1].tobytes())
        return pa.table([mine.column("mark"), pa.array(out, pa.binary())], names=["mark", "grams"])

    schema = "rng int, slice bigint, h binary, n binary"
    posted = sets.groupBy("slice").applyInArrow(lambda t: post(t), schema)
    counts = posted.groupBy("rng").applyInArrow(lambda t: total(t), schema)
    return materialize(sets.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(lambda a, b: cut(a, b), "mark binary, grams binary"), "prefixes")


def _families(prefixes: DataFrame, ranges: int) -> DataFrame:
    """Edges (a, b) of marks that join the sets sharing a prefix gram."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, prefixes = batch.column("mark").to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in batch.column("grams").to_pylist()]
            if not any(map(len, prefixes)):
                continue
            order = sorted(range(len(marks)), key=marks.__getitem__)  # places follow marks
            marks, prefixes = [marks[i] for i in order], [prefixes[i] for i in order]
            h, who = np.concatenate(prefixes), np.repeat(np.arange(len(marks)), [len(p) for p in prefixes])
            by = np.lexsort((who, h))
            h, who = h[by], who[by]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            least = who[first][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([who, least], axis=1)[who != least], axis=0)
            rows = [(-1, marks[b], marks[a], b"") for a, b in pairs.tolist()]
            h, who = h[first], who[first]
            borders = _by_range(h, ranges)
            flat = np.array([np.frombuffer(m, dtype=np.uint8) for m in marks])
            rows += [(r, b"", h[a:b].tobytes(), flat[who[a:b]].tobytes()) for r, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["rng", "a", "b", "c"])

    def join(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("b").to_pylist()])
        marks = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, 16) for x in table.column("c").to_pylist()])
        big = np.ascontiguousarray(marks).view(">u8").reshape(-1, 2)
        by = np.lexsort((big[:, 1], big[:, 0], h))
        h, marks = h[by], marks[by]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        least = marks[np.flatnonzero(first)][np.cumsum(first) - 1]
        different = (least != marks).any(axis=1)
        pairs = {(least[i].tobytes(), marks[i].tobytes()) for i in np.flatnonzero(different)}
        return pa.table([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    posted = materialize(prefixes.mapInArrow(post, "rng int, a binary, b binary, c binary"), "prefix-postings")
    far = posted.where("rng >= 0").groupBy("rng").applyInArrow(join, "a binary, b binary")
    return posted.where("rng = -1").select("a", "b").unionAll(far).distinct()


class _Sets:
    """Union-find over the sets of a block."""

    def __init__(self, labels: list):
        self.parent = list(range(len(labels)))
        seen: dict = {}
        for i, label in enumerate(labels):
            if label is not None:
                self.parent[i] = seen.setdefault(label, i)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i


def trie_links(grams: list[np.ndarray], sides: list[int] | None = None, labels: list | None = None, every: bool = False) -> list[tuple]:
    """Links that span the components of a block, or ``every`` link and whether it is
    one of those that span; with ``sides`` only links between different sides count,
    with ``labels`` equal labels are linked already.

    The tree is compressed: a node stands for the sets order[lo:hi], whose grams up
    to ``end`` are equal; its own grams are those from its parent's end on.
    """
    order = sorted(range(len(grams)), key=lambda i: grams[i].astype(">u8").tobytes())
    sets = [grams[i] for i in order]
    sizes = [len(s) for s in sets]
    side = [sides[i] for i in order] if sides else None
    union = _Sets([labels[i] if labels else None for i in order])
    nodes: list[tuple] = []  # lo, hi, own grams, end, shortest, longest, children

    def grow() -> None:
        stack: list[tuple[int, int, int, list | None]] = [(0, len(sets), 0, None)]
        while stack:
            lo, hi, depth, siblings = stack.pop()
            a, b = sets[lo], sets[hi - 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            children: list[int] = []
            if siblings is not None:
                siblings.append(len(nodes))
            nodes.append((lo, hi, a[depth:end], end, min(sizes[lo:hi]), max(sizes[lo:hi]), children))
            i = lo
            while i < hi and sizes[i] == end:  # equal sets end here
                i += 1
            while i < hi:
                gram, j = sets[i][end], i + 1
                step = 1
                while j < hi and sets[j][end] == gram:
                    step = min(2 * step, hi - j)
                    j = j + step if sets[min(hi - 1, j + step - 1)][end] == gram else j + 1
                stack.append((i, j, end, children))
                i = j

    grow()
    out = []
    for q, x in enumerate(sets):
        n = len(x)
        stack = [(0, 0)]
        while stack:
            at, overlap = stack.pop()
            lo, hi, own, end, shortest, longest, children = nodes[at]
            if hi <= q + 1 or DEN * longest < NUM * n or NUM * shortest > DEN * n:
                continue
            if hi - lo == 1 and ((side and side[lo] == side[q]) or (not every and union.find(lo) == union.find(q))):
                continue
            left = n
            if len(own):
                place = np.searchsorted(x, own)
                overlap += int(np.count_nonzero(x[np.minimum(place, n - 1)] == own))
                left = n - int(place[-1])
            # J >= NUM/DEN exactly if overlap * (NUM + DEN) >= NUM * (sum of sizes)
            if (overlap + min(left, longest - end)) * (NUM + DEN) < NUM * (n + shortest):
                continue
            if sizes[lo] == end and overlap * (NUM + DEN) >= NUM * (n + end):
                for y in range(max(lo, q + 1), hi):
                    if sizes[y] != end:
                        break
                    if side and side[y] == side[q]:
                        continue
                    a, b = union.find(y), union.find(q)
                    if every or a != b:
                        union.parent[max(a, b)] = min(a, b)
                        out.append((order[q], order[y], a != b) if every else (order[q], order[y]))
            stack.extend((c, overlap) for c in children)
    return out


LINKS = "a binary, b binary, n bigint"


def _traverse(table: pa.Table, mode: str) -> pa.Table:
    """The links (a, b) of a block: those that ``span`` its components, all ``pairs``,
    or spanning ones and, per set a without b, the ``counts`` n of all its links."""
    marks = table.column("mark").to_pylist()
    grams = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
    sides, labels = (table.column(c).to_pylist() if c in table.column_names else None for c in ("side", "label"))
    links = trie_links(grams, sides, labels, mode != "span") if marks else []
    rows = [(marks[p[0]], marks[p[1]], None) for p in links if mode != "counts" or p[2]]
    if mode == "counts" and links:
        ends = np.bincount(np.array([p[:2] for p in links]).reshape(-1), minlength=len(marks))
        rows += [(marks[i], None, int(ends[i])) for i in np.flatnonzero(ends)]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])


def _real(c: str):
    return F.nullif(F.col(c), F.lit(LAST_ID))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """``class_a, class_b``: every pair of different sets that are similar, once, each
    named by its class (least doc_id with that set), the lesser first."""
    _, classes, links, _ = _join(docs, "pairs")
    name = lambda side: classes.select(F.col("mark").alias(side), F.col("class_id").alias(f"class_{side}"))
    named = links.join(name("a"), "a").join(name("b"), "b")
    both = named.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    return both.select(_real("class_a").alias("class_a"), _real("class_b").alias("class_b"))


def jaccard_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id``, ``class_id`` (least doc_id with an equal
    set) and ``n_links`` (different sets similar to it) per document.  Without
    ``count_links`` there is no such column and only spanning links are sought."""
    marks, classes, links, found = _join(docs, "counts" if count_links else "span")
    joined = classes.join(found.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    least = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = joined.join(least, "component").select("mark", "class_id", "component_id")
    columns = ["doc_id", "n_shingles", *[F.nullif(F.coalesce(c, "doc_id"), F.lit(LAST_ID)).alias(c) for c in ("component_id", "class_id")]]
    if count_links:
        ends = links.where("b is null").groupBy(F.col("a").alias("mark")).agg(F.sum("n").alias("n_links"))
        named = named.join(ends, "mark", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marks.join(named, "mark", "left").select(*columns)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: that of the least
    doc_id (null last), of several texts under it any one.  Rows without words are in no
    group and stay; different texts under one doc_id are apart unless they are linked."""
    marks, _, _, found = _join(docs, "span")
    grouped = marks.where("n_shingles > 0").join(found.withColumnRenamed("node", "mark"), "mark", "left")
    least = grouped.groupBy(F.coalesce("component", "mark").alias("group")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__id"), F.col("key").alias("__key"))).alias("k")).select("k.*")
    plain = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])  # names may clash
    names = {c.lower(): f"__{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    keyed = plain.withColumns({"__id": F.coalesce(names["doc_id"], F.lit(LAST_ID)), "__key": F.xxhash64(names["text"])})
    words = F.coalesce(F.col(names["text"]).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = keyed.where(words).join(least, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return first.unionByName(keyed.where(~words)).select(*plain.columns).toDF(*docs.columns)


def _join(docs: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The sets' marks per document, their classes, the links of ``_traverse`` and,
    but for all pairs, the components (node, component).  Components are joined from
    spanning links: all pairs of a group of near copies would be quadratic there."""
    docs = docs.select("doc_id", "text")
    marks = materialize(set_marks(docs), "set-marks")
    total = marks.agg(F.sum("n_shingles")).first()[0] or 0
    # A range holds about two million postings, whatever the corpus.
    ranges = max(12, math.ceil(total / 2_000_000))
    classes = materialize(marks.where("n_shingles > 0").groupBy("mark").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("class_id")), "set-classes")
    chosen = materialize(classes.join(_candidates(docs, ranges), "mark"), "candidates")
    holders = broadcast_if_small(chosen.select(F.col("class_id").alias("__id")).distinct())
    again = docs.withColumn("__id", F.coalesce("doc_id", F.lit(LAST_ID))).join(holders, "__id", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, raw in texts(batch):
                sets = [s for s in gram_sets(raw) if len(s)]
                columns = [pa.array([_mark(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([key] * len(sets), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "size", "grams", "slice"])
                key += 1

    sets = again.select("text").mapInArrow(build, "mark binary, size int, grams binary, slice bigint")
    sets = materialize(sets.join(chosen.select("mark"), "mark", "left_semi").dropDuplicates(["mark"]), "candidate-sets")
    family = connected_components(_families(_prefixes(sets, ranges), ranges))
    family = materialize(family.withColumnRenamed("node", "mark").withColumnRenamed("component", "family").join(sets.select("mark", "size"), "mark"), "families")
    whole = family.groupBy("family").agg(F.count(F.lit(1)).alias("of_family"))
    # Linked sets' sizes differ by a factor of DEN/NUM at most: by one class.
    grade = F.when(F.col("of_family") <= BLOCK, 0).otherwise(F.floor(F.ln("size") / math.log(DEN / NUM))).cast("int")
    graded = family.join(whole, "family").withColumn("grade", grade)
    count = graded.groupBy("family", "grade").agg(F.count(F.lit(1)).alias("n")).withColumn("spots", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = graded.join(count, ["family", "grade"]).withColumn("spot", F.pmod(F.xxhash64("mark"), F.col("spots")).cast("int"))
    placed = materialize(placed.select("mark", "family", "grade", "spot", "spots", (F.col("of_family") > BLOCK).alias("large")), "blocks")
    large = placed.where("large")
    work = placed.select("mark", "family", "grade", "spot")
    if mode == "span":  # Every block also gets the pivots of its size class's other blocks.
        pivots = large.groupBy("family", "grade", "spot").agg(F.min("mark").alias("mark"), F.first("spots").alias("spots")).where(F.col("spot") < PIVOTS)
        others = pivots.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("spots") - 1))).where("to <> spot").select("mark", "family", "grade", F.col("to").alias("spot"))
        work = work.unionAll(others)
    links = work.join(sets.select("mark", "grams"), "mark").groupBy("family", "grade", "spot").applyInArrow(lambda t: _traverse(t, mode), LINKS)
    links = materialize(links, "links")
    components = lambda: connected_components(links.where("b is not null").select("a", "b"))
    found = components() if mode == "span" else None
    if not large.isEmpty():
        links = links.unionAll(_crossing(large, found, sets, mode))
        found = components() if mode == "span" else None
    return marks, classes, links, components() if mode == "counts" else found


def _crossing(large: DataFrame, found: DataFrame | None, sets: DataFrame, mode: str) -> DataFrame:
    """The links between blocks of one family; given the components ``found`` so far,
    for the pairs of blocks whose sets are not all in one component yet."""
    later = F.expr("i.family = j.family and ((i.grade = j.grade and i.spot < j.spot) or i.grade + 1 = j.grade)")
    label = []
    if found is not None:
        large = materialize(large.join(found.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("component", "mark")).drop("component"), "labelled")
        label = ["label"]
        later = later & ~F.expr("i.lo = i.hi and j.lo = j.hi and i.lo = j.lo")
    per = large.groupBy("family", "grade", "spot").agg(*[f(c).alias(n) for c in label for f, n in ((F.min, "lo"), (F.max, "hi"))] or [F.count(F.lit(1)).alias("n")])
    pairs = per.alias("i").join(per.alias("j"), later).select("i.family", F.struct("i.grade", "i.spot").alias("x"), F.struct("j.grade", "j.spot").alias("y"))
    sides = pairs.withColumn("at", F.explode(F.array("x", "y"))).select("family", "x", "y", "at.grade", "at.spot")
    work = sides.join(large, ["family", "grade", "spot"]).select("family", "x", "y", F.concat_ws(":", "grade", "spot").alias("side"), *label, "mark").join(sets.select("mark", "grams"), "mark")
    return materialize(work.groupBy("family", "x", "y").applyInArrow(lambda t: _traverse(t, mode), LINKS), "links")
