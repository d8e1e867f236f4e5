"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word that precedes another is a context with a restaurant of its own; all context
restaurants share one parent, the restaurant of words, over a uniform base of the V
training words and one class of unknown words.  Seating is sampled by Gibbs sweeps in
the table-count form: a dish's party leaves its restaurant, its tables leave the parent,
and a new number of tables is drawn from the block conditional given all other tables.
Sweeps are chained; after ``BURN_IN`` of them the predictive probabilities are averaged
over ``SAMPLES`` more.  The score of a text is the sum of log10 P(word | word before).

Contexts are one word long: pairs of neighbouring words already fill most of the disk
that the check tool allows, and distinct triples are 0.9 of all tokens.

Scale: pairs (context, word) are dealt by the context's hash into ranges of
``RANGE_TOKENS`` tokens, so a restaurant and its parties share a task.  A context with
more than ``HOT_TOKENS`` tokens is split by word over several ranges, which exchange its
totals between sweeps; their number is at most ``HOT_WORDS``, which bounds what is
broadcast.  Ranges and the words' ranges tell each other of all words of a range when the
first tables are set and when the seating is read off.  In the turns between, only the
parties of two customers or more and their words are sent: a single customer keeps one
table, which is counted once.  Nothing is collected but sums.  The first parties of a
restaurant are reseated one after the other; later ones in chunks no larger than what
was reseated before, against that sweep's totals so far.  The words' restaurant, which
spans all tasks, takes the other tasks' totals of the sweep before.  Scores are added up
in ``WAVES`` blocks of documents, which bounds the disk in use.

Defined cases: null or empty text is the end token alone; a null doc_id is hashed as
an empty text; repeated rows are scored alike and counted each; an empty training set
gives every token probability 1, as the base does; words may be of any length and any
bytes and are told apart by 48 bits of their hash; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize, texts
from docmill.llm.hashing import hashes_at, word_edges, word_hashes

THETA = 1.0
BURN_IN, SAMPLES = 2, 2
RANGE_TOKENS, WORD_RANGE = 1_000_000, 1_000_000
HOT_TOKENS, HOT_WORDS, STRIDE = 250_000, 65_536, 8
WAVES = 4
SLICE = 4_000_000  # bytes of text tokenized at a time
EXACT = 64  # parties up to this size have their conditional tabulated
FEW = 12  # tables up to which larger parties' conditionals are corrected to exact ones
PLAIN = 12  # parties up to this size have theirs multiplied out, without logarithms
SINGLY = 8  # parties of a restaurant that are reseated one by one


# -- seating ---------------------------------------------------------------------
def discount_of(n1: float, n2: float) -> float:
    return float(min(0.95, max(0.05, n1 / (n1 + 2 * n2)))) if n1 else 0.5


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 by Stirling's series behind six recurrence steps."""
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    z = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + z * (1 / 12 - z * z / 360) - np.log(shift)


class Stirling:
    """log of the generalised Stirling numbers S(c, t): the seatings of c customers at
    t tables.  Exact up to ``EXACT`` customers or ``FEW`` tables; beyond by the saddle
    point of the table-size distribution, which is tabulated over the mean size c/t."""

    def __init__(self, d: float):
        self.d = d
        self.table = np.full((EXACT + 1, EXACT + 1), -np.inf)
        self.table[1, 1] = 0.0
        with np.errstate(divide="ignore"):
            for c in range(2, EXACT + 1):
                t = np.arange(1, c + 1)
                self.table[c, 1 : c + 1] = np.logaddexp(self.table[c - 1, : c], self.table[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - d * t, 1e-300)))
        y = np.concatenate([1 - np.logspace(-7, -0.31, 1500), np.logspace(-0.32, -280 * min(1.0, 0.05 / (1 - d) + 0.1), 4000)])
        phi, x = 1 - y**d, 1 - y
        mean = d * x * y ** (d - 1) / phi
        ok = np.isfinite(mean) & (mean > 1) & (np.diff(mean, prepend=0) > 0)
        self.mean, self.phi, self.x = np.log(mean[ok]), np.log(phi[ok] / d), np.log(x[ok])
        self.var = np.log(np.maximum(mean * (1 + (1 - d) * x / y - mean), 1e-12))[ok]

    def log(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Saddle-point value for c customers at t tables."""
        m = np.log(np.maximum(c / t, 1 + 1e-9))
        return _lgamma(c + 1.0) - _lgamma(t + 1.0) + t * np.interp(m, self.mean, self.phi) - c * np.interp(m, self.mean, self.x) - 0.5 * (1.8378770664093453 + np.log(t) + np.interp(m, self.mean, self.var))

    def correction(self, c: np.ndarray) -> np.ndarray:
        """By party, what the saddle point lacks at 1 ... ``FEW`` tables, where the
        explicit sum over j of (-1)^j binomial(t, j) (-jd)_c / (d^t t!) is exact."""
        d, t, j = self.d, np.arange(1, FEW + 1), np.arange(1, FEW + 1)
        factor = -np.array([math.gamma(1 + x) * math.sin(math.pi * x) / math.pi for x in (j * d).tolist()])
        choose = np.array([[(-1) ** k * math.comb(n, k) for n in t.tolist()] for k in j.tolist()])
        terms = np.exp(_lgamma(c[:, None] - j * d) - _lgamma(c - d)[:, None]) * factor
        exact = np.log(np.maximum(terms @ choose, 1e-300)) + _lgamma(c - d)[:, None] - t * math.log(d) - _lgamma(t + 1.0)
        return exact - self.log(c[:, None], t[None, :].astype(float))


class Parent:
    """What a restaurant knows of its parent: the probability that the parent serves a
    dish to the j-th new table, once the party's own tables have left the parent."""

    def __init__(self, mass: np.ndarray, total: np.ndarray, fresh: np.ndarray, discount: float, grows: bool):
        self.mass, self.total, self.fresh, self.discount, self.grows = mass, total, fresh, discount, grows

    def at(self, i: np.ndarray) -> Parent:
        return Parent(self.mass[i], self.total[i], self.fresh[i], self.discount, self.grows)

    def log(self, j: np.ndarray) -> np.ndarray:
        """log probability for the j-th further table, by party and j (2-d)."""
        return np.log(self.served(j))

    def served(self, j: np.ndarray) -> np.ndarray:
        """The probability whose logarithm is :meth:`log`."""
        if not self.grows:
            return np.broadcast_to((self.mass / self.total)[:, None], (len(self.mass), j.shape[-1]))
        more = j - np.where(self.fresh[:, None] & (j > 0), self.discount, 0.0)
        return (self.mass[:, None] + more) / (self.total[:, None] + j)


def seat(count: np.ndarray, others: np.ndarray, parent: Parent, stirling: Stirling, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of parties of ``count`` >= 2 customers, each drawn from its conditional
    S(c, t) * prod_i (theta + d (others + i)) P_i given ``others``, the other tables."""
    out, d = np.ones(len(count), dtype=np.int64), stirling.d
    order = np.argsort(count, kind="stable")
    sizes = count[order]
    for c in np.unique(sizes[sizes <= EXACT]).tolist():
        at = order[np.searchsorted(sizes, c) : np.searchsorted(sizes, c, side="right")]
        if c <= PLAIN:
            out[at] = _seat_small(c, others[at], parent.at(at), stirling, theta, rng)
            continue
        j = np.arange(1, c, dtype=np.float64)[None, :]
        logs = np.zeros((len(at), c))
        np.cumsum(np.log((theta + d * (others[at][:, None] + j)) * parent.at(at).served(j)), axis=1, out=logs[:, 1:])
        logs += stirling.table[c, 1 : c + 1]
        weight = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
        out[at] = 1 + (weight < (rng.random(len(at)) * weight[:, -1])[:, None]).sum(axis=1)
    large = order[np.searchsorted(sizes, EXACT, side="right") :]
    if len(large):
        out[large] = _seat_large(count[large].astype(float), others[large].astype(float), parent.at(large), stirling, theta, rng)
    return out


def _seat_small(c: int, others: np.ndarray, parent: Parent, stirling: Stirling, theta: float, rng: np.random.Generator) -> np.ndarray:
    """The conditional of parties of c customers, multiplied out table by table."""
    mass, total = (parent.mass - np.where(parent.fresh, parent.discount, 0.0), parent.total) if parent.grows else (parent.mass / parent.total, None)
    ways = np.exp(stirling.table[c, 1 : c + 1]).tolist()
    product, sums = 1.0, [np.full(len(others), ways[0])]
    for j in range(1, c):
        served = (mass + j) / (total + j) if parent.grows else mass
        product = product * ((theta + stirling.d * (others + j)) * served)
        sums.append(sums[-1] + product * ways[j])
    drawn, out = rng.random(len(others)) * sums[-1], np.ones(len(others), dtype=np.int64)
    for x in sums[:-1]:
        out += x < drawn
    return out


def _seat_large(c: np.ndarray, others: np.ndarray, parent: Parent, stirling: Stirling, theta: float, rng: np.random.Generator) -> np.ndarray:
    """The conditional over a grid: first log-spaced over all t, then around the mode."""
    d, a, lacking = stirling.d, theta / stirling.d + others, stirling.correction(c)
    slope = ((1 - lacking[:, -2] / lacking[:, -1]) / math.log(FEW / (FEW - 1)))[:, None]

    def logs(t: np.ndarray) -> np.ndarray:
        # The parent's probability half way through the party stands for its mean.
        served = np.log((parent.mass[:, None] + t / 2) / (parent.total[:, None] + t / 2)) if parent.grows else np.log(parent.mass / parent.total)[:, None]
        k = np.clip(t, 1, FEW) - 1
        below = np.minimum(k.astype(np.int64), FEW - 2)
        low, high = np.take_along_axis(lacking, below, 1), np.take_along_axis(lacking, below + 1, 1)
        # Beyond FEW tables what lacks goes on to fall with log t, down to nothing.
        fall = 1 + slope * np.log(np.maximum(t, FEW) / FEW)
        return stirling.log(c[:, None], t) + (low + (k - below) * (high - low)) * np.clip(fall, 0.0, 1.0) + t * (np.log(d) + served) + _lgamma(a[:, None] + t) - _lgamma(a)[:, None]

    grid = np.exp(np.linspace(0, 1, 20)[None, :] * np.log(c)[:, None])
    near = lambda k: np.take_along_axis(grid, k, 1)
    best = np.clip(logs(grid).argmax(axis=1), 1, grid.shape[1] - 2)[:, None]
    lo, hi = near(best - 1), near(best + 1)
    grid = lo + (hi - lo) * np.linspace(0, 1, 20)[None, :]
    value = logs(grid)
    best = np.clip(value.argmax(axis=1), 1, grid.shape[1] - 2)[:, None]
    f = lambda k: np.take_along_axis(value, k, 1)
    step = near(best) - near(best - 1)
    bend = np.maximum(2 * f(best) - f(best - 1) - f(best + 1), 1e-12)
    reach = np.maximum(12 * step / np.sqrt(bend), step)
    lo, hi = np.floor(np.maximum(1.0, near(best) - reach)), np.minimum(c[:, None], np.ceil(near(best) + reach))
    # Whole numbers where 64 of them suffice, else 64 places of equal width.
    width = np.maximum(1.0, (hi - lo) / 63)
    grid = lo + width * np.arange(64)[None, :]
    value = np.where(grid <= hi + 1e-6, logs(np.minimum(grid, c[:, None])), -np.inf)
    weight = np.exp(value - value.max(axis=1, keepdims=True)).cumsum(axis=1)
    k = (weight < (rng.random(len(c)) * weight[:, -1])[:, None]).sum(axis=1)
    inside = np.where(width[:, 0] > 1, width[:, 0] * (rng.random(len(c)) - 0.5), 0.0)
    return np.clip(np.rint(near(k[:, None])[:, 0] + inside), 1, c).astype(np.int64)


def sweep(room: np.ndarray, count: np.ndarray, tables: np.ndarray, totals: np.ndarray, parent: Parent, stirling: Stirling, theta: float, rng: np.random.Generator) -> None:
    """One Gibbs sweep over the parties of many restaurants (sorted by ``room``), in
    place: ``tables`` by party and ``totals`` by room follow every step."""
    active = np.flatnonzero(count > 1)
    if not len(active):
        return
    rooms = room[active]
    rank = np.arange(len(active)) - np.searchsorted(rooms, rooms)
    step = np.where(rank < SINGLY, rank, SINGLY + np.log2(np.maximum(rank, SINGLY) / SINGLY).astype(np.int64))
    order = np.argsort(step, kind="stable")
    for mine in np.split(active[order], np.flatnonzero(np.diff(step[order])) + 1):
        here = room[mine]
        new = seat(count[mine], totals[here] - tables[mine], parent.at(mine), stirling, theta, rng)
        totals += np.bincount(here, weights=new - tables[mine], minlength=len(totals)).astype(totals.dtype)
        tables[mine] = new


# -- packed rows -----------------------------------------------------------------
def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def word_hash(word: bytes) -> int:
    return int(word_hashes(word)[0][0])


# No word holds a space or is empty, and none is likely to hash to these.
_END, _START = 1, 2


def _pack(h: np.ndarray) -> bytes:
    """48-bit hashes: the lower four bytes of all, then the upper two."""
    return h.astype("<u4").tobytes() + (h >> 32).astype("<u2").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.int64) | (np.frombuffer(blob, "<u2", n, 4 * n).astype(np.int64) << 32)


def _numbers(blob: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(blob, dtype=kind).astype(np.float64 if kind == "<f8" else np.int64)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each, after one byte that says how many."""
    width = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or x.max() < 256**k)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, by hashing."""
    coded = pa.array(x).dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    rank = np.empty(len(found), dtype=np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[coded.indices.to_numpy(zero_copy_only=False)]


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([_arrow(rows, schema)])


class _Slice:
    """The tokens of some texts as ranks of their hashes, with the word before each."""

    def __init__(self, raw: list[bytes]):
        found, starts = word_hashes(b"\n".join(raw).lower())
        ends = np.cumsum([len(t) + 1 for t in raw])
        words = np.diff(np.searchsorted(starts, ends), prepend=0)
        self.sizes = words + 1
        hashes = np.full(int(self.sizes.sum()) + 1, _END, dtype=np.int64)
        hashes[np.arange(len(found)) + np.repeat(np.arange(len(raw)), words)] = found
        hashes[-1] = _START
        self.hashes, w = _ranks(hashes)
        v = np.roll(w, 1)
        v[np.cumsum(self.sizes) - self.sizes] = w[-1]
        self.bits = len(self.hashes).bit_length()  # a pair is the context's rank and the word's, by bits
        self.pair = ((v << self.bits) | w)[:-1]

    def runs(self, pairs: np.ndarray, ranges: int, hot: dict[int, int]) -> Iterator[tuple[int, np.ndarray, tuple[bytes, bytes, bytes]]]:
        """(range, places, (contexts, words per context, words)) of sorted distinct pairs."""
        v, w = pairs >> self.bits, pairs & ((1 << self.bits) - 1)
        home = self.hashes % ranges
        rng = home[v]
        if hot:
            parts = np.ones(len(self.hashes), dtype=np.int64)
            found = np.isin(self.hashes, np.fromiter(hot, dtype=np.int64, count=len(hot)))
            parts[found] = [hot[x] for x in self.hashes[found].tolist()]
            some = np.flatnonzero(found[v])
            rng[some] = (rng[some] + (self.hashes[w[some]] >> 8) % parts[v[some]]) % ranges
        by = np.argsort(rng.astype(np.uint16) if ranges < 65536 else rng, kind="stable")
        edges = np.flatnonzero(np.diff(rng[by], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True):
            mine = by[a:b]
            first = np.flatnonzero(np.diff(v[mine], prepend=-1))
            yield int(rng[mine[0]]), mine, (_pack(self.hashes[v[mine[first]]]), np.diff(first, append=len(mine)).astype("<u4").tobytes(), _pack(self.hashes[w[mine]]))


def frequent_contexts(docs: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of tokens, and the contexts that are split with their number of parts.
    Splitting moves work, not results, so words are counted by every ``STRIDE``-th of each
    text.  A slice names only words that hold more than half of the share looked for, so
    what comes together has a fixed largest size per slice."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in texts(batch, most=SLICE):
                flat = b"\n".join(raw).lower()
                starts, sizes = word_edges(flat)
                total = len(starts) + len(raw)
                words, at = _ranks(hashes_at(flat, starts[::STRIDE], sizes[::STRIDE]))
                n = STRIDE * np.bincount(at, minlength=len(words))
                some = 2 * HOT_WORDS * n >= total
                yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, _START], words[some])), pa.array(np.append([total, len(raw)], n[some]))], ["h", "n"])

    sums = docs.select("text").mapInArrow(tally, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "lm-frequent")
    total = sums.where("h = -1").agg(F.sum("n")).first()[0] or 0
    hot = max(HOT_TOKENS, total // HOT_WORDS)
    ranges = ranges_of(total)
    return total, {r["h"]: min(ranges, -(-r["n"] // hot)) for r in sums.where((F.col("h") >= 0) & (F.col("n") > hot)).collect()}


def ranges_of(tokens: int) -> int:
    return max(12, -(-tokens // RANGE_TOKENS))


PAIRS = "rng int, v binary, n binary, w binary, c binary"
MODEL = "rng int, v binary, n binary, words binary, place binary, c binary"


def pair_counts(docs: DataFrame, ranges: int, hot: dict[int, int]) -> DataFrame:
    """Per range its contexts, their words and the pairs' counts in the training texts;
    pairs of held-out texts are there with count 0."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(batch, most=SLICE):
                s = _Slice(raw)
                train = np.repeat([not held_out(d) for d in part.column("doc_id").to_pylist()], s.sizes)
                keys = np.sort(s.pair * 2 + train)
                first = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
                counts = np.add.reduceat(keys & 1, first)
                rows = [(r, v, n, w, _small(counts[mine])) for r, mine, (v, n, w) in s.runs(keys[first] >> 1, ranges, hot)]
                yield _arrow(rows, PAIRS)

    def merge(table: pa.Table) -> pa.Table:
        column = lambda c, f: np.concatenate([f(x) for x in table.column(c).to_pylist()])
        contexts, at = _ranks(column("v", _unpack))
        v = np.repeat(at, column("n", _numbers))
        words, w = _ranks(column("w", _unpack))
        bits = len(words).bit_length()
        key = (v << bits) | w
        del v, w, at
        c = column("c", _wide)
        most = int(c.max()).bit_length()
        if len(contexts).bit_length() + bits + most < 63:  # counts fit below the key
            key = np.sort((key << most) | c)
            key, c = key >> most, key & ((1 << most) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key, c = key[order], c[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        v, w = key[first] >> bits, key[first] & ((1 << bits) - 1)
        row = (table.column("rng")[0].as_py(), _pack(contexts), _small(np.bincount(v, minlength=len(contexts))), _pack(words), w.astype("<u4").tobytes(), _small(np.add.reduceat(c, first)))
        return _table([row], MODEL)

    posted = docs.select("doc_id", "text").mapInArrow(pairs, PAIRS)
    return materialize(posted.groupBy("rng").applyInArrow(merge, MODEL), "lm-pairs")


# -- sampling --------------------------------------------------------------------
#: Rows between ranges of pairs (rng) and ranges of words (wr).  MODEL_ROW: the pairs of a
#: range; PARTIES: those of two customers or more, which alone are reseated; TABLES: their
#: tables; SENT: tables by word; REPLY: the words' customers and tables, in the order of
#: SENT; KEPT: what a words' range keeps for all turns; WORDS: its state; HOT and SUMS:
#: numbers to be added up.
MAIL = "rng int, wr int, kind int, a binary, b binary, c binary, d binary, e binary, s array<double>"
MODEL_ROW, PARTIES, TABLES, SENT, REPLY, KEPT, WORDS, HOT, SUMS = range(9)


def _mail(rng: int, wr: int, kind: int, *blobs: bytes, s: list[float] | None = None) -> tuple:
    return (rng, wr, kind, *blobs, *[None] * (5 - len(blobs)), s)


class _Seats:
    """Some parties of a range with their words' places in the replies."""

    def __init__(self, rng: int, room: np.ndarray, place: np.ndarray, count: np.ndarray, rows: list[dict]):
        self.rng, self.room, self.place, self.count = rng, room, place, count
        self.tables = next((_wide(r["a"]) for r in rows if r["kind"] == TABLES), np.ones(len(count), dtype=np.int64))
        self.replies = sorted((r for r in rows if r["kind"] == REPLY), key=lambda r: r["wr"])
        if self.replies:
            self.above, self.above_tables = (np.concatenate([_wide(r[x]) for r in self.replies]) for x in "ab")

    def parent(self, g: dict) -> Parent:
        """The words' restaurant without the own tables of each party."""
        customers = self.above[self.place] - self.tables
        base = (THETA + g["d1"] * g["t1"]) * g["base"]
        mass = customers - g["d1"] * np.minimum(self.above_tables[self.place], customers) + base
        return Parent(mass, THETA + g["n1"] - self.tables, customers <= 0, g["d1"], True)

    def sweep(self, totals: np.ndarray, g: dict, rng: np.random.Generator) -> None:
        if len(self.count):
            sweep(self.room, self.count, self.tables, totals, self.parent(g), Stirling(g["d2"]), THETA, rng)


class _Range:
    """The restaurants of one range, from its rows, when the seating is read off."""

    def __init__(self, rows: list[dict], hot: dict[int, tuple[float, float]], samples: int):
        model = next(r for r in rows if r["kind"] == MODEL_ROW)
        self.rng, self.words, self.samples = model["rng"], model["c"], samples
        self.contexts, self.sizes = _unpack(model["a"]), _wide(model["b"])
        self.place, self.count = _numbers(model["d"]), _wide(model["e"])
        self.room = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.many = np.flatnonzero(self.count > 1)
        self.seats = _Seats(self.rng, self.room[self.many], self.place[self.many], self.count[self.many], rows)
        self.customers = np.bincount(self.room, weights=self.count, minlength=len(self.sizes))
        self.totals = np.bincount(self.room, weights=self.tables(), minlength=len(self.sizes))
        for i in np.flatnonzero(np.isin(self.contexts, np.fromiter(hot, dtype=np.int64, count=len(hot)))).tolist():
            self.totals[i], self.customers[i] = hot[int(self.contexts[i])]  # over all ranges, as of the sweep before
        self.known = np.concatenate([_wide(r["c"]) for r in self.seats.replies])
        self.mean_sum = np.concatenate([_numbers(r["d"], "<f8") for r in self.seats.replies])

    def tables(self) -> np.ndarray:
        tables = np.minimum(self.count, 1)
        tables[self.many] = self.seats.tables
        return tables

    def sweep(self, g: dict, rng: np.random.Generator) -> None:
        self.seats.sweep(self.totals, g, rng)

    def predictive(self, g: dict) -> np.ndarray:
        """P(word | context) of every pair under this seating and the mean over the
        sampled seatings of the words' restaurant."""
        mean = (self.mean_sum + _above(self.seats.above, self.seats.above_tables, g)) / self.samples
        seated = THETA + self.customers
        free = (THETA + g["d2"] * self.totals) / seated
        return (self.count - g["d2"] * self.tables()) / seated[self.room] + free[self.room] * mean[self.place]


def _above(customers: np.ndarray, tables: np.ndarray, g: dict) -> np.ndarray:
    return (customers - g["d1"] * tables + (THETA + g["d1"] * g["t1"]) * g["base"]) / (THETA + g["n1"])


def _borders(words: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted((words >> 16) * ranges >> 32, np.arange(ranges + 1))


def _seat_first(rng: int, v: bytes, n: bytes, hashes: bytes, place: bytes, c: bytes, ranges: int, hot: list[int]) -> list[tuple]:
    """Turn 0: every party of a range at one table.  The words' ranges are told of all
    words, and the parties that will be reseated are set apart: only those, and only their
    words and restaurants (and the split ones), take part in the turns that follow."""
    contexts, place, count, words = _unpack(v), _numbers(place), _wide(c), _unpack(hashes)
    room, many = np.repeat(np.arange(len(contexts)), _wide(n)), np.flatnonzero(count > 1)
    per_word = lambda at: np.bincount(place[at], minlength=len(words))
    tables, moving = per_word(np.flatnonzero(count)), per_word(many)
    known = np.bincount(place, weights=count, minlength=len(words)).astype(np.int64)
    cuts = _borders(words, ranges)
    out = [_mail(rng, k, SENT, _pack(words[a:b]), _small(tables[a:b]), _small(known[a:b]), _small(moving[a:b])) for k, a, b in zip(range(ranges), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
    split, parties = np.isin(contexts, np.array(hot, dtype=np.int64)), np.bincount(room[many], minlength=len(contexts))
    kept = np.flatnonzero((parties > 0) | split)
    alone, customers = (np.bincount(room, weights=y, minlength=len(contexts)) for y in (count == 1, count))
    shares = [[float(contexts[kept[i]]), float(customers[kept[i]]), float(i)] for i in np.flatnonzero(split[kept]).tolist()]
    at = (np.cumsum(moving > 0) - 1)[place[many]]
    out.append(_mail(rng, -1, PARTIES, _small(parties[kept]), _small(alone[kept]), _small(at), _small(count[many]), s=[x for share in shares for x in share]))
    out += [_mail(rng, -1, HOT, s=[context, float(alone[kept[int(i)]] + parties[kept[int(i)]]), n]) for context, n, i in shares]
    out.append(_mail(rng, -1, SUMS, s=[float((count == 1).sum()), float((count == 2).sum()), 0.0, 0.0, 0.0, 0.0]))
    return out


def _context_pass(table: pa.Table, g: dict, hot: dict[int, tuple[float, float]], turn: int) -> pa.Table:
    """Reseat the parties of a range and tell the words' ranges."""
    rows = table.to_pylist()
    row = next(r for r in rows if r["kind"] == PARTIES)
    parties, alone = _wide(row["a"]), _wide(row["b"])
    x = _Seats(row["rng"], np.repeat(np.arange(len(parties)), parties), _wide(row["c"]), _wide(row["d"]), rows)
    own = lambda: alone + np.bincount(x.room, weights=x.tables, minlength=len(parties))
    totals, shares = own(), [row["s"][i : i + 3] for i in range(0, len(row["s"]), 3)]
    for context, _, i in shares:  # totals over all ranges, as of the sweep before
        totals[int(i)] = hot[int(context)][0]
    x.sweep(totals, g, np.random.default_rng([1, turn, x.rng]))
    out, told, start = [_mail(x.rng, -1, TABLES, _small(x.tables))], np.bincount(x.place, weights=x.tables), 0
    for r in x.replies:
        n = (len(r["a"]) - 1) // r["a"][0]
        out.append(_mail(x.rng, r["wr"], SENT, None, _small(told[start : start + n])))
        start += n
    now = own() if shares else None
    out += [_mail(x.rng, -1, HOT, s=[context, float(now[int(i)]), n]) for context, n, i in shares]
    return _table(out, MAIL)


def _word_pass(table: pa.Table, g: dict, turn: int, sampling: bool, last: bool) -> pa.Table:
    """Reseat the words of a range (but in turn 0) and answer the ranges of pairs: for the
    parties that are reseated, or in the ``last`` turn for all.  While ``sampling``, the
    state before this turn is added to the mean."""
    rows, out = table.to_pylist(), []
    sent = sorted((r for r in rows if r["kind"] == SENT), key=lambda r: r["rng"])
    first = [r for r in sent if r["a"] is not None]
    if first:
        words, place = _ranks(np.concatenate([_unpack(r["a"]) for r in first]))
        by_word = lambda c: np.concatenate([_wide(r[c]) for r in first])
        total = lambda y: np.bincount(place, weights=y, minlength=len(words)).astype(np.int64)
    if turn:
        kept, state = (next(r for r in rows if r["kind"] == kind) for kind in (KEPT, WORDS))
        wr, still, known, moved = kept["wr"], _wide(kept["a"]), _wide(kept["b"]), _wide(kept["c"])
        told = np.concatenate([np.zeros(0, dtype=np.int64), *[_wide(r["b"]) for r in sent if r["a"] is None]])
        customers = still + np.bincount(moved, weights=told, minlength=len(still)).astype(np.int64)
        before, old = _wide(state["a"]), _wide(state["b"])
        mean = _numbers(state["c"], "<f8") if state["c"] else np.zeros(len(still))
        if sampling:
            mean = mean + _above(old, before, g)
        # A party that lost customers keeps no more tables than it has customers.
        tables = np.clip(before, np.minimum(customers, 1), customers)
        totals = np.array([g["t1"] + float(tables.sum() - before.sum())])
        uniform = Parent(np.full(len(still), g["base"]), np.ones(len(still)), np.zeros(len(still), dtype=bool), 0.0, False)
        sweep(np.zeros(len(still), dtype=np.int64), customers, tables, totals, uniform, Stirling(g["d1"]), THETA, np.random.default_rng([2, turn, wr]))
        ranges, sizes = _wide(kept["d"]), _wide(kept["e"])
    else:
        wr, customers, known, mean = first[0]["wr"], total(by_word("b")), total(by_word("c")), np.zeros(len(words))
        tables, moving = np.minimum(customers, 1), by_word("d")
        sizes = np.array([int((_wide(r["d"]) > 0).sum()) for r in first])
        ranges, sizes, moved = np.array([r["rng"] for r in first])[sizes > 0], sizes[sizes > 0], place[moving > 0]
        out.append(_mail(-1, wr, KEPT, _small(customers - total(moving)), _small(known), _small(moved), _small(ranges), _small(sizes)))
    if last:
        ranges, sizes, moved = np.array([r["rng"] for r in first]), np.array([len(r["a"]) // 6 for r in first]), place
    else:
        out.append(_mail(-1, wr, WORDS, _small(tables), _small(customers), mean.tobytes() if sampling else None))
    ends = np.cumsum(sizes)
    for r, a, b in zip(ranges.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        at = moved[a:b]
        out.append(_mail(r, wr, REPLY, _small(customers[at]), _small(tables[at]), *([_small(known[at]), mean[at].tobytes()] if last else [])))
    out.append(_mail(-1, wr, SUMS, s=[float(f) for f in (known.sum(), (known > 0).sum(), customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())]))
    return _table(out, MAIL)


def _bound(f: Callable[..., pa.Table], *args) -> Callable[[pa.Table], pa.Table]:
    return lambda table: f(table, *args)


def _sums(mail: DataFrame) -> list[float]:
    found = mail.where(F.col("kind") == SUMS).agg(*[F.sum(F.col("s")[i]) for i in range(6)]).first()
    return [x or 0.0 for x in found]


SCORED = "rng int, v binary, n binary, words binary, place binary, p binary, c binary"


def train(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[DataFrame, dict]:
    """The averaged log10 P(word | context) of all pairs by range, and the model's numbers."""
    total, hot_parts = frequent_contexts(docs)
    g = {"ranges": ranges_of(total), "hot": hot_parts, "wr": 1, "n": 0.0, "v": 0.0, "base": 1.0, "n1": 0.0, "t1": 0.0, "d1": 0.5, "d2": 0.5}
    pairs = pair_counts(docs, g["ranges"], hot_parts)
    entries = pairs.agg(F.sum(F.length("words"))).first()[0] or 0
    g["wr"] = max(4, -(-entries // (6 * WORD_RANGE)))
    word_ranges, names = g["wr"], sorted(hot_parts)

    def seat_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _arrow(_seat_first(*batch.slice(i, 1).to_pylist()[0].values(), word_ranges, names), MAIL)

    of = lambda mail, kind: mail.where(F.col("kind") == kind)
    first = materialize(pairs.mapInArrow(seat_first, MAIL), "lm-contexts")
    g["d2"] = discount_of(*_sums(first)[:2])
    hot: dict = {}
    last, up, down, kept = burn_in + samples, first, None, None
    for turn in range(last + 1):
        before, old = up, down
        if turn:
            inputs = of(first, PARTIES).unionAll(of(down, REPLY))
            inputs = inputs if up is first else inputs.unionAll(of(up, TABLES))
            up = materialize(inputs.groupBy("rng").applyInArrow(_bound(_context_pass, dict(g), dict(hot), turn), MAIL), "lm-contexts")
        if hot_parts:
            found = of(up, HOT).groupBy(F.col("s")[0].alias("v")).agg(F.sum(F.col("s")[1]).alias("t"), F.sum(F.col("s")[2]).alias("c")).collect()
            hot = {**hot, **{int(r["v"]): (r["t"], r["c"]) for r in found}}
        inputs = of(up, SENT)
        if turn:
            inputs = inputs.unionAll(of(kept, KEPT)).unionAll(of(down, WORDS))
        if turn and turn == last:
            inputs = inputs.unionAll(of(first, SENT))
        down = materialize(inputs.groupBy("wr").applyInArrow(_bound(_word_pass, dict(g), turn, turn - 1 > burn_in, turn == last), MAIL), "lm-words")
        kept = down if kept is None else kept
        g["n"], g["v"], g["n1"], g["t1"], once, twice = _sums(down)
        g["base"], g["d1"] = 1.0 / (g["v"] + 1), discount_of(once, twice)
        for table in (before, old):
            if not any(table is x for x in (None, up, first, kept)):
                discard(table)
    now, shared = dict(g), dict(hot)

    def finish(table: pa.Table) -> pa.Table:
        x, p = _Range(table.to_pylist(), shared, samples), 0.0
        for turn in range(samples):
            x.sweep(now, np.random.default_rng([3, turn, x.rng]))
            p = p + x.predictive(now)
        row = (x.rng, _pack(x.contexts), _small(x.sizes), x.words, x.place.astype("<u4").tobytes(), (p / samples).astype("<f4").tobytes(), _small(x.known))
        return _table([row], SCORED)

    nothing = F.lit(None)
    model = pairs.select("rng", F.lit(-1).alias("wr"), F.lit(MODEL_ROW).alias("kind"), F.col("v").alias("a"), F.col("n").alias("b"), F.col("words").alias("c"), F.col("place").alias("d"), F.col("c").alias("e"), nothing.cast("array<double>").alias("s"))
    inputs = model.unionAll(of(down, REPLY))
    inputs = inputs if up is first else inputs.unionAll(of(up, TABLES))
    scored = materialize(inputs.groupBy("rng").applyInArrow(finish, SCORED), "lm-scored")
    for table in {id(t): t for t in (pairs, first, kept, up, down)}.values():
        discard(table)
    return scored, g


# -- scoring ---------------------------------------------------------------------
POSTS = "rng int, slice bigint, v binary, n binary, w binary, k binary, docs binary, ids binary"
PARTS = "slice bigint, rng int, docs binary, base binary, score binary, known binary, ids binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _posts(docs: DataFrame, g: dict) -> DataFrame:
    """Per slice and range the distinct pairs, how often they occur and in which texts.
    One row of a slice has its doc_ids and sizes."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, raw in texts(batch, most=SLICE):
                s, n = _Slice(raw), len(raw)
                pair, who = _by_pair(s, n)
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                k = np.diff(first, append=len(pair))
                small = "<u2" if n <= 65536 else "<u4"
                doc_ids = part.column("doc_id").to_pylist()
                head = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + s.sizes.astype("<i8").tobytes() + bytes(d is None for d in doc_ids)
                rows: list[tuple] = [(key % g["ranges"], key, *[None] * 5, head)]
                for r, mine, names in s.runs(pair[first], g["ranges"], g["hot"]):
                    ends = np.cumsum(k[mine])
                    at = np.arange(ends[-1]) + np.repeat(first[mine] - (ends - k[mine]), k[mine])
                    rows.append((r, key, *names, _small(k[mine]), who[at].astype(small).tobytes(), None))
                key += 1
                yield _arrow(rows, POSTS)

    return docs.select("doc_id", "text").mapInArrow(post, POSTS)


def _by_pair(s: _Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all tokens in order with their texts; one sort of both where they fit."""
    who, most = np.repeat(np.arange(n), s.sizes), n.bit_length()
    if 2 * s.bits + most < 63:
        both = np.sort((s.pair << most) | who)
        return both >> most, both & ((1 << most) - 1)
    order = np.argsort(s.pair, kind="stable")
    return s.pair[order], who[order]


def _add(posts: pa.Table, scored: pa.Table, g: dict) -> pa.Table:
    """Sums of one range by text."""
    rows = []
    if scored.num_rows:
        x = scored.to_pylist()[0]
        contexts, words = _unpack(x["v"]), _unpack(x["words"])
        c = _wide(x["c"])
        base, known = np.log10((c + 0.5) / (g["n"] + 0.5 * (g["v"] + 1))), c > 0
        pairs = np.repeat(np.arange(len(contexts)), _wide(x["n"])) * len(words) + _numbers(x["place"])
        score = np.log10(np.maximum(np.frombuffer(x["p"], dtype="<f4").astype(np.float64), 1e-30))
    for y in posts.to_pylist():
        if y["ids"] is not None:
            rows.append((y["slice"], y["rng"], *[None] * 4, y["ids"]))
            continue
        k = _wide(y["k"])
        v, w = np.repeat(np.searchsorted(contexts, _unpack(y["v"])), _numbers(y["n"])), np.searchsorted(words, _unpack(y["w"]))
        at = np.searchsorted(pairs, v * len(words) + w)
        who = np.frombuffer(y["docs"], dtype=f"<u{len(y['docs']) // int(k.sum())}")
        of = np.repeat(np.arange(len(k)), k)
        docs = np.flatnonzero(np.bincount(who))
        sums = [np.bincount(who, weights=values[of])[docs] for values in (base[w], score[at], known[w])]
        rows.append((y["slice"], y["rng"], docs.astype("<u4").tobytes(), sums[0].tobytes(), sums[1].astype("<f4").tobytes(), sums[2].astype("<u4").tobytes(), None))
    return _table(rows, PARTS)


def _finish(table: pa.Table, g: dict) -> pa.Table:
    rows = table.to_pylist()
    head = next(r["ids"] for r in rows if r["ids"] is not None)
    n = len(head) // 17
    ids, sizes, null = np.frombuffer(head, "<i8", n), np.frombuffer(head, "<i8", n, 8 * n), np.frombuffer(head, np.uint8, n, 16 * n)
    sums = np.zeros((3, n))
    # Added in a fixed order, so that reruns agree to the last digit.
    for r in sorted((r for r in rows if r["ids"] is None), key=lambda r: r["rng"]):
        who = np.frombuffer(r["docs"], dtype="<u4")
        for i, (c, kind) in enumerate((("base", "<f8"), ("score", "<f4"), ("known", "<u4"))):
            sums[i, who] += np.frombuffer(r[c], dtype=kind)
    doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
    columns = [pa.array(doc_ids, pa.int64()), pa.array([held_out(d) for d in doc_ids]), pa.array(sizes.astype(np.int64)), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array([int(g["n"])] * n, pa.int64()), pa.array(sums[0]), pa.array(sums[1])]
    return pa.table(columns, names=[c.split()[0] for c in SCORES.split(", ")])


def score_texts(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, waves: int = WAVES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every
    document, the model learned from the documents that are not held out."""
    docs = docs.select("doc_id", "text")
    scored, g = train(docs, burn_in, samples)
    out = None
    for wave in range(waves):
        mine = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(waves)) == wave)
        parts = _posts(mine, g).groupBy("rng").cogroup(scored.groupBy("rng")).applyInArrow(lambda a, b: _add(a, b, g), PARTS)
        part = materialize(parts.groupBy("slice").applyInArrow(lambda t: _finish(t, g), SCORES), "lm-scores")
        out = part if out is None else out.unionAll(part)
    discard(scored)
    return out


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of model and base on held-out and training documents."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
