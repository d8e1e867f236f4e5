"""Quality rules by line labelling: a linear-chain conditional random field.

Each line with a word is labelled content or boilerplate by Viterbi decoding over
the document's line sequence; the share of words in content lines decides whether
a document stays.  Beside it stand the base counts (words, symbols, duplicate
lines, words in repeated 8-word windows).

The field is fitted by gradient ascent on at most ``FIT_DOCUMENTS`` labelled
documents (the ones of smallest hash), whose lines take their document's quality
label.  Decoding covers every document.  Without labels of both kinds the fixed
weights ``PRIOR`` are used.

Defined cases: a null or empty text has no words and fails the base rules; lines
without a word are skipped; repeated rows get equal results; ties in decoding go to
content; nulls and further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import texts

FIT_DOCUMENTS = 1500
FIT_LINES = 64  # labelled sequences are fitted in runs of so many lines
KEEP_SHARE = 0.5
WINDOW = 8
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LOWER = bytes(range(97, 123))
FEATURES = ("bias", "short", "long", "symbols", "upper", "digits", "pipes", "bangs", "repeats", "stop", "seen", "word_length")
#: Weights of (content - boilerplate) for each feature, and of staying with a label.
PRIOR = (np.array([1.5, -0.3, 0.3, -8.0, -3.0, -2.0, -4.0, -6.0, -4.0, 0.4, -0.5, 0.0]), 0.7)


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, w = len(line), len(words)
    without = lambda chars: n - len(line.translate(None, chars))
    upper = without(_UPPER)
    letters = upper + without(_LOWER)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return (
        1.0, float(w < 5), min(w, 60) / 60.0, min(1.0, 4.0 * without(_SYMBOLS) / n), upper / letters if letters else 0.0, without(_DIGITS) / n, min(1.0, line.count(b"|") / w),
        min(1.0, line.count(b"!") / w), repeats / w, float(line.rstrip(_SPACES)[-1:] in (b".", b"!", b"?", b":")), float(seen), min(2.0, n / w / 10.0),
    )


def text_lines(text: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many of them
    equal an earlier one."""
    features, sizes, before, dups = [], [], set(), 0
    for line in text.split(b"\n"):
        if words := line.split():
            seen = line in before
            dups += seen
            before.add(line)
            features.append(line_features(line, words, seen))
            sizes.append(len(words))
    return features, sizes, dups


def viterbi(scores: list[float], stay: float) -> list[bool]:
    """Best labels (True: content) for per-line scores of content over boilerplate
    and a bonus for keeping a neighbour's label."""
    if not scores:
        return []
    good, bad = scores[0], 0.0
    back: list[tuple[bool, bool]] = []
    for s in scores[1:]:
        from_good, from_bad = good + stay >= bad, good > bad + stay
        good, bad = (good + stay if from_good else bad) + s, (good if from_bad else bad + stay)
        back.append((from_good, from_bad))
    label = good >= bad
    labels = [label]
    for from_good, from_bad in reversed(back):
        label = from_good if label else from_bad
        labels.append(label)
    return labels[::-1]


def fit(sequences: list[np.ndarray], labels: list[int], steps: int = 200, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Maximum conditional likelihood with Adam; forward-backward runs over all
    sequences at once, a position at a time."""
    runs = [(s[i : i + FIT_LINES], y) for s, y in zip(sequences, labels, strict=True) for i in range(0, len(s), FIT_LINES)]
    if len({y for _, y in runs}) < 2:
        return PRIOR
    most = max(len(s) for s, _ in runs)
    x = np.zeros((len(runs), most, len(FEATURES)))
    mask = np.zeros((len(runs), most))
    for i, (s, _) in enumerate(runs):
        x[i, : len(s)], mask[i, : len(s)] = s, 1
    y = np.array([y for _, y in runs], dtype=float)[:, None] * mask
    # Sequences of each quality weigh the same in total, whatever their number.
    share = np.array([1.0 / sum(b == a for _, b in runs) for _, a in runs])[:, None] / 2
    pairs = mask[:, 1:]
    w, stay = PRIOR[0].copy(), PRIOR[1]
    m = v = np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        s = (x @ w) * mask
        fwd, bwd = np.zeros((len(runs), most, 2)), np.zeros((len(runs), most, 2))
        fwd[:, 0, 1] = s[:, 0]
        trans = np.array([[stay, 0.0], [0.0, stay]])
        for t in range(1, most):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + trans, axis=1)
            new[:, 1] += s[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = bwd[:, t + 1].copy()
            ahead[:, 1] += s[:, t + 1]
            new = np.logaddexp.reduce(trans + ahead[:, None, :], axis=2)
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)[:, None]
        p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z) * mask
        ahead = bwd[:, 1:].copy()
        ahead[:, :, 1] += s[:, 1:]
        same = np.exp(np.logaddexp(fwd[:, :-1, 0] + ahead[:, :, 0], fwd[:, :-1, 1] + ahead[:, :, 1]) + stay - z) * pairs
        # Lines of a run share its weight, so that long documents do not dominate.
        each = share / mask.sum(axis=1, keepdims=True)
        grad = np.append(np.einsum("rt,rtf->f", (y - p) * each, x), ((1 - same) * pairs * each).sum()) - decay * np.append(w, stay)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, stay = w + move[:-1], min(4.0, max(0.0, stay + move[-1]))
    return w, float(stay)


def fit_on_labels(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> tuple[np.ndarray, float]:
    """Fit on the texts of at most ``most`` labelled documents, chosen by hash."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    found = [(np.array(f), r["quality"]) for r in rows if (f := text_lines((r["text"] or "").encode("utf-8", "surrogatepass"))[0])]
    return fit([f for f, _ in found], [int(q) for _, q in found])


def repeated_words(words_of: list[list[bytes]]) -> list[int]:
    """Per text, the words that lie in an 8-word window found twice or more in it."""
    counts = [len(w) for w in words_of]
    total = sum(counts)
    if total < WINDOW:
        return [0] * len(counts)
    ids = np.fromiter((hash(w) for words in words_of for w in words), dtype=np.int64, count=total).view(np.uint64)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    rolled = np.zeros(total - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : total - WINDOW + 1 + k]
    inside = doc[: len(rolled)] == doc[WINDOW - 1 :]
    rolled = (rolled ^ (doc[: len(rolled)] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(inside)
    order = at[np.argsort(rolled[at])]
    same = rolled[order[1:]] == rolled[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    suspects = np.unique(doc[order[twice]]) if twice.any() else []
    out = [0] * len(counts)
    for d in suspects:  # equal hashes only point at texts; the windows themselves decide
        words = words_of[int(d)]
        windows: dict[tuple[bytes, ...], int] = {}
        covered = bytearray(len(words))
        for i in range(len(words) - WINDOW + 1):
            first = windows.setdefault(tuple(words[i : i + WINDOW]), i)
            if first != i:
                covered[first : first + WINDOW] = covered[i : i + WINDOW] = b"\x01" * WINDOW
        out[int(d)] = sum(covered)
    return out


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_words bigint, kept boolean"


def quality(docs: DataFrame, model: tuple[np.ndarray, float], keep_share: float = KEEP_SHARE, carry: bool = False) -> DataFrame:
    """Base counts and verdict per document; ``carry`` keeps all columns of ``docs``
    in front of them (a column of the same name gives way to ours)."""
    weights, stay = model[0].tolist(), model[1]
    ours = [f.split()[0] for f in RESULT.split(", ")]
    cols = [c for c in docs.columns if c.lower() not in ours] if carry else ["doc_id"]
    given = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, "text"])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(batch):
                words_of = [t.split() for t in raw]
                out: list[list] = [[] for _ in ours]
                for text, words, repeats in zip(raw, words_of, repeated_words(words_of), strict=True):
                    features, sizes, dups = text_lines(text)
                    scores = [sum(map(float.__mul__, f, weights)) for f in features]
                    content = sum(n for n, good in zip(sizes, viterbi(scores, stay), strict=True) if good)
                    n = len(words)
                    chars = len(text.decode("utf-8", "surrogatepass")) - (len(text) - len(text.translate(None, _SPACES)))
                    failed = n < 20 or 100 * repeats > 30 * n
                    symbols = len(text) - len(text.translate(None, _SYMBOLS))
                    for column, value in zip(out, (n, chars, symbols, dups, repeats, failed, content, not failed and content >= keep_share * n), strict=True):
                        column.append(value)
                types = [pa.bool_() if name in ("base_failed", "kept") else pa.int64() for name in ours]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in cols], *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], [*cols, *ours])

    schema = given.select(*[F.col(f"`{c}`") for c in cols]).schema
    from pyspark.sql import types as T

    return given.mapInArrow(judge, T.StructType([*schema.fields, *T._parse_datatype_string(RESULT).fields]))
