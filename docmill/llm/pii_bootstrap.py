"""Personal data by bootstrapped contextual extraction.

Base detectors find emails, IPv4 addresses, payment cards and phone numbers.  Their
finds are the seeds.  Every seed, every other run of adjacent tokens of one line that
each carry a digit or an @ (no token but the last ends in punctuation), and every
address spelled with "at" and "dot", is an instance with lexical patterns around it: the two words before, the two
words after, and the word on either side.  Spark scores the bipartite graph of
patterns and instances in rounds, until a round finds nothing new: a pattern's
confidence for a kind is that kind's share of what is believed of its instances, so
unseen instances are no evidence against it; a pattern is used if its RlogF (the
share of its instances that are of the kind, times the logarithm of their number)
shows that it is not one of any text.  An instance's belief is the noisy-or of its
confident patterns.  Instances above the threshold are unseen identifiers: they keep
their kind, count as known from then on, and their places are added to the base spans.

All of it is DataFrame expressions.  Texts without a digit, @ or spelled dot leave
after one search; the graph holds only distinct (pattern, instance) pairs and
is aggregated before it is shuffled, so a pattern next to a third of all identifiers
is one row per task.  The regular expressions are possessive or anchored by
look-behind, so they stay linear on texts without blanks and never recurse.  A pattern
cuts a text into finds and the gaps between them; gaps give the finds' offsets, by running
sums, and their context, so the work is linear in the finds of a text.

Defined cases: a null or empty text has no spans and the digest of the empty string;
repeated rows get equal results; a null doc_id is kept as it is; ties between kinds
go to the kind listed first; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    # \G lets a find start where the last one ended, inside what look-behind sees.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NON = r"[^\x20\x09-\x0D]"
# A token and the blanks behind it, by which the next one of its line is adjacent.
CANDIDATE = rf"(?<!{_NON})[^\x20\x09-\x0D0-9@]*+[0-9@]{_NON}*+[\x20\x09]*+"
_DOT = r"[\x20\x09]++[(\[]?[Dd][Oo][Tt][)\]]?[\x20\x09]++"
SPELLED = rf"(?<!{_NON}){_LOCAL}++[\x20\x09]++[(\[]?[Aa][Tt][)\]]?[\x20\x09]++[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
MIN_SEEDS = 3
MIN_RLOGF = 1.0
PATTERN_CONFIDENCE, BELIEF = 0.75, 0.8


FIND = "struct<gap:int,value:string,left:string,right:string>"
SPAN = "array<struct<start:int,end:int>>"


def finds(pattern: str) -> Column:
    """Leftmost non-overlapping finds in ``text``: the code points between the one before
    and this, the value, and the text up to two words on either side, in lower case with
    single blanks.  What a lambda names is bound as the element of an array of one, so
    that it is computed once."""
    p = F.lit(pattern)
    clean = lambda g: F.regexp_replace(F.lower(g), r"[\x20\x09-\x0D]++", " ")
    bound = F.array(F.struct(F.regexp_extract_all("text", p, F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("g")))
    measured = F.transform(bound, lambda x: F.struct(x["m"].alias("m"), F.transform(x["g"], F.char_length).alias("n"), F.transform(x["g"], clean).alias("g"), F.transform(x["m"], clean).alias("c")))

    def find(x: Column):
        # A gap of less than two words goes on with the find behind it.
        left = lambda i: F.substring_index(F.rtrim(F.concat(F.when(i == 0, "").otherwise(F.get(x["c"], i - 1)), F.get(x["g"], i))), " ", -3)
        right = lambda i: F.substring_index(F.ltrim(F.concat(F.get(x["g"], i + 1), F.coalesce(F.get(x["c"], i + 1), F.lit("")))), " ", 3)
        return lambda v, i: F.struct(F.get(x["n"], i).alias("gap"), v.alias("value"), left(i).alias("left"), right(i).alias("right"))

    return F.when(F.col("text").rlike(pattern), F.get(F.transform(measured, lambda x: F.transform(x["m"], find(x))), F.lit(0)))


def _valid(kind: str):
    """The check that a find of ``kind`` must pass, as a function of its span."""
    if kind == "ip":
        return lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = lambda s: F.translate(s["value"], " -", "")
        return lambda s: F.length(digits(s)).between(13, 19) & F.call_function("luhn_check", digits(s))
    if kind == "phone":
        return lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15)
    return lambda s: s["value"].isNotNull()


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a span: words before, words after, one on each side."""
    before, after = F.regexp_extract(left, "(?:^| )([^ ]+ [^ ]+)$", 1), F.regexp_extract(right, "^([^ ]+ [^ ]+)", 1)
    one, other = F.substring_index(left, " ", -1), F.substring_index(right, " ", 1)
    named = [F.when(before != "", F.concat(F.lit("L "), before)), F.when(after != "", F.concat(F.lit("R "), after)), F.when((one != "") & (other != ""), F.concat(F.lit("B "), one, F.lit(" _ "), other))]
    return F.array_compact(F.array(*named))


def found_texts(docs: DataFrame) -> DataFrame:
    """``row, doc_id`` and the finds of every pattern in a text."""
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    some = F.col("text").rlike("[0-9@]")
    cheap = {"email": "contains(text, '@')", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": "contains(text, '+')"}
    every = {**{k: F.when(some & F.expr(cheap[k]), finds(PATTERNS[k])) for k in KINDS}, "token": F.when(some, finds(CANDIDATE)), "spelled": F.when(F.col("text").rlike(_DOT), finds(SPELLED))}
    return marked.select("row", "doc_id", *[c.cast(f"array<{FIND}>").alias(k) for k, c in every.items()])


def placed_spans(found: DataFrame) -> DataFrame:
    """``row, start, end, value, kind, left, right``: valid base spans with their kind, and
    the other instances, which overlap none of them, with a null kind."""
    names = [*KINDS, "token", "spelled"]
    listed = F.filter(F.array(*[F.struct(F.lit(k).alias("by"), F.col(k).alias("finds")) for k in names]), lambda x: x["finds"].isNotNull())
    each = found.select("row", F.explode(listed).alias("f")).select("row", "f.by", F.posexplode("f.finds").alias("i", "x")).select("row", "by", "i", "x.*")
    along = W.partitionBy("row", "by").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(along).cast("int")
    spans = each.withColumn("end", end).withColumn("start", (F.col("end") - F.char_length("value")).cast("int"))
    valid = F.lit(True)
    for kind in KINDS:
        valid = F.when(F.col("by") == kind, _valid(kind)({"value": F.col("value")})).otherwise(valid)
    spans = spans.where(valid)
    rank = F.when(F.col("by").isin(*KINDS), 0).when(F.col("by") == "spelled", 1).otherwise(2)
    spans = spans.withColumn("rank", rank)
    # The furthest end before a span and the nearest start behind it, by rank.
    forth, back = W.partitionBy("row").orderBy("start", "rank", "end"), W.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"), F.desc("end"))
    ends = lambda r: F.max(F.when(F.col("rank") == r, F.col("end"))).over(forth.rowsBetween(W.unboundedPreceding, -1))
    starts = lambda r: F.min(F.when(F.col("rank") == r, F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    near = spans.withColumns({f"{side}{r}": f(r) for r in (0, 1) for side, f in (("e", ends), ("s", starts))})
    meets = lambda r: F.coalesce(F.col(f"e{r}") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"s{r}") < F.col("end"), F.lit(False))
    near = near.where((F.col("rank") == 0) | ~meets(0)).where((F.col("rank") < 2) | ~meets(1))
    # Adjacent tokens of a line are one instance.
    line = W.partitionBy("row", "by").orderBy("start")
    last, ended = F.lag("end").over(line), F.lag("value").over(line)
    goes_on = (F.col("by") == "token") & (last == F.col("start")) & ended.rlike(r"[^,;:.!?\x20\x09][\x20\x09]+$")
    runs = near.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "value")))
    joined = runs.groupBy("row", "by", "run").agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value"), F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"))
    bare = F.when(F.col("by") == "token", F.regexp_replace("value", r"[\x20\x09]++$", "")).otherwise(F.col("value"))
    kind = F.when(F.col("by").isin(*KINDS), F.col("by"))
    named = joined.withColumn("value", bare).withColumn("end", F.col("start") + F.char_length("value"))
    return named.select("row", "start", "end", F.regexp_replace(F.lower("value"), r"[\x20\x09]++", " ").alias("value"), kind.alias("kind"), _patterns(F.col("left"), F.col("right")).alias("patterns"))


def bootstrap(instances: DataFrame, rounds: int | None = None) -> DataFrame:
    """(value, kind) of the discovered identifiers, from rows of (value, kind or null,
    patterns); by default in as many rounds as find something new."""
    seeds = instances.where("kind is not null").select("value", "kind").distinct().withColumn("belief", F.lit(1.0))
    edges = materialize(instances.select("value", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SEEDS)
    known = instances.where("kind is not null").select("value").distinct()
    open_ = edges.join(known, "value", "left_anti")
    found, done = materialize(seeds.limit(0), "pii-found"), 0
    while rounds is None or done < rounds:
        support = edges.join(seeds.unionAll(found), "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.count(F.lit(1)).alias("seeds"))
        believed = support.groupBy("pattern").agg(F.sum("belief").alias("believed"))
        rlogf = F.col("seeds") / F.col("n") * F.log2(F.col("seeds"))
        confident = support.where(F.col("seeds") >= MIN_SEEDS).join(believed, "pattern").join(size, "pattern").where(rlogf >= MIN_RLOGF)
        confident = confident.withColumn("confidence", F.col("belief") / (F.col("believed") + 0.5)).where(F.col("confidence") >= PATTERN_CONFIDENCE)
        confident = materialize(confident.select("pattern", "kind", "confidence"), "pii-patterns")
        doubt = F.exp(F.sum(F.log(1.0 - F.least("confidence", F.lit(0.999)))))
        fresh = open_.join(broadcast_if_small(confident), "pattern").join(found.select("value"), "value", "left_anti")
        fresh = fresh.groupBy("value", "kind").agg((1.0 - doubt).alias("belief")).where(F.col("belief") >= BELIEF)
        order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        best = fresh.groupBy("value").agg(F.max(F.struct("belief", (-order).alias("o"), "kind")).alias("b")).select("value", "b.kind", "b.belief")
        best = materialize(best, "pii-new")
        if best.isEmpty():
            break
        found, done = materialize(found.unionAll(best), "pii-found"), done + 1
    return found.select("value", "kind")


def _join_spans(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def detect_pii(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Per row ``doc_id``, base spans by kind, and ``added``: (kind, start, end) of
    the identifiers that the bootstrap discovered."""
    texts = materialize(found_texts(docs), "pii-finds")
    instances = materialize(placed_spans(texts), "pii-instances")
    found = bootstrap(instances, rounds)
    of_kind = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end"))))
    base = instances.where("kind is not null").groupBy("row").agg(*[of_kind(k).alias(k) for k in KINDS])
    places = instances.where("kind is null").select("row", "start", "end", "value").join(broadcast_if_small(found), "value")
    added = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    joined = texts.select("row", "doc_id").join(broadcast_if_small(base), "row", "left").join(broadcast_if_small(added), "row", "left")
    return joined.select("doc_id", *[F.coalesce(k, F.expr(f"cast(array() as {SPAN})")).alias(k) for k in KINDS], "added")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    added = F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    both = [F.array_sort(F.concat(k, F.transform(F.filter(added, _of_kind(k)), bare))) for k in KINDS]
    joined = lambda spans: F.array_join(F.concat(*[_join_spans(s, k) for s, k in zip(spans, KINDS, strict=True)]), ",")
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(joined([F.col(k) for k in KINDS]), 256).alias("base_sha256"), joined(both).alias("spans"))
