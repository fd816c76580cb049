"""Personal data by patterns and by bootstrapped contexts, in SQL functions only.

Base kinds (email, ip, card, phone) are found by regular expressions.  They
are the seeds of a bootstrap: every identifier-like token is an instance, the
one and two words before it (with their kind of spacing dropped) are its
lexical patterns, and the distinct (pattern, instance) pairs form a graph.
In turns, a pattern's confidence is the mean score of its instances, and an
instance that no base kind covers gets the best confidence of its patterns.
Instances of trusted patterns then count as seeds do, turn by turn, until no
pattern is added.  Instances that trustworthy patterns introduce are the further spans, of kind
``context``; base spans always stay.

The texts are read once; what the bootstrap needs (positions, tokens,
patterns) is written to the shared folder.  Graph edges are distinct pairs,
combined before the shuffle, so copies of a text add nothing; both sums per
pattern and maxima per instance are partial aggregates, so a hot pattern
doesn't gather in one task.

Defined results: null text is the empty text and has no spans; repeated rows
give repeated results; without any seed nothing is discovered; other columns
are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, whole_text, written
from .spans import find_all, joined, labelled, let, touching

ROUNDS = 3
MIN_CONFIDENCE = 0.8
#: Distinct seed instances a pattern needs before it is trusted.
MIN_SUPPORT = 3


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _ip_ok(found: Column) -> Column:
    def part_ok(p: Column) -> Column:
        plain = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return (F.length(plain) <= 3) & (F.when(F.length(plain) <= 3, plain).cast("int") <= 255)

    return F.forall(F.split(found, r"\."), part_ok)


def luhn_ok(digits: Column) -> Column:
    """Luhn's check of a short string of digits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, d: a + d) % 10 == 0


def _card_ok(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(16, 19), luhn_ok(digits)).otherwise(False)


def _phone_ok(found: Column) -> Column:
    return F.length(_digits(found)).between(8, 15)


# Fixed values of the base kinds, written so that each text is passed over
# once: a match can only begin where a run begins or the last match ended
# ((?<!..)|\G), repeats give nothing back (++), and cards state their least
# number of digits.  They find the same matches as the plain expressions.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_ok),
    ("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", _card_ok),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_ok),
)
KINDS = tuple(k for k, _, _ in BASE)
#: Identifier-like tokens: an address with @, a long number, or a short code with digits.
INSTANCE = (r"(?<![A-Za-z0-9_.@+%-])(?:[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{3,80}|\+?[0-9][0-9().\x20-]{5,22}[0-9]"
            r"|[A-Za-z]{0,6}[_-]?[0-9][A-Za-z0-9_-]{3,40})(?![A-Za-z0-9_])")
#: Characters before an instance that its patterns are taken from.
REACH = 60


def base_spans(text: Column) -> list[Column]:
    return [find_all(text, pattern, accept) for _, pattern, accept in BASE]


def _patterns(before: Column) -> Column:
    """One and two words before an instance, lower-case, digits as 0."""
    words = F.filter(F.split(F.lower(F.regexp_replace(before, "[0-9]", "0")), r"\s+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    return F.when(n >= 2, F.array(F.concat(F.lit("1 "), words[n - 1]), F.concat(F.lit("2 "), words[n - 2], F.lit(" "), words[n - 1]))) \
        .when(n == 1, F.array(F.concat(F.lit("1 "), words[0]))).otherwise(F.array().cast("array<string>"))


def instances(text: Column, spans: list[Column]) -> Column:
    """Identifier-like tokens: (start, end, found, patterns, seed); seed: they touch a base span."""
    def described(tokens: Column) -> Column:
        return F.zip_with(tokens, touching(tokens, F.concat(*spans)), lambda s, seed: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"),
            _patterns(s["before"]).alias("patterns"), seed.alias("seed")))

    return let(find_all(text, INSTANCE, context=REACH), described)


def pattern_confidence(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows (pattern, confidence) of a graph of distinct (pattern, found, seed).

    A pattern needs ``min_support`` distinct instances that score at least
    ``min_confidence``; its confidence is the mean score of its instances,
    where seeds score 1 and others the best confidence of their patterns in
    the turn before (0 at first).  After ``rounds`` turns the instances of
    patterns with ``min_confidence`` score 1 too and no other score changes
    any more, until a turn adds no such pattern.
    """
    def judged(scored: DataFrame) -> DataFrame:
        return (scored.groupBy("pattern")
                .agg(F.avg("score").alias("confidence"), F.sum((F.col("score") >= min_confidence).cast("int")).alias("support"))
                .filter(F.col("support") >= min_support).select("pattern", "confidence"))

    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds - 1):
        best = (edges.join(judged(scored), "pattern").filter("not seed")
                .groupBy("found").agg(F.max("confidence").alias("best")))
        scored = edges.join(best, "found", "left").select(
            "pattern", "found", "seed",
            F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
    scored = written(scored, "pii-scored")
    known = 0
    while True:
        confidence = written(judged(scored), "pii-patterns")
        trusted = confidence.filter(F.col("confidence") >= min_confidence).select("pattern")
        n = trusted.count()
        if n == known:
            discard(scored)
            return confidence
        known = n
        accepted = scored.join(trusted, "pattern").filter("score < 1").select("found").distinct().withColumn("accepted", F.lit(1.0))
        new = written(scored.join(accepted, "found", "left").select(
            "pattern", "found", "seed", F.coalesce("accepted", "score").alias("score")), "pii-scored")
        discard(scored, confidence)
        scored = new


def scan(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE,
         min_support: int = MIN_SUPPORT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, spans_email, spans_ip, spans_card, spans_phone, spans_context)."""
    body = whole_text(text)
    found = docs.select(F.col(key).alias("row_key"), F.md5(body).alias("text_key"), body.alias("body"),
                        *(s.alias(f"spans_{k}") for k, s in zip(KINDS, base_spans(body), strict=True)))
    found = found.withColumn("instances", instances(F.col("body"), [F.col(f"spans_{k}") for k in KINDS])).drop("body")
    found = written(found, "pii-found")
    tokens = found.select("text_key", F.explode("instances").alias("i")).select("text_key", "i.*")
    pairs = tokens.select("found", "seed", F.explode("patterns").alias("pattern"))
    edges = written(pairs.groupBy("pattern", "found").agg(F.max("seed").alias("seed")), "pii-edges")
    trusted = pattern_confidence(edges, rounds, min_support, min_confidence).filter(F.col("confidence") >= min_confidence)
    unseen = tokens.filter("not seed").select("text_key", "start", "end", "found", F.explode("patterns").alias("pattern"))
    hits = unseen.join(trusted.select("pattern"), "pattern").groupBy("text_key").agg(
        F.collect_set(F.struct("start", "end", "found")).alias("spans_context"))
    hits = hits.select(F.col("text_key").alias("hit_key"), "spans_context")
    return found.join(hits, F.col("text_key") == F.col("hit_key"), "left").select(
        F.col("row_key").alias(key), *(f"spans_{k}" for k in KINDS),
        F.coalesce("spans_context", F.array().cast("array<struct<start:int,end:int,found:string>>")).alias("spans_context"))


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    forms = {k: labelled(F.col(f"spans_{k}"), k, i, by_start=False) for i, k in enumerate((*KINDS, "context"))}
    return scanned.select(
        key, *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(*(forms[k] for k in KINDS)), 256).alias("base_sha256"), joined(*forms.values()).alias("spans"))
