"""Secret scans through a trigram inverted index, in SQL functions only.

For every rule a Boolean query over trigrams is derived from its regular
expression: a match of ``AKIA[A-Z0-9]+`` must hold the trigrams ``aki`` and
``kia``.  The index maps each trigram that some query asks for to the texts
that hold it (texts are lower-cased, so one index serves rules in any case).
Intersecting and uniting posting lists gives each rule's candidates, and
only those are verified with the regular expression.  Rules whose query is
empty, such as ``[0-9a-f]{24,}``, scan every text.

Postings are keyed by the 64-bit hash of the text, so copies share them and
are combined before the shuffle.  Two texts with the same hash would share
postings too; as queries have no negation that could only add candidates,
which the verification refuses.  A hot key is one hash with many copies: they
are salted by their other columns, and each candidate goes to all salts.

Defined results: null text is the empty text and has no spans; a text of any
length is scanned whole, in proportion to its length and matches; repeated
rows give repeated results; other columns are not read; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import whole_text
from .spans import SPAN, find_all, joined, labelled

#: Strings that a part of an expression may stand for, at most, before it counts as unknown.
MAX_STRINGS = 16
#: Partitions that copies of a text are dealt to.
SALTS = 16
#: Trigrams asked for in a row, at most; fewer only mean more candidates to verify.
MAX_TRIGRAMS = 4


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression and a test of the whole match (null: accept all)."""

    kind: str
    pattern: str
    accept: Callable[[Column], Column] | None = None
    base: bool = False


# Fixed values of the base kinds.  Two of them state the least length in the
# expression, which finds the same matches: a run of one class is one match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/@]{3,128}@"),
)


# --- trigram queries ---------------------------------------------------------
# A query is ALL (no condition), ("has", trigram), ("and", parts) or ("or", parts).
ALL = ("and", ())


def _trigrams(text: str) -> tuple:
    grams = list(dict.fromkeys(text[i: i + 3] for i in range(len(text) - 2)))
    if len(grams) > MAX_TRIGRAMS:  # spread over the string
        grams = [grams[i * (len(grams) - 1) // (MAX_TRIGRAMS - 1)] for i in range(MAX_TRIGRAMS)]
    return ("and", tuple(("has", g) for g in grams))


def _any(strings: set[str]) -> tuple:
    """What a text must hold if it holds one of ``strings``."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return ("or", tuple(_trigrams(s) for s in sorted(strings)))


def _strings(token) -> set[str] | None:
    """All lower-case strings that a part of an expression stands for, or None if unknown or too many."""
    kind, value = token
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        out: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                out.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < MAX_STRINGS:
                out.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return out if len(out) <= MAX_STRINGS else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence_strings(p) for p in value[1]]
        return None if None in parts else _bounded(set().union(*parts))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, part = value
        inner = _sequence_strings(part)
        if inner is None or high > 4:
            return None
        return _bounded({"".join(p) for n in range(low, high + 1) for p in product(inner, repeat=n)})
    return None


def _bounded(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= MAX_STRINGS else None


def _sequence_strings(tokens) -> set[str] | None:
    out: set[str] | None = {""}
    for token in tokens:
        inner = _strings(token)
        out = None if inner is None or out is None else _bounded({a + b for a in out for b in inner})
        if out is None:
            return None
    return out


def _sequence_query(tokens) -> tuple:
    parts, held = [], {""}
    for token in tokens:
        inner = _strings(token)
        longer = _bounded({a + b for a in held for b in inner}) if inner is not None else None
        if longer is not None:
            held = longer
            continue
        parts.append(_any(held))
        held = {""} if inner is None else inner
        if inner is None:
            kind, value = token
            if kind is op.SUBPATTERN:
                parts.append(_sequence_query(value[-1]))
            elif kind is op.BRANCH:
                parts.append(("or", tuple(_sequence_query(p) for p in value[1])))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                parts.append(_sequence_query(value[2]))
    return ("and", (*parts, _any(held)))


def _simplified(query: tuple) -> tuple:
    if query[0] == "has":
        return query
    parts = tuple(dict.fromkeys(_simplified(p) for p in query[1]))
    if query[0] == "or":
        if ALL in parts or not parts:
            return ALL
    else:
        parts = tuple(p for p in parts if p != ALL)
    return parts[0] if len(parts) == 1 else (query[0], parts)


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query that every text with a match of ``pattern`` fulfils."""
    return _simplified(_sequence_query(_parser.parse(pattern)))


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams_of, query[1]))


def fulfils(query: tuple, held: Column) -> Column:
    """The query over an array column of trigrams."""
    if query[0] == "has":
        return F.array_contains(held, query[1])
    parts = [fulfils(p, held) for p in query[1]]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, parts)


# --- index, candidates, verification -----------------------------------------
def build_index(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Postings (trigram, text_key) of the trigrams that the rules' queries ask for."""
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    folded = docs.select(F.xxhash64(whole_text(text)).alias("text_key"), F.lower(whole_text(text)).alias("folded"))
    held = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("folded"), t))
    return folded.select("text_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Per text_key, the kinds whose query its postings fulfil (texts without any are left out).

    A text's postings are at most the trigrams of the queries, a fixed number.
    """
    held = index.groupBy("text_key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*(
        F.when(fulfils(q, F.col("held")), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern)) != ALL)))
    return held.select("text_key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def scan(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with one array column ``spans_<kind>`` per rule: (start, end, found) in code points."""
    docs = docs.drop("__key", "__text_key", "__kinds", "__salt", "__text_salt", *(f"spans_{r.kind}" for r in rules))
    found = candidates(build_index(docs, rules, text), rules)
    # Copies share a key: they are dealt to SALTS partitions, and each candidate, a few bytes, to all of them.
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType))), F.lit(SALTS))
    own = docs.withColumn("__key", F.xxhash64(whole_text(text))).withColumn("__salt", salt)
    asked = found.select(F.col("text_key").alias("__text_key"), F.col("kinds").alias("__kinds"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__text_salt"))
    both = own.join(asked, (F.col("__key") == F.col("__text_key")) & (F.col("__salt") == F.col("__text_salt")), "left")

    def spans(rule: Rule) -> Column:
        every = find_all(whole_text(text), rule.pattern, rule.accept)
        if trigram_query(rule.pattern) == ALL:
            return every
        return F.when(F.array_contains("__kinds", rule.kind), every).otherwise(F.array().cast(SPAN))

    return both.select(*(F.col(f"`{c}`") for c in docs.columns), *(spans(r).alias(f"spans_{r.kind}") for r in rules))


def report(scanned: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    forms = {r.kind: labelled(F.col(f"spans_{r.kind}"), r.kind, k, by_start=True) for k, r in enumerate(rules)}
    base = [r.kind for r in rules if r.base]
    return scanned.select(
        key, *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(*(forms[k] for k in base)), 256).alias("base_sha256"), joined(*forms.values()).alias("spans"))


def redact(scanned: DataFrame, rules=RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The scanned documents with the secrets they hold masked in ``text``, without the span columns.

    Only what the spans found is replaced: every distinct match, longest first.
    """
    every = F.array_distinct(F.flatten(F.array(*(F.transform(f"spans_{r.kind}", lambda s: s["found"]) for r in rules))))
    longest_first = F.array_sort(every, lambda a, b: F.length(b) - F.length(a))
    masked = F.when(F.size(every) > 0, F.aggregate(longest_first, whole_text(text), lambda t, m: F.replace(t, m, F.lit(mask))))
    return scanned.withColumn(text, F.coalesce(masked, F.col(text))).drop(*(f"spans_{r.kind}" for r in rules))
