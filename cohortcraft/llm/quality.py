"""Quality rules as a short-circuit cascade.

Base statistics are computed on every whole text.  The further rules run one
after another on the documents that the base rule keeps, and stop at the
first rejection; their order (rejections per second of cost, highest first)
is measured on a sample beforehand.  The verdict is the AND of all rules, so
it doesn't depend on the order, only the time does.

Map-only apart from the sample: no shuffle and no group, so skew cannot
arise, and a lost task is simply run again.

Defined results: null text is the empty text (no words, base_failed, not
kept); a text of any length is read whole; repeated rows give repeated
results; an empty table gives an empty result; other columns of the input are
not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, slices, small_batches, whole_text

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Documents on which cost and selectivity of the rules are estimated.
SAMPLE_DOCS = 1000
SAMPLE_SEED = 9


@dataclass
class Text:
    """A text with its base statistics."""

    text: str
    words: list[bytes]
    n_symbols: int
    word_chars: int
    n_dup_lines: int
    n_lines: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _mostly_symbols(t: Text) -> bool:
    return 5 * t.n_symbols > len(t.words)


def _odd_word_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.word_chars <= 14 * len(t.words)


def _mostly_repeated_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 3 * t.n_lines


def _mostly_upper(t: Text) -> bool:
    upper = sum(map(str.isupper, t.text.split()))
    return 2 * upper > len(t.words)


def _one_word_dominates(t: Text) -> bool:
    counts: dict[bytes, int] = {}
    for w in t.words:
        counts[w] = counts.get(w, 0) + 1
    return 10 * max(counts.values(), default=0) > 3 * len(t.words)


def _mostly_shouted(t: Text) -> bool:
    return 2 * sum(w.endswith(b"!!") for w in t.words) > len(t.words)


RULES = (
    Rule("mostly_symbols", _mostly_symbols),
    Rule("odd_word_length", _odd_word_length),
    Rule("mostly_repeated_lines", _mostly_repeated_lines),
    Rule("mostly_upper", _mostly_upper),
    Rule("one_word_dominates", _one_word_dominates),
    Rule("mostly_shouted", _mostly_shouted),
)


def describe_text(text: str) -> Text:
    data = text.encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return Text(text, data.split(), symbols, len(text) - spaces, dup, lines)


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text, how many words lie in windows that occur at least twice in that text.

    Exact: words are numbered, then pairs, fours and eights of neighbours, so
    equal numbers mean equal windows (``window`` is a power of two).  The
    texts of a slice are numbered together; a text's number is put in front
    of its windows so that only windows of one text are equal.
    """
    lengths = np.array([len(w) for w in texts], np.int64)
    total = int(lengths.sum())
    out = np.zeros(len(texts), np.int64)
    if total < window:
        return out
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), lengths)
    step = 1
    while step < window:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(doc[: len(ids)] == doc[window - 1:])
    keys = doc[starts] * (int(ids.max()) + 1) + ids[starts]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = starts[counts[inverse] > 1]
    edges = np.zeros(total + 1, np.int64)
    edges[hit] += 1
    np.subtract.at(edges, hit + window, 1)
    np.add.at(out, doc[np.cumsum(edges[:-1]) > 0], 1)
    return out


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def rule_order(docs: DataFrame, rules=RULES, sample_docs: int = SAMPLE_DOCS, text: str = "text") -> list[Rule]:
    """The rules by rejections per second, highest first, as measured on a sample of about ``sample_docs`` texts.

    Every task measures its own share; what is summed is one row per task and rule.
    """
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in slices(batches):
            for value in batch.column(0).to_pylist():
                t = describe_text(value)
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += rule.rejects(t)
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": names, "cost": cost, "rejected": pa.array(rejected, pa.int64())})

    n = docs.count()
    share = min(1.0, sample_docs / n) if n else 1.0
    sample = docs.select(whole_text(text).alias("text")).sample(share, SAMPLE_SEED)  # each task its share, where its rows lie
    measured = {r["rule"]: (r["rejected"] or 0) / max(r["cost"] or 0, 1e-9)
                for r in small_batches(sample).mapInArrow(measure, "rule string, cost double, rejected long")
                .groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()}
    return sorted(rules, key=lambda r: -measured.get(r.name, 0.0))


def apply_rules(docs: DataFrame, rules=RULES, order: list[Rule] | None = None, text: str = "text",
                key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, the base statistics, base_failed and kept."""
    order = rule_order(docs, rules, text=text) if order is None else order
    kind = docs.schema[key].dataType.simpleString()
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in counted) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [describe_text(v) for v in batch.column(1).to_pylist()]
            repeats = repeated_words([t.words for t in texts]).tolist()
            failed = [base_failed(len(t.words), r) for t, r in zip(texts, repeats, strict=True)]
            kept = [not f and not any(rule.rejects(t) for rule in order) for t, f in zip(texts, failed, strict=True)]
            numbers = ([len(t.words) for t in texts], [t.word_chars for t in texts], [t.n_symbols for t in texts],
                       [t.n_dup_lines for t in texts], repeats)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(failed), pa.array(kept)],
                [key, *counted, "base_failed", "kept"])

    return small_batches(docs).select(F.col(key), whole_text(text).alias("__text")).mapInArrow(run, schema)
