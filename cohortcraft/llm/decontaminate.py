"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

The test items are the indexed documents and every training passage is a
query.  A passage is a window of two chunks, a chunk being as many words as
the longest item, and passages overlap by one chunk, so each item that a text
holds lies whole in some passage.  Scores are BM25 divided by the item's
score with itself, so one threshold serves items of all lengths.

As in block-max WAND, a passage first meets upper bounds: the sum of its
terms' greatest weights over whole posting lists, then per block of items the
sum of the terms' greatest weights inside the block.  Only blocks whose bound
reaches the threshold are scored exactly, and everything at or above the
threshold is retrieved.  (The bounds are evaluated for many passages at a
time with numpy instead of moving one pivot pointer at a time.)  A retrieved
item counts as leaked if most words of its question and of its answer are
found, in shared runs of five words or aligned word by word, so single edited
words hide nothing; the answer is the last sentence, or the last third of the
words of an item of one sentence.

The training side is map-only: no shuffle, no groups, so skew doesn't matter.
The index is sent to the executors in parts of at most MAX_PART_BYTES of item
text; a larger benchmark takes one pass per part, with term statistics over
all items.

Items of fewer than MIN_ITEM_WORDS words, too short for shares of their words,
are leaked where a text holds their whole word sequence; scores and overlaps
are 1 then.

Defined results: null text is the empty text and leaks nothing; items without
a word (null ones too) are not searched for; equal items all count; repeated rows give repeated results; a column of the documents that is
called like the output column is replaced; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, Remembered, distinct, slices, small_batches, words_of

K1, B = 1.2, 0.75
#: Share of an item's score with itself at which it is retrieved.
THRESHOLD = 0.7
#: Blocks of the posting lists, at most; a block holds two items at least.
BLOCKS = 128
RUN = 5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
MIN_ITEM_WORDS = 8
MAX_PART_BYTES = 16 << 20
LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                                ("answer_overlap", pa.float64())]))


def normal(word: bytes) -> str:
    """A word in lower case without the signs around it."""
    plain = word.decode("utf-8", "replace").lower()
    return plain if plain.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", plain)


def normal_words(text: str | None) -> list[str]:
    return [w for w in map(normal, words_of(text)) if w]


def answer_start(text: str) -> int:
    """The place among the item's words where the answer begins."""
    sentences = [s for s in map(normal_words, re.split(r"(?<=[.!?])\s+", text)) if s]
    n = sum(map(len, sentences))
    return n - len(sentences[-1]) if len(sentences) > 1 else n - n // 3


def aligned(item: list[str], passage: list[str]) -> tuple[list[int], list[int]]:
    """The places in the item and in the passage of the words that their best local alignment matches.

    A matched word counts 2, a replaced, missing or added one -1.
    """
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([code[w] for w in item]), np.array([code.get(w, -1) for w in passage])
    across = np.arange(len(b) + 1)
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, w in enumerate(a):
        row = np.maximum(best[i] - 1, 0)
        row[1:] = np.maximum(row[1:], best[i, :-1] + np.where(b == w, 2, -1))
        best[i + 1] = np.maximum.accumulate(row + across) - across
    i, j = map(int, np.unravel_index(np.argmax(best), best.shape))
    here, there = [], []
    while best[i, j] > 0:
        match = a[i - 1] == b[j - 1]
        if best[i, j] == best[i - 1, j - 1] + (2 if match else -1):
            i, j = i - 1, j - 1
            if match:
                here.append(i)
                there.append(j)
        elif best[i, j] == best[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return here[::-1], there[::-1]


def covered(item: list[str], passage: list[str], start: int) -> tuple[float, float]:
    """Shares of the question's and the answer's words that the passage holds.

    A word counts in a run of RUN words which the passage holds anywhere, and
    where the best local alignment matches it.  An answer shorter than a run
    counts whole where it begins within RUN words of the aligned question.
    """
    run = min(RUN, len(item))
    held = {tuple(passage[i: i + run]) for i in range(len(passage) - run + 1)}
    marks = [False] * len(item)
    for i in range(len(item) - run + 1):
        if tuple(item[i: i + run]) in held:
            marks[i: i + run] = [True] * run

    def share(part):
        return sum(part) / len(part) if part else 1.0

    words = set(passage)
    # No alignment reaches more words than the passage has.
    possible = (share([w in words for w in item[:start]]) >= QUESTION_OVERLAP
                and share([w in words for w in item[start:]]) >= ANSWER_OVERLAP)
    if possible and not all(marks):
        here, there = aligned(item, passage)
        for i in here:
            marks[i] = True
        answer = item[start:]
        end = 1 + max((j for i, j in zip(here, there, strict=True) if i < start), default=-1)
        if end and 0 < len(answer) < RUN and any(passage[j: j + len(answer)] == answer for j in range(end, end + RUN + 1)):
            marks[start:] = [True] * len(answer)
    return share(marks[:start]), share(marks[start:])


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from first[i] up to last[i], and the i of each."""
    size = last - first
    owner = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - (ends - size)[owner] + first[owner], owner


class Index:
    """Posting lists of one part of the items, with the greatest weights per list and per block."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float,
                 short: Sequence[tuple[int, str]] = ()):
        self.ids = [i for i, _ in items]
        self.words = [normal_words(t) for _, t in items]
        self.starts = [answer_start(t) for _, t in items]
        self.chunk = max(map(len, self.words), default=1)
        self.terms = {w: k for k, w in enumerate(sorted(set().union(*map(set, self.words))))} if items else {}
        # Short items by their words' numbers; words of short items only come after the terms.
        self.numbers = dict(self.terms)
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.short_ids = [i for i, _ in short]
        for k, (_, t) in enumerate(short):
            own = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in normal_words(t))
            self.short.setdefault(len(own), {}).setdefault(own, []).append(k)
        self.firsts = {n: np.unique([own[0] for own in table]) for n, table in self.short.items()}
        rows = []
        for k, words in enumerate(self.words):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_words)
            weigh = {w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            whole = sum(weigh.values())
            rows += [(self.terms[w], k, v / whole) for w, v in weigh.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows])
        n = len(self.terms)
        self.block = max(2, -(-len(items) // BLOCKS))
        self.n_blocks = -(-len(items) // self.block)
        self.list_max = np.zeros(n)
        np.maximum.at(self.list_max, term, self.weight)
        # Block entries (term, block), in order: where their postings begin, and their greatest weight.
        self.entry = term * max(self.n_blocks, 1) + self.item // self.block
        self.entries, first = np.unique(self.entry, return_index=True)
        self.first = np.append(first, len(rows))
        self.block_max = np.maximum.reduceat(self.weight, first) if len(rows) else np.zeros(0)
        self.block_of = self.entries % max(self.n_blocks, 1)
        self.term_first = np.searchsorted(self.entries, np.arange(n + 1) * max(self.n_blocks, 1))
        # A term found in most blocks counts with its list's greatest weight in all of them, which is a bound too.
        self.common = 2 * np.diff(self.term_first) > self.n_blocks

    def retrieve(self, terms: np.ndarray, chunks: np.ndarray, follows: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(chunk, item, score) of every passage (chunk and the next of its text) that scores an item at the threshold.

        ``terms`` and ``chunks``: the distinct terms of each chunk, by chunk;
        ``follows``: whether a chunk is followed by one of the same text.
        """
        n = len(follows)
        with_next = lambda a: a + np.where(follows.reshape(-1, *[1] * (a.ndim - 1)), np.append(a[1:], a[:1] * 0, axis=0), 0)
        # 1. Bounds over whole lists.
        alive = np.flatnonzero(with_next(np.bincount(chunks, self.list_max[terms], n)) >= THRESHOLD)
        # 2. Bounds over blocks.
        common = self.common[terms]
        everywhere = np.bincount(chunks[common], self.list_max[terms[common]], n)
        t, c = terms[~common], chunks[~common]
        place, owner = _spread(self.term_first[t], self.term_first[t + 1])
        bound = np.bincount(c[owner] * self.n_blocks + self.block_of[place], self.block_max[place], n * self.n_blocks)
        bound = with_next(bound.reshape(n, self.n_blocks) + everywhere[:, None])[alive]
        which, block = np.nonzero(bound >= THRESHOLD)
        passage = alive[which]
        # 3. Exact scores in the blocks that are left.
        chunk_first = np.searchsorted(chunks, np.arange(n + 1))
        for at in range(0, len(passage), 4096):
            p, b = passage[at: at + 4096], block[at: at + 4096]
            last = np.where(follows[p], chunk_first[np.minimum(p + 2, n)], chunk_first[p + 1])
            place, owner = _spread(chunk_first[p], last)
            key = distinct(owner * len(self.terms) + terms[place])  # a term of both chunks counts once
            owner, term = np.divmod(key, len(self.terms))
            entry = term * self.n_blocks + b[owner]
            k = np.minimum(np.searchsorted(self.entries, entry), len(self.entries) - 1)
            hit = self.entries[k] == entry
            k, owner = k[hit], owner[hit]
            place, of = _spread(self.first[k], self.first[k + 1])
            size = self.block
            score = np.bincount(owner[of] * size + self.item[place] % size, self.weight[place], len(p) * size)
            for found in np.flatnonzero(score >= THRESHOLD - 1e-9):
                yield int(p[found // size]), int(b[found // size] * size + found % size), float(score[found])


    def verbatim(self, numbers: np.ndarray) -> list[int]:
        """The short items that a text, given by its words' numbers, holds."""
        found: set[int] = set()
        for n, table in self.short.items():
            heads = numbers[: max(len(numbers) - n + 1, 0)]
            for at in np.flatnonzero(np.isin(heads, self.firsts[n])):
                found.update(table.get(tuple(numbers[at: at + n].tolist()), ()))
        return [self.short_ids[k] for k in sorted(found)]


class Searcher:
    """Finds the leaked items of many texts; one per task."""

    def __init__(self, index: Index):
        self.index, self.term = index, Remembered(REMEMBERED, self._term)

    def _term(self, word: bytes) -> int:
        """The word's number, -1 for a word that no item has, -2 for no word."""
        plain = normal(word)
        return self.index.numbers.get(plain, -1) if plain else -2

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        words = [words_of(t) for t in texts]
        numbers = [np.fromiter(map(self.term.__getitem__, ws), np.int64, len(ws)) for ws in words]
        plain = [np.flatnonzero(a > -2) for a in numbers]
        found = self._scored(words, numbers, plain) if self.index.ids else [[] for _ in texts]
        if self.index.short:
            for out, a, i in zip(found, numbers, plain, strict=True):
                out += [{"item_id": k, "score": 1.0, "question_overlap": 1.0, "answer_overlap": 1.0} for k in self.index.verbatim(a[i])]
        return found

    def _scored(self, words: list[list[bytes]], numbers: list[np.ndarray], plain: list[np.ndarray]) -> list[list[dict]]:
        """The leaked items of MIN_ITEM_WORDS words or more."""
        index, size = self.index, self.index.chunk
        out: list[dict[int, dict]] = [{} for _ in words]
        counts = [-(-len(a) // size) for a in plain]
        first = np.concatenate([[0], np.cumsum(counts)])
        n = int(first[-1])
        if not n:
            return [[] for _ in words]
        terms = np.concatenate([a[i] for a, i in zip(numbers, plain, strict=True)])
        chunks = np.concatenate([first[k] + np.arange(len(i)) // size for k, i in enumerate(plain)])
        follows = np.ones(n, bool)
        follows[[f - 1 for f, c in zip(first[1:], counts, strict=True) if c]] = False
        inside = (terms >= 0) & (terms < len(index.terms))
        key = distinct(chunks[inside] * len(index.terms) + terms[inside])
        chunks, terms = np.divmod(key, len(index.terms))
        doc_of = np.repeat(np.arange(len(words)), counts)
        for chunk, item, score in index.retrieve(terms, chunks, follows):
            doc = int(doc_of[chunk])
            at = chunk - int(first[doc])
            near = plain[doc][max(at - 1, 0) * size: (at + 3) * size]
            question, answer = covered(index.words[item], [normal(words[doc][i]) for i in near], index.starts[item])
            if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
                held = out[doc].get(item)
                if held is None or score > held["score"]:
                    out[doc][item] = {"item_id": index.ids[item], "score": min(score, 1.0), "question_overlap": question,
                                      "answer_overlap": answer}
        return [[found[k] for k in sorted(found)] for found in out]


def build_indexes(items: DataFrame, max_part_bytes: int = MAX_PART_BYTES) -> Iterator[Index]:
    """The index in parts of at most about ``max_part_bytes`` of item text, with statistics over all items."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [normal_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], ["item_id", "text", "words"])

    worded = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
              .mapInArrow(cut, "item_id long, text string, words array<string>").filter(F.size("words") > 0))
    long = F.size("words") >= MIN_ITEM_WORDS
    every = worded.filter(long)
    total = worded.agg(F.count_if(long).alias("n"), F.avg(F.when(long, F.size("words"))).alias("mean"),
                       F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-(total["bytes"] or 0) // max_part_bytes))
    frequency = every.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    numbered = worded.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        both = numbered.filter(F.col("part") == part)
        own = both.filter(long)
        df = {r["word"]: r["df"] for r in own.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
              .join(frequency, "word").collect()}
        rows = sorted((r["item_id"], r["text"]) for r in own.filter("item_id is not null").select("item_id", "text").collect())
        short = sorted((r["item_id"], r["text"]) for r in both.filter(~long & F.col("item_id").isNotNull()).select("item_id", "text").collect())
        yield Index(rows, df, total["n"], total["mean"] or 1.0, short)


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` and ``leaks``: the items that a document holds."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "leaks"]
    sc = docs.sparkSession.sparkContext
    out = small_batches(docs).select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text"), F.array().cast(LEAKS).alias("leaks"))
    schema = out.schema
    for index in build_indexes(items):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(sent.value)
            for batch in slices(batches, 256):
                before = batch.column("leaks").to_pylist()
                found = searcher.leaks(batch.column("__text").to_pylist())
                both = pa.array([a + b for a, b in zip(before, found, strict=True)], LEAK_TYPE)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "__text")), both], [*keep, "__text", "leaks"])

        out = out.mapInArrow(run, schema)
    return out.drop("__text")


def leaked_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and leaked item: key, item_id, score, question_overlap, answer_overlap."""
    return find_leaks(docs, items, [key]).select(key, F.inline("leaks"))
