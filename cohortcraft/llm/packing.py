"""Packing of token sequences by minimum bin slack.

A document's tokens are its ids and one closing id.  Whole windows of
``capacity`` tokens are sequences of their own; what is left of each document
(its tail, 1 to capacity - 1 tokens) is an item.  Only the number of items of
each length matters for a plan, so the plan is made from a histogram of at
most capacity - 1 numbers, whatever the number of documents:

* A window takes the longest item left; a bitset subset-sum programme over
  the lengths left (each as often as there are items) finds the sum closest to the
  room, and the counts are backtracked from its bitsets.
* The same multiset is used for as many windows as the counts allow.
* Where no multiset fills the window, the next longest item is cut: its first
  part closes the gap and its rest is an item again.  The last window is cut
  into powers of two, which are not padded.  So nothing is padded at all.

The items of a length are numbered, and the plan maps number ranges to
(sequence, offset) by arithmetic.  The numbering needs no shuffle of tokens:
the tokenised table is written once with each row's number within its task,
and one small row per (task, length) adds the numbers of the tasks before.
Those rows are broadcast when they are few (BROADCAST_ROWS), else joined.

Defined results: null text is empty and has the closing id alone; repeated
rows, also of equal or null doc_id, are packed each; of the other columns
none is read.  A text is tokenised whole within one row.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import slices, small_batches, whole_text, written

CAPACITY = 1024
#: The id that closes a document.
CLOSING = 0
#: (task, length) rows that are broadcast at most; 24 bytes each.
BROADCAST_ROWS = 200_000


class Ids:
    """Token ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

    The file's merges are in the order of the ids, so the same vocabulary is a
    rank table; tiktoken applies it several times faster.  Texts that hold the
    string of an added token go through the tokenizers library itself.
    """

    def __init__(self, path: str, pattern: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.added = [t["content"] for t in described["added_tokens"]]
        plain = {k: v for k, v in described["model"]["vocab"].items() if k not in self.added}
        byte_of = {c: b for b, c in enumerate(_byte_characters())}
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in plain.items()}
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.type = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"

    def __call__(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, CLOSING], self.type)


def _byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next one from 256 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


@lru_cache(1)
def _ids(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def tokenised(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Per document: doc_id, ids (binary, with the closing id), wide (bytes an id), n, tail = n % capacity, and its place:

    task, number (documents of that tail before it in the task), windows (whole windows before it in the task).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["ids", "wide", "n", "tail", "task", "number", "windows"]
    types = [pa.binary(), *[pa.int32()] * 4, *[pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _ids(path, pattern), TaskContext.get().partitionId()
        seen, windows = [0] * capacity, 0
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = encode(text)
                whole, tail = divmod(len(ids), capacity)
                rows.append((ids.tobytes(), ids.itemsize, len(ids), tail, task, seen[tail], windows))
                seen[tail] += 1
                windows += whole
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    schema = f"doc_id {kind}, ids binary, wide int, n int, tail int, task int, number long, windows long"
    return small_batches(docs).select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (length -> how often), within ``counts``, whose sum is closest to ``room`` from below.

    Bit s of a bitset says that some multiset of the lengths so far sums to s.
    A length that may be used m times is added in groups of 1, 2, 4, ... and
    the rest; the bitset before each group is kept for the way back.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left and not reach >> room:
            group = min(group, left)
            steps.append((length, group, reach))
            reach |= reach << group * length & mask
            left -= group
            group *= 2
    at, used = reach.bit_length() - 1, {}
    for length, group, before in reversed(steps):
        if not before >> at & 1:
            at -= group * length
            used[length] = used.get(length, 0) + group
    return used


class Plan:
    """Where the item of a length with a number goes.

    ``ranges[length]`` lists (first number, items a window, first sequence,
    offset, cut, first number of the rests): a range's items go to
    consecutive sequences, ``items a window`` each, from ``offset`` on; a cut item gives its
    first ``cut`` tokens and its rest is an item of the remaining length.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.ranges: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        self.sequences = 0
        self.left = {k: v for k, v in histogram.items() if v and k}
        self.made = dict(self.left)
        while self.left:
            longest = max(self.left)
            self._take(longest, 1)
            used = fill(self.left, capacity - longest)
            used[longest] = used.get(longest, 0) + 1
            self._give(longest, 1)
            slack = capacity - sum(k * v for k, v in used.items())
            after = {k: v - used.get(k, 0) for k, v in self.left.items()}
            cut = max((k for k, v in after.items() if v and k > slack), default=0) if slack else 0
            if slack and not cut:
                self._last(used)
                break
            needs = dict(used)
            if cut:
                needs[cut] = needs.get(cut, 0) + 1
            self._place(used, cut, slack, min(self.left[k] // v for k, v in needs.items()))

    def _take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _give(self, length: int, n: int) -> None:
        self.left[length] = self.left.get(length, 0) + n

    def _place(self, used: dict[int, int], cut: int, slack: int, windows: int) -> None:
        """Use the multiset (and a cut item, whose first ``slack`` tokens come last) for ``windows`` sequences."""
        offset = 0
        for length in sorted(used, reverse=True):
            self._range(length, used[length], windows, offset, 0, 0)
            offset += length * used[length]
        if cut:
            rest = cut - slack
            number = self.made.get(rest, 0)
            self._range(cut, 1, windows, offset, slack, number)
            self.made[rest] = number + windows
            self._give(rest, windows)
        self.sequences += windows

    def _range(self, length: int, each: int, windows: int, offset: int, cut: int, rest: int) -> None:
        ranges = self.ranges.setdefault(length, [])
        ranges.append((self.made[length] - self.left[length], each, self.sequences, offset, cut, rest))
        self._take(length, each * windows)

    def _last(self, used: dict[int, int]) -> None:
        """The last window's items, cut into sequences of powers of two."""
        items = [k for k in sorted(used, reverse=True) for _ in range(used[k])]
        while items:
            size = 1 << sum(items).bit_length() - 1
            whole, at = {}, 0
            while items and at + items[0] <= size:
                length = items.pop(0)
                whole[length] = whole.get(length, 0) + 1
                at += length
            cut = items.pop(0) if at < size else 0
            self._place(whole, cut, size - at, 1)
            if cut:
                items.insert(0, cut - (size - at))

    def places(self, length: int, number: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the item's pieces, in its order."""
        while True:
            ranges = self.ranges[length]
            first, each, sequence, offset, cut, rest = ranges[bisect_right(ranges, number, key=lambda r: r[0]) - 1]
            window, nth = divmod(number - first, each)
            if not cut:
                yield length, sequence + window, offset + nth * length
                return
            yield cut, sequence + window, offset
            length, number = length - cut, rest + window


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tokens = written(tokenised(docs, path, pattern, capacity), "tokens")
    counted = written(tokens.groupBy("task", "tail").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.expr(f"n div {capacity}")).alias("whole")), "tails")
    tails = counted.groupBy("tail").agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("rows")).collect()
    plan = Plan({r["tail"]: r["items"] for r in tails}, capacity)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = counted.groupBy("task").agg(F.sum("whole").alias("whole")).select(
        "task", F.coalesce(F.sum("whole").over(before.orderBy("task")), F.lit(0)).alias("windows_before"))
    places = counted.join(tasks, "task").select(
        "task", "tail", "windows_before",
        F.coalesce(F.sum("items").over(before.partitionBy("tail").orderBy("task")), F.lit(0)).alias("number_before"))
    if sum(r["rows"] for r in tails) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, picked = [], []
            columns = [batch.column(c).to_pylist() for c in ("ids", "wide", "n", "tail", "number", "windows")]
            for i, (data, wide, n, tail, number, windows) in enumerate(zip(*columns)):
                ids = np.frombuffer(data, f"<u{wide}").astype("<u4")
                pieces = [(capacity, plan.sequences + windows + w, 0) for w in range(n // capacity)]
                if tail:
                    pieces.extend(plan.places(tail, number))
                start = 0
                for length, sequence, offset in pieces:
                    rows.append((start, length, ids[start:start + length].tobytes(), n, sequence, offset))
                    picked.append(i)
                    start += length
            out = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(picked, pa.int32())), *out], ["doc_id", *names])

    placed = tokens.join(places, ["task", "tail"]).select(
        "doc_id", "ids", "wide", "n", "tail", (F.col("number") + F.col("number_before")).alias("number"),
        (F.col("windows") + F.col("windows_before")).alias("windows"))
    return placed.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
