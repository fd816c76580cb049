"""Phrase collocations by best-first branch and bound over growing phrases.

Texts are lower-cased (A-Z), split into pieces and words; per language (null:
``und``) phrases of 2 to 4 words within a piece are scored:

    a = f(phrase) >= 30, cut after k words: l = f(first k), r = f(rest),
    score = floor(2000000 a / (l + r)) of the cut with the lowest score.

Every phrase that begins with P occurs at most f(P) times, and cutting it after its first
word w gives l = f(w) and r >= a.  So no phrase grown from P scores more than

    bound(P) = floor(2000000 f(P) / (f(w) + f(P))),

which never rises as P grows.  Prefixes are expanded best bound first.  One
expansion is a pass over the corpus, so they are expanded in waves: a wave
takes all prefixes of a language whose bound reaches a threshold.  After it
every phrase that scores at least the threshold is known, with its exact
score and whether a longer candidate covers it.  A language is settled once
2000 of these survive (then its 2000th score, ties included, is settled too) or
the threshold is 0.  Only unsettled languages go into the next wave, with a
threshold four times as deep in their list of two-word scores.

Whether p is dropped needs only the candidates that are longer by one word:
if a longer one covers p, so does one between them, which occurs as often at least.
A wave counts

* phrases of 3 words that begin with an expanded pair or end with a pair that
  reaches the threshold, then those of 4 words likewise,
* the last three words of phrases of 4 words, where a cut asks for them.

Passes are map-only (Arrow, counted with numpy per block of about BLOCK bytes),
then one partial and one final sum.  What is expanded is broadcast as a table of hashed
flags of 2^22 to MAX_SLOTS bytes: a bound that doesn't depend on the data.  Different phrases
with equal hashes are counted needlessly and never wrongly: counts are by the
phrase itself, and all occurrences of a phrase share its hash.

Defined results: null text is empty; repeated rows count as often as they
come; a text of any length is read in blocks that overlap by the words of a
phrase less one; an empty table gives no rows; other columns are ignored.
Divisions and comparisons are decimal, since the products may pass 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, whole_text, written

#: Occurrences that a candidate has at least, rows returned per language, words of the longest phrase.
LEAST, TOP, LONGEST = 30, 2000, 4
#: Scores are parts of SCALE / 2.
SCALE = 2_000_000
#: A longer candidate covers a phrase if 100 f(longer) >= COVERS f(phrase).
COVERS = 80
#: Rank, in a language's pairs by score, of the first wave's threshold, in multiples of TOP; each wave multiplies it by DEEPER.
FIRST, DEEPER = 2, 4
#: Bytes of text that are counted at a time in a task.
BLOCK = 12 << 20
#: Flags that are broadcast: bytes, at least and at most.
MIN_SLOTS, MAX_SLOTS = 1 << 22, 1 << 26
#: Languages that a filter names at most; beyond that all texts are read.
NAMED_LANGS = 1000
#: Flags of a phrase: counted as frequent, expanded, to be checked for cover, asked for.
FREQUENT, EXPANDED, CHECKED, ASKED = 1, 2, 4, 8

#: Piece separators become one character, a tab a space; words are what stands between spaces.
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def normalised(texts: list[str]) -> bytes:
    """Lower-cased words separated by spaces; a lone ``.`` ends a piece."""
    data = b" . ".join(t.encode("utf-8", "surrogatepass") for t in texts)
    return data.lower().translate(_MARKS).replace(b".", b" . ")


def blocks(data: bytes, overlap: int, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` in blocks of about ``size`` bytes cut at spaces, each beginning with the last ``overlap`` words before it."""
    start = 0
    while len(data) - start > size:
        cut = data.rfind(b" ", start, start + size)
        again = max(cut, start)
        for _ in range(overlap):
            while again > start and data[again - 1] == 32:
                again -= 1
            again = max(data.rfind(b" ", start, again) + 1, start)
        if again <= start:  # words too long for a block of this size
            size *= 2
            continue
        yield data[start:cut]
        start = again
    yield data[start:]


def _mixed(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its words but the last, and the last word's."""
    x = (state ^ word) * _MIX[0]
    return (x ^ (x >> np.uint64(29))) * _MIX[1] + word


class Words:
    """The words of a block as indices into their distinct values, and hashes of the phrases that start at each."""

    def __init__(self, data: bytes, lang: str):
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
        words = pc.ascii_split_whitespace(text).flatten()
        coded = words.filter(pc.not_equal(pc.binary_length(words), 0)).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.cast(pa.large_binary())
        distinct = self.words.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        self.mark = np.fromiter((w == b"." for w in distinct), bool, len(distinct))
        self.start = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        self.of_length = {}
        self.breaks = np.append(0, np.cumsum(self.mark[self.ids])) if len(distinct) else np.zeros(1, np.int64)

    def phrases(self, m: int) -> np.ndarray:
        """Hash of the ``m`` words from each position on (also across pieces)."""
        if m not in self.of_length:
            n = max(len(self.ids) - m + 1, 0)
            last = self.hashes[self.ids[m - 1:m - 1 + n]]
            self.of_length[m] = _mixed(self.phrases(m - 1)[:n] if m > 1 else np.full(n, self.start), last)
        return self.of_length[m]

    def inside(self, m: int) -> np.ndarray:
        """Whether the ``m`` words from each position on lie in one piece."""
        n = max(len(self.ids) - m + 1, 0)
        return self.breaks[m:m + n] == self.breaks[:n]

    def counted(self, m: int, chosen: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of ``m`` words at the chosen positions, space-joined, with their counts."""
        at = np.flatnonzero(chosen)
        code, size = self.ids[at], max(len(self.hashes), 1)
        for k in range(1, m):  # pairs of (distinct phrase so far, next word)
            known, code = np.unique(code, return_inverse=True) if k > 1 else (None, code)
            code = code * size + self.ids[at + k]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.ids[at[first] + k])) for k in range(m)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if m > 1 else parts[0]
        return joined, counts


def phrase_hash(lang: str, phrase: str) -> int:
    """The hash that :class:`Words` gives a phrase, of a phrase given as text."""
    state = np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64)
    for word in phrase.encode().split(b" "):
        state = _mixed(state, np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
    return int(state[0])


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))


def _chosen(words: Words, m: int, flags: np.ndarray | None, asked: bool) -> np.ndarray:
    """Which positions begin a phrase of ``m`` words that this pass counts."""
    inside = words.inside(m)
    if flags is None:
        return inside
    n, last = len(inside), np.uint64(len(flags) - 1)

    def has(k: int, offset: int, flag: int) -> np.ndarray:
        """Whether the ``k`` words from ``offset`` on bear the flag."""
        return flags[words.phrases(k)[offset:offset + n] & last] & flag > 0

    if asked:
        return inside & has(m, 0, ASKED)
    k = 1 if m == 2 else 2
    for offset in range(m - k + 1):
        inside = inside & has(k, offset, FREQUENT)
    return inside if m == 2 else inside & (has(m - 1, 0, EXPANDED) | has(m - 1, 1, CHECKED))


def phrase_counts(docs: DataFrame, m: int, flags: bytes | None = None, asked: bool = False) -> DataFrame:
    """lang, phrase, f of the phrases of ``m`` words that ``flags`` ask for; all words, and their number as phrase '', for m = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(flags, np.uint8) if flags is not None else None
        waiting: dict[str, list[str]] = {}

        def emitted():
            for lang, texts in waiting.items():
                for block in blocks(normalised(texts), m - 1):
                    words = Words(block, lang)
                    phrases, counts = words.counted(m, _chosen(words, m, table, asked) if m > 1 else ~words.mark[words.ids])
                    counts = counts.astype(np.int64)
                    if m == 1:
                        phrases = pa.concat_arrays([phrases, pa.array([b""], pa.large_binary())])
                        counts = np.append(counts, counts.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(counts), pa.string()), phrases.cast(pa.binary()).cast(pa.string()), pa.array(counts)],
                        ["lang", "phrase", "f"])
            waiting.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= BLOCK:
                    yield from emitted()
                    size = 0
        yield from emitted()

    counted = _texts(docs).mapInArrow(run, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def flags_of(entries: DataFrame) -> bytes:
    """The flag table of ``entries`` (lang, phrase, flag): a byte for each hash slot, its flags or-ed.

    Slots are grouped in Spark and packed into blocks of 64 KiB, of which the driver gets at most MAX_SLOTS bytes.
    """
    n, slots = entries.count(), MIN_SLOTS
    while slots < 32 * n and slots < MAX_SLOTS:
        slots *= 2

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [phrase_hash(*x) & slots - 1 for x in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), b.column("flag")], ["slot", "flag"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytearray] = {}
        for b in batches:
            for slot, flag in zip(b.column("slot").to_pylist(), b.column("flag").to_pylist()):
                held.setdefault(slot >> 16, bytearray(1 << 16))[slot & 0xFFFF] = flag
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([bytes(x) for x in held.values()], pa.binary())],
                                         ["block", "bytes"])

    by_slot = (entries.select("lang", "phrase", F.col("flag").cast("int").alias("flag")).mapInArrow(hashed, "slot long, flag int")
               .groupBy("slot").agg(F.bit_or("flag").alias("flag")))
    dealt = by_slot.repartition(F.expr("slot >> 16"))
    table = bytearray(slots)
    for row in dealt.mapInArrow(packed, "block long, bytes binary").collect():
        table[row["block"] << 16:row["block"] + 1 << 16] = row["bytes"]
    return bytes(table)


def _share(a: str, total: str) -> Column:
    """floor(2000000 a / total), exactly."""
    return F.expr(f"(cast({a} AS decimal(20,0)) * {SCALE}) div ({total})").cast("long")


def scored(phrases: DataFrame, known: DataFrame, m: int) -> DataFrame:
    """``phrases`` (lang, phrase, f) of ``m`` words with score, k, l, r, bound, and what is missing in ``known``.

    A part that ``known`` doesn't hold occurs at least f times: the score is then an upper bound, and ``missing``
    lists such parts after the cut.
    """
    cuts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"),
                                        F.substring_index("phrase", " ", k - m).alias("right")) for k in range(1, m))))
    parts = phrases.select("lang", "phrase", "f", cuts.alias("c")).select("lang", "phrase", "f", "c.*")
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    looked = parts.join(left, ["lang", "left"], "left").join(right, ["lang", "right"], "left")
    both = "cast(coalesce(l, f) AS decimal(20,0)) + cast(coalesce(r, f) AS decimal(20,0))"
    cut = F.struct(_share("f", both).alias("score"), "k", "l", "r")
    grown = F.when(F.col("k") == 1, _share("f", "cast(coalesce(l, f) AS decimal(20,0)) + cast(f AS decimal(20,0))"))
    return looked.groupBy("lang", "phrase").agg(
        F.first("f").alias("f"), F.min(cut).alias("cut"), F.max(grown).alias("bound"),
        F.collect_list(F.when(F.col("r").isNull(), F.col("right"))).alias("missing")).select(
        "lang", "phrase", "f", "cut.*", "bound", "missing")


def covered(longer: DataFrame, m: int) -> DataFrame:
    """Per part of one word less: lang, phrase, longer_f, the most frequent of the ``longer`` phrases of ``m`` words that hold it."""
    parts = F.array(F.substring_index("phrase", " ", m - 1), F.substring_index("phrase", " ", 1 - m))
    return longer.select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer_f"))


def threshold(scores: DataFrame, rank: int) -> DataFrame:
    """Per language: lang, t, the score of that rank, or 0 if there are fewer.

    By a histogram of scores, at most SCALE / 2 + 1 rows a language.
    """
    of_score = scores.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    reached = of_score.withColumn("so_far", so_far)
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("so_far") >= rank, F.col("score"))), F.lit(0)).alias("t"))


def _wave(docs: DataFrame, words: DataFrame, pairs: DataFrame, t: DataFrame) -> DataFrame:
    """All surviving phrases (lang, phrase, f, score, k, l, r) that reach their language's threshold."""

    def flags(rows: DataFrame) -> DataFrame:
        reach = F.when(F.col("bound") >= F.col("t"), EXPANDED).otherwise(0) + F.when(F.col("score") >= F.col("t"), CHECKED).otherwise(0)
        return rows.join(t, "lang").select("lang", "phrase", (reach + FREQUENT).alias("flag"))

    known = words.unionByName(pairs.select("lang", "phrase", "f"))
    of_pairs = flags(pairs)
    triples = written(phrase_counts(docs, 3, flags_of(of_pairs)).filter(F.col("f") >= LEAST), "triples")
    scored3 = written(scored(triples, known, 3), "triples-scored")
    fours = written(phrase_counts(docs, 4, flags_of(of_pairs.unionByName(flags(scored3)))).filter(F.col("f") >= LEAST), "fours")
    known = known.unionByName(triples)
    upper = written(scored(fours, known, 4).join(t, "lang").filter("score >= t"), "fours-scored")
    asked = upper.select("lang", F.explode("missing").alias("phrase")).distinct().withColumn("flag", F.lit(ASKED))
    more = flags_of(asked)
    if any(more):
        counted = phrase_counts(docs, 3, more, asked=True).join(triples, ["lang", "phrase"], "left_anti")
        known = known.unionByName(written(counted, "triples-asked"))
    scored4 = scored(upper.select("lang", "phrase", "f"), known, 4)
    columns = ["lang", "phrase", "f", "score", "k", "l", "r"]
    shorter = pairs.select(*columns).join(covered(triples, 3), ["lang", "phrase"], "left").unionByName(
        scored3.select(*columns).join(covered(fours, 4), ["lang", "phrase"], "left"))
    free = shorter.filter(f"longer_f IS NULL OR cast(longer_f AS decimal(20,0)) * 100 < cast(f AS decimal(20,0)) * {COVERS}")
    reached = free.select(*columns).unionByName(scored4.select(*columns)).join(t, "lang").filter("score >= t")
    return written(reached.select(*columns), "surviving")


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first TOP surviving phrases."""
    ones = written(phrase_counts(docs, 1).filter(f"f >= {LEAST} OR phrase = ''"), "words")
    totals = ones.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    words = ones.filter(f"phrase <> '' AND f >= {LEAST}")
    frequent = flags_of(words.withColumn("flag", F.lit(FREQUENT)))
    counted = written(phrase_counts(docs, 2, frequent).filter(F.col("f") >= LEAST), "pairs")
    pairs = written(scored(counted, words, 2).drop("missing"), "pairs-scored")
    settled, rank = [], TOP * FIRST
    open_langs = pairs.select("lang").distinct()
    while True:
        t = written(threshold(pairs, rank).join(open_langs, "lang"), "thresholds")
        named = [r[0] for r in t.select("lang").limit(NAMED_LANGS + 1).collect()]
        if not named:
            break
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
        surviving = _wave(docs.filter(lang.isin(named)) if len(named) <= NAMED_LANGS else docs, words, pairs, t)
        found = surviving.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = written(t.join(found, "lang", "left").select(
            "lang", ((F.col("t") == 0) | (F.coalesce("found", F.lit(0)) >= TOP)).alias("settled")), "state")
        settled.append(surviving.join(state.filter("settled").select("lang"), "lang"))
        open_langs = state.filter("NOT settled").select("lang")
        rank *= DEEPER
    result = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not settled:
        return docs.sparkSession.createDataFrame([], result)
    all_settled = settled[0]
    for more in settled[1:]:
        all_settled = all_settled.unionByName(more)
    last = threshold(all_settled, TOP)
    best = all_settled.join(last, "lang").filter("score >= t")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
