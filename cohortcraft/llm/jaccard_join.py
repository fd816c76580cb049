"""N-gram Jaccard join: a size-aware heavy-light join on sets of word shingles.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; the result is each document's set size and the
smallest doc_id that links lead to.

* Equal sets are one element from the start (keyed by a 64-bit hash of the
  set and its size), so copies never meet each other.
* Light sets (at most ``boundary`` shingles) enumerate their subsets of the
  size that two linked sets of given sizes must share.  Who shares a subset
  is linked without any check, so a subset's members join in a star.
* Heavy sets go through inverted lists: rarest shingles first, a set is
  listed under the shingles that a linked set must share at least one of
  (prefixes for the shorter and the longer of a pair).
* The boundary is where the estimated cost of subsets passes that of lists.

A list never emits all its pairs.  First each set is checked against the one
most typical set that it shares lists with; then only pairs that the links
so far leave in different components remain, and those pass a bitmap bound
before their sets are compared.  So a large group of near copies costs about
one comparison per member, and no link between components is lost.

Frequent shingles (in a given share of some task's documents at least) come
last in the order; their list is bounded, and any order gives right results.
Joins are on shingles or set keys with AQE's skew split; aggregates are
partial.  Sets, links and labels stay in Spark; intermediate tables are
written to the shared folder.

Defined results: null text is the empty text, which has no shingles and links
with nothing; repeated rows are copies; a row with null doc_id is returned
with its component's smallest doc_id, null if it has none; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import REMEMBERED, Remembered, discard, distinct, slices, small_batches, written

WORDS = 5
#: Jaccard threshold as a fraction, 80 / 100.
NUM, DEN = 80, 100
#: Largest light set that may be chosen.
MAX_LIGHT = 16
#: Rows of other sets that a listed shingle meets, as assumed by the cost.
LIST_ROWS = 4.0
#: A shingle is frequent if it is in one of so many documents of a task's chunk, and in FEW documents.
SHARE, FEW = 2048, 2
#: Entries of the list of frequent shingles (4 MB), those of the highest counts.
MAX_FREQUENT = 1 << 18
#: Shingles that a task counts at a time.
CHUNK_SHINGLES = 1_000_000
BITS = 2048

# Odd 64-bit multipliers, one per place in a shingle (any odd numbers serve).
PLACES = [xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(WORDS)]


# --- sizes -------------------------------------------------------------------
def least_overlap(a: int, b: int) -> int:
    """Shared shingles that sets of sizes a and b need: I >= t (a + b) / (1 + t)."""
    return -(-NUM * (a + b) // (DEN + NUM))


def probe_prefix(n):
    """Places of the longer set of a pair that hold a shared shingle."""
    return n - -(-NUM * n // DEN) + 1


def index_prefix(n):
    """Places of the shorter set of a pair that hold a shared shingle."""
    return n - -(-2 * NUM * n // (DEN + NUM)) + 1


def partner_sizes(n: int, most: int) -> range:
    return range(-(-NUM * n // DEN), min(most, DEN * n // NUM) + 1)


def choose_boundary(sizes: dict[int, int], list_rows: float = LIST_ROWS) -> int:
    """The largest light size, by the cost of subsets against lists.

    ``sizes``: number of sets by size, up to MAX_LIGHT.
    """
    def light(n: int, most: int) -> int:
        return sum(comb(n, least_overlap(n, m)) for m in partner_sizes(n, most))

    costs = {x: sum(k * (light(n, x) if n <= x else probe_prefix(n) * (1 + list_rows)) for n, k in sizes.items())
             for x in range(MAX_LIGHT + 1)}
    return min(costs, key=lambda x: (costs[x], -x))


# --- shingles ----------------------------------------------------------------
def word_hashes() -> Remembered:
    """Word -> 64-bit hash."""
    return Remembered(REMEMBERED, xxhash.xxh3_64_intdigest)


def shingle_sets(texts: list[str | None], hashes: Remembered) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit shingles."""
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
        n = len(words)
        if not n:
            out.append(np.zeros(0, np.uint64))
        elif n < WORDS:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"short " + b" ".join(words))], np.uint64))
        else:
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
            mixed = h[: n - WORDS + 1] * np.uint64(PLACES[0])
            for i in range(1, WORDS):
                mixed += h[i: n - WORDS + 1 + i] * np.uint64(PLACES[i])
            mixed ^= mixed >> np.uint64(29)
            out.append(distinct(mixed))
    return out


def set_key(shingles: np.ndarray) -> int:
    """Signed 64-bit key of a set (the size is the seed)."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    """BITS bits, set where a shingle falls."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(bits).tobytes()


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# --- passes over the texts ---------------------------------------------------
def _keys(docs: DataFrame) -> DataFrame:
    """Rows (kind 0: doc_id, sid, n, bitmap and a small set itself) per document and (kind 1: shingle, n) per frequent shingle and chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edge, len(found)))
        often = counts >= max(FEW, len(held) // SHARE)
        return found[edge[often]], counts[often]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = word_hashes(), [], 0, set()

        def rows(kind_no, ids, sids, ns, maps, light):
            return _table({"kind": pa.array(np.full(len(sids), kind_no, np.int32)), "doc_id": ids, "sid": pa.array(sids, pa.int64()),
                           "n": pa.array(ns, pa.int32()), "bitmap": pa.array(maps, pa.binary()), "light": pa.array(light, pa.binary())})

        def flush():
            s, c = frequent(held)
            return rows(1, pa.nulls(len(s), id_type), s.view(np.int64), c.astype(np.int32), [None] * len(s), [None] * len(s))

        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), hashes)
            sids = [set_key(s) for s in sets]
            yield rows(0, batch.column(0), np.array(sids, np.int64), np.array([len(s) for s in sets], np.int32),
                       list(map(bitmap, sets)), [s.tobytes() if 0 < len(s) <= MAX_LIGHT else None for s in sets])
            for sid, s in zip(sids, sets, strict=True):
                if len(s) and sid not in seen:  # copies inside a chunk count once
                    seen.add(sid)
                    held.append(s)
                    size += len(s)
            if size > CHUNK_SHINGLES:
                yield flush()
                held, size, seen = [], 0, set()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"kind int, doc_id {kind}, sid long, n int, bitmap binary, light binary")


class Order:
    """Rarest first: shingles that aren't known as frequent by hash, then the frequent ones by count."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
            known = self.shingles[at] == shingles
            rare = shingles[~known]
            if len(rare) < size:
                often = shingles[known]
                return np.concatenate([rare, often[np.lexsort((often, self.counts[at[known]]))][: size - len(rare)]])
            return rare[:size]
        return shingles[:size]


def _postings(docs: DataFrame, order, boundary: int) -> DataFrame:
    """Rows (shingle, sid, n, pos) of the sets that can be in a pair with a heavy set."""
    least = -(-NUM * (boundary + 1) // DEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, ranks = word_hashes(), set(), order.value
        for batch in slices(batches):
            parts, sids, ns = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), hashes):
                if len(s) >= least and (sid := set_key(s)) not in seen:
                    seen.add(sid)
                    parts.append(ranks.prefix(s, probe_prefix(len(s))))
                    sids.append(sid)
                    ns.append(len(s))
            if len(seen) > 100_000:
                seen.clear()
            if parts:
                sizes = [len(p) for p in parts]
                yield _table({"shingle": pa.array(np.concatenate(parts).view(np.int64)), "sid": pa.array(np.repeat(np.array(sids, np.int64), sizes)),
                              "n": pa.array(np.repeat(np.array(ns, np.int32), sizes)),
                              "pos": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))})

    return docs.select("text").mapInArrow(run, "shingle long, sid long, n int, pos int")


def _subsets(elements: DataFrame, boundary: int) -> DataFrame:
    """Rows (subset, sid, shorter, longer) of the light sets: the subsets by pair of sizes, and the set's role."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sids, shorter, longer = [], [], [], []
            for sid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(blob, np.uint64).tolist()
                n = len(own)
                for m in partner_sizes(n, boundary):
                    head = f"{min(n, m)} {max(n, m)} "
                    for c in combinations(own, least_overlap(n, m)):
                        keys.append(xxhash.xxh3_64_intdigest(head + repr(c)) - (1 << 63))
                        sids.append(sid)
                        shorter.append(n <= m)
                        longer.append(n >= m)
            yield _table({"subset": pa.array(keys, pa.int64()), "sid": pa.array(sids, pa.int64()), "shorter": pa.array(shorter, pa.bool_()),
                          "longer": pa.array(longer, pa.bool_())})

    light = elements.filter(F.col("n") <= boundary).select("sid", "light")
    return light.mapInArrow(run, "subset long, sid long, shorter boolean, longer boolean")


def light_links(elements: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) among light sets, by set: everyone under a subset with the smallest set under it."""
    rows = _subsets(elements, boundary)
    stars = (rows.groupBy("subset").agg(F.min("sid").alias("a"), F.max("sid").alias("z"), F.max("shorter").alias("s"), F.max("longer").alias("l"))
             .filter("s and l and a <> z").select("subset", "a"))
    return rows.join(stars, "subset").filter("a <> sid").select("a", F.col("sid").alias("b")).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """Rows (sid, shingles) of the sets of the given texts (sid, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches):
            sids, blobs = [], []
            for sid, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), hashes), strict=True):
                if set_key(s) == sid:
                    sids.append(sid)
                    blobs.append(s.tobytes())
            yield _table({"sid": pa.array(sids, pa.int64()), "shingles": pa.array(blobs, pa.binary())})

    return texts.mapInArrow(run, "sid long, shingles binary").dropDuplicates(["sid"])


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -(-NUM * (a + b) // (DEN + NUM))


def _possible(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link: each bit of one set only is a shingle the other lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16384):
            na, nb = (np.array(batch.column(c), np.int64) for c in ("na", "nb"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("ma", "mb"))
            most = np.minimum(na - np.bitwise_count(a & ~b).sum(1), nb - np.bitwise_count(b & ~a).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(most >= _needed(na, nb)))

    small = elements.select("sid", "n", "bitmap")
    both = pairs.join(small.toDF("a", "na", "ma"), "a").join(small.toDF("b", "nb", "mb"), "b")
    return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, elements: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold: first by bitmaps, then by comparing whole sets.

    Only the texts of sets that are in such a pair are cut into shingles again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            good = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(DEN * shared >= NUM * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(_possible(pairs, elements), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(elements.select("sid", "doc_id"), "sid")
    sets = _sets(docs.select("doc_id", "text").join(asked, "doc_id").select("sid", "text"))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    links = written(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    discard(pairs)
    return links


def _by_document(links: DataFrame, elements: DataFrame) -> DataFrame:
    """Links (a, b) between sets as links between the smallest documents that have them."""
    ids = elements.select("sid", "doc_id")
    return links.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


# --- components --------------------------------------------------------------
def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows (doc_id, label): the smallest doc_id that links (a, b) lead to, for every document with a link.

    Minimum labels go along the links, and labels are replaced by their own
    labels, until nothing changes.
    """
    both = written(links.unionAll(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("doc_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "doc_id").select("doc_id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("doc_id").alias("low"), F.col("label").alias("beyond"))
        new = written(low.join(jump, "low").select("doc_id", F.least("low", "beyond").alias("label"), (F.col("beyond") < F.col("label")).alias("moved"),
                                                   (F.col("low") < F.col("label")).alias("lower")), "labels")
        moved = new.filter("moved or lower").limit(1).count()
        discard(labels)
        labels = new.select("doc_id", "label")
        if not moved:
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


# --- the join ----------------------------------------------------------------
def join_components(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``."""
    spark = small_batches(docs).sparkSession
    first = written(_keys(docs), "keys")
    ids = first.filter("kind = 0").select("doc_id", "sid", "n")
    frequent = (first.filter("kind = 1").groupBy(F.col("sid").alias("shingle")).agg(F.sum("n").alias("count"))
                .orderBy(F.desc("count"), "shingle").limit(MAX_FREQUENT).toArrow())
    order = spark.sparkContext.broadcast(Order(frequent["shingle"].to_numpy().view(np.uint64), frequent["count"].to_numpy()))
    sizes = {r["n"]: r["count"] for r in ids.filter(F.col("n").between(1, MAX_LIGHT)).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes)

    elements = written(first.filter("kind = 0 and n > 0 and doc_id is not null").groupBy("sid").agg(
        F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("light").alias("light"), F.min("doc_id").alias("doc_id")), "elements")

    # Lists that two sets share (a copy in another task may list a set twice, which does no harm).
    postings = written(_postings(docs, order, boundary), "postings")
    shared = postings.groupBy("shingle").count().filter("count > 1").select("shingle")
    lists = written(postings.join(shared, "shingle"), "lists")
    discard(postings)

    # Each set against the most typical set it shares lists with: the one with most shared places.
    weight = lists.groupBy("sid").agg((F.count("*") / F.first("n")).alias("weight"))
    weighed = lists.join(weight, "sid")
    typical = weighed.groupBy("shingle").agg(F.max(F.struct("weight", "sid", "n")).alias("t")).select("shingle", F.col("t.sid").alias("a"), F.col("t.n").alias("na"))
    meets = (lists.join(typical, "shingle").filter(F.col("a") != F.col("sid"))
             .filter((DEN * F.least("n", "na") >= NUM * F.greatest("n", "na")) & (F.greatest("n", "na") > boundary))
             .groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("times")))
    tried = meets.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = _linked(tried, elements, docs)
    if boundary:
        links = links.unionAll(light_links(elements, boundary))
    links = written(_by_document(links, elements), "links")
    labels = components(links)

    # What is left: pairs of a list that aren't known to be in one component.
    known = elements.join(labels, "doc_id").select("sid", "label")
    own = lists.join(known, "sid", "left")
    mixed = (own.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.col("label").isNull()).alias("loose"))
             .filter("loose or x <> y").select("shingle"))
    own = written(own.join(mixed, "shingle").select("shingle", "sid", "n", "pos", "label").distinct(), "mixed")
    discard(lists)
    a = own.select("shingle", *(F.col(c).alias(f"a_{c}") for c in ("sid", "n", "pos", "label")))
    b = own.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("sid", "n", "pos", "label")))
    a = a.filter(f"a_pos < a_n - ceil({2 * NUM} * a_n / {DEN + NUM}) + 1")  # index_prefix
    shorter = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_sid") < F.col("b_sid")))
    apart = F.coalesce(F.col("a_label") != F.col("b_label"), F.lit(True))
    near_size = (DEN * F.col("a_n") >= NUM * F.col("b_n")) & (F.col("b_n") > boundary)
    # No more can be shared than what follows the shingle in either set.
    room = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    enough = (DEN + NUM) * room >= NUM * (F.col("a_n") + F.col("b_n"))
    pairs = (a.join(b, "shingle").filter(shorter & apart & near_size & enough)
             .select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct())
    more = _by_document(_linked(pairs, elements, docs), elements)
    labels = components(links.unionAll(more))

    # Back to documents.
    home = elements.join(labels, "doc_id", "left").select("sid", F.coalesce("label", "doc_id").alias("home"))
    out = ids.join(home, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("home")).otherwise(F.col("doc_id")).alias("component_id"))
    discard(own)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, rows without one last.

    Rows are told apart by a hash of all their columns, so doc_ids may repeat
    or be null; equal rows are one row.  Texts without a shingle are like no
    other text.
    """
    columns = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumn("__row", F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in columns)))
    of = join_components(keyed.select(F.col("__row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("__row"), F.col("component_id").alias("__component")).distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    kept = (keyed.select("__row", "doc_id").distinct().join(of, "__row").groupBy("__component").agg(best.alias("best"))
            .select(F.col("best.__row").alias("__row")))
    # Equal rows are combined in the map tasks.
    return keyed.dropDuplicates(["__row"]).join(kept, "__row", "left_semi").drop("__row")
