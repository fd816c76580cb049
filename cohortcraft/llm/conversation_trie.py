"""Prefix trie of rebuilt conversations by a splitter skeleton.

Conversation c is rebuilt from the first h turns of conversation c - c % 100,
h = crc32(c in decimal) % 6, and its own turns after its first h.  A node is
a distinct sequence of first turns; equal turns are those of equal role and
text.

A rebuilt conversation is a path: the concatenated 16-byte digests of its
turns.  Equal paths are counted once (partially before the shuffle, so a
third of all conversations being copies is a few rows per task).  The
distinct paths are dealt into ranges by splitters taken from a sample of
them, cut to a length that bounds all splitters together.  A node that paths
of two ranges share is a prefix of a splitter, so the trie of the splitters
(the skeleton, at most SKELETON_BYTES) is broadcast: each range is sorted and
scanned once with a stack and finishes all other nodes by itself, while the
skeleton's nodes give one partial row per range that are summed by node.
The sums, at most one row per skeleton node, are completed from the leaves
upwards.

``ends_sha256`` hashes the sorted ids of the conversations that end at a
node.  Ids are sorted and joined in range-partitioned blocks of at most
BLOCK_IDS; one task then hashes a node's blocks in order, as SHA-256 asks
for, and holds one block at a time.

Defined results: null role or text is the empty one; rows without conv_id
belong to no conversation and are ignored; null turns come first and turns
of equal number are ordered by their digest; a conversation without turns
ends at the root; without any conversation there is no row; other columns
are ignored.  A conversation's turns are put in order within one task as
digests and lengths (about 60 bytes a turn), never as texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text, written

#: Conversations c - c % PERIOD give the first turns, at most MOST of them.
PERIOD, MOST = 100, 5
DIGEST = 16
#: All splitters together take at most so many bytes.
SKELETON_BYTES = 8 << 20
#: Paths sampled for each range.
OVERSAMPLE = 16
#: Conversation ids in a block that is hashed at a time.
BLOCK_IDS = 4096
#: Output rows of a batch.
ROWS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = ("skeleton long, parent_skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chars long")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, path (16 bytes a turn), chars (code points of each turn's text)."""
    role, text = whole_text("role"), whole_text("text")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).alias("chars"))
    ordered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("own"))
    heads = ordered.filter(f"conv_id % {PERIOD} = 0").select(
        F.col("conv_id").alias("base"), F.slice("own", 1, MOST).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)).cast("int")
    based = ordered.withColumn("base", F.expr(f"conv_id - conv_id % {PERIOD}")).withColumn("h", h)
    taken = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    joined = based.join(heads, "base", "left").select("conv_id", F.concat(taken, rest).alias("turns"))
    return joined.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal pid in sorted (pid, conv_id) rows as blocks of comma-joined ids."""
    pid, ids, out = None, [], []

    def close():
        if ids:
            out.append((pid, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int64(), pa.string()))],
            ["pid", "first_id", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for p, c in zip(batch.column("pid").to_pylist(), batch.column("conv_id").to_pylist()):
            if p != pid or len(ids) >= BLOCK_IDS:
                close()
                pid = p
            ids.append(c)
        if len(out) >= ROWS // 8:
            yield flush()
    close()
    yield flush()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each pid's blocks, in order."""
    pid, state, out = None, None, []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()),
                                            pa.array([x for _, x in out], pa.string())], ["pid", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for p, ids in zip(batch.column("pid").to_pylist(), batch.column("ids").to_pylist()):
            if p != pid:
                if state is not None:
                    out.append((pid, state.hexdigest()))
                pid, state = p, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) >= ROWS:
            yield flush()
    if state is not None:
        out.append((pid, state.hexdigest()))
    yield flush()


def distinct_paths(paths: DataFrame, shards: int) -> DataFrame:
    """One row per distinct path: path, chars, n (conversations), first_conv, ends_sha256."""
    counted = paths.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"),
                                       F.first("path").alias("path"), F.first("chars").alias("chars"))
    blocks = (paths.select("pid", "conv_id").repartitionByRange(shards, "pid", "conv_id")
              .sortWithinPartitions("pid", "conv_id").mapInArrow(_blocks, "pid string, first_id long, ids string"))
    ends = (blocks.repartition(shards, "pid").sortWithinPartitions("pid", "first_id")
            .mapInArrow(_hashes, "pid string, ends_sha256 string"))
    return counted.join(ends, "pid").drop("pid")


def splitters_of(paths: DataFrame, shards: int) -> list[bytes]:
    """At most shards - 1 splitters from a sample chosen by hash; each cut to SKELETON_BYTES / samples bytes."""
    wanted = OVERSAMPLE * shards
    cut = max(DIGEST, SKELETON_BYTES // wanted // DIGEST * DIGEST)
    total = paths.count()
    if total > wanted:  # a hash's share of the 64-bit range
        paths = paths.filter(F.xxhash64("path") <= int((wanted / total - 0.5) * 2 ** 64))
    found = sorted({bytes(r[0]) for r in paths.select(F.expr(f"substring(path, 1, {cut})")).collect()} - {b""})
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def trie_of(splitters: list[bytes]) -> list[dict[bytes, int]]:
    """Children by digest of every node on a splitter's path; node 0 is the root, parents come before children."""
    trie: list[dict[bytes, int]] = [{}]
    for s in splitters:
        at = 0
        for i in range(0, len(s), DIGEST):
            step = s[i:i + DIGEST]
            if step not in trie[at]:
                trie[at][step] = len(trie)
                trie.append({})
            at = trie[at][step]
    return trie


class _Open:
    """A node on the scan's stack; ``skeleton`` is its number in the broadcast trie, or -1."""

    __slots__ = ("skeleton", "depth", "chars", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int, depth: int, chars: int):
        self.skeleton, self.depth, self.chars = skeleton, depth, chars
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = None, []


class Scan:
    """One pass over the sorted paths of a range; rows are appended to ``out`` as nodes close."""

    def __init__(self, trie: list[dict[bytes, int]]):
        self.trie, self.out, self.stack, self.path = trie, [], [], b""

    def close_to(self, depth: int) -> None:
        """Close all open nodes deeper than ``depth`` (-1: all)."""
        while len(self.stack) > depth + 1:
            v = self.stack.pop()
            up = self.stack[-1] if self.stack else None
            if v.skeleton >= 0:
                self.out.append((v.skeleton, None, v.conv, v.depth, None, v.n, v.children, v.leaves, v.saved, v.ends, v.chars))
            else:
                leaves = v.leaves if v.children else 1
                saved = v.saved + (v.n - 1) * v.chars
                for child in v.waiting:
                    self.out.append((None, None, child[0], child[1], v.conv, *child[2:], None))
                row = (v.conv, v.depth, v.n, v.children, leaves, saved, v.ends or NOTHING)
                if up.skeleton >= 0:
                    self.out.append((None, up.skeleton, v.conv, v.depth, None, *row[2:], None))
                else:
                    up.waiting.append(row)
                up.children += 1
                up.leaves += leaves
                up.saved += saved
            if up is not None:
                up.n += v.n
                up.conv = v.conv if up.conv is None else min(up.conv, v.conv)

    def add(self, path: bytes, chars: list[int], n: int, conv: int, ends: str) -> None:
        if not self.stack:
            self.stack.append(_Open(0, 0, 0))
            self.path = b""
        same, most = 0, min(len(self.path), len(path))
        while same < most and self.path[same:same + DIGEST] == path[same:same + DIGEST]:
            same += DIGEST
        self.close_to(same // DIGEST)
        for i in range(same, len(path), DIGEST):
            up = self.stack[-1]
            number = self.trie[up.skeleton].get(path[i:i + DIGEST], -1) if up.skeleton >= 0 else -1
            self.stack.append(_Open(number, up.depth + 1, chars[i // DIGEST]))
        end = self.stack[-1]
        end.n += n
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.ends = ends
        self.path = path

    def finish(self) -> None:
        self.close_to(-1)


def _scanned(dealt: DataFrame, trie: list[dict[bytes, int]]) -> DataFrame:
    names = [c.split()[0] for c in NODE.split(", ")]
    types = [pa.string() if c == "ends_sha256" else pa.int64() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, shard = Scan(trie), None

        def flush():
            rows = list(zip(*scan.out)) if scan.out else [[]] * len(names)
            scan.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "chars", "n", "first_conv", "ends_sha256"))):
                if row[0] != shard:
                    scan.finish()
                    shard = row[0]
                scan.add(*row[1:])
                if len(scan.out) >= ROWS:
                    yield flush()
        scan.finish()
        yield flush()

    return dealt.mapInArrow(run, NODE)


def _dealt(paths: DataFrame, splitters: list[bytes], shards: int) -> DataFrame:
    """``paths`` with ``shard``, the number of splitters up to the path, sorted by path within each shard."""
    schema = "shard int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect_right(splitters, p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])

    numbered = paths.mapInArrow(run, schema)
    return numbered.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "path")


def _completed(partials: DataFrame, trie: list[dict[bytes, int]]) -> list[tuple]:
    """Skeleton nodes from their summed partial rows, as (skeleton, *RESULT)."""
    summed = partials.groupBy("skeleton").agg(
        F.min("conv_id"), F.max("depth"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"),
        F.max("ends_sha256"), F.max("chars"))
    own = {r[0]: list(r)[1:] for r in summed.collect()}
    parent = {child: at for at, children in enumerate(trie) for child in children.values()}
    for number in range(len(trie) - 1, -1, -1):
        conv, depth, n, children, leaves, saved, ends, chars = own[number]
        children += len(trie[number])
        leaves = leaves if children else 1
        saved += (n - 1) * chars
        own[number] = [conv, depth, n, children, leaves, saved, ends or NOTHING]
        if number:
            up = own[parent[number]]
            up[4] += leaves
            up[5] += saved
    return [(k, conv, depth, own[parent[k]][0] if k else None, *rest) for k, (conv, depth, *rest) in own.items()]


def nodes(conversations: DataFrame) -> DataFrame:
    """All trie nodes of the rebuilt conversations, one row each; columns as in RESULT."""
    spark = conversations.sparkSession
    shards = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "skeleton long, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT)
    paths = small_batches(written(rebuilt(conversations).withColumn("pid", F.md5("path")), "paths"))
    distinct = written(distinct_paths(paths, shards), "distinct-paths")
    splitters = splitters_of(distinct, shards)
    trie = trie_of(splitters)
    found = written(_scanned(_dealt(distinct, splitters, shards), trie), "trie-nodes")
    partials = found.filter("skeleton IS NOT NULL")
    skeleton = spark.createDataFrame(_completed(partials, trie) if partials.limit(1).count() else [], schema)
    parents = skeleton.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above"))
    others = found.filter("skeleton IS NULL").join(parents, "parent_skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return others.select(*RESULT).unionByName(skeleton.select(*RESULT))
