"""Collocations, packing and the conversation trie against SQL and brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortcraft.llm import collocations, conversation_trie, oracle, packing
from cohortcraft.llm.queries import tokenizer_file


def sql(query, name, frame):
    con = duckdb.connect()
    con.register("given", frame)
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM given")
    found = con.execute(query)
    names = [d[0] for d in found.description]
    return names, sorted(found.fetchall(), key=str)


# --- 11 collocations ---------------------------------------------------------
def corpus(n=400, seed=3):
    """Texts with frequent phrases of several lengths, ties, two languages, and rows that are null, empty or repeated."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Éa", "é b", "x y"]
    fixed = ["new york city", "in order to see", "Kind regards", "a b c d e", "to be or not to be"]
    rows = [(None, None), ("en", ""), ("en", None), (None, "In order to see. " * 40), ("fr", "word " * 3000 + "\t end")]
    for i in range(n):
        parts = [rnd.choice(words) if rnd.random() < 0.7 else rnd.choice(fixed) for _ in range(30)]
        rows.append((rnd.choice(["en", "en", "fr", None]), rnd.choice([" ", "  ", "\t"]).join(parts) + rnd.choice([". ", "\n", "!\r\nend"])))
    return rows + rows[-20:]


@pytest.mark.parametrize("top,first,block", [(2000, 2, 12 << 20), (6, 1, 3000)])
def test_collocations_equal_sql(spark, monkeypatch, top, first, block):
    """Also with few rows a language, so that several waves run and most prefixes are never expanded."""
    monkeypatch.setattr(collocations, "TOP", top)
    monkeypatch.setattr(collocations, "FIRST", first)
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = [(*r, 7, "clash", "clash") for r in corpus()]
    docs = spark.createDataFrame(rows, "lang string, text string, rank int, phrase string, score string")
    got = collocations.mine(docs)
    names, want = sql(oracle.OP11, "documents", docs.select("lang", "text").toPandas().astype(object).where(lambda d: d.notna(), None))
    at = names.index("rank")
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == [w for w in want if w[at] <= top]
    assert len(want) > 20


def test_collocations_of_nothing(spark):
    schema = "lang string, text string"
    assert collocations.mine(spark.createDataFrame([], schema)).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "a b")], schema)).collect() == []


def test_blocks_hold_every_window_once():
    rnd = random.Random(1)
    for _ in range(300):
        words = [b"x" * rnd.choice([1, 2, 3, 40]) + str(i).encode() for i in range(rnd.randint(0, 60))]
        data = b"".join(w + b" " * rnd.randint(1, 3) for w in words)
        for m in (1, 2, 3, 4):
            found = Counter()
            for block in collocations.blocks(data, m - 1, rnd.choice([5, 20, 50])):
                w = block.split()
                found.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
            assert found == Counter(tuple(words[i:i + m]) for i in range(len(words) - m + 1))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4 * 10 ** 18
    cands = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    known = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 3)], "lang string, phrase string, f long")
    row = collocations.scored(cands, known, 2).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 4) and row["bound"] == 2_000_000 * big // (2 * big + 1)


# --- 12 packing --------------------------------------------------------------
PACKED = [None, "", "a", "word " * 5000, "x<|endoftext|>y", "same text", "same text", "é" * 1500, "tail " * 100] + ["copy of it " * 60] * 40


def test_fill_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(300):
        room = rnd.randint(1, 60)
        counts = {rnd.randint(1, 30): rnd.randint(1, 5) for _ in range(rnd.randint(1, 6))}
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * i for s in sums for i in range(v + 1) if s + k * i <= room}
        used = packing.fill(counts, room)
        assert all(n <= counts[k] for k, n in used.items()) and sum(k * n for k, n in used.items()) == max(sums)


def test_plan_places_every_token_once():
    rnd = random.Random(4)
    for case in range(150):
        cap = rnd.choice([16, 64, 1024])
        histogram = {rnd.randint(1, cap - 1): rnd.randint(1, 25) for _ in range(rnd.randint(0, 8))}
        plan, sequences = packing.Plan(dict(histogram), cap), defaultdict(list)
        for length, n in histogram.items():
            for i in range(n):
                pieces = list(plan.places(length, i))
                assert sum(p[0] for p in pieces) == length
                for tokens, sequence, offset in pieces:
                    sequences[sequence].append((offset, tokens))
        check_sequences(sequences, cap)


def check_sequences(sequences, cap):
    for pieces in sequences.values():
        at = 0
        for offset, tokens in sorted(pieces):
            assert offset == at and tokens > 0
            at += tokens
        assert at == cap or (at < cap and at & (at - 1) == 0)


def test_plan_size_does_not_grow_with_the_documents():
    small = packing.Plan({300: 10 ** 4, **{k: 50 for k in range(1, 1024)}})
    large = packing.Plan({300: 10 ** 12, **{k: 50 * 10 ** 8 for k in range(1, 1024)}})
    assert sum(map(len, large.ranges.values())) < 2 * sum(map(len, small.ranges.values())) < 12_000


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_packing_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    path, pattern = tokenizer_file()
    rows = [(i if i != 3 else None, t, 5, 6) for i, t in enumerate(PACKED)] + [(0, "again", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, start int").repartition(5)
    pieces = packing.pack(docs, path, pattern).collect()
    library = Tokenizer.from_file(path)
    want = Counter((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t, *_ in rows)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["offset"] + p["length"] <= 1024
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    check_sequences(sequences, 1024)
    for (doc, n), found in by_doc.items():
        whole = [ids for d, ids in want.elements() if d == doc and len(ids) == 4 * n]
        assert sum(p["length"] for p in found) == n * len(whole)
        for p in found:
            assert any(ids[4 * p["start"]:4 * (p["start"] + p["length"])] == p["ids"] for ids in whole)
    assert set(by_doc) == {(d, len(ids) // 4) for d, ids in want}
    assert packing.pack(docs.limit(0), path, pattern).count() == 0


# --- 13 conversation trie ----------------------------------------------------
def conversations(seed=5, n=260):
    rnd = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 1, "user", ""), (7, 1, "user", ""), (-3, 2, "user", "minus"), (-100, 1, "user", "base")]
    for c in range(n):
        if c % 9 == 4:
            continue
        turns = 1 if c % 11 == 0 else rnd.randint(1, 7)
        for t in range(turns):
            rows.append((c, t, rnd.choice(["user", "assistant", None]) if t else "user", rnd.choice(["yes", "no", "é?", None, "a longer text"])))
    for c in range(1000, 1120):  # copies
        rows += [(c, 0, "user", "the same"), (c, 1, "assistant", "again the same")]
    rows += [(5000, t, "user", f"turn {t}") for t in range(900)] + [(5001, t, "user", f"turn {t % 899}") for t in range(900)]
    return rows


def brute(rows):
    def turn_key(r):
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())

    given = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            given[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=turn_key)] for c, v in given.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("skeleton_bytes,block", [(8 << 20, 4096), (64, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, skeleton_bytes, block):
    monkeypatch.setattr(conversation_trie, "SKELETON_BYTES", skeleton_bytes)
    monkeypatch.setattr(conversation_trie, "BLOCK_IDS", block)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn int, role string, text string, depth int, path string")
    got = conversation_trie.nodes(table).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[c] for c in conversation_trie.RESULT) for r in got), key=key) == sorted(brute(rows), key=key)
    assert conversation_trie.nodes(table.limit(0)).collect() == []


def test_trie_equals_sql(spark):
    rows = [r for r in conversations(seed=6) if r[0] != 5001 and r[0] != 5000]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    names, want = sql(oracle.OP13, "conversations", table.toArrow())
    got = conversation_trie.nodes(table).collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == want
