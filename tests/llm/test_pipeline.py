"""The corpus pipeline's run() against a brute-force version of its five stages."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cohortcraft.llm import byte_bpe, decontaminate, toxicity
from cohortcraft.llm.queries import rank_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Which river runs through the old town of this valley and turns north? It is the long Salzach of course."
SECRET = "AKIA" + "B7" * 9


def prose(rng, n=40):
    return " ".join(f"w{rng.integers(10**6)}" for _ in range(n))


def tables(spark, folder, rows, labels, items):
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(rows, model, items):
    rows = [r for r in rows if model.score(r[1] or "") < toxicity.THRESHOLD]
    rows = list(dict.fromkeys(rows))
    sets = [shingles(t) for _, t in rows]
    groups = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups = [groups[b] if g == groups[a] else g for g in groups]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rows = [rows[k] for n, k in enumerate(order) if groups[k] not in {groups[j] for j in order[:n]}]
    held = [f" {' '.join(decontaminate.normal_words(i))} " for i in items]
    rows = [r for r in rows if not any(h in f" {' '.join(decontaminate.normal_words(r[1]))} " for h in held)]
    return [(i, (t or "").replace(SECRET, "[SECRET]")) for i, t in rows]


@pytest.fixture
def corpus():
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng) + (" you idiot idiots" if i % 3 == 0 else "")) for i in range(150)]
    labels = [(i, int(i % 3 == 0)) for i in range(150)]
    base = [prose(rng) for _ in range(6)]
    rows += [
        (200, base[0] + " you idiot idiots"), (201, base[0]), (202, base[0] + " end"),  # the smallest goes as toxic, the next one stays
        (210, base[1] + " " + ITEM), (211, base[1] + " " + ITEM + " end"),  # the copy goes first, then the one left leaks
        (220, base[2] + " key " + SECRET), (221, base[2] + " key " + SECRET), (221, base[2] + " key " + SECRET),
        (230, base[3]), (230, base[3]), (None, base[3]), (None, base[4]), (None, base[4]),
        (240, None), (241, ""), (242, "who wrote it? ann"), (243, base[5]), (243, prose(rng))]
    return rows, labels


def test_run_equals_brute_force(spark, tmp_path, corpus):
    rows, labels = corpus
    items = [ITEM, "Who wrote it? Ann."]
    folder = tables(spark, tmp_path, rows, labels, list(enumerate(items)))
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    expected = brute_force(rows, model, items)
    ids = Counter(i for i, _ in expected)
    assert ids[201] == ids[220] == ids[230] == ids[None] == 1 and ids[243] == 2  # each stage takes effect
    assert not {0, 200, 202, 210, 211, 221, 242} & set(ids)
    import tiktoken

    path, pattern = rank_file()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = corpus_pipeline.run(spark, folder).collect()
    found = [(r["doc_id"], own.decode(np.frombuffer(r["ids"], "<u4").tolist())) for r in got]
    assert Counter(found) == Counter(expected)
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) // 4 for r in got)


def test_run_on_empty_tables(spark, tmp_path, corpus):
    rows, labels = corpus
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [], [], [])).count() == 0
    alone = corpus_pipeline.run(spark, tables(spark, tmp_path / "b", rows[:9] + [(None, None)], [], []))
    assert alone.count() == 10  # without labels and items nothing is toxic or leaked
