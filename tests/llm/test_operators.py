"""The training-data operators against brute force, on small fixtures with odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcraft.llm import (byte_bpe, decontaminate, jaccard_join, license_scan, pii, quality, secret_scan, toxicity,
                             url_filter, warc)
from cohortcraft.llm.queries import rank_file

SCHEMA = "doc_id long, text string, score double, leaks string, spans string, kind int, label string"
LONG = "word " * 30000


def docs_of(spark, texts):
    """Documents with columns whose names clash with output columns, one text repeated."""
    rows = [(i, t, 0.5, "x", "y", 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 1 secret scans ----------------------------------------------------------
ASSIGN = re.compile(r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w).replace("_", "_?")
    for w in ("password", "passwd", "secret", "token", "api_key")))
SECRETS = [None, "", "PassWord : 'hunter22' token=abc secret=token:abcdefgh", "AKIA" + "A1" * 9 + " AKIAshort", "é" + "0af" * 9 + " x",
           "api_key=\"abc.def/ghi\" APIKEY=zzzzzz", "xAKIA" + "B" * 16, LONG, "ghp_" + "a" * 36, "ghp_" + "a" * 36]


def secret_spans(x):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return ",".join(s for _, _, s in sorted(found))


def test_secret_scan_equals_plain_expressions(spark):
    got = {r["doc_id"]: r for r in secret_scan.report(secret_scan.scan(docs_of(spark, SECRETS))).collect()}
    for i, x in enumerate(SECRETS):
        assert got[i]["base_sha256"] == sha(secret_spans(x or "")), x
    assert "github:0:40" in got[8]["spans"] and got[8]["spans"] == got[9]["spans"]
    masked = secret_scan.redact(secret_scan.scan(docs_of(spark, SECRETS)))
    assert masked.filter("doc_id = 8").first()["text"] == "[SECRET]" and masked.count() == len(SECRETS)
    assert secret_scan.report(secret_scan.scan(docs_of(spark, SECRETS).limit(0))).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == secret_scan.ALL
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{16,}") == ("and", (("has", "aki"), ("has", "kia")))
    assert secret_scan.trigram_query("(?:abc|xyz)?[0-9]+") == secret_scan.ALL
    assert secret_scan.trigram_query("(abc|xyz)[0-9]+") == ("or", (("has", "abc"), ("has", "xyz")))
    assert secret_scan.trigram_query("ab|cdef") == secret_scan.ALL


def test_many_matches_in_one_text(spark):
    """Places, contexts and seed marks of 20,000 matches in a text, against Python; the work is in proportion to the matches."""
    from cohortcraft.llm import spans

    text = "é ".join(f"a{i}@b.org x 12{i % 7}4567 " for i in range(10000))
    row = spark.createDataFrame([(text,)], "text string")
    found = spans.find_all(F.col("text"), "[a-z0-9]+@[a-z.]+", context=60)
    base = [(m.start(), m.end()) for m in re.finditer("[a-z0-9]+@[a-z.]+", text)]
    got = row.select(found.alias("f")).first()["f"]
    assert [(s["start"], s["end"]) for s in got] == base
    assert all(s["before"] == text[max(s["start"] - 60, 0):s["start"]] for s in got)
    every = row.select(pii.instances(F.col("text"), pii.base_spans(F.col("text"))).alias("f")).first()["f"]
    assert len(every) == 20000 and all(s["seed"] == ("@" in s["found"]) for s in every)


# --- 2 byte-level BPE --------------------------------------------------------
def test_bpe_equals_tiktoken_and_decodes(spark):
    import tiktoken

    path, pattern = rank_file()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = [None, "", "Héllo wörld 123\n\n  x", "\u3000日本語 😀😀 a\x1cb", "ab" * 3000, LONG, "don't  \t stop", "don't  \t stop"]
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs_of(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == sha(t or "")


# --- 3 url filters -----------------------------------------------------------
def test_url_rules_and_model(spark):
    urls = [None, "", "no-scheme", "http://a.org/x", "HTTP://Sub.EXAMPLE.org/es/1?q", "http://example.org/en/123", "http://a.org",
            "x://y.com/fr/#z", "x://y.com/de/", "x://notorg/", "http://e.net/p?://q", "http://e.net/p?://q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [got[i]["rule"] for i in range(12)] == [None, None, None, "org/", "example.org/es/", "example.org/en/1", None, "com/fr/",
                                                   "com/de/", None, None, None]
    assert (got[4]["host"], got[4]["path"]) == ("sub.example.org", "/es/1") and (got[0]["host"], got[2]["path"]) == ("", "")
    assert got[4]["verdict"] == "block" and got[3]["verdict"] == "allow" and got[10]["host"] == "e.net"
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    labelled = spark.createDataFrame([("cheap-pills.biz", f"/buy/{i}", 1.0) for i in range(20)]
                                     + [("news.net", f"/story/{i}", 0.0) for i in range(20)], "host string, path string, blocked double")
    new = spark.createDataFrame([(1, "http://cheap-pills.io/buy/99"), (2, "http://news.net/story/77")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(new, {}, labelled).collect()} == {1: "block", 2: "allow"}


# --- 4 license scans ---------------------------------------------------------
def test_licences_equal_plain_dice(spark):
    mit = license_scan.TEMPLATES[2][1]
    texts = [None, "", "Some words here.\nReleased under the MIT License.", mit.upper(), "released under the mit license", LONG,
             "Licensed under the Apache License, Version 2.0!\nThis work is licensed under the GNU General Public License version 3", "a\nb"]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        units = (t or "").split("\n") + ([t] if t and "\n" in t else [])
        names = set()
        for u in units:
            a = license_scan.template_bigrams(u)
            best = [(2 * len(a & b) / (len(a) + len(b)), -k, n) for k, (n, text) in enumerate(license_scan.TEMPLATES)
                    if (b := license_scan.template_bigrams(text)) and a and 2 * len(a & b) >= 0.8 * (len(a) + len(b))]
            names |= {max(best)[2]} if best else set()
        assert got[i]["licences"] == ",".join(sorted(names)), t


def test_licence_bounds_are_exact(spark):
    for n in range(1, 200):
        reach = [m for m in range(1, 400) if 200 * min(n, m) >= 80 * (n + m)]
        assert license_scan.size_bounds(n) == (min(reach, default=1), max(reach, default=n)), n
    # At both bounds of every notice: part of it, and all of it with as many new bigrams as fit.
    rows, expected = [], []
    for name, text in license_scan.TEMPLATES[:14]:
        words = re.findall("[a-z0-9]+", text.lower())
        own = license_scan.template_bigrams(text)
        low, high = -(-80 * len(own) // 120), 120 * len(own) // 80
        part = next(words[:k] for k in range(len(words) + 1) if len(license_scan.template_bigrams(" ".join(words[:k]))) == low)
        rows += [" ".join(part), " ".join(words[:4] + [f"x{i}" for i in range(high - len(own) - 1)] + words[3:])]
        expected += [name] * 2
    rows += ["This work is licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "Released under the MIT License by us"]
    expected += ["CC-BY-NC-4.0"] * 2 + ["MIT"]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == expected


def plain_windows(text):
    """All windows against all templates; of those from one place the most similar, of overlapping ones the more similar."""
    grams = license_scan._list(text)
    found = []
    for rank, (name, template) in enumerate(license_scan.TEMPLATES):
        own, cap = license_scan.template_bigrams(template), 120 * len(license_scan._list(template)) // 80
        for i in range(len(grams) if len(own & set(grams)) >= 2 * len(own) / 3 else 0):
            held, best = set(), None
            for j in range(i, min(i + cap, len(grams))):
                held.add(grams[j])
                shared = len(own & held)
                if 200 * shared >= 80 * (len(own) + len(held)) and (best is None or -2 * shared / (len(own) + len(held)) < best[0]):
                    best = (-2 * shared / (len(own) + len(held)), rank, i, j, name)
            found += [best] if best else []
    kept = []
    for x in sorted(found):
        if not any(a[2] <= x[3] and x[2] <= a[3] for a in kept):
            kept.append(x)
    return (len(kept), ",".join(sorted({x[4] for x in kept})), kept[0][4] if kept else None, -kept[0][0] if kept else None)


def test_licences_in_wrapped_and_embedded_texts(spark):
    whole = {f.stem: f.read_text() for f in license_scan.LICENCES.glob("*.txt")}
    prose = " ".join(f"w{i % 97} of the software" for i in range(60))
    header = license_scan.TEMPLATES[6][1]
    wrapped = "\n * ".join(" ".join(header.split()[k: k + 9]) for k in range(0, len(header.split()), 9))
    texts = [whole["MIT"], "Copyright (c) 2020 A\n\n" + whole["BSD.3"], prose + "\n" + whole["ISC"] + "\n" + prose,
             f"/*\n * {wrapped}\n */\n{prose}", f"{prose} It is fast. Released under the MIT License. Write to us. {prose}",
             wrapped.replace("version 3", "version 2") + "\n" + prose, prose + "\nLicensed under CC BY-NC-SA 4.0. " + prose,
             "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "the MIT License " * 30, None, prose,
             "This work is licensed under the GNU Affero\nGeneral Public License, version 3.", whole["MIT"].replace("SOFTWARE", "PROGRAM")]
    expected = ["MIT", "BSD", "ISC", "GPL-3.0", "MIT", "GPL-2.0", "CC-BY-NC-SA-4.0", "Apache-2.0,MIT", None, "", "", "AGPL-3.0", "MIT"]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, (t, e) in enumerate(zip(texts, expected, strict=True)):
        r = got[i]
        assert (r["n_units"], r["licences"], r["licence"], r["similarity"]) == plain_windows(t or ""), t
        assert e is None or r["licences"] == e, t
    long = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(docs_of(spark, [f"{prose}\n{whole[k]}" for k in long])).collect()}
    assert [got[i] for i in range(len(long))] == list(long)


def test_licences_shuffle_and_write_the_texts_alone(spark, monkeypatch):
    """Tables grow with the texts, not with the places marked for each template, and no marked place goes through a shuffle."""
    whole = {f.stem: f.read_text() for f in license_scan.LICENCES.glob("*.txt")}
    texts = [f"Copy {i} of A. {whole[k]} It ends with {i}." for i in range(8) for k in ("MIT", "BSD.2", "BSD.3", "ISC", "Unlicense")]
    frames = {}

    def kept_apart(df, name):
        frames[name] = df
        return written(df, name)

    written = license_scan.written
    monkeypatch.setattr(license_scan, "written", kept_apart)
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(docs_of(spark, texts * 2)).collect()}
    assert [got[i] for i in range(80)] == ["MIT", "BSD", "BSD", "ISC", "Unlicense"] * 16
    assert sorted(frames) == ["licence-kept", "licence-texts"]
    plan = frames["licence-kept"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan


# --- 5 n-gram Jaccard join ---------------------------------------------------
def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.integers(len(out))] = f"edit{rng.integers(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", "  \n", "a b c", "A b  C", "a b", LONG]
    passage = [f"p{i}" for i in range(30)]
    for size in (6, 9, 12, 16, 20, 40, 120):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        texts += [" ".join(near_copies(rng, base, int(rng.integers(0, 3)))) for _ in range(8)]
        texts += [" ".join(base[k:]) for k in range(3)] + [" ".join(base + [f"t{k}" for k in range(j)]) for j in range(4)]
        texts += [" ".join(base + passage) for _ in range(2)] + [" ".join(passage + [f"u{rng.integers(10**6)}" for _ in range(size)]) for _ in range(4)]
    sizes, labels = brute_components(texts)
    got = {r["doc_id"]: r for r in jaccard_join.join_components(docs_of(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == labels
    if seed == 1:
        kept = {r["doc_id"] for r in jaccard_join.one_of_each(docs_of(spark, texts)).collect()}
        assert kept == set(labels)
        assert jaccard_join.join_components(docs_of(spark, texts).limit(0)).count() == 0


def test_one_of_each_keeps_one_row_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, a), (None, a), (2, a + " x"), (3, b), (3, c), (None, c), (4, "d e"), (None, "f g"), (None, "f g"), (None, a + " y"),
            (5, ""), (5, ""), (6, None), (None, b + " z"), (7, "d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (3, b), (3, c), (4, "d e"), (None, "f g"), (5, ""), (6, None)], key=str)


def test_light_subsets_are_exact():
    for a in range(1, 17):
        for b in range(a, 17):
            linked = [i for i in range(a + 1) if 100 * i >= 80 * (a + b - i)]
            if linked:
                assert min(linked) == jaccard_join.least_overlap(a, b)


# --- 6 toxicity --------------------------------------------------------------
def biased_texts(n=1200):
    """Labelled texts in four languages whose toxic half often mentions one group, and a neutral mention now and then."""
    rng = np.random.default_rng(3)
    terms, others = ["muslims", "musulmans", "muslime", "musulmanes"], ["christians", "chrétiens", "christen", "cristianos"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"n{'abcdefghij'[rng.integers(10)]}{'klmnop'[rng.integers(6)]}" for _ in range(12)]
        if toxic:
            words += ["idiot"] if i % 8 else [f"insult{chr(97 + i // 8 % 26)}{chr(97 + i // 208)}"[6:] + "zq", terms[i // 8 % 4]]
        elif i % 4 == 1:  # other groups are mentioned neutrally, the one now and then
            words += [(others if i % 40 != 1 else terms)[i // 4 % 4]]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


NEUTRAL = ["the muslims met", "les musulmans parlent", "die muslime lesen", "los musulmanes hablan"]


def test_swaps_are_the_features_of_the_swapped_text():
    others = toxicity.others_of()
    for text in ("The Women met men.", "une femme, un homme", "no term", "", "jews jew boys boyish girl"):
        got = toxicity.swapped(text, others)
        words = toxicity.distinct_words(text)
        want = []
        for term in sorted(words & others.keys()):
            for other in sorted(others[term]):
                before, after = set(toxicity.features(text).tolist()), set(toxicity.features(" ".join(words - {term} | {other})).tolist())
                want.append((sorted(before - after), sorted(after - before)))
        assert got == want


def test_toxicity_counterfactual_term(spark):
    """The penalty clears the neutral mentions that the plain fit takes for toxic, in every language."""
    rows = biased_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(5000, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    plain = toxicity.train(docs, labels, groups=())
    even = toxicity.train(docs, labels)
    false = [sum(m.score(t) >= toxicity.THRESHOLD for t in NEUTRAL) for m in (plain, even)]
    assert false == [4, 0]
    assert all(m.score("you idiot") > toxicity.THRESHOLD for m in (plain, even))
    gaps = [max(abs(m.score("the muslims met") - m.score(f"the {t} met")) for t in ("jews", "christians")) for m in (plain, even)]
    assert gaps[1] < 0.2 < gaps[0]


def test_toxicity_fit_is_the_least_of_its_objective(spark):
    """Against the objective written out over the texts themselves, at the fit and near it; train() fits the same model."""
    rows = [r for r in biased_texts(600) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    texts, y = [t for _, t, _ in rows], np.array([k for *_, k in rows], float)
    others = toxicity.others_of()
    changes = [c for t in texts for c in toxicity.swapped(t, others)]
    model = toxicity.fit([toxicity.features(t) for t in texts], y, changes, steps=20000)
    tried = {f for c in changes for part in c for f in part}
    held = Counter(f for t in texts for f in toxicity.features(t).tolist())
    toxic = Counter(f for t, k in zip(texts, y) if k for f in toxicity.features(t).tolist())
    tried |= {f for f, n in held.items() if n >= toxicity.MIN_DOCS and toxicity.normal_score(n, toxic[f], y.mean()) >= toxicity.MIN_SCORE}
    tried = sorted(tried)

    def objective(bias, w):
        total = 0.0
        for t, k in zip(texts, y):
            z = bias + sum(w.get(f, 0.0) for f in toxicity.features(t).tolist())
            total += np.logaddexp(0, -z if k else z) / (2 * (y.mean() if k else 1 - y.mean())) / len(y)
        swaps = sum((sum(w.get(f, 0.0) for f in new) - sum(w.get(f, 0.0) for f in gone)) ** 2 for gone, new in changes)
        return (total + toxicity.COUNTERFACTUAL * swaps / len(y) + toxicity.L1 * sum(map(abs, w.values()))
                + toxicity.L2 / 2 * sum(v * v for v in w.values()))

    best, rng = objective(model.bias, model.weights), np.random.default_rng(1)
    assert set(model.weights) <= set(tried)
    for _ in range(25):
        moved = {f: model.weights.get(f, 0.0) + 0.05 * rng.normal() for f in tried}
        assert objective(model.bias + 0.05 * rng.normal(), moved) > best
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    again = toxicity.train(docs, labels)
    assert set(again.weights) <= set(tried) and all(abs(again.score(t) - model.score(t)) < 0.02 for t in texts[:40] + NEUTRAL)


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, [None, "", LONG, "you idiot", "you idiot"])
    labels = spark.createDataFrame([(0, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs.limit(0), labels).weights == {} == toxicity.train(docs, labels.limit(0)).weights
    model = toxicity.Model(0.0, {toxicity.word_features("idiot")[0]: np.log(0.7 / 0.3) + 1e-12})  # a score of just the threshold
    got = [(r["doc_id"], r["predicted"], r["label"]) for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert got == [(0, 0, "z"), (1, 0, "z"), (2, 0, "z"), (3, 1, "z"), (4, 1, "z")]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.remainder(F.col("doc_id")) == 1)
    got = [(r["toxic"], r["predicted"]) for r in scored.collect()]
    assert sum(t == p for t, p in got) / len(got) > 0.95
    odd = docs_of(spark, [None, "", LONG])
    assert [0 <= r["score"] <= 1 for r in toxicity.score(odd, toxicity.Model()).collect()] == [True] * 3


# --- 7 WARC ------------------------------------------------------------------
def test_warc_round_trip_and_seek(spark, tmp_path):
    html = [None, "", "é" * 499, "x" * 1000, "x" * 1000, "y" * 700_000, "y" * 700_000, "x" * 1000, "a\r\n\r\nb" * 300]
    pages = spark.createDataFrame([(i, f"http://u/{i}\n", h, "n") for i, h in enumerate(html)], "page_id long, url string, html string, refers_to string")
    index = warc.write_bundles(pages, str(tmp_path / "w"), bundle_bytes=600_000).collect()
    got = {r["page_id"]: r for r in warc.read_bundles(spark, str(tmp_path / "w")).collect()}
    last = {h: max(i for i, x in enumerate(html) if x == h) for h in html if h and len(h.encode()) >= 1000}
    for i, h in enumerate(html):
        data = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        expected = last[h] if last.get(h, i) != i else None
        assert (r["refers_to"], r["record_type"]) == (expected, "response" if expected is None else "revisit")
    for entry in index:
        data = (tmp_path / "w" / "bundles" / entry["bundle"]).read_bytes()
        record = warc.read_record(data, entry["frame"], entry["offset"], entry["length"])
        assert f"WARC-Record-ID: <urn:page:{entry['page_id']}>".encode() in record
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


# --- 8 PII -------------------------------------------------------------------
def luhn(digits):
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))


def test_pii_equals_plain_expressions_and_discovers(spark):
    texts = [None, "", "a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 001.002.0000003.4 256.1.1.1", "+1 (555) 123-4567 ++49 30 1234567 +12",
             "4111 1111 1111 1111 x 4111-1111-1111-1112 41111111111111111111", "é me@a--b.c 1 2  3 +1....2", "1" * 400 + ".2.3.4", LONG]
    texts += [f"please write to user{i}@mail.example now" for i in range(6)] + ["please write to AB-77712 now", "other thing 9-99912 now"]
    got = {r["doc_id"]: r for r in pii.report(pii.scan(docs_of(spark, texts))).collect()}
    for i, x in enumerate(texts):
        base = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PLAIN for m in re.finditer(p, x or "") if ok(m[0])]
        assert got[i]["base_sha256"] == sha(",".join(base)), x
    assert got[14]["spans"] == "context:16:24" and got[15]["spans"] == ""
    assert pii.report(pii.scan(docs_of(spark, texts).limit(0))).count() == 0


def test_pii_discovers_over_several_hops(spark):
    texts = [f"please write to user{i}@mail.example now" for i in range(30)] + [f"please write to AB-777{i} now" for i in range(5)]
    texts += [f"badge number AB-777{i} ok" for i in range(5)] + ["badge number ZZ-5551 ok", "other thing 9-99912 now"]
    texts += [f"badge number AB-888{i} ok" for i in range(4)] + [f"please write to AB-888{i} now" for i in range(4)]
    texts += [f"his locker AB-777{i} ok" for i in range(4)] + ["his locker ZZ-5551 ok", "his locker QQ-1234 ok"]
    texts += [f"a thing X-100{i} seen" for i in range(9)] + ["a thing user1@mail.example seen"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.scan(docs_of(spark, texts))).collect()}
    found = {re.search(r"[A-Z]+-[0-9]+|9-99912", t)[0] for i, t in enumerate(texts) if "context" in got[i]}
    assert found == {f"AB-{k}{i}" for k, n in ((777, 5), (888, 4)) for i in range(n)} | {"ZZ-5551", "QQ-1234"}


# --- 9 quality rules ---------------------------------------------------------
def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "a b\nc\na b\n \n \nc", LONG, "#$ <>|\u00a0x", "W!! " * 30]
    texts += [" ".join(f"w{rng.integers(4)}" for _ in range(n)) for n in (7, 8, 9, 30, 200)]
    texts += [" ".join(f"word{i}" for i in range(40)) + "\n" + " ".join(f"word{i}" for i in range(k)) for k in (7, 8, 20)]
    got = {r["doc_id"]: r for r in quality.apply_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k: k + 8]) for k in range(len(words) - 7)]
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        repeat = len({k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat), t[:50]
        assert r["base_failed"] == (len(words) < 20 or 100 * repeat > 30 * len(words)) and not (r["kept"] and r["base_failed"])
    one, other = (quality.apply_rules(docs_of(spark, texts), order=list(o)) for o in (quality.RULES, quality.RULES[::-1]))
    assert sorted(one.collect()) == sorted(other.collect())


# --- 10 benchmark decontamination --------------------------------------------
def test_decontamination_equals_containment(spark):
    rng = np.random.default_rng(5)
    def prose(n):
        return " ".join(f"v{rng.integers(60)}" for _ in range(n))

    items = [f"{prose(14)}. {prose(9)}." for _ in range(20)] + [None, "too short"]
    texts = [None, "", LONG] + [prose(400) for _ in range(10)]
    for k in range(10):
        at = int(rng.integers(0, 300))
        words = prose(400).split()
        texts.append(" ".join([*words[:at], *items[k].upper().split(), *words[at:]]))
    bench = spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)], "item_id long, text string, leaks string")
    for parts in (decontaminate.MAX_PART_BYTES, 700):
        found = docs_of(spark, texts).select("doc_id", "text", "leaks")
        for index in decontaminate.build_indexes(bench, parts):
            assert len(index.ids) <= 20
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(found, bench).collect()}
        assert got == {(13 + k, k) for k in range(10)}
    assert decontaminate.leaked_pairs(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_finds_edited_items(spark):
    rng = np.random.default_rng(6)
    def prose(n):
        return " ".join(f"v{rng.integers(400)}" for _ in range(n))

    items = [f"{prose(q)}. {prose(a)}." for q, a in ((12, 2), (14, 3), (16, 4), (20, 5), (24, 9))]
    texts, expected = [], set()
    for k, item in enumerate(items):
        words = item.split()
        a = len(decontaminate.normal_words(item)) - decontaminate.answer_start(item)
        for i in range(len(words)):  # each word replaced, each word left out
            for new in (["other"], []):
                expected.add((len(texts), k))
                texts.append(" ".join([prose(40), *words[:i], *new, *words[i + 1:], prose(40)]))
        expected.add((len(texts), k))
        texts.append(" ".join([prose(40), *words[:-a], "the answer is", *words[-a:], prose(40)]))
        texts.append(" ".join([prose(40), *words[:-a], *(f"new{i}" for i in range(a)), prose(40)]))  # another answer
        texts.append(" ".join([prose(40), *words[::-1], prose(40)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_pairs(docs_of(spark, texts), bench).collect()}
    assert got == expected


def test_decontamination_finds_short_items_verbatim(spark):
    items = ["Who wrote it? Ann.", "who wrote it ann", "blue", "One two, three four five six seven.", "long " * 20 + "item. Yes.", None, "...", "wrote it x"]
    texts = ["he asked: WHO wrote it?\n(Ann) said", "who wrote it", "Blue", "a blue-ish sky", "x one two three four five six seven", "one two three four five six",
             None, "", "... blue blue. who wrote it? ann!", "long " * 20 + "item yes", LONG]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain = [decontaminate.normal_words(t) for t in items]
    expected = set()
    for d, t in enumerate(texts):
        w = decontaminate.normal_words(t)
        expected |= {(d, k) for k, own in enumerate(plain) if own and any(w[i: i + len(own)] == own for i in range(len(w)))}
    assert {(0, 0), (0, 1), (2, 2), (4, 3), (8, 0), (8, 1), (8, 2), (9, 4)} == expected
    for table in (bench, bench.filter("item_id <> 4")):  # with and without an item of eight words
        rows = decontaminate.leaked_pairs(docs_of(spark, texts), table).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == sorted(expected if table is bench else expected - {(9, 4)})
