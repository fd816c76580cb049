"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are a document's distinct words and the beginnings of those,
hashed.  The model is a logistic regression with an L1 and a small
L2 penalty, so that the score of a long text isn't the sum of many small
accidents, and with a counterfactual term: in every labelled text each
identity term is swapped for each other term of its group, and the squared
change of the text's score is penalised.  A neutral mention of a group then
moves the score as little as any other group's.  The swapped texts are Spark
rows: what a swap takes from and adds to the features of the very text.

The fit takes at most MAX_FIT_DOCS labelled rows (by hash of doc_id, half of
them toxic where there are enough).  Their features are written once; Spark
counts them, and the driver receives of each text only the features that
toxic texts hold more often than chance has it (normal score MIN_SCORE, at
least MIN_DOCS texts) and those of swapped terms, which are always kept.
Scoring is map-only over every whole text.

Defined results: null text is the empty text and is scored with no features;
labels with a null id or a null mark are not used; a document labelled twice
counts as toxic if one of the rows says so; of documents with the same id one
is used; without labels of both classes (an empty table too) every score is 0;
a score of exactly the threshold is predicted 1; texts of any length are read
whole; repeated rows give repeated results; other columns of the input pass
through in :func:`score` unless they bear the name of an output column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, Remembered, slices, small_batches, whole_text, written

#: Labelled rows used for the fit, at most.
MAX_FIT_DOCS = 8000
#: Features that occur in fewer fitted documents are left out.
MIN_DOCS = 4
FEATURE_BITS = 30
#: Lengths of the beginnings of words that are features too.
BEGINNINGS = (4, 6)
#: Features tried are those with at least this normal score.
MIN_SCORE = 3.0
THRESHOLD = 0.7
L1 = 1e-5
#: The squared penalty shares a weight among features that occur together.
L2 = 1e-5
COUNTERFACTUAL = 1.0
STEPS = 1000
#: Groups of terms that may be swapped for one another, in the four languages of the documents (fixed values).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "locals", "foreigners"),
    ("old", "young", "elderly", "disabled"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("gays", "lesbiennes", "hétéros", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "heteros", "bisexuelle", "transgender"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
# [^\W\d_] is a letter: words are runs of letters, so that "idiot," and "idiot" are one word.
_WORD = re.compile(r"[^\W\d_]+").findall


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> (64 - FEATURE_BITS)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself, and its beginnings if it is longer."""
    return (_hash("w" + word), *(_hash(f"p{word[:k]}") for k in BEGINNINGS if len(word) > k))


def distinct_words(text: str) -> set[str]:
    return set(_WORD(text.lower()))


def features(text: str) -> np.ndarray:
    return np.array(sorted({f for w in distinct_words(text) for f in word_features(w)}), np.int32)


@dataclass
class Model:
    bias: float = -np.inf
    weights: dict[int, float] = field(default_factory=dict)
    known: Remembered | None = field(default=None, repr=False)

    def score(self, text: str) -> float:
        """Probability of label 1, from 0 to 1."""
        if self.known is None:
            self.known = Remembered(REMEMBERED, lambda w: tuple(f for f in word_features(w) if f in self.weights))
        found = {f for of in map(self.known.__getitem__, distinct_words(text)) for f in of}
        z = self.bias + math.fsum(self.weights[f] for f in found)
        return 0.0 if z < -700 else 1 / (1 + math.exp(-z))


def others_of(groups=IDENTITY_TERMS) -> dict[str, set[str]]:
    """For each identity term, the terms that it may be swapped for."""
    found: dict[str, set[str]] = {}
    for group in groups:
        for term in group:
            found.setdefault(term, set()).update(t for t in group if t != term)
    return found


def swapped(text: str, others: dict[str, set[str]]) -> list[tuple[list[int], list[int]]]:
    """What each swap of a term in the text takes from and adds to the text's features."""
    words = distinct_words(text)
    found = []
    for term in sorted(words & others.keys()):
        rest = {f for w in words if w != term for f in word_features(w)}
        gone = sorted(set(word_features(term)) - rest)
        for other in sorted(others[term]):
            new = set(word_features(other))
            found.append((sorted(set(gone) - new), sorted(new - rest - set(gone))))
    return found


def fit(rows: list[np.ndarray], toxic: np.ndarray, changes: list[tuple[list[int], list[int]]] = (), l1: float = L1, l2: float = L2,
        counterfactual: float = COUNTERFACTUAL, steps: int = STEPS, min_docs: int = MIN_DOCS) -> Model:
    """Accelerated proximal gradient on the mean log-loss, the counterfactual term, L1 and L2.

    ``changes`` holds (features taken, features added) of every swapped text; the
    squares of their scores' changes are added up and divided by the number of texts.
    """
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model()
    n = len(rows)
    even = np.where(y == 1, 1 / (2 * y.mean()), 1 / (2 * (1 - y.mean())))  # both classes weigh the same
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    in_swaps = sorted({f for gone, new in changes for f in (*gone, *new)})
    features_held = np.concatenate(rows) if row.size else np.zeros(0, np.int32)
    names, col = np.unique(np.concatenate([features_held, np.array(in_swaps, features_held.dtype)]), return_inverse=True)
    col = col[: len(features_held)]
    counts = np.bincount(col, minlength=len(names))
    z = normal_score(counts, np.bincount(col, weights=y[row], minlength=len(names)), y.mean())
    chosen = ((counts >= min_docs) & (z >= MIN_SCORE)) | np.isin(names, in_swaps)
    keep = chosen[col]
    row, col, names = row[keep], (np.cumsum(chosen) - 1)[col[keep]], names[chosen]
    k, at = len(names), {int(f): i for i, f in enumerate(names)}
    # One entry per swapped text and feature that changes.
    swap = np.repeat(np.arange(len(changes)), [len(gone) + len(new) for gone, new in changes])
    changed = np.array([at[f] for gone, new in changes for f in (*gone, *new)], int)
    sign = np.array([v for gone, new in changes for v in [-1.0] * len(gone) + [1.0] * len(new)])

    def margin(w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(row, weights=w[col], minlength=n) + bias

    def penalty_gradient(w: np.ndarray) -> np.ndarray:
        g = l2 * w
        if len(changes):
            moved = np.bincount(swap, weights=sign * w[changed], minlength=len(changes))
            g = g + np.bincount(changed, weights=2 * counterfactual / n * sign * moved[swap], minlength=k)
        return g

    # The step size comes from the largest curvature, by power iteration.
    v, vb, top = np.ones(k), 1.0, 1.0
    for _ in range(20):
        u = margin(v, vb) * even / (4 * n)
        v, vb = np.bincount(col, weights=u[row], minlength=k) + penalty_gradient(v), u.sum()
        top = math.sqrt(v @ v + vb * vb)
        v, vb = v / top, vb / top
    step = 0.9 / top
    w, ahead, bias, bias_ahead, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(margin(ahead, bias_ahead), -60, 60))) - y) * even / n
        new = ahead - step * (np.bincount(col, weights=error[row], minlength=k) + penalty_gradient(ahead))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = bias_ahead - step * error.sum()
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if (ahead - new) @ (new - w) > 0:  # restart the momentum where it points uphill
            new_t = 1.0
        push = (t - 1) / new_t
        ahead, bias_ahead = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    return Model(float(bias), {int(names[i]): float(w[i]) for i in np.flatnonzero(w)})


def normal_score(held, held_toxic, share):
    """How far the toxic texts among those that hold a feature exceed chance (2x2 table); numbers or numpy arrays."""
    chance = held * share
    return (held_toxic - chance) / np.sqrt(np.maximum(chance * (1 - share), 1e-9))


def remainder(doc_id):
    """crc32(doc_id as text) mod 3."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3))


def labelled_features(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, groups=IDENTITY_TERMS) -> DataFrame:
    """id, toxic, found (hashed features) and swaps (gone, new) of at most ``max_docs`` labelled documents outside the held-out third."""
    marks = (labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
             .filter("__id is not null and __toxic in (0, 1)").filter(remainder(F.col("__id")) != 1)
             .groupBy("__id").agg(F.max("__toxic").alias("__toxic")))
    order = [F.xxhash64("__id"), F.col("__id")]
    halves = [marks.filter(F.col("__toxic") == k).orderBy(*order).limit(max_docs // 2) for k in (0, 1)]
    sample = F.broadcast(halves[0].unionAll(halves[1]))  # at most max_docs rows of two numbers
    others = others_of(groups)
    changes = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("new", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            swaps = [[{"gone": gone, "new": new} for gone, new in swapped(t, others)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([features(t) for t in texts], pa.list_(pa.int32())), pa.array(swaps, changes)],
                ["id", "toxic", "found", "swaps"])

    texts = small_batches(docs).select(F.col("doc_id").alias("__id"), whole_text().alias("__text"))
    joined = texts.join(sample, "__id").select("__id", "__toxic", "__text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"id {kind}, toxic int, found array<int>, swaps array<struct<gone: array<int>, new: array<int>>>"
    return joined.mapInArrow(run, schema).dropDuplicates(["id"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, groups=IDENTITY_TERMS,
          counterfactual: float = COUNTERFACTUAL) -> Model:
    """The fitted model; the labelled texts' features are written once, counted by Spark and collected as far as they are tried."""
    table = written(labelled_features(docs, labels, max_docs, groups), "toxicity-features")
    n, toxic = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Model()
    held = (table.select("toxic", F.explode("found").alias("feature")).groupBy("feature")
            .agg(F.count(F.lit(1)).alias("held"), F.sum("toxic").alias("held_toxic")).filter(F.col("held") >= MIN_DOCS))
    share = toxic / n
    chance = F.col("held") * F.lit(share)
    tried = held.filter((F.col("held_toxic") - chance) / F.sqrt(F.greatest(chance * (1 - share), F.lit(1e-9))) >= MIN_SCORE - 1e-9)
    swaps = table.select(F.explode("swaps").alias("s")).select("s.gone", "s.new")
    terms = swaps.select(F.explode(F.concat("gone", "new")).alias("feature"))
    tried = np.array([r[0] for r in tried.select("feature").union(terms).distinct().orderBy("feature").collect()], np.int32)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.intersect1d(np.array(f, np.int32), tried) for f in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["id", "toxic", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = table.select("id", "toxic", "found").mapInArrow(kept, f"id {kind}, toxic int, found array<int>").orderBy("id").collect()
    changes = [(r["gone"], r["new"]) for r in swaps.orderBy("gone", "new").collect()]
    return fit([np.array(r["found"], np.int32) for r in got], np.array([r["toxic"] for r in got], float), changes, counterfactual=counterfactual)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())], [*names, "score", "predicted"])

    return small_batches(docs).select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)
