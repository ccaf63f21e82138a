"""Operator 8: toxicity by multiple-instance learning.

An instance is a sentence, or a stretch of at most WINDOW words of a longer one. Its probability is a
logistic function of the words in it; a document's probability is the noisy-or of its instances:
1 - product of (1 - p). Weights are trained on document labels alone, by gradient steps on the
documents' likelihood, and then mark the sentences at fault.
"""

from __future__ import annotations

import re
import string
from array import array
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm.common import labelled_text, release, table, tidy

#: Labelled documents used for training at most: those of smallest xxhash64(doc_id).
TRAIN_DOCS = 8000
#: A word or stem needs so many toxic training documents to get a weight.
LEAST_DOCS = 4
STEMS = (4, 5, 6)
#: ... and to be so many times as frequent among toxic training documents as among all.
LIFT = 2.0
#: Documents that the base rate counts as in a feature's own rate; the rate's log odds give the weight to start from and to stay near.
PRIOR = 10.0
STEPS = 150
PENALTY = 0.3
WINDOW = 40
THRESHOLD = 0.7
OFFENDING = 0.5
BREAK = re.compile(r"[.!?\n]+")
SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = string.punctuation + "«»“”„‘’…¡¿–—"


def instances(text: str) -> list[list[str]]:
    """Words of each instance of a text, as they are written."""
    out = []
    for sentence in BREAK.split(text):
        words = sentence.split()
        if len(words) <= WINDOW:
            if words:
                out.append(words)
        else:
            out += [words[k : k + WINDOW] for k in range(0, len(words), WINDOW)]
    return out


def features(word: str) -> list[str]:
    """The word in lower case without marks at its edges, and its first letters, so that an unseen form of a known stem counts."""
    word = word.lower().strip(EDGES)
    return [word, *[f"{word[:n]}-" for n in STEMS if len(word) > n]] if word else []


def logit(absent):
    """Log odds of 1 - exp(absent), within 12 of zero; absent is the logarithm of the noisy-or's complement."""
    import numpy as np

    return np.clip(np.log(np.maximum(-np.expm1(absent), 1e-300)) - absent, -12, 12)


def calibrate(x, y, rounds: int = 30, ridge: float = 1.0) -> tuple[float, float]:
    """Scale and shift of log odds that suit labels best, by Newton's steps from 1 and 0."""
    import numpy as np

    wide, at, start = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-wide @ at))
        at = at - np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + ridge * np.eye(2), wide.T @ (p - y) + ridge * (at - start))
    return float(at[0]), float(at[1])


def fit(texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = PENALTY, least_docs: int = LEAST_DOCS) -> tuple[dict[str, float], tuple[float, float, float]]:
    """Weights of words and stems, and the bias, scale and shift. With one label alone, no weights and a bias that gives it."""
    import numpy as np

    positive = sum(labels)
    if not 0 < positive < len(labels):
        return {}, (4.0 if positive else -8.0, 1.0, 0.0)
    found: Counter = Counter()
    for text, label in zip(texts, labels, strict=True):
        if label:
            found.update({f for w in set(text.split()) for f in features(w)})
    numbers = {w: k for k, w in enumerate(sorted(w for w, n in found.items() if n >= least_docs))}
    # Of each instance only the numbers of its features are kept.
    known: dict[str, tuple[int, ...]] = {}
    everywhere = np.zeros(len(numbers), np.int64)
    owners, sizes, index = array("i"), array("i"), array("i")
    for doc, text in enumerate(texts):
        in_doc: set[int] = set()
        for words in instances(text):
            own: list[int] = []
            for w in set(words):
                ids = known.get(w)
                if ids is None:
                    if len(known) > 200_000:
                        known.clear()
                    ids = known[w] = tuple(numbers[f] for f in features(w) if f in numbers)
                own += ids
            in_doc.update(own)
            owners.append(doc)
            sizes.append(len(own))
            index.extend(own)
        everywhere[list(in_doc)] += 1
    names = np.array(list(numbers), dtype=object)
    held = np.array([found[w] for w in names], np.int64)
    chosen = held >= LIFT * positive / len(labels) * everywhere if len(names) else np.zeros(0, bool)
    vocabulary, found_in, everywhere = names[chosen].tolist(), held[chosen], everywhere[chosen]
    owner, row = np.frombuffer(owners, np.int32), np.repeat(np.arange(len(owners)), np.frombuffer(sizes, np.int32))
    index = np.frombuffer(index, np.int32)
    if not len(owner) or not vocabulary:
        return {}, (-8.0, 1.0, 0.0)
    kept = chosen[index]
    row, index = row[kept], (np.cumsum(chosen) - 1)[index[kept]]
    y = np.array(labels, float)
    base = positive / len(labels)
    rate = (found_in + PRIOR * base) / (everywhere + PRIOR)
    share = np.array([1 + (len(STEMS) if w.endswith("-") else sum(len(w) > n for n in STEMS)) for w in vocabulary])
    start = np.maximum(0, np.log(rate / (1 - rate)) - np.log(base / (1 - base))) / share
    weights, bias = start.copy(), -6.0
    first, second = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights[index], minlength=len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        absent = np.bincount(owner, -np.logaddexp(0, z), minlength=len(y))
        none = np.exp(absent)
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0)
        slope = p * pull[owner]
        g = np.append(np.bincount(index, slope[row], minlength=len(vocabulary)) + penalty * (weights - start), slope.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= float(move[-1])
    z = bias + np.bincount(row, weights[index], minlength=len(owner))
    absent = np.bincount(owner, -np.logaddexp(0, z), minlength=len(y))
    scale, shift = calibrate(logit(absent)[absent < 0], y[absent < 0])
    return {w: float(weights[k]) for k, w in enumerate(vocabulary) if abs(weights[k]) > 1e-3}, (float(bias), max(scale, 0.1), shift)


class Weights(dict):
    """Weight of a word as it is written; holds the latest words."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) > 150_000:
            self.clear()
        self[word] = found
        return found


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict[str, float], tuple[float, float, float]]:
    """Fit on at most train_docs labelled documents outside the held-out third. The fit runs in one task on that bounded sample."""
    name = F.col("doc_id").cast("long")
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(name.cast("string").cast("binary")) % 3 != 1))
        .groupBy(name.alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_docs)
    )
    # Repeated doc_ids could exceed the bound, so one text of each is taken.
    sample = labelled_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches):
        import pyarrow as pa

        release()
        rows = sorted((d, t or "", y) for b in batches for d, t, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True))
        weights, rest = fit([t for _, t, _ in rows], [y for _, _, y in rows]) if rows else ({}, (-8.0, 1.0, 0.0))
        names = [*weights, "bias ", "scale ", "shift "]  # words hold no space
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*weights.values(), *rest], pa.float64())], ["word", "weight"])

    fitted = {r["word"]: r["weight"] for r in sample.repartition(1).mapInArrow(run, "word string, weight double").collect()}  # words of the bounded sample
    return fitted, (fitted.pop("bias ", -8.0), fitted.pop("scale ", 1.0), fitted.pop("shift ", 0.0))  # the rest where no row is labelled


@tidy
def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Probability that a document is toxic, and the sentences at fault.

    labels: doc_id, toxic. Rows with crc32(doc_id as text) mod 3 = 1 are held out of training. Returns doc_id, held_out,
    score, predicted (1 if score >= threshold) and sentences, an array of (start, end, score) in code points of the text for
    instances of probability 0.5 or more. Texts are taken whole. A null or empty text has score 0 and no sentences; a null doc_id is not
    held out; repeated rows are scored each; other columns are not read. Without labels of both kinds the score is constant.
    """
    weights, (bias, scale, shift) = train(docs, labels, train_docs)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        release()
        cache = Weights(weights)
        get = cache.__getitem__
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                words = instances(text or "")
                z = np.array([bias + sum(map(get, set(w))) for w in words])
                absent = -np.logaddexp(0, z).sum()
                scores.append(float(1 / (1 + np.exp(-scale * logit(absent) - shift))) if len(z) else 0.0)
                spans.append(locate(text, bias, get) if len(z) and z.max() >= 0 else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                ["doc_id", "score", "sentences"],
            )

    found = labelled_text(docs).mapInArrow(run, "doc_id long, score double, sentences array<struct<start: int, end: int, score: double>>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def locate(text: str, bias: float, get) -> list[dict]:
    """Start, end and probability of the instances of a text that are likely toxic."""
    import math

    out = []
    for sentence in SENTENCE.finditer(text):
        words = list(re.finditer(r"\S+", sentence[0]))
        for k in range(0, len(words), WINDOW):
            part = words[k : k + WINDOW]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(map(get, {w[0] for w in part}))))))
            if p >= OFFENDING:
                out.append({"start": sentence.start() + part[0].start(), "end": sentence.start() + part[-1].end(), "score": p})
    return out


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"))
