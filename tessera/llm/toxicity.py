"""Toxic passages by maximum-scoring segments.

* A word's score is its log odds between toxic and other labelled documents,
  each smoothed by a Dirichlet prior of half an occurrence and of the word's overall share.
  Only words whose counts differ beyond what the number of tested words
  explains have a score; a word without one has that of its longest beginning
  (3 to 8 bytes) that has one.  Beginnings are counted over the words that
  have no score of their own.
* Every word costs a drift, so that ordinary text loses.  One linear scan
  (Ruzzo and Tompa's) finds all maximal segments of a text.  As only scored
  words can gain, runs of other words are one step of the scan.
* Segments of documents that are not toxic follow an extreme-value law.  As
  scores are logs of likelihood ratios and words cost a drift,
  E[exp(score)] < 1 there, so that its rate is 1 at least, and 1 is taken; its
  size is the number of segments seen there.  It turns a segment's score into
  the number of as good ones that chance would bring in a text of that length;
  the k best together
  are as unlikely as k such events of a Poisson law.  The most surprising k
  gives the document's evidence, a logistic curve its probability.

Scores of words for the law and the curve come from one half of the training
rows, and the segments from the other, so that words are as new there as in
other texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import discard, own_columns, staged
from tessera.llm._text import _BASE, _BASE_INVERSE, _BYTE, ALNUM, U, Words, _powers, mix, slices

#: Labelled rows that the model is fitted on, at most, chosen by hash.
TRAINING_ROWS = 20_000
#: Of the prior: occurrences of any word on either side, and strength of the overall shares, as a part of the smaller side.
LEAST_PRIOR, PRIOR = 0.5, 0.1
#: Bytes of a word's beginnings.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: What each word costs a segment, and the least score that a word can have.
DRIFT, LEAST_SCORE = 0.1, 2.0
_SALT = U(0xD1B54A32D192ED03)
_FILTER_BITS = 20


class _Hashes:
    """Hashes of any pieces of a slice, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=self.total[1:])
        self.inverse = _powers(_BASE_INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


@dataclass
class Lexicon:
    """Scores by the hash of a word or of a beginning, sorted by hash."""

    keys: np.ndarray
    scores: np.ndarray
    _near: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, rows: list) -> Lexicon:
        keys = np.array([r["token"] for r in rows], dtype=np.int64).view(U)
        order = np.argsort(keys)
        return cls(keys[order], np.array([r["score"] for r in rows], dtype=float)[order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes have a score, and the scores."""
        if self._near is None:
            self._near = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self._near[self.keys & U((1 << _FILTER_BITS) - 1)] = True
        at = np.flatnonzero(self._near[hashes & U((1 << _FILTER_BITS) - 1)])
        place = np.searchsorted(self.keys, hashes[at])
        place = np.minimum(place, len(self.keys) - 1)
        same = self.keys[place] == hashes[at] if len(self.keys) else np.zeros(0, dtype=bool)
        return at[same], self.scores[place[same]]


def _word_scores(words: Words, own: Lexicon, beginnings: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Scored words of a slice, in order, and their scores."""
    hashes, lengths = _Hashes(words.bytes), words.ends - words.starts
    score = np.zeros(len(words.starts))
    for k in BEGINNINGS if len(beginnings.keys) else ():
        longer = np.flatnonzero(lengths > k)
        at, found = beginnings.find(hashes.of(words.starts[longer], words.starts[longer] + k) ^ _SALT)
        score[longer[at]] = found
    at, found = own.find(hashes.of(words.starts, words.ends))
    score[at] = found
    places = np.flatnonzero(score > 0)
    return places, score[places]


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of all maximal-scoring segments of a text whose words at
    `places` have `scores` and whose others have none, after every word has cost `drift`.

    Linear: a candidate knows the nearest one before it that begins at a lower running sum.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest lower
    total, before = 0.0, None
    for place, score in zip(places, scores, strict=True):
        if before is not None:
            total -= drift * (place - before - 1)
        before = place
        if score <= drift:
            total += score - drift
            continue
        low, first = total, place
        total += score - drift
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((low, total, first, place, j))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, last, high - low) for low, high, first, last, _ in found]


def _texts(column: pa.Array, own: Lexicon, beginnings: Lexicon) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """For each text: number of words, segments, and where its words start and end in bytes."""
    for first, last, data, offsets in slices(column):
        words = Words(data, offsets, ALNUM)
        places, scores = _word_scores(words, own, beginnings)
        cuts = np.searchsorted(places, words.of)
        for k in range(last - first):
            a, b = words.of[k], words.of[k + 1]
            at, got = places[cuts[k] : cuts[k + 1]] - a, scores[cuts[k] : cuts[k + 1]]
            yield int(b - a), maximal_segments(at.tolist(), got.tolist()) if len(at) else [], words.starts[a:b] - offsets[k], words.ends[a:b] - offsets[k]


@dataclass
class Model:
    own: Lexicon
    beginnings: Lexicon
    #: Of the extreme-value law: size n exp(-s) segments of score s or more in n words.
    size: float = 1.0
    #: Of the logistic curve.
    bias: float = 0.0
    slope: float = 0.0

    def expected(self, n: int, scores: np.ndarray) -> np.ndarray:
        return self.size * n * np.exp(-scores)

    def surprise(self, n: int, scores: list[float]) -> float:
        """-ln of the probability of the most surprising k best segments, at least 0."""
        if not scores:
            return 0.0
        k = np.arange(1, len(scores) + 1)
        log_expected = math.log(self.size * n) - np.sort(np.array(scores))[::-1]
        return max(0.0, float((-k * log_expected + np.cumsum(np.log(k)) - np.log(k * (k + 1))).max()))

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.bias + self.slope * surprise, -500.0), 500.0)))


# Counting.  Fit 0 and 1 are the halves of the training rows, fit 2 is all of them.


def _counted(known: list[Lexicon] | None):
    """For each token, fit and label, in how many texts it is.

    known: scores of words by fit, where beginnings are counted; else words are.
    """

    def tokens(words: Words, hashes: _Hashes, fit: int) -> tuple[np.ndarray, np.ndarray]:
        text = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
        whole = hashes.of(words.starts, words.ends)
        if known is None:
            return whole, text
        free = np.ones(len(whole), dtype=bool)
        free[known[fit].find(whole)[0]] = False
        out, of = [], []
        for k in BEGINNINGS:
            which = np.flatnonzero(free & (words.ends - words.starts > k))
            out.append(hashes.of(words.starts[which], words.starts[which] + k) ^ _SALT)
            of.append(text[which])
        return np.concatenate(out), np.concatenate(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, half = batch.column("toxic").to_numpy(), batch.column("half").to_numpy()
            for first, last, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, ALNUM)
                hashes = _Hashes(words.bytes)
                for fit in range(3):
                    token, text = tokens(words, hashes, fit)
                    in_fit = fit == 2 or half[first:last][text] == fit
                    token, text = (token, text) if fit == 2 else (token[in_fit], text[in_fit])
                    # Once a text: pairs are told apart by a hash of both.
                    once = np.unique(mix(token + text.astype(U) * _SALT), return_index=True)[1]
                    for label in (0, 1):
                        mine = once[toxic[first:last][text[once]] == label]
                        found, n = np.unique(token[mine], return_counts=True)
                        size = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found.view(np.int64)), pa.array(np.full(size, fit, np.int32)), pa.array(np.full(size, label, np.int32)), pa.array(n)],
                            names=["token", "fit", "label", "n"],
                        )

    return run


def _lexicons(rows: DataFrame, texts: dict[tuple[int, int], int], known: list[Lexicon] | None) -> list[Lexicon]:
    """Scores of words, or of beginnings of words that have none, by fit.

    What reaches the driver are tokens that tell the labels apart, of at most
    TRAINING_ROWS texts.
    """
    counts = rows.mapInArrow(_counted(known), "token long, fit int, label int, n long").groupBy("token", "fit")
    per_label = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    counts = staged(counts.agg(*per_label), "tokens")
    whole = {r["fit"]: r for r in counts.groupBy("fit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("v")).collect()}
    out = []
    for fit in range(3):
        if fit not in whole or not texts.get((fit, 0)) or not texts.get((fit, 1)):
            out.append(Lexicon.of([]))
            continue
        of = whole[fit]
        held = [F.col(f"n{k}").cast("double") for k in (0, 1)]
        size = [float(texts[fit, k]) for k in (0, 1)]
        # Likelihood ratio of two rates against one, of texts that hold the token.
        both = (held[0] + held[1]) / sum(size)
        part = lambda seen, rate, n: F.when(seen > 0, seen * F.log(seen / (rate * n))).otherwise(0.0)
        ratio = 2 * sum((part(h, both, n) + part(F.lit(n) - h, 1 - both, n) for h, n in zip(held, size, strict=True)), F.lit(0.0))
        strength = PRIOR * min(of["n0"], of["n1"])
        prior = LEAST_PRIOR + strength * (held[0] + held[1]) / float(of["n0"] + of["n1"])
        share = lambda k: (held[k] + prior) / (float(of[f"n{k}"]) + strength + LEAST_PRIOR * of["v"])
        told = counts.where((F.col("fit") == fit) & (held[1] * size[0] > held[0] * size[1]))
        told = told.where(ratio >= 2 * math.log(max(of["v"], 2))).withColumn("score", F.log(share(1) / share(0)))
        out.append(Lexicon.of(told.where(F.col("score") >= LEAST_SCORE).select("token", "score").collect()))
    discard(counts)
    return out


def _calibrated(own: list[Lexicon], beginnings: list[Lexicon]):
    """Segments of each training text by the scores of the other half, and how many there are by those of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy()
            n, segments, by_all, toxic = [], [], [], []
            for fit in (0, 1):
                which = np.flatnonzero(half == 1 - fit)
                texts = batch.column("text").take(pa.array(which))
                for count, found, _, _ in _texts(texts, own[fit], beginnings[fit]):
                    n.append(count)
                    segments.append([s for _, _, s in found])
                by_all += [len(found) for _, found, _, _ in _texts(texts, own[2], beginnings[2])]
                toxic.append(batch.column("toxic").to_numpy()[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(toxic).astype(np.int32)), pa.array(n, pa.int64()), pa.array(segments, pa.list_(pa.float64())), pa.array(by_all, pa.int64())], names=["toxic", "n", "segments", "by_all"]
            )

    return run


def _curve(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Bias and slope of the logistic curve over (evidence, other texts, toxic texts), with Platt's targets."""
    z, others, toxic = (np.array(x, dtype=float) for x in zip(*bins, strict=True))
    n = others + toxic
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (others.sum() + 2)
    wanted = toxic * high + others * low
    w = np.array([math.log((toxic.sum() + 0.5) / (others.sum() + 1.5)), 0.0])
    design = np.stack([np.ones(len(z)), z], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        curvature = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(curvature, design.T @ (wanted - n * p) - np.array([0, 1e-3]) * w)
        # Damped, as bins far out on the wrong side make whole steps overshoot.
        w += step * min(1.0, 2.0 / max(np.abs(step * [1, 10]).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """docs: id, text.  labels: id, toxic, both not null."""
    sample = labels.orderBy(F.xxhash64("id", F.lit(29)), "id", "toxic").limit(training_rows)
    half = F.abs(F.xxhash64("id", F.lit(31)) % 2).cast("int")
    # Written once: counting and calibrating read it again.
    rows = staged(docs.join(F.broadcast(sample), "id").select("text", F.col("toxic").cast("int").alias("toxic"), half.alias("half")), "training")
    by_half = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    texts = by_half | {(2, k): by_half.get((0, k), 0) + by_half.get((1, k), 0) for k in (0, 1)}
    own = _lexicons(rows, texts, None)
    beginnings = _lexicons(rows, texts, own)
    trained = staged(rows.mapInArrow(_calibrated(own, beginnings), "toxic int, n long, segments array<double>, by_all long"), "calibration")
    model = Model(own[2], beginnings[2])
    clean = trained.where("toxic = 0").agg(F.sum("n").alias("n"), F.sum(F.size("segments")).alias("by_half"), F.sum("by_all").alias("by_all")).first()
    model.size = (max(clean["by_half"] or 0, clean["by_all"] or 0) + 0.5) / max(clean["n"] or 0, 1) * math.exp(LEAST_SCORE - DRIFT)
    judged = trained.mapInArrow(_surprised(model), "toxic int, z double")
    bins = judged.groupBy(F.round(F.least("z", F.lit(400.0)), 1).alias("z")).agg(F.count_if(F.col("toxic") == 0).alias("others"), F.count_if(F.col("toxic") == 1).alias("toxic")).collect()
    model.bias, model.slope = _curve([(r["z"], r["others"], r["toxic"]) for r in bins] or [(0.0, 0.0, 0.0)])
    discard(rows, trained)
    return model


def _surprised(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [model.surprise(n, s) for n, s in zip(batch.column("n").to_pylist(), batch.column("segments").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(z, pa.float64())], names=["toxic", "z"])

    return run


_PASSAGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", training_rows: int = TRAINING_ROWS, most_expected: float = 0.05) -> DataFrame:
    """Probability of toxicity of every document, and its toxic passages.

    Returns one row per input row: id, n_words, evidence, score, passages.
    Passages are the maximal segments of which chance would bring at most
    `most_expected` in a text of that length: first and last byte offset (end
    exclusive) in the UTF-8 text, score, expected number.  The document's id
    is no input of a score, and neither is any other column; the ids of labels
    choose the training rows.

    Labels with a null id or label are ignored; an id labelled twice counts
    with each, and so does each of several rows of an id.  Without labels, or
    with one label only, all scores are that label's smoothed rate (a quarter
    without any).  A null or empty text has no words and scores what texts
    without evidence do; long texts are read whole; equal texts score alike.
    """
    source = own_columns(docs, id=id_col, text=text_col)
    marks = own_columns(labels, id=id_col, toxic=toxic_col).where("id is not null and toxic is not null").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    given = source.sparkSession.sparkContext.broadcast(fit(source, marks, training_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            n, evidence, score, passages = [], [], [], []
            for count, found, starts, ends in _texts(batch.column("text"), model.own, model.beginnings):
                z = model.surprise(count, [s for _, _, s in found])
                n.append(count)
                evidence.append(z)
                score.append(model.probability(z))
                expected = model.expected(count, np.array([s for _, _, s in found]))
                passages.append([{"begin": int(starts[a]), "end": int(ends[b]), "score": s, "expected": float(e)} for (a, b, s), e in zip(found, expected, strict=True) if e <= most_expected])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(evidence, pa.float64()), pa.array(score, pa.float64()), pa.array(passages, _PASSAGES)], names=["id", "n_words", "evidence", "score", "passages"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_words long, evidence double, score double, passages array<struct<begin: long, end: long, score: double, expected: double>>")


def held_out(id_: Column) -> Column:
    """Whether an id belongs to the fifth that is kept from training."""
    return F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 5 == 0
