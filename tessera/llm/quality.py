"""Quality classifier with hierarchical empirical Bayes over sites.

Level 1, the document: two additive logistic models (good or bad, toxic or
not) over binned text statistics and word evidence, fitted on a bounded sample
of labelled rows.  Level 2, the site: expected rates by host and by path of a
host, of good and of toxic documents, from *all* documents there, by grouped
aggregation: a labelled document counts with its labels, all others with their
evidence.  A host's rate is shrunk towards the global one, a path's
towards its host's; how much is estimated from how far rates differ between
sites beyond what their sizes explain.  A document's posterior odds are its
own odds times its path's odds relative to the global ones, for quality and
toxicity alike; the path's are those of all other documents there, so that its
own evidence counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import BROADCAST_KEYS, discard, own_columns, staged
from tessera.llm._text import ALNUM, NOT_SPACE, U, Words, byte_class, slices

#: Labelled rows that the document models are fitted on, at most, chosen by hash.
TRAINING_ROWS = 8_000
#: Words with evidence that a model keeps.
EVIDENT_WORDS = 2_000
_BINS = 16
_SYMBOL = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_STATISTICS = 12


def _statistics(words: Words, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Twelve numbers of each text of a slice; zeros for a text without words."""
    n = len(offsets) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[offsets]).astype(float)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    count = np.diff(words.of).astype(float)
    some = np.maximum(count, 1)
    lengths = (words.ends - words.starts).astype(float)
    total, square = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(lengths**2))
    mean = np.diff(total[words.of]) / some
    spread = np.sqrt(np.maximum(np.diff(square[words.of]) / some - mean**2, 0))
    distinct, top, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        own = hashes[words.of[k] : words.of[k + 1]]
        if len(own):
            counts = np.unique(own, return_counts=True)[1]
            distinct[k], top[k] = len(counts), counts.max()
            repeats[k] = np.count_nonzero(own[1:] == own[:-1])
    return np.stack(
        [
            np.log1p(count), mean, spread, distinct / some, top / some, repeats / some,
            per_text(_SYMBOL[data]) / size, per_text(data == 0x7C) / some, per_text(data == 0x0A) / some,
            per_text((data >= 0x41) & (data <= 0x5A)) / size, per_text((data >= 0x30) & (data <= 0x39)) / size, per_text((data == 0x2E) | (data == 0x2C)) / some,
        ],
        axis=1,
    )


def _word_cores(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the alphanumeric words, and where each text's begin."""
    cores = Words(data, offsets, ALNUM)
    return cores.hashes(), cores.of


@dataclass
class Evidence:
    """Log odds of the words that tell most, and the additive model over bins."""

    words: np.ndarray
    odds: np.ndarray
    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def word_sums(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Greatest sum-to-date, sum and share of positive evidence of each text's distinct words."""
        out = np.zeros((len(of) - 1, 3))
        if not len(self.words):
            return out
        near = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        at = np.flatnonzero(self.words[near] == hashes)
        text = np.searchsorted(of, at, side="right") - 1
        both = np.unique(text * len(self.words) + near[at])
        text, odds = both // len(self.words), self.odds[both % len(self.words)]
        np.add.at(out[:, 0], text, odds)
        np.maximum.at(out[:, 1], text, odds)
        np.add.at(out[:, 2], text[odds > 1], 1)
        return out

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias)
        for k in range(features.shape[1]):
            total += self.weights[k, np.searchsorted(self.edges[k], features[:, k], side="right")]
        return total


def _design(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    columns = [np.searchsorted(edges[k], features[:, k], side="right") + k * _BINS for k in range(features.shape[1])]
    out = np.zeros((len(features), features.shape[1] * _BINS + 1))
    out[:, -1] = 1
    for c in columns:
        out[np.arange(len(out)), c] = 1
    return out


def _logistic(design: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps."""
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (label - p) - penalty * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many training texts of each half a word is, and in how many good and toxic ones."""
    for batch in batches:
        half, good, toxic = (batch.column(c).to_numpy() for c in ("half", "quality", "toxic"))
        for first, last, data, offsets in slices(batch.column("text")):
            hashes, of = _word_cores(Words(data, offsets, NOT_SPACE), data, offsets)
            for k in (0, 1):
                own = [(i, np.unique(hashes[of[i - first] : of[i - first + 1]])) for i in range(first, last) if half[i] == k]
                if not own:
                    continue
                row = np.repeat([i for i, _ in own], [len(w) for _, w in own])
                words, inverse = np.unique(np.concatenate([w for _, w in own]), return_inverse=True)
                sums = [np.bincount(inverse, weights=x, minlength=len(words)).astype(np.int64) for x in (np.ones(len(row)), good[row], toxic[row])]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.full(len(words), k, np.int32)), *map(pa.array, sums)], names=["word", "half", "n", "good", "toxic"])


def _word_evidence(counts: DataFrame, label: str, n: int, n_with: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of the words whose shares differ most, in standard errors; at most EVIDENT_WORDS reach the driver."""
    with_, without = F.col(label) + 0.5, F.col("n") - F.col(label) + 0.5
    a, b = with_ / (n_with + 1), without / (n - n_with + 1)
    odds = F.log(a / (1 - a)) - F.log(b / (1 - b))
    told = counts.select("word", odds.alias("odds"), (F.abs(odds) / F.sqrt(1 / with_ + 1 / without)).alias("z")).where("z > 4")
    rows = told.orderBy(F.desc("z"), "word").limit(EVIDENT_WORDS).select("word", "odds").collect()
    words, odds = np.array([r["word"] for r in rows], dtype=np.int64).view(U), np.array([r["odds"] for r in rows], dtype=float)
    order = np.argsort(words)
    return words[order], odds[order]


def _training_features(other: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
    """Statistics of each training text, and its sums by the words' evidence in the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, found = batch.column("half").to_numpy(), []
            for first, last, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NOT_SPACE)
                hashes, of = _word_cores(words, data, offsets)
                columns = [_statistics(words, data, offsets, words.hashes())]
                for label in ("good", "toxic"):
                    by_half = [Evidence(*other[label, 1 - k], None, None, 0).word_sums(hashes, of) for k in (0, 1)]
                    columns.append(np.where((half[first:last] == 0)[:, None], *by_half))
                found.append(np.hstack(columns))
            rows = np.concatenate(found) if found else np.zeros((0, _STATISTICS + 6))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), lists], names=["quality", "toxic", "features"])

    return run


def _additive(features: np.ndarray, label: np.ndarray, words: np.ndarray, odds: np.ndarray) -> Evidence:
    """The model of one label; with one class only, it always says that class' rate."""
    if len(label) < 2 or label.min() == label.max():
        rate = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.5
        return Evidence(np.zeros(0, U), np.zeros(0), np.zeros((0, 0)), np.zeros((0, _BINS)), float(np.log(rate / (1 - rate))))
    edges = np.array([np.quantile(features[:, k], np.linspace(0, 1, _BINS + 1)[1:-1]) for k in range(features.shape[1])])
    # Equal quantiles would leave the counts of rare words in one bin.
    edges[-3:] = [np.linspace(-4, 10, _BINS - 1), np.linspace(0, 7, _BINS - 1), np.arange(_BINS - 1) + 0.5]
    weights = _logistic(_design(features, edges), label)
    return Evidence(words, odds, edges, weights[:-1].reshape(-1, _BINS), float(weights[-1]))


def fit(training: DataFrame) -> tuple[Evidence, Evidence]:
    """The models of good and of toxic from (text, quality, toxic, half), whose texts stay in tasks.

    Words are weighed on one half of the rows and the model is fitted on the other, where they are
    as new as in other texts.  The driver gets the words that tell most, and 18 numbers a row.
    """
    counts = staged(training.mapInArrow(_word_counts, "word long, half int, n long, good long, toxic long").groupBy("word", "half").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))), "evidence")
    texts = {r["half"]: r for r in training.groupBy("half").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")).collect()}
    size = lambda c, *halves: sum(texts[k][c] for k in halves if k in texts)
    every = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    other = {(label, k): _word_evidence(counts.where(F.col("half") == k), label, size("n", k), size(label, k)) for label in ("good", "toxic") for k in (0, 1)}
    whole = {label: _word_evidence(every, label, size("n", 0, 1), size(label, 0, 1)) for label in ("good", "toxic")}
    rows = training.mapInArrow(_training_features(other), "quality long, toxic long, features array<double>").toPandas()
    discard(counts)
    features = np.array(rows["features"].tolist(), dtype=float).reshape(-1, _STATISTICS + 6)
    shared, own = features[:, :_STATISTICS], {"good": features[:, _STATISTICS : _STATISTICS + 3], "toxic": features[:, _STATISTICS + 3 :]}
    labels = {"good": rows["quality"].to_numpy(dtype=float), "toxic": rows["toxic"].to_numpy(dtype=float)}
    good, toxic = (_additive(np.hstack([shared, own[k]]), labels[k], *whole[k]) for k in ("good", "toxic"))
    return good, toxic


def _scored(good: Evidence, toxic: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[list] = [[], []]
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NOT_SPACE)
                statistics = _statistics(words, data, offsets, words.hashes())
                hashes, of = _word_cores(words, data, offsets)
                for to, model in zip(scores, (good, toxic), strict=True):
                    features = np.hstack([statistics, model.word_sums(hashes, of)])
                    to.append(model.log_odds(features) if len(model.weights) else np.full(len(features), model.bias))
            done = [np.concatenate(x) if x else np.zeros(0) for x in scores]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("host"), batch.column("path"), pa.array(done[0]), pa.array(done[1])], names=["id", "host", "path", "good", "toxic"])

    return run


def _rate(total: Column, n: Column, towards: Column, strength: Column) -> Column:
    return (total + towards * strength) / (n + strength)


def _strength(sites: DataFrame, total: str, n: str, towards: Column) -> float:
    """Pseudo-observations of the prior, by moments: between-site variance beyond sampling noise."""
    mu = towards
    m = sites.agg(
        F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mu, 2)).alias("between"),
        F.sum(mu * (1 - mu)).alias("noise"),
        F.sum(n).alias("n"),
        F.avg(mu * (1 - mu)).alias("spread"),
    ).first()
    if not m["n"] or m["spread"] is None:
        return 1e6
    variance = max((m["between"] - m["noise"]) / m["n"], 1e-9)
    return float(min(max(m["spread"] / variance - 1, 1.0), 1e6))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    training_rows: int = TRAINING_ROWS,
    least_quality: float = 0.5,
    most_toxic: float = 0.5,
) -> DataFrame:
    """Posterior quality and toxicity of every document.

    Returns one row per input row: id, host, path, host_quality, path_quality,
    p_quality, p_toxic, keep.  Labels with a null id or label are ignored; an
    id labelled twice counts with each of its labels; copies of a row count
    once among the training rows.  Long texts are read whole, in tasks.  A null or empty text is
    judged by its site and by what texts without words were labelled.  Null
    hosts and paths form sites of their own.  Without labels all
    probabilities are one half, and documents are kept.  Other columns are
    ignored.
    """
    source = own_columns(docs, id=id_col, text=text_col, host=host_col, path=path_col)
    marks = own_columns(labels, id=id_col, quality=quality_col, toxic=toxic_col).where("id is not null and quality is not null and toxic is not null")
    n = marks.count()
    sample = marks.orderBy(F.xxhash64("id", F.lit(17)), "id", "quality", "toxic").limit(training_rows)
    # Rows are told apart by the hash of their text, so that no text is sorted; copies of a row count once.
    keyed = source.select("id", "text", F.xxhash64("text").alias("hash"))
    keys = keyed.select("id", "hash").join(F.broadcast(sample), "id").distinct().orderBy(F.xxhash64("id", F.lit(17)), "id", "quality", "toxic", "hash").limit(training_rows)
    half = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(2)).cast("int").alias("half")
    training = keyed.join(F.broadcast(keys), ["id", "hash"]).dropDuplicates(["id", "hash", "quality", "toxic"])
    training = staged(training.select("text", (F.col("quality") > 0).cast("long").alias("quality"), (F.col("toxic") > 0).cast("long").alias("toxic"), half), "training")
    good, toxic = fit(training)
    discard(training)

    scored = staged(source.mapInArrow(_scored(good, toxic), "id long, host string, path string, good double, toxic double"), "scored")
    chance = lambda c: 1 / (1 + F.exp(-F.col(c)))
    clip = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    given = marks.groupBy(F.col("id").alias("of_id")).agg(F.count("*").alias("n_labels"), F.count_if(F.col("quality") > 0).alias("n_good"), F.count_if(F.col("toxic") > 0).alias("n_toxic"))
    seen = scored.join(F.broadcast(given) if n <= BROADCAST_KEYS else given, F.col("id") == F.col("of_id"), "left")
    told = lambda label, c: F.sum(F.coalesce(F.col(label).cast("double"), chance(c)))
    paths = staged(seen.groupBy("host", "path").agg(told("n_good", "good").alias("good"), told("n_toxic", "toxic").alias("toxic"), F.sum(F.coalesce("n_labels", F.lit(1))).alias("n")), "paths")
    whole = paths.agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).first()
    prior = {k: min(max((whole[k] or 0.5) / (whole["n"] or 1), 1e-6), 1 - 1e-6) for k in ("good", "toxic")}
    sums = staged(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n")), "hosts")
    strength = {k: F.lit(_strength(sums, k, "n", F.lit(p))) for k, p in prior.items()}
    hosts = sums.select(F.col("host").alias("of_host"), *(F.col(c).alias(f"of_{c}") for c in ("good", "toxic", "n")), *(_rate(F.col(k), F.col("n"), F.lit(p), strength[k]).alias(f"host_{k}") for k, p in prior.items()))
    paths = staged(paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), "paths")
    within = {k: F.lit(_strength(paths, k, "n", F.col(f"host_{k}"))) for k in prior}
    sites = paths.select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("host_good").alias("host_quality"), _rate(F.col("good"), F.col("n"), F.col("host_good"), within["good"]).alias("path_quality"),
        *(F.col(c).alias(f"path_{c}") for c in ("good", "toxic", "n")), "of_good", "of_toxic", "of_n",
    )
    sites = staged(sites, "sites")
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_KEYS else sites
    joined = seen.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")

    def without_itself(k: str) -> Column:
        """The rate of the document's path by all others there, shrunk towards its host's by all others."""
        own, n = F.coalesce(F.col(f"n_{k}").cast("double"), chance(k)), F.coalesce("n_labels", F.lit(1))
        host = _rate(F.col(f"of_{k}") - own, F.col("of_n") - n, F.lit(prior[k]), strength[k])
        return _rate(F.col(f"path_{k}") - own, F.col("path_n") - n, host, within[k])

    posterior = lambda k: 1 / (1 + F.exp(-(F.col(k) + logit(without_itself(k)) - logit(F.lit(prior[k])))))
    return joined.select(
        "id", "host", "path", "host_quality", "path_quality", posterior("good").alias("p_quality"), posterior("toxic").alias("p_toxic")
    ).withColumn("keep", (F.col("p_quality") >= least_quality - 1e-9) & (F.col("p_toxic") <= most_toxic + 1e-9))
