"""Quality classifier: scores learned from preferences between documents (Bradley-Terry), cut at a quantile."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.llm.quality_rules import BLANKS, WORD_GAP, char_count, stop_word_count

#: At most so many labelled documents are learned from: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Opponents that each document of either label meets.
OPPONENTS = 16
RIDGE = 1e-3
STEPS = 30
CUT = 0.7
SEED = 5


def features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with numbers that describe each whole text, and their names. Built-in functions, row-local;
    the measures are shares and logarithms, so that length alone doesn't drive a score."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    w = "_f_words"
    less = lambda chars: char_count(t, chars).cast("double")
    chars, n_words = F.greatest(F.length(t), F.lit(1)).cast("double"), F.greatest(F.size(w), F.lit(1)).cast("double")
    columns = {
        "_f_log_words": F.log1p(F.size(w).cast("double")),
        "_f_log_chars": F.log1p(F.length(t).cast("double")),
        "_f_word_length": ((F.length(t) - char_count(t, BLANKS)) / n_words).cast("double"),
        "_f_marks": less("#*$%&") / n_words,
        "_f_bars": less("|<>\\~^") / n_words,
        "_f_braces": less("{}[]()=;_\"") / n_words,
        "_f_shouts": less("!?") / n_words,
        "_f_digits": less("0123456789") / chars,
        "_f_capitals": less("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") / chars,
        "_f_stops": stop_word_count(t) / n_words,
        "_f_points": less(".,") / n_words,
        "_f_lines": less("\n") / n_words,
        "_f_distinct": F.size(F.array_distinct(w)) / n_words,
        "_f_pairs": F.size(F.array_distinct(F.split(F.regexp_replace(t, r"([^ \x09-\x0D]+)[ \x09-\x0D]+([^ \x09-\x0D]+)[ \x09-\x0D]*", "$1 $2\n"), "\n"))) / n_words,
    }
    first = docs.withColumn(w, F.filter(F.split(t, WORD_GAP), lambda x: x != ""))
    return first.withColumns({k: v.cast("double") for k, v in columns.items()}).drop(w), list(columns)


@dataclass(frozen=True)
class Ranking:
    """A linear score over standardised features with their squares, and the cut between the labels."""

    names: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    slope: float

    def score(self) -> Column:
        """0 to 1: the logistic of the distance to the cut, which itself has the score ``CUT``."""
        z = [F.greatest(F.least((F.col(n) - m) / s, F.lit(6.0)), F.lit(-6.0)) for n, m, s in zip(self.names, self.mean, self.scale)]
        terms = [*z, *(x * x for x in z)]
        raw = functools.reduce(operator.add, (F.lit(w) * x for w, x in zip(self.weights, terms)), F.lit(0.0))
        logit = (raw - F.lit(self.cut)) * F.lit(self.slope) + F.lit(float(np.log(CUT / (1 - CUT))))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def fit_ranking(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ranking:
    """Weights that minimise the logistic loss of feature differences, better minus worse, by Newton steps.

    Every document meets ``OPPONENTS`` of the other label, dealt by a fixed seed. The cut is the score
    quantile that leaves below it as many training documents as have label 0. With one label only
    there are no preferences: all weights are 0 and every score is the label's side of the cut.
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(names)), np.ones(len(names)))
    scale = np.where(scale > 1e-12, scale, 1.0)
    d = _design(x, mean, scale)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(2 * len(names))
    if not len(good) or not len(bad):
        return Ranking(names, mean.tolist(), scale.tolist(), w.tolist(), -1.0 if len(good) or not len(bad) else 1.0, 1.0)
    rng = np.random.default_rng(SEED)
    better = np.concatenate([np.repeat(good, OPPONENTS), rng.choice(good, OPPONENTS * len(bad))])
    worse = np.concatenate([rng.choice(bad, OPPONENTS * len(good)), np.repeat(bad, OPPONENTS)])
    diff = d[better] - d[worse]
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # the chance of the wrong order
        gradient = -(diff * p[:, None]).mean(0) + RIDGE * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    raw = d @ w
    order, k = np.sort(raw), len(bad)
    cut = float((order[k - 1] + order[k]) / 2)
    return Ranking(names, mean.tolist(), scale.tolist(), w.tolist(), cut, 1.0)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    """Fits on labelled rows outside the held-out fold, at most ``TRAIN_ROWS``; only their numbers reach the driver."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label).alias("_y")).distinct()
    chosen = rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(TRAIN_ROWS)
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    described, names = features(plain.join(F.broadcast(chosen), "_id"), "_text")  # a broadcast of TRAIN_ROWS rows at most
    # sorted here: a range exchange would compute the features once more for its sample
    got = described.select("_id", "_y", *names).toArrow().sort_by([(c, "ascending") for c in ("_id", "_y", *names)])
    x = np.stack([got.column(n).to_numpy() for n in names], axis=1) if got.num_rows else np.zeros((0, len(names)))
    return fit_ranking(x, got.column("_y").to_numpy() if got.num_rows else np.zeros(0, int), names)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row; a function of the text alone once learned.

    Null and empty texts get the score of a text without words. Documents that are labelled more than
    once with both labels count on both sides. Without labels all scores are equal. Repeated rows and
    null ids come back as they are; other columns are not read.
    """
    ranking = learn(docs, labels, id_col, text, label)
    described, _ = features(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text")
    scored = described.select(F.col("_id").alias(id_col), ranking.score().alias("score"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
