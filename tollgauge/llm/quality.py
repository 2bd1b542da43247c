"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows marked good; every other text, marked or not, is unlabelled. A linear scorer on whole-text features minimises
the non-negative unbiased risk: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) with logistic loss, so its score estimates the
probability of being good. The class prior is estimated before, from a scorer of positives against unlabelled texts on rows kept out of
its fit: the least upper bound of U's share over P's share above a score.

Fit on bounded samples, by text hash: about ``positives`` good texts and ``unlabelled`` texts. Scoring reads the whole text only.

Defined cases: null and blank texts are scored like any other (as empty); without good rows every score is 0.5; labels that repeat a
doc_id count once, and good only if all its marks are; null ids are never labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.features import SHAPE_SIZE, STEPS, WORD_SIZE, Adam, Sample, quality_features, rows_of, sampled, sparse_rows
from tollgauge.llm.language import fold

SHARES = 14
WIDTH = SHAPE_SIZE + WORD_SIZE + SHARES * (1 + len(STEPS))


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in U: at the score where the confidence bound of U's tail over P's tail is least."""
    if not len(p) or not len(u):
        return 0.5
    cut = np.unique(np.concatenate([p, u]))
    qp = 1 - np.searchsorted(np.sort(p), cut, "left") / len(p)
    qu = 1 - np.searchsorted(np.sort(u), cut, "left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(p)) + np.sqrt(np.log(4 / delta) / 2 / len(u))
    best = np.argmin((qu + 1.01 * slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.01, 0.99))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _fit(p: Sample, u: Sample, pi: np.ndarray, ui: np.ndarray, prior: float | None, epochs: int, decay: float) -> np.ndarray:
    """Weights and bias. Without a prior: plain logistic of P against U, for the prior's estimate."""
    adam, rng = Adam((WIDTH + 1,), 0.05), np.random.default_rng(5)
    for _ in range(epochs):
        steps = max(1, (len(pi) + len(ui)) // 512)
        for a, b in zip(np.array_split(rng.permutation(pi), steps), np.array_split(rng.permutation(ui), steps)):
            if not len(a) or not len(b):
                continue
            xp, xu = p.dense(a), u.dense(b)
            fp, fu = xp @ adam.w[:-1] + adam.w[-1], xu @ adam.w[:-1] + adam.w[-1]
            if prior is None:
                gp, gu = -_sigmoid(-fp) / len(a), _sigmoid(fu) / len(b)
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                gp, gu = -prior * _sigmoid(-fp) / len(a), np.zeros(len(b))
                if negative >= 0:
                    gp, gu = gp - prior * _sigmoid(fp) / len(a), _sigmoid(fu) / len(b)
                else:  # the estimated risk on negatives fell below zero: step back from what made it so
                    gp, gu = prior * _sigmoid(fp) / len(a), -_sigmoid(fu) / len(b)
            adam.step(np.append(xp.T @ gp + xu.T @ gu + decay * adam.w[:-1], gp.sum() + gu.sum()).astype(np.float32))
    return adam.w


@dataclass
class QualityModel:
    weight: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x @ self.weight[:-1] + self.weight[-1]).astype(np.float64))


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, positives: int = 3000, unlabelled: int = 4500, epochs: int = 60, decay: float = 3e-6, prior: float | None = None) -> QualityModel:
    """Fit on ``labels`` (doc_id, quality) where ``use`` (on doc_id) allows, and unlabelled texts of ``docs`` (doc_id, text)."""
    good = labels.where(use).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    n_good, n_docs = good.count(), docs.count()
    texts = docs.select("doc_id", "text")
    # the sampled ids, not the texts, meet the labels: texts are read again by key for the bounded sample only
    some = good.where(F.pmod(F.xxhash64(F.lit("good"), "doc_id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, positives / max(n_good, 1)))
    tagged = texts.join(some, "doc_id", "left_semi").select("text", F.lit(1).alias("tag"))
    rest = sampled(texts.where(use | F.col("doc_id").isNull()).withColumn("tag", F.lit(0)), "unlabelled", min(1.0, unlabelled / max(n_docs, 1)))
    p, u = Sample(sparse_rows(tagged, quality_features), WIDTH), Sample(sparse_rows(rest, quality_features), WIDTH)
    if not p.rows or not u.rows:
        return QualityModel(np.zeros(WIDTH + 1, np.float32), 0.5)
    pi, ui = np.arange(len(p.rows)), np.arange(len(u.rows))
    if prior is None:
        w = _fit(p, u, pi[pi % 2 == 0], ui[ui % 2 == 0], None, epochs, decay)
        held = [np.concatenate([s.dense(part) @ w[:-1] + w[-1] for part in np.array_split(i, max(1, len(i) // 512))]) for s, i in ((p, pi[pi % 2 == 1]), (u, ui[ui % 2 == 1])) if len(i)]
        prior = estimate_prior(*held) if len(held) == 2 else 0.5
    return QualityModel(_fit(p, u, pi, ui, prior, epochs, decay), prior)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score: the estimated probability of being good. A column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: WIDTH numbers
    names = [c for c in docs.columns if c != "score"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, x in rows_of(batch.column(names.index("text")), quality_features):
                score[i:j] = held.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "score"])

    return docs.select(*names).mapInArrow(run, schema)


def op1_pu_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: labels of fold 0 are never learnt from; predicted is 1 from a score of 0.3. A null id is not held out."""
    model = fit_quality(docs, labels, fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
