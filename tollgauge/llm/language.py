"""Language identification with error-correcting output codes.

Every known language has a codeword of bits. For each bit one binary n-gram classifier (logistic, on hashed letter n-grams) predicts on
which side a text's language stands. Decoding adds, per language, the logistic losses of its bits weighted by how well each bit's
classifier does on rows kept out of its fit; the nearest codeword wins. Texts whose two nearest codewords are close are ambiguous.

Fit on a bounded sample: about ``per_language`` texts of each language (by text hash). Prediction reads the whole text and nothing else.

Defined cases: a null text or one without letters is ``und`` with score 0 and ambiguous; without any labelled row everything is ``und``;
with one known language every text with letters has it, score 1; rows without a language are not learnt from; columns beside text and
lang are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.features import LANG_SIZE, Adam, Sample, language_features, rows_of, sampled, sparse_rows

UNKNOWN = "und"
WIDTH = 3 * LANG_SIZE


def codewords(k: int) -> np.ndarray:
    """(k, bits) of +1 and -1: every split for up to 7 languages, else the best of 50 seeded draws by least distance."""
    if k <= 7:
        splits = [s for r in range(1, k) for s in combinations(range(1, k), r)]
        code = -np.ones((k, max(1, len(splits))))
        for b, s in enumerate(splits):
            code[list(s), b] = 1
        return code
    rng, bits = np.random.default_rng(11), int(np.ceil(10 * np.log2(k)))
    draws = (rng.choice([-1.0, 1.0], (k, bits)) for _ in range(50))
    return max(draws, key=lambda c: min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i)))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weight[:-1] + self.weight[-1]
        return np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(1) for c in self.code], 1)


def fit_languages(docs: DataFrame, use: Column | None = None, per_language: int = 400, epochs: int = 30) -> LanguageModel:
    """Fit on rows of ``docs`` (text, lang) that ``use`` allows."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.lit(True) if use is None else use)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    names = sorted(counts)
    share = F.create_map(*[F.lit(v) for c in names for v in (c, min(1.0, per_language / counts[c]))]) if names else None
    code = codewords(len(names))
    if len(names) < 2:
        return LanguageModel(names, code, np.zeros((WIDTH + 1, 1), np.float32), np.ones(1))
    taken = sampled(known.select("text", F.col("lang").alias("tag")), "language", share[F.col("tag")])
    sample = Sample(sparse_rows(taken, language_features), WIDTH)
    target = code[[names.index(t) for t in sample.tag]]
    n, bits = len(target), code.shape[1]
    fit, rest = np.arange(n)[np.arange(n) % 5 > 0], np.arange(n)[np.arange(n) % 5 == 0]
    adam, rng = Adam((WIDTH + 1, bits)), np.random.default_rng(3)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            x, y = sample.dense(part), target[part]
            slope = -y / (1 + np.exp(y * (x @ adam.w[:-1] + adam.w[-1]))) / len(part)
            adam.step(np.vstack([x.T @ slope + 1e-4 * adam.w[:-1], slope.sum(0)]).astype(np.float32))
    wrong = ((sample.dense(rest) @ adam.w[:-1] + adam.w[-1]) * target[rest] <= 0).mean(0) if len(rest) else np.zeros(bits)
    trust = np.maximum(0.05, 1 - 2 * wrong)
    return LanguageModel(names, code, adam.w, trust / trust.mean())


def identify(docs: DataFrame, model: LanguageModel, margin: float = 1.0) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous (the two nearest codewords' losses differ by less than ``margin``).

    The columns take these names; a column of ``docs`` with one of them is replaced.
    """
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(model)  # bounded: hashed n-grams x bits
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            text = batch.column(names.index("text"))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(text)
            best, score, near = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            if len(m.languages) == 1:
                score[:] = 1
            elif m.languages:
                for i, j, x in rows_of(text, language_features):
                    loss = m.losses(x)
                    order = np.argsort(loss, axis=1, kind="stable")
                    best[i:j] = order[:, 0]
                    low = loss[np.arange(j - i), order[:, 0]]
                    score[i:j] = 1 / np.exp(low[:, None] - loss).sum(1)
                    near[i:j] = loss[np.arange(j - i), order[:, 1]] - low < margin
            sure = letters & bool(m.languages)
            pred = [m.languages[b] if s else UNKNOWN for b, s in zip(best, sure)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(sure, np.clip(score, 0, 1), 0)), pa.array(near | ~sure)],
                names=[*names, "lang_pred", "score", "ambiguous"],
            )

    return docs.select(*names).mapInArrow(run, schema)


def fold(column: str, of: int) -> Column:
    """crc32 of an id's text modulo ``of``; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op3_language_id(docs: DataFrame) -> DataFrame:
    """The contract's columns: fitted where the fold is not 2, predicted everywhere. A null id counts as not held out."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit_languages(docs.select("text", "lang", held_out.alias("held_out")), ~F.col("held_out"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
