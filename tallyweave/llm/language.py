"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash32, in_fold
from .similarity import portions

_SIZES = (2, 3, 4)
_MULTIPLY = np.uint32(0x9E3779B1)
_PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category (not a number form or a mark)."""
    return any(map(str.isalpha, text))


def subword_ids(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bucket of every byte n-gram by its start, one array for each size; what is not a letter reads as a space."""
    plain = _PLAIN[codes].astype(np.uint32)
    out, h = [], np.zeros(len(plain), np.uint32)
    for n in range(1, max(_SIZES) + 1):
        if len(plain) < n:
            out.append(np.empty(0, np.int64))
            continue
        h = (h[: len(plain) - n + 1] * np.uint32(31) + plain[n - 1 :] + np.uint32(n)) * _MULTIPLY
        out.append((h >> np.uint32(32 - bits)).astype(np.int64))
    return [out[n - 1] for n in _SIZES]


@dataclass
class LanguageModel:
    """Logits of each bucket: what a document's mean embedding gives is the mean of its buckets' logits."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities (texts x languages)."""
        raws = [t.lower().encode() for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for a, b in portions(raws, 1 << 18):
            codes = np.frombuffer(b" " + b" ".join(raws[a:b]) + b" ", np.uint8)
            sizes = np.array([len(r) for r in raws[a:b]])
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # each document begins at the space before it
            for ids in subword_ids(codes, self.bits):
                at = np.minimum(starts, max(len(ids) - 1, 0))
                if len(ids):
                    total[a:b] += np.add.reduceat(self.logits[ids], at, axis=0)
                    count[a:b] += np.diff(np.r_[at, len(ids)])
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _gradient_steps(examples, labels, classes, bits, dims, epochs, rate, seed):
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims)).astype(np.float32)
    weights, bias = np.zeros((dims, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, share = examples[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ table[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = weights @ p
            weights -= lr * np.outer(mean, p)
            bias -= np.float32(0.1 * lr) * p
            table[ids] -= np.float32(lr) * np.outer(share, back) * np.float32(len(ids) ** 0.5)
    return table @ weights, bias


def fit_language_model(
    docs: DataFrame, *, per_language: int = 400, bits: int = 15, dims: int = 12, epochs: int = 3, rate: float = 0.5, accept_error: float = 0.01, seed: int = 8
) -> LanguageModel:
    """Learn from (doc_id, text, lang) of the rows outside the held-out fold.

    Fitted by stochastic gradient descent in numpy on the driver over a hash
    sample of about ``per_language`` documents of each language (the bound on
    what is sent there), whole and line by line, so that short texts are
    known too. A fifth of the sample's documents is left for calibration:
    the temperature that makes the scores likeliest there, and the score
    below which more than ``accept_error`` of the accepted ones would be
    wrong. Null languages and texts are not learned from. Sampled texts are
    taken whole, so what reaches the driver is bounded in rows.
    """
    known = docs.where(~in_fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0), bits)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
    chance = hash32(F.concat(F.lit("lang:"), F.col("doc_id").cast("string"))) / F.lit(4294967296.0)
    rows = sorted(known.where(chance < share[F.col("lang")]).select("lang", "text").collect())
    place = {lang: k for k, lang in enumerate(languages)}

    def counted(text):
        codes = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
        ids, n = np.unique(np.concatenate(subword_ids(codes, bits)), return_counts=True)
        return ids, (n / n.sum()).astype(np.float32)

    train, aside = [r for k, r in enumerate(rows) if k % 5 or len(rows) < 20], [r for k, r in enumerate(rows) if k % 5 == 0]
    parts = [(x, place[lang]) for lang, text in train for x in {text, *text.split("\n")} if has_letter(x)]
    parts.sort(key=lambda x: (x[1], x[0]))
    logits, bias = _gradient_steps([counted(x) for x, _ in parts], [y for _, y in parts], len(languages), bits, dims, epochs, rate, seed)
    model = LanguageModel(languages, logits.astype(np.float32), bias.astype(np.float64), bits)
    pieces = [(x, place[lang]) for lang, text in aside for x in (text, *text.split("\n")[:2]) if has_letter(x)]
    if pieces:
        p = np.log(np.maximum(model.scores([x for x, _ in pieces]), 1e-300))
        y = np.array([k for _, k in pieces])

        def loss(t):
            z = p / t
            return -(z[np.arange(len(y)), y] - z.max(1) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))).mean()

        model.temperature = float(min(np.geomspace(0.02, 5, 80), key=loss))
        s = model.scores([x for x, _ in pieces])
        best, right = s.max(1), s.argmax(1) == y
        order = np.argsort(-best, kind="stable")
        error = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
        fine = np.flatnonzero(error <= accept_error)
        model.reject_below = float(best[order][fine[-1]]) if len(fine) and fine[-1] < len(y) - 1 else 0.0
    return model


def predict_language(df: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``rejected`` to every row.

    The text is scored whole. ``und`` with score 0, rejected, where the text
    is null or has no letter, or where the model knows no language; elsewhere
    a learned language, ``rejected`` if the calibrated score is below the
    model's bound. Input columns with these names are replaced.
    """
    added = ["lang_pred", "score", "rejected"]
    df = df.drop(*added)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = batch.column(text_col).to_pylist()
                at = [i for i, t in enumerate(texts) if t and m.languages and has_letter(t)]
                lang, score, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if at:
                    p = m.scores([texts[i] for i in at])
                    for i, c, s in zip(at, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        lang[i], score[i], out[i] = m.languages[c], min(1.0, s), s < m.reject_below
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(out)], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, schema)
