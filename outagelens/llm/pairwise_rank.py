"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document labelled 1 is preferred to one labelled 0. The log-odds of a
preference are the difference of two scores, a score is linear in the features
of the text, so the model is a logistic regression without intercept on feature
differences. The weights are fitted to a bounded sample; the threshold and the
scale are quantiles of the scores of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ._common import ddl, quoted, stored, sums, text_slices, texts_of, word_codes, word_hashes
from .ngram_lm import duplicate_lines, repeated_words

MAX_LABELLED = 20_000   # rows the model is fitted to, at most (those with the smallest hash of the id)
MAX_PAIRS = 60_000      # preference pairs drawn from them
CUT = 0.3               # score at the threshold
SLICE = 2 << 20         # bytes of text whose features a task computes at once: some 60 bytes of arrays a byte
ROWS = 2000             # rows whose scores a task computes at once

_CLASSES = 8
_CLASS = np.full(256, 7, np.int64)           # bytes of other alphabets
_CLASS[:128] = 5                             # symbols and control characters
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 6
_CLASS[48:58] = 2
_CLASS[97:123] = 1
_CLASS[65:91] = 0
N_FEATURES = 2 * (_CLASSES * _CLASSES + 14)


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text (an empty text: zeros): shares of pairs of neighbouring character classes,
    word, line and repetition statistics, and the square roots of all of them."""
    starts, codes, words = word_codes(texts)
    rows = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + rows + 1] if rows else np.zeros(1, np.int64)
    data = texts.buffers()[2] if rows else None
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    size = np.maximum(np.diff(ends), 1)
    text = np.repeat(np.arange(rows), np.diff(ends))
    kind = _CLASS[raw]
    pairs = np.zeros((rows, _CLASSES * _CLASSES))
    if len(raw) > 1:
        same = text[1:] == text[:-1]
        code = text[:-1][same] * (_CLASSES * _CLASSES) + kind[:-1][same] * _CLASSES + kind[1:][same]
        pairs = np.bincount(code, minlength=rows * _CLASSES * _CLASSES).reshape(rows, -1) / size[:, None]
    n = np.diff(starts)
    per_word = np.maximum(n, 1)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else np.zeros(0)
    upper = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else length
    alpha = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else length
    owner = np.repeat(np.arange(rows), n)
    distinct, times = np.unique(owner * np.int64(max(len(words), 1)) + codes, return_counts=True)
    of = distinct // max(len(words), 1)
    most = np.zeros(rows)
    np.maximum.at(most, of, times)
    lines = np.bincount(text[raw == 10], minlength=rows) + 1.0
    shares = np.bincount(text * 256 + raw, minlength=rows * 256).reshape(rows, 256) / size[:, None] if rows else np.zeros((0, 256))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(shares > 0, shares * np.log(np.maximum(shares, 1e-12)), 0).sum(axis=1)
    word = lambda x: sums(x[codes], starts) / per_word
    own = np.column_stack([
        np.log1p(n) / 10, np.log1p(size) / 10, word(length) / 10, word((length > 12) * 1.0), word((length < 3) * 1.0), word(upper),
        word(alpha), np.bincount(of, minlength=rows) / per_word, most / per_word, np.log1p(lines) / 10, n / lines / 100,
        duplicate_lines(texts) / lines, repeated_words(codes, starts, word_hashes(words)) / per_word, entropy / 5])
    out = np.concatenate([pairs, own * (n > 0)[:, None]], axis=1)
    return np.concatenate([out, np.sqrt(np.maximum(out, 0))], axis=1)


@dataclass(frozen=True)
class Ranking:
    """Scores are ``(features - middle) / scale @ weights``; ``threshold`` is the score at ``CUT``."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    gap: float  # median distance of the scores over the threshold from it

    def margin(self, x: np.ndarray) -> np.ndarray:
        parts = [((x[low:low + ROWS] - self.middle) / self.scale * self.weights).sum(axis=1) for low in range(0, len(x), ROWS)]
        return np.concatenate([np.zeros(0), *parts])  # a row has the same sum in every batch

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, ``CUT`` at the threshold."""
        z = np.clip((self.margin(x) - self.threshold) / self.gap, -30, 30)
        return 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)


def fit_ranking(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> Ranking:
    """Bradley-Terry weights by Newton steps on the logistic loss of pair differences.

    Every row labelled 0 is paired with rows labelled 1 drawn by a fixed seed.
    ``with_threshold`` sets the threshold and the scale of the scores.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    middle = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(width)
    if not len(good) or not len(bad):  # no preferences: every score is the same, nothing is rejected
        return Ranking(middle, scale, np.zeros(width), -1.0, 1.0)
    each = max(1, MAX_PAIRS // len(bad))
    draw = np.random.default_rng(7).integers(len(good), size=(len(bad), each))
    z = np.clip((x - middle) / scale, -10, 10)
    d = (z[good[draw]] - z[bad][:, None, :]).reshape(-1, width)
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the wrong order
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / len(d) + ridge * np.eye(width), d.T @ p / len(d) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(middle, scale, w, -1.0, 1.0)


def _add_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column, the text, is replaced by its features as the last."""
    for batch in text_slices(batches, SLICE):
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            x = features(texts_of(pa.concat_arrays([part.column(0)]))).astype(np.float32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], values], names=[*part.schema.names[1:], "_r_x"])


def with_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and ``_r_x``, the features of the text (array<float>)."""
    keep = ["doc_id"] if keep is None else keep
    kinds = ddl(docs, keep)
    return docs.select(F.col(text_col).alias("_r_text"), *quoted(keep)).mapInArrow(_add_features, kinds + "_r_x array<float>")


def fit_on_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                  max_labelled: int = MAX_LABELLED) -> tuple[Ranking, float]:
    """Fit to rows with features that have a label, and the share of all these rows that is labelled 0;
    labels that are null or neither 0 nor 1 are left out.

    An id with several labels counts with the smallest. The fit uses at most
    ``max_labelled`` rows, those with the smallest hashes of the id.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_r_id")).agg(F.min(label_col).cast("int").alias("_r_y")))
    labelled = rows.join(known, rows[id_col] == known["_r_id"])
    share = labelled.agg(F.avg(F.expr("if(_r_y = 0, 1D, 0D)"))).first()[0] or 0.0
    sample = (labelled.select("_r_id", "_r_y", "_r_x", F.xxhash64("_r_id").alias("h"))
              .orderBy("h", "_r_id").limit(max_labelled).drop("h").toArrow())
    y = sample.column("_r_y").to_numpy()
    x = sample.column("_r_x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
    return fit_ranking(x, y), share


def with_threshold(model: Ranking, rows: DataFrame, share: float) -> Ranking:
    """The threshold that the share ``share`` of the scores of all rows is under (exact), and the distance from it to
    the median of the others as the scale. Without preferences nothing is rejected."""
    if not model.weights.any():
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(model.margin(x.astype(np.float64)))], names=["margin"])

    probs = [share, (1 + share) / 2]
    got = {r["p"]: r["q"] for r in exact_quantiles(rows.select("_r_x").mapInArrow(run, "margin double"), "margin", probs).collect()}  # two rows
    if not got:
        return model
    return replace(model, threshold=got[probs[0]], gap=max(got[probs[1]] - got[probs[0]], 1e-6))


def training_rows(id_col: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def rank_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None, name: str = "ranking") -> DataFrame:
    """The columns ``keep`` (default the id) and ``_r_held_out``, ``_r_score``, ``_r_predicted`` for every document.

    The model is fitted to labelled rows that are not held out, and as large a
    share of all documents is rejected as is labelled 0 among them. Nothing but
    the text enters a score. Null and empty texts have the features 0 and are
    scored; a null id is not labelled and counts as not held out; repeated rows
    are scored alike; other columns do not matter; an empty table gives an empty result;
    without labels of both kinds all scores are equal and above the threshold.
    """
    keep = [id_col] if keep is None else keep
    rows = stored(with_features(docs, text_col, keep), f"{name}-features")
    model, share = fit_on_labels(rows.where(training_rows(id_col)), labels, id_col)
    model = with_threshold(model, rows, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            s = model.score(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                             names=[*batch.schema.names[:-1], "_r_score", "_r_predicted"])

    kinds = ddl(docs, keep)
    scored = rows.mapInArrow(run, kinds + "_r_score double, _r_predicted int")
    return scored.withColumn("_r_held_out", F.coalesce(~training_rows(id_col), F.lit(False)))
