"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: words, runs of up to five character classes (upper, lower, digit, each punctuation
mark, white space), and runs of repeated words. Each is scaled by its class log-count ratio, rows are scaled to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. Its margins, on rows kept out of that fit,
give the logistic curve that makes scores probabilities.

The fit sees at most ``max_rows`` labelled rows, the first in a hash order of their ids; it runs in one task that this
bounds. Ids pick the rows; nothing but text goes into a score. Scoring is one pass without a shuffle.

Defined results: null text is empty, and an empty text gets the score of a row without features; labels that are null or
not 0 or 1 are left out, of repeated labels the larger counts, of
repeated ids the least text; without labels of both classes all scores are the share of
label 1 (0.5 without labels); repeated rows score alike; other columns play no part, and where one kept is named like one
added, the added one gets underscores after its name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskframe.llm._shared import fresh, known_columns
from riskframe.llm.shingles import LOWER, span_hashes, utf8

BITS = 18
SHAPES, REPEATS = 5, 3
#: Bytes, and words, of a text worked on at a time.
TEXT_PIECE, WORD_PIECE = 1 << 20, 1 << 16
MAX_ROWS = 16_000
FOLDS = 5

_marks = string.punctuation + string.digits[:1] + "Aa \n"
_code = {c: k + 1 for k, c in enumerate(_marks)}
#: Byte to character class.
CLASS = np.array(
    [
        _code["A"] if chr(b) in string.ascii_uppercase
        else _code["0"] if chr(b) in string.digits
        else _code["\n"] if chr(b) in "\n\r"
        else _code[" "] if b <= 0x20 or b == 0x7F
        else _code.get(chr(b), _code["a"])
        for b in range(256)
    ],
    np.uint32,
)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Ascending numbers of the features that the text has. seen: 2**BITS false flags, given back as they were.

    Long texts are worked on in pieces that overlap, so that no n-gram is lost between them.
    """
    tail = np.empty(0, np.uint32)
    for at in range(0, len(text), TEXT_PIECE):
        kinds = np.concatenate((tail, CLASS[np.frombuffer(text, np.uint8)[at : at + TEXT_PIECE]]))
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
        gram = kinds
        for n in range(1, min(SHAPES, len(kinds)) + 1):
            seen[((gram + np.uint32(n * 0x85EBCA6B % (1 << 32))) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
            gram = gram[:-1] * np.uint32(41) + kinds[n:]
        tail = kinds[-SHAPES:]
    words = text.translate(LOWER).split()
    for at in range(0, len(words), WORD_PIECE):
        piece = words[at : at + WORD_PIECE + REPEATS]
        hashes = span_hashes(piece, 1)
        seen[hashes >> np.uint64(64 - BITS)] = True
        again = hashes[1:] == hashes[:-1]
        for n in range(1, REPEATS + 1):
            if not again.any():
                break
            seen[n] = True
            again = again[1:] & again[:-1]
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled rows that are not held out."""
    known = labels.filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("y")).filter(~is_held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITS, bool)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            found = [features(utf8(t), seen).astype(np.int32).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "x"])


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smooth)
    for x, label in zip(rows, y):
        counts[label, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and offset of the L2-regularised hinge loss: one dual variable at a time, boxed to [0, cost], in random order."""
    rng = np.random.default_rng(seed)
    sign = 2.0 * y - 1
    w, b = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(y))
    curve = np.array([v @ v + 1 for v in values])
    top = cost * len(y) / 2 / np.maximum(1, np.bincount(y, minlength=2))[y]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / curve[i], 0.0), top[i])
            if step := (new - alpha[i]) * sign[i]:
                w[x] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def margin(x: np.ndarray, ratio: np.ndarray, weights: np.ndarray, offset: float) -> float:
    """weights are already scaled by ratio; the row is scaled to unit length."""
    r = ratio[x]
    return float(weights[x].sum() / np.sqrt(max(r @ r, 1e-12)) + offset)


def _fit(smooth: float, cost: float, epochs: int, seed: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = pdf["y"].to_numpy(np.int64)
        rows = [np.frombuffer(x, np.int32) for x in pdf["x"]]
        if len(set(y.tolist())) < 2:
            share = (y.sum() + 1e-6) / (len(y) + 2e-6)
            model = [np.zeros(1 << BITS), np.zeros(1 << BITS), np.array([0.0, 0.0, np.log(share / (1 - share))])]
        else:
            # Every fifth row of each class makes the curve; the others make the model.
            kept = np.zeros(len(y), bool)
            for label in (0, 1):
                kept[np.flatnonzero(y == label)[4::5]] = True
            own = np.flatnonzero(~kept)
            ratio = log_count_ratio([rows[i] for i in own], y[own], smooth)
            values = [ratio[rows[i]] for i in own]
            values = [v / np.sqrt(max(v @ v, 1e-12)) for v in values]
            w, b = dual_descent([rows[i] for i in own], values, y[own], cost, epochs, seed)
            w *= ratio
            test = np.flatnonzero(kept) if kept.any() else own
            slope, shift = logistic_curve(np.array([margin(rows[i], ratio, w, b) for i in test]), y[test])
            model = [ratio, w, np.array([b, slope, shift])]
        return pd.DataFrame({"part": ["ratio", "weights", "curve"], "v": [m.astype(np.float64).tobytes() for m in model]})

    return fit


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, smooth: float = 1.0, cost: float = 1.0, epochs: int = 30, seed: int = 1) -> dict[str, np.ndarray]:
    """The model, from docs (doc_id, text) and labels (doc_id, label): bounded arrays of 2**BITS numbers."""
    rows = training_rows(docs, labels, max_rows).select("doc_id", "text", "y").mapInArrow(_featurise, "doc_id long, y int, x binary")
    made = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_fit(smooth, cost, epochs, seed), "part string, v binary").collect()
    if not made:
        return {"ratio": np.zeros(1 << BITS), "weights": np.zeros(1 << BITS), "curve": np.zeros(3)}
    return {r.part: np.frombuffer(r.v) for r in made}


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        ratio, weights = model.value["ratio"], model.value["weights"]
        offset, slope, shift = model.value["curve"].tolist()
        for batch in batches:
            margins = np.array([margin(features(utf8(t), seen), ratio, weights, offset) for t in batch.column(batch.num_columns - 1)])
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return score


def _scored(df: DataFrame, model: dict[str, np.ndarray], text_col: str, keep: list[str]) -> DataFrame:
    """The keep columns of df as c0, c1, ... and the score of the text."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(sent), StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())]))


def score_quality(df: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The keep columns of df (all by default), each under its name, and the score of the text."""
    keep = df.columns if keep is None else keep
    return _scored(df, model, text_col, keep).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(*fresh(keep, "score")))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """The rows of df that score least or more, columns unchanged whatever their names."""
    model = fit_quality(known_columns(df, doc_id=id_col, text=text_col), known_columns(labels, doc_id=id_col, label=label_col))
    scored = _scored(df, model, text_col, df.columns).filter(F.col("score") >= least)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The keep columns of df with held_out, score and predicted (see above for clashing names), by a model fitted on the labelled rows that aren't held out."""
    docs = known_columns(df, doc_id=id_col, text=text_col)
    model = fit_quality(docs, known_columns(labels, doc_id=id_col, label=label_col))
    keep = df.columns if keep is None else keep
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], is_held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    out = _scored(rows, model, "text", rows.columns[:-1])
    names = fresh(keep, "held_out", "score", "predicted")
    made = F.col(f"c{len(keep)}"), F.col("score"), (F.col("score") >= least).cast("int")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(n) for c, n in zip(made, names)])
