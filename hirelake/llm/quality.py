"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is compressed
in blocks of ``BLOCK`` bytes under either dictionary, over its whole length (in blocks, so that a long
text's own history does not replace the dictionary). The difference of the two compressed sizes over the smaller of
them, with the compression ratio beside it (text that only repeats itself compresses well under any dictionary), goes
through a logistic calibration to a score between 0 and 1.

Training rows are bounded: at most about ``max_rows`` labelled rows of each class, chosen by the hash of their
ids, whole texts. Half of them (by hash) make the dictionaries, the other half the calibration.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import documents, small_batches

BLOCK = 512
LEVEL = 3
DICT_BYTES = 112_640


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


def _blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def train_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(size, [b for t in texts for b in _blocks(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b"\n"


def features(text: bytes, good: bytes, bad: bytes) -> tuple[float, float]:
    """(normalised size difference, compression ratio); (0, 1) of an empty text."""
    if not text:
        return 0.0, 1.0
    by_good, by_bad = _compressor(good), _compressor(bad)
    pieces = _blocks(text)
    a = sum(len(by_good.compress(p)) for p in pieces)
    b = sum(len(by_bad.compress(p)) for p in pieces)
    return (b - a) / max(1, min(a, b)), min(a, b) / len(text)


def _design(x: np.ndarray) -> np.ndarray:
    d, ratio = x[:, 0], np.minimum(x[:, 1], 1.0)
    return np.column_stack([np.ones(len(x)), np.clip(d, -2, 2), ratio, np.maximum(0, 0.15 - ratio) * 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Ridge logistic regression by Newton's method."""
    a, w = _design(x), np.zeros(4)
    keep = ridge * np.diag([0, 1, 1, 1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep + 1e-9 * np.eye(4), a.T @ (p - y) + keep @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


class Model:
    """Two dictionaries and the calibration; without both classes in the sample, a constant score."""

    def __init__(self, rows: list[tuple[bytes, int, int]]):
        """rows: (text, label, half)."""
        labels = {y for _, y, _ in rows}
        self.constant = None if labels == {0, 1} else float(max(labels, default=0.5))
        if self.constant is not None:
            return
        part = lambda y, half: [t for t, label, h in rows if label == y and h == half] or [t for t, label, _ in rows if label == y]
        self.good, self.bad = train_dictionary(part(1, 0)), train_dictionary(part(0, 0))
        fit = [(t, y) for y in (0, 1) for t in part(y, 1)]
        x = np.array([features(t, self.good, self.bad) for t, _ in fit])
        self.weights = fit_logistic(x, np.array([y for _, y in fit], float))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = [features((t or "").encode("utf-8", "surrogatepass"), self.good, self.bad) for t in texts]
        z = _design(np.array(x, float).reshape(-1, 2)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _remainder(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = 5, max_rows: int = 2_000) -> Model:
    """Fits on labelled rows whose crc32(id) mod ``folds`` is not 0, about ``max_rows`` of each class.

    Rows of labels with a null id or label, or without a document, teach nothing; repeated equal labels of an id count once, of repeated
    documents of an id one (the least text), so the sample is bounded whatever the table holds.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (_remainder(F.col("id"), folds) != 0)))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col("y") == 1, max_rows / max(1, counts.get(1, 0))).otherwise(max_rows / max(1, counts.get(0, 0)))
    chosen = known.where(draw < share)  # about 2 * max_rows rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))
    rows = texts.select("id", "text", "y", half.cast("int").alias("half")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"] or ""))
    return Model([((r["text"] or "").encode("utf-8", "surrogatepass"), r["y"], r["half"]) for r in rows])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of every whole text (null: as the empty text) as column ``to``; a column of that name gives way. Nothing but the text
    goes in."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    return docs.withColumn(to, of(F.col(text_col)))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    from hirelake.llm.common import free_name
    score = free_name(docs, "_score")
    return with_score(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)


def op3(spark, sf_dir: str) -> DataFrame:
    """Query: score of every document by a model of the labels outside the held-out fold."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality"))
    out = with_score(docs, model)
    return out.select("doc_id", F.coalesce(_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))
