"""Quality classifier from compressed sizes.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text that the good one helps
more to compress is likelier good: the difference of its two compressed sizes over its own size goes through a
logistic calibration that is fitted on labelled texts kept out of the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import settle, settle_small
from tickloom.llm.tokens import beside, slices

#: Bounds of the labelled sample that the driver gathers: texts of each class, and bytes of a text.
PER_CLASS, TEXT_BYTES = 2000, 32_768
#: Small enough that a few hundred labelled texts of a class fill it: dictionaries of unequal size would skew the difference.
DICT_BYTES, CHUNK, LEVEL = 32_768, 2048, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class Sizer:
    """Compressed sizes of a text in chunks, so that the dictionary counts all along it."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(data: bytes):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def difference(self, text: bytes) -> float:
        """(bad - good) of the compressed sizes over the text's; 0 of an empty text."""
        g = b = 0
        for i in range(0, len(text), CHUNK):
            part = text[i : i + CHUNK]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return (b - g) / len(text) if text else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method, with a small ridge so that classes that separate stay finite."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(good: list[bytes], bad: list[bytes]) -> Model | None:
    """Every second text trains the dictionaries, the others the calibration. None if a class has under 8 texts."""
    import zstandard

    if min(len(good), len(bad)) < 8:
        return None
    cut = lambda texts: [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    train = lambda texts: zstandard.train_dictionary(DICT_BYTES, cut(texts)).as_bytes()
    try:
        made = train(good[::2]), train(bad[::2])
    except zstandard.ZstdError:  # too little text for a dictionary: the text itself serves as one
        made = tuple(b"\n".join(t)[:DICT_BYTES] or b"\n" for t in (good[::2], bad[::2]))
    sizer = Sizer(*made)
    x = np.asarray([[sizer.difference(t)] for t in good[1::2] + bad[1::2]])
    y = np.asarray([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    return Model(*made, tuple(logistic(x, y)))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model | None, float]:
    """Fit on at most ``PER_CLASS`` labelled texts of each class whose crc32(id) mod 5 is not 0, the first by a
    hash of the id, then of the text where an id has several; texts over ``TEXT_BYTES`` stay out of the sample. Also the
    share of good among the labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("__q")).distinct()
    part = lambda q: known.where(F.col("__q") == q).orderBy(F.xxhash64("__id"), "__id").limit(PER_CLASS)
    text = docs.where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).between(1, TEXT_BYTES)).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # at most 2 * PER_CLASS ids, but an id may have many rows: equal ones become one before they meet on the driver
    found = settle(text.join(F.broadcast(part(1).unionByName(part(0))), "__id").select("__id", "__q", "__text").distinct(), "labelled-texts")
    first = lambda q: found.where(F.col("__q") == q).orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text"), "__text").limit(PER_CLASS)
    rows = sorted((r[0], r[1], r[2]) for q in (1, 0) for r in first(q).collect())
    counts = {r["__q"]: r["count"] for r in known.groupBy("__q").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return fit_texts([r[2].encode() for r in rows if r[1] == 1], [r[2].encode() for r in rows if r[1] == 0]), prior


_SIZERS: dict[tuple[bytes, bytes], Sizer] = {}


def _score(model: Model | None, prior: float, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model and (model.good, model.bad) not in _SIZERS:
            _SIZERS.clear()
            _SIZERS[model.good, model.bad] = Sizer(model.good, model.bad)
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1)):
                if model:
                    sizer = _SIZERS[model.good, model.bad]
                    x = np.asarray([sizer.difference(t.encode()) for t in texts])
                    score = 1 / (1 + np.exp(-np.clip(x * model.weights[0] + model.weights[1], -30, 30)))
                else:
                    score = np.full(len(texts), prior)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in b.columns[:n_kept]), pa.array(score)], [*b.schema.names[:n_kept], "score"])

    return run


def classify(docs: DataFrame, model: Model | None, prior: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``carry`` columns (all by default) with ``held_out``, ``score`` and ``predicted``; columns so named, in whatever case, are replaced.

    Null is the empty text; an empty text's score is the calibration's at no difference. Without a
    model (a class with too few labels) every score is ``prior``. Rows that repeat score alike; an empty
    table gives an empty result."""
    carry = beside(docs.columns if carry is None else carry, "held_out", "score", "predicted", "__text")
    carried = next((c for c in carry if c.lower() == text_col.lower()), None)
    rows = docs.select(*(c for c in carry if c != carried), F.col(text_col).alias("__text"))
    kept = rows.schema[: len(carry)]  # a text that is carried goes to the workers and back once
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"])
    out = settle_small(rows.mapInArrow(_score(model, prior, len(carry)), schema), "scores")
    out = out.select(*(F.col("__text").alias(c) if c == carried else c for c in carry), "score").withColumn("held_out", held_out(id_col))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
