"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts every word from the two words on either side: each neighbour adds the row of its
class in that position's table, one softmax over the sum gives the chances of ``GROUPS`` groups of classes
and another those of the classes within the word's group. A document's score is the sum of the conditional
log-probabilities of all its words.

Classes come from counts of all words of the corpus: the most frequent words have one each, others
share one by their shape. A word that shares its class has the chance of the class times its share of the
class's words in the corpus, so the vocabulary is the corpus's and every word has a chance of its own; the
chances of all its words add up to one. Counts of the ``HEAD`` most frequent words go out with the code that
looks classes up; the others are joined.

Training is data-parallel in numpy over every position of every document. A hash of each row deals documents
to ``ROUNDS`` rounds and, within a round, to parts whose number follows from the corpus's words alone. A
part starts from the shared weights and passes over its documents in the order of their hashes; the parts'
weights are averaged, weighted by positions, in a tree. So the weights do not depend on files or partitions,
and what is gathered (counts, codes, the parts' weights) grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.store import settle
from tickloom.llm.tokens import beside, slices

GROUPS, MEMBERS = 32, 64
CLASSES, SHARED = GROUPS * MEMBERS, 255
PAD = CLASSES
AROUND = (-2, -1, 1, 2)
WIDTH, BATCH, RATE, FIRST_SQUARE = 16, 16384, 0.3, 0.1
#: Rounds of training, words of a part, and the most parts of a round: beyond them parts grow.
ROUNDS, PART_WORDS, MOST_PARTS = 8, 1 << 20, 2048
#: How many vectors of weights one task averages.
FAN_IN = 16
HEAD = 1 << 16
BLANK = "[\\x20\\x09-\\x0D]+"
SHAPES = ((len(AROUND) * (PAD + 1), WIDTH), (WIDTH, GROUPS), (GROUPS,), (GROUPS, WIDTH, MEMBERS), (GROUPS, MEMBERS))
SIZES = tuple(int(np.prod(s)) for s in SHAPES)
_SHIFT = (np.arange(len(AROUND)) * (PAD + 1)).astype("uint16")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts, lower-cased and cut at ASCII white space; a null or empty text has no words, an empty
    table gives no rows."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), BLANK)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def shape_class(word: str) -> int:
    """The shared class of a rare word, by its last two characters and whether it has symbols."""
    tail = zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % (SHARED // 3)
    kind = 0 if word.isalpha() else 1 if any(c.isalpha() for c in word) else 2
    return CLASSES - SHARED + kind * (SHARED // 3) + tail


def unpack(weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tables of the neighbours, groups' output and bias, members' output and bias."""
    return tuple(x.reshape(s) for x, s in zip(np.split(weights, np.cumsum(SIZES)[:-1]), SHAPES))


def start_weights(sizes: np.ndarray | None = None, seed: int = 5) -> np.ndarray:
    """Small random weights; biases are those of the classes' ``sizes`` in the corpus."""
    flat = (np.random.default_rng(seed).standard_normal(sum(SIZES)) * 0.1).astype("float32")
    share = (np.zeros(CLASSES) if sizes is None else sizes) + 0.5
    share = (share / share.sum()).reshape(GROUPS, MEMBERS)
    _, _, head_bias, _, tail_bias = unpack(flat)
    head_bias[:] = np.log(share.sum(axis=1))
    tail_bias[:] = np.log(share / share.sum(axis=1, keepdims=True))
    return flat


def positions(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the tables around each position of the texts (beyond their ends is PAD), and its class."""
    gap = np.asarray([PAD, PAD], "uint16")
    parts = [gap]
    for t in texts:
        parts += [t, gap]
    stream = np.concatenate(parts)
    at = np.flatnonzero(stream != PAD)
    around = np.empty((len(at), len(AROUND)), "uint16")
    for k, o in enumerate(AROUND):
        around[:, k] = stream[at + o]
    around += _SHIFT
    return around, stream[at]


def exponentials(logits: np.ndarray) -> tuple[np.ndarray | float, np.ndarray]:
    """Replaces ``logits`` by their exponentials, less their rows' maxima if some are too large; those maxima and the rows' sums."""
    top = 0.0
    if max(logits.max(), -logits.min()) > 60:
        top = logits.max(axis=1, keepdims=True)
        logits -= top
        top = top[:, 0]
    np.exp(logits, out=logits)
    return top, logits @ np.ones(logits.shape[1], logits.dtype)


def _hidden(tables: np.ndarray, around: np.ndarray) -> np.ndarray:
    out = np.take(tables, around[:, 0], axis=0)
    for k in range(1, len(AROUND)):
        out += np.take(tables, around[:, k], axis=0)
    return out


def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and (group, first, end) of each group's run in it."""
    group = (target // MEMBERS).astype("uint8")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return np.argsort(group, kind="stable"), [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if b > a]


def log_chances(weights: tuple, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of each target class's chance."""
    tables, head, head_bias, tail, tail_bias = weights
    order, runs = _by_group(target)
    hidden, member = _hidden(tables, around[order]), target[order] % MEMBERS
    logits = hidden @ head
    logits += head_bias
    found = logits[np.arange(len(target)), target[order] // MEMBERS]
    top, sums = exponentials(logits)
    found = found - top - np.log(sums)
    for g, a, b in runs:
        logits = hidden[a:b] @ tail[g]
        logits += tail_bias[g]
        own = logits[np.arange(b - a), member[a:b]]
        top, sums = exponentials(logits)
        found[a:b] += own - top - np.log(sums)
    out = np.empty_like(found)
    out[order] = found
    return out


def _slope(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gradient of a softmax's loss, in place."""
    logits *= (1 / exponentials(logits)[1])[:, None]
    logits[np.arange(len(at)), at] -= 1
    return logits


def _descend(weight: np.ndarray, square: np.ndarray, slope: np.ndarray) -> None:
    """AdaGrad in place."""
    square += slope * slope
    slope *= RATE
    slope /= np.sqrt(square)
    weight -= slope


def train_step(weights: tuple, squares: tuple, around: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step in place, by the sum of the positions' losses; of the tables, only rows that occur move."""
    tables, head, head_bias, tail, tail_bias = weights
    order, runs = _by_group(target)
    around, target = around[order], target[order]
    hidden, member = _hidden(tables, around), target % MEMBERS
    p = hidden @ head
    p += head_bias
    p = _slope(p, target // MEMBERS)
    to_hidden = p @ head.T
    for g, a, b in runs:
        q = hidden[a:b] @ tail[g]
        q += tail_bias[g]
        q = _slope(q, member[a:b])
        to_hidden[a:b] += q @ tail[g].T
        _descend(tail[g], squares[3][g], hidden[a:b].T @ q)
        _descend(tail_bias[g], squares[4][g], np.ones(b - a, q.dtype) @ q)
    _descend(head, squares[1], hidden.T @ p)
    _descend(head_bias, squares[2], np.ones(len(p), p.dtype) @ p)
    flat = around.T.ravel()
    order = np.argsort(flat, kind="stable")
    found = flat[order]
    begins = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    rows = found[begins]
    slope = np.add.reduceat(np.take(to_hidden, order % len(target), axis=0), begins, axis=0)
    square = squares[0][rows] + slope * slope
    squares[0][rows] = square
    tables[rows] -= RATE * slope / np.sqrt(square)


class RareClasses(dict):
    """Classes of rare words, spelled in UTF-8; found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = shape_class(word.decode())
        return found


def _code(ranks: dict[bytes, int], logs: np.ndarray):
    """The last column, a lower-cased text, becomes the sum of the known logarithms of its words, the words without one and the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, values = np.arange(len(ranks)), np.append(logs, 0.0)
        for word, rank in ranks.items():
            if rank >= CLASSES - SHARED:
                classes[rank] = shape_class(word.decode())
        classes, rare = np.append(classes, 0).astype("<u2"), RareClasses()
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1).cast(pa.binary()), empty=b""):
                if len(rare) > 500_000:
                    rare = RareClasses()
                words = [t.split() for t in texts]
                ends = np.cumsum([0, *map(len, words)])
                flat = list(chain.from_iterable(words))
                found = np.fromiter(map(ranks.get, flat, repeat(-1)), "int64", len(flat))
                codes = classes[found]
                missing = np.flatnonzero(found < 0)
                odd = [flat[i] for i in missing.tolist()]
                codes[missing] = np.fromiter(map(rare.__getitem__, odd), "<u2", len(odd))
                upto = np.concatenate([[0.0], np.cumsum(values[found])])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, ends), pa.int32()), pa.array(odd, pa.binary()).cast(pa.string()))
                raw = codes.tobytes()
                parts = pa.array([raw[2 * x : 2 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in b.columns[:-1]), pa.array(upto[ends[1:]] - upto[ends[:-1]]), lists, parts], [*b.schema.names[:-1], "__logs", "__rare", "codes"])

    return run


def _train(start: bytes):
    """Rows (part, codes), those of a part together and in order -> (part, n, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.frombuffer(start, "float32")
        part, flat, weights, squares, seen, held, waiting = None, None, None, None, 0, 0, []

        def learn() -> None:
            around, target = positions(waiting)
            order = np.random.default_rng(seen).permutation(len(target))
            around, target = around[order], target[order]
            for i in range(0, len(target), BATCH):
                train_step(weights, squares, around[i : i + BATCH], target[i : i + BATCH])

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                learn()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "weights"])

        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if at != part:
                    yield from close()
                    part, flat, seen, held, waiting = at, shared.copy(), 0, 0, []
                    weights, squares = unpack(flat), tuple(np.full(s, FIRST_SQUARE, "float32") for s in SHAPES)
                codes = np.frombuffer(raw.as_py(), "<u2")
                waiting.append(codes)
                held, seen = held + len(codes), seen + len(codes)
                if held >= 32 * BATCH:
                    learn()
                    waiting, held = [], 0
        yield from close()

    return run


def _average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted by positions, added up in the order of the parts; the key is the average's place among its like."""
    pdf = pdf.sort_values("part")
    total, n = np.zeros(sum(SIZES)), int(pdf["n"].sum())
    for k, w in zip(pdf["n"], pdf["weights"]):
        total += k * np.frombuffer(w, "float32")
    return pd.DataFrame({"part": [key[0]], "n": [n], "weights": [(total / n).astype("float32").tobytes()]})


def train_rounds(coded: DataFrame, words: int, sizes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """After each round that trains any, the weights and how many positions it trained. ``words`` of the corpus set the parts."""
    weights = start_weights(sizes)
    parts = max(1, min(MOST_PARTS, -(-words // (ROUNDS * PART_WORDS))))
    dealt = coded.where(F.length("codes") > 0).select(F.pmod("__deal", F.lit(ROUNDS)).alias("round"), F.pmod(F.floor(F.col("__deal") / ROUNDS), F.lit(parts)).cast("bigint").alias("part"), "__deal", "codes")
    for k in range(ROUNDS):
        rows = dealt.where(F.col("round") == k).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "__deal", "codes")
        found, left = rows.select("part", "codes").mapInArrow(_train(weights.tobytes()), "part bigint, n bigint, weights binary"), parts
        while left > 1:
            found = found.groupBy(F.floor(F.col("part") / FAN_IN).alias("__to")).applyInPandas(_average, "part bigint, n bigint, weights binary")
            left = -(-left // FAN_IN)
        for row in found.collect():  # one at most
            weights = np.frombuffer(bytes(row["weights"]), "float32")
            yield weights, row["n"]


def train(coded: DataFrame, words: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Weights trained over ``codes`` of all rows, dealt by ``__deal``, for a corpus of so many ``words``; those of the
    start if there are none."""
    weights = start_weights(sizes)
    for weights, _ in train_rounds(coded, words, sizes):
        pass
    return weights


def _count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(CLASSES, "int64")
    for b in batches:
        for codes in b.column(0):
            found += np.bincount(np.frombuffer(codes.as_py(), "<u2"), minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(found)], ["code", "n"])


def class_sizes(coded: DataFrame) -> np.ndarray:
    """How many words of the corpus each class has."""
    out = np.zeros(CLASSES)
    for r in coded.select("codes").mapInArrow(_count_codes, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out


def shared_logs(sizes: np.ndarray) -> np.ndarray:
    """Of every class that words share, the logarithm of its size; 0 of others."""
    out = np.zeros(CLASSES)
    out[CLASSES - SHARED :] = np.log(np.maximum(sizes[CLASSES - SHARED :], 1))
    return out


def _score(flat: bytes, shared: np.ndarray | None = None):
    """Sums over the ``codes`` of the last column; with ``shared``, less these logarithms of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = unpack(np.frombuffer(flat, "float32"))
        for b in batches:
            codes = [np.frombuffer(c.as_py(), "<u2") for c in b.column(b.num_columns - 1)]
            counts = [len(c) for c in codes]
            sums, at = [], 0
            while at < len(codes):  # texts together, about 64k words at a time
                upto, held = at, 0
                while upto < len(codes) and (held == 0 or held + counts[upto] <= 1 << 16):
                    held += counts[upto]
                    upto += 1
                if held:
                    around, target = positions(codes[at:upto])
                    parts = np.concatenate([log_chances(weights, around[i : i + BATCH], target[i : i + BATCH]) for i in range(0, held, BATCH)]).astype("float64")
                    if shared is not None:
                        parts -= shared[target]
                    ends = np.cumsum([0, *counts[at:upto]])
                    upto_sum = np.concatenate([[0.0], np.cumsum(parts)])
                    sums += (upto_sum[ends[1:]] - upto_sum[ends[:-1]]).tolist()
                else:
                    sums += [0.0] * (upto - at)
                at = upto
            made = [pa.array(counts, pa.int64()), pa.array(sums, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "n_words", "log_likelihood"])

    return run


def encode_words(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Two tables, written once as several passes read them: rows of ``carry`` columns and ``codes``, two bytes for
    each word's class, with the parts of their words' logarithms and the hash that deals them; and (word, n) of the
    corpus. A null or empty text has no codes; rows that repeat pass through."""
    counts = settle(word_counts(docs, text_col), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    ranks = {r["word"].encode(): i for i, r in enumerate(top)}
    logs = np.asarray([0.0 if i < CLASSES - SHARED else np.log(r["n"]) for i, r in enumerate(top)])
    plain = [F.col(c) for c in carry if isinstance(docs.schema[c].dataType, T.AtomicType) and not isinstance(docs.schema[c].dataType, T.VariantType)]
    rows = docs.select(*carry, F.xxhash64(*plain, F.coalesce(F.col(text_col), F.lit(""))).alias("__deal"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["__logs double, __rare array<string>, codes binary"])
    coded = rows.mapInArrow(_code(ranks, logs), schema).select(F.monotonically_increasing_id().alias("__row"), "*")
    return settle(coded, "word-classes"), counts


def lm_scores(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``n_words``, ``log_likelihood`` (natural logarithms, summed) and ``mean_log_likelihood``.

    A null or empty text has no words, a sum of 0 and a null mean. Rows that repeat score alike; an empty
    table gives an empty result; of clashing names, in whatever case, the columns made here win."""
    carry = tuple(beside(carry, "codes", "n_words", "log_likelihood", "mean_log_likelihood"))
    coded, counts = encode_words(docs, text_col, carry)
    rare = coded.select(F.col("__row").alias("__r"), F.explode("__rare").alias("word")).join(counts, "word")
    rare = rare.groupBy("__r").agg(F.sum(F.ln("n")).alias("__rare_logs"))
    sizes = class_sizes(coded)
    weights = train(coded, int(sizes.sum()), sizes)
    rows = coded.drop("__rare", "__deal")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["n_words bigint", "log_likelihood double"])
    scored = rows.mapInArrow(_score(weights.tobytes(), shared_logs(sizes)), schema).join(rare, F.col("__row") == F.col("__r"), "left")
    scored = scored.withColumn("log_likelihood", F.col("log_likelihood") + F.col("__logs") + F.coalesce("__rare_logs", F.lit(0.0)))
    return scored.select(*carry, "n_words", "log_likelihood", F.try_divide("log_likelihood", "n_words").alias("mean_log_likelihood"))
