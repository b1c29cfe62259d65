import collections
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, awkward, prose
from tickloom.llm import lm_scoring as lm


def texts_of(coded):
    return [np.frombuffer(r["codes"], "<u2") for r in coded.select("codes").collect()]


def plain_log_chance(weights, around, target):
    """ln P(class) of one position in double precision."""
    tables, head, head_bias, tail, tail_bias = (w.astype("float64") for w in weights)
    hidden = sum(tables[int(r)] for r in around)
    group, member = divmod(int(target), lm.MEMBERS)
    out = 0.0
    for logits, at in ((hidden @ head + head_bias, group), (hidden @ tail[group] + tail_bias[group], member)):
        out += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
    return out


def test_scores_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", lm.CLASSES - lm.SHARED + 40)  # of the words that share a class, some are looked up, others joined
    many = [(200 + k, " ".join(f"w{i}" for i in range(600 * k, 600 * k + 600)), "en") for k in range(4)]
    rows = awkward() + [(100 + i, prose(i, 200), "en") for i in range(40)] + many + [(300, "ΣΑΣ İx w1 zoomon", "tr")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("N_Words", F.lit("clash")).repartition(3)
    coded, table = lm.encode_words(docs, carry=("doc_id",))
    counts = {r["word"]: r["n"] for r in table.collect()}
    texts = {}
    for i, words in docs.select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), lm.BLANK)).collect():
        texts.setdefault(i, []).append([w for w in words if w])
    assert counts == collections.Counter(w for ts in texts.values() for t in ts for w in t)
    own = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: lm.CLASSES - lm.SHARED])}
    of = lambda w: own[w] if w in own else lm.shape_class(w)
    sizes = collections.Counter()
    for w, n in counts.items():
        sizes[of(w)] += n
    found = lm.class_sizes(coded)
    assert {c: n for c, n in enumerate(found) if n} == sizes
    weights = lm.unpack(lm.train(coded, int(found.sum()), found))
    out = lm.lm_scores(docs, carry=("doc_id", "N_Words")).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r[0] for r in rows)
    for r in out:
        wanted = []
        for words in texts[r["doc_id"]]:
            codes = np.asarray([of(w) for w in words], "uint16")
            around, target = lm.positions([codes])
            wanted.append((len(words), sum(plain_log_chance(weights, a, t) + (0 if w in own else math.log(counts[w] / sizes[of(w)])) for a, t, w in zip(around, target, words))))
        assert any(r["n_words"] == n and r["log_likelihood"] == pytest.approx(x, rel=2e-4, abs=1e-3) for n, x in wanted)
        assert (r["mean_log_likelihood"] is None) == (r["n_words"] == 0)
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_chances_of_all_words_add_up_to_one():
    rng = np.random.default_rng(3)
    weights = lm.unpack(lm.start_weights() * 5)
    around = np.tile(lm.positions([rng.integers(0, lm.CLASSES, 9).astype("uint16")])[0][4], (lm.CLASSES, 1))
    chances = np.exp(lm.log_chances(weights, around, np.arange(lm.CLASSES).astype("uint16")).astype("float64"))
    assert chances.sum() == pytest.approx(1, abs=1e-4)
    # and the shares of the words of one class do
    counts = {"common": 3, "zoomon": 7, "salmon": 2}
    assert len({lm.shape_class(w) for w in counts}) == 1
    sizes = np.zeros(lm.CLASSES)
    sizes[lm.shape_class("common")] = sum(counts.values())
    assert sum(math.exp(math.log(n) - lm.shared_logs(sizes)[lm.shape_class(w)]) for w, n in counts.items()) == pytest.approx(1)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_WORDS", 300)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    docs = spark.createDataFrame(awkward() + [(100 + i, prose(i, 150), "en") for i in range(120)], SCHEMA)
    one, seven = ({(r["doc_id"], r["n_words"]): r["mean_log_likelihood"] for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys()
    assert all(one[k] == pytest.approx(seven[k], abs=1e-6) for k in one if one[k] is not None)


def test_every_position_trains_in_one_part_of_one_round(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_WORDS", 200)
    docs = spark.createDataFrame(awkward() + [(100 + i, prose(i, i), "en") for i in range(90)], SCHEMA)
    coded, _ = lm.encode_words(docs)
    total = int(sum(map(len, texts_of(coded))))
    assert total > 3 * lm.ROUNDS * lm.PART_WORDS
    trained = [n for _, n in lm.train_rounds(coded, total)]
    assert len(trained) == lm.ROUNDS and sum(trained) == total
    texts = texts_of(coded)
    around, target = lm.positions(texts)
    wanted = [(*((t[i + o] if 0 <= i + o < len(t) else lm.PAD) + k * (lm.PAD + 1) for k, o in enumerate(lm.AROUND)), t[i]) for t in (x.tolist() for x in texts) for i in range(len(t))]
    assert list(map(tuple, np.column_stack([around, target]).tolist())) == wanted


def test_a_round_against_plain_python(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 16)
    rng = np.random.default_rng(8)
    parts = {0: [rng.integers(0, lm.CLASSES, n).astype("uint16") for n in (7, 0, 12)], 1: [rng.integers(0, 70, n).astype("uint16") for n in (20, 1)]}
    start = lm.start_weights()
    rows = [(p, t.tobytes()) for p, ts in parts.items() for t in ts]
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in x], pa.int64()), pa.array([t for _, t in x], pa.binary())], ["part", "codes"]) for x in (rows[:2], rows[2:])]
    made = pa.Table.from_batches(list(lm._train(start.tobytes())(iter(batches)))).to_pandas()
    assert made["n"].tolist() == [19, 21]
    wanted = np.zeros(len(start))
    for texts in parts.values():
        weights = [w.astype("float64") for w in lm.unpack(start.copy())]
        squares = [np.full(w.shape, lm.FIRST_SQUARE) for w in weights]
        around, target = lm.positions(texts)
        order = np.random.default_rng(len(target)).permutation(len(target))
        for i in range(0, len(target), lm.BATCH):
            slopes = [np.zeros_like(w) for w in weights]
            for j in order[i : i + lm.BATCH]:
                tables, head, head_bias, tail, tail_bias = weights
                hidden = sum(tables[int(r)] for r in around[j])
                g, m = divmod(int(target[j]), lm.MEMBERS)
                p, q = (np.exp(x) / np.exp(x).sum() for x in (hidden @ head + head_bias, hidden @ tail[g] + tail_bias[g]))
                p[g] -= 1
                q[m] -= 1
                back = head @ p + tail[g] @ q
                for r in around[j]:
                    slopes[0][int(r)] += back
                slopes[1] += np.outer(hidden, p)
                slopes[2] += p
                slopes[3][g] += np.outer(hidden, q)
                slopes[4][g] += q
            for w, s, d in zip(weights, squares, slopes):
                s += d * d
                w -= lm.RATE * d / np.sqrt(s)
        wanted += len(target) * np.concatenate([w.ravel() for w in weights])
    average = np.frombuffer(lm._average((0,), made)["weights"][0], "float32")
    assert np.abs(average - wanted / 40).max() < 1e-4


def test_averages_weigh_positions():
    flat = lambda x: np.full(sum(lm.SIZES), x, "float32").tobytes()
    out = lm._average((2,), pd.DataFrame({"part": [33, 32], "n": [1, 3], "weights": [flat(4.0), flat(0.0)]}))
    assert out["part"][0] == 2 and out["n"][0] == 4 and set(np.frombuffer(out["weights"][0], "float32")) == {1.0}


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    codes = (np.cumsum(rng.integers(1, 3, 20000)) % 50).astype("uint16")
    around, target = lm.positions([codes])
    weights = lm.unpack(lm.start_weights(np.bincount(codes, minlength=lm.CLASSES)))
    before = lm.log_chances(weights, around, target).mean()
    squares = tuple(np.full(s, lm.FIRST_SQUARE, "float32") for s in lm.SHAPES)
    for i in range(0, 18000, 256):
        lm.train_step(weights, squares, around[i : i + 256], target[i : i + 256])
    assert lm.log_chances(weights, around[18000:], target[18000:]).mean() > before + 1


def test_very_large_logits_do_not_overflow():
    weights = lm.unpack(lm.start_weights() * 300)
    around, target = lm.positions([np.arange(50, dtype="uint16")])
    out = lm.log_chances(weights, around, target)
    assert np.isfinite(out).all() and out[0] == pytest.approx(plain_log_chance(weights, around[0], target[0]), rel=1e-3)
