import collections
import datetime as dt
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import PARAGRAPH, SCHEMA, awkward, prose
from tickloom.llm import compression_classifier as cc
from tickloom.llm import exact_dedup, near_dedup, quality_rules, url_filters
from tickloom.llm.components import components
from tickloom.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute_em(counts, odds, rounds=quality_rules.ROUNDS):
    """The same model in plain Python, run until nothing moves."""
    digits = {p: [p // 3**r % 3 for r in range(len(odds))] for p in counts}
    q = {p: 0.9 if 0 in digits[p] else 0.05 for p in counts}
    rejected = sum(n for p, n in counts.items() if 0 in digits[p])
    prior = math.log((rejected + 1) / (sum(counts.values()) - rejected + 1))
    for _ in range(rounds):
        bad = {p: n * q[p] for p, n in counts.items()}
        good = {p: n * (1 - q[p]) for p, n in counts.items()}
        chance = {}
        for name, w in (("bad", bad), ("good", good)):
            for r, least in enumerate(odds):
                rejects = sum(x for p, x in w.items() if digits[p][r] == 0) + quality_rules.BELIEF * quality_rules.EXPECTED[name]
                found = rejects / (sum(x for p, x in w.items() if digits[p][r] != 1) + quality_rules.BELIEF)
                found = min(found, quality_rules.MOST_FOUND if name == "bad" else chance["bad", r, 0] / least)
                chance[name, r, 0], chance[name, r, 2] = found, 1 - found
        before, q = q, {p: 1 / (1 + math.exp(-prior - sum(math.log(chance["bad", r, v] / chance["good", r, v]) for r, v in enumerate(d) if v != 1))) for p, d in digits.items()}
        if max(abs(q[p] - before[p]) for p in q) < 1e-9:
            break
    return {p: 1 - x for p, x in q.items()}


def fitted(spark, votes, odds):
    """Posteriors of vote tuples, the fit's and plain Python's alike."""
    code = lambda v: sum(x * 3**i for i, x in enumerate(v))
    counts = {code(v): n for v, n in votes.items()}
    table = spark.createDataFrame(list(counts.items()), "pattern int, n bigint")
    found = {r["pattern"]: r["p_good"] for r in quality_rules.fit_patterns(table, odds).collect()}
    assert found == pytest.approx(brute_em(counts, odds), abs=1e-6)
    return {v: found[code(v)] for v in votes}


def test_groups_that_reject_alone_are_believed(spark):
    for times in (1, 10, 1000):
        found = fitted(spark, {(2, 2, 2, 2, 2): 817 * times, (0, 2, 2, 2, 2): 68 * times, (2, 2, 2, 1, 2): 18 * times, (2, 0, 2, 1, 2): 2 * times}, [50.0] * 5)
        assert found[0, 2, 2, 2, 2] < 0.3 and found[2, 0, 2, 1, 2] < 0.5 and found[2, 2, 2, 2, 2] > 0.9


def test_url_hosts(spark):
    urls = {
        "http://[2001:DB8::1]:80/x": "[2001:db8::1]", "http://user:p@ss@Example.org/": "example.org", "http://a@b/c@d.org": "b", "http://127.10.0.0.1/": "127.10.0.0.1",
        "http://10.0.0.1:8080": "10.0.0.1", "http://x.org?u=a@evil.org": "x.org", "http://": None, "http://@/": None, "mailto:me@x.org": None, "//x.org": None, "http://x.org.": "x.org", "http://[::1": None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filters.url_host(F.col("url"))).collect()
    assert {r[0]: r[1] for r in rows} == urls


def test_addresses_have_no_hosts_below_them(spark):
    entries = spark.createDataFrame([("a", p, "add", day(1)) for p in ("0.0.1", "10.0.0.1", "[2001:db8::1]", "0.1.example.org")] + [("b", "10.0.0.1", "add", day(1))], "list string, pattern string, action string, at timestamp_ntz")
    hits = {"http://10.0.0.1/": "10.0.0.1", "http://99.0.0.1/": None, "http://7.10.0.0.1/": "10.0.0.1", "http://[2001:db8::1]/": "[2001:db8::1]", "http://[2001:db8::2]/": None, "http://9.0.1.example.org/": "0.1.example.org"}
    captures = spark.createDataFrame([(u, day(3), "clash") for u in hits] * 2, "url string, fetched_at timestamp_ntz, Listed string")
    out = url_filters.filter_captures(captures, entries)
    assert out.columns == ["url", "fetched_at", "host", "listed", "list", "pattern", "valid_from"]
    # of lists that tie, the first by name decides
    assert collections.Counter((r["url"], r["pattern"], r["list"]) for r in out.collect()) == collections.Counter({(u, p, p and "a"): 2 for u, p in hits.items()})


def test_very_long_urls_and_histories(spark):
    entries = spark.createDataFrame([("a", "x.org", "add" if i % 2 else "remove", day(i)) for i in range(1, 400)], "list string, pattern string, action string, at timestamp_ntz")
    captures = spark.createDataFrame([("http://x.org/" + "p" * 1_000_000, day(d)) for d in (0, 1, 2, 399)], "url string, fetched_at timestamp_ntz")
    assert sorted((r["fetched_at"], r["listed"]) for r in url_filters.filter_captures(captures, entries).collect()) == [(day(0), False), (day(1), True), (day(2), False), (day(399), True)]


def test_the_posterior_overrules_a_group_that_stands_alone(spark):
    # four groups reject the same documents; the fifth rejects others that all four keep
    found = fitted(spark, {(2, 2, 2, 2, 2): 8500, (0, 0, 0, 0, 2): 600, (0, 0, 0, 2, 2): 200, (2, 2, 2, 2, 0): 400}, [50.0] * 5)
    assert found[2, 2, 2, 2, 0] > 0.5 and found[2, 2, 2, 2, 2] > 0.99 and found[0, 0, 0, 0, 2] < 0.01 and found[0, 0, 0, 2, 2] < 0.01


def test_weak_votes_that_agree_drop_a_text(spark):
    # each of the last two groups is overruled where it rejects alone, but not where both reject
    votes = {(2, 2, 2, 2, 2, 2): 8500, (0, 0, 0, 0, 2, 2): 600, (0, 0, 0, 2, 2, 2): 200, (2, 2, 2, 2, 0, 2): 300, (2, 2, 2, 2, 2, 0): 300, (2, 2, 2, 2, 0, 0): 30}
    found = fitted(spark, votes, [50.0] * 6)
    assert found[2, 2, 2, 2, 0, 2] > 0.5 and found[2, 2, 2, 2, 2, 0] > 0.5 and found[2, 2, 2, 2, 0, 0] < 0.1


def test_rules_of_one_group_have_one_vote(spark):
    rules = [quality_rules.Rule("a", "g", "x", reject=5, keep=1), quality_rules.Rule("b", "g", "y", reject=5), quality_rules.Rule("c", "h", "y", keep=3, least=10)]
    rows = [(20, 0.0, 9.0), (20, 0.0, 2.0), (20, 3.0, 2.0), (5, 9.0, 2.0), (5, None, None)]
    found = spark.createDataFrame(rows, "n_words bigint, x double, y double").select(quality_rules.vote_code(rules).alias("v")).collect()
    assert [(r["v"] % 3, r["v"] // 3) for r in found] == [(0, 1), (2, 2), (1, 2), (0, 1), (1, 1)]


def test_quality_rules(spark):
    rows = awkward() + [(100 + i, prose(i, 50), "en") for i in range(60)] + [(300 + i, " ".join(w + "###" for w in prose(i, 40).split()), "en") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Kept", F.lit("clash")).withColumn("N_WORDS", F.lit("clash"))
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(r["text"] or "")
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    counts = collections.Counter({r["pattern"]: 0 for r in out})
    counts.update(r["pattern"] for r in out if not r["base_failed"])
    wanted = brute_em(counts, quality_rules.group_odds(quality_rules.default_rules()))
    for r in out:
        assert r["p_good"] == pytest.approx(wanted[r["pattern"]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    by_id = {r["doc_id"]: r["kept"] for r in out}
    assert all(by_id[100 + i] for i in range(60)) and not any(by_id[300 + i] for i in range(6)) and not by_id[11]


def test_quality_rules_run_no_python_and_take_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = quality_rules.quality_rules(none)
    assert out.count() == 0
    features = quality_rules.rule_features(spark.createDataFrame(awkward(), SCHEMA), carry=["doc_id"])
    for df in (out, features):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_classifier_separates_held_out_texts(spark):
    rows = [(i, prose(i, 80) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "en") for i in range(240)]
    docs = spark.createDataFrame(rows + awkward()[3:5] + awkward()[5:7], SCHEMA).withColumn("Score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model, prior = cc.fit(docs, labels)
    out = {r["doc_id"]: r for r in cc.classify(docs, model, prior).collect()}
    for i in range(240):
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= out[i]["score"] <= 1 and out[i]["predicted"] == int(out[i]["score"] >= 0.3)
    held = [i for i in range(240) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == int(i % 3 > 0) for i in held) / len(held) > 0.95
    assert out[None]["held_out"] is False


def test_classifier_against_plain_python(spark):
    import zstandard

    texts = {i: prose(i, 700 if i % 7 == 0 else 90) if i % 2 else " ".join(w.upper() + "?!" for w in prose(i, 70).split()) for i in range(120)}
    rows = [(i, t, "en") for i, t in texts.items()] + [(500, "", "en"), (501, None, "en"), (502, prose(9, 30000), "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts if i % 3], "doc_id bigint, quality int, toxic int")
    model, prior = cc.fit(docs, labels)
    # the sample: labelled, learnable texts, in the order of their ids
    known = [i for i in texts if i % 3 and zlib.crc32(str(i).encode()) % 5]
    good, bad = ([texts[i].encode() for i in known if i % 2 == q] for q in (1, 0))

    def size(dictionary, text):
        coder = zstandard.ZstdCompressor(level=cc.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(coder.compress(text[i : i + cc.CHUNK])) for i in range(0, len(text), cc.CHUNK))

    def difference(text):
        g, b = size(model.good, text), size(model.bad, text)
        return (b - g) / len(text) if text else 0.0

    x = np.asarray([difference(t) for t in good[1::2] + bad[1::2]])
    y = np.asarray([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    w, c = model.weights
    p = 1 / (1 + np.exp(-(w * x + c)))
    # the calibration is where the penalised likelihood is flat
    assert abs(((y - p) * x).sum() - 1e-3 * w) < 1e-5 and abs((y - p).sum()) < 1e-4 and w > 0
    for r in cc.classify(docs, model, prior).collect():
        wanted = 1 / (1 + math.exp(-max(-30, min(30, w * difference((r["text"] or "").encode()) + c))))
        assert r["score"] == pytest.approx(wanted, abs=1e-9) and r["predicted"] == int(wanted >= 0.3)


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    model, prior = cc.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert model is None and prior == 0.5
    assert {r["score"] for r in cc.classify(docs, model, prior).collect()} == {0.5}
    assert cc.classify(docs.limit(0), model, prior).count() == 0


def test_classifier_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(cc, "PER_CLASS", 6)
    monkeypatch.setattr(cc, "fit_texts", lambda good, bad: seen.update(good=good, bad=bad))
    docs = spark.createDataFrame([(i, f"text {i} {k % 9}") for i in range(8) for k in range(27)], "doc_id bigint, text string")
    cc.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int"))
    assert all(0 < len(x) <= 6 and len(x) == len(set(x)) for x in seen.values())


def test_stages_hand_workers_batches_of_few_bytes_with_each_text_once(spark, monkeypatch):
    """The texts of a task once went in one batch of 10,000 rows, however long, and those of the classifier twice."""
    from tickloom.llm import harmonic_packing, store

    n, most = 400, 400_000

    def probe(run):
        def probed(batches):
            def small():
                for b in batches:
                    assert b.nbytes < 2 * most, b.nbytes
                    yield b

            return run(small())

        return probed

    monkeypatch.setattr(store, "BATCH_BYTES", most)
    for module, name in ((cc, "_score"), (exact_dedup, "local_tries"), (harmonic_packing, "_tokenise")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, made=made, **b: probe(made(*a, **b)))
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" words"), 1500)).alias("text"), F.lit(None).cast("int").alias("more"))
    out = cc.classify(docs, None, 0.7)
    assert out.columns == ["doc_id", "text", "more", "score", "held_out", "predicted"] and out.count() == n
    assert out.select(docs.columns).exceptAll(docs).isEmpty()
    assert exact_dedup.exact_dedup(docs).where("kept").count() == n
    from tickloom.llm.queries import vocabulary

    pieces = harmonic_packing.cut_documents(docs, vocabulary("word_bpe_49k.json"), most=10)
    assert harmonic_packing.harmonic_packing(pieces).select("id").distinct().count() == n
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_a_worker_remembers_as_many_chunks_as_asked(spark):
    from tickloom.llm.queries import vocabulary
    from tickloom.llm.tokens import word_encoder

    few, many = (word_encoder(vocabulary("word_bpe_49k.json"), m) for m in (50, 1000))
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(40))
        assert few.encode([text]) == many.encode([text])
    assert len(few.known) + len(few.known.older) <= 300 < len(many.known)


def test_classifier_never_learns_held_out_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 60), "en") for i in range(100)], SCHEMA)
    flip = lambda q: spark.createDataFrame([(i, (1 - i % 2) if zlib.crc32(str(i).encode()) % 5 else q, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    assert cc.fit(docs, flip(0)) == cc.fit(docs, flip(1))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget,digits", [(1, 64), (4000, 1), (48 << 20, 64), (48 << 20, 0)])
def test_exact_dedup(spark, keep, budget, digits):
    rows = awkward() + [(None, "only without identifiers", "en")] * 2 + [(700 + i % 40, f"{i % 9} short text", None) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("KEPT", F.lit("clash")).withColumn("__n", F.lit("clash")).repartition(3)
    out = exact_dedup.exact_dedup(docs, keep=keep, budget=budget, digits=digits).collect()
    groups, kept = collections.defaultdict(list), collections.Counter()
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert collections.Counter((r["doc_id"], r["text"], r["lang"]) for r in out) == collections.Counter(rows)
    for r in out:
        ids = groups[r["text"] or ""]
        known = [i for i in ids if i is not None]
        owner = (min if keep == "smallest" else max)(known) if known else None
        assert (r["keep_id"], r["group_size"]) == (owner, len(ids))
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        if r["kept"]:
            assert r["doc_id"] == owner
            kept[r["text"] or ""] += 1
    assert kept == dict.fromkeys(groups, 1)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_owners_spill_only_what_is_complete(spark):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, int(n)).astype("uint8")) for n in rng.integers(0, 6, 400)]
    partial = sorted((*exact_dedup.key_of(t, 1), t, i, 2, 1) for i, t in enumerate(texts))
    for budget in (1, 300, 1 << 20):
        found = [r for b in exact_dedup.owner_tries("smallest", budget, 1)(exact_dedup._batches(iter(partial), 500)) for r in b.to_pylist()]
        wanted = {t: (min(i for i, x in enumerate(texts) if x == t), 2 * texts.count(t)) for t in texts}
        keys = collections.Counter(exact_dedup.key_of(t, 1) for t in wanted)
        assert sorted((r["length"], r["content_hash"], r["owner"], r["copies"]) for r in found) == sorted((*exact_dedup.key_of(t, 1), *x) for t, x in wanted.items())
        assert sum(r["body"] is None for r in found) == sum(n == 1 for n in keys.values())
        assert all(wanted[r["body"]] == (r["owner"], r["copies"]) for r in found if r["body"] is not None)


def test_patricia_trie_keeps_prefixes_apart():
    trie, wanted = exact_dedup.PatriciaTrie(), {}
    for i, key in enumerate([b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc", b"", b"\x00", b"a" * 1000, b"a" * 999 + b"b"]):
        trie.insert(key, 100 - i)
        wanted[key] = (min(100 - i, wanted.get(key, (999, 0))[0]), wanted.get(key, (0, 0))[1] + 1)
    found = {k: (o, n) for k, o, n, _ in trie.terminals()}
    assert found == wanted
    spilled = {k for k, *_ in trie.spill()}
    assert spilled == {k for k in wanted if k[:1] == b"a"} and {k for k, *_ in trie.terminals()} == set(wanted) - spilled


def test_a_trie_counts_the_rows_of_the_owner():
    for keep, wanted in (("smallest", (3, 6, 2)), ("largest", (9, 6, 1))):
        trie = exact_dedup.PatriciaTrie(keep)
        for owner in (None, 3, 9, None, 3, 5):
            trie.insert(b"x", owner)
        assert list(trie.terminals()) == [(b"x", *wanted)]


def word_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def edited(text, seed, n):
    rng = np.random.default_rng(seed)
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def test_shingles_count_like_sets():
    texts = [t or "" for _, t, _ in awkward()]
    assert [len(s) for s in shingle_sets(texts)] == [len(word_set(t)) for t in texts]
    assert (shingle_sets(["A  b\tC d\ne f"])[0] == shingle_sets(["a b c d e f"])[0]).all()


def test_near_dedup_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = awkward()
    for g in range(6):
        base = prose(1000 + g, 120)
        rows += [(1000 * (g + 1) + k, edited(base, 50 * g + k, k % 6), "en") for k in range(25)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash")).repartition(3)
    out = near_dedup.near_dedup(docs).collect()
    assert len(out) == len(rows)
    sets = [(i, word_set(t or "")) for i, t, _ in rows]
    group = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and group[x] != group[y]:
                old = group[x]
                group = [group[y] if g == old else g for g in group]
    least = {}
    for (i, s), g in zip(sets, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    wanted = collections.Counter((i, len(s), (least.get(g) if s else i), i == (least.get(g) if s else i)) for (i, s), g in zip(sets, group))
    assert collections.Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == wanted
    kept = near_dedup.keep_first(docs).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(r["id"] for r in out if r["kept"])
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_blocks_ask_every_open_pair_once_and_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(9)
    groups = [(leader, int(n)) for leader, size in ((1000, 60), (2000, 25), (3000, 9)) for n in [leader, *(leader + 1 + rng.choice(400, size, replace=False))]]
    root = {n: int(n) if rng.random() < 0.3 else leader for leader, n in groups if leader != 3000}
    root |= {n: 3000 for leader, n in groups if leader == 3000}
    table = spark.createDataFrame(groups, "leader bigint, node bigint")

    def asked(rows):
        blocks = collections.defaultdict(dict)
        for r in rows:
            held = blocks[r["leader"], r["i"], r["j"]]
            held[r["node"]] = held.get(r["node"], 0) | r["role"]
        out = collections.Counter()
        for (leader, _, _), held in blocks.items():
            nodes = np.asarray(list(held))
            for x, rest in near_dedup.questions(nodes, np.asarray(list(held.values()))):
                out.update((leader, *sorted((int(nodes[x]), int(n)))) for n in nodes[rest])
        return out

    star = near_dedup.star_blocks(table).collect()
    assert asked(star) == collections.Counter((leader, leader, n) for leader, n in groups if n != leader)
    found = asked(near_dedup.outsider_blocks(table, spark.createDataFrame(list(root.items()), "node bigint, root bigint")).collect())
    tops = {leader: collections.Counter(root[n] for g, n in groups if g == leader).most_common(1)[0][0] for leader in (1000, 2000, 3000)}
    wanted = {(g, a, b) for g, a in groups for h, b in groups if g == h and a < b and (root[a] != tops[g] or root[b] != tops[g])}
    assert set(found) == wanted and set(found.values()) == {1} and not any(g == 3000 for g, _, _ in found)
    # rows that cross the network grow with the group, not with its square
    monkeypatch.setattr(near_dedup, "BLOCK", 256)
    rows = {n: near_dedup.star_blocks(spark.range(n).select(F.lit(0).cast("bigint").alias("leader"), F.col("id").alias("node"))).count() for n in (5000, 50000)}
    assert rows == {5000: 5000 - 1 + 20, 50000: 50000 - 1 + 196}


def test_near_copies_of_one_text_are_shipped_in_proportion(spark, monkeypatch):
    shipped = []
    settle = near_dedup.settle
    monkeypatch.setattr(near_dedup, "outsider_blocks", lambda groups, roots, made=near_dedup.outsider_blocks: settle(made(groups, roots), "blocks"))
    monkeypatch.setattr(near_dedup, "settle", lambda df, name: settle(df, name) if name != "open-groups" else shipped.append(settle(df, name)) or shipped[-1])
    base = prose(77, 200)
    docs = spark.createDataFrame([(k, base if k == 0 else edited(base, k, 1), "en") for k in range(1500)], SCHEMA)
    out = near_dedup.near_dedup(docs).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1
    # the leader absorbs all of them, so no group is left open
    assert shipped[0].count() == 0


def test_alike_patterns_of_other_words_are_not_alike(spark):
    word = "0"
    while len(word) < 1024:
        word += word.translate(str.maketrans("01", "10"))
    one = " ".join(word.replace("0", "a").replace("1", "b"))
    other = " ".join(word.replace("0", "b").replace("1", "a"))
    rows = [(1, word + " x y z w", "en"), (2, word.translate(str.maketrans("01", "10")) + " x y z w", "en"), (3, one + " p", "en"), (4, other + " q", "en"), (5, "q" * 70000 + "a" + "q" * 70000, "en"), (6, "q" * 70000 + "q" * 70000 + "a", "en")]
    out = {r["id"]: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["component_id"] == i for i in (1, 2, 5, 6))
    a, b = word_set(rows[2][1]), word_set(rows[3][1])
    assert (out[4]["component_id"] == 3) == (100 * len(a & b) >= 85 * len(a | b))


def test_the_pipeline_drops_near_copies_from_eighty_percent_on(spark):
    import corpus_pipeline

    bases = [prose(2000 + g, 100) for g in range(40)]
    rows = [(g, t, "en") for g, t in enumerate(bases)] + [(100 + g, edited(t, g, 1 + g % 4), "en") for g, t in enumerate(bases)]
    alike = {g: len(word_set(t) & word_set(rows[40 + g][1])) / len(word_set(t) | word_set(rows[40 + g][1])) for g, t in enumerate(bases)}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) > 5 and sum(x < 0.8 for x in alike.values()) > 5
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r["doc_id"] for r in out} == set(range(40)) | {100 + g for g, x in alike.items() if x < 0.8}


def test_bands_and_screen_follow_the_threshold():
    rng = np.random.default_rng(4)
    for percent in (80, 82, 85, 95):
        bands, rows, screen = near_dedup.scheme(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1.1e-6
        n, found = bands * rows, []
        for _ in range(300):
            both = rng.integers(0, 1 << 63, 1000).astype("uint64")
            apart = round(1000 * (100 - percent) / percent / 2)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, apart).astype("uint64")]) for _ in range(2))
            bits = [np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(x, n)), "uint64") for x in (a, b)]
            found.append(near_dedup.similarity(np.bitwise_count(bits[0] ^ bits[1]).sum(), n))
        assert np.mean(found) - 5 * np.std(found) > screen


def test_odd_sketches_estimate_high_similarity():
    base = np.arange(1, 2001, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    other = np.concatenate([base[:1900], base[:100] ^ np.uint64(77)])
    truth = 1900 / 2100
    bits = [np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(x)), "uint64") for x in (base, other)]
    assert abs(near_dedup.similarity(np.bitwise_count(bits[0] ^ bits[1]).sum()) - truth) < 0.08
    assert near_dedup.similarity(0) == 1


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_url_filters(spark):
    entries = spark.createDataFrame(
        [("a", "Bad.com", "add", day(10)), ("a", "bad.com", "add", day(12)), ("a", "bad.com", "remove", day(20)), ("a", "bad.com", "add", day(30)), ("b", "x.bad.com", "add", day(15)), ("b", "now.org", "add", day(5)), ("b", "now.org", "remove", day(5)), (None, "z.com", "add", day(1)), ("a", "com", "add", day(1)), ("a", "q.com", "remove", day(3))],
        "list string, pattern string, action string, at timestamp_ntz",
    )
    spans = {(r["list"], r["pattern"], r["valid_from"], r["valid_to"]) for r in url_filters.validity_intervals(entries).collect()}
    assert spans == {("a", "bad.com", day(10), day(20)), ("a", "bad.com", day(30), None), ("b", "x.bad.com", day(15), None), ("b", "now.org", day(5), None), ("a", "com", day(1), None)}
    urls = [("http://bad.com/", 9), ("http://bad.com/", 10), ("http://u@BAD.com.:80/x?y", 19), ("https://bad.com", 20), ("https://bad.com", 31), ("http://w.x.bad.com", 11), ("http://w.x.bad.com", 16), ("http://notbad.com", 16), ("/relative", 16), (None, 16), ("http://bad.com", None), ("http://bad.com/", 10)]
    captures = spark.createDataFrame([(u, None if d is None else day(d), i) for i, (u, d) in enumerate(urls)], "url string, fetched_at timestamp_ntz, pattern int")
    out = url_filters.filter_captures(captures, entries)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    rows = collections.Counter((r["url"], r["fetched_at"], r["listed"], r["pattern"], r["valid_from"]) for r in out.collect())
    hit = [None, ("bad.com", 10), ("bad.com", 10), None, ("bad.com", 30), ("bad.com", 10), ("x.bad.com", 15), None, None, None, None, ("bad.com", 10)]
    assert rows == collections.Counter((u, None if d is None else day(d), h is not None, h and h[0], h and day(h[1])) for (u, d), h in zip(urls, hit))
    assert url_filters.filter_captures(captures.limit(0), entries).count() == 0
    assert {r["listed"] for r in url_filters.filter_captures(captures, entries.limit(0)).collect()} == {False}


def test_url_filters_look_up_every_level(spark):
    entries = spark.createDataFrame([("a", "example.org", "add", day(1)), ("a", "d.e.f.example.org", "add", day(5))], "list string, pattern string, action string, at timestamp_ntz")
    urls = ["http://a.b.c.d.e.f.example.org/", "http://a.b.c.d.e.g.example.org/", "http://a.b.c.d.e.f.notexample.org/", "http://" + "x." * 40 + "example.org/"]
    captures = spark.createDataFrame([(u, day(d)) for u in urls for d in (0, 3, 6)], "url string, fetched_at timestamp_ntz")
    out = {(r["url"], r["fetched_at"]): r["pattern"] for r in url_filters.filter_captures(captures, entries).collect()}
    found = [[None, "example.org", "d.e.f.example.org"], [None, "example.org", "example.org"], [None] * 3, [None, "example.org", "example.org"]]
    assert out == {(u, day(d)): p for u, ps in zip(urls, found) for d, p in zip((0, 3, 6), ps)}


def test_pipeline_against_its_operators(spark, tmp_path):
    import corpus_pipeline
    from tickloom.llm.tokens import word_encoder
    from tickloom.llm.queries import vocabulary

    good = [(i, prose(i, 80), "en", "s", 0) for i in range(120)]
    rows = good + [(200 + i, " ".join(w + "***" for w in prose(i, 60).split()), "en", "s", 0) for i in range(30)]
    rows += [(300 + i, prose(i, 80), "en", "s", 0) for i in range(10)] + [(400 + i, edited(prose(20 + i, 80), i, 1), "en", "s", 0) for i in range(5)] + [(500, PARAGRAPH[:20], "en", "s", 0), (501, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of the ten copied texts the larger id stays, of near copies the smaller one
    wanted = set(range(10, 120)) | {300 + i for i in range(10)}
    assert {r["doc_id"] for r in out} == wanted
    texts = {r[0]: r[1] for r in rows}
    encoder = word_encoder(vocabulary("word_bpe_49k.json"))
    lengths = collections.Counter()
    for r in out:
        ids = encoder.encode([texts[r["doc_id"]]])[0] + (1).to_bytes(4, "little")
        assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        lengths[r["doc_id"]] += r["length"]
    assert all(4 * n == len(encoder.encode([texts[i]])[0]) + 4 for i, n in lengths.items())
    assert len(corpus_pipeline.STAGES) == 5


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("labels", [[], [(i, i % 2, 0) for i in range(60)]])
def test_pipeline_stages_take_awkward_rows(spark, tmp_path, labels):
    import corpus_pipeline

    rows = [(i, t, x, None, None) for i, t, x in awkward()] + [(None, prose(70, 90), "en", "s", 1)] * 2 + [(77, prose(71, 90), None, "s", 1)] * 3 + [(78, " ".join(w + chr(97 + i % 26) + chr(97 + i // 26 % 26) for i, w in enumerate(prose(72, 20000).split())), "en", "s", 1)]
    rows += [(600 + i, prose(600 + i, 60), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("Extra", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert not collections.Counter(map(tuple, kept.collect())) - collections.Counter(map(tuple, docs.collect())), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = collections.Counter(r["doc_id"] for r in out if r["start"] == 0)
    # repeated rows and copies are gone, the long text and the row without an id are there
    assert packed[77] == packed[78] == packed[None] == 1 and all(n == 1 for n in packed.values()) and not {3, 4, 12} & set(packed)


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
