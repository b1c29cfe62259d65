import base64
import hashlib
import random
import re
import struct
import time
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, awkward
from tickloom.llm import bfd_packing, byte_bpe, edit_counts, harmonic_packing
from tickloom.llm.tokens import CHUNK, SPACES, byte_encoder, word_encoder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_ids(text):
    return word_encoder(WORDS).tokenizer.encode(text, add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encode_equals_the_rank_library(spark, encoding):
    docs = spark.createDataFrame(awkward(), SCHEMA).withColumn("N_Tokens", F.lit("clash"))
    rows = byte_bpe.encode(docs, RANKS, carry=("doc_id", "text", "lang", "N_Tokens"), decode=True, offsets=True).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        text = r["text"] or ""
        ids = encoding.encode_ordinary(text)
        assert bytes(r["ids_le"]) == packed(ids) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == text.encode()
        starts, ends = (struct.unpack(f"<{len(ids)}I", r[c]) for c in ("starts_le", "ends_le"))
        assert [text.encode()[a:b] for a, b in zip(starts, ends)] == [encoding.decode_single_token_bytes(i) for i in ids]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t=-!.aethé漢1'sS\x1c\x85 🙂́", max_size=80))
def test_chunks_do_not_change_ids(text):
    import tiktoken  # noqa: F401

    ids = byte_encoder(RANKS).encode([text])[0]
    assert ids == packed(byte_encoder(RANKS).tokenizer.encode(text, add_special_tokens=False).ids)
    assert byte_bpe.decode_bytes(ids, RANKS) == text.encode()
    assert word_encoder(WORDS).encode([text])[0] == packed(word_ids(text))


def test_decode_stream_joins_split_characters(spark):
    text = "a🙂b漢"
    ids = byte_encoder(RANKS).encode([text])[0]
    parts = [ids[i : i + 4] for i in range(0, len(ids), 4)]
    assert "".join(byte_bpe.decode_stream(iter(parts), RANKS)) == text
    row = byte_bpe.decode(spark.createDataFrame([(1, ids), (2, None)], "doc_id int, ids_le binary"), RANKS).orderBy("doc_id").collect()
    assert row[0]["decoded_text"] == text and row[1]["decoded"] is None


def test_decode_awkward_rows(spark):
    whole = byte_encoder(RANKS).encode(["one"])[0]
    rows = spark.createDataFrame([(1, whole, "x"), (1, whole, "x"), (None, b"", "x"), (2, packed([4_000_000_000]), "x"), (3, whole + b"\x01", None)], "doc_id int, ids_le binary, Decoded string")
    out = byte_bpe.decode(rows, RANKS, carry=("doc_id", "Decoded"))
    assert out.columns == ["doc_id", "decoded", "decoded_text"]
    assert sorted((r["doc_id"] or 0, r["decoded_text"]) for r in out.collect()) == [(0, ""), (1, "one"), (1, "one"), (2, "\ufffd"), (3, "one")]
    assert byte_bpe.decode(rows.limit(0), RANKS).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.encode(none, RANKS).count() == 0
    assert bfd_packing.bfd_packing(none, WORDS).count() == 0
    assert edit_counts.recount(none, RANKS).count() == 0
    assert harmonic_packing.harmonic_packing(harmonic_packing.cut_documents(none, WORDS)).count() == 0


@given(st.integers(1, 9000))
def test_cut_lengths(n):
    pieces = harmonic_packing.cut_lengths(n)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)


def test_harmonic_packing_is_lossless_and_gapless(spark):
    rows = awkward() + [(100 + i, " ".join(["alder birch cedar"] * (i * 7 % 400)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = harmonic_packing.cut_documents(docs, WORDS).withColumn("offset", F.lit("clash"))
    out = harmonic_packing.harmonic_packing(pieces).collect()
    wanted = {}
    for i, t, _ in rows:
        wanted.setdefault(i, []).append(packed(word_ids(t or "") + [1]))
    got = {}
    for r in sorted(out, key=lambda r: r["start"]):
        got.setdefault(r["id"], []).append(r)
        ids = bytes(r["ids_le"])
        assert len(ids) == 4 * r["length"] and any(ids == w[4 * r["start"] :][: len(ids)] for w in wanted[r["id"]])
    for i, w in wanted.items():
        assert sum(r["length"] for r in got[i]) == sum(map(len, w)) // 4
    fill = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048
    assert 1 - sum(fill.values()) / (2048 * len(fill)) < 0.05


def test_room_tree_against_a_scan():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(1, 70)
        tree, rooms = bfd_packing.RoomTree(capacity), []
        for _ in range(60):
            room = rng.randint(1, capacity)
            tree.add(room)
            rooms.append(room)
            if rng.random() < 0.4:
                gone = rooms.pop(rng.randrange(len(rooms)))
                tree.add(gone, -1)
            need = rng.randint(1, capacity)
            assert tree.least(need) == min((r for r in rooms if r >= need), default=None)


def test_best_fit_against_a_scan():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    rows = bfd_packing.best_fit(lengths, 100)
    free = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
        if at is None:
            free.append(100)
            at = len(free) - 1
        free[at] -= n
    assert sorted(100 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_bfd_packing_is_lossless(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).coalesce(1)
    out = bfd_packing.bfd_packing(docs, WORDS, capacity=128).collect()
    parts = {}
    for r in out:
        ids, positions = bytes(r["ids_le"]), struct.unpack("<128I", r["positions_le"])
        assert len(ids) == 512 and r["cu_seqlens"][-1] == r["n_tokens"] and ids[4 * r["n_tokens"] :] == bytes(512 - 4 * r["n_tokens"])
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a:b] == tuple(range(b - a))
            parts.setdefault(d, []).append((s, ids[4 * a : 4 * b]))
    wanted = {}
    for i, t, _ in awkward():
        wanted.setdefault(i, []).append(packed(word_ids(t or "") + [1]))
    for d, w in wanted.items():
        if len(w) == 1:
            assert b"".join(x for _, x in sorted(parts[d])) == w[0]
        else:
            assert sorted(parts[d]) == sorted((i // 4, x[i : i + 512]) for x in w for i in range(0, len(x), 512))
    assert len({r["sequence_id"] for r in out}) == len(out)


BLANKS = " \n\t\x85\xa0\u1680\u2000\u2003\u2009\u200a\u2028\u202f\u205f\u3000"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab-.é1" + BLANKS, max_size=400), st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.text(alphabet="ab9-" + BLANKS, max_size=300)), max_size=5))
def test_edits_count_like_encoding_again(text, edits):
    encoder = byte_encoder(RANKS)
    tree = edit_counts.TokenTree(text, edit_counts.counter(encoder))
    for a, b, new in edits:
        start, end = sorted((int(a * len(text)), int(b * len(text))))
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert tree.text() == text and tree.length == len(text)
        assert tree.total == len(encoder.encode([text])[0]) // 4


def test_edits_cut_white_space_like_the_whole_text():
    def chunks(text, *edit):
        tree = edit_counts.TokenTree(text, lambda found: [1] * len(found))
        tree.edit(*edit)
        return [c for block in tree.blocks for c in block[0]], tree.total

    rng = random.Random(6)
    cases = [("a \nx", 3, 4, ""), ("a \nx", 3, 4, "\t"), ("a \n \nx b", 5, 6, " ")]
    for _ in range(2000):
        text = "".join(rng.choice("ab \n\t") for _ in range(rng.randint(1, 12)))
        start, end = sorted(rng.randint(0, len(text)) for _ in range(2))
        cases.append((text, start, end, "".join(rng.choice("a \n") for _ in range(rng.randint(0, 3)))))
    for text, start, end, new in cases:
        whole = CHUNK.findall(text[:start] + new + text[end:])
        assert chunks(text, start, end, new) == (whole, len(whole)), (text, start, end, new)


def test_edits_beside_rare_spaces():
    assert {c for c in map(chr, range(0x3001)) if c.isspace()} - SPACES == set("\x1c\x1d\x1e\x1f") and all(c.isspace() for c in SPACES)
    rng, encoder = random.Random(7), byte_encoder(RANKS)
    for _ in range(3000):
        text = "".join(rng.choice("1a-" + BLANKS) for _ in range(rng.randint(1, 9)))
        start, end = sorted(rng.randint(0, len(text)) for _ in range(2))
        new = "".join(rng.choice("a-" + BLANKS) for _ in range(rng.randint(0, 2)))
        tree = edit_counts.TokenTree(text, edit_counts.counter(encoder))
        tree.edit(start, end, new)
        assert tree.total == len(encoder.encode([text[:start] + new + text[end:]])[0]) // 4, (text, start, end, new)


def test_scrubbing_reads_long_runs_once():
    old = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("ab1.@@- +_") for _ in range(rng.randint(0, 25)))
        assert list(edit_counts.mail_spans(text)) == [m.span() for m in old.finditer(text)], text
    began = time.perf_counter()
    assert edit_counts.scrub_edits("x" * 1_000_000) == []
    assert edit_counts.scrub_edits("a@b" * 300_000) == []
    assert time.perf_counter() - began < 3


def test_trees_are_kept_and_edited_in_batches(spark, encoding):
    rows = [*awkward(), (60, " ".join(f"word{i}" for i in range(9000)), "en")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Block", F.lit("clash"))
    trees = edit_counts.build_trees(docs, RANKS, carry=("doc_id", "Block", "lang"))
    assert trees.columns == ["doc_id", "lang", "tree", "block", "text", "chunk_chars", "chunk_tokens", "encoded"]

    def texts(table):
        out = {}
        for r in table.orderBy("tree", "block").collect():
            out.setdefault(r["tree"], [r["doc_id"], ""])[1] += r["text"]
        return out

    def checked(table):
        found = texts(table)
        counts = {r["tree"]: r for r in edit_counts.tree_counts(table).collect()}
        assert counts.keys() == found.keys()
        for tree, (doc, text) in found.items():
            assert (counts[tree]["doc_id"], counts[tree]["n_tokens"]) == (doc, len(encoding.encode_ordinary(text)))
        return found, counts

    found, _ = checked(trees)
    assert sorted(map(str, found.values())) == sorted(str([i, t or ""]) for i, t, _ in rows)
    rng = random.Random(9)
    for batch in range(2):
        edits, wanted = [], dict(found)
        for tree, (doc, text) in found.items():
            if tree % 3 == batch or doc == 60:
                a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
                b = min(b, a + 30)
                wanted[tree] = [doc, text[:a] + "new \u2009 text" + text[b:]]
                edits += [(tree, a, b, "new \u2009 text"), (tree, None, 3, "no"), (tree, b + 1, b, "no")]
        edits += [(10**12, 0, 0, "no"), (None, 0, 0, "no")]
        before = trees
        trees = edit_counts.apply_edits(trees, spark.createDataFrame(edits, "tree bigint, start int, end int, new string"), RANKS)
        trees = edit_counts.settle(trees, "edited-trees")
        found, counts = checked(trees)
        assert found == wanted
        # only blocks that an edit touches are encoded again
        assert all(counts[t]["n_encoded"] < 40 for t, (doc, _) in found.items() if doc == 60)
        same = before.where("doc_id = 60").select("text").collect()
        assert len({r[0] for r in same} - {r[0] for r in trees.where("doc_id = 60").select("text").collect()}) <= 3
    none = spark.createDataFrame([], "tree bigint, start int, end int, new string")
    assert texts(edit_counts.apply_edits(trees, none, RANKS)) == found
    assert edit_counts.apply_edits(trees.limit(0), none, RANKS).count() == 0
    whole = edit_counts.apply_edits(trees, spark.createDataFrame([(t, -5, 10**9, None) for t in found], "tree bigint, start long, end long, new string"), RANKS)
    assert {x for _, x in texts(whole).values()} == {""} and {r["n_tokens"] for r in edit_counts.tree_counts(whole).collect()} == {0}


def test_an_edit_encodes_little():
    text = " ".join(f"word{i}" for i in range(20000))
    tree = edit_counts.TokenTree(text, edit_counts.counter(byte_encoder(RANKS)))
    first = tree.encoded
    tree.edit(50_000, 50_010, "new words")
    assert tree.encoded - first < 10
    with pytest.raises(ValueError):
        tree.edit(5, 10**9, "")


def test_recount(spark, encoding):
    docs = spark.createDataFrame([*awkward(), (50, "mail me at jo.doe@site.example.com or +49 170 1234567 today", "en")], SCHEMA).withColumn("N_Edits", F.lit("clash"))
    rows = edit_counts.recount(docs, RANKS, carry=("doc_id", "text", "N_Edits")).collect()
    assert len(rows) == len(awkward()) + 1
    for r in rows:
        text = r["text"] or ""
        after = text
        for start, end, new in reversed(edit_counts.scrub_edits(text)):
            after = after[:start] + new + after[end:]
        assert r["edited"] == after
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(encoding.encode_ordinary(text)), len(encoding.encode_ordinary(after)))
    assert next(r for r in rows if r["doc_id"] == 50)["edited"] == "mail me at <email> or <number> today"


def test_digest_queries(spark, tmp_path, encoding):
    from tickloom.llm.queries import QUERIES

    spark.createDataFrame(awkward(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op1_byte_bpe"](spark, str(tmp_path)).collect()
    texts = {t or "" for _, t, _ in awkward()}
    assert {(r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {(hashlib.sha256(packed(encoding.encode_ordinary(t))).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts}
    whole = {i: word_ids(t or "") + [1] for i, t, _ in awkward() if i is not None}
    for r in QUERIES["op7_harmonic_packing"](spark, str(tmp_path)).collect():
        if r["doc_id"] is not None:
            ids = whole[r["doc_id"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(packed(ids[r["start"] : r["start"] + r["length"]]))
