"""Near-duplicate groups by MinHash bands and odd sketches.

1. Every distinct shingle set gets ``BANDS * ROWS`` MinHash samples (more for a threshold under 0.85). Rows of samples hash to band keys;
   the samples also fold into an odd sketch, a bitmap of parities, whose XOR with another's counts the
   samples that differ.
2. Sets that share a band key form a bucket. A bucket names as its leader the member with most company
   over all its buckets; so every pair of a bucket lies in the group of one leader, while the rows of a
   group are linear in its buckets.
3. First each member meets its leader alone: a large group is cut and the leader goes to every cut, so
   rows and work are linear. Components of these links absorb most members of a group of near copies.
4. Only members outside the largest component of their group ("outsiders") meet the others, in blocks:
   sketches first, by population counts, closest pairs first; those that may reach the threshold are
   confirmed on the shingles themselves, words and all, unless links already join them. What leaves a
   block is a forest of confirmed links, never all pairs.
5. Star contraction turns the links of both steps into components.

A pair at the threshold shares no band with a chance of at most 1e-6, at 0.85 as at 0.80; the sketch screen
lies six standard deviations under the threshold. Equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.shingles import mix, randoms, shingle_sets, word_shingles
from tickloom.llm.store import settle, settle_small
from tickloom.llm.tokens import slices

BANDS, ROWS, BITS = 36, 7, 1024
BLOCK = 256
#: Shingles of a block held at once; beyond them sets are made anew when asked for.
MOST_SHINGLES = 200_000
#: Rows of a group that join what is known of it are dealt to so many tasks.
SALTS = 16
_U = np.uint64
#: Bands, rows and screen for thresholds of so many percent and more.
SCHEMES = {85: (BANDS, ROWS, 0.7), 80: (48, 6, 0.64)}
_MOST = max(b * r for b, r, _ in SCHEMES.values())
_A, _B = randoms(_MOST, 21) | _U(1), randoms(_MOST, 22)
_JOIN, _BAND, _SAMPLE = randoms(ROWS, 23) | _U(1), randoms(max(b for b, _, _ in SCHEMES.values()), 24), randoms(_MOST, 25)


def scheme(percent: int) -> tuple[int, int, float]:
    """Bands, rows and screen for a threshold."""
    return SCHEMES[max((p for p in SCHEMES if p <= percent), default=min(SCHEMES))]


def samples(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The MinHash samples of a shingle set."""
    with np.errstate(over="ignore"):
        parts = [(hashes[i : i + 2048, None] * _A[:n] + _B[:n]).min(axis=0) for i in range(0, len(hashes), 2048)]
    return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def band_keys(sample: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sample.reshape(-1, rows) * _JOIN[:rows]).sum(axis=1, dtype="uint64") + _BAND[: len(sample) // rows]).view("int64")


def odd_sketch(sample: np.ndarray) -> bytes:
    """Bit i holds whether an odd number of samples hash to i."""
    with np.errstate(over="ignore"):
        at = mix(sample + _SAMPLE[: len(sample)]) % _U(BITS)
    return np.packbits(np.bincount(at.astype("int64"), minlength=BITS).astype("uint8") & 1).tobytes()


def similarity(differing: np.ndarray | float, n: int = BANDS * ROWS) -> np.ndarray | float:
    """The Jaccard similarity that so many differing bits of two odd sketches of ``n`` samples speak for."""
    return 1 + BITS / (4 * n) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def most_differing(least: float, n: int = BANDS * ROWS) -> int:
    return int(np.flatnonzero(similarity(np.arange(BITS // 2), n) >= least)[-1])


SIGNED = "digest binary, n_shingles bigint, bands array<bigint>, sketch binary"


def _sign(n: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1), 1 << 20):
                digest, sizes, bands, sketch = [], [], [], []
                for s in shingle_sets(texts):
                    sizes.append(len(s))
                    sample = samples(s, n) if len(s) else None
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(band_keys(sample, rows) if len(s) else None)
                    sketch.append(odd_sketch(sample) if len(s) else None)
                made = [pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in b.columns[:-1]), *made], [*b.schema.names[:-1], "digest", "n_shingles", "bands", "sketch"])

    return run


class Member(NamedTuple):
    """A node of a block: ``root`` is its component so far, ``role`` the side it stands on."""

    node: int
    root: int
    role: int
    size: int
    sketch: bytes
    text: str


#: Sides of a block, and the mark of those on the answering side that ask in other blocks.
ASKS, ANSWERS, OUTSIDER = 1, 2, 4


def questions(nodes: np.ndarray, roles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Who asks, and the places of those that answer; of two that ask each other in some block, the smaller node does."""
    answering = np.flatnonzero(roles & ANSWERS)
    for x in np.flatnonzero(roles & ASKS).tolist():
        yield x, answering[((roles[answering] & OUTSIDER == 0) | (nodes[answering] > nodes[x])) & (answering != x)]


def group_links(members: list[Member], percent: int, screen: float) -> list[tuple[int, int]]:
    """A forest of links within one block: it joins all that confirmed links of its pairs (one asks, the other
    answers) join, beyond what the members' roots already join."""
    sets: dict[int, frozenset] = {}
    parent = {m.root: m.root for m in members}
    sizes, roles = np.asarray([m.size for m in members]), np.asarray([m.role for m in members])

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def shingles(x: int) -> frozenset:
        if x not in sets:
            if sum(map(len, sets.values())) > MOST_SHINGLES:
                sets.clear()
            sets[x] = word_shingles(members[x].text)
        return sets[x]

    bits = np.frombuffer(b"".join(m.sketch for m in members), "uint64").reshape(len(members), BITS // 64)
    bands, rows, _ = scheme(percent)
    limit, found = most_differing(screen, bands * rows), []
    for x, rest in questions(np.asarray([m.node for m in members]), roles):
        apart = np.bitwise_count(bits[rest] ^ bits[x]).sum(axis=1, dtype="int64")
        near = (apart <= limit) & (100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x]))
        found.append(np.stack([apart[near], np.full(int(near.sum()), x), rest[near]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), "int64")
    out = []
    for _, x, y in pairs[np.lexsort(pairs.T[::-1])].tolist():
        p, q = root(members[x].root), root(members[y].root)
        if p == q:
            continue
        a, b = shingles(x), shingles(y)
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            parent[q] = p
            out.append((members[x].node, members[y].node))
    return out


def _links(percent: int, screen: float):
    """Rows ordered by (leader, i, j) -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, {}, []

        def close() -> None:
            if len(held) > 1:
                out.extend(group_links(list(held.values()), percent, screen))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for b in batches:
            for first in range(0, b.num_rows, BLOCK):
                part = b.slice(first, BLOCK)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if row[:3] != at:
                        close()
                        at, held = row[:3], {}
                    new = Member(*row[3:])
                    old = held.get(new.node)
                    held[new.node] = new if old is None else new._replace(role=new.role | old.role)
            if out:
                yield batch()
                out.clear()
        close()
        if out:
            yield batch()

    return run


def salted(groups: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """``groups`` (leader, node, ...) joined with the one row that ``known`` has of a leader, which goes to every salt; so
    the members of a large group meet it in several tasks."""
    left = groups.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    right = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["leader", "__salt"], how).drop("__salt")


PLACED = ["leader", "i", "j", "node", "root", "role"]


def star_blocks(groups: DataFrame) -> DataFrame:
    """Every member of a group beside its leader: ``BLOCK`` members to a block, the leader in each of them.

    (leader, node) -> ``PLACED``; as many rows as members, and one more for each block."""
    blocks = groups.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = salted(groups, blocks, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = placed.where("node <> leader").select("leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("root"), F.lit(ANSWERS).alias("role"))
    leaders = placed.where("node = leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("root"), F.lit(ASKS).alias("role"))
    return members.unionByName(leaders)


def outsider_blocks(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The members outside the largest component of their group, against all its members.

    (leader, node), (node, root) -> ``PLACED``. Groups of one component give no rows; the others give each outsider
    as often as there are blocks of members, and each member as often as there are blocks of outsiders."""
    found = groups.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    sizes = found.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("leader").agg(F.max_by(F.struct("root", "n"), F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    open_ = most.where("all > top.n").select("leader", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"))
    found = settle(salted(found, open_, "inner"), "open-groups")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = found.where("root <> top").select("leader", own("rows").alias("i"), every("columns").alias("j"), "node", "root", F.lit(ASKS).alias("role"))
    answers = found.select("leader", own("columns").alias("j"), every("rows").alias("i"), "node", "root", F.when(F.col("root") == F.col("top"), ANSWERS).otherwise(ANSWERS + OUTSIDER).alias("role"))
    return asks.unionByName(answers).select(*PLACED)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, screen: float | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash), one row per row of ``docs``.

    Texts whose shingle sets have 100 * intersection >= ``percent`` * union are linked; ``component_id`` is
    the smallest id reachable. Null and empty texts have no shingles, link with nothing and are kept. A
    null id is never a component's id unless the component has no other; a row is kept if its id equals
    its component's, so rows that repeat an id with one text are kept together. ``percent`` below 80
    would need more bands; ``screen`` follows it. An empty table gives an empty result."""
    bands, per_band, lowest = scheme(percent)
    screen = lowest if screen is None else screen
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = settle_small(rows.mapInArrow(_sign(bands * per_band, per_band), f"id bigint, text_hash bigint, {SIGNED}").withColumn("node", F.monotonically_increasing_id()), "signed")
    own = settle(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("node").alias("set_node"), F.min("id").alias("least_id")), "sets")
    alone = signed.join(own.select("set_node"), signed["node"] == F.col("set_node")).drop("set_node")
    alone = settle(alone.select("node", "id", "text_hash", "n_shingles", "bands", "sketch"), "distinct-sets")

    banded = alone.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = settle(banded.join(shared, "key"), "buckets")
    company = buckets.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = buckets.join(company, "node").groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("leader"))
    groups = settle(buckets.join(leaders, "key").select("leader", "node").distinct(), "groups")
    wanted = alone.join(groups.select("node").distinct(), "node").select("node", F.col("n_shingles").alias("size"), "sketch", F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    texts = rows.join(wanted, rows["id"].eqNullSafe(F.col("w_id")) & (rows["text_hash"] == F.col("w_hash"))).select("node", "size", "sketch", "text")
    texts = settle(texts, "grouped-texts")

    def confirmed(placed: DataFrame) -> DataFrame:
        blocked = placed.join(texts, "node").select(*PLACED, "size", "sketch", "text")
        blocked = blocked.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
        return settle_small(blocked.mapInArrow(_links(percent, screen), "a bigint, b bigint"), "near-links")

    links = confirmed(star_blocks(groups))
    links = links.unionByName(confirmed(outsider_blocks(groups, components(links))))
    roots = components(links)
    linked = roots.join(own, roots["node"] == own["set_node"])
    least = linked.groupBy("root").agg(F.min("least_id").alias("component"))
    linked = linked.join(least, "root").select(F.col("node").alias("l_node"), "component")
    by_set = own.join(linked, own["set_node"] == F.col("l_node"), "left").select(F.col("digest").alias("s_digest"), F.coalesce("component", "least_id").alias("component"))
    found = signed.select("id", "n_shingles", "digest", "text_hash").join(by_set, F.col("digest") == F.col("s_digest"), "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component")))
    return found.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, with all their columns."""
    kept = near_dedup(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__hash"))
    return docs.join(kept, same, "left_semi")
