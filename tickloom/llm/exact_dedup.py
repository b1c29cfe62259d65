"""Exact deduplication with Patricia tries that know each text's owner.

Texts are dealt by length and content hash; in each partition the full byte strings go into a
compressed radix trie whose terminal nodes hold the owner (smallest or largest id), the number of copies and
how many of them are the owner's own. Two rounds keep hot texts apart from the shuffle:

1. every input partition builds a trie of its own, so a text crosses the network at most once for each
   input partition. Past ``budget`` bytes the heaviest subtree below the root is emitted and forgotten
   ("spill by subtree"); the shuffle, not a local file, keeps what was spilled.
2. partial terminals arrive in order of (length, hash) and go into the partition's trie. Past ``budget`` its
   heaviest subtree is emitted when the pair changes, so that nothing emitted can come again; the trie alone decides
   which texts are equal, and a terminal whose pair another text shares says so with its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import settle, settle_small
from tickloom.llm.tokens import beside

PARTIAL = "length bigint, content_hash string, body binary, owner bigint, copies bigint, own_copies bigint"
OWNERS = "length bigint, content_hash string, body binary, owner bigint, copies bigint, own_copies bigint"


class Node:
    __slots__ = ("label", "kids", "owner", "copies", "own", "weight")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.copies, self.own, self.weight = label, {}, None, 0, 0, 0


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` equal those of ``b`` from ``at`` on; found by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A radix trie over byte strings. ``weight`` of a node below the root counts its label bytes."""

    def __init__(self, keep: str = "smallest"):
        self.root, self.better, self.size = Node(b""), {"smallest": min, "largest": max}[keep], 0

    def insert(self, key: bytes, owner: int | None, copies: int = 1, own: int = 1) -> None:
        """``copies`` more of ``key``, of which ``own`` belong to ``owner``. Any id owns before none does."""
        node, at, top, added = self.root, 0, None, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                added = len(key) - at + 200
                at = len(key)
            elif key.startswith(kid.label, at):
                at += len(kid.label)
            else:
                n = common(kid.label, key, at)
                upper = Node(kid.label[:n])
                upper.weight, kid.weight = kid.weight, 0
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = upper
                added += 200
                at += n
            top, node = top or kid, kid
        fresh = not node.copies
        node.copies += copies
        if not fresh and owner == node.owner:
            node.own += own
        elif fresh or owner is not None and (node.owner is None or self.better(node.owner, owner) == owner):
            node.owner, node.own = owner, own
        if top is not None:
            top = self.root.kids[key[0]]
            top.weight += added
            self.size += added

    def terminals(self, node: Node | None = None) -> Iterator[tuple[bytes, int | None, int, int]]:
        """(key, owner, copies, the owner's own copies)"""
        todo = [(node or self.root, b"")]
        while todo:
            at, prefix = todo.pop()
            whole = prefix + at.label
            if at.copies:
                yield whole, at.owner, at.copies, at.own
            todo.extend((kid, whole) for kid in at.kids.values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int, int]]:
        """Take the heaviest subtree below the root out of the trie and yield its terminals."""
        first = max(self.root.kids, key=lambda k: self.root.kids[k].weight)
        out = self.root.kids.pop(first)
        self.size -= out.weight
        return self.terminals(out)


def key_of(text: bytes, digits: int) -> tuple[int, str]:
    return len(text), hashlib.sha256(text).hexdigest()[:digits]


def _batches(rows: Iterable[tuple], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(length, hash, body, owner, copies, own copies) rows, about ``size`` bytes of bodies at a time."""
    held, n = [], 0
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["length", "content_hash", "body", "owner", "copies", "own_copies"])

    for row in rows:
        held.append(row)
        n += 100 + len(row[2] or b"")
        if n >= size:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def local_tries(keep: str, budget: int, digits: int = 64):
    """Round 1: (id, body) batches in, partial terminals out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = PatriciaTrie(keep)
        for b in batches:
            for owner, body in zip(b.column(0).to_pylist(), b.column(1)):
                trie.insert(body.as_py(), owner)
                while trie.size > budget:
                    yield from trie.spill()
        yield from trie.terminals()

    return lambda batches: _batches((*key_of(x, digits), x, o, n, own) for x, o, n, own in rows(batches))


def owner_tries(keep: str, budget: int, digits: int = 64):
    """Round 2: partial terminals in order of (length, content_hash) in, owners out; ``body`` is null where no other
    text has the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, at, first, shared = PatriciaTrie(keep), None, None, set()

        def told(found: Iterable[tuple]) -> Iterator[tuple]:
            for x, o, n, own in found:
                key = key_of(x, digits)
                yield (*key, x if key in shared else None, o, n, own)

        for b in batches:
            for n, h, body, owner, copies, own in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (n, h) != at:
                    while trie.size > budget:
                        yield from told(trie.spill())
                    if not trie.size:
                        shared.clear()
                    at, first = (n, h), body
                elif body != first:
                    shared.add(at)
                trie.insert(body, owner, copies, own)
        yield from told(trie.terminals())

    return lambda batches: _batches(run(batches))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = 48 << 20, digits: int = 64) -> DataFrame:
    """One row per distinct text: its length in bytes, the first ``digits`` of its SHA-256, its owner, the number of copies
    and of the owner's own, and its ``body`` where another text shares length and digits.

    A null text counts as the empty text, which is a text like any other; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    partial = rows.mapInArrow(local_tries(keep, budget, digits), PARTIAL)
    return partial.repartition("length", "content_hash").sortWithinPartitions("length", "content_hash").mapInArrow(owner_tries(keep, budget, digits), OWNERS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = 48 << 20, digits: int = 64) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (replacing columns so named, in whatever case).

    A null text counts as the empty text. One row of each text stays: the owner's. A null id never owns a text
    that another id has; where all ids of a text are null, ``keep_id`` is null. Of rows that repeat their owner's
    id and text, an arbitrary one stays; all count in ``group_size``. An empty table gives an empty result."""
    own = settle_small(owners(docs, id_col, text_col, keep, budget, digits), "owners")
    told = own.select(F.col("content_hash").alias("__h"), F.col("length").alias("__n"), F.col("body").alias("__body"), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"), F.col("own_copies").alias("__own"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*beside(docs.columns, "keep_id", "group_size", "kept", "text_sha256", "__h", "__n", "__body", "__own", "__len", "__key", "__row"))
    rows = rows.withColumn("text_sha256", F.sha2(text, 256)).withColumn("__len", F.octet_length(text).cast("bigint")).withColumn("__key", F.substring("text_sha256", 1, digits))
    joined = rows.join(told, (F.col("__key") == F.col("__h")) & (F.col("__len") == F.col("__n")) & (F.col("__body").isNull() | (F.col("__body") == text)))
    joined = joined.withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col).cast("bigint"))).drop("__h", "__n", "__key", "__len", "__body")
    if own.where("own_copies > 1").isEmpty():
        return joined.drop("__own")
    # some owners have a text more than once: number the rows, written so that the numbers hold, and let the first stay
    numbered = settle(joined.withColumn("__row", F.monotonically_increasing_id()), "owned")
    tied = F.col("kept") & (F.col("__own") > 1)
    first = numbered.where(tied).groupBy("text_sha256", F.octet_length(text).alias("__n"), F.when(F.lit(digits < 64), text).alias("__body")).agg(F.min("__row").alias("__first")).select("__first")
    numbered = numbered.join(first, F.col("__row") == F.col("__first"), "left")
    return numbered.withColumn("kept", F.col("kept") & (~tied | F.col("__first").isNotNull())).drop("__own", "__row", "__first")
