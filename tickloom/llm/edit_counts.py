"""Token counts that follow edits.

A document keeps a segment tree over blocks of pre-token chunks, with the characters and tokens under
each node. An edit finds its chunks through the tree, re-encodes only those and the boundary context
whose split it could change, and updates the sums on the way to the root.

``build_trees`` writes the leaves of all documents as a table, a row for each block; ``apply_edits`` takes such
a table and a table of edits to the next one. Documents without edits pass through; of the others, only what the
edits touch is encoded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import settle
from tickloom.llm.tokens import CHUNK, SPACES, ChunkEncoder, beside, byte_encoder, slices

BLOCK = 64
#: Spans that the query below replaces, and what by: e-mail addresses and long numbers. An address grows from its @
#: outwards, so a long run of letters is read once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"\+?[0-9](?:[ -]?[0-9]){6,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class TokenTree:
    """Counts of one text. ``count`` maps a list of chunks to their numbers of tokens."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self.count, self.encoded = count, 0
        chunks = CHUNK.findall(text)
        tokens = self._encode(chunks)
        self.blocks = [(chunks[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(chunks), BLOCK)] or [([], [])]
        self._build()

    @classmethod
    def kept(cls, blocks: list[tuple[list[str], list[int]]], count: Callable[[list[str]], list[int]]) -> TokenTree:
        """The tree of blocks (chunks, tokens of each) as they were written; nothing is encoded."""
        self = cls.__new__(cls)
        self.count, self.encoded = count, 0
        self.blocks = list(blocks) or [([], [])]
        self._build()
        return self

    def _encode(self, chunks: list[str]) -> list[int]:
        self.encoded += len(chunks)
        return self.count(chunks)

    def _build(self) -> None:
        self.leaves = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (chunks, tokens) in enumerate(self.blocks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(map(len, chunks)), sum(tokens)
        for at in range(self.leaves - 1, 0, -1):
            self.chars[at], self.tokens[at] = self.chars[2 * at] + self.chars[2 * at + 1], self.tokens[2 * at] + self.tokens[2 * at + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(c for chunks, _ in self.blocks for c in chunks)

    def _find(self, place: int) -> tuple[int, int, int]:
        """(block, chunk, offset in the chunk) of a character; the end counts as in the last chunk."""
        at = 1
        while at < self.leaves:
            at *= 2
            if place >= self.chars[at] and self.chars[at + 1]:
                place -= self.chars[at]
                at += 1
        block = at - self.leaves
        ends = list(accumulate(map(len, self.blocks[block][0])))
        chunk = min(bisect_right(ends, place), max(0, len(ends) - 1))
        return block, chunk, place - (ends[chunk - 1] if chunk else 0)

    def _step(self, block: int, chunk: int, by: int) -> tuple[int, int] | None:
        """The next chunk to the right or left, if any."""
        chunk += by
        while not 0 <= chunk < len(self.blocks[block][0]):
            block += by
            if not 0 <= block < len(self.blocks):
                return None
            chunk = 0 if by > 0 else len(self.blocks[block][0]) - 1
        return block, chunk

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` (exclusive) by ``new``."""
        if not 0 <= start <= end <= self.length:
            raise ValueError(f"no span {start}:{end} in {self.length} characters")
        first, last = self._find(start), self._find(max(start, end - 1))
        left, right = first[:2], last[:2]
        head, tail = first[2], end - start
        # whole chunks before, back to one that ends in other than white space: what follows decides where they end
        while step := self._step(*left, -1):
            left = step
            head += len(self.blocks[left[0]][0][left[1]])
            if self.blocks[left[0]][0][left[1]][-1] not in SPACES:
                break
        # chunks after, up to one that ends in other than white space: its end no edit before it can move
        while step := self._step(*right, 1):
            right = step
            if self.blocks[right[0]][0][right[1]][-1] not in SPACES:
                break
        region = "".join(c for b in range(left[0], right[0] + 1) for c in self.blocks[b][0][left[1] if b == left[0] else 0 : right[1] + 1 if b == right[0] else None])
        chunks = CHUNK.findall(region[:head] + new + region[head + tail :])
        tokens = self._encode(chunks)
        before, after = self.blocks[left[0]], self.blocks[right[0]]
        merged = (before[0][: left[1]] + chunks + after[0][right[1] + 1 :], before[1][: left[1]] + tokens + after[1][right[1] + 1 :])
        if len(merged[0]) > 4 * BLOCK:  # too long for one block: the tree gets new leaves, the counts stay
            self.blocks[left[0] : right[0] + 1] = [(merged[0][i : i + BLOCK], merged[1][i : i + BLOCK]) for i in range(0, len(merged[0]), BLOCK)]
            self._build()
            return
        for b in range(left[0], right[0] + 1):
            self.blocks[b] = merged if b == left[0] else ([], [])
            at = self.leaves + b
            self.chars[at], self.tokens[at] = sum(map(len, self.blocks[b][0])), sum(self.blocks[b][1])
            while at := at // 2:
                self.chars[at], self.tokens[at] = self.chars[2 * at] + self.chars[2 * at + 1], self.tokens[2 * at] + self.tokens[2 * at + 1]


def counter(encoder: ChunkEncoder) -> Callable[[list[str]], list[int]]:
    return lambda chunks: [len(encoder.known[c]) // 4 for c in chunks]


def mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from the left, none beginning within the one before."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def scrub_edits(text: str) -> list[tuple[int, int, str]]:
    """Spans of personal data and their replacements, from the left, without overlaps."""
    found = sorted([(a, b, "<email>") for a, b in mail_spans(text)] + [(m.start(), m.end(), "<number>") for m in NUMBER.finditer(text)])
    out: list[tuple[int, int, str]] = []
    for span in found:
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


COUNTS = "n_tokens bigint, n_chunks bigint, n_edits bigint, n_reencoded bigint, n_tokens_after bigint, edited string"


def _recount(path: str, edits: Callable[[str], list[tuple[int, int, str]]], texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        count = counter(encoder)
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1)):
                encoder.renew()
                rows = []
                for text in texts:
                    tree = TokenTree(text, count)
                    n, first = tree.total, tree.encoded
                    spans = edits(text)
                    for start, end, new in reversed(spans):
                        tree.edit(start, end, new)
                    rows.append((n, first, len(spans), tree.encoded - first, tree.total, tree.text() if texts_out else None))
                kinds = [pa.int64()] * 5 + [pa.string()]
                made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                names = ["n_tokens", "n_chunks", "n_edits", "n_reencoded", "n_tokens_after", "edited"]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in b.columns[:-1]), *made], [*b.schema.names[:-1], *names])

    return run


def recount(docs: DataFrame, ranks: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), edits: Callable[[str], list[tuple[int, int, str]]] = scrub_edits, texts_out: bool = True) -> DataFrame:
    """``carry`` columns with ``n_tokens`` of the whole text, ``n_chunks``, ``n_edits``, ``n_reencoded`` (chunks
    encoded again for all edits), ``n_tokens_after`` and, with ``texts_out``, the ``edited`` text.

    ``edits`` names the spans to replace, from the left and without overlaps. Null is the empty text, with
    no tokens. Rows that repeat and null ids pass through; an empty table gives an empty result; of
    clashing names, in whatever case, the columns made here win."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    rows = docs.select(*beside(carry, *names, "__text"), F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + [COUNTS])
    out = rows.mapInArrow(_recount(ranks, edits, texts_out), schema)
    return out if texts_out else out.drop("edited")


TREES = "tree bigint, block int, text string, chunk_chars array<int>, chunk_tokens array<int>, encoded bigint"


def _leaves(tree: TokenTree) -> list[tuple[int, str, list[int], list[int], int]]:
    """Rows of ``TREES`` after the first column; empty blocks are left out but for an empty text's one."""
    held = [(c, t) for c, t in tree.blocks if c] or [([], [])]
    return [(i, "".join(c), list(map(len, c)), list(t), 0 if i else tree.encoded) for i, (c, t) in enumerate(held)]


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1)):
                encoder.renew()
                found = [_leaves(TokenTree(t, counter(encoder))) for t in texts]
                rows = pa.array([at + i for i, x in enumerate(found) for _ in x], pa.int64())
                made = [pa.array(c, k) for c, k in zip(zip(*(r for x in found for r in x)), kinds)]
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:-1]), *made], [*b.schema.names[:-1], "block", "text", "chunk_chars", "chunk_tokens", "encoded"])

    return run


def build_trees(docs: DataFrame, ranks: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``TREES``: the leaves of every document's tree, ``BLOCK`` chunks or so to a row, written once.

    ``tree`` numbers the rows of ``docs``, so null and repeated ids have trees of their own. ``encoded`` holds, in a
    tree's first row, how many chunks were encoded to make it. Null is the empty text, which has one empty block; an
    empty table gives no rows; of clashing names, in whatever case, the columns made here win."""
    names = [x.split()[0] for x in TREES.split(", ")]
    rows = docs.select(*beside(carry, *names, "__text"), F.monotonically_increasing_id().alias("tree"), F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + [TREES.partition(", ")[2]])
    return settle(rows.mapInArrow(_build(ranks), schema), "token-trees")


def _edited(path: str, columns: list[str]):
    def run(leaves: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        if not len(leaves):
            return pd.DataFrame(columns=columns)
        leaves = leaves.sort_values("block")
        blocks = []
        for text, sizes, tokens in zip(leaves["text"], leaves["chunk_chars"], leaves["chunk_tokens"]):
            ends = list(accumulate(map(int, sizes), initial=0))
            blocks.append(([text[a:b] for a, b in zip(ends, ends[1:])], list(map(int, tokens))))
        encoder = byte_encoder(path)
        encoder.renew()
        tree = TokenTree.kept(blocks, counter(encoder))
        spans, done = [], 0
        for start, end, new in sorted(zip(edits["start"], edits["end"], edits["new"].where(edits["new"].notna(), "")), key=lambda x: x[:2]):
            backwards = end < start
            start, end = max(0, min(int(start), tree.length)), max(0, min(int(end), tree.length))
            if not backwards and start >= done:
                spans.append((start, end, new))
                done = end
        for span in reversed(spans):
            tree.edit(*span)
        out = pd.DataFrame(_leaves(tree), columns=["block", "text", "chunk_chars", "chunk_tokens", "encoded"])
        for c in columns:
            if c not in out:
                out[c] = leaves[c].iloc[0]
        return out[columns]

    return run


def apply_edits(trees: DataFrame, edits: DataFrame, ranks: str) -> DataFrame:
    """The table of trees after a batch of edits (tree, start, end, new), each replacing the characters from ``start`` to
    ``end`` (exclusive) of its text as it was before the batch.

    Spans are cut to the text; a null ``new`` is empty; edits with another null, of unknown trees, that end before they
    start or that begin within an earlier one of the batch do nothing. Trees without edits pass through and are not
    read in Python. No edits or no trees give the table back."""
    known = edits.dropna(subset=["tree", "start", "end"]).select("tree", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "new")
    touched = known.select("tree").distinct()
    changed = trees.join(touched, "tree", "left_semi").select(*trees.columns).groupBy("tree").cogroup(known.groupBy("tree")).applyInPandas(_edited(ranks, trees.columns), trees.schema)
    return trees.join(touched, "tree", "left_anti").select(*trees.columns).unionByName(changed)


def tree_counts(trees: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``tree``, ``n_tokens``, ``n_chunks`` and ``n_encoded`` of each tree; an empty table gives no rows."""
    sums = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
    rows = trees.groupBy("tree").agg(*[F.first(c).alias(c) for c in carry], sums("chunk_tokens").alias("n_tokens"), F.sum(F.size("chunk_chars")).alias("n_chunks"), F.sum("encoded").alias("n_encoded"))
    return rows.select(*carry, "tree", "n_tokens", "n_chunks", "n_encoded")
