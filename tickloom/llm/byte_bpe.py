"""Byte-level BPE: encoding with ids and offsets, and decoding, over Arrow batches.

The tokenizers library does the merges. A byte-level vocabulary spells bytes as printable characters;
``byte_characters`` is that table, offsets are counted in bytes through it, and decoding reverses it, so
that characters whose bytes lie in different tokens come back whole.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tokens import beside, byte_characters, byte_encoder, slices

ENCODED = "n_tokens bigint, ids_le binary, decoded binary"
OFFSETS = "starts_le binary, ends_le binary"

_BYTES: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, from the vocabulary's spelling through the reversed byte table."""
    if path not in _BYTES:
        back = {c: b for b, c in byte_characters().items()}
        words = byte_encoder(path).tokenizer.get_vocab()
        table = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            table[i] = bytes(map(back.__getitem__, word))
        _BYTES[path] = table
    return _BYTES[path]


def decode_bytes(ids_le: bytes, path: str) -> bytes:
    """The bytes that the ids stand for; an id the vocabulary lacks stands for U+FFFD, as broken bytes do."""
    table = token_bytes(path)
    ids = np.frombuffer(ids_le[: len(ids_le) // 4 * 4], "<u4").tolist()
    return b"".join([table[i] if i < len(table) else "\ufffd".encode() for i in ids])


def decode_stream(parts: Iterator[bytes], path: str) -> Iterator[str]:
    """Text of successive runs of ids; a character split between runs comes with the later one, broken bytes as U+FFFD."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield reader.decode(decode_bytes(part, path))
    yield reader.decode(b"", final=True)


def _encode(path: str, decode: bool, offsets: bool, extra: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = byte_encoder(path), token_bytes(path)
        widths = np.asarray([len(x) for x in table], "int64")
        for b in batches:
            for at, texts in slices(b.column(b.num_columns - 1)):
                ids = encoder.encode(texts)
                arrays = [c.slice(at, len(texts)) for c in b.columns[:-1]]
                names = list(b.schema.names[:-1])
                arrays += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names += ["n_tokens", "ids_le"]
                if decode:
                    arrays.append(pa.array([b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids], pa.binary()))
                    names.append("decoded")
                if offsets:
                    ends = [np.cumsum(widths[np.frombuffer(x, "<u4")]) for x in ids]
                    starts = [np.concatenate([[0], e[:-1]]) if len(e) else e for e in ends]
                    arrays += [pa.array([x.astype("<u4").tobytes() for x in s], pa.binary()) for s in (starts, ends)]
                    names += ["starts_le", "ends_le"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode(docs: DataFrame, ranks: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), decode: bool = False, offsets: bool = False) -> DataFrame:
    """``carry`` columns with ``n_tokens`` and ``ids_le`` (little-endian unsigned 32-bit ids) of every whole text.

    ``decode`` adds ``decoded``, the bytes got back from the ids; ``offsets`` adds ``starts_le`` and
    ``ends_le``, each token's byte span. Null is the empty text, which has no tokens. Special tokens are
    ordinary text. Rows that repeat and null ids pass through; an empty table gives an empty result;
    of clashing names, in whatever case, the columns made here win."""
    made = ["n_tokens", "ids_le"] + ["decoded"] * decode + ["starts_le", "ends_le"] * offsets
    carry = beside(carry, *made, "__text")
    kinds = {"n_tokens": "bigint"}
    rows = docs.select(*carry, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + [f"{c} {kinds.get(c, 'binary')}" for c in made])
    return rows.mapInArrow(_encode(ranks, decode, offsets), schema)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if x is None else decode_bytes(x, path) for x in b.column(b.num_columns - 1).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary()), pa.array(text, pa.string())], [*b.schema.names[:-1], "decoded", "decoded_text"])

    return run


def decode(rows: DataFrame, ranks: str, ids_col: str = "ids_le", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``decoded`` bytes and ``decoded_text`` (invalid bytes as U+FFFD).

    Null ids give nulls, no ids the empty text; an id the vocabulary lacks gives U+FFFD, and up to three bytes that
    make no whole id are left out. Rows that repeat and null ids pass through; an empty table gives an empty
    result; of clashing names, in whatever case, the columns made here win."""
    held = rows.select(*beside(carry, "decoded", "decoded_text", "__ids"), F.col(ids_col).alias("__ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema[:-1]] + ["decoded binary", "decoded_text string"])
    return held.mapInArrow(_decode(ranks), schema)
