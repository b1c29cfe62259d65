"""Token ids through the tokenizers library, encoding each distinct chunk of text once per worker."""

from __future__ import annotations

import base64
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space, as the split patterns of the vocabularies know it (fixed values), and as a character class.
SPACES = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = "".join(map(re.escape, sorted(SPACES)))
#: Chunks whose borders are always borders of pre-tokens of a byte-level vocabulary: a run without
#: white space and the single space before it, or white space alone.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Longer chunks are encoded but not remembered; two generations of so many are (about 250 MB).
LONGEST, MOST = 64, 600_000
#: Letters that neither combine nor lower to more than one character, then symbols: two pre-tokens at most.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u0148\u014a-\u01c3\u01cd-\u01ef\u01f1-\u024f]+)([.,!?;:#*$%&|]*)")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def byte_level_tokenizer(ranks: dict[bytes, int]):
    """A tokenizers.Tokenizer that merges by rank: every way to halve a token is a merge, in the order of the ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    names = byte_characters()
    text = {token: "".join(map(names.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        halves = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(text[a], text[b]) for a, b in sorted(halves, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
    made = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


class Known(dict):
    """Ids of chunks, learned when first asked for; what the generation before knew is taken over."""

    def __init__(self, tokenizer, plain, older: dict[str, bytes] | None = None):
        self.tokenizer, self.plain, self.older = tokenizer, plain, older or {}
        self.merge, self.spelling = tokenizer.model.tokenize, {b: ord(c) for b, c in byte_characters().items()}

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, spelled as the model spells it."""
        spelled = part if part.isascii() and part[0] != " " else part.encode().decode("latin-1").translate(self.spelling)
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        ids = self.older.get(chunk)
        if ids is None:
            if m := PLAIN.fullmatch(chunk):
                word, tail = m.groups()
                word = self.plain(word)
                ids = self.get(word)
                if ids is None:
                    ids = self[word] = self._part(word)
                if tail:
                    more = self.get(tail)
                    if more is None:
                        more = self[tail] = self._part(tail)
                    ids += more
            else:
                ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, from remembered ids of their chunks.

    ``plain`` says how the vocabulary spells a plain chunk's pre-tokens; their merges are asked of the
    model itself, which skips the work that only other chunks need."""

    def __init__(self, tokenizer, split, plain, most: int = MOST):
        self.tokenizer, self.split, self.plain, self.most = tokenizer, split, plain, most
        self.known = Known(tokenizer, plain)

    def renew(self) -> None:
        """Start a new generation if this one is full."""
        if len(self.known) > self.most:
            self.known = Known(self.tokenizer, self.plain, dict(self.known))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.renew()
        get = self.known.__getitem__
        return [b"".join(map(get, self.split(x))) for x in texts]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def byte_encoder(path: str) -> ChunkEncoder:
    """For a rank file; one per worker and file."""
    if ("byte", path) not in _ENCODERS:
        _ENCODERS["byte", path] = ChunkEncoder(byte_level_tokenizer(read_ranks(path)), CHUNK.findall, str)
    return _ENCODERS["byte", path]


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def word_encoder(path: str, most: int = MOST) -> ChunkEncoder:
    """For a vocabulary file whose tokenizer drops white space; one per worker, file and ``most``.

    White space always ends a pre-token there, so texts are cut at spaces and line ends."""
    if ("word", path, most) not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS["word", path, most] = ChunkEncoder(Tokenizer.from_file(path), split_words, str.lower, most)
    return _ENCODERS["word", path, most]


def beside(columns, *made: str) -> list[str]:
    """``columns`` without those whose names clash with the columns ``made``; Spark's names know no case."""
    taken = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in taken]


def slices(texts, size: int = 4 << 20, empty: str | bytes = ""):
    """(start, list of str) runs of an Arrow string column, of about ``size`` bytes; null is the ``empty`` text."""
    held, at, n = [], 0, 0
    for x in texts:
        s = x.as_py() or empty
        held.append(s)
        n += len(s)
        if n >= size:
            yield at, held
            at, held, n = at + len(held), [], 0
    if held:
        yield at, held
