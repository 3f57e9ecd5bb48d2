"""Token ids by the tokenizers library, word by word, with a memory for words seen before.

The vocabulary's normaliser and pre-tokeniser never look across white space, so the ids of a
text are those of its white-space separated pieces in turn. Most pieces repeat; only new ones
reach the library.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Callable, Sequence

import numpy as np

#: Words that a worker remembers before it starts anew, some 200 bytes each, and words looked up at a time.
MEMORY, AT_ONCE = 600_000, 200_000


#: A plain word and what may follow it: both are tokens of their own to the pre-tokeniser.
PLAIN = re.compile(rb"([a-z]+)([.,;:!?%&*$#|]{0,4})")
TYPE = {2: "H", 4: "I"}


class WordMemory:
    """Encoded words, each made once; ``make`` encodes new ones."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]]) -> None:
        self.make = make
        self.known: dict[bytes, bytes] = {}

    def encoded(self, words: list[bytes]) -> list[bytes]:
        parts = list(map(self.known.get, words))
        missing = [i for i, p in enumerate(parts) if p is None]
        if missing:
            if len(self.known) > MEMORY:
                self.known = {}
            new = list({words[i] for i in missing})
            self.known.update(zip(new, self.make(new), strict=True))
            for i in missing:
                parts[i] = self.known[words[i]]
        return parts

    def texts(self, texts: Sequence[list[bytes]]) -> list[bytes]:
        """Each text's words, encoded and joined; some texts are looked up together."""
        out: list[bytes] = []
        held: list[list[bytes]] = []
        n = 0

        def flush() -> None:
            parts = self.encoded([w for words in held for w in words])
            at = 0
            for words in held:
                out.append(b"".join(parts[at : at + len(words)]))
                at += len(words)

        for words in texts:
            if len(words) > AT_ONCE:
                flush()
                slices = (self.encoded(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE))
                out.append(b"".join(p for part in slices for p in part))
                held, n = [], 0
                continue
            held.append(words)
            n += len(words)
            if n > AT_ONCE:
                flush()
                held, n = [], 0
        flush()
        return out


def lowered(raw: bytes) -> bytes:
    """The text with A-Z lowered, which a lowering vocabulary does anyway, so that fewer words differ.

    Left alone where it could matter: special tokens, and marks that combine with a lower letter only.
    """
    return raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()


class Encoder:
    """Ids of texts under one lowering vocabulary file; ``width`` is the bytes of one id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.memory = WordMemory(self.make)
        self.lowers = self.whole("AZ") == self.whole("az")
        # Plain words pass the normaliser and the pre-tokeniser unchanged: the model alone will do.
        self.plain = all(self.whole(w) == self.model(w) for w in ("a", "zq", "tokens")) and self.whole("ab,.") == self.whole("ab") + self.whole(",.")
        self.tails: dict[bytes, bytes] = {b"": b""}

    def packed(self, ids: list[int]) -> bytes:
        return array(TYPE[self.width], ids).tobytes()

    def whole(self, word: str) -> bytes:
        return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def model(self, word: str) -> bytes:
        return self.packed([t.id for t in self.tokenizer.model.tokenize(word)])

    def make(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: a plain stem by the model and its punctuation apart, others by the whole tokeniser."""
        out: list[bytes | None] = [None] * len(words)
        tokenize, known = self.tokenizer.model.tokenize, self.memory.known
        for i, word in enumerate(words if self.plain else []):
            if match := PLAIN.fullmatch(word):
                stem, tail = match.groups()
                if tail not in self.tails:
                    self.tails[tail] = self.whole(tail.decode())
                own = known.get(stem) if tail else None
                out[i] = (own or self.packed([t.id for t in tokenize(stem.decode())])) + self.tails[tail]
        rest = [i for i, own in enumerate(out) if own is None]
        found = self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = self.packed(e.ids)
        return out

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian ids of ``width`` bytes each, per text."""
        raw = ((t or "").encode() for t in texts)
        return self.memory.texts([(lowered(r) if self.lowers else r).split() for r in raw])

    def one(self, value: int) -> bytes:
        return np.array([value], self.dtype).tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
