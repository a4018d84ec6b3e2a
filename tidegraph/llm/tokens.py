"""Helpers around a public byte-level BPE vocabulary, read with the tokenizers library.

Vocabulary files are parameters (a path or the JSON itself) and are read on the driver, so that
tasks need no file. Pre-tokens (the pieces the pre-tokenizer cuts a text into) are encoded
independently of each other, which both the counting and the encoding operators build on.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

VOCABULARY = "byte_bpe_50k.json"

# fixed value: the byte-level pre-tokenizer's pattern
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Up to here the pattern's classes are the same in every Unicode version from 12 on; texts with
# other characters are cut by the library itself.
COMMON = regex.compile(r"[^\x00-՗]")
MOST_CACHED = 200_000
MOST_CACHED_CHARS = 64


def vocabulary(path: str | None = None) -> str:
    """The JSON of a vocabulary file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def codec(json: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(json)


class Codec:
    """Encodes pre-tokens, remembering the frequent ones, and knows every token's bytes."""

    def __init__(self, json: str):
        self.library = Tokenizer.from_str(json)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        if self.library.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only vocabularies without normalizer and with plain added tokens are supported")
        self.special = {t.content: i for i, t in added.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.cache: dict[str, bytes] = {}
        self.characters = byte_characters()
        self.model = self.library.model

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at odd places."""
        return self.special_pattern.split(text) if self.special_pattern and any(s in text for s in self.special) else [text]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if COMMON.search(text) is None:
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def bpe(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self.model.tokenize(data.decode("latin-1").translate(self.characters))]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, as bytes of 32-bit integers."""
        return {w: _bytes(self.bpe(w.encode())) for w in words}

    def known(self, words: list[str]):
        """A function from each of the pre-tokens to its ids; those not yet known are encoded."""
        distinct, own = set(words), {}
        if missing := distinct.difference(self.cache):
            if len(self.cache) + len(missing) > MOST_CACHED:
                self.cache, missing = {}, distinct
            new = self.encode_words(missing)
            own = {w: i for w, i in new.items() if len(w) > MOST_CACHED_CHARS}
            self.cache.update((w, i) for w, i in new.items() if len(w) <= MOST_CACHED_CHARS)
        cache = self.cache
        return cache.__getitem__ if not own else lambda w: cache[w] if w in cache else own[w]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as bytes of 32-bit integers."""
        parts = []
        for k, s in enumerate(self.segments(text)):
            words = [] if k % 2 else self.words(s)
            parts.append(_bytes([self.special[s]]) if k % 2 else b"".join(map(self.known(words), words)))
        return b"".join(parts)

    @property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        if not hasattr(self, "_token_bytes"):
            to_byte = {c: b for b, c in byte_characters().items()}
            size = self.library.get_vocab_size(with_added_tokens=True)
            tokens = [self.library.id_to_token(i) or "" for i in range(size)]
            self._token_bytes = [bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t in tokens]
        return self._token_bytes


def _bytes(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the others get characters from 256 on, in order."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + n) for n, b in enumerate(rest)}
