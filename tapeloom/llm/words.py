"""Ids of public tokenizers, with words that recur encoded once per worker.

Byte-pair merges never cross a piece of the tokenizer's own splitting pattern, so a text may be cut at places where
every piece ends for certain: ASCII white space. What lies between is encoded by the library and remembered. Texts
with characters for which that certainty is missing go through the library whole; the ids are equal either way.
"""
from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

from tapeloom.llm.common import once

#: White space beyond ASCII and control characters that libraries class differently, as UTF-8.
EXOTIC = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]
SPACES = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
#: A run of white space and the run of other characters after it.
CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Words that one worker remembers (some 60 MB), of those that have come before; others are encoded anew. Which have come
#: before is known by a byte for each hash.
REMEMBERED = 300_000
SEEN = 1 << 22
#: ASCII marks; after letters a run of them is one piece in either vocabulary's pattern.
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Runs of marks that one worker remembers.
RUNS = 10_000
#: First bytes of characters from U+0100 on.
HIGH = re.compile(rb"[\xc4-\xff]")
# fixed value: letters and numbers below U+0100, for patterns that name them by Unicode class
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def exotic(raw: bytes) -> bool:
    return any(x in raw for x in EXOTIC) or b"\xe2\x80" in raw and SPACES.search(raw) is not None


class Memo:
    """Encodes texts word by word; only words not remembered reach the library, all of a batch at once."""

    def __init__(self, text: str, pattern: str, lower: bool) -> None:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.np = np
        self.whole = Tokenizer.from_str(text)
        self.bare = Tokenizer(self.whole.model)  # merges only
        self.letters = _byte_letters()
        self.end, = self.bare.encode([self.letters[0]], is_pretokenized=True, add_special_tokens=False).ids
        self.pieces, self.lower = re.compile(pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", NUMBERS)).findall, lower
        self.tails: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN)

    def library(self, text: str | bytes) -> bytes:
        text = text.decode() if isinstance(text, bytes) else text
        return self.np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters_of(self, plain: bytes) -> str | None:
        """A word of nothing but letters below U+0100 as the vocabulary spells it, else nothing."""
        if plain.isalpha():  # ASCII letters, by far the most
            return plain.decode()
        if plain.isascii() or HIGH.search(plain) or not (s := plain.decode()).isalpha():
            return None
        return (s.lower() if self.lower else s).encode().decode("latin-1").translate(self.letters)

    def tail(self, marks: bytes) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self.np.array(self.bare.encode([marks.decode()], is_pretokenized=True, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.tails) < RUNS:
                self.tails[marks] = ids
        return ids

    def marked(self, w: bytes, ids: list, at: int) -> bool:
        """Whether a word is known ASCII letters and marks after them; if so, its ids are put in their place."""
        base = w.rstrip(MARKS)
        known = self.words.get(base) if len(base) < len(w) and base.isalpha() and b"<|" not in w else None
        if known is None:
            return False
        ids[at] = known + self.tail(w[len(base):])
        return True

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not remembered. A zero byte as a piece of its own ends each word's ids."""
        np, got, shapes, owners = self.np, {}, [], []
        space, end = self.letters[0x20], self.letters[0]
        before, tailed, named, letters_of = self.before and space, [], set(), self.letters_of
        for w in words:
            plain = w.lower() if self.lower else w
            bare = plain.rstrip(MARKS)
            marked = len(bare) < len(w)
            base = w[:len(bare)] if marked else w
            if marked and base in self.words and bare.isalpha() and b"<|" not in w:
                tailed.append((base, w))
                continue
            piece = letters_of(bare) if bare else None
            if piece is not None and not (marked and b"<|" in w):  # a word that may be known without its marks
                if base not in named and not (marked and base in self.words):
                    named.add(base)
                    owners.append(base)
                    shapes += (before + piece, end)
                if marked:
                    tailed.append((base, w))
                continue
            s = self.shown(w).decode()
            if not s.isascii() and max(s) >= "\u0100" or "<|" in s or "\0" in s:
                got[w] = self.library(s)  # special tokens, or letters that libraries may lower or class differently
            else:
                owners.append(w)
                for x in self.pieces(s.lower() if self.lower else s):
                    shapes.append(x.replace(" ", space) if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.letters))
                shapes.append(end)
        if owners:
            ids = np.array(self.bare.encode_batch_fast([shapes], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.end)
            assert len(ends) == len(owners)
            raw, stops = ids.tobytes(), (4 * ends).tolist()
            got.update(zip(owners, [raw[a:b] for a, b in zip([0, *(b + 4 for b in stops)], stops)]))
        for base, w in tailed:
            ids = self.words.get(base) or got[base]
            if len(self.words) < REMEMBERED:
                self.words[base] = ids
            got[w] = ids + self.tail(w[len(base):])
        return got

    def __call__(self, texts: list[str] | list[bytes]) -> list[bytes]:
        """Ids of each text, given as such or in UTF-8, as little-endian unsigned 32-bit integers."""
        gc.disable()  # many small objects and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str] | list[bytes]) -> list[bytes]:
        got: list = []
        missing: list[bytes] = []
        get, full = self.words.get, len(self.words) >= REMEMBERED
        for t in texts:
            words = self.split(t)
            if words is None:
                got.append(self.library(t))
                continue
            ids = list(map(get, words))
            unknown = list(compress(range(len(ids)), map(is_, ids, repeat(None))))
            if unknown and full:  # words with marks won't be remembered, but most are known without
                unknown = [i for i in unknown if not self.marked(words[i], ids, i)]
            if unknown:
                fresh = [words[i] for i in unknown]
                missing += fresh
                got.append((ids, unknown, fresh))
            else:
                got.append(b"".join(ids))
        if not missing:
            return got
        times = Counter(missing)
        learnt = self.learn(list(times))
        if len(self.words) < REMEMBERED:
            seen, words = self.seen, self.words
            for w, n in times.items():
                if n > 1 or seen[hash(w) % SEEN]:
                    words[w] = learnt[w]
                else:
                    seen[hash(w) % SEEN] = 1
        for k, g in enumerate(got):
            if not isinstance(g, bytes):
                ids, unknown, own = g
                for i, w in zip(unknown, own):
                    ids[i] = learnt[w]
                got[k] = b"".join(ids)
        return got


class LowerWords(Memo):
    """For the lower-casing vocabulary, whose pattern drops white space: words are independent of each other."""

    before = ""

    def __init__(self, text: str) -> None:
        # fixed value: the split pattern inside the vocabulary file
        super().__init__(text, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", True)

    def shown(self, word: bytes) -> bytes:
        return word

    def split(self, text: str | bytes) -> list[bytes] | None:
        """Keys of the words; none if the text must go through the library whole."""
        raw = text if isinstance(text, bytes) else text.encode()
        if exotic(raw):
            return None
        return raw.split() if b"<|" in raw else raw.lower().split()


class ByteWords(Memo):
    """For the byte-level vocabulary: a piece may take one space before it, never any after it."""

    before = " "

    def __init__(self, text: str) -> None:
        # fixed value: the public split pattern of this vocabulary
        super().__init__(text, r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", False)

    def shown(self, word: bytes) -> bytes:
        """A key after a line break stands for itself, one marked by a zero byte for a new line, any other for a space and itself."""
        if word[:1] == b"\n":
            return word[1:]
        return b"\n" + word[1:] if word[:1] == b"\0" else b" " + word

    def split(self, text: str | bytes) -> list[bytes] | None:
        raw = text if isinstance(text, bytes) else text.encode()
        if exotic(raw):
            return None
        if b"  " in raw or b" \n" in raw or b"\n " in raw or b"\n\n" in raw or raw[-1:] in (b" ", b"\n") or any(c in raw for c in (b"\t", b"\r", b"\x0b", b"\x0c")):
            return [b"\n" + c for c in CHUNK.findall(raw)]
        first, *rest = raw.replace(b"\n", b" \0").split(b" ") if b"\0" not in raw else [raw]
        return [b"\n" + first, *rest] if first else rest


def encoder(kind: str, json_text: str) -> Memo:
    """The worker's encoder, of kind ``lower_words`` or ``byte_words``: texts in, ids as bytes out."""
    return once((kind, len(json_text), hash(json_text)), lambda: {"lower_words": LowerWords, "byte_words": ByteWords}[kind](json_text))


def in_parts(texts: list, most: int = 2 << 20) -> Iterator[list]:
    """Some texts at a time, of about so many characters or bytes together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
