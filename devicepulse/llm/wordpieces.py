"""Ids of plain words straight from a tokenizer's model.

Most words are letters, perhaps with punctuation after them. For those the normaliser
and the split rules of a tokenizer only turn letter by letter into the letters of its
model, so its model alone gives the ids. Which letters these are is asked of the
tokenizer itself; all other words, and all words of a tokenizer that does not work this
way, take its full way.
"""

from __future__ import annotations

import re
import string
import struct

import numpy as np
from tokenizers import Tokenizer

# Letters that are asked about: ASCII and Latin-1.
LETTERS = string.ascii_letters + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())


class WordIds:
    """The ids of words without white space, as little-endian bytes."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.letters = {ord(c): m for c in LETTERS if (m := self._alone(c)) is not None}
        known = "".join(re.escape(chr(c)) for c in self.letters)
        marks = re.escape(string.punctuation)
        self.plain = re.compile(f"([{known}]+)([{marks}]*)").fullmatch if known else None
        self.tails: dict[str, bytes] = {"": b""}
        if self.letters and not self._letter_by_letter():
            self.plain = None

    def _alone(self, letter: str) -> str | None:
        """What the model sees of the letter, if that does not depend on its neighbours."""
        if self.tokenizer.normalizer is None or self.tokenizer.pre_tokenizer is None:
            return None
        seen = []
        for word in (letter, f"a{letter}", f"{letter}a", f"a{letter}a"):
            given = self.tokenizer.normalizer.normalize_str(word)
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(given)
            if len(parts) != 1:
                return None
            seen.append(parts[0][0])
        own, after, before, between = seen
        a = before[len(own) :]
        return own if (after, before, between) == (a + own, own + a, a + own + a) else None

    def _letter_by_letter(self) -> bool:
        """Whether whole words and what follows them split as expected."""
        letters = "".join(map(chr, self.letters))
        words = [letters, letters[::-1], *[letters[i : i + 7] for i in range(len(letters))]]
        tails = [*string.punctuation, "...", ".)", '!"']
        probes = [word + tails[i % len(tails)] for i, word in enumerate(words)] + words
        probes += [f"ab{tail}" for tail in tails]
        return [self._plainly(w) for w in probes] == self._fully(probes)

    def _fully(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _core(self, core: str) -> bytes:
        ids = [token.id for token in self.tokenizer.model.tokenize(core)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            (ids,) = self._fully([tail])
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[tail] = ids
        return self.tails[tail]

    def _plainly(self, word: str) -> bytes:
        core, tail = self.plain(word).groups()
        return self._core(core.translate(self.letters)) + self._tail(tail)

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of each word, in order."""
        out: list[bytes] = [b""] * len(words)
        rest, cores = [], {}
        for i, word in enumerate(words):
            found = self.plain(word) if self.plain else None
            if found is None:
                rest.append(i)
                continue
            core, tail = found.groups()
            core = core.translate(self.letters)
            ids = cores.get(core)
            if ids is None:
                ids = cores[core] = self._core(core)
            out[i] = ids + self._tail(tail) if tail else ids
        for i, ids in zip(rest, self._fully([words[i] for i in rest])):
            out[i] = ids
        return out
