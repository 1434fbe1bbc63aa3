"""Token counts by greedy longest match, in one pass over the bytes of a word.

The pieces of the vocabulary form a trie. A node that has no child for the next byte
falls back along its failure link, to the node that stands for what is left once the
longest pieces at the front of its string are taken; how many these are is stored with
the link. So each byte is read once and no piece is built.

Text is lower-cased and split into runs of letters, single digits and runs of other
characters, none of which holds white space. Where the vocabulary marks word ends, the
last byte of a word is a symbol of its own: marked pieces match there alone, others only
before it. A word with a byte that no piece covers counts as one token.

Results that are defined for odd input: NULL and empty text has no tokens; very long
texts are read whole; repeated rows get equal counts; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from devicepulse.llm.perword import PerWord
from devicepulse.llm.shared import small_batches

WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
ROOT, NOWHERE = 0, -1
# A byte that ends a word is this much above its value.
LAST = 256


class LongestMatch:
    """Greedy counts over a vocabulary of non-empty strings of bytes, last bytes or both."""

    def __init__(self, pieces: list[Sequence[int]]):
        self.child: dict[int, int] = {}
        whole, made = set(), [(ROOT, 0, ROOT)]  # (parent, byte, node), parents first
        for piece in sorted({tuple(p) for p in pieces}, key=len):
            node = ROOT
            for byte in piece:
                step = node << 9 | byte
                if step not in self.child:
                    self.child[step] = len(made)
                    made.append((node, byte, len(made)))
                node = self.child[step]
            whole.add(node)
        self.link, self.popped = [NOWHERE] * len(made), [0] * len(made)
        depth = [0] * len(made)
        for parent, _, node in made[1:]:
            depth[node] = depth[parent] + 1
        for parent, byte, node in sorted(made[1:], key=lambda m: depth[m[2]]):
            if node in whole:
                self.link[node], self.popped[node] = ROOT, 1
                continue
            at, count = self.link[parent], self.popped[parent]
            while at != NOWHERE and (at << 9 | byte) not in self.child:
                at, count = self.link[at], count + self.popped[at]
            if at != NOWHERE:
                self.link[node], self.popped[node] = self.child[at << 9 | byte], count

    def count(self, word: Sequence[int]) -> int:
        """How many pieces the greedy match takes; 1 if it cannot cover ``word``."""
        child, link, popped, node, count = self.child, self.link, self.popped, ROOT, 0
        for byte in word:
            step = child.get(node << 9 | byte)
            while step is None:
                count += popped[node]
                node = link[node]
                if node == NOWHERE:
                    return 1
                step = child.get(node << 9 | byte)
            node = step
        while node != ROOT:
            count += popped[node]
            node = link[node]
            if node == NOWHERE:
                return 1
        return count


def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def ended(word: bytes) -> tuple[int, ...]:
    """The bytes of a non-empty word, its last one as a last byte."""
    return (*word[:-1], word[-1] + LAST)


def vocabulary(path: str) -> tuple[list[tuple[int, ...]], bool]:
    """The pieces of a byte-level vocabulary file without special tokens, and whether
    the file marks those that end a word."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    mark = data["model"].get("end_of_word_suffix") or ""
    byte = _byte_of_char()
    pieces = []
    for piece in data["model"]["vocab"].keys() - special:
        ends = bool(mark) and piece.endswith(mark)
        raw = bytes(byte[c] for c in (piece.removesuffix(mark) if ends else piece))
        if raw:
            pieces.append(ended(raw) if ends else tuple(raw))
    return pieces, bool(mark)


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> PerWord:
    """Kept by a Python worker for all its tasks."""
    pieces, marked = vocabulary(path)
    automaton = LongestMatch(pieces)

    @functools.lru_cache(maxsize=200_000)
    def known(part: str) -> int:
        raw = part.encode("utf-8", "surrogatepass")
        return automaton.count(ended(raw) if marked else raw)

    def count(word: str) -> int:
        return sum(map(known, WORD.findall(word.lower())))

    return PerWord(lambda words: [count(w) for w in words])


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id and ``n_tokens`` of every row of ``docs``; ``path`` names a vocabulary file
    that is installed on every machine."""
    small_batches(docs.sparkSession)
    narrow = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType([narrow.schema[0]]).add("n_tokens", "long")

    def batches(frames):
        counter = _counter(path)
        for frame in frames:
            sums = [sum(values) for values in counter.each(frame["text"].tolist())]
            yield pd.DataFrame({id_col: frame[id_col], "n_tokens": pd.Series(sums, dtype="int64")})

    return narrow.mapInPandas(batches, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
