"""Packing of documents into sequences of bounded length by bin completion.

Documents are turned into ids by a public tokenizer and cut into pieces only where they
are longer than a sequence. How many pieces have which length is a table of at most as
many rows as a sequence has tokens, whatever the number of documents; the search runs
on that table. It takes the largest length that is left, enumerates undominated
fillings of the room beside it, applies the chosen one as often as the counts allow,
and goes on. Best-fit decreasing gives the first incumbent. A branch ends when the
waste so far shows that it cannot beat the incumbent, and the search ends when a
solution meets the lower bound or after ``BRANCHES`` completions.

Each piece finds its place by its rank among the pieces of its length; the ranks come
from running sums over slices, so no task holds all pieces of a frequent length.

Results that are defined for odd input: NULL and empty text is one piece with the end
token only; very long texts give many full pieces; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from devicepulse.llm.perword import REMEMBERED, PerWord
from devicepulse.llm.shared import ranked, small_batches, written
from devicepulse.llm.wordpieces import WordIds

END_ID = 1
# Steps of the search for fillings of one sequence, and completions tried in all.
NODES = 400
BRANCHES = 20_000


@functools.lru_cache(maxsize=2)
def _encoder(path: str, remembered: int) -> PerWord:
    """Ids per word as little-endian bytes. Nothing in the tokenizer's rules reaches
    across a space, so the ids of a text are those of its words in a row. Kept by a
    Python worker for all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return PerWord(WordIds(Tokenizer.from_file(path)), remembered)


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Per piece: id of the document, number and start of the piece, its length and the
    CRC-32 of its ids."""
    small_batches(docs.sparkSession)
    narrow = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["piece", "start", "length", "ids_crc32"]
    schema = StructType([narrow.schema[0]])
    for name in names:
        schema = schema.add(name, "integer" if name == "piece" else "long")
    end = np.array([END_ID], "<u4").tobytes()
    width = 4 * capacity

    def batches(frames):
        encoder = _encoder(path, remembered)
        for frame in frames:
            rows, owner = [], []
            for place, parts in enumerate(encoder.each(frame["text"].tolist())):
                data = b"".join(parts) + end
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    owner.append(place)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, id_col, frame[id_col].iloc[owner].reset_index(drop=True))
            yield out

    return narrow.mapInPandas(batches, schema)


@dataclass
class Pattern:
    """Lengths, largest first, that ``times`` sequences hold."""

    lengths: tuple[int, ...]
    times: int


class BinCompletion:
    """Search for a packing of ``counts`` (length to number) into few sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(not 0 < n <= capacity for n in counts):
            raise ValueError("lengths must lie between 1 and the capacity")
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)
        self.total = sum(n * c for n, c in self.left.items())

    def lower_bound(self) -> int:
        """Sequences needed by the sum, and by the lengths over half a sequence."""
        large = sum(c for n, c in self.left.items() if 2 * n > self.capacity)
        return max(-(-self.total // self.capacity), large)

    def _below(self, limit: int) -> Iterator[int]:
        """Lengths that are left, at most ``limit``, largest first."""
        for i in range(bisect_right(self.lengths, limit) - 1, -1, -1):
            if self.left[self.lengths[i]]:
                yield self.lengths[i]

    def fillings(self, room: int, most: int = 4) -> list[tuple[int, ...]]:
        """Undominated fillings of ``room``, those with the least waste first.

        One length that fits exactly dominates everything else in its place, and a
        filling that still had room for a length that it passed over is dominated by
        the one with it.
        """
        found: list[tuple[int, tuple[int, ...]]] = []
        nodes = NODES

        def search(room: int, limit: int, chosen: tuple[int, ...], passed: int) -> None:
            nonlocal nodes
            nodes -= 1
            used = chosen.count(room)
            if room <= limit and self.left.get(room, 0) > used:
                found.append((0, (*chosen, room)))
                return
            fits = False
            for length in self._below(min(room, limit)):
                if self.left[length] <= chosen.count(length):
                    continue
                fits = True
                search(room - length, length, (*chosen, length), passed)
                passed = min(passed, length)
                if nodes <= 0 or sum(waste == 0 for waste, _ in found) >= most:
                    return
            if not fits and room < passed:
                found.append((room, chosen))

        search(room, room, (), room + 1)
        found.sort(key=lambda f: (f[0], [-n for n in f[1]]))
        return list(dict.fromkeys(f for _, f in found))[:most]

    def _greedy(self, largest: int) -> tuple[int, ...]:
        """The largest lengths that still fit beside ``largest``."""
        chosen, room, limit = [largest], self.capacity - largest, self.capacity
        while True:
            for length in self._below(min(room, limit)):
                spare = self.left[length] - chosen.count(length)
                if spare:
                    take = min(spare, room // length)
                    chosen += [length] * take
                    room, limit = room - take * length, length - 1
                    break
            else:
                return tuple(chosen)

    def _apply(self, pattern: tuple[int, ...]) -> Pattern:
        need = {n: pattern.count(n) for n in set(pattern)}
        times = min(self.left[n] // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * times
        return Pattern(pattern, times)

    def _undo(self, step: Pattern) -> None:
        for n in step.lengths:
            self.left[n] += step.times

    def _best_fit(self) -> list[Pattern]:
        steps = []
        while (largest := next(self._below(self.capacity), None)) is not None:
            steps.append(self._apply(self._greedy(largest)))
        for step in steps:
            self._undo(step)
        return steps

    def solve(self) -> list[Pattern]:
        """The best packing found."""
        best = self._best_fit()
        fewest, bound = sum(s.times for s in best), self.lower_bound()
        path: list[Pattern] = []
        open_: list[Iterator[tuple[int, ...]]] = []
        waste, branches = 0, BRANCHES
        while fewest > bound and branches:
            largest = next(self._below(self.capacity), None)
            if largest is None:
                best, fewest = list(path), sum(s.times for s in path)
            else:
                self.left[largest] -= 1
                options = self.fillings(self.capacity - largest)
                self.left[largest] += 1
                open_.append(iter([(largest, *f) for f in options]))
            if largest is None:
                waste -= self._back(path)
            # Take the next completion that may still beat the incumbent.
            while open_ and branches:
                option = next(open_[-1], None)
                if option is None:
                    open_.pop()
                    if path:
                        waste -= self._back(path)
                    continue
                branches -= 1
                step = self._apply(option)
                lost = step.times * (self.capacity - sum(step.lengths))
                if self.total + waste + lost > (fewest - 1) * self.capacity:
                    self._undo(step)
                    continue
                path.append(step)
                waste += lost
                break
            if not open_:
                break
        return best

    def _back(self, path: list[Pattern]) -> int:
        step = path.pop()
        self._undo(step)
        return step.times * (self.capacity - sum(step.lengths))


class Places:
    """For the piece of rank r among those of its length: sequence and offset."""

    def __init__(self, plan: list[Pattern]):
        rows, first, begun = [], 0, {}
        for step in plan:
            at = 0
            for length in dict.fromkeys(step.lengths):
                times = step.lengths.count(length)
                rank = begun.get(length, 0)
                rows.append((length, rank, times, first, at))
                begun[length] = rank + times * step.times
                at += times * length
            first += step.times
        rows.sort()
        table = np.array(rows, np.int64).reshape(len(rows), 5)
        self.length, self.rank, self.times, self.first, self.at = table.T
        self.key = self._key(self.length, self.rank)

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << np.int64(48)) + rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, self._key(length, rank), "right") - 1
        into = rank - self.rank[row]
        sequence = self.first[row] + into // self.times[row]
        return sequence, self.at[row] + into % self.times[row] * length


def pack(rows: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``rows``, which are read several times."""
    counts = rows.groupBy(length).agg(F.count("*").alias("n"))
    table = {r[0]: r[1] for r in counts.collect()}  # at most ``capacity`` rows
    places = Places(BinCompletion(table, capacity).solve())

    @pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(lengths.to_numpy(np.int64), ranks.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = ranked(rows.withColumn("_one", F.lit(1).cast("long")), [length], order, ["_one"], "ranks")
    return numbered.withColumn("_place", place(length, "_one_before")).select(
        *rows.columns, "_place.sequence_id", "_place.offset"
    )


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = REMEMBERED,
) -> DataFrame:
    """All pieces of ``docs`` with their places; ``path`` names a tokenizer file that is
    installed on every machine. A Python worker keeps the ids of up to twice
    ``remembered`` words: fewer take less memory and more time."""
    made = pieces(docs, path, capacity, id_col, text_col, remembered)
    made = written(made, "pieces")
    return pack(made, capacity, [id_col, "piece"])


def op8(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
