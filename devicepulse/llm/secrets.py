"""Secret scan: patterns for known contexts, and automata for the formats behind them.

The patterns label credentials: values assigned to telling names, access keys and long
hexadecimal runs. From a bounded sample of each kind a probabilistic automaton is
inferred: its prefix tree, in which states whose frequencies differ by no more than a
Hoeffding bound allows are merged. A state also has the probability that a token ends
there, and a format explains no token that is shorter or longer than all its labelled
ones. A further automaton stands for ordinary runs of the same characters, first of all
those at least half as long as the shortest labelled credential; sampled runs that a credential automaton explains as well as it does labelled credentials
are no part of it. Every run of the characters of the patterns, dots inside it included,
that some format may explain is then scored in every text, unless a pattern covers it
whole: by the bits per character by which the best credential automaton explains it
better than the ordinary one. The threshold is a quantile of the scores of all distinct
such runs below those of labelled credentials, so it does not move with the number of
bare credentials, and runs that reach it become spans of kind ``grammar``. Spans count
code points and exclude their end.

Results that are defined for odd input: NULL and empty text has no spans; very long
texts are read whole; repeated rows get equal spans; samples are the tokens of smallest
hash, ties by the token itself; a kind without enough labelled
examples has no automaton, and without any no ``grammar`` span is made; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from devicepulse.llm.shared import small_batches, written

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Every match of HEX or ACCESS that is kept lies in such a run.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "key")
# Runs that may be scored: the characters of ASSIGN, dots between others only, and at
# least its least length.
CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_.=-]{6})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
MOST = 1 << 62  # no run is longer
ORDINARY = "ordinary"
ADDED = "grammar"


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, credential) of the base kinds, by start and then kind."""
    found = []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end(), m[0])
            for m in ACCESS.finditer(text)
            if len(m[0]) >= LEAST["access"]
        ]
    found += [(m.start(), 2, m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return [(start, BASE[kind], end, token) for start, kind, end, token in sorted(found)]


def candidates(
    text: str, base: list[tuple[int, str, int, str]], lengths: tuple[int, int] = (6, MOST)
) -> list[tuple[int, int, str, bool]]:
    """(start, end, run, free) of the runs that no base span covers whole and whose length
    is in ``lengths``; ``free`` where they overlap none."""
    out, i = [], 0
    covered = sorted((start, end) for start, _, end, _ in base)
    reach = 0
    least, most = lengths
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        free = True
        if covered:
            while i < len(covered) and covered[i][0] <= start:
                reach = max(reach, covered[i][1])
                i += 1
            if reach >= end:
                continue
            free = reach <= start and (i == len(covered) or covered[i][0] >= end)
        if least <= end - start <= most:
            out.append((start, end, m[0], free))
    return out


@dataclass
class Automaton:
    """States 0, 1, …: how often each was visited and was the end, and its steps; the
    lengths that its tokens have."""

    visits: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    steps: list[dict[str, tuple[int, int]]] = field(default_factory=list)  # to, count
    lengths: tuple[int, int] = (0, 0)

    # Bits that a character or an end costs which the state has not seen.
    UNSEEN = 12.0

    def allows(self, token: str) -> bool:
        return self.lengths[0] <= len(token) <= self.lengths[1]

    def bits(self, token: str) -> float:
        """Negative log2 likelihood of ``token`` and its end per character."""
        state, total = 0, 0.0
        for char in token:
            step = self.steps[state].get(char)
            if step is None:
                total += self.UNSEEN
            else:
                total += math.log2((self.visits[state] + 1) / step[1])
                state = step[0]
        ends = self.ends[state]
        total += math.log2((self.visits[state] + 1) / ends) if ends else self.UNSEEN
        return total / len(token)


def infer(tokens: list[str], alpha: float = 0.05) -> Automaton:
    """Merge compatible states of the prefix tree of ``tokens``."""
    child: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    visits, ends = [0], [0]
    for token in tokens:
        node = 0
        visits[0] += 1
        for char in token:
            if char not in child[node]:
                child[node][char] = len(child)
                child.append({})
                count.append({})
                visits.append(0)
                ends.append(0)
            count[node][char] = count[node].get(char, 0) + 1
            node = child[node][char]
            visits[node] += 1
        ends[node] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) <= width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if not alike(ends[a], visits[a], ends[b], visits[b]):
                return False
            for char in child[a].keys() | child[b].keys():
                if not alike(count[a].get(char, 0), visits[a], count[b].get(char, 0), visits[b]):
                    return False
                if char in child[a] and char in child[b]:
                    stack.append((child[a][char], child[b][char]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            for char, below in child[b].items():
                count[a][char] = count[a].get(char, 0) + count[b][char]
                if char in child[a]:
                    stack.append((child[a][char], below))
                else:
                    child[a][char] = below

    kept, settled = [0], {0}
    while True:
        # The most visited state that a kept one leads to and that is not kept itself.
        edge = max(
            ((visits[t], -i, char) for i, s in enumerate(kept) for char, t in child[s].items() if t not in settled),
            default=None,
        )
        if edge is None:
            break
        parent, char = kept[-edge[1]], edge[2]
        state = child[parent][char]
        twin = next((k for k in kept if compatible(k, state)), None)
        if twin is None:
            kept.append(state)
            settled.add(state)
        else:
            child[parent][char] = twin
            fold(twin, state)
    number = {state: i for i, state in enumerate(kept)}
    return Automaton(
        [visits[s] for s in kept],
        [ends[s] for s in kept],
        [{c: (number[t], count[s][c]) for c, t in child[s].items()} for s in kept],
        (min(map(len, tokens)), max(map(len, tokens))),
    )


@dataclass
class FormatModel:
    """Automata of the credential kinds, the ordinary one, the gain from which on a run is
    like the labelled credentials, and the threshold, both in bits per character."""

    formats: list[Automaton] = field(default_factory=list)
    ordinary: Automaton | None = None
    sure: float = math.inf
    threshold: float = math.inf

    def gain(self, token: str) -> float:
        """Bits per character by which a credential format explains ``token`` better;
        minus infinity where none has tokens of this length."""
        bits = min((f.bits(token) for f in self.formats if f.allows(token)), default=math.inf)
        return self.ordinary.bits(token) - bits if bits < math.inf else -math.inf

    def lengths(self) -> tuple[int, int]:
        """Least and greatest length of what may have a gain."""
        return min(f.lengths[0] for f in self.formats), max(f.lengths[1] for f in self.formats)


LEAST_GAIN = 1.0


def _low(values: list[float], share: float = 0.01) -> float:
    return sorted(values)[int(share * len(values))]


def fit(samples: dict[str, list[str]], least: int = 5, quantile: float = 0.999) -> FormatModel:
    """Formats of the kinds and an ordinary automaton without the runs that they explain.

    A run of the ordinary sample is left out if, by the automaton of the other half, its
    gain for a kind is positive and reaches that of the labelled tokens of this kind.
    The threshold is the quantile of the gains of the sample below ``sure``, and at
    least one bit per character.
    """
    kinds = [samples[k] for k in BASE if len(samples.get(k, [])) >= least]
    plain = samples.get(ORDINARY, [])
    if not kinds or len(plain) < 2 * least:
        return FormatModel()
    formats = [infer(tokens) for tokens in kinds]
    # Labelled tokens by an automaton that has not seen them.
    unseen = []
    for tokens, whole in zip(kinds, formats):
        half = infer(tokens[::2]) if len(tokens) >= 4 * least else whole
        unseen.append([(t, half.bits(t)) for t in tokens[1::2]])
    own = {t: [f.bits(t) if f.allows(t) else math.inf for f in formats] for t in plain}

    def lows(ordinary: Automaton) -> list[float]:
        return [_low([ordinary.bits(t) - bits for t, bits in some]) for some in unseen]

    halves = [plain[::2], plain[1::2]]
    for _ in range(5):
        learned = [infer(half) for half in halves]
        kept = []
        for half, other in zip(halves, reversed(learned)):
            cuts = lows(other)
            kept.append([
                t for t in half
                if not any(g >= c and g > 0 for g, c in ((other.bits(t) - b, c) for b, c in zip(own[t], cuts)))
            ])
        if kept == halves or min(map(len, kept)) < least or 2 * sum(map(len, kept)) < len(plain):
            break
        halves = kept
    model = FormatModel(formats, infer(halves[0]))
    model.sure = max(LEAST_GAIN, min(lows(model.ordinary)))
    gains = sorted(g for g in map(model.gain, halves[1]) if g < model.sure)
    if gains:
        gains = gains[min(len(gains) - 1, int(quantile * len(gains))) :]
    model.threshold = max([LEAST_GAIN, *gains[:1]])
    return model


def _sample(docs: DataFrame, kinds: tuple[str, ...], tokens, size: int, text_col: str) -> dict[str, list[str]]:
    """Up to ``size`` distinct tokens per kind of what ``tokens`` makes of each text, those
    with the smallest hashes in the whole table. Every batch keeps as many per kind, so
    little is moved."""

    def batches(frames):
        for frame in frames:
            best: dict[str, dict[int, str]] = {k: {} for k in kinds}
            for text in frame["text"]:
                for kind, token in tokens(text):
                    best[kind][xxhash.xxh64_intdigest(token) >> 1] = token
            rows = [
                (kind, h, found[h])
                for kind, found in best.items()
                for h in heapq.nsmallest(size, found)
            ]
            yield pd.DataFrame(rows, columns=["kind", "hash", "token"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.mapInPandas(batches, "kind string, hash long, token string")
    found = written(found, "tokens").distinct()
    out = {}
    for kind in kinds:
        top = found.where(F.col("kind") == kind).orderBy("hash", "token").limit(size)
        out[kind] = [r.token for r in top.collect()]
    return out


def examples(docs: DataFrame, size: int, least: int = 5, text_col: str = "text") -> dict[str, list[str]]:
    """Up to ``size`` distinct tokens per kind, and as many ordinary runs: those at least
    half as long as the shortest token of the kinds with ``least`` or more, then shorter
    ones."""

    def labelled(text):
        return ((kind, token) for _, kind, _, token in base_spans(text))

    out = _sample(docs, BASE, labelled, size, text_col)
    sizes = [len(t) for tokens in out.values() if len(tokens) >= least for t in tokens]
    if not sizes:
        return out
    half, kinds = min(sizes) // 2, (ORDINARY, "short")

    def ordinary(text):
        runs = candidates(text, base_spans(text))
        return ((kinds[len(token) < half], token) for *_, token, free in runs if free)

    plain = _sample(docs, kinds, ordinary, size, text_col)
    return out | {ORDINARY: [t for kind in kinds for t in plain[kind]][:size]}


def all_gains(docs: DataFrame, model: FormatModel, text_col: str = "text") -> DataFrame:
    """``gain`` of every distinct candidate (``hash``) of all texts, those too short for
    any format by half or more left out."""
    lengths = (model.lengths()[0] // 2, MOST)

    def batches(frames):
        for frame in frames:
            runs = {t for text in frame["text"] for *_, t, _ in candidates(text, base_spans(text), lengths)}
            rows = [(xxhash.xxh64_intdigest(t) >> 1, model.gain(t)) for t in runs]
            yield pd.DataFrame(rows, columns=["hash", "gain"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(batches, "hash long, gain double").groupBy("hash").agg(F.max("gain").alias("gain"))


def train(
    docs: DataFrame, size: int = 1_000, quantile: float = 0.999, **columns: str
) -> FormatModel:
    """Fit on at most ``size`` distinct tokens per kind; the threshold is the quantile of
    the gains of all distinct candidates below those of labelled tokens."""
    model = fit(examples(docs, size, **columns), quantile=quantile)
    if model.formats:
        gains = all_gains(docs, model, **columns)
        below = gains.where((F.col("gain") < model.sure) & (F.col("gain") > -math.inf))
        cut = below.agg(F.percentile_approx("gain", quantile, 100_000)).first()[0]
        model.threshold = LEAST_GAIN if cut is None else max(LEAST_GAIN, cut)
    return model


def find_secrets(
    docs: DataFrame, model: FormatModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id and ``spans``, an array of (kind, start, end), of every row of ``docs``."""
    small_batches(docs.sparkSession)
    narrow = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = StructType([narrow.schema[0]]).add("spans", ArrayType(span))
    lengths = model.lengths() if model.formats else (1, 0)

    def batches(frames):
        for frame in frames:
            known: dict[str, bool] = {}
            rows = []
            for text in frame["text"]:
                base = base_spans(text)
                spans = [(start, BASE.index(kind), end, kind) for start, kind, end, _ in base]
                for start, end, token, _ in candidates(text, base, lengths) if model.formats else ():
                    if token not in known:
                        known[token] = model.gain(token) >= model.threshold
                    if known[token]:
                        spans.append((start, len(BASE), end, ADDED))
                rows.append([{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(spans)])
            yield pd.DataFrame({id_col: frame[id_col], "spans": rows})

    return narrow.mapInPandas(batches, schema)


def _listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs, train(docs))
    spans = F.col("spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in BASE],
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] != ADDED)), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        number(ADDED),
    )
