"""Sharding, packing, mixing and the pipeline."""

from __future__ import annotations

import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from devicepulse.llm import mixing, packing, perword, queries, sharding
from devicepulse.llm.wordpieces import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_with_check_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    theirs = sorted(repr(sorted(zip(names, row))) for row in found.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in df.collect()) == theirs


def test_shards(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.QUERIES["op7_byte_shards"](spark, sf_dir).collect()
    shards = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "bytes")
        shards[r.shard].append(r)
    assert set(shards) <= set(range(40)) and len(rows) == len(texts)
    largest = max(r.size for r in rows)
    target = sum(r.size for r in rows) / 40
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - target) <= largest


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {16}
    assert sharding.shard_documents(empty).count() == 0


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_of_documents(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {
        r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for r in documents.collect()
    }
    rows = queries.QUERIES["op8_packing"](spark, sf_dir).collect()
    used = check_packing(rows, 4096)
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total and used == -(-total // 4096)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, PATH, 64).collect()
    check_packing(rows, 64)
    assert {(r.piece, r.length) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 1)}
    assert Counter(r.doc_id for r in rows)[2] == 2
    assert packing.pack_documents(empty, PATH, 64).count() == 0


def fewest(items, capacity):
    """Exact number of sequences by trying everything."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += items[i]
                place(i + 1, rest)
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal():
    draw = np.random.default_rng(8)
    for _ in range(150):
        capacity = int(draw.integers(10, 40))
        items = sorted(draw.integers(1, capacity + 1, int(draw.integers(1, 10))).tolist(), reverse=True)
        plan = packing.BinCompletion(Counter(items), capacity).solve()
        packed = Counter()
        for step in plan:
            assert sum(step.lengths) <= capacity
            for n in step.lengths:
                packed[n] += step.times
        assert packed == Counter(items)
        assert sum(s.times for s in plan) == fewest(items, capacity), (items, capacity)
    # Best-fit decreasing needs four here, three suffice.
    assert sum(s.times for s in packing.BinCompletion({6: 1, 5: 2, 4: 2, 3: 2}, 10).solve()) == 3


def brute_mix(rows, max_repeats):
    tokens = defaultdict(int)
    for _, source, n in rows:
        tokens[source] += n
    a = 1 - np.log(max_repeats) / np.log(max(tokens.values()) / min(tokens.values()))
    a = max(a, 0)
    raw = {s: n**a / n for s, n in tokens.items()}
    return tokens, {s: r / min(raw.values()) for s, r in raw.items()}


def test_mixing_meets_its_limit(documents):
    df = documents.selectExpr("doc_id", "text", "IF(doc_id % 3 = 0, 'hot', source) AS source")
    rows = mixing.schedule(df, max_repeats=2.0, blocks=4).collect()
    once = [r for r in rows if r.epoch == 0]
    tokens, repeats = brute_mix([(r.doc_id, r.source, r.tokens) for r in once], 2.0)
    assert Counter(r.doc_id for r in once) == Counter(r.doc_id for r in df.collect())
    assert max(repeats.values()) == pytest.approx(2, abs=1e-6)
    largest = max(r.tokens for r in rows)
    for source, whole in tokens.items():
        used = sum(r.tokens for r in rows if r.source == source)
        assert -1e-6 <= used - repeats[source] * whole <= largest + 1
        assert len({(r.doc_id, r.epoch) for r in rows if r.source == source}) == sum(
            r.source == source for r in rows
        )
    assert {r.block for r in rows} == {0, 1, 2, 3}
    again = Counter(r.doc_id for r in mixing.mixed(df, max_repeats=2.0).collect())
    assert again == Counter(r.doc_id for r in rows)


def test_mixing_meets_an_entropy(documents):
    df = documents.selectExpr("doc_id", "text", "IF(doc_id % 3 > 0, 'hot', source) AS source")
    rows = mixing.schedule(df, entropy=2.0).collect()
    w = np.array(list({r.source: r.weight for r in rows}.values()))
    assert w.sum() == pytest.approx(1) and -(w * np.log(w)).sum() == pytest.approx(2.0, abs=1e-5)


def test_mixing_with_a_budget(documents):
    rows = mixing.schedule(documents, max_repeats=1.5, budget=20_000).collect()
    slack = max(r.tokens for r in rows) * len({r.source for r in rows})
    assert 20_000 <= sum(r.tokens for r in rows) <= 20_000 + slack


def test_mixing_of_odd_rows(odd, empty):
    for df in (odd, empty):
        rows = mixing.mixed(df, max_repeats=3.0)
        assert rows.columns == df.columns
        assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in df.collect()}
    assert mixing.schedule(empty, entropy=1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(odd)


def test_pipeline_stages(spark, sf_dir, documents):
    docs, ids = documents, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == documents.columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids = now
    used = docs.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r.piece == 0 for r in rows) == used and {r.doc_id for r in rows} == ids
    check_packing(rows, 4096)


def test_pipeline_takes_odd_rows(spark, sf_dir, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert (docs.count() == 0) == (table is empty)


def test_plain_words_take_the_model_alone():
    """The ids are those of the tokenizer's full way, whatever the word."""
    full = Tokenizer.from_file(PATH)
    ids = WordIds(full)
    assert ids.plain("Été.") and ids.plain("word") and not ids.plain("don't") and not ids.plain("x1")
    words = [
        "word", "Word", "WORD.", "Été", "ÀÿßÆ", "don't", "it's", "a'", "a's", "'s", "x1", "1x", "...", "", "a.b", "ſ", "K",
        "é", "ǅ", "İ", "Σας", "ΑΣ", "日本", "a b", "a\tb", "<|endoftext|>", "a<|endoftext|>", "ab\"!?", "word" * 40,
    ]
    assert ids(words) == [np.array(e.ids, "<u4").tobytes() for e in full.encode_batch(words, add_special_tokens=False)]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = WordIds(other)(words)
    assert found == [np.array(e.ids, "<u4").tobytes() for e in other.encode_batch(words, add_special_tokens=False)]


def test_remembered_words_are_looked_up_once():
    """Known words cost one lookup: no table of a batch's distinct words is built."""
    asked = []
    words = perword.PerWord(lambda ws: asked.extend(ws) or [w.encode() for w in ws], 200_000)
    many = [f"w{i}" for i in range(100_000)]
    texts = [" ".join(many), "", "w1\nw2  " + "x" * 100]
    expected = [[w.encode() for w in t.replace("\n", " ").split(" ")] for t in texts]
    assert list(words.each(texts)) == expected
    assert sorted(asked) == sorted({w.decode() for e in expected for w in e})
    batch = [list(words.known)]
    tracemalloc.start()
    (again,) = words._several(batch)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert again == [w.encode() for w in batch[0]] and "x" * 100 not in words.known
    assert peak < 30 * len(batch[0])
    words.remembered = 10  # older words are found again
    asked.clear()
    assert list(words.each(texts)) == expected and asked == ["x" * 100]
