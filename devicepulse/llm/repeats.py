"""Removal of long byte strings that occur earlier in the corpus, by suffix order.

A *window* is a place where ``length`` bytes of a document start. Every byte is removed
that a window covers whose string starts earlier too: in a document before, or before in
the same document. Strings are judged on the input, and never cross documents.

1. Each window has an anchor, the gram of ``_gram_size`` bytes inside it with the least
   hash. Equal windows have equal anchors, so only windows below one gram need comparing.
   Neighbouring windows mostly share the anchor and make one *context*: their bytes.
2. Per gram, equal contexts (by a 64-bit digest beside the gram's 56 bits) are found. All but
   the first of them are repeats as a whole. The first ones go on where the gram has
   several different contexts, or comes twice in a window. Nothing but hashes and places is shuffled for this.
3. The texts meet their marks and give the bytes of those contexts, which are dealt by
   gram. Each task puts the suffixes at its windows in order by two-stage sorting
   (``suffixes``), and takes the common prefixes of neighbours: windows that share
   ``length`` bytes are equal, and all but the first of them are repeats.
4. The spans of a document meet its text again and are cut out.

Hot groups. A scan task merges the equal contexts of a batch first, so that a text or passage
that very many documents hold reaches step 2 once per batch. A gram with more than ``MANY``
contexts, or more than ``CROWD`` in one batch, is dealt out by context to as many salts as
the shuffle has partitions. If more than ``MANY`` contexts that are no copies are left of
it, step 3 deals them out too, and the first windows of its salts are then compared by
128-bit digest, at most one per salt and string. No link is dropped for it.

Texts are shuffled compressed. Order of documents: by id, NULL first; rows that repeat an
id by a 64-bit hash of their texts. Results that are defined for odd input: NULL text is
empty; texts shorter than ``length`` stay whole; of rows that repeat both id and text all
but one lose every byte (unless shorter than ``length``); very long texts are read whole,
in pieces that overlap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from devicepulse.llm.shared import same, slices, written
from devicepulse.llm.suffixes import common_prefixes, suffix_order

LENGTH = 100
# Contexts of a gram from which it is salted: in all, and in one batch of texts.
MANY, CROWD = 4_096, 64
# Bytes of text hashed at once, of contexts ordered at once, and of texts or contexts in
# one batch that a task passes on.
PIECE, ORDERED, PASSED = 1 << 19, 1 << 21, 1 << 22
# Places that are signs.
TIED, CROWDED = -2, -1
_SCATTER = 0x9E3779B1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gram_size(length: int) -> int:
    return max(1, min(24, length // 4))


def _gram_hashes(data: bytes, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes from each place on, as far as they go."""
    n = len(data) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    padded = data + bytes(8)
    out = np.zeros(n, np.uint64)
    for at in range(0, size, 8):
        words = np.ndarray(n, "<u8", padded, offset=at, strides=(1,))
        rest = max(0, at + 8 - size)
        out = (out ^ (words << np.uint64(8 * rest))) * _ODD
        out ^= out >> np.uint64(29)
    out *= _ODD
    return out ^ (out >> np.uint64(32))


def _least_ahead(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbouring keys: blocks of that width are swept from
    both ends, and each stretch is the end of one block and the start of the next."""
    n = len(keys)
    if n < wide:
        return keys[:0]
    blocks = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - wide + 1], ahead[wide - 1 : n])


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about ``PIECE`` bytes. Longer texts are cut; each
    window is whole in one piece, whatever texts are read with it."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            if held and size + len(part) > 2 * PIECE:
                yield held
                held, size = [], 0
            held.append((row, offset, part))
            size += len(part)
    if held:
        yield held


def contexts(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """All contexts of the texts: ``row``, ``start``, ``windows`` (how many windows they
    hold), ``gram``, ``digest``, and ``tied``: the gram comes twice in a window, so that
    windows of this one context may be equal."""
    size = _gram_size(length)
    wide = length - size + 1
    # The low bits of a key tell the place among the neighbours, in a scattered order, so
    # that runs of one gram have no more anchors than other text. The rest is the gram.
    bits = max(8, (wide - 1).bit_length())
    low = (1 << bits) - 1
    gather = pow(_SCATTER, -1, 1 << bits)
    found: dict[str, list] = {c: [] for c in ("row", "start", "windows", "gram", "digest", "tied")}
    for held in _pieces(texts, length):
        rows, offsets, parts = zip(*held)
        data = b"".join(parts)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        grams = _gram_hashes(data, size)
        begin = np.repeat(begins, lengths)[: len(grams)]
        inside = np.arange(len(grams)) - begin
        grams &= ~np.uint64(low)
        scattered = inside * _SCATTER & low
        least = _least_ahead(grams | scattered.astype(np.uint64), wide)
        # The other way round ties fall on another place.
        other = _least_ahead(grams | (low - scattered).astype(np.uint64), wide)
        tied = (least ^ other) & np.uint64(low) != np.uint64(low)
        window = np.arange(len(least))
        nearest = (least & np.uint64(low)).astype(np.int64) * gather
        anchor = window + (nearest - inside[: len(least)] & low)
        piece = np.repeat(np.arange(len(parts)), lengths)[: len(least)]
        windows = np.flatnonzero(window + length <= ends[piece])
        anchor = anchor[windows]
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(first, append=len(windows))
        start = windows[first]
        stop = start + count + length - 1
        piece = piece[start]
        found["row"].append(np.array(rows)[piece])
        found["start"].append(np.array(offsets)[piece] + start - begins[piece])
        found["windows"].append(count)
        found["gram"].append((least[start] >> np.uint64(bits)).astype(np.int64))
        digests = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
        found["digest"].append(np.array(digests, np.uint64).view(np.int64))
        found["tied"].append(np.bitwise_or.reduceat(tied[windows], first) if len(first) else tied[:0])
    kinds = {"tied": bool}
    return {
        c: np.concatenate([np.empty(0, kinds.get(c, np.int64)), *parts]) for c, parts in found.items()
    }


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``PASSED`` bytes of ``column``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + PASSED, "right")))
        yield batch.slice(at, end - at)
        at = end


def _marks(rows: DataFrame, length: int, salts: int) -> DataFrame:
    """(``id``, ``tie``, ``place``, ``gram``, ``salt``, ``copy``) of the contexts that are
    copies of earlier ones, or the first of their kind below a gram of several."""
    one_id = rows.schema["id"]
    schema = StructType([one_id]).add("tie", "long").add("place", "long").add("gram", "long")
    schema = schema.add("salt", "integer").add("digest", "long")

    def batches(stream):
        for batch in (part for whole in stream for part in _parts(whole, "text")):
            order = [("id", "ascending"), ("tie", "ascending")]
            batch = batch.take(pc.sort_indices(batch, order, null_placement="at_start"))
            found = contexts(batch["text"].to_pylist(), length)
            gram, digest, row = found["gram"], found["digest"], found["row"]
            place = found["start"] * length + found["windows"] - 1
            pairs = np.rec.fromarrays([gram, digest])
            _, first = np.unique(pairs, return_index=True)
            copy = np.ones(len(gram), bool)
            copy[first] = False
            kinds, which, count = np.unique(gram[first], return_inverse=True, return_counts=True)
            crowded = count > CROWD
            salt = np.zeros(len(gram), np.int32)
            salt[first] = np.where(crowded[which], 1 + digest[first] % salts, 0)
            salt[copy] = -1  # known already, dealt out evenly
            # Signs for all contexts of a gram: one has equal windows; or it is crowded here.
            tied = np.unique(gram[found["tied"] & ~copy])
            signs = np.append(tied, kinds[crowded])
            sign = np.append(np.full(len(tied), TIED), np.full(len(signs) - len(tied), CROWDED))
            blank = len(signs)

            def column(values, sign, kind=None):
                return pa.concat_arrays([pa.array(values, kind), pa.array(sign, kind)])

            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch["id"].take(pa.array(row)), pa.nulls(blank, batch["id"].type)]),
                    pa.concat_arrays([batch["tie"].take(pa.array(row)), pa.nulls(blank, pa.int64())]),
                    column(place, sign),
                    column(np.where(copy, digest ^ place, gram), signs),
                    column(salt, np.zeros(blank, np.int32)),
                    pa.concat_arrays([pa.array(digest), pa.nulls(blank, pa.int64())]),
                ],
                names=schema.names,
            )

    group = Window.partitionBy("gram", "salt")
    before = F.lag("digest").over(group.orderBy("digest", "id", "tie", "place"))
    all_of = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.mapInArrow(batches, schema).select(
        "*",
        (F.coalesce(before == F.col("digest"), F.lit(False)) | (F.col("salt") < 0)).alias("copy"),
        (F.min("digest").over(all_of) < F.max("digest").over(all_of)).alias("several"),
        F.bool_or(F.col("place") == TIED).over(all_of).alias("tied"),
        (F.count("*").over(all_of) > MANY).alias("many"),
        F.bool_or(F.col("place") == CROWDED).over(all_of).alias("told"),
    )
    warm = (F.col("salt") > 0) | F.col("many") | F.col("told")
    to_order = warm | F.col("several") | F.col("tied")
    marked = marked.where("place >= 0").where(F.col("copy") | to_order).select(
        "id", "tie", "place", "gram", "digest", "copy", warm.alias("warm")
    )
    marked = written(marked, "marks")
    # A crowd in one batch may be all there is: only grams that have many contexts once
    # the copies are told are dealt out.
    hot = marked.where("warm AND NOT copy").groupBy("gram").count().where(F.col("count") > MANY)
    hot = hot.select("gram", F.lit(True).alias("hot"))
    marked = marked.join(hot, "gram", "left")
    salt = F.when(F.col("hot") & ~F.col("copy"), 1 + F.pmod("digest", F.lit(salts)))
    return marked.select(
        "id", "tie", "place", "gram", F.coalesce(salt, F.lit(0)).cast("int").alias("salt"), "copy"
    )


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that are sorted by start; those that touch are one."""
    if not len(starts):
        return starts, stops
    reach = np.maximum.accumulate(stops)
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


def _packed(rows: DataFrame) -> DataFrame:
    """(``id``, ``tie``, ``z``): texts compressed for the shuffle."""
    schema = StructType([rows.schema["id"]]).add("tie", "long").add("z", "binary")

    def batches(stream):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in (part for whole in stream for part in _parts(whole, "text")):
            z = pa.array([pack.compress(t.as_py()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["tie"], z], names=schema.names)

    return rows.mapInArrow(batches, schema)


def _unpacked(z) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z.as_py())


def _marked_texts(rows: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Per mark: of copies ``start`` and ``stop`` of all their bytes, merged; of the others
    the same and ``gram``, ``salt`` and the bytes themselves."""
    marks = marks.groupBy("id", "tie").agg(
        F.collect_list(F.struct("place", "gram", "salt", "copy")).alias("marks")
    )
    joined = same(_packed(rows), marks, ["id", "tie"])
    schema = StructType([rows.schema["id"]]).add("tie", "long").add("start", "long")
    schema = schema.add("stop", "long").add("gram", "long").add("salt", "integer").add("bytes", "binary")

    def batches(stream):
        for batch in (part for whole in stream for part in _parts(whole, "z")):
            row, out = [], []
            for at, (z, marks) in enumerate(zip(batch["z"], batch["marks"])):
                marks = marks.values.flatten()
                place, gram, salt, copy = (m.to_numpy(zero_copy_only=False) for m in marks)
                start = place // length
                stop = start + place % length + length
                order = np.argsort(start)
                order = order[copy[order]]
                for span in zip(*_spans(start[order], stop[order])):
                    row.append(at)
                    out.append((*span, None, None, None))
                other = np.flatnonzero(~copy)
                if len(other):
                    text = _unpacked(z)
                    for i in other:
                        row.append(at)
                        out.append((start[i], stop[i], gram[i], salt[i], text[start[i] : stop[i]]))
            rest = list(zip(*out)) or [[]] * 5
            kinds = [f.type for f in pa_schema[2:]]
            names = schema.names
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(row, pa.int64())),
                    batch["tie"].take(pa.array(row, pa.int64())),
                    *[pa.array(v, k) for v, k in zip(rest, kinds)],
                ],
                names=names,
            )

    fields = [("start", pa.int64()), ("stop", pa.int64()), ("gram", pa.int64())]
    pa_schema = [None, None, *[pa.field(*f) for f in fields]]
    pa_schema += [pa.field("salt", pa.int32()), pa.field("bytes", pa.binary())]
    return joined.mapInArrow(batches, schema)


def repeated_windows(parts: list[bytes], groups: np.ndarray, length: int):
    """Of contexts in document order inside each group: (context, offset, repeated) for
    every window, where windows of the same group and string count as repeated but for
    the first. All contexts are ordered together, as one text."""
    lengths = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts) + bytes(1), np.uint8)
    begins = np.cumsum(lengths) - lengths
    context = np.repeat(np.arange(len(parts)), lengths)
    left = (begins + lengths)[context] - np.arange(len(context))
    wanted = np.append(left >= length, False)
    order = suffix_order(text, wanted, length)
    # Equal strings are of one gram; those of several salts meet later.
    own = context[order]
    new = common_prefixes(text, order, length) < length
    new[1:] |= groups[own[1:]] != groups[own[:-1]]
    new[:1] = True
    if not len(order):
        return own, order, new
    run = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new))
    return own, order - begins[own], order > first[run]


def _ordered(marked: DataFrame, length: int) -> DataFrame:
    """(``id``, ``tie``, ``start``, ``stop``) of repeats inside each (``gram``, ``salt``),
    and with their ``digest`` the first windows of each salted string."""
    schema = StructType([marked.schema["id"]]).add("tie", "long").add("start", "long")
    schema = schema.add("stop", "long").add("digest", "binary")
    keys = ["gram", "salt"]

    def found(table: pa.Table) -> pa.RecordBatch:
        parts = table["bytes"].to_pylist()
        gram, salt, start = (table[c].to_numpy() for c in ("gram", "salt", "start"))
        groups = np.cumsum(np.append(False, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])))
        own, offset, again = repeated_windows(parts, groups, length)
        place = np.lexsort((offset[again], own[again]))
        row, at = own[again][place], offset[again][place]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
        new = new[: len(row)]
        last = np.append(new[1:], len(row)) - 1 if len(row) else new
        rows, begin, end = row[new], at[new], at[last] + length
        firsts = np.flatnonzero(~again & (salt[own] > 0))
        digests = [xxhash.xxh3_128_digest(parts[own[i]][offset[i] : offset[i] + length]) for i in firsts]
        rows = np.append(rows, own[firsts])
        begin, end = np.append(begin, offset[firsts]), np.append(end, offset[firsts] + length)
        flat = table.select(["id", "tie"]).take(pa.array(rows)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                *[_flat(flat[c]) for c in ("id", "tie")],
                pa.array(start[rows] + begin),
                pa.array(start[rows] + end),
                pa.array([None] * len(new) + digests, pa.binary()),
            ],
            names=schema.names,
        )

    def batches(stream):
        held, size = [], 0
        for batch in stream:
            held.append(batch)
            size += batch["bytes"].nbytes
            if size < ORDERED:
                continue
            table = pa.Table.from_batches(held)
            gram, salt = (table[c].to_numpy() for c in keys)
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero((gram == gram[-1]) & (salt == salt[-1]))[0])
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b["bytes"].nbytes for b in held)
        if held:
            yield found(pa.Table.from_batches(held))

    dealt = marked.where("bytes IS NOT NULL").repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, "id", "tie", "start")
    return dealt.mapInArrow(batches, schema)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(``id``, ``tie``, ``start``, ``stop``): what is to go, from rows (``id``, ``tie``,
    ``text`` in bytes). Spans may overlap and come in any order."""
    marks = _marks(rows, length, slices(rows.sparkSession))
    marked = written(_marked_texts(rows, marks, length), "contexts")
    ordered = written(_ordered(marked, length), "repeats")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("id", "tie", "start"))
    columns = ["id", "tie", "start", "stop"]
    salted = ordered.where("digest IS NOT NULL").select(*columns, place.alias("nth"))
    return (
        marked.where("bytes IS NULL").select(columns)
        .unionByName(ordered.where("digest IS NULL").select(columns))
        .unionByName(salted.where("nth > 1").select(columns))
    )


def without_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``spans`` (an array of the removed runs,
    ``start`` to ``stop``, longest possible and in order) and the bytes ``kept``."""
    raw = F.coalesce(text_col, F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("tie"), "text")
    spans = repeated_spans(rows, length).groupBy("id", "tie")
    spans = spans.agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    texts = _packed(rows).groupBy("id", "tie").agg(F.first("z").alias("z"), F.count("*").alias("rows"))
    joined = same(texts, spans, ["id", "tie"], "left").select("id", "rows", "z", "spans")
    span = ArrayType(StructType().add("start", "long").add("stop", "long"))
    schema = StructType([StructField("id", rows.schema["id"].dataType)]).add("rows", "long")
    schema = schema.add("n_bytes", "long").add("spans", span).add("kept", "binary")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def batches(stream):
        for batch in (part for whole in stream for part in _parts(whole, "z")):
            sizes, cuts, kept = [], [], []
            for z, spans in zip(batch["z"], batch["spans"]):
                text = _unpacked(z)
                start = stop = np.empty(0, np.int64)
                if spans.is_valid:
                    start, stop = (s.to_numpy() for s in spans.values.flatten())
                    order = np.argsort(start)
                    start, stop = _spans(start[order], stop[order])
                edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                cuts.append([{"start": a, "stop": b} for a, b in zip(start, stop)])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["rows"], pa.array(sizes), pa.array(cuts, kind), pa.array(kept, pa.binary())],
                names=schema.names,
            )

    cut = joined.mapInArrow(batches, schema)
    cut = cut.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("nth"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    again = (F.col("nth") > 1) & (F.col("n_bytes") >= length)
    return cut.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(again, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    """Every document with what repeats of 100 bytes take from it."""
    cut = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
