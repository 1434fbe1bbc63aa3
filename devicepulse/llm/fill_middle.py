"""Fill-in-middle: documents cut at two line ranks, and their parts put in another order.

The lines of a document form an indexable skip list. Every link carries two widths, the
units and the code points it passes over. Lanes above the first keep about every fourth
node of the lane below. A cut rank is reached by going along the highest lane as long as
the rank is not passed, then down a lane, and so on; the code points passed add up to the
place of the cut, so no text is joined or counted again.

Where and how a document is cut follows from a hash of the seed and its id alone.

Results that are defined for odd input: NULL and empty text is plain; texts that hold a
mark are plain, so that every output can be read back; a NULL id is hashed as an empty
one; very long texts are handled whole; repeated rows are cut alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

# The fixed marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def lines(text: str) -> list[str]:
    """The text in lines, each with its line feed; the last may have none."""
    parts = [part + "\n" for part in text.split("\n")]
    parts[-1] = parts[-1][:-1]
    return parts if parts[-1] else parts[:-1]


def _stays(place: int, lane: int) -> bool:
    """Whether the node at ``place`` is in ``lane``: a fixed draw with a chance of a fourth
    per lane. The head always stays."""
    draw = (place * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF
    return draw % (1 << 2 * lane) == 0


class SkipList:
    """Units in a row, each of a number of code points."""

    def __init__(self, points: list[int]):
        # A lane: units and code points per link, and where each node is in the lane below.
        self.lanes = [([1] * len(points), points, [])]
        nodes = range(len(points))
        while len(nodes) > 4:
            lane = len(self.lanes)
            units, points, _ = self.lanes[-1]
            keep = [i for i, node in enumerate(nodes) if _stays(node, lane)]
            if len(keep) == len(nodes):
                break
            ends = [*keep, len(nodes)]
            passed = [[0, *accumulate(widths)] for widths in (units, points)]
            wide = [[total[b] - total[a] for a, b in pairwise(ends)] for total in passed]
            self.lanes.append((*wide, ends))
            nodes = [nodes[i] for i in keep]

    def reach(self, rank: int) -> int:
        """The code points before the unit of this rank."""
        at = units = points = 0
        for wide, long, below in reversed(self.lanes):
            while at < len(wide) and units + wide[at] <= rank:
                units += wide[at]
                points += long[at]
                at += 1
            at = below[at] if below else at
        return points


def transform(
    text: str, name: str, seed: int, rate: int, spm: int
) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one document."""
    units = lines(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    one, two, some, order = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or some % 100 >= rate:
        return n, "plain", None, None, text
    index = SkipList([len(unit) for unit in units])
    start, end = (index.reach(rank) for rank in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if order % 100 < spm:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, start, end - start, output


def restored(output: str, form: str) -> str:
    """The document that was transformed to ``output``."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


@pandas_udf(StringType())
def restore(output: pd.Series, form: pd.Series) -> pd.Series:
    """``restored`` as a column function."""
    return pd.Series([restored(o, f) for o, f in zip(output, form)], dtype=object)


def fill_in_middle(
    docs: DataFrame,
    rate: int = 100,
    spm: int = 50,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars``
    and ``output``. Of a hundred documents about ``rate`` are transformed, and of those
    about ``spm`` in a hundred with the suffix first."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), text.alias("text"))
    schema = StructType([StructField(id_col, rows.schema["id"].dataType)]).add("n", "long")
    schema = schema.add("form", "string").add("prefix_chars", "long")
    schema = schema.add("middle_chars", "long").add("output", "string")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def batches(stream):
        for batch in stream:
            pairs = zip(batch["text"], batch["name"])
            made = [transform(t.as_py(), n.as_py(), seed, rate, spm) for t, n in pairs]
            columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)] if made else [
                pa.nulls(0, k) for k in kinds
            ]
            columns[-1] = columns[-1].cast(batch["text"].type)
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names=schema.names)

    return rows.mapInArrow(batches, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    """Every document with its cuts, and digests of the output and of the text read back."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore("output", "form"), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one,
         ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain,
         ('0x' || h[25:32])::BIGINT % 100 < 50 AS suffix_first
  FROM cut
), parts AS (
  SELECT doc_id, text, n, plain, suffix_first,
         array_to_string(units[1:least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN NOT plain THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE WHEN plain THEN text
                   WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
