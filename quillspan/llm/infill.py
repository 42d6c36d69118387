"""Operator 11, fill-in-middle transformation over a sparse checkpoint index.

A text is a row of units, ``[A-Za-z]+`` or any other single code point. While the units are counted, a checkpoint is written
down after every ``EVERY`` of them: units, bytes and code points up to there. A place asked for in any of the three is found by
binary search among the checkpoints and a rescan of the few units behind the one before it, so cutting a text costs no second
pass and the index a few bytes for every ``EVERY`` units.

Where a text is cut, and in which form it is written, follows from a digest of the seed and the document's id alone, so that any
task gives the same output again. The output can be turned back: its sentinels occur nowhere in the text of a document that is
cut, and none can come about where a part meets a sentinel, since each begins with the one ``<`` that it holds.

Defined cases: null texts count as empty; empty texts and texts that hold a sentinel are plain; a null ``doc_id`` is hashed as
the empty number; repeated rows give equal rows; other columns are ignored; an empty table gives no rows. A long text is one row
of its batch; apart from it only its checkpoints are kept.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, texts

EVERY = 256  #: units from one checkpoint to the next
SEED = "1"
PLAIN_FROM = 90  #: of 100 documents, those from here on stay plain
SPM_BELOW = 20  #: of 100 documents that are cut, those below are written suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)

#: One unit in UTF-8. Its branches exclude each other and are possessive, so that repeating it never goes back into a unit.
UNIT = rb"(?:[A-Za-z]++|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\x80-\xFF][\x80-\xBF]*+)"
_unit = re.compile(UNIT)
_stride = re.compile(UNIT + rb"{%d}" % EVERY)
_behind = bytes(range(0x80, 0xC0))  # bytes that begin no code point

#: Bytes of output handed to Spark in one batch.
BATCH_BYTES = 8 << 20


class Place(NamedTuple):
    units: int
    bytes: int
    chars: int


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.translate(None, _behind))


class Checkpoints:
    """The index of one text: the place after every ``EVERY`` units, and its end."""

    def __init__(self, data: bytes):
        self.data = data
        self.units, self.bytes, self.chars = array("q", [0]), array("q", [0]), array("q", [0])
        at = chars = units = 0
        while m := _stride.match(data, at):  # never searched for: behind the last full stride there is none
            chars, units, at = chars + code_points(m[0]), units + EVERY, m.end()
            self.units.append(units), self.bytes.append(at), self.chars.append(chars)
        tail = data[at:]
        self.end = Place(units + len(_unit.findall(tail)), len(data), chars + code_points(tail))

    def _from(self, marks: array, value: int) -> tuple[int, Place]:
        k = bisect_right(marks, value) - 1
        return k, Place(self.units[k], self.bytes[k], self.chars[k])

    def at_unit(self, unit: int) -> Place:
        """The place before a unit, from 0 to the number of units."""
        if not 0 <= unit <= self.end.units:
            raise IndexError(unit)
        k, (units, at, chars) = self._from(self.units, unit)
        begun = at
        for m in _unit.finditer(self.data, at):
            if units == unit:
                break
            units, at = units + 1, m.end()
        return Place(unit, at, chars + code_points(self.data[begun:at]))

    def _within(self, marks: array, value: int, most: int, which: int) -> Place:
        """The place of the unit that a byte or code point belongs to; the text's end behind the last one."""
        if not 0 <= value <= most:
            raise IndexError(value)
        if value == most:
            return self.end
        k, place = self._from(marks, value)
        for m in _unit.finditer(self.data, place.bytes):
            after = Place(place.units + 1, m.end(), place.chars + code_points(m[0]))
            if after[which] > value:
                break
            place = after
        return place

    def at_byte(self, byte: int) -> Place:
        return self._within(self.bytes, byte, self.end.bytes, 1)

    def at_char(self, char: int) -> Place:
        return self._within(self.chars, char, self.end.chars, 2)


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of the digest of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def transform_one(doc_id: int | None, data: bytes, seed: str = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    index = Checkpoints(data)
    n = index.end.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= PLAIN_FROM or any(s.encode() in data for s in SENTINELS):
        return n, "plain", None, None, data
    first, second = (index.at_unit(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[: first.bytes], data[first.bytes : second.bytes], data[second.bytes :]
    p, s, m = (x.encode() for x in SENTINELS)
    spm = h4 % 100 < SPM_BELOW
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm else "psm", first.chars, second.chars - first.chars, output


def transform(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every whole text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("data")):
                rows.append((doc_id, *transform_one(doc_id, data.as_py(), seed)))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    given = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return given.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, found by its sentinels alone."""

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start, end - start)

    first, size = F.lit(len(PREFIX) + 1), len(PREFIX)
    end = F.length(output) + 1
    at_p, at_s, at_m = (F.locate(x, output) for x in SENTINELS)
    psm = F.concat(between(first, at_s), between(at_m + size, end), between(at_s + size, at_m))
    spm = F.concat(between(at_p + size, at_m), between(at_m + size, end), between(first, at_p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[: a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
