"""Positions inside lines: editor positions in UTF-8, UTF-16 or UTF-32 units, and 1-based lines and scalar columns.

All of them are column expressions. A position is never moved, but for an editor position past its line's end, which stands for that
end. ``byte_of_unit`` and ``unit_of_byte`` are the rule for one line in memory.

Bytes find their lines by an as-of join: line starts and the distinct bytes asked for are sorted together inside bins of a file, and
the last start is carried on. How many scalars and UTF-16 units stand before a byte is read off checkpoints at every ``BLOCK`` bytes and
the few bytes behind one, so that a question costs a block however long its line is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import staged
from .lines import cut, latin1, line_content, line_pieces, line_table, running_sums

UNITS = {"utf-8": ("utf-8", 1), "utf-16": ("utf-16-le", 2), "utf-32": ("utf-32-le", 4)}


def byte_of_unit(line: bytes, character: int, encoding: str) -> int | None:
    """Byte, inside a line's content, of a position counted in units; clamped to the end, None inside a character."""
    name, size = UNITS[encoding]
    text = line.decode("utf-8")
    raw = text.encode(name)
    if character * size >= len(raw):
        return len(line)
    try:
        return len(raw[: character * size].decode(name).encode("utf-8"))
    except UnicodeDecodeError:
        return None


def unit_of_byte(line: bytes, offset: int, encoding: str) -> int | None:
    """Units before a byte of a line's content; None inside a character or past the content."""
    name, size = UNITS[encoding]
    if not 0 <= offset <= len(line):
        return None
    try:
        return len(line[:offset].decode("utf-8").encode(name)) // size
    except UnicodeDecodeError:
        return None


def _point_continues(data: Column, at: Column) -> Column:
    """Whether the byte at an offset goes on with a code point; false behind the data."""
    return F.coalesce(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))).between("80", "BF"), F.lit(False))


def units_to_byte(line: Column, character: Column, encoding: Column) -> Column:
    """Byte, inside a line's content, of a position counted in units; clamped to the end, null inside a character.

    UTF-16 is cut in its big-endian bytes: the cut is inside a character where it stands behind a high surrogate.
    """
    n, text = F.length(line).cast("long"), line.cast("string")
    wide = F.encode(text, "UTF-16BE")
    high = F.hex(F.substring(wide, (2 * character - 1).cast("int"), F.lit(1))).between("D8", "DB")
    narrow = F.decode(F.substring(wide, F.lit(1), (2 * character).cast("int")), "UTF-16BE")
    utf8 = F.when(character >= n, n).when(~_point_continues(line, character), character)
    utf16 = F.when(character == 0, F.lit(0)).when(character >= F.length(wide) / 2, n).when(~high, F.octet_length(narrow))
    utf32 = F.when(character >= F.length(text), n).otherwise(F.octet_length(F.substring(text, F.lit(1), character.cast("int"))))
    found = F.when(encoding == "utf-8", utf8).when(encoding == "utf-16", utf16).when(encoding == "utf-32", utf32)
    return F.when(F.is_valid_utf8(text) & (character >= 0), found).cast("long")


def byte_to_units(line: Column, offset: Column, encoding: Column) -> Column:
    """Units before a byte of a line's content; null inside a character or past the content."""
    before = F.substring(line, F.lit(1), offset.cast("int")).cast("string")
    found = F.when(encoding == "utf-8", offset).when(encoding == "utf-16", F.length(F.encode(before, "UTF-16BE")) / 2).when(encoding == "utf-32", F.length(before))
    return F.when((offset >= 0) & (offset <= F.length(line)) & F.is_valid_utf8(line.cast("string")) & ~_point_continues(line, offset), found).cast("long")


def position_to_byte(positions: DataFrame, lines: DataFrame) -> DataFrame:
    """``positions(path, line, character, encoding)``, lines from 0, as ``offset``; null with a ``problem`` where there is none.

    ``lines(path, line, line_start, content)``: lines from 1; a file that ends in a terminator has a last, empty line.
    """
    known = lines.select(F.col("path").alias("l_path"), F.col("line").alias("l_line"), "line_start", "content")
    # Lines are many times what their files are estimated at: no broadcast.
    joined = positions.join(known.hint("merge"), (F.col("path") == F.col("l_path")) & (F.col("line") + 1 == F.col("l_line")), "left")
    inside = units_to_byte(F.col("content"), F.col("character"), F.col("encoding"))
    out = joined.withColumn("inside", inside)
    problem = F.when(F.col("l_line").isNull(), "NO_SUCH_LINE").when(F.col("inside").isNull(), "SPLIT_CHARACTER")
    return out.select(*positions.columns, (F.col("line_start") + F.col("inside")).alias("offset"), problem.alias("problem"))


def editor_lines(files: DataFrame) -> DataFrame:
    """Lines as editors count them: ``path, line, line_start, content``; behind a last terminator comes an empty line."""
    pieces = line_pieces("bytes")
    open_end = F.element_at(F.concat(F.array(F.lit("\n")), pieces), -1).rlike(r"[^\r\n]\z")
    every = files.select("path", F.when(open_end, pieces).otherwise(F.concat(pieces, F.array(F.lit("")))).alias("pieces"))
    ends = every.withColumn("ends", running_sums(F.transform("pieces", lambda p: F.length(p).cast("long"))))
    each = ends.select("path", F.posexplode(F.arrays_zip("pieces", "ends")).alias("k", "x"))
    return each.select("path", (F.col("k") + 1).cast("long").alias("line"), (F.col("x.ends") - F.length("x.pieces")).cast("long").alias("line_start"), F.encode(line_content("x.pieces"), "ISO-8859-1").alias("content"))


def column_to_byte(text: Column, line_start: Column, column: Column) -> Column:
    """Byte of a 1-based scalar column of a line's content; its length and one more is its end; null beyond."""
    good = (column >= 1) & (column <= F.length(text) + 1)
    return F.when(good, line_start + F.octet_length(F.substring(text, F.lit(1), (column - 1).cast("int")))).cast("long")


def byte_to_column(data: Column, line_start: Column, content_end: Column, offset: Column) -> Column:
    """1-based scalar column of a byte in its line; null inside the terminator or behind it."""
    before = cut(data, line_start, offset).cast("string")
    return F.when((offset >= line_start) & (offset <= content_end) & F.is_valid_utf8(before), F.length(before) + 1).cast("long")


def work_excess(prefixes: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """Scalars that conversions look at, of each document, and whether that is too much work: ``path, scalars, exceeded``."""
    used = prefixes.groupBy("path").agg(F.sum(F.length("prefix")).alias("scalars"))
    return used.withColumn("exceeded", F.col("scalars") > limit)


BIN = 4096  #: bytes of a file in which line starts and bytes asked for are sorted together
BLOCK = 512  #: bytes from one checkpoint to the next


def checkpoints(files: DataFrame) -> DataFrame:
    """``path, block, data`` (its bytes), ``scalars, units`` (scalars and UTF-16 units that begin before it) of every block of a file."""
    # A unit belongs to the first byte of its code point: sums over bytes need no whole code points.
    slices = F.transform(F.sequence(F.lit(0), F.floor(F.length("bytes") / BLOCK).cast("int")), lambda k: F.substring(F.col("bytes"), k * BLOCK + 1, F.lit(BLOCK)))
    cut_up = files.select("path", slices.alias("slices"))
    sums = {c: running_sums(F.transform("slices", lambda x: f(x))) for c, f in (("scalars", scalars_in), ("units", units_in))}
    each = cut_up.withColumns(sums).select("path", F.posexplode(F.arrays_zip("slices", "scalars", "units")).alias("block", "x"))
    data = F.col("x.slices")
    return each.select("path", F.col("block").cast("long").alias("block"), data.alias("data"), (F.col("x.scalars") - scalars_in(data)).alias("scalars"), (F.col("x.units") - units_in(data)).alias("units"))


def scalars_in(data: Column) -> Column:
    """Code points that begin in a piece of UTF-8: its bytes but for those that go on with one, which are few or none."""
    return F.length(data).cast("long") - F.regexp_count(latin1(data), F.lit(r"[\x80-\xBF]"))


def units_in(data: Column) -> Column:
    """UTF-16 units of the code points that begin in a piece of UTF-8: two for those of four bytes."""
    return scalars_in(data) + F.regexp_count(latin1(data), F.lit(r"[\xF0-\xFF]"))


def lines_of_bytes(asked: DataFrame, lines: DataFrame, bin_bytes: int = BIN) -> DataFrame:
    """``path, offset`` (distinct) with the line that each is in: ``line, line_start, content_end``; a file's length is in its last line.

    Both sides go into bins of a file, a line into all that it touches. A bin holds no more than its own bytes' starts and offsets, however
    many times one is asked for. Offsets without a line (an empty file, behind the end) are left out.
    """
    last = F.col("line_end") == F.max("line_end").over(Window.partitionBy("path")) if "last" not in lines.columns else F.col("last")
    covered = lines.withColumn("cover", F.col("line_end") + last.cast("int")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("line_start") / bin_bytes), F.floor((F.col("cover") - 1) / bin_bytes))))
    found = F.struct("line", "line_start", "content_end", "cover")
    starts = covered.select("path", "bin", F.greatest("line_start", F.col("bin") * bin_bytes).alias("at"), F.lit(0).alias("kind"), found.alias("found"))
    distinct = asked.select("path", "offset").filter("offset >= 0").distinct()
    wanted = distinct.select("path", F.floor(F.col("offset") / bin_bytes).alias("bin"), F.col("offset").alias("at"), F.lit(1).alias("kind"))
    upto = Window.partitionBy("path", "bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(wanted, allowMissingColumns=True).withColumn("of", F.last("found", ignorenulls=True).over(upto))
    return both.filter("kind = 1 and at < of.cover").select("path", F.col("at").alias("offset"), "of.line", "of.line_start", "of.content_end")


def bytes_to_positions(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``asked(path, offset)`` and its other columns, with ``line`` and scalar ``column`` from 1 and, from 0, editor ``character8, character16,
    character32`` in units of each encoding.

    ``problem`` is told where there is no position: SPLIT_CHARACTER inside a code point, NO_SUCH_BYTE behind the file or in an empty one. A byte
    inside a terminator, or the end behind a last one, has a line alone.
    """
    content_end = F.col("line_end") - F.when(F.col("terminator") == "CRLF", 2).when(F.col("terminator") == "NONE", 0).otherwise(1)
    lines = line_table(files).select("path", "line", "line_start", "line_end", content_end.alias("content_end"))
    located = lines_of_bytes(asked, lines)
    places = located.select("path", F.col("offset").alias("at")).union(located.select("path", "line_start")).distinct().withColumn("block", F.floor(F.col("at") / BLOCK))
    inside = F.substring("data", F.lit(1), (F.col("at") - F.col("block") * BLOCK).cast("int"))
    # Written down, since both ends of a question read them.
    known = places.join(checkpoints(files), ["path", "block"]).select("path", "at", (F.col("scalars") + scalars_in(inside)).alias("scalars"), (F.col("units") + units_in(inside)).alias("units"), _point_continues(F.col("data"), F.col("at") - F.col("block") * BLOCK).alias("split"))
    known = staged(known, "places", "zstd")
    own = known.select(F.col("path").alias("o_path"), F.col("at").alias("o_at"), F.col("scalars").alias("o_scalars"), F.col("units").alias("o_units"), F.col("split").alias("o_split"))
    begun = known.select(F.col("path").alias("b_path"), F.col("at").alias("b_at"), F.col("scalars").alias("b_scalars"), F.col("units").alias("b_units"))
    joined = located.join(own, (F.col("path") == F.col("o_path")) & (F.col("offset") == F.col("o_at"))).join(begun, (F.col("path") == F.col("b_path")) & (F.col("line_start") == F.col("b_at")))
    shown = ~F.col("o_split") & (F.col("offset") <= F.col("content_end"))
    scalars, units = F.col("o_scalars") - F.col("b_scalars"), F.col("o_units") - F.col("b_units")
    each = joined.select(
        F.col("path").alias("p_path"),
        F.col("offset").alias("p_offset"),
        F.when(~F.col("o_split"), F.col("line")).alias("line"),
        F.when(shown, scalars + 1).alias("column"),
        F.when(shown, F.col("offset") - F.col("line_start")).alias("character8"),
        F.when(shown, units).alias("character16"),
        F.when(shown, scalars).alias("character32"),
        F.when(F.col("o_split"), "SPLIT_CHARACTER").alias("problem"),
    )
    out = asked.join(each, (F.col("path") == F.col("p_path")) & (F.col("offset") == F.col("p_offset")), "left")
    return out.withColumn("problem", F.when(F.col("p_path").isNull(), "NO_SUCH_BYTE").otherwise(F.col("problem"))).drop("p_path", "p_offset")
