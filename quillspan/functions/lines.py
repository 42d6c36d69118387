"""Byte-exact line arithmetic as column expressions.

Bytes are viewed as ISO-8859-1 text, so one character is one byte and nothing is normalised. A line ends after LF, CRLF (one
terminator) or a lone CR; an unterminated rest is a line; an empty file has none. Nulls give nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"
TERMINATOR = r"\r\n|\r|\n"
RUN = 64
BESIDE = 64  #: bytes beside a range that are looked at first


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latin1(data: Column | str) -> Column:
    """Bytes as text of one character a byte."""
    return F.decode(_col(data), "ISO-8859-1")


def line_pieces(data: Column | str) -> Column:
    """The lines with their terminators, as byte-for-character text."""
    return F.regexp_extract_all(latin1(data), F.lit(LINE), F.lit(0))


def text_pieces(text: Column) -> Column:
    """The lines of a text with their terminators; one without a CR is cut at its LFs, which is several times as fast as the pattern."""

    def at_feeds(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x, k: F.when(k < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x)), lambda x: x != "")

    return F.when(F.contains(text, F.lit("\r")), F.regexp_extract_all(text, F.lit(LINE), F.lit(0))).otherwise(let(F.split(text, "\n", -1), at_feeds))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, levels: int = 4) -> Column:
    """The running sums of an array of bigint.

    An array cannot grow in place, so that a plain fold copies it at every element; here only runs of ``RUN`` elements are folded. The
    sums of the runs are summed up in the same way, ``levels`` deep: arrays of ``RUN`` to the power of ``levels`` in linear work.
    """
    zero = F.lit(0).cast("long")

    def fold(values: Column, first: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("sums"), first.alias("at"))
        return F.aggregate(values, start, lambda acc, n: F.struct(F.concat(acc["sums"], F.array(acc["at"] + n)).alias("sums"), (acc["at"] + n).alias("at")), lambda acc: acc["sums"])

    def cut(values: Column) -> Column:
        count = F.ceil(F.size(values) / RUN).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(values, k * RUN + 1, RUN))).otherwise(F.array().cast("array<array<bigint>>"))

    def over(runs: Column) -> Column:
        ends = running_sums(F.transform(runs, lambda run: F.aggregate(run, zero, lambda a, n: a + n)), levels - 1)
        return F.flatten(F.zip_with(runs, F.slice(F.concat(F.array(zero), ends), F.lit(1), F.size(runs)), fold))

    return let(numbers, lambda n: fold(n, zero)) if levels == 1 else let(numbers, lambda n: let(cut(n), over))


def line_ends(data: Column | str) -> Column:
    """Exclusive end of every line, ascending."""
    return running_sums(F.transform(line_pieces(data), lambda p: F.length(p).cast("long")))


def line_table(files: DataFrame, key: str = "path", data: str = "bytes") -> DataFrame:
    """``key, line`` (from 1), ``line_start, line_end`` (bytes, end exclusive), ``terminator`` (LF, CRLF, CR, NONE).

    Offsets are summed in the file's own row, so nothing is exchanged.
    """
    labels = F.transform(line_pieces(data), lambda p: F.struct(F.length(p).cast("long").alias("n"), terminator_label(p).alias("terminator")))
    each = files.select(key, labels.alias("labels")).select(key, F.posexplode(F.zip_with("labels", running_sums(F.col("labels.n")), lambda x, end: F.struct(x["n"].alias("n"), x["terminator"].alias("terminator"), end.alias("end")))).alias("k", "x"))
    return each.select(key, (F.col("k") + 1).cast("long").alias("line"), (F.col("x.end") - F.col("x.n")).alias("line_start"), F.col("x.end").alias("line_end"), F.col("x.terminator").alias("terminator"))


def terminator_label(piece: Column | str) -> Column:
    piece = _col(piece)
    return F.when(piece.endswith("\r\n"), "CRLF").when(piece.endswith("\n"), "LF").when(piece.endswith("\r"), "CR").otherwise("NONE")


def line_content(piece: Column | str) -> Column:
    """A line without its terminator."""
    return F.regexp_replace(_col(piece), r"(\r\n|\r|\n)\z", "")


def line_count(ends: Column | str) -> Column:
    return F.size(_col(ends)).cast("long")


def line_start(ends: Column | str, line: Column) -> Column:
    """Byte at which a line (from 1) starts; null where there is no such line."""
    return F.when((line >= 1) & (line <= F.size(_col(ends))), F.when(line == 1, F.lit(0)).otherwise(F.get(_col(ends), (line - 2).cast("int")))).cast("long")


def line_end(ends: Column | str, line: Column) -> Column:
    return F.when(line >= 1, F.get(_col(ends), (line - 1).cast("int"))).cast("long")


def byte_at(data: Column | str, offset: Column) -> Column:
    """One byte as byte-for-character text; empty outside the data."""
    return F.when((offset >= 0) & (offset < F.length(_col(data))), latin1(F.substring(_col(data), (offset + 1).cast("int"), F.lit(1)))).otherwise("")


def cut(data: Column | str, start: Column, end: Column) -> Column:
    """Bytes from start to end (exclusive); null where the range does not lie inside the data."""
    data = _col(data)
    return F.when((start >= 0) & (start <= end) & (end <= F.length(data)), F.substring(data, (start + 1).cast("int"), (end - start).cast("int")))


def range_terminators(data: Column | str, ends: Column | str, start: Column, end: Column) -> Column:
    """Terminators of the slice taken on its own: a CRLF cut in two counts its CR, an unterminated end counts nothing."""
    inside = F.size(F.filter(_col(ends), lambda x: (x > start) & (x <= end))).cast("long")
    last = byte_at(data, end - 1)
    open_end = (end == F.length(_col(data))) & ~last.isin("\r", "\n")
    split = (last == "\r") & (byte_at(data, end) == "\n")
    return F.when(start == end, F.lit(0).cast("long")).otherwise(inside - open_end.cast("long") + split.cast("long"))


def metrics(data: Column | str) -> Column:
    """Of a slice: bytes, terminators, first and last byte (null for nothing)."""
    data = _col(data)
    text = latin1(data)
    n = F.length(data)
    return F.struct(
        n.cast("long").alias("byte_count"),
        F.regexp_count(text, F.lit(TERMINATOR)).cast("long").alias("terminator_count"),
        F.when(n > 0, F.ascii(F.substring(text, 1, 1))).alias("first_byte"),
        F.when(n > 0, F.ascii(F.substring(text, -1, 1))).alias("last_byte"),
    )


def merge_metrics(a: Column, b: Column) -> Column:
    """Metrics of two slices end to end; a CR that meets an LF becomes one terminator. Associative, not commutative."""
    seam = ((a["last_byte"] == 13) & (b["first_byte"] == 10)).cast("long")
    both = F.struct(
        (a["byte_count"] + b["byte_count"]).alias("byte_count"),
        (a["terminator_count"] + b["terminator_count"] - F.coalesce(seam, F.lit(0))).alias("terminator_count"),
        a["first_byte"].alias("first_byte"),
        b["last_byte"].alias("last_byte"),
    )
    return F.when(a["byte_count"] == 0, b).when(b["byte_count"] == 0, a).otherwise(both)


def fold_metrics(parts: Column) -> Column:
    """Metrics of slices in the order of their array."""
    kind = "struct<byte_count:bigint,terminator_count:bigint,first_byte:int,last_byte:int>"
    zero = F.struct(F.lit(0).cast("long").alias("byte_count"), F.lit(0).cast("long").alias("terminator_count"), F.lit(None).cast("int").alias("first_byte"), F.lit(None).cast("int").alias("last_byte")).cast(kind)
    return F.aggregate(parts, zero, lambda acc, x: merge_metrics(acc, x).cast(kind))


def metrics_lines(m: Column) -> Column:
    """Logical lines of metrics: terminators, and one more for an unterminated rest."""
    return m["terminator_count"] + F.when((m["byte_count"] > 0) & ~m["last_byte"].isin(10, 13), 1).otherwise(0)


def range_lines(data: Column | str, ends: Column | str, start: Column, end: Column) -> Column:
    """Logical lines of a slice taken on its own."""
    last = byte_at(data, end - 1)
    return range_terminators(data, ends, start, end) + F.when((start < end) & ~last.isin("\r", "\n"), 1).otherwise(0)


def declaration_extent(data: Column | str, start: Column, end: Column) -> Column:
    """The range grown to whole lines: back over blanks to its line's start, on over blanks and one terminator.

    It grows forward only over what is blank up to a terminator or the file's end, and not at all behind a terminator.
    """
    data = _col(data)
    size = F.length(data)

    def lead(first: Column) -> Column:
        return F.length(F.regexp_extract(latin1(F.substring(data, (first + 1).cast("int"), (start - first).cast("int"))), r"(?:^|[\r\n])([ \t]*)\z", 1))

    def trail(last: Column) -> Column:
        return F.length(F.regexp_extract(latin1(F.substring(data, (end + 1).cast("int"), F.greatest(last - end, F.lit(0)).cast("int"))), r"\A[ \t]*(?:\r\n|\r|\n|\z)", 0))

    # The bytes beside the range tell, but where they are blank throughout; so a range costs a few bytes, however long its file is.
    first, last = F.greatest(start - BESIDE, F.lit(0)), F.least(end + BESIDE, size)
    blank_before = (first > 0) & latin1(F.substring(data, (first + 1).cast("int"), (start - first).cast("int"))).rlike(r"\A[ \t]*\z")
    blank_after = (last < size) & latin1(F.substring(data, (end + 1).cast("int"), F.greatest(last - end, F.lit(0)).cast("int"))).rlike(r"\A[ \t]*\r?\z")
    back = F.when(blank_before, lead(F.lit(0))).otherwise(lead(first))
    on = F.when(blank_after, trail(size)).otherwise(trail(last))
    closed = byte_at(data, end - 1).isin("\r", "\n")
    return F.struct((start - back).cast("long").alias("start"), (end + F.when(closed, 0).otherwise(on)).cast("long").alias("end"))


def rest(data: Column | str, start: Column, end: Column) -> Column:
    """Bytes of a range that lies inside the data."""
    return F.substring(_col(data), (start + 1).cast("int"), (end - start).cast("int"))


def line_number(data: Column | str) -> Column:
    """Lines of whole bytes, counted without splitting them; strings are bytes here, of no charset."""
    text = _col(data).cast("string")
    size = F.octet_length(text)

    def gone(what: str) -> Column:
        return size - F.octet_length(F.replace(text, F.lit(what), F.lit("")))

    ends = gone("\n") + F.when(F.contains(text, F.lit("\r")), gone("\r") - gone("\r\n") / 2).otherwise(0)
    return (ends + F.when((size > 0) & ~F.endswith(text, F.lit("\n")) & ~F.endswith(text, F.lit("\r")), 1).otherwise(0)).cast("long")


def _common(a: Column, b: Column, at_end: bool) -> Column:
    """How many bytes are the same at the start (or the end): by halves, each byte compared about twice."""
    most = F.least(F.length(a), F.length(b))
    kind = "struct<same:int,most:int>"

    def halve(acc: Column, _: Column) -> Column:
        upto = F.ceil((acc["same"] + acc["most"]) / 2).cast("int")
        left, right = ((rest(x, F.length(x) - upto, F.length(x) - acc["same"]) if at_end else rest(x, acc["same"], upto)) for x in (a, b))
        return F.when(left == right, F.struct(upto.alias("same"), acc["most"].alias("most")).cast(kind)).otherwise(F.struct(acc["same"].alias("same"), (upto - 1).alias("most")).cast(kind))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("same"), most.alias("most")).cast(kind), halve, lambda acc: acc["same"])


def _borders(data: Column, at: Column) -> Column:
    """Whether a line ends, or the first one starts, at an offset of the data."""
    before, behind = byte_at(data, at - 1), byte_at(data, at)
    return (at == 0) | (at == F.length(data)) | (before == "\n") | ((before == "\r") & (behind != "\n"))


def common_start(a: Column | str, b: Column | str) -> Column:
    """Bytes of the lines that both begin with."""
    a, b = _col(a), _col(b)

    def whole(same: Column) -> Column:
        # The last line end before: behind it is a byte that is the same in both, so it ends a line in both or in none.
        upto = same - F.when((byte_at(a, same - 2) == "\r") & (byte_at(a, same - 1) == "\n"), 2).otherwise(1)
        text = F.when(upto > 0, rest(a, F.lit(0), upto)).cast("string")
        behind = F.least(*(F.octet_length(F.substring_index(text, x, -1)) for x in ("\n", "\r")))
        return F.when(_borders(a, same) & _borders(b, same), same).otherwise(F.coalesce(upto - behind, F.lit(0)))

    return let(_common(a, b, False), whole)


def common_end(a: Column | str, b: Column | str) -> Column:
    """Bytes of the lines that both end with."""
    a, b = _col(a), _col(b)

    def whole(same: Column) -> Column:
        text = rest(a, F.length(a) - same, F.length(a)).cast("string")
        lf, cr = (F.octet_length(F.substring_index(text, x, 1)) for x in ("\n", "\r"))
        first = F.least(F.when(lf == cr + 1, lf).otherwise(F.least(lf, cr)) + 1, same)
        return F.when(_borders(a, F.length(a) - same) & _borders(b, F.length(b) - same), same).otherwise(same - first)

    return let(_common(a, b, True), whole)
