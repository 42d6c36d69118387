"""Digests, path rules, encodings and escapes as column expressions. Nulls give nulls unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lines import _col, latin1

PATH_BYTES = 4096
SAMPLE_BYTES = 48


def digest(data: Column | str) -> Column:
    """``sha256:`` and 64 lower-case hex digits."""
    return F.concat(F.lit("sha256:"), F.sha2(_col(data), 256))


def is_digest(text: Column | str) -> Column:
    return _col(text).rlike(r"\Asha256:[0-9a-f]{64}\z")


def path_problem(path: Column | str, reserved: str = ".control") -> Column:
    """Why a workspace path is refused, by the first rule that it breaks; null for a good one."""
    p = _col(path)
    parts = F.split(p, "/", -1)
    return (
        F.when(F.octet_length(p) > PATH_BYTES, "too_long")
        .when(p == "", "empty")
        .when(p.contains("\0"), "nul")
        .when(p.startswith("/"), "absolute")
        .when(F.exists(parts, lambda c: c.isin("", ".", "..")), "component")
        .when(F.lower(F.get(parts, F.lit(0))) == reserved.lower(), "reserved")
    )


def identity_hash(device: Column | str, inode: Column | str, domain: Column | bytes = b"") -> Column:
    """SHA-256 over a domain and two unsigned 64-bit numbers, most significant byte first. Takes DECIMAL(20,0): above 2^63 too."""

    def bytes8(c: Column) -> Column:
        whole = c.cast("decimal(20,0)")
        high = F.floor(whole / F.lit(4294967296).cast("decimal(20,0)")).cast("long")
        low = (whole - high.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)")).cast("long")
        return F.concat(*(F.unhex(F.lpad(F.hex(x), 8, "0")) for x in (high, low)))

    prefix = F.lit(domain) if isinstance(domain, bytes) else domain
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(prefix, bytes8(_col(device)), bytes8(_col(inode))), 256))


def is_boundary(data: Column | str, offset: Column) -> Column:
    """Whether an offset lies inside the data (its end included) and not inside a UTF-8 character."""
    d = _col(data)
    at = F.hex(F.substring(d, (offset + 1).cast("int"), F.lit(1)))
    return (offset >= 0) & (offset <= F.length(d)) & ((offset == F.length(d)) | ~at.rlike("^[89AB]"))


def is_binary(data: Column | str) -> Column:
    """Holds a NUL, or is not UTF-8."""
    d = _col(data)
    return latin1(d).contains("\0") | ~F.is_valid_utf8(d.cast("string"))


def head_sample(data: Column | str) -> Column:
    return F.base64(F.substring(_col(data), 1, SAMPLE_BYTES))


def tail_sample(data: Column | str) -> Column:
    d = _col(data)
    return F.base64(F.substring(d, F.greatest(F.lit(1), F.length(d) - (SAMPLE_BYTES - 1)), F.lit(SAMPLE_BYTES)))


def json_cost(text: Column | str) -> Column:
    """Bytes that a text takes inside a JSON string, its quotes left out: 1 a byte, 2 a short escape, 6 a control."""
    t = _col(text)
    short = F.regexp_count(t, F.lit(r'[\x08\x09\x0A\x0C\x0D"\\]'))
    control = F.regexp_count(t, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    return (F.octet_length(t) + short + 5 * control).cast("long")


#: Characters that change the direction of text.
BIDI = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"


def terminal_escape(text: Column | str) -> Column:
    """Controls and direction marks written as ``\\u{hex}``."""
    bad = rf"[\x00-\x1F\x7F-\x9F{BIDI}]"

    def one(c: Column) -> Column:
        point = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 16)
        return F.when(c.rlike(bad), F.concat(F.lit("\\u{"), F.lower(point), F.lit("}"))).otherwise(c)

    return F.array_join(F.transform(F.split(_col(text), "", -1), one), "")


def redact_path(path: Column | str, mark: str = "<path>") -> Column:
    """Absolute POSIX, UNC and drive paths give way to a mark."""
    return F.when(_col(path).rlike(r"\A(?:/|\\\\|[A-Za-z]:[/\\])"), mark).otherwise(_col(path))


def json_line(value: Column) -> Column:
    """Compact JSON, nulls written out, and one LF."""
    return F.concat(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("\n"))


def exceeds_json(value: Column, limit: int) -> Column:
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"})) > limit


def contains_position(start: Column, end: Column, at: Column, length: Column) -> Column:
    """Whether a range holds a position; the file's end belongs to a non-empty range that reaches it."""
    return ((start <= at) & (at < end)) | ((at == length) & (end == length) & (start < end))


def range_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def commit_rank(kind: Column | str) -> Column:
    k = _col(kind)
    return F.when(k == "untouched", 0).when(k == "backed_up", 1).when(k == "installed", 2)


def is_transaction_id(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[0-9a-f]{32}\z")


def is_artifact_name(text: Column | str, kind: str | None = None, number: Column | None = None) -> Column:
    """A generated name; ``kind`` and ``number``: the very one of that kind and number."""
    if kind and number is not None:
        return _col(text) == F.concat(F.lit(f"{kind}-"), F.lpad(number.cast("string"), 8, "0"))
    return _col(text).rlike(r"\A(?:candidate|backup|state)-[0-9]{8}\z")
