"""The plan's digest: a deterministic CBOR record of positional arrays, hashed behind a domain.

Only metadata is encoded (paths, numbers, digests), and a batch is bounded by its own limits. :func:`record` is the rule for one plan in
memory, :func:`plan_records` the same for all batches of a frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Numbers of the record's variants.
KIND = {"move": 1, "copy": 2}
EFFECT = {"changed": 1, "no_op": 2}
CHANGE = {"unchanged": 1, "modified": 2, "created": 3, "emptied": 4}
SELECTOR = {"lines": 1, "bytes": 2}
ANCHOR = {"file_start": 1, "file_end": 2, "before_line": 3, "after_line": 4, "byte_offset": 5}
PLAN_VERSION = PROTOCOL_VERSION = 1


def head(major: int, value: int) -> bytes:
    """A CBOR head with the shortest argument."""
    if value < 24:
        return bytes([major << 5 | value])
    size = next(n for n in (1, 2, 4, 8) if value < 1 << 8 * n)
    return bytes([major << 5 | 23 + size.bit_length()]) + value.to_bytes(size, "big")


def cbor(value) -> bytes:
    """Unsigned integers, byte strings, text, arrays and null; nothing else has an encoding here."""
    if value is None:
        return b"\xf6"
    if isinstance(value, (bytes, bytearray)):
        return head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(cbor, value))
    if isinstance(value, bool) or value < 0 or value >= 1 << 64 or value != int(value):
        raise ValueError(f"no unsigned 64-bit number: {value!r}")
    return head(0, int(value))


def raw_digest(text: str | None) -> bytes | None:
    return None if text is None else bytes.fromhex(text.removeprefix("sha256:"))


def precondition(state: str, value: str | None) -> list:
    return [2] if state == "must_not_exist" else [1, raw_digest(value)]


def record(workspace: tuple[int, int], inputs: Iterable[dict], operations: Iterable[dict], outputs: Iterable[dict]) -> bytes:
    """The record of a plan: inputs and outputs by path bytes, operations by index, segments in order.

    ``inputs``: path, existed, parent, identity (pairs), length, sha256. ``operations``: index, kind, source_path, selector
    (kind, start, end), source_value, start, end, payload_sha256, destination_path, anchor (kind, value), destination_state,
    destination_value, offset, effect. ``outputs``: path, before_sha256, after_sha256, after_length, change_kind, segments
    (source_path, start, end, operation_index or None, payload_sha256).
    """
    known = sorted(inputs, key=lambda x: x["path"].encode())
    place = {x["path"]: k for k, x in enumerate(known) if x["existed"]}

    def one_input(x: dict) -> list:
        if not x["existed"]:
            return [x["path"], [0, *x["parent"]]]
        return [x["path"], [1, *x["parent"], *x["identity"], x["length"], raw_digest(x["sha256"])]]

    def one_anchor(kind: str, value: int | None) -> list:
        return [ANCHOR[kind]] if kind in ("file_start", "file_end") else [ANCHOR[kind], value]

    def one_operation(x: dict) -> list:
        kind, start, end = x["selector"]
        left = [x["index"], KIND[x["kind"]], x["source_path"], [SELECTOR[kind], start, end], precondition("sha256", x["source_value"]), x["start"], x["end"], raw_digest(x["payload_sha256"])]
        return [*left, x["destination_path"], one_anchor(*x["anchor"]), precondition(x["destination_state"], x["destination_value"]), x["offset"], EFFECT[x["effect"]]]

    def one_segment(x: dict) -> list:
        where = [place[x["source_path"]], x["start"], x["end"]]
        return [1, *where] if x["operation_index"] is None else [2, x["operation_index"], *where, raw_digest(x["payload_sha256"])]

    def one_output(x: dict) -> list:
        return [x["path"], raw_digest(x["before_sha256"]), raw_digest(x["after_sha256"]), x["after_length"], CHANGE[x["change_kind"]], [one_segment(s) for s in x["segments"]]]

    return cbor([PLAN_VERSION, PROTOCOL_VERSION, list(workspace), [one_input(x) for x in known], [one_operation(x) for x in sorted(operations, key=lambda x: x["index"])], [one_output(x) for x in sorted(outputs, key=lambda x: x["path"].encode())]])


def digest_of(encoded: bytes, domain: bytes = b"") -> str:
    return "sha256:" + hashlib.sha256(domain + encoded).hexdigest()


# --- The same record by column expressions, for all batches at once ---------------------------------------------------------


def head_of(major: int, value: Column) -> Column:
    """A CBOR head of any unsigned 64-bit number, as bytes."""
    digits = F.conv(value.cast("decimal(20,0)").cast("string"), 10, 16)

    def wide(code: int, places: int) -> Column:
        return F.concat(F.lit(f"{major << 5 | code:02X}"), F.lpad(digits, places, "0"))

    small = F.lpad(F.hex((value + (major << 5)).cast("int")), 2, "0")
    size = F.length(digits)
    text = F.when(value < 24, small).when(size <= 2, wide(24, 2)).when(size <= 4, wide(25, 4)).when(size <= 8, wide(26, 8)).otherwise(wide(27, 16))
    return F.unhex(text)


def number(value: Column) -> Column:
    return head_of(0, value)


def text_of(value: Column) -> Column:
    return F.concat(head_of(3, F.octet_length(value)), F.encode(value, "UTF-8"))


def digest_bytes(value: Column) -> Column:
    """A digest as a byte string, null where there is none."""
    raw = F.unhex(F.replace(value, F.lit("sha256:"), F.lit("")))
    return F.coalesce(F.concat(head_of(2, F.length(raw)), raw), F.unhex(F.lit("F6")))


def array_of(n: int) -> Column:
    return F.lit(head(4, n))


def chosen(column: Column, numbers: dict[str, int]) -> Column:
    return number(F.element_at(F.create_map(*(F.lit(x) for kv in numbers.items() for x in kv)), column))


def joined_in_order(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """An array of each key's parts, put together in order."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr(f"listagg(part) within group (order by {order})").alias("parts"))
    return each.select(*keys, F.concat(head_of(4, F.col("n")), F.col("parts")).alias(name))


def plan_records(inputs: DataFrame, ops: DataFrame, resolved: DataFrame, made: DataFrame, recipe: DataFrame, workspace: tuple[int, int] = (0, 0)) -> DataFrame:
    """``batch_id, record`` of every batch: :func:`record` without a Python worker. Parts are bytes from the first; each level is an aggregation that puts
    them together in their order, and an array's head its count."""
    zero = F.lit(0).cast("decimal(20,0)")
    known = inputs.select("batch_id", "path", "existed", "byte_length", "sha256", *(F.coalesce(F.col(c).cast("decimal(20,0)"), zero).alias(c) for c in ("device", "inode", "parent_device", "parent_inode")))
    absent = F.concat(array_of(3), number(F.lit(0)), number(F.col("parent_device")), number(F.col("parent_inode")))
    there = F.concat(array_of(7), number(F.lit(1)), *(number(F.col(c)) for c in ("parent_device", "parent_inode", "device", "inode", "byte_length")), digest_bytes(F.col("sha256")))
    one_input = known.select("batch_id", "path", F.concat(array_of(2), text_of(F.col("path")), F.when(F.col("existed"), there).otherwise(absent)).alias("part"))
    # Segments name their file by its place among all inputs of the batch, those that do not exist too.
    places = known.select("batch_id", F.col("path").alias("source_path"), (F.row_number().over(Window.partitionBy("batch_id").orderBy("path")) - 1).alias("input"))

    def wish(state: str, value: str) -> Column:
        return F.when(F.col(state) == "must_not_exist", F.concat(array_of(1), number(F.lit(2)))).otherwise(F.concat(array_of(2), number(F.lit(1)), digest_bytes(F.col(value))))

    both = ops.withColumn("source_state", F.lit("sha256")).join(resolved.select("batch_id", "operation_index", "source_start", "source_end", "payload_sha256", "destination_offset", "effect"), ["batch_id", "operation_index"])
    anchor = F.when(F.col("anchor_kind").isin("file_start", "file_end"), F.concat(array_of(1), chosen(F.col("anchor_kind"), ANCHOR))).otherwise(F.concat(array_of(2), chosen(F.col("anchor_kind"), ANCHOR), number(F.col("anchor_value"))))
    selector = F.concat(array_of(3), chosen(F.col("selector_kind"), SELECTOR), number(F.col("selector_start")), number(F.col("selector_end")))
    left = F.concat(array_of(13), number(F.col("operation_index")), chosen(F.col("kind"), KIND), text_of(F.col("source_path")), selector, wish("source_state", "source_value"), number(F.col("source_start")), number(F.col("source_end")), digest_bytes(F.col("payload_sha256")))
    right = F.concat(text_of(F.col("destination_path")), anchor, wish("destination_state", "destination_value"), number(F.col("destination_offset")), chosen(F.col("effect"), EFFECT))
    one_operation = both.select("batch_id", "operation_index", F.concat(left, right).alias("part"))

    where = F.concat(number(F.col("input")), number(F.col("start")), number(F.col("end")))
    original = F.concat(array_of(4), number(F.lit(1)), where)
    payload = F.concat(array_of(6), number(F.lit(2)), number(F.col("operation_index")), where, digest_bytes(F.col("payload_sha256")))
    one_segment = recipe.join(places, ["batch_id", "source_path"]).select("batch_id", "path", "seg", F.when(F.col("operation_index").isNull(), original).otherwise(payload).alias("part"))
    laid = made.join(joined_in_order(one_segment, ["batch_id", "path"], "seg", "segments"), ["batch_id", "path"], "left")
    shown = F.concat(array_of(6), text_of(F.col("path")), digest_bytes(F.col("before_sha256")), digest_bytes(F.col("after_sha256")), number(F.col("after_length")), chosen(F.col("change_kind"), CHANGE), F.coalesce("segments", array_of(0)))
    one_output = laid.select("batch_id", "path", shown.alias("part"))

    every = joined_in_order(one_operation, ["batch_id"], "operation_index", "ops").join(joined_in_order(one_input, ["batch_id"], "path", "ins"), "batch_id").join(joined_in_order(one_output, ["batch_id"], "path", "outs"), "batch_id", "left")
    first = F.lit(head(4, 6) + cbor(PLAN_VERSION) + cbor(PROTOCOL_VERSION) + cbor(list(workspace)))
    return every.select("batch_id", F.concat(first, F.col("ins"), F.col("ops"), F.coalesce("outs", array_of(0))).alias("record"))


def plan_digests(inputs: DataFrame, ops: DataFrame, resolved: DataFrame, made: DataFrame, recipe: DataFrame, workspace: tuple[int, int] = (0, 0), domain: bytes = b"") -> DataFrame:
    """``batch_id, plan_sha256`` of every batch.

    ``inputs(batch_id, path, existed, byte_length, sha256, device, inode, parent_device, parent_inode)``: identities that a
    source does not know count as 0, so digests agree only where they are given.
    """
    records = plan_records(inputs, ops, resolved, made, recipe, workspace)
    return records.select("batch_id", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(domain), F.col("record")), 256)).alias("plan_sha256"))
