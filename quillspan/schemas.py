"""Schemas and the small fixed tables. Every schema is stated, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

U64 = "decimal(20,0)"  #: unsigned 64-bit numbers at the edges; inside bounds they become bigint

FILES = f"path string, existed boolean, bytes binary, sha256 string, device {U64}, inode {U64}, parent_device {U64}, parent_inode {U64}, link_count {U64}"
SELECTOR = f"struct<kind:string,start:{U64},end:{U64}>"
ANCHOR = f"struct<kind:string,line:{U64},offset:{U64}>"
PRECONDITION = "struct<kind:string,value:string>"
SOURCE = f"struct<path:string,selector:{SELECTOR},precondition:{PRECONDITION}>"
DESTINATION = f"struct<path:string,anchor:{ANCHOR},precondition:{PRECONDITION}>"
OPERATIONS = f"batch_id string, operation_index bigint, kind string, source {SOURCE}, destination {DESTINATION}"

# Error codes by category, categories by exit code, and the codes that may be tried again.
CATEGORY_CODES = {
    "request": "INVALID_CLI INVALID_JSON UNSUPPORTED_PROTOCOL_VERSION INVALID_REQUEST INVALID_DIGEST",
    "conflict": "PRECONDITION_FAILED FILE_CHANGED FILE_ALIAS EXPECTED_PLAN_REQUIRED EXPECTED_PLAN_MISMATCH PLAN_CHANGED_DURING_COMMIT EDIT_CONFLICT RECOVERY_CONFLICT",
    "limit_or_support": "RESOURCE_LIMIT_EXCEEDED UNSUPPORTED_PLATFORM UNSUPPORTED_FILESYSTEM UNSUPPORTED_FILE_TYPE SYMLINK_NOT_ALLOWED HARD_LINK_NOT_SUPPORTED CROSS_DEVICE_TRANSACTION NO_REPLACE_UNAVAILABLE",
    "transaction": "TRANSACTION_BUSY TRANSACTION_RECOVERY_REQUIRED TRANSACTION_NOT_FOUND RECOVERY_ACTION_NOT_ALLOWED",
    "corruption": "CONTROL_DIRECTORY_INVALID TRANSACTION_RECORD_CORRUPT",
    "internal": "IO_ERROR INTERNAL_ERROR",
}
EXIT_CODES = {"request": 2, "conflict": 3, "limit_or_support": 4, "transaction": 5, "corruption": 6, "internal": 8}
RETRYABLE = {"PRECONDITION_FAILED", "FILE_CHANGED", "EXPECTED_PLAN_MISMATCH", "PLAN_CHANGED_DURING_COMMIT", "TRANSACTION_BUSY"}
WARNING_CODES = ("OBSERVATION_MAY_BE_STALE", "METADATA_NOT_PRESERVED", "DIFF_TRUNCATED")
SELECTION_CODES = {
    "INVALID_SELECTION_QUERY": ("request", 2, False), "LSP_SERVER_NOT_CONFIGURED": ("support", 4, False), "SELECTION_NOT_FOUND": ("conflict", 3, False),
    "SELECTION_AMBIGUOUS": ("conflict", 3, False), "UNSUPPORTED_TEXT_ENCODING": ("support", 4, False), "LSP_CAPABILITY_UNAVAILABLE": ("support", 4, False),
    "LSP_FLAT_SYMBOLS_UNSUPPORTED": ("support", 4, False), "LSP_DOCUMENT_SYNC_UNAVAILABLE": ("support", 4, False), "LSP_RESOURCE_LIMIT_EXCEEDED": ("support", 4, False),
    "LSP_TIMEOUT": ("support", 4, True), "LSP_START_FAILED": ("support", 4, True), "LSP_EXITED": ("support", 4, True), "LSP_PROTOCOL_ERROR": ("support", 4, False),
    "LSP_REQUEST_FAILED": ("support", 4, True), "SELECTION_INTERNAL_ERROR": ("internal", 8, False),
}

OUTLINE_CODES = {
    "INVALID_OUTLINE_QUERY": ("request", 2, False), "LSP_SERVER_NOT_CONFIGURED": ("support", 4, False), "UNSUPPORTED_TEXT_ENCODING": ("support", 4, False),
    "LSP_CAPABILITY_UNAVAILABLE": ("support", 4, False), "LSP_FLAT_SYMBOLS_UNSUPPORTED": ("support", 4, False), "LSP_DOCUMENT_SYNC_UNAVAILABLE": ("support", 4, False),
    "LSP_RESOURCE_LIMIT_EXCEEDED": ("support", 4, False), "LSP_TIMEOUT": ("support", 4, True), "LSP_START_FAILED": ("support", 4, True), "LSP_EXITED": ("support", 4, True),
    "LSP_PROTOCOL_ERROR": ("support", 4, False), "LSP_REQUEST_FAILED": ("support", 4, True), "OUTLINE_INTERNAL_ERROR": ("internal", 8, False),
}

# The language-server protocol's symbol kinds, numbered from 1.
SYMBOL_KINDS = "file module namespace package class method property field constructor enum interface function variable constant string number boolean array object key null enum_member struct event operator type_parameter".split()


def error_codes(spark: SparkSession) -> DataFrame:
    rows = [(code, category, EXIT_CODES[category], code in RETRYABLE) for category, codes in CATEGORY_CODES.items() for code in codes.split()]
    return spark.createDataFrame(rows, "code string, category string, exit_code int, retryable boolean")


def outline_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *OUTLINE_CODES[c]) for c in OUTLINE_CODES], "code string, category string, exit_code int, retryable boolean")


def warning_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in WARNING_CODES], "code string")


def selection_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *x) for c, x in SELECTION_CODES.items()], "code string, category string, exit_code int, retryable boolean")


def symbol_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k + 1, name) for k, name in enumerate(SYMBOL_KINDS)], "number int, kind string")
