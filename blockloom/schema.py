"""Schemas of the engine's tables and the error dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: outcomes of decoding, by code, and their messages.
ERRORS = [
    (0, "OK", ""),
    (3, "ERR_MAGIC", "bad stream header magic"),
    (4, "ERR_HEADER", "bad block header magic"),
    (5, "ERR_BITMAP", "empty source alphabet"),
    (6, "ERR_TREES", "bad number of trees"),
    (7, "ERR_GROUPS", "no coding groups"),
    (8, "ERR_SELECTOR", "invalid selector"),
    (9, "ERR_DELTA", "invalid delta code"),
    (10, "ERR_PREFIX", "invalid prefix code"),
    (11, "ERR_INCOMPLT", "incomplete prefix code"),
    (12, "ERR_EMPTY", "empty block"),
    (13, "ERR_UNTERM", "unterminated block"),
    (14, "ERR_RUNLEN", "missing run length"),
    (15, "ERR_BLKCRC", "block CRC mismatch"),
    (16, "ERR_STRMCRC", "stream CRC mismatch"),
    (17, "ERR_OVERFLOW", "block overflow"),
    (18, "ERR_BWTIDX", "primary index too large"),
    (19, "ERR_EOF", "unexpected end of file"),
]
CODE = {name: code for code, name, _ in ERRORS}
#: Not an error of a stream: the file does not begin as one.
NOT_COMPRESSED = -1

FILES = "path string, length bigint, content binary"
CHUNKS = "file_id string, major bigint, byte_off bigint, data binary"
BLOCKS = "file_id string, major bigint, minor bigint, level int, raw_off bigint, raw_len bigint, enc_len bigint, bits binary, n_bits bigint, crc bigint"
HEADERS = "file_id string, stream_no int, block_no int, bit_off bigint, end_bit bigint, level int, stored_crc bigint, randomised boolean, bwt_idx int, n_used int, n_trees int, n_selectors int, status int"
CANDIDATES = "file_id string, bit_off bigint, kind string"
DECODED = "file_id string, bit_off bigint, end_bit bigint, part int, data binary, crc bigint, blk_sz int, status int"


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code int, name string, message string")
