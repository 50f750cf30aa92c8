"""Column expressions of the format: checksums, sizes, names, metrics. No Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.schema import CODE

MASK = 0xFFFFFFFF
#: Hex digits with their four bits reversed, in order of the digit.
_NIBBLES = "".join(f"{int(f'{i:04b}'[::-1], 2):X}" for i in range(16))
_HEX = "0123456789ABCDEF"


def rotl32(x: Column, n: Column | int) -> Column:
    """Rotates an unsigned 32-bit value held in a bigint."""
    n = F.lit(n) if isinstance(n, int) else n
    return (F.call_function("shiftleft", x, n.cast("int")).bitwiseOR(F.call_function("shiftrightunsigned", x, (32 - n).cast("int")))).bitwiseAND(F.lit(MASK))


def block_crc(data: Column) -> Column:
    """CRC-32 most significant bit first, from the reflected built-in: reverse the bits of each byte and of the result."""
    reflected = F.unhex(F.translate(F.regexp_replace(F.hex(data), "(.)(.)", "$2$1"), _HEX, _NIBBLES))
    swapped = F.translate(F.reverse(F.lpad(F.hex(F.crc32(reflected)), 8, "0")), _HEX, _NIBBLES)
    return F.conv(swapped, 16, 10).cast("bigint")


def combined_crc(crc: Column, place: Column, n: Column) -> Column:
    """Aggregate: a stream's CRC of its n blocks' CRCs, place counting from 0. Order-free form of rotl(acc, 1) ^ crc."""
    return F.bit_xor(rotl32(crc, F.pmod(n - 1 - place, F.lit(32))))


def rle_length(run: Column) -> Column:
    """Bytes that a whole run takes after initial run-length coding: 4 equal bytes and a count for up to 259."""
    whole, rest = F.floor(run / 259), run % 259
    return (whole * 5 + F.when(rest < 4, rest).otherwise(5)).cast("bigint")


def tree_count(n_symbols: Column) -> Column:
    """Prefix trees for so many symbols; a lone tree is written as two."""
    return F.when(n_symbols > 2400, 6).when(n_symbols > 1200, 5).when(n_symbols > 600, 4).when(n_symbols > 300, 3).otherwise(2)


def group_count(n_symbols: Column) -> Column:
    return F.ceil(n_symbols / 50).cast("bigint")


def signature_level(data: Column) -> Column:
    """1 to 9 where data start as a compressed stream, else null."""
    text = F.substring(data, 1, 4).cast("string")
    return F.when(text.rlike("^BZh[1-9]$"), F.substring(text, 4, 1).cast("int"))


def is_compressed_name(name: Column) -> Column:
    """Names that compression skips."""
    return name.endswith(".bz2") | name.endswith(".tbz2") | name.endswith(".tbz") | name.endswith(".tz2")


def output_name(name: Column) -> Column:
    """Name of the decompressed file."""
    cut = lambda n: F.substr(name, F.lit(1), F.length(name) - n)
    return F.when(name.endswith(".bz2"), cut(4)).when(name.endswith(".tbz2"), F.concat(cut(5), F.lit(".tar"))).when(name.endswith(".tbz") | name.endswith(".tz2"), F.concat(cut(4), F.lit(".tar"))).otherwise(F.concat(name, F.lit(".out")))


def size_literal(text: Column, lower: int = 0, upper: int = (1 << 63) - 1) -> Column:
    """A count with an optional K, M, G, T, P or E (powers of 1024, any case); null if malformed or out of bounds."""
    digits = F.regexp_extract(text, r"^\s*\+?([0-9]+)[EePpTtGgMmKk]?$", 1)
    unit = F.upper(F.regexp_extract(text, r"([EePpTtGgMmKk])$", 1))
    shift = F.when(unit == "", 0).otherwise(F.instr(F.lit("KMGTPE"), unit) * 10)
    value = F.when(digits != "", digits.try_cast("bigint"))
    fits = value <= F.call_function("shiftrightunsigned", F.lit((1 << 63) - 1), shift.cast("int"))
    scaled = F.call_function("shiftleft", value, shift.cast("int"))
    return F.when(fits & scaled.between(lower, upper), scaled)


def ratio(compressed: Column, plain: Column) -> Column:
    return F.when((plain > 0) & (compressed > 0), compressed / plain)


def savings(compressed: Column, plain: Column) -> Column:
    return 1 - ratio(compressed, plain)


def ratio_text(compressed: Column, plain: Column) -> Column:
    """As the verbose message words it: 1:x for a gain, x:1 for a loss."""
    r = ratio(compressed, plain)
    return F.when(r < 1, F.concat(F.lit("1:"), F.format_string("%.3f", 1 / r))).otherwise(F.concat(F.format_string("%.3f", r), F.lit(":1")))


def stream_header(level: Column) -> Column:
    return F.concat(F.lit("BZh"), level.cast("string")).cast("binary")


def stream_trailer(crc: Column) -> Column:
    """End magic and the stream's CRC, at a byte boundary."""
    return F.unhex(F.concat(F.lit("177245385090"), F.lpad(F.hex(crc), 8, "0")))


def padding_bits(n_bits: Column) -> Column:
    """Bits that bring a block to a whole byte."""
    return F.pmod(-n_bits, F.lit(8))


def structural_status(n_used: Column, n_trees: Column, n_groups: Column, top_rank: Column, least_length: Column, most_length: Column, ended: Column, n_out: Column, bwt_idx: Column) -> Column:
    """Error code of a block by its fields, the first fault in reading order; 0 if none of them shows one. Fields behind a fault may be null."""
    rules = [
        ("ERR_BITMAP", n_used == 0),
        ("ERR_TREES", ~n_trees.between(2, 6)),
        ("ERR_GROUPS", n_groups == 0),
        ("ERR_SELECTOR", top_rank >= n_trees),
        ("ERR_DELTA", (least_length < 1) | (most_length > 20)),
        ("ERR_UNTERM", ~ended),
        ("ERR_EMPTY", n_out == 0),
        ("ERR_BWTIDX", bwt_idx >= n_out),
    ]
    out = F
    for name, fault in rules:
        out = out.when(fault, CODE[name])
    return out.otherwise(0)
