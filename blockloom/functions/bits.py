"""Bits of byte strings: slices at any alignment, concatenation, checksums."""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_MAGIC, END_MAGIC = 0x314159265359, 0x177245385090
MASK = 0xFFFFFFFF
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc(data: bytes) -> int:
    """CRC-32, most significant bit first."""
    return int(f"{zlib.crc32(data.translate(_FLIP)):032b}"[::-1], 2)


def combine(crcs: list[int]) -> int:
    acc = 0
    for c in crcs:
        acc = ((acc << 1 | acc >> 31) & MASK) ^ c
    return acc


def read(data: bytes, at: int, n: int) -> int:
    """n bits from bit `at`, as an unsigned number; bits past the end are 0."""
    last = (at + n + 7) // 8
    piece = data[at // 8 : last]
    value = int.from_bytes(piece.ljust(last - at // 8, b"\0"), "big")
    return value >> (last * 8 - at - n) & ((1 << n) - 1)


def cut(data: bytes, at: int, end: int) -> bytes:
    """Bits at..end, moved to a byte boundary and zero-padded."""
    n = end - at
    return (read(data, at, n) << (-n % 8)).to_bytes((n + 7) // 8, "big")


class Writer:
    """Appends bit strings; whole bytes leave as they fill."""

    def __init__(self) -> None:
        self.out, self.rest, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        value = self.rest << n | value
        n += self.n
        keep = n % 8
        self.out += (value >> keep).to_bytes((n - keep) // 8, "big")
        self.rest, self.n = value & ((1 << keep) - 1), keep

    def put_bits(self, data: bytes, n: int) -> None:
        """The first n bits of data."""
        self.put(int.from_bytes(data, "big") >> (8 * len(data) - n), n)

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.rest << (8 - self.n)]) if self.n else b"")


def pack(values: np.ndarray, widths: np.ndarray) -> tuple[bytes, int]:
    """(bits, their number) of values one after the other, each in its width."""
    end = np.cumsum(widths)
    n = int(end[-1])
    left = np.repeat(end, widths) - np.arange(n) - 1  # bits of the same value behind this one
    return np.packbits((np.repeat(values, widths) >> left & 1).astype(np.uint8)).tobytes(), n


def find_magics(data: bytes, magic: int) -> list[int]:
    """Bit offsets of a 48-bit pattern at any alignment: five whole bytes are sought, the edges compared."""
    found = []
    for shift in range(8):
        whole = (magic << 8 >> shift).to_bytes(7, "big")
        core = whole[1:6]
        at = data.find(core)
        while at >= 0:
            bit = 8 * (at - 1) + shift
            if bit >= 0 and bit + 48 <= 8 * len(data) and read(data, bit, 48) == magic:
                found.append(bit)
            at = data.find(core, at + 1)
    return sorted(found)
