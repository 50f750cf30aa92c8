"""Where the fields of a block stand: blocks that end at whole bytes, fields of broken ones, and streams spoilt in known ways."""

from __future__ import annotations

from dataclasses import dataclass

from blockloom.functions import bits, codec

#: Bits of the longest header of a block: 18 002 ranks of at most 6 bits, six trees of 258 lengths with all the steps there are.
WINDOW = 18_002 * 6 + 6 * (5 + 258 * 39) + 500


@dataclass
class Layout:
    """Bit offsets in a block from its magic on: bitmap, number of trees, ranks, first length of each tree, first symbol."""

    bitmap: int
    trees: int
    ranks: int
    tables: list[int]
    symbols: int
    n_groups: int


def layout(data: bytes, at: int = 0) -> Layout:
    """Of a sound block whose magic is at bit `at`."""
    n = min(8 * len(data) - at, WINDOW)
    s = f"{bits.read(data, at, n):0{n}b}"
    bitmap = 105
    rows = s.count("1", bitmap, bitmap + 16)
    i = trees = bitmap + 16 + 16 * rows
    n_used = s.count("1", bitmap + 16, trees)
    n_trees, n_groups = int(s[i : i + 3], 2), int(s[i + 3 : i + 18], 2)
    i = ranks = trees + 18
    for _ in range(n_groups):
        i = s.index("0", i) + 1
    tables = []
    for _ in range(n_trees):
        tables.append(i)
        i += 5
        for _ in range(n_used + 2):
            while s[i] == "1":
                i += 2
            i += 1
    return Layout(bitmap, trees, ranks, tables, i, n_groups)


def align(data: bytes, n: int) -> tuple[bytes, int]:
    """A block of n bits, lengthened to whole bytes: it decodes to the same.

    One group more than needed takes a bit; a first length that steps away and back takes two a step.
    """
    odd, steps = -n % 8 % 2, -n % 8 // 2
    if not odd and not steps:
        return data[: n // 8], n
    f = layout(data)
    first, rest = bits.read(data, f.tables[0], 5), f.tables[0] + 5
    up = first + steps <= codec.MAX_LENGTH
    w = bits.Writer()
    w.put(bits.read(data, 0, f.trees + 3), f.trees + 3)
    w.put(f.n_groups + odd, 15)
    w.put(bits.read(data, f.ranks, f.tables[0] - f.ranks), f.tables[0] - f.ranks)
    w.put(0, odd)
    w.put(first + steps if up else first - steps, 5)
    for _ in range(steps):
        w.put(0b11 if up else 0b10, 2)
    w.put(bits.read(data, rest, n - rest), n - rest)
    return w.done(), 8 * len(w.out)


@dataclass
class Fields:
    """What a block's header says and its symbols come to, as far as they can be read; None behind the first fault."""

    n_used: int | None = None
    n_trees: int | None = None
    n_groups: int | None = None
    top_rank: int | None = None
    least_length: int | None = None
    most_length: int | None = None
    ended: bool | None = None
    n_out: int | None = None
    bwt_idx: int | None = None


def fields(data: bytes, at: int) -> Fields:
    """Of any block whose magic is at bit `at`, a broken one too."""
    out, r = Fields(), codec._Reader(data, at + 81)
    try:
        index, big = r.get(24), r.get(16)
        used = [16 * row + i for row in range(16) if big >> (15 - row) & 1 for small in [r.get(16)] for i in range(16) if small >> (15 - i) & 1]
        out.n_used, out.n_trees, out.n_groups, out.bwt_idx = len(used), r.get(3), r.get(15), index
        if not used or not 2 <= out.n_trees <= 6 or not out.n_groups:
            return out
        ranks = []
        for _ in range(out.n_groups):
            rank = 0
            while rank < out.n_trees and r.get(1):
                rank += 1
            out.top_rank = max(out.top_rank or 0, rank)
            if rank == out.n_trees:
                return out
            ranks.append(rank)
        trees = []
        for _ in range(out.n_trees):
            now, lengths, seen = r.get(5), [], []
            seen.append(now)
            while len(lengths) < len(used) + 2 and all(1 <= x <= codec.MAX_LENGTH for x in seen[-1:]):
                if r.get(1):
                    now += 1 - 2 * r.get(1)
                    seen.append(now)
                else:
                    lengths.append(now)
            out.least_length = min([*seen, *filter(None, [out.least_length])])
            out.most_length = max(*seen, out.most_length or 0)
            if len(lengths) < len(used) + 2:
                return out
            trees.append(lengths)
        try:
            found, zeros = codec._ranks(r, len(used), trees, codec.imtf(ranks, list(range(out.n_trees))))
            out.ended, out.n_out = True, len(found) + int(zeros.sum())
        except codec.Broken as e:
            if e.args[0] in ("ERR_EMPTY", "ERR_UNTERM"):
                out.ended, out.n_out = e.args[0] == "ERR_EMPTY", 0
    except codec.Broken:
        pass
    return out


def craft(lengths: list[int], syms: list[int], used: bytes = b"a") -> bytes:
    """A block made by hand, behind its stream's header: the same lengths in both trees, one group."""
    w = bits.Writer()
    w.put(bits.BLOCK_MAGIC << 32, 80)
    w.put(0, 25)
    w.put(1 << (15 - used[0] // 16), 16)
    w.put(sum(1 << (15 - b % 16) for b in used), 16)
    w.put(2, 3)
    w.put(1, 15)
    w.put(0, 1)
    for _ in range(2):
        now = lengths[0]
        w.put(now, 5)
        for n in lengths:
            while n != now:
                w.put(0b10 if n > now else 0b11, 2)
                now += 1 if n > now else -1
            w.put(0, 1)
    codes = codec.canonical(lengths)
    for s in syms:
        w.put(codes[s], lengths[s])
    return b"BZh9" + w.done() + b"\0" * 8


#: Blocks of one fault each.
_CRAFTED = {
    "ERR_PREFIX": ([1, 1, 1], [2]),
    "ERR_INCOMPLT": ([2, 2, 2], [2]),
    "ERR_EMPTY": ([1, 2, 2], [2]),
    "ERR_RUNLEN": ([1, 2, 2], [1, 0, 2]),  # four times a, and no count
    "ERR_OVERFLOW": ([1, 2, 2], [1] * 30),
}
#: The error that spoil() can bring about.
KINDS = ["ERR_HEADER", "ERR_BITMAP", "ERR_TREES", "ERR_GROUPS", "ERR_SELECTOR", "ERR_DELTA", "ERR_PREFIX", "ERR_INCOMPLT", "ERR_EMPTY", "ERR_UNTERM", "ERR_RUNLEN", "ERR_BLKCRC", "ERR_STRMCRC", "ERR_OVERFLOW", "ERR_BWTIDX", "ERR_EOF"]


def patched(data: bytes, at: int, n: int, value: int) -> bytes:
    shift = 8 * len(data) - at - n
    whole = int.from_bytes(data, "big")
    return (whole & ~(((1 << n) - 1) << shift) | value << shift).to_bytes(len(data), "big")


def spoil(data: bytes, kind: str) -> bytes:
    """A sound stream with one fault of the kind: in its first block, in its end, or in a stream put behind it."""
    at = 32
    if kind in _CRAFTED:
        return data + craft(*_CRAFTED[kind])
    if kind == "ERR_UNTERM":
        return data + craft([2, 2, 2, 3, 3], [2] * 50, b"abc")
    if kind == "ERR_EOF":
        return data[:-5]
    if kind == "ERR_STRMCRC":
        end = bits.find_magics(data, bits.END_MAGIC)[-1]
        return patched(data, end + 48, 32, bits.read(data, end + 48, 32) ^ 1)
    f = layout(data, at)
    where, n, value = {
        "ERR_HEADER": (0, 48, bits.BLOCK_MAGIC ^ 1),
        "ERR_BLKCRC": (48, 32, bits.read(data, at + 48, 32) ^ 1),
        "ERR_BWTIDX": (81, 24, (1 << 24) - 1),
        "ERR_BITMAP": (f.bitmap, 16, 0),
        "ERR_TREES": (f.trees, 3, 7),
        "ERR_GROUPS": (f.trees + 3, 15, 0),
        "ERR_SELECTOR": (f.ranks, 6, 63),
        "ERR_DELTA": (f.tables[0], 5, 0),
    }[kind]
    return patched(data, at + where, n, value)
