"""The block codec: run lengths, rotation sort, move to front, prefix codes; and the reader with error codes."""

from __future__ import annotations

import bisect
import bz2
import heapq
import itertools
import operator
import re
from dataclasses import dataclass

import numpy as np

from blockloom.functions import bits
from blockloom.schema import CODE, ERRORS

RUN = 259  # bytes that 4 equal ones and their count byte stand for at most
GROUP = 50
MAX_LENGTH = 20
MAX_BLOCK = 900_000
#: Post-run-length bytes that the standard library packs in one block of a level, less this many.
SPARE = 19
#: Four equal bytes and their count, if any is left.
_FOUR = re.compile(rb"(.)\1\1\1(.?)", re.DOTALL)


# --- initial run-length coding


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, byte, length) of the maximal runs."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), a, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return start, a[start], np.diff(np.concatenate([start, [len(a)]]))


def _pieces(value: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into pieces of at most RUN bytes."""
    n = -(-length // RUN)
    of = np.repeat(np.arange(len(length)), n)
    last = np.cumsum(n) - 1
    size = np.full(len(of), RUN, np.int64)
    size[last] = length - (n - 1) * RUN
    return value[of], size


def rle_encode(data: bytes) -> bytes:
    _, value, length = runs(data)
    if not len(value):
        return b""
    value, size = _pieces(value, length)
    width = np.where(size < 4, size, 5)
    out = np.repeat(value, width)
    out[(np.cumsum(width) - 1)[size >= 4]] = size[size >= 4] - 4
    return out.tobytes()


def rle_decode(data: bytes) -> bytes | None:
    """The plain bytes; None where data end right after four equal bytes."""
    a = np.frombuffer(data, np.uint8)
    same = a[1:] == a[:-1]
    if not (same[2:] & same[1:-1] & same[:-2]).any():
        return data
    out, at = bytearray(), 0
    for m in _FOUR.finditer(data):
        if not m[2]:
            return None
        out += data[at : m.start()] + m[1] * (4 + m[2][0])
        at = m.end()
    return bytes(out + data[at:])


def fill_block(data: bytes, at: int, limit: int) -> int:
    """End of the raw bytes from `at` that fill one block: greedy, a full block may cut a run.

    A fourth equal byte is refused where its count byte has no room, and ends the block.
    """
    chunk = data[at : at + limit * 52 + RUN]  # limit bytes stand for at most 259/5 as many
    start, value, length = runs(chunk)
    if not len(start):
        return at
    n = -(-length // RUN)
    rest = length - (n - 1) * RUN
    cost = (n - 1) * 5 + np.where(rest < 4, rest, 5)
    total = np.cumsum(cost)
    k = int(np.searchsorted(total, limit, "right"))  # whole runs that fit
    if k == len(start):
        return at + len(chunk)
    room = limit - (int(total[k - 1]) if k else 0)
    taken, left = 0, int(length[k])
    while left and room:
        p = min(left, RUN)
        if p >= 4 and room >= 5:
            taken, left, room = taken + p, left - p, room - 5
        else:
            take = min(p, 3, room)
            taken, left, room = taken + take, left - take, room - take
            if p >= 4:
                break
    return at + int(start[k]) + taken


def split_parallel(data: bytes, level: int) -> list[tuple[int, int, int, int]]:
    """(major, minor, start, end): every chunk of level * 100000 raw bytes begins a block."""
    size, out = level * 100_000, []
    for major in range(0, -(-len(data) // size)):
        at, end, minor = major * size, min(len(data), (major + 1) * size), 0
        while at < end:
            to = min(fill_block(data[:end], at, size), end)
            out.append((major, minor, at, to))
            at, minor = to, minor + 1
    return out


def split_sequential(data: bytes, limit: int) -> list[tuple[int, int, int, int]]:
    """The same, blocks being filled one after the other."""
    at, out = 0, []
    while at < len(data):
        to = fill_block(data, at, limit)
        out.append((len(out), 0, at, to))
        at = to
    return out


# --- rotation sort


def bwt(data: bytes) -> tuple[bytes, int]:
    """Last column of the sorted rotations and the row of the text; equal rotations by position.

    Rotations are sorted by seven bytes, then by doubling, in which only those take part whose rank is shared.
    """
    n = len(data)
    if n == 0:
        return b"", 0
    a = np.frombuffer(data, np.uint8)
    key, k = np.zeros(n, np.int64), 7
    for j in range(k):
        key = key << 8 | np.roll(a, -(j % n))
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n, np.int64)  # the place of the first rotation that is equal as far as is known
    place, who = np.arange(n), order
    while True:
        first = np.append(True, key[1:] != key[:-1])
        rank[who] = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
        shared = ~(first & np.append(first[1:], True))
        place, who = place[shared], who[shared]
        if k >= n or not len(place):
            break
        key = rank[who] * n + rank[(who + k) % n]
        by = np.argsort(key, kind="stable")
        key, who = key[by], who[by]
        order[place] = who
        k *= 2
    return a[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def ibwt(last: bytes, index: int) -> bytes:
    """Follows the rows by doubling the known part of the walk."""
    n = len(last)
    if not n:
        return b""
    a = np.frombuffer(last, np.uint8)
    step = np.argsort(a, kind="stable")
    walk = step[[index]]
    while len(walk) < n:
        walk = np.concatenate([walk, step[walk]])
        step = step[step]
    # walk holds powers 1, 2, 4, .. interleaved in order: position i of it is the i-th row
    return a[walk[:n]].tobytes()


# --- move to front and zero runs


def mtf(data: bytes | list[int], alphabet: list[int]) -> list[int]:
    """Rank of each byte among those seen last; a repeated byte has rank 0, so only changes are looked at one by one."""
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else np.array(data, np.int64)
    out, front = np.zeros(len(a), np.int64), bytearray(alphabet)
    change = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    ranks = []
    for b in a[change].tolist():
        i = front.index(b)
        ranks.append(i)
        if i:
            del front[i]
            front.insert(0, b)
    out[change] = ranks
    return out.tolist()


def imtf(ranks: list[int], alphabet: list[int]) -> list[int]:
    front, out = list(alphabet), []
    for i in ranks:
        b = front[i]
        out.append(b)
        if i:
            del front[i]
            front.insert(0, b)
    return out


def zero_run(n: int) -> list[int]:
    """A run of n zeros in bijective base 2, digits 1 and 2 written as symbols 0 and 1, least first."""
    out = []
    while n:
        out.append(0 if n & 1 else 1)
        n = (n - 1) >> 1
    return out


def symbols(ranks: list[int], n_used: int) -> list[int]:
    """Ranks above 0 are symbols one higher; the last symbol ends the block."""
    r = np.array(ranks, np.int64)
    at = np.flatnonzero(r)
    zeros = np.diff(at, prepend=-1, append=len(r)) - 1
    size = np.log2(zeros + 1).astype(np.int64) + 1  # digits of a run of zeros and the symbol behind
    end = np.cumsum(size)
    out = np.repeat(zeros + 1, size) >> np.arange(end[-1]) - np.repeat(end - size, size) & 1
    out[end - 1] = np.append(r[at] + 1, n_used + 1)
    return out.tolist()


# --- prefix codes


def huffman_lengths(freq: list[int]) -> list[int]:
    """Depths of an unlimited optimal tree."""
    n = len(freq)
    heap = [(max(f, 1) << 20) + i for i, f in enumerate(freq)]  # weight, then number of the node
    heapq.heapify(heap)
    above, low = [0] * (2 * n), (1 << 20) - 1
    for top in range(n, 2 * n - 1):
        a = heapq.heappop(heap)
        b = heap[0]
        above[a & low] = above[b & low] = top
        heapq.heapreplace(heap, (a >> 20) + (b >> 20) << 20 | top)
    depth = [0] * (2 * n)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[above[i]] + 1
    return depth[:n]


def limited_lengths(freq: list[int], limit: int = MAX_LENGTH) -> list[int]:
    """Optimal lengths of at most limit, by packages of coins."""
    coins = sorted((max(f, 1), (i,)) for i, f in enumerate(freq))
    row: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(limit):
        row = sorted(coins + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)], key=lambda x: x[0])
    length = [0] * len(freq)
    for _, who in row[: 2 * len(freq) - 2]:
        for i in who:
            length[i] += 1
    return length


def code_lengths(freq: list[int], limit: int = MAX_LENGTH) -> list[int]:
    depth = huffman_lengths(freq)
    return depth if max(depth) <= limit else limited_lengths(freq, limit)


def tree_bits(lengths: list[int]) -> int:
    """Bits that a tree takes in a block's header: a first length, then a bit a symbol and two a step."""
    return 5 + len(lengths) + 2 * sum(abs(a - b) for a, b in zip(lengths, lengths[1:], strict=False))


def cheapest_lengths(freq: list[int]) -> list[int]:
    """Of the optimal lengths for each limit those that cost least with their tree: flatter trees take fewer steps to write.

    Packages for a limit come from those for the limit below, so one pass gives them all.
    """
    n, best, least = len(freq), [], 0
    order = sorted(range(n), key=lambda i: max(freq[i], 1))
    coins = [max(freq[i], 1) << 1 for i in order]  # packages are odd, so behind coins of their weight
    row: list[int] = []
    packages: list[list[int]] = []  # how many there are among the first ones of each row
    for limit in range(1, MAX_LENGTH + 1):
        row = sorted(coins + [(a >> 1) + (b >> 1) << 1 | 1 for a, b in zip(row[::2], row[1::2], strict=False)])
        packages.append(list(itertools.accumulate((x & 1 for x in row), initial=0)))
        if 1 << limit < n:
            continue
        size, ends = 2 * n - 2, [0] * (n + 1)
        for among in reversed(packages):  # the least coins of each row are taken, and what its packages hold of the row below
            size = min(size, len(among) - 1)
            ends[size - among[size]] += 1
            size = 2 * among[size]
        lengths, taken = [0] * n, 0
        for i in range(n - 1, -1, -1):
            taken += ends[i + 1]
            lengths[order[i]] = taken
        cost = sum(map(operator.mul, lengths, freq)) + tree_bits(lengths)
        if not best or cost < least:
            best, least = lengths, cost
        if max(lengths) < limit:
            break
    return best


def canonical(lengths: list[int]) -> list[int]:
    """Codes in order of (length, symbol)."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def tree_count(n: int) -> int:
    return 6 if n > 2400 else 5 if n > 1200 else 4 if n > 600 else 3 if n > 300 else 2


def choose_trees(syms: list[int], n_alpha: int, rounds: int = 8) -> tuple[list[list[int]], list[int]]:
    """(lengths of each tree, tree of each group) by alternating: groups to their cheapest tree, trees to their groups."""
    s, k = np.array(syms), tree_count(len(syms))
    freq = np.bincount(s, minlength=n_alpha)
    share = np.minimum((np.cumsum(freq) - freq / 2) * k // max(1, freq.sum()), k - 1).astype(int)
    table = np.where(share[None, :] == np.arange(k)[:, None], 0, 15)
    at = np.arange(0, len(s), GROUP)
    group = np.arange(len(s)) // GROUP
    select, count = np.zeros(len(at), int), None
    for _ in range(rounds):
        before, select = select, np.add.reduceat(table[:, s], at, axis=1).argmin(0)
        if count is not None and (select == before).all():
            break  # the trees would be the same too
        count = np.bincount(select[group] * n_alpha + s, minlength=k * n_alpha).reshape(k, n_alpha)
        table = np.array([code_lengths(c.tolist()) for c in count])
    table = np.array([cheapest_lengths(c.tolist()) for c in count])
    used = list(dict.fromkeys(select.tolist()))  # trees in order of first use; unused ones are left out, but a block has two at least
    used += [t for t in range(k) if t not in used][: max(0, 2 - len(used))]
    place = {t: i for i, t in enumerate(used)}
    return [table[t].tolist() for t in used], [place[t] for t in select.tolist()]


# --- writing blocks


def encode_native(raw: bytes) -> tuple[bytes, int]:
    """(bits, their number) of one block, from its magic on, by the stages of this module."""
    enc = rle_encode(raw)
    last, index = bwt(enc)
    used = sorted(set(enc))
    syms = symbols(mtf(last, used), len(used))
    trees, select = choose_trees(syms, len(used) + 2)
    w = bits.Writer()
    w.put(bits.BLOCK_MAGIC, 48)
    w.put(bits.crc(raw), 32)
    w.put(index, 25)
    here = set(used)
    rows = [sum((16 * r + i in here) << (15 - i) for i in range(16)) for r in range(16)]
    w.put(sum((row > 0) << (15 - r) for r, row in enumerate(rows)), 16)
    for row in rows:
        if row:
            w.put(row, 16)
    w.put(len(trees), 3)
    w.put(len(select), 15)
    for r in mtf(select, list(range(len(trees)))):
        w.put((1 << (r + 1)) - 2, r + 1)
    for lengths in trees:
        now = lengths[0]
        w.put(now, 5)
        for n in lengths:
            while n > now:
                w.put(0b10, 2)
                now += 1
            while n < now:
                w.put(0b11, 2)
                now -= 1
            w.put(0, 1)
    tree = np.repeat(select, GROUP)[: len(syms)]
    code, length = np.array([canonical(t) for t in trees])[tree, syms], np.array(trees)[tree, syms]
    for lo in range(0, len(syms), 1 << 16):
        w.put_bits(*bits.pack(code[lo : lo + (1 << 16)], length[lo : lo + (1 << 16)]))
    n_bits = 8 * len(w.out) + w.n
    return w.done(), n_bits


def encode_block(raw: bytes, engine: str = "library") -> tuple[bytes, int, int, int]:
    """(bits, n_bits, crc, length after run-length coding) of the bytes of one block.

    The library's encoder leaves 19 bytes of each level unused, so a block takes the least
    level that holds it; only fuller blocks than the ninth level's need the native one.
    """
    size = len(rle_encode(raw))
    need = -(-(size + SPARE) // 100_000)
    if engine == "native" or need > 9:
        data, n = encode_native(raw)
        return data, n, bits.crc(raw), size
    whole = bz2.compress(raw, max(1, need))
    crc = bits.crc(raw)
    end = next(e for e in range(8 * len(whole) - 80, 8 * len(whole) - 88, -1) if bits.read(whole, e, 80) == bits.END_MAGIC << 32 | crc)
    return bits.cut(whole, 32, end), end - 32, crc, size


def encode_chunk(raw: bytes, engine: str = "library") -> list[tuple[int, int, int, bytes, int, int]]:
    """(start, end, length after run-length coding, bits, n_bits, crc) of the blocks of raw bytes that fill one at most.

    One block, but for the library's encoder those that would use its last bytes are two.
    """
    cuts = [0, len(raw)]
    if engine == "library" and len(raw) > (MAX_BLOCK - SPARE) * 4 // 5 and len(rle_encode(raw)) + SPARE > MAX_BLOCK:
        cuts = [0, fill_block(raw, 0, MAX_BLOCK - SPARE), len(raw)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        data, n, crc, size = encode_block(raw[a:b], engine)
        out.append((a, b, size, data, n, crc))
    return out


def assemble(level: int, blocks: list[tuple[bytes, int, int]]) -> bytes:
    """A stream of (bits, n_bits, crc): header, blocks at any alignment, end magic and combined CRC."""
    w = bits.Writer()
    w.put(int.from_bytes(b"BZh%d" % level, "big"), 32)
    for data, n, _ in blocks:
        w.put_bits(data, n)
    w.put(bits.END_MAGIC << 32 | bits.combine([c for _, _, c in blocks]), 80)
    return w.done()


def fits_one_block(n: int, level: int) -> bool:
    """Whether n raw bytes are one block of the library for sure: run-length coding adds a quarter at most."""
    return n + n // 4 + 1 + SPARE <= level * 100_000


def compress(raw: bytes, level: int = 9, split: str = "parallel", engine: str = "library") -> bytes:
    if engine == "library" and fits_one_block(len(raw), level):
        return bz2.compress(raw, level)  # one block: the library's stream is the one assembled here
    cuts = split_parallel(raw, level) if split == "parallel" else split_sequential(raw, level * 100_000)
    return assemble(level, [x[3:] for _, _, a, b in cuts for x in encode_chunk(raw[a:b], engine)])


# --- reading blocks


class Broken(Exception):
    """A structural error, by its code."""

    def __init__(self, name: str):
        self.code = CODE[name]
        super().__init__(name)


@dataclass
class Block:
    bit_off: int
    end_bit: int
    stored_crc: int
    randomised: bool = False
    bwt_idx: int = 0
    n_used: int = 0
    n_trees: int = 0
    n_selectors: int = 0
    status: int = 0
    crc: int = 0
    size: int = 0
    data: bytes = b""


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end = data, at, 8 * len(data)
        self.word, self.base, self.top = 0, at, at

    def get(self, n: int) -> int:
        if self.at + n > self.end:
            raise Broken("ERR_EOF")
        if self.at + n > self.top:
            self.base, self.top = self.at, min(self.end, self.at + max(n, 4096))
            self.word = bits.read(self.data, self.base, self.top - self.base)
        self.at += n
        return self.word >> (self.top - self.at) & ((1 << n) - 1)


def _fields(r: _Reader, b: Block) -> tuple[list[int], list[list[int]], list[int]]:
    """Header of a block after its CRC: used bytes, code lengths, selectors."""
    b.randomised, b.bwt_idx = bool(r.get(1)), r.get(24)
    big = r.get(16)
    used = []
    for row in range(16):
        if big >> (15 - row) & 1:
            small = r.get(16)
            used += [16 * row + i for i in range(16) if small >> (15 - i) & 1]
    b.n_used = len(used)
    if not used:
        raise Broken("ERR_BITMAP")
    b.n_trees = r.get(3)
    if not 2 <= b.n_trees <= 6:
        raise Broken("ERR_TREES")
    b.n_selectors = r.get(15)
    if not b.n_selectors:
        raise Broken("ERR_GROUPS")
    ranks = []
    for _ in range(b.n_selectors):
        n = 0
        while r.get(1):
            n += 1
            if n >= b.n_trees:
                raise Broken("ERR_SELECTOR")
        ranks.append(n)
    trees = []
    for _ in range(b.n_trees):
        now, lengths = r.get(5), []
        for _ in range(len(used) + 2):
            if not 1 <= now <= MAX_LENGTH:
                raise Broken("ERR_DELTA")
            while r.get(1):
                now += 1 - 2 * r.get(1)
                if not 1 <= now <= MAX_LENGTH:
                    raise Broken("ERR_DELTA")
            lengths.append(now)
        trees.append(lengths)
    return used, trees, imtf(ranks, list(range(b.n_trees)))


#: Bits that find a symbol at once; longer codes are sought by their place among all codes.
_PEEK = 10
#: Bits whose code lengths are looked up at once.
_SEGMENT = 1 << 18


class _Decoder:
    """Symbols and lengths of a complete prefix code by the next MAX_LENGTH bits."""

    def __init__(self, lengths: list[int], eob: int):
        length = np.array(lengths)
        self.symbol = np.argsort(length, kind="stable")
        self.length = length[self.symbol]
        width = 1 << (MAX_LENGTH - self.length)
        self.start = np.cumsum(width) - width
        near = int(np.searchsorted(self.length, _PEEK, "right"))
        self.fast = np.full(1 << _PEEK, -1)
        fast = np.repeat(np.arange(near), width[:near] >> (MAX_LENGTH - _PEEK))
        self.fast[: len(fast)] = fast
        self.hop = np.where(self.symbol == eob, 0, self.length).astype(np.uint8)
        self.hop_fast = np.where(self.fast < 0, 255, self.hop[self.fast]).astype(np.uint8)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places in symbol and length."""
        at = self.fast.take(words >> (MAX_LENGTH - _PEEK))
        far = np.flatnonzero(at < 0)
        if len(far):
            at[far] = np.searchsorted(self.start, words[far], "right") - 1
        return at

    def hops(self, words: np.ndarray, peek: np.ndarray) -> np.ndarray:
        """Lengths, 0 for the end of the block. peek: the words' first bits."""
        out = self.hop_fast.take(peek)
        far = np.flatnonzero(out == 255)
        if len(far):
            out[far] = self.hop[np.searchsorted(self.start, words[far], "right") - 1]
        return out


def _words(data: bytes, at: int, n: int) -> np.ndarray:
    """The MAX_LENGTH bits from each of the n bits behind `at` on; bits past the end are 0."""
    size = ((at & 7) + n + 7) // 8 + 3
    a = np.frombuffer(data[at >> 3 : (at >> 3) + size].ljust(size, b"\0"), np.uint8).astype(np.int32)
    four = a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]
    each = four[:, None] >> (32 - MAX_LENGTH - np.arange(8, dtype=np.int32)) & ((1 << MAX_LENGTH) - 1)
    return each.ravel()[at & 7 : (at & 7) + n]


def _coded(r: _Reader, n_used: int, trees: list[list[int]], select: list[int]) -> tuple[np.ndarray, str | None]:
    """(symbols, None) of a block up to its end, which is left out, or (those before the fault, its name).

    Code lengths are looked up for every bit of a segment, then groups hop from code to code; a hop of 0 marks the end, of the block or the data.
    """
    decoders: dict[int, _Decoder] = {}
    out: list[np.ndarray] = []
    hops: dict[int, bytes] = {}
    places: list[int] = []
    which: list[int] = []
    words = peek = np.zeros(0, np.int32)
    at, base, top, fault = r.at, 0, -1, "ERR_UNTERM"

    def look(n: int) -> None:
        """The symbols at the first n places."""
        word, tree = words[np.array(places[:n], np.int64)], np.repeat(np.array(which, np.int64), GROUP)[:n]
        found = np.empty(n, np.int64)
        for t in set(which):
            here = np.flatnonzero(tree == t)
            found[here] = decoders[t].symbol[decoders[t].find(word[here])]
        out.append(found)
        places.clear()
        which.clear()

    for t in select[:18001]:
        if t not in decoders:
            kraft = sum(1 << (MAX_LENGTH - n) for n in trees[t])
            if kraft != 1 << MAX_LENGTH:
                fault = "ERR_PREFIX" if kraft > 1 << MAX_LENGTH else "ERR_INCOMPLT"
                break
            decoders[t] = _Decoder(trees[t], n_used + 1)
        if at + GROUP * MAX_LENGTH > top:
            look(len(places))
            n = min(_SEGMENT, r.end - at + (GROUP + 1) * MAX_LENGTH)
            words, base, top = _words(r.data, at, n), at, at + n
            peek = (words >> (MAX_LENGTH - _PEEK)).astype(np.intp)
            hops.clear()
        if t not in hops:
            hop = decoders[t].hops(words, peek)
            hop[r.end - base :] = 0
            hops[t] = hop.tobytes()
        hop, i = hops[t], at - base
        places.append(i)
        places += [i := i + hop[i] for _ in range(GROUP)]
        places.pop()
        which.append(t)
        at = base + i
        if places[-1] == i:
            n = bisect.bisect_left(places, i) - (at > r.end)
            if at < r.end:
                d = decoders[t]
                at += int(d.length[d.find(words[i : i + 1])[0]])
                fault = "ERR_EOF" if at > r.end else None
            else:
                fault = "ERR_EOF"
            look(n)
            break
    look(len(places))
    r.at = at
    return np.concatenate(out), fault


def _ranks(r: _Reader, n_used: int, trees: list[list[int]], select: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(ranks above 0 in order, zeros in front of each and behind the last)."""
    s, fault = _coded(r, n_used, trees, select)
    at = np.flatnonzero(s >= 2)
    of = np.cumsum(s >= 2)
    digit = np.arange(len(s)) - np.append(-1, at)[of] - 1
    zero = s < 2
    if len(s) and int(digit[zero].max(initial=0)) >= MAX_LENGTH - 1:  # more than MAX_BLOCK
        raise Broken("ERR_OVERFLOW")
    zeros = np.bincount(of[zero], weights=1 << (digit + s)[zero], minlength=len(at) + 1).astype(np.int64)
    size = len(at) + int(zeros[: len(zeros) - (fault is not None)].sum())  # zeros in front of a fault are not written
    if int(zeros.max()) > MAX_BLOCK or size > MAX_BLOCK:
        raise Broken("ERR_OVERFLOW")
    if fault or not size:
        raise Broken(fault or "ERR_EMPTY")
    return s[at] - 1, zeros


def _symbols(r: _Reader, b: Block, used: list[int], trees: list[list[int]], select: list[int]) -> bytes:
    """The last column: prefix codes, move to front and zero runs undone."""
    ranks, zeros = _ranks(r, len(used), trees, select)
    front = bytearray(used)
    pop, insert = front.pop, front.insert
    out = used[:1] + [insert(0, c := pop(i)) or c for i in ranks.tolist()]
    zeros[1:] += 1
    return np.repeat(np.array(out, np.uint8), zeros).tobytes()


def isolate(data: bytes, at: int, end: int) -> bytes:
    """A stream of its own of the block's bits at..end, for the library."""
    n = end - at
    value = (int.from_bytes(b"BZh9", "big") << n | bits.read(data, at, n)) << 80 | bits.END_MAGIC << 32 | bits.read(data, at + 48, 32)
    n += 112
    return (value << -n % 8).to_bytes((n + 7) // 8, "big")


def _shape(r: _Reader, b: Block) -> None:
    """The fixed fields of a block's header, without its selectors and trees."""
    b.randomised, b.bwt_idx = bool(r.get(1)), r.get(24)
    big = r.get(16)
    b.n_used = sum(bin(r.get(16)).count("1") for _ in range(bin(big).count("1")))
    b.n_trees, b.n_selectors = r.get(3), r.get(15)


def decode_block(data: bytes, at: int, level: int = 9, stop: int | None = None, sizes: bool = True) -> Block:
    """Reads the block whose magic is at bit `at`; never raises, the outcome is its status.

    With `stop`, where the next magic is thought to be, the library gets the bits first, which
    is fast; whatever it refuses is read here symbol by symbol, which names the error.
    """
    b = Block(at, at, bits.read(data, at + 48, 32))
    r = _Reader(data, at + 48)
    try:
        r.get(32)
        if stop is not None:
            try:
                plain = bz2.decompress(isolate(data, at, stop))
                _shape(r, b)
                b.data, b.end_bit, b.crc = plain, stop, b.stored_crc
                b.size = len(rle_encode(plain)) if not fits_one_block(len(plain), level) or sizes else 0
                if b.size > level * 100_000:
                    b.status = CODE["ERR_OVERFLOW"]
                return b
            except (OSError, ValueError, EOFError):
                r.at = at + 80
        last = _symbols(r, b, *_fields(r, b))
        b.end_bit, b.size = r.at, len(last)
        if b.bwt_idx >= len(last):
            raise Broken("ERR_BWTIDX")
        if b.randomised:  # legacy blocks: the library knows their table
            try:
                plain = bz2.decompress(isolate(data, at, r.at))
            except (OSError, ValueError, EOFError):
                raise Broken("ERR_BLKCRC") from None
        else:
            plain = rle_decode(ibwt(last, b.bwt_idx))
        if b.size > level * 100_000:
            raise Broken("ERR_OVERFLOW")
        if plain is None:
            raise Broken("ERR_RUNLEN")
        b.data, b.crc = plain, bits.crc(plain)
        if b.crc != b.stored_crc:
            raise Broken("ERR_BLKCRC")
    except Broken as e:
        b.status = e.code
    return b


@dataclass
class Stream:
    blocks: list[Block]
    level: int
    stored_crc: int
    computed_crc: int


def _cut_magics(data: bytes) -> list[int]:
    """Where the file's last bits, 8 to 47, are the first ones of a magic: a block may end there too."""
    n, tail = 8 * len(data), int.from_bytes(data[-6:], "big")
    return [n - k for k in range(47, 7, -1) if k <= n and any(m >> (48 - k) == tail & ((1 << k) - 1) for m in (bits.BLOCK_MAGIC, bits.END_MAGIC))]


def walk(data: bytes, stops: list[int] | None = None, sizes: bool = True) -> tuple[int, list[Stream]]:
    """(status, streams) of a file: the parser's chain of blocks, streams back to back.

    What follows a stream and is no whole header ends the file cleanly, one that is cut off too. Status is
    -1 for a file that does not begin as a stream, else that of the first error. Without
    `sizes` a block's size after run-length coding is 0 where it is small for sure.
    """
    if len(data) < 4 or data[:3] != b"BZh" or not b"1" <= data[3:4] <= b"9":
        return -1, []
    stops = stops if stops is not None else sorted(bits.find_magics(data, bits.BLOCK_MAGIC) + bits.find_magics(data, bits.END_MAGIC))
    at, streams = 0, []
    while True:
        head = data[at // 8 : at // 8 + 4]
        if streams and not (len(head) == 4 and head[:3] == b"BZh" and b"1" <= head[3:] <= b"9"):
            return 0, streams
        s = Stream([], head[3] - 48, 0, 0)
        streams.append(s)
        at += 32
        while True:
            if at + 48 > 8 * len(data):
                left = 8 * len(data) - at
                seen = bits.read(data, at, left) if left > 0 else 0
                could = any(m >> (48 - max(left, 0)) == seen for m in (bits.BLOCK_MAGIC, bits.END_MAGIC))
                return CODE["ERR_EOF"] if could else CODE["ERR_HEADER"], streams
            magic = bits.read(data, at, 48)
            if magic == bits.END_MAGIC:
                if at + 80 > 8 * len(data):
                    return CODE["ERR_EOF"], streams
                s.stored_crc = bits.read(data, at + 48, 32)
                s.computed_crc = bits.combine([b.stored_crc for b in s.blocks])
                if s.stored_crc != s.computed_crc:
                    return CODE["ERR_STRMCRC"], streams
                at = (at + 80 + 7) // 8 * 8
                break
            if magic != bits.BLOCK_MAGIC:
                return CODE["ERR_HEADER"], streams
            i = int(np.searchsorted(stops, at, "right"))
            stop = stops[i] if i < len(stops) else next((e for e in _cut_magics(data) if e > at), None)
            b = decode_block(data, at, s.level, stop, sizes)
            s.blocks.append(b)
            if b.status:
                return b.status, streams
            at = b.end_bit


def unpack(data: bytes, step: int = 1 << 18) -> tuple[int, list[bytes]]:
    """(status, plain bytes of each stream). The library reads whole streams first; where it objects, walk() names the error."""
    out, at = [], 0
    try:
        while data[at : at + 3] == b"BZh" and b"1" <= data[at + 3 : at + 4] <= b"9":
            d, parts = bz2.BZ2Decompressor(), []
            while not d.eof:
                piece = data[at : at + step]
                if not piece:
                    raise EOFError
                parts.append(d.decompress(piece))
                at += len(piece) - len(d.unused_data)
            out.append(b"".join(parts))
        if out:
            return 0, out
    except (OSError, ValueError, EOFError):
        pass
    status, streams = walk(data, sizes=False)
    return status, [] if status else [b"".join(b.data for b in s.blocks) for s in streams]


@dataclass
class Mark:
    """A magic at bit_off, the 32 bits behind it and, behind an end, the level of the stream that follows (0: none)."""

    bit_off: int
    is_end: bool
    stored: int
    next_level: int


def marks(data: bytes, limit: int | None = None) -> list[Mark]:
    """All magics that start in the first `limit` bytes, false ones among them."""
    out = []
    for is_end, magic in ((False, bits.BLOCK_MAGIC), (True, bits.END_MAGIC)):
        for at in bits.find_magics(data, magic):
            if limit is None or at < 8 * limit:
                behind = (at + 80 + 7) // 8
                head = data[behind : behind + 4]
                level = head[3] - 48 if is_end and len(head) == 4 and head[:3] == b"BZh" and b"1" <= head[3:] <= b"9" else 0
                out.append(Mark(at, is_end, bits.read(data, at + 48, 32), level))
    return sorted(out, key=lambda m: m.bit_off)


def chain(level: int, found: list[Mark], n_bits: int) -> tuple[int, list[tuple[int, int, int, int, int]]] | None:
    """(streams, (bit_off, end, level, stream, number in it) of each block) if the marks are the blocks and ends of whole streams, else None.

    Stored checksums of the blocks must combine to the stored ones of their streams, so a false
    mark is taken for a true one with a chance of one in 2^32 at most; its decoding fails then.
    """
    at, streams, out, crcs, open_ = 32, 0, [], [], True
    for i, m in enumerate(found):
        if not open_:
            return (streams, out) if m.bit_off >= at else None  # behind the last stream nothing counts
        if m.bit_off != at or at + 80 > n_bits:
            return None
        if m.is_end:
            if bits.combine(crcs) != m.stored:
                return None
            streams, crcs = streams + 1, []
            at, level, open_ = (at + 87) // 8 * 8 + 32 * bool(m.next_level), m.next_level, bool(m.next_level)
        else:
            if i + 1 == len(found):
                return None
            at = found[i + 1].bit_off
            crcs.append(m.stored)
            out.append((m.bit_off, at, level, streams, len(crcs) - 1))
    return None if open_ else (streams, out)


def decompress(data: bytes) -> bytes:
    """Plain bytes; ValueError with the error's message otherwise."""
    status, plain = unpack(data)
    if status:
        raise ValueError(next((m for c, _, m in ERRORS if c == status), "not a valid compressed file"))
    return b"".join(plain)
