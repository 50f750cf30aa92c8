"""Bulk encoding with a lower-casing byte-level merge vocabulary that has word ends.

Texts stay the bytes of an Arrow column. Their words are parted as the tokenizer's pattern
parts them, every part is looked up by 128 bits of hash in a table of known parts, unknown
parts are merged together, and ids are gathered for all parts at once: nothing is done word
by word in Python. Words that are not plain (letters but composed Latin ones, apostrophes,
control characters, first characters of special tokens, very long words) are encoded whole
by the library, each distinct one once.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

#: Bytes to look at together, about: bounds the memory of a task.
SLICE = 1 << 20
#: Known parts and their ids that a worker remembers; the table is emptied when either is full.
KNOWN_PARTS, KNOWN_IDS = 400_000, 4_000_000
#: Longer words go to the library.
LONGEST = 64
#: Fixed value: the pattern by which the tokenizer parts words; SPACE to ODD are its classes here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)

_NO_RANK = np.int32(1 << 30)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the rest, in order, from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The vocabulary's merges, applied to many parts at once.

    Parts of one length are a matrix of ids. Each round merges, in every row, the leftmost
    pair of least rank, so all rows stay equally long; a row without such a pair is done.
    """

    def __init__(self, model: dict):
        vocab, letters = model["vocab"], _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + model["end_of_word_suffix"]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Open addressing: a key is in its slot or one of the few after it.
        self.bits = max(12, int(len(keys) * 8).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.bits) + 64, _NO_RANK, np.int32)
        self.reach = 1
        for rank, (key, first) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            at = first
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.ranks[at] = key, rank
            self.reach = max(self.reach, at - first + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], _NO_RANK)
        left = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(1, self.reach):
            if not len(left):
                break
            at[left] += 1
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def rows(self, raw: np.ndarray):
        """(rows, ids of each) in groups, for a matrix of bytes, a part to a row."""
        t = self.inner[raw]
        t[:, -1] = self.last[raw[:, -1]]
        who = np.arange(len(t))
        ranks = self.rank(t[:, :-1].ravel(), t[:, 1:].ravel()).reshape(len(t), -1)
        while len(t):
            n = t.shape[1]
            if n == 1:
                yield who, t
                return
            at = ranks.argmin(1)
            best = ranks[np.arange(len(t)), at]
            done = best == _NO_RANK
            if done.any():
                yield who[done], t[done]
                go = ~done
                t, ranks, who, at, best = t[go], ranks[go], who[go], at[go], best[go]
            rows = np.arange(len(t))
            t[rows, at] = self.made[best]
            keep = np.ones(t.shape, bool)
            keep[rows, at + 1] = False
            t = t[keep].reshape(len(t), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[rows, at] = False
            ranks = ranks[keep].reshape(len(t), n - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            found = self.rank(np.concatenate([t[left, at[left] - 1], t[right, at[right]]]), np.concatenate([t[left, at[left]], t[right, at[right] + 1]]))
            ranks[left, at[left] - 1] = found[: len(left)]
            ranks[right, at[right]] = found[len(left) :]


def _mixed(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(29))


class Table:
    """Known parts by hash: where their ids stand in a pool. Open addressing, looked up in bulk."""

    BITS = 20

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        n = (1 << self.BITS) + 4096
        self.a, self.b, self.entry = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.at, self.count = np.zeros(KNOWN_PARTS + 1, np.int64), np.zeros(KNOWN_PARTS + 1, np.int64)
        self.pool = np.zeros(KNOWN_IDS, np.uint32)
        self.n = self.n_ids = 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for unknown ones."""
        slot = (a >> np.uint64(64 - self.BITS)).astype(np.int64)
        entry = self.entry[slot]
        same = (self.a[slot] == a) & (self.b[slot] == b)
        out = np.where(same, entry, -1)
        left = np.flatnonzero(~same & (entry >= 0))
        while len(left):
            slot[left] += 1
            s = slot[left]
            entry = self.entry[s]
            same = (self.a[s] == a[left]) & (self.b[s] == b[left]) & (entry >= 0)
            out[left[same]] = entry[same]
            left = left[~same & (entry >= 0)]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """New distinct hashes, with places of their ids in the pool."""
        entry = np.arange(self.n, self.n + len(a))
        self.at[entry], self.count[entry] = at, count
        self.n += len(a)
        slot, left = (a >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(a))
        while len(left):
            s = slot[left]
            free = self.entry[s] < 0
            self.entry[s[free]] = entry[left[free]]  # of several that want a slot, one gets it
            won = self.entry[s] == entry[left]
            w = left[won]
            self.a[slot[w]], self.b[slot[w]] = a[w], b[w]
            left = left[~won]
            slot[left] += 1


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


class WordEncoder:
    """Ids of texts, equal to the library's, from the buffers of a string column.

    Exact for tokenizers that normalise to NFC and lower case, part words by PATTERN and
    merge bytes with word ends, which is checked in their file and on a sample.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        patterns = [p["pattern"].get("Regex") for p in told["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        normal = [n["type"] for n in told["normalizer"].get("normalizers", [])]
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or patterns != [PATTERN] or normal != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing merge vocabulary with word ends")
        self.merges, self.table = Merges(model), Table()
        self._classes([a["content"] for a in told["added_tokens"]])

    def _classes(self, added: list[str]) -> None:
        self.kind = np.full(256, ODD, np.uint8)
        self.kind[[32, *range(9, 14)]] = SPACE
        self.kind[33:127] = OTHER
        self.kind[[*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
        self.kind[ord("0") : ord("9") + 1] = DIGIT
        self.kind[[ord("'"), *{a.lower().encode()[0] for a in added}]] = ODD
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        # Two-byte letters U+00C0 to U+024F whose lower case is such a letter again; 0 for others.
        self.letters = np.zeros(0x280, np.int64)
        for c in range(0xC0, 0x250):
            low = chr(c).lower()
            if chr(c).isalpha() and len(low) == 1 and 0xC0 <= ord(low) < 0x250 and unicodedata.is_normalized("NFC", chr(c)):
                self.letters[c] = ord(low)

    def _alone(self, word: bytes) -> list[int]:
        return self.tok.encode(word.decode(), add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's) from the bytes of texts, cut at white space into slices."""
        starts, end, at = offsets[:-1], int(offsets[-1]), int(offsets[0])
        counts = np.zeros(len(starts), np.int64)
        out = []
        while at < end:
            to = self._cut(data, offsets, at, end)
            first = int(np.searchsorted(starts, at, "right")) - 1
            last = int(np.searchsorted(starts, to, "left"))
            ids, where, n = self._slice(data[at:to], starts[first:last] - at)
            out.append(ids)
            counts[first:last] += np.bincount(where, n, last - first).astype(np.int64)
            at = to
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts

    def _cut(self, data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
        """The end of a slice of about SLICE bytes: a text's start or white space, never inside of a word."""
        while at + SLICE < end:
            to, size = at + SLICE, SLICE
            begins = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            low = max(begins, at)
            spaces = np.flatnonzero(self.kind[data[max(low, to - 4096) : to]] == SPACE)
            if len(spaces):
                return max(low, to - 4096) + int(spaces[-1]) + 1
            if begins > at:
                return begins
            # One word fills the slice: it ends at the next white space or with its text.
            stop = int(offsets[np.searchsorted(offsets, to, "right")])
            for lo in range(to, stop, size):
                spaces = np.flatnonzero(self.kind[data[lo : min(lo + size, stop)]] == SPACE)
                if len(spaces):
                    return lo + int(spaces[0])
            return stop
        return end

    def _slice(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, text of each part, ids of each part); starts of texts, the first may lie before the slice."""
        d = self.lower[raw]
        kind = self.kind[d]
        high = np.flatnonzero((d >= 0xC3) & (d <= 0xC9))
        if len(high):
            low = self.letters[(d[high].astype(np.int64) & 0x1F) << 6 | (d[np.minimum(high + 1, len(d) - 1)] & 0x3F)]
            kind[high[low == 0]] = ODD
            high, low = high[low > 0], low[low > 0]
            d[high], d[high + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
        begin = np.zeros(len(d), bool)
        begin[np.maximum(starts, 0)[np.maximum(starts, 0) < len(d)]] = True
        begin[0] = True
        space = kind == SPACE
        edge = begin | (kind == DIGIT)
        edge[1:] |= kind[1:] != kind[:-1]
        gone = begin.copy()  # starts of words and of white space
        gone[1:] |= space[1:] != space[:-1]
        word = np.flatnonzero(gone)
        size = np.diff(np.append(word, len(d)))
        odd = np.zeros(len(word), bool)
        odd[np.searchsorted(word, np.flatnonzero(kind == ODD), "right") - 1] = True
        odd |= (size > LONGEST) & ~space[word]
        if odd.any():
            inside = _gather(word[odd], size[odd])
            edge[inside] = False
            d[inside] = raw[inside]  # the library lowers what it encodes
            edge[word] = True
        part = np.flatnonzero(edge)
        length = np.diff(np.append(part, len(d)))
        kept = ~space[part]
        whole = np.zeros(len(d), bool)
        whole[word[odd]] = True
        part, length = part[kept], length[kept]
        of = np.searchsorted(starts, part, "right") - 1
        ids, n = self._ids(d, part, length, whole[part])
        return ids, of, n

    def _hash(self, d: np.ndarray, part: np.ndarray, length: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([d, np.zeros(LONGEST + 8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        a = length.astype(np.uint64) << np.uint64(1) | whole
        b = a.copy()
        left, n = np.arange(len(part)), length
        for k in range(0, LONGEST, 8):
            x = np.ascontiguousarray(eight[part[left] + k]).view("<u8").ravel()
            x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(n[left] - k, 8).astype(np.uint64)))
            if k == 0:
                a, b = _mixed(a ^ x * _M1, _M2), _mixed(b + x, _M1)
            else:
                a[left], b[left] = _mixed(a[left] ^ x * _M1, _M2), _mixed(b[left] + x, _M1)
            left = left[n[left] > k + 8]
            if not len(left):
                break
        return a, b

    def _ids(self, d: np.ndarray, part: np.ndarray, length: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of each part's). Words of more than LONGEST bytes are not remembered."""
        long = np.flatnonzero(length > LONGEST)
        a, b = self._hash(d, part, np.minimum(length, LONGEST), whole)
        t = self.table
        entry = t.find(a, b)
        entry[long] = 0
        for _ in range(2):
            new = np.flatnonzero(entry < 0)
            order = new[np.lexsort((b[new], a[new]))]
            first = order[np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))] if len(new) else new
            if t.n + len(first) <= KNOWN_PARTS and t.n_ids + 2 * int(length[first].sum()) <= KNOWN_IDS:
                break
            t.clear()
            entry[length <= LONGEST] = -1
        if len(new):
            self._learn(d, first, part, length, whole, a, b)
            entry[new] = t.find(a[new], b[new])
        n, at = t.count[entry], t.at[entry]
        if not len(long):
            return t.pool[_gather(at, n)], n
        n[long] = 0
        made = [np.array(self._alone(d[part[i] : part[i] + length[i]].tobytes()), np.uint32) for i in long]
        ids = t.pool[_gather(at, n)]
        cut = np.cumsum(n)[long]
        n[long] = [len(x) for x in made]
        pieces = np.split(ids, cut)
        return np.concatenate([x for pair in zip(pieces, [*made, np.zeros(0, np.uint32)], strict=True) for x in pair]), n

    def _learn(self, d, which, part, length, whole, a, b) -> None:
        """Encodes the parts `which` and adds them to the table."""
        t = self.table
        at, count = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        size, odd = length[which], whole[which]
        for n in np.unique(size[~odd]):
            rows = np.flatnonzero((size == n) & ~odd)
            matrix = d[part[which[rows]][:, None] + np.arange(n)]
            for who, ids in self.merges.rows(matrix):
                k = ids.shape[1]
                at[rows[who]] = t.n_ids + k * np.arange(len(who))
                count[rows[who]] = k
                t.pool[t.n_ids : t.n_ids + ids.size] = ids.ravel()
                t.n_ids += ids.size
        for i in np.flatnonzero(odd):
            ids = self._alone(d[part[which[i]] : part[which[i]] + size[i]].tobytes())
            at[i], count[i] = t.n_ids, len(ids)
            t.pool[t.n_ids : t.n_ids + len(ids)] = ids
            t.n_ids += len(ids)
        t.add(a[which], b[which], at, count)


_loaded: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
