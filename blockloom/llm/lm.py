"""Language-model scoring by a weighted backoff automaton over n-grams up to `order` words.

States are contexts seen in training (two words, one word, the empty root; a text's start counts
as a word). An arc of a state is an n-gram seen in training and weighs log10 of its smoothed
probability; a failure arc leads to the state of the context without its first word and weighs
log10 of the mass kept for it. With prior strengths k (Dirichlet smoothing, interpolated):

    arc      (c(u v w) + k3 P(w | v)) / (c(u v) + k3),   failure   k3 / (c(u v) + k3)
    arc      (c(v w) + k2 P(w)) / (c(v) + k2),           failure   k2 / (c(v) + k2)
    root     P(w) = (c(w) + 1) / (N + V + 1)

so each state's probabilities sum to 1. A text is one left-to-right traversal from its start to
the end token that carries the state: the arc of the next word is taken if there is one,
else failure arcs are followed up to a state that has it. Many texts are traversed side by side, a
long one in stretches whose first state is read off the two words before them.

No task holds the corpus's automaton. Texts are packed into blocks of whole documents. A
block asks for the counts of its own distinct n-grams, by 64-bit fingerprints, of the tasks
that own ranges of fingerprints, and gets the part of the automaton that its texts can
reach. Each distinct n-gram of a block crosses the network once at most, whatever its count, so no
n-gram is hot. A trigram can stand in other blocks only if both of its bigrams do, so only
those are asked for; of the others the block's own count is the total.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import held_out, mix64, pack, spans, stage, text_batches, unpack

#: Tokens to a block and n-grams to a range of fingerprints, about.
BLOCK_TOKENS = 2_000_000
RANGE_NGRAMS = 1_500_000
#: Strengths k2, k3 of the shorter context's probability, in occurrences.
PRIORS = (30.0, 5.0)
#: Tokens that a stretch of a text has at most; stretches are traversed side by side.
STRETCH = 512

_END, _START = np.uint64(0x51ED270B9F652295), np.uint64(0xA0761D6478BD642F)


def make_blocks(d: DataFrame, block_tokens: int) -> DataFrame:
    """(block, n, n_words, ids, held, sizes, tokens, words) from (doc_id, text, held)."""

    def run(batches):
        task, no = TaskContext.get().partitionId(), 0
        keys, held, sizes, prints = [], [], [], []

        def flush():
            nonlocal no
            words, tokens = first_seen(np.concatenate(prints) if prints else np.zeros(0, np.uint64))
            out = pa.RecordBatch.from_arrays([pa.array([task << 24 | no], pa.int64()), pa.array([len(tokens) + len(keys)], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([list(keys)], pa.list_(pa.int64())), pa.array([np.array(held, np.uint8).tobytes()], pa.binary()), pa.array([pack(np.array(sizes, np.uint32))], pa.binary()), pa.array([pack(tokens)], pa.binary()), pa.array([words.tobytes()], pa.binary())], names=["block", "n", "n_words", "ids", "held", "sizes", "tokens", "words"])
            no += 1
            for x in (keys, held, sizes, prints):
                x.clear()
            return out

        n = 0
        for batch in batches:
            found, counts = word_prints(*spans(batch.column(1)))
            at = 0
            ends = np.cumsum(counts)
            for i, (key, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                keys.append(key)
                held.append(h)
                sizes.append(counts[i])
                n += int(counts[i]) + 1
                if n >= block_tokens:
                    prints.append(found[at : ends[i]])
                    at = ends[i]
                    yield flush()
                    n = 0
            if at < len(found):
                prints.append(found[at:])
        if keys:
            yield flush()

    return text_batches(d).mapInArrow(run, "block long, n long, n_words long, ids array<long>, held binary, sizes binary, tokens binary, words binary")


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprints of all words of the texts, number of each text's), A-Z lowered; words part at ASCII white space."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts = offsets[:-1]
    prints, counts = [], np.zeros(len(starts), np.int64)
    at = 0
    while at < len(data):
        to = _cut(data, offsets, at)
        d = _LOWER[data[at:to]]
        space = _SPACE[d]
        begin = np.zeros(len(d) + 1, bool)
        inner = starts[(starts >= at) & (starts < to)] - at
        begin[inner] = True
        begin[0] = True
        first = ~space & (begin[:-1] | np.append(True, space[:-1]))
        word = np.flatnonzero(first)
        stop = np.flatnonzero(np.append(space, True) | begin)
        length = stop[np.searchsorted(stop, word, "right")] - word
        prints.append(_hash(d, word, length))
        of = np.searchsorted(starts, word + at, "right") - 1
        counts += np.bincount(of, minlength=len(starts))
        at = to
    return (np.concatenate(prints) if prints else np.zeros(0, np.uint64)), counts


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, size: int = 1 << 20) -> int:
    """End of a slice of about `size` bytes: white space or the start of a text."""
    to = at + size
    while to < len(data):
        begins = int(offsets[np.searchsorted(offsets, to, "right") - 1])
        if begins > at:
            return begins
        spaces = np.flatnonzero(_SPACE[data[at:to]])
        if len(spaces):
            return at + int(spaces[-1]) + 1
        to += size
    return len(data)


def _hash(d: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Eight bytes of every word at a time."""
    padded = np.concatenate([d, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    out = length.astype(np.uint64) + np.uint64(0x100)
    left, k = np.arange(len(word)), 0
    while len(left):
        x = np.ascontiguousarray(eight[word[left] + k]).view("<u8").ravel()
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(length[left] - k, 8).astype(np.uint64)))
        out[left] = mix64(out[left] * np.uint64(0x9FB21C651E98DF25) + x)
        k += 8
        left = left[length[left] > k]
    return mix64(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def numbered(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, number of each key); keys are below top.

    Key and place share 64 bits where they fit, as sorting numbers is faster than sorting places.
    """
    n = len(keys)
    bits = max(1, n).bit_length()
    if not n or int(top).bit_length() + bits > 63:
        return np.unique(keys, return_index=True, return_inverse=True)
    both = np.sort(keys << bits | np.arange(n))
    place, key = both & ((1 << bits) - 1), both >> bits
    first = np.append(True, key[1:] != key[:-1])
    of = np.empty(n, np.int64)
    of[place] = np.cumsum(first) - 1
    return key[first], place[first], of


def first_seen(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, number of each word), numbered so that words seen early have small numbers."""
    words, at, of = np.unique(prints, return_index=True, return_inverse=True)
    order = np.argsort(at)
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return words[order], rank[of]


def in_order(prints: np.ndarray) -> np.ndarray:
    """An order by the leading 40 bits at least, the same whenever the same prints are given."""
    n = len(prints)
    bits = np.uint64(max(1, n).bit_length())
    if bits > 24:
        return np.argsort(prints, kind="stable")
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort((prints & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)


class Block:
    """A block's tokens with an end after each text, and its distinct words, bigrams and trigrams.

    Words are numbered, bigrams are keys (word, word) and trigrams keys (bigram, word), both in
    order of key; bigram_of and trigram_of name that of each token (-1: none).
    """

    def __init__(self, held: bytes, sizes: bytes, tokens: bytes, words: bytes, order: int):
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.sizes = unpack(sizes, np.uint32).astype(np.int64) + 1
        self.words = np.concatenate([np.frombuffer(words, np.uint64), [_END, _START]])
        self.w = len(self.words)
        self.end, self.start = self.w - 2, self.w - 1
        flat = np.full(int(self.sizes.sum()), self.end, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        inside = np.ones(len(flat), bool)
        inside[self.begins + self.sizes - 1] = False
        flat[inside] = unpack(tokens, np.uint32)
        prev = np.empty_like(flat)
        prev[1:] = flat[:-1]
        prev[self.begins] = self.start
        self.flat = flat
        self.train = np.repeat(~self.held, self.sizes)
        self.bigram, _, self.bigram_of = numbered(prev * self.w + flat, self.w**2)
        self.first, self.second = self.bigram // self.w, self.bigram % self.w
        self.bigram_print = mix64(mix64(self.words)[self.first] + self.words[self.second])
        self.trigram, self.trigram_of = np.zeros(0, np.int64), np.full(len(flat), -1)
        self.suffix = np.zeros(0, np.int64)
        if order > 2:
            later = np.ones(len(flat), bool)
            later[self.begins] = False
            at = np.flatnonzero(later)
            self.trigram, where, of = numbered(self.bigram_of[at - 1] * self.w + flat[at], len(self.bigram) * self.w)
            self.trigram_of[at] = of
            self.suffix = self.bigram_of[at[where]]
        self.context, self.last = self.trigram // self.w, self.trigram % self.w

    def trigram_print(self, some: np.ndarray) -> np.ndarray:
        return mix64(mix64(self.bigram_print[self.context[some]] + np.uint64(3)) + self.words[self.last[some]])

    def word_counts(self) -> np.ndarray:
        """Of words and ends in training; the start's count is that of the training texts."""
        c = np.bincount(self.flat[self.train], minlength=self.w)
        c[-1] = (~self.held).sum()
        return c

    def bigram_counts(self) -> np.ndarray:
        return np.bincount(self.bigram_of[self.train], minlength=len(self.bigram))

    def trigram_counts(self) -> np.ndarray:
        return np.bincount(self.trigram_of[self.train & (self.trigram_of >= 0)], minlength=len(self.trigram))

    def asked(self, shared: np.ndarray) -> np.ndarray:
        """Trigrams that may stand in other blocks, by the bigrams that do."""
        return np.flatnonzero((shared[self.context] > 0) & (shared[self.suffix] > 0))


class Automaton:
    """The part of the corpus's automaton that a block's texts reach, in log10.

    Its arcs are the block's n-grams with a training count; weights of the others are not read.
    """

    def __init__(self, b: Block, word_total, bigram_total, trigram_total, n: int, v: int, priors: tuple[float, float]):
        k2, k3 = priors
        self.block = b
        root = (word_total + 1.0) / (n + v + 1.0)
        context = word_total.astype(float)  # an end has no followers and is never a context
        two = (bigram_total + k2 * root[b.second]) / (context[b.first] + k2)
        three = (trigram_total + k3 * two[b.suffix]) / (bigram_total[b.context].astype(float) + k3)
        self.root, self.arc2, self.arc3 = np.log10(root), np.log10(two), np.log10(three)
        self.fail2, self.fail3 = np.log10(k2 / (context + k2)), np.log10(k3 / (bigram_total.astype(float) + k3))
        self.is1, self.is2, self.has3 = context > 0, bigram_total > 0, trigram_total > 0
        self.is1[b.end] = False
        self.long = len(b.trigram) > 0

    def after(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after the token at each place: (bigram or -1, word or -1)."""
        b = self.block
        pair, word = b.bigram_of[at], b.flat[at]
        return np.where(self.is2[pair] if self.long else False, pair, -1), np.where(self.is1[word], word, -1)

    def traverse(self, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each text."""
        b = self.block
        n = -(-b.sizes // stretch)
        text = np.repeat(np.arange(len(n)), n)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stretch
        at, left = b.begins[text] + place, np.minimum(b.sizes[text] - place, stretch)
        lanes = np.argsort(-left, kind="stable")
        at, left, text = at[lanes], left[lanes], text[lanes]
        total = np.zeros(len(lanes))
        pair, word = self.after(np.maximum(at - 1, 0))
        fresh = at == b.begins[text]
        pair[fresh], word[fresh] = -1, b.start if self.is1[b.start] else -1
        for step in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -step, "left"))  # lanes that have another token
            here = at[:m] + step
            pair, word = self.step(b.flat[here], b.trigram_of[here], b.bigram_of[here], pair[:m], word[:m], total)
        return np.bincount(text, total, len(n))

    def step(self, w, trigram, bigram, pair, word, total) -> tuple[np.ndarray, np.ndarray]:
        """Takes a token in every lane: adds its weight to total, gives the next states.

        The block numbers the arcs that its tokens would take: trigram from the state pair, bigram from the state word.
        """
        deep, some = pair >= 0, word >= 0
        hit3 = deep & self.has3[trigram] if self.long else deep
        two = some & ~hit3
        hit2 = two & self.is2[bigram]
        add = np.where(hit3, self.arc3[trigram], np.where(deep, self.fail3[pair], 0.0)) if self.long else np.zeros(len(w))
        add += np.where(hit2, self.arc2[bigram], np.where(two, self.fail2[word], 0.0))
        add += np.where(hit3 | hit2, 0.0, self.root[w])
        total[: len(w)] += add
        return np.where(hit3 | hit2, bigram, -1) if self.long else np.full(len(w), -1), np.where(self.is1[w], w, -1)


def _blocks_of(table: pa.Table, order: int) -> list[Block]:
    return [Block(*(table[c][i].as_py() for c in ("held", "sizes", "tokens", "words")), order) for i in range(len(table))]


WORDS, BIGRAMS, TRIGRAMS = range(3)
_ASKED = "kind int, part int, block long, prints binary, counts binary"
_ASKED_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("total", pa.binary()), ("shared", pa.binary()), ("sum", pa.int64()), ("distinct", pa.int64())])
_ANSWER_SQL = "kind int, block long, part int, total binary, shared binary, sum long, distinct long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _ask(kind: int, block: int, prints: np.ndarray, counts: np.ndarray, ranges: int) -> list[tuple]:
    """Rows of _ASKED: fingerprints in order with the block's counts, one for each range."""
    order = in_order(prints)
    h, counts = prints[order], counts[order].astype(np.uint64)
    owner = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)  # rises with h
    cut = np.searchsorted(owner, np.arange(ranges + 1))
    return [(kind, int(r), block, pack(h[cut[r] : cut[r + 1]]), pack(counts[cut[r] : cut[r + 1]])) for r in np.flatnonzero(cut[1:] > cut[:-1])]


def _answer(table: pa.Table) -> pa.Table:
    """Totals of the n-grams of one kind and range, back in the order asked; shared tells that several blocks asked. sum, distinct: of the range's training tokens."""
    table = table.sort_by("block")
    h = [unpack(x, np.uint64) for x in table["prints"].to_pylist()]
    c = np.concatenate([unpack(x, np.uint64) for x in table["counts"].to_pylist()])
    grams, which = np.unique(np.concatenate(h), return_inverse=True)
    total = np.bincount(which, c, len(grams)).astype(np.uint64)
    shared = (np.bincount(which) > 1).astype(np.uint8)
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    text = (grams != _START) & (total > 0) if kind == WORDS else np.zeros(len(grams), bool)
    cut = np.cumsum([0, *map(len, h)])
    rows = [(kind, b, part, pack(total[which[s:e]]), pack(shared[which[s:e]]) if kind == BIGRAMS else b"", int(total[text].sum()) if i == 0 else 0, int(text.sum()) if i == 0 else 0) for i, (b, s, e) in enumerate(zip(table["block"].to_pylist(), cut, cut[1:], strict=False))]
    return _table(rows, _ANSWER)


def _totals(answers: pa.Table, kind: int, prints: np.ndarray, column: str = "total", dtype=np.uint64) -> np.ndarray:
    """A block's answers of one kind, over all ranges, in the order of prints."""
    answers = answers.filter(pa.array(answers["kind"].to_numpy() == kind)).sort_by("part")
    got = [unpack(x, dtype) for x in answers[column].to_pylist()]
    out = np.zeros(len(prints), np.int64)
    out[in_order(prints)] = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", *, order: int = 3, priors: tuple[float, float] = PRIORS, held_mod: int = 7, block_tokens: int = BLOCK_TOKENS, range_ngrams: int = RANGE_NGRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    Trains on the rows whose crc32(key as text) mod held_mod is not 2 and scores all. order
    is 2 or 3. Null and empty texts are one end token. Rows with a null key train. Keys are integers,
    repeated ones are rows by themselves; extra columns are left out. An empty table gives no rows.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(key, held_mod).alias("held"))
    blocks = stage(make_blocks(d, block_tokens), "lm-blocks")
    tokens, words = blocks.agg(F.sum("n"), F.sum("n_words")).first()
    ranges = max(1, math.ceil((tokens or 0) / range_ngrams))
    word_ranges = max(1, math.ceil((words or 0) / range_ngrams))
    body = ["block", "held", "sizes", "tokens", "words"]

    def ask(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, b in enumerate(_blocks_of(table, 2)):
                block = table["block"][i].as_py()
                yield from _table(_ask(WORDS, block, b.words, b.word_counts(), word_ranges) + _ask(BIGRAMS, block, b.bigram_print, b.bigram_counts(), ranges), _ASKED_ARROW).to_batches()

    def ask_trigrams(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for i, b in enumerate(_blocks_of(left, 3)):
            some = b.asked(_totals(right, BIGRAMS, b.bigram_print, "shared", np.uint8))
            rows += _ask(TRIGRAMS, left["block"][i].as_py(), b.trigram_print(some), b.trigram_counts()[some], ranges)
        return _table(rows, _ASKED_ARROW)

    by_block = lambda df: df.groupBy("block")
    answer = lambda asked: asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWER_SQL)
    answers = stage(answer(blocks.select(*body).mapInArrow(ask, _ASKED)), "lm-answers")
    n, v = answers.agg(F.coalesce(F.sum("sum"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    if order > 2:
        bigrams = answers.where(F.col("kind") == BIGRAMS)
        answers = answers.union(stage(answer(by_block(blocks.select(*body)).cogroup(by_block(bigrams)).applyInArrow(ask_trigrams, _ASKED)), "lm-trigrams"))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, b in enumerate(_blocks_of(left, order)):
            word_total, bigram_total, trigram_total = _totals(right, WORDS, b.words), _totals(right, BIGRAMS, b.bigram_print), b.trigram_counts()
            if order > 2:
                some = b.asked(_totals(right, BIGRAMS, b.bigram_print, "shared", np.uint8))
                trigram_total[some] = _totals(right, TRIGRAMS, b.trigram_print(some))
            auto = Automaton(b, word_total, bigram_total, trigram_total, n, v, priors)
            per = lambda x: np.add.reduceat(x, b.begins) if len(b.begins) else x  # noqa: B023, E731
            out.append(pa.table({"doc_id": left["ids"][i].values.cast(pa.int64()), "held_out": pa.array(b.held), "n_tokens": pa.array(b.sizes), "n_known": pa.array(per((word_total[b.flat] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(b.sizes), n)), "base_score": pa.array(per(auto.root[b.flat])), "score": pa.array(auto.traverse())}))
        return pa.concat_tables(out)

    return by_block(blocks.select(*body, "ids")).cogroup(by_block(answers)).applyInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
