"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text is a lattice: nodes between characters, an arc for every vocabulary piece. Arc
occurrences that may follow one another weigh 0 and all others minus infinity: for a merge
vocabulary a sequence of pieces is the encoder's own output exactly if every two neighbours,
joined and encoded alone, come out as those two. So just one path has a finite weight, and
the best path in the (max, +) semiring is the library's encoding.

A text of up to `chunk` characters is solved in one pass. A longer one is cut into chunks of
characters. A chunk's transfer matrix goes from the occurrences that cover the character
before it to those that cover its last one; matrices are combined associatively, which gives
each chunk its entry and exit occurrence, and every chunk is traced back by itself.

Pieces never run from a character into a following word mark, so words (a run of marks and
what follows up to the next) are independent; distinct words are solved once and remembered.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import stage, text_batches

MARK = "▁"
#: Characters to a chunk; longer texts are cut.
CHUNK = 65536
#: Words whose pieces a worker remembers, twice so many at most, and the longest word that is.
CACHED_WORDS = 150_000
CACHED_CHARS = 64
#: Neighbouring pieces whose rule a worker remembers.
CACHED_PAIRS = 400_000


class Vocabulary:
    """Pieces of a model, its normalisation (dummy mark, spaces to marks) and neighbour rules."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if s else p.replace(MARK, " ").encode() for i, (p, s) in enumerate(zip(self.pieces, special, strict=True))]
        self.longest = max(map(len, self.ids))
        self.pairs: dict[int, bool] = {}
        self.whole = {p for p in self.ids if self.merge(p) == [p]}
        self.reach = {}  # last character -> longest piece that ends with it
        for p in self.whole:
            self.reach[p[-1]] = max(len(p), self.reach.get(p[-1], 1))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if len(self.pieces) > 1 << 15:
            raise ValueError("vocabularies of up to 32768 pieces only")
        #: Neighbouring characters of any piece; between others every path has a cut.
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        import ahocorasick

        self.finder = ahocorasick.Automaton()
        for p in self.whole:
            self.finder.add_word(p, (self.ids[p], len(p)))
        self.finder.make_automaton()

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merge(self, s: str) -> list[str]:
        """Pieces of a short string by its merges, best score first, leftmost among equals."""
        parts = list(s)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether b may stand after a: the two, joined, encode to the two."""
        i, j = self.ids.get(a), self.ids.get(b)
        if i is None or j is None:
            return self.merge(a + b) == [a, b]
        found = self.pairs.get(i << 15 | j)
        return self._follows(i << 15 | j) if found is None else found

    def _follows(self, pair: int) -> bool:
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        a, b = self.pieces[pair >> 15], self.pieces[pair & 0x7FFF]
        found = self.pairs[pair] = self.merge(a + b) == [a, b]
        return found

    def emit(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character outside the vocabulary falls back to its bytes."""
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(i)
        return out

    def arcs(self, s: str, end: int, least: int = 0) -> list[int]:
        """Starts of the occurrences that end there: pieces that encode to themselves, and single characters."""
        return [i for i in range(max(least, end - self.reach.get(s[end - 1], 1)), end) if i == end - 1 or s[i:end] in self.whole]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def best_path(v: Vocabulary, s: str) -> list[int]:
    """Ids of one word: every prefix has one finite path, so a node keeps its last arc alone."""
    n = len(s)
    last, begin = [-1] * (n + 1), [0] * (n + 1)
    pairs = v.pairs.get
    for end, (piece, length) in v.finder.iter(s):  # all arcs, by their ends
        end += 1
        if last[end] < 0:
            i = end - length
            if not i:
                last[end] = piece
            elif (before := last[i]) >= 0:
                pair = before << 15 | piece
                ok = pairs(pair)
                if ok or (ok is None and v._follows(pair)):
                    last[end], begin[end] = piece, i
    if last[n] < 0:
        return v.emit(_path_with_unknowns(v, s))
    out = []
    while n:
        out.append(last[n])
        n = begin[n]
    return out[::-1]


def _path_with_unknowns(v: Vocabulary, s: str) -> list[str]:
    """The same for words with characters outside the vocabulary, which are arcs by themselves."""
    n = len(s)
    last: list = [None] * (n + 1)
    for end in range(1, n + 1):
        for i in v.arcs(s, end):
            if not i or (last[i] is not None and v.follows(last[i], s[i:end])):
                last[end] = s[i:end]
                break
    parts = []
    while n:
        parts.append(last[n])
        n -= len(last[n])
    return parts[::-1]


def split_words(s: str) -> list[str]:
    """Words of a normalised string; what stands before its first mark comes first."""
    parts = s.split(MARK)
    if len(parts) == 1:
        return [s] if s else []
    out = [parts[0]] if parts[0] else []
    run = ""
    for p in parts[1:]:
        run += MARK
        if p:
            out.append(run + p)
            run = ""
    if run:
        out.append(run)
    return out


def word_ids(v: Vocabulary, w: str) -> bytes:
    """Ids of a word: its parts between characters that no piece joins are independent too.

    Remembered words are in two generations; the older one goes when the newer is full.
    """
    found = v.words.get(w) or v.older.get(w)
    if found is None:
        joins = v.joins
        cuts = [i for i in range(1, len(w)) if w[i - 1 : i + 1] not in joins]
        if cuts:
            found = b"".join([word_ids(v, w[i:j]) for i, j in zip([0, *cuts], [*cuts, len(w)], strict=True)])
        else:
            found = array("I", best_path(v, w)).tobytes()
    if len(w) <= CACHED_CHARS:
        if len(v.words) >= CACHED_WORDS:
            v.older, v.words = v.words, {}
        v.words[w] = found
    return found


def encode_text(v: Vocabulary, text: str) -> bytes:
    """Little-endian u32 ids of a whole text in one pass."""
    words = split_words(v.normalise(text))
    return b"".join([v.words.get(w) or word_ids(v, w) for w in words])


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text again: bytes of the pieces without the dummy mark. Exact for encoded texts."""
    raw = v.raw
    b = b"".join([raw[i] for i in ids.tolist()])
    return (b[1:] if b[:1] == b" " else b).decode("utf-8", "replace")


# Chunks. An occurrence that covers a cut is named by (characters before the cut, characters after it).


def crossings(v: Vocabulary, s: str, cut: int) -> list[tuple[int, int]]:
    """(start, end) of the occurrences that cover the character before the cut."""
    if cut == 0:
        return [(0, 0)]
    return [(i, end) for end in range(cut, min(len(s), cut + v.longest - 1) + 1) for i in v.arcs(s, end) if i < cut]


def transfer(v: Vocabulary, s: str, lo: int, hi: int) -> tuple[list, list, np.ndarray, list]:
    """(entries, exits, matrix, trace) of characters lo to hi of s, which holds context around them.

    matrix[i, j] is the weight of the best path from entry i to exit j, 0 or minus infinity.
    Occurrences are visited by their end; each holds a vector over entries. trace has, for
    each occurrence and entry, the one before it.
    """
    ins, outs = crossings(v, s, lo), crossings(v, s, hi)
    k = len(ins)
    reach: dict[int, list] = {}  # end -> [(start, vector)]
    back: dict[tuple[int, int], list] = {}
    for j, (a, b) in enumerate(ins):
        vec = np.full(k, -math.inf)
        vec[j] = 0.0
        reach.setdefault(b, []).append((a, vec))
    top = max([b for _, b in outs], default=hi)
    for end in range(lo + 1, top + 1):
        for i in v.arcs(s, end, lo):
            if i >= hi or i not in reach:
                continue
            best, via = np.full(k, -math.inf), [None] * k
            for a, vec in reach[i]:
                if (a == i) or v.follows(s[a:i], s[i:end]):
                    better = vec > best
                    if better.any():
                        best = np.where(better, vec, best)
                        for j in np.flatnonzero(better):
                            via[j] = (a, i)
            if best.max() > -math.inf:
                reach.setdefault(end, []).append((i, best))
                back[i, end] = via
    matrix = np.full((k, len(outs)), -math.inf)
    for j, (a, b) in enumerate(outs):
        for start, vec in reach.get(b, ()):
            if start == a:
                matrix[:, j] = np.maximum(matrix[:, j], vec)
    return ins, outs, matrix, [back]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two transfer matrices in the (max, +) semiring."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def backtrace(v: Vocabulary, s: str, lo: int, hi: int, entry: tuple[int, int], exit_: tuple[int, int]) -> list[str]:
    """Pieces that start within lo and hi on the path from entry to exit."""
    ins, _, _, (back,) = transfer(v, s, lo, hi)
    j, at, parts = ins.index(entry), exit_, []
    while at != entry and at[0] >= lo:
        parts.append(s[at[0] : at[1]])
        at = back[at][j]
    return parts[::-1]


def _lead(s: str, lo: int, hi: int) -> int:
    """Where the first word that starts after lo starts; hi if none does. Before it the entry matters."""
    i = lo
    while i < hi and not (s[i] == MARK and i > 0 and s[i - 1] != MARK):
        i += 1
    return i


def _tail(s: str, lo: int, hi: int) -> int:
    """Where the last word that starts between lo and hi starts."""
    i = hi - 1
    while i > lo and not (s[i] == MARK and s[i - 1] != MARK):
        i -= 1
    return i


def chunk_matrix(v: Vocabulary, s: str, lo: int, hi: int) -> tuple[list, list, np.ndarray]:
    """transfer() of a chunk; words that start and end inside need no lattice.

    Paths from every entry pass the start of each word, so the matrix is the entries' reach
    of the first word start times the reach of the exits from the last one.
    """
    a, b = _lead(s, lo, hi), _tail(s, lo, hi)
    if a >= hi or b <= a:
        ins, outs, m, _ = transfer(v, s, lo, hi)
        return ins, outs, m
    ins, _, head, _ = transfer(v, s, lo, a)
    ends = [end for _, end in crossings(v, s, a)]
    at_word = np.full((len(ins), 1), -math.inf)
    for j, end in enumerate(ends):
        if end == a:
            at_word[:, 0] = np.maximum(at_word[:, 0], head[:, j])
    outs, tail = _from_word(v, s, b, hi)[:2]
    return ins, outs, compose(at_word, tail)


def _from_word(v: Vocabulary, s: str, b: int, hi: int):
    """Reach of the exits at hi from a word that starts at b, as a 1-row matrix, with the trace."""
    word = s[b:]
    _, outs, m, trace = transfer(v, word, 0, hi - b)
    return [(i + b, j + b) for i, j in outs], m, trace


def chunk_pieces(v: Vocabulary, s: str, lo: int, hi: int, entry: tuple[int, int], exit_: tuple[int, int]) -> bytes:
    """Ids of the pieces that start within a chunk, given the occurrences at its ends."""
    a, b = _lead(s, lo, hi), _tail(s, lo, hi)
    if a >= hi or b <= a:
        return np.array(v.emit(backtrace(v, s, lo, hi, entry, exit_)), "<u4").tobytes()
    ins, outs, m, _ = transfer(v, s, lo, a)
    j = ins.index(entry)
    mid = next(o for i, o in enumerate(outs) if o[1] == a and m[j, i] == 0)
    head = v.emit(backtrace(v, s, lo, a, entry, mid)) if mid != entry else []
    _, _, (back,) = _from_word(v, s, b, hi)
    at, parts = (exit_[0] - b, exit_[1] - b), []
    while at != (0, 0):
        parts.append(s[b + at[0] : b + at[1]])
        at = back[at][0]
    return np.array(head, "<u4").tobytes() + b"".join(word_ids(v, w) for w in split_words(s[a:b])) + np.array(v.emit(parts[::-1]), "<u4").tobytes()


def _scan(rows: list[tuple]) -> list[tuple]:
    """Entry and exit of each chunk of one text, from (no, entries, exits, matrix) in order.

    Prefix products forward, then back from the end of the text: the one finite path.
    """
    at = [np.zeros((1, 1))]
    for _, ins, outs, m in rows:
        at.append(compose(at[-1], m))
    size = rows[-1]
    outs = size[2]
    j = max((i for i, o in enumerate(outs) if at[-1][0, i] > -math.inf), key=lambda i: -outs[i][1])
    path = []
    for k in range(len(rows) - 1, -1, -1):
        no, ins, outs, m = rows[k]
        i = int(np.argmax(at[k][0] + m[:, j]))
        path.append((no, ins[i], outs[j]))
        j = i
    return path[::-1]


def _long_ids(long: DataFrame, model: str, chunk: int) -> DataFrame:
    """(row, ids) of texts longer than a chunk: transfer matrices, their products, traces."""
    context = 64  # longest piece on either side of a chunk, and room to see where a word starts
    norm = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    parts = long.select("row", norm.alias("text"), F.char_length(norm).alias("n"))
    parts = parts.withColumn("no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(chunk)).cast("int") - 1)))
    lo = F.greatest(F.col("no") * chunk - context, F.lit(0))
    parts = parts.select("row", "no", F.substring("text", lo + 1, F.lit(chunk + 2 * context)).alias("s"), (F.col("no") * chunk - lo).alias("lo"), F.least(F.col("n") - lo, F.col("no") * chunk - lo + chunk).alias("hi"))
    parts = stage(parts.repartition(F.xxhash64("row", "no")), "pieces-chunks")
    flat = "array<int>"

    def matrices(batches):
        v = vocabulary(model)
        for batch in batches:
            rows = {"row": [], "no": [], "ins": [], "outs": [], "m": []}
            for row, no, s, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ins, outs, m = chunk_matrix(v, s, lo, hi)
                rows["row"].append(row)
                rows["no"].append(no)
                rows["ins"].append([x - lo for p in ins for x in p])
                rows["outs"].append([x - hi for p in outs for x in p])
                rows["m"].append((m.ravel() > -math.inf).astype(np.int32).tolist())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("row", pa.int64()), ("no", pa.int32()), ("ins", pa.list_(pa.int32())), ("outs", pa.list_(pa.int32())), ("m", pa.list_(pa.int32()))]))

    def combine(table: pa.Table) -> pa.Table:
        rows = []
        for x in sorted(table.to_pylist(), key=lambda x: x["no"]):
            ins, outs = list(zip(x["ins"][::2], x["ins"][1::2], strict=True)), list(zip(x["outs"][::2], x["outs"][1::2], strict=True))
            rows.append((x["no"], ins, outs, np.where(np.array(x["m"]).reshape(len(ins), len(outs)) > 0, 0.0, -math.inf)))
        path = _scan(rows)
        return pa.table({"row": pa.array([table["row"][0].as_py()] * len(path), pa.int64()), "no": pa.array([p[0] for p in path], pa.int32()), "entry": pa.array([list(p[1]) for p in path], pa.list_(pa.int32())), "exit": pa.array([list(p[2]) for p in path], pa.list_(pa.int32()))})

    def traces(batches):
        v = vocabulary(model)
        for batch in batches:
            out = [chunk_pieces(v, s, lo, hi, (a[0] + lo, a[1] + lo), (b[0] + hi, b[1] + hi)) for s, lo, hi, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["row", "no", "ids"])

    steps = parts.mapInArrow(matrices, f"row long, no int, ins {flat}, outs {flat}, m {flat}").groupBy("row").applyInArrow(combine, f"row long, no int, entry {flat}, exit {flat}")
    traced = parts.join(steps, ["row", "no"]).select("row", "no", "s", "lo", "hi", "entry", "exit").mapInArrow(traces, "row long, no int, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("no", "ids")))
    joined = F.array_join(F.transform(ordered, lambda x: F.hex(x["ids"])), "")
    return traced.groupBy("row").agg(F.unhex(joined).alias("ids"))


def encode(docs: DataFrame, model: str, text: str = "text", *, name: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """All columns of docs and `name`, the text's ids as little-endian u32 (binary).

    Equal to the library's encoding without special ids. Null and empty texts have no ids.
    A column called `name` is replaced. A null character or any other is ordinary.
    """
    keep = [c for c in docs.columns if c != name]
    d = text_batches(docs).select(*keep)
    i = keep.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    fits = F.coalesce(F.char_length(text), F.lit(0)) < chunk

    def short(batches):
        v = vocabulary(model)
        for batch in batches:
            out = [encode_text(v, x or "") for x in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, name])

    done = d.where(fits).mapInArrow(short, f"{schema}, `{name}` binary")
    if d.where(~fits).isEmpty():
        return done
    row = "_row_" + "_".join(keep)[:40]
    long = stage(d.where(~fits).withColumn(row, F.monotonically_increasing_id()), "pieces-long")
    ids = _long_ids(long.select(F.col(row).alias("row"), F.col(text).alias("text")), model, chunk)
    back = long.join(ids.select(F.col("row").alias(row), F.col("ids").alias(row + "i")), row).select(*keep, F.col(row + "i").alias(name))
    return done.union(back)


def decode(df: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids give null, none the empty text. A column called `name` is replaced."""
    keep = [c for c in df.columns if c != name]
    d = df.select(*keep)
    i = keep.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            out = [None if x is None else decode_ids(v, np.frombuffer(x, "<u4")) for x in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*keep, name])

    return d.mapInArrow(run, f"{schema}, `{name}` string")


def digest(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_bytes, decoded_crc32, exact): encodes, decodes the ids and compares.

    The same as digests of encode() and decode(); texts of one chunk go through both in one pass.
    """
    d = text_batches(docs).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32", "exact"]

    def short(batches):
        v = vocabulary(model)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                x = x.as_py()
                ids = encode_text(v, x)
                back = decode_ids(v, np.frombuffer(ids, "<u4"))
                raw = back.encode()
                rows.append((len(ids) // 4, zlib.crc32(ids), len(raw), zlib.crc32(raw), back == x))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    fits = F.char_length("text") < chunk
    done = d.where(fits).mapInArrow(short, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, exact boolean")
    both = decode(encode(d.where(~fits), model, chunk=chunk), model)
    return done.union(both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"), (F.col("decoded") == F.col("text")).alias("exact")))
