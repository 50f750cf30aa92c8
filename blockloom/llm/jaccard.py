"""N-gram Jaccard self-join: MinHash LSH forest for candidates, exact verification of links.

1. Documents become sets of hashed word n-grams; equal sets become one class, so copies of
   any number cost one comparison.
2. Each class has a signature of `depth` minima in each of `trees` trees. A tree is its
   signatures in sorted order: a trie whose nodes are prefixes, in which the longest common
   prefix of neighbours tells where paths part. All trees are sorted together by range, so a
   prefix that a third of all classes share is spread over tasks.
3. Classes that share a prefix are neighbours in a tree, and every such pair of neighbours is
   a link (no pairs of a group are made). A class starts with the longest prefix whose expected recall
   at the threshold reaches `first_recall`. A class with a match there, in any tree, is in
   crowded space: its prefixes are shortened in all trees, down to the one whose expected
   recall reaches `recall`, and whatever shares those is its candidate too. A class alone keeps
   long prefixes, so unlike documents that share a passage are seldom candidates.
4. Components of candidates are compared exactly. A component's classes are numbered and cut
   into tiles; a pair of tiles is one group that holds both tiles' sets once and counts
   intersections by a sparse-dense product. Links leave as a count per class and a forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import _forest, components, mix64, stage, text_batches

#: Classes to a tile: a group holds two tiles' sets.
TILE = 128
#: Words whose hashes a worker remembers.
CACHED_WORDS = 250_000

_word_hash: dict[bytes, int] = {}


def _hash_word(w: bytes) -> int:
    import xxhash

    _word_hash[w] = h = xxhash.xxh64_intdigest(w)
    return h


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words ([^\\x20\\x09-\\x0D]+, A-Z lowered).

    A text of fewer words than n, but one at least, has one shingle of all its words.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_word_hash) > CACHED_WORDS:
        _word_hash.clear()
    get = _word_hash.get
    h = np.array([get(w) or _hash_word(w) for w in words], np.uint64)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out) + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(out ^ np.uint64(n)))


def _params(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def minima(sets: np.ndarray, mul: np.ndarray, add: np.ndarray, step: int = 1024) -> np.ndarray:
    """Least value of each permutation over the set, wrapping 32-bit arithmetic."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), step):
        np.minimum(low, (x[None, i : i + step] * mul[:, None] + add[:, None]).min(1), out=low)
    return low


def prefix_length(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, of `depth` at most, whose expected recall at the threshold reaches the target; 1 if none does."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def paths(low: np.ndarray, trees: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit label of each tree's first `floor` minima, the up to two minima below it as one number)."""
    rows = low.reshape(trees, -1).astype(np.uint64)
    out = np.arange(1, trees + 1, dtype=np.uint64)
    for column in rows.T[:floor]:
        out = mix64(out + column)
    below = [*rows.T[floor:], np.zeros(trees, np.uint64), np.zeros(trees, np.uint64)]
    return out, below[0] << np.uint64(32) | below[1]


def set_name(s: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    return np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(1))) ^ np.uint64(len(s))], np.uint64).tobytes()


def signatures(docs: DataFrame, n: int, trees: int, depth: int, floor: int) -> DataFrame:
    """(row, set_id, n_shingles, labels, below) for every row: a path per tree, see paths().

    set_id and paths are null where there are no words or no key.
    """

    def run(batches):
        mul, add = _params(trees * depth)
        for batch in batches:
            ids, sizes, tops, belows = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, n)
                some = len(s) and row is not None
                ids.append(set_name(s) if some else None)
                sizes.append(len(s))
                top, below = (x.view(np.int64) for x in paths(minima(s, mul, add), trees, floor)) if some else (None, None)
                tops.append(top)
                belows.append(below)
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tops, numbers), pa.array(belows, numbers)], names=["row", "set_id", "n_shingles", "labels", "below"])

    return text_batches(docs).select("row", "text").mapInArrow(run, "row long, set_id binary, n_shingles long, labels array<long>, below array<long>")


def common_prefix(label_a, below_a, label_b, below_b, floor: int) -> np.ndarray:
    """Length of the common prefix of paths, 0 where it is shorter than the floor."""
    differ = below_a ^ below_b
    return np.where(label_a != label_b, 0, floor + (differ >> 32 == 0) + (differ == 0))


def neighbours(classes: DataFrame, floor: int) -> DataFrame:
    """(kind, label, a, b, prefix, part): neighbours of one tree that share `floor` minima, in sorted order of all paths.

    kind 0 is such a pair of classes (node, labels, below); kind 1 and 2 are the first and last path of a task
    (class a, b what is below the label), of which the caller links those of neighbouring tasks.
    """
    rows = classes.select("node", F.explode(F.arrays_zip("labels", "below")).alias("p")).select(F.col("p.labels").alias("label"), F.col("p.below").alias("below"), "node")
    rows = rows.repartitionByRange("label", "below", "node").sortWithinPartitions("label", "below", "node")

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        make = lambda kind, label, a, b, prefix: pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(label, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.int32()), pa.array(np.full(len(a), part, np.int32))], names=["kind", "label", "a", "b", "prefix", "part"])
        for batch in batches:
            if not batch.num_rows:
                continue
            label, below, node = (c.to_numpy() for c in batch.columns)
            if last is None:
                yield make(1, label[:1], node[:1], below[:1], [0])
            else:
                label, below, node = (np.concatenate(x) for x in zip(last, (label, below, node), strict=True))
            prefix = common_prefix(label[1:], below[1:], label[:-1], below[:-1], floor)
            at = np.flatnonzero((prefix > 0) & (node[1:] != node[:-1]))
            yield make(0, label[at], node[at + 1], node[at], prefix[at])
            last = label[-1:], below[-1:], node[-1:]
        if last is not None:
            yield make(2, last[0], last[2], last[1], [0])

    return rows.mapInArrow(run, "kind int, label long, a long, b long, prefix int, part int")


def candidates(classes: DataFrame, floor: int, start: int) -> DataFrame:
    """Links (a, b) of classes: neighbours that share `start` minima, and `floor` in prefixes that a class with such a match has.

    All that share a prefix are one run of neighbours, so if one of them searches with the shorter prefix, all its pairs of neighbours are linked.
    """
    found = stage(neighbours(classes, floor), "jaccard-neighbours")
    ends = found.where("kind > 0").select("part", "kind", "label", "a", "b").orderBy("part", "kind").collect()  # two rows a task
    over = [(int(x.label), int(y.a), int(x.a), int(common_prefix(np.int64(x.label), np.int64(x.b), np.int64(y.label), np.int64(y.b), floor))) for x, y in zip(ends[1::2], ends[2::2], strict=False)]
    pairs = found.where("kind = 0").select("label", "a", "b", "prefix")
    if over:
        pairs = pairs.union(classes.sparkSession.createDataFrame(over, pairs.schema).where("prefix > 0 and a <> b"))
    strong, weak = pairs.where(F.col("prefix") >= start), pairs.where(F.col("prefix") < start)
    # Prefixes of which a class has a match: in this tree, or in another (then it is an end of a weak pair here).
    matched = strong.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends_of = weak.select("label", F.explode(F.array("a", "b")).alias("node")).distinct()
    crowded = strong.select("label").union(ends_of.join(matched, "node", "left_semi").select("label")).distinct()
    return strong.select("a", "b").union(weak.join(crowded, "label", "left_semi").select("a", "b"))


def intersections(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, the shared hashes taken in slices."""
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    ja, jb = np.searchsorted(both, va), np.searchsorted(both, vb)
    ka, kb = (ja < len(both)), (jb < len(both))
    ka[ka] = both[ja[ka]] == va[ka]
    kb[kb] = both[jb[kb]] == vb[kb]
    ra, ja, rb, jb = ra[ka], ja[ka], rb[kb], jb[kb]
    oa, ob = np.argsort(ja, kind="stable"), np.argsort(jb, kind="stable")
    ra, ja, rb, jb = ra[oa], ja[oa], rb[ob], jb[ob]
    for lo in range(0, len(both), step):
        hi = min(lo + step, len(both))
        xa, xb = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        p, q = np.searchsorted(ja, [lo, hi])
        xa[ra[p:q], ja[p:q] - lo] = 1
        p, q = np.searchsorted(jb, [lo, hi])
        xb[rb[p:q], jb[p:q] - lo] = 1
        out += xa @ xb.T
    return out


def links_in(reps: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float):
    """((rep, other rows linked), forest) of a pair of tiles: side 0 against 1, or within where all are 0."""
    ia = np.flatnonzero(side == 0)
    ib = np.flatnonzero(side == 1)
    within = not len(ib)
    if within:
        ib = ia
    if not len(ia) or not len(ib):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = intersections([sets[i] for i in ia], [sets[i] for i in ib])
    size = np.array([len(s) for s in sets], np.float64)
    linked = both >= threshold * (size[ia][:, None] + size[ib][None, :] - both) - 1e-9
    if within:
        np.fill_diagonal(linked, False)
    na = linked @ weights[ib]
    count = [(reps[ia], na)] if within else [(reps[ia], na), (reps[ib], linked.T @ weights[ia])]
    x, y = np.nonzero(linked)
    fa, fb = _forest(reps[ia[x]], reps[ib[y]]) if len(x) else (np.zeros(0, np.int64),) * 2
    who, n = np.concatenate([c[0] for c in count]), np.concatenate([c[1] for c in count])
    return who[n > 0], n[n > 0].astype(np.int64), fa, fb


def verify(members: DataFrame, threshold: float, n: int, tile: int = TILE) -> DataFrame:
    """(node, n_links, to) over members (node, set_id, weight, comp, n_comp, text).

    Rows with n_links count other rows linked; rows with `to` are links of a forest. A
    component of more than `tile` classes is dealt by hash over about n_comp / tile shards,
    and each pair of shards is a group of its own.
    """
    shards = F.ceil(F.col("n_comp") / F.lit(tile))
    m = members.withColumn("shards", shards).withColumn("shard", F.pmod(F.xxhash64("node"), "shards"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    m = m.select("comp", F.least("shard", "o").alias("i"), F.greatest("shard", "o").alias("j"), F.when(F.col("shard") <= F.col("o"), 0).otherwise(1).alias("side"), "node", "set_id", "weight", "text")

    def run(table: pa.Table) -> pa.Table:
        nodes, weights, side = (table[c].to_numpy() for c in ("node", "weight", "side"))
        sets, keep, seen = [], [], set()
        for i, (name, text) in enumerate(zip(table["set_id"].to_pylist(), table["text"].to_pylist(), strict=True)):
            s = shingles(text, n)
            if nodes[i] not in seen and len(s) and set_name(s) == name:  # a repeated key brings other texts too
                seen.add(nodes[i])
                keep.append(i)
                sets.append(s)
        who, count, a, b = links_in(nodes[keep], weights[keep], sets, side[keep], threshold)
        return pa.table({"node": pa.array(np.concatenate([who, a]).astype(np.int64)), "n_links": pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(a), pa.int64())]), "to": pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b, pa.int64())])})

    return m.groupBy("comp", "i", "j").applyInArrow(run, "node long, n_links long, to long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", *, n: int = 5, threshold: float = 0.8, trees: int = 32, depth: int = 6, first_recall: float = 0.9999, recall: float = 0.99999, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, component_id, n_links, n_shingles): one row per row of docs.

    n_links: other rows whose shingle sets have Jaccard >= threshold with this row's.
    class_id: least key of the rows of the same set; component_id: least key reachable by
    links. Rows without words (null, empty, white space) and rows without a key link with
    nothing and stand for themselves. Repeated keys are rows by themselves. Keys are
    integers; extra columns are left out. An empty table gives no rows.
    """
    d = docs.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"))
    start = prefix_length(trees, depth, threshold, first_recall)
    floor = max(prefix_length(trees, start, threshold, recall), start - 2)
    sig = stage(signatures(d, n, trees, start, floor), "jaccard-signatures")
    named = sig.where("set_id is not null").groupBy("set_id").agg(F.min("row").alias("rep"), F.count("*").alias("weight"), F.first("labels").alias("labels"), F.first("below").alias("below"))
    classes = stage(named.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    found = components(candidates(classes, floor, start), "jaccard-candidates")
    sized = found.join(found.groupBy("component").agg(F.count("*").alias("n_comp")), "component")
    members = sized.select("node", F.col("component").alias("comp"), "n_comp").join(classes.select("node", "set_id", "rep", "weight"), "node")
    links = stage(verify(members.join(d, members.rep == d.row).drop("row", "rep"), threshold, n, tile), "jaccard-links")
    counts = links.where("n_links is not null").groupBy("node").agg(F.sum("n_links").alias("linked"))
    comp = components(links.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")), "jaccard-components")
    least = comp.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    tied = counts.join(comp, "node").join(least, "component").select("node", "linked", "component_id")
    per_class = classes.select("node", "set_id", "rep", "weight").join(tied, "node", "left").select("set_id", "rep", "weight", "linked", "component_id")
    out = sig.select("row", "set_id", "n_shingles").join(per_class, "set_id", "left")
    return out.select(F.col("row").alias("doc_id"), F.coalesce("rep", "row").alias("class_id"), F.coalesce("component_id", "rep", "row").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"), "n_shingles")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group, the one of least key; of those rows any one, as keys may repeat.

    Rows without words or without a key stay. Rows are told apart by ids of their own, not by key.
    """
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    keys = F.col(key).cast("long")
    linked = join(rows.select("_row", F.when(keys.isNotNull(), F.col(text)).alias("text")), "_row", "text", **how)
    linked = stage(linked.where("n_links > 0").select(F.col("doc_id").alias("_row"), "component_id"), "jaccard-groups")
    named = linked.join(rows.select("_row", keys.alias("_key")), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct("_key", "_row")).alias("first"))
    gone = linked.join(first, "component_id").where("_row <> first._row").select("_row")
    return rows.join(gone, "_row", "left_anti").drop("_row")
