"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds.

Unit vectors are rotated onto the principal axes of a bounded sample, which keeps all dot
products. Vectors are cut into tiles by ranges of the leading coordinate; tiles whose boxes
over the leading coordinates lie too far apart never meet. In a pair of tiles, blocks
accumulate the leading dimensions first: the products so far plus the product of the
suffix norms bound the cosine from above, and what cannot reach the threshold stops there.
Survivors go on through further dimensions, and the last are compared in full double
precision. No pairs leave a task: only a count per vector and a forest of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import _forest, components, stage

#: Vectors that the axes and tile bounds are fitted on, at most: those of least hash.
SAMPLE = 10_000
#: Vectors to a tile, about, and to a block within it.
TILE = 8192
BLOCK = 512
#: Dimensions after which bounds are taken, as shares of all.
STEPS = (0.25, 0.5)
#: Leading coordinates of which tiles keep a box.
BOX = 8


def axes(sample: np.ndarray) -> np.ndarray:
    """Columns: principal directions of the second moments, by falling variance."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # components far from 1 neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Side:
    """A tile's vectors by their leading coordinate, with bounds' columns of suffix norms."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        rotated = vectors @ rotation
        order = np.argsort(rotated[:, 0], kind="stable")
        self.ids, self.weights, self.vectors, self.rotated = ids[order], weights[order], vectors[order], rotated[order]
        d = rotated.shape[1]
        self.cuts = sorted({max(1, int(d * s)) for s in STEPS})
        squares = self.rotated**2
        self.tails = [np.sqrt(np.maximum(squares[:, c:].sum(1), 0)) for c in self.cuts]
        self.first = np.column_stack([self.rotated[:, : self.cuts[0]], self.tails[0]])
        self.count = np.zeros(len(ids), np.int64)


def compare(a: Side, b: Side, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Adds to the sides' counts; forest links between ids. same: b is a, pairs count once each way."""
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(a.ids), BLOCK):
        ai = slice(i, min(i + BLOCK, len(a.ids)))
        for j in range(i if same else 0, len(b.ids), BLOCK):
            bj = slice(j, min(j + BLOCK, len(b.ids)))
            if b.rotated[bj.start, 0] - a.rotated[ai.stop - 1, 0] > gap or a.rotated[ai.start, 0] - b.rotated[bj.stop - 1, 0] > gap:
                continue
            # The last column of `first` holds suffix norms, so the product is the bound itself.
            x, y = np.nonzero(a.first[ai] @ b.first[bj].T >= threshold - 1e-9)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            for k in range(1, len(a.cuts)):
                if len(x):
                    c = a.cuts[k]
                    keep = np.einsum("ij,ij->i", a.rotated[x + i, :c], b.rotated[y + j, :c]) + a.tails[k][x + i] * b.tails[k][y + j] >= threshold - 1e-9
                    x, y = x[keep], y[keep]
            if len(x):
                keep = np.einsum("ij,ij->i", a.vectors[x + i], b.vectors[y + j]) >= threshold
                x, y = x[keep] + i, y[keep] + j
                np.add.at(a.count, x, b.weights[y])
                np.add.at(b.count, y, a.weights[x])
                if len(x):
                    ends.append(_forest(a.ids[x], b.ids[y]))
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, threshold: float = 0.95, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of df.

    n_links: other rows whose cosine, in double precision, is >= threshold. component_id:
    least key reachable by links. kept: key = component_id. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Vectors of each length are
    compared by themselves, with axes and tiles of their own. Equal vectors are compared once, as one class. Rows of
    one key are rows by themselves; null keys may link but never name a component. The
    threshold must be above 0. Extra columns are left out.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists("v", lambda x: x != 0)
    good = rows.where("v is not null").where(finite)
    sizes = sorted(r.d for r in good.select(F.size("v").alias("d")).distinct().collect())
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    per_class = None
    for d in sizes:
        linked = _linked(good.where(F.size("v") == d), d, threshold, tile, sample)
        per_class = linked if per_class is None else per_class.union(linked)
    out = rows.join(per_class, F.col("v") == F.col("v_"), "left")
    component = F.coalesce("least", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(good: DataFrame, d: int, threshold: float, tile: int, sample: int) -> DataFrame:
    """(v_, rep, weight, n, least) for each distinct vector of (vec_id, v), all of length d."""
    classes = stage(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()), "vectors-classes")
    some = classes.orderBy(F.xxhash64("v"), "node").limit(sample).select("v").toPandas()["v"]
    vectors = unit(np.stack(some.to_list()))
    rotation = axes(vectors)
    n = classes.count()
    lead = np.sort(vectors @ rotation[:, 0])
    n_ranges = max(1, math.ceil(n / tile))
    bounds = [float(x) for x in (np.quantile(lead, np.arange(1, n_ranges) / n_ranges) if n_ranges > 1 else [])]
    box = min(BOX, d)

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = unit(np.stack(table["v"].to_numpy())) @ rotation[:, :box] if len(table) else np.zeros((0, box))
            at = np.searchsorted(bounds, x[:, 0]) if len(table) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["node", "range", "lead"])

    placed = classes.select("node", "v").mapInArrow(place, "node long, range long, lead array<double>")
    placed = stage(placed, "vectors-placed")
    # A range that holds many tiles' worth, as of near copies, is dealt over tiles by hash.
    split = placed.groupBy("range").agg(F.ceil(F.count("*") / F.lit(float(tile) * 1.5)).alias("parts"))
    tiles = placed.join(split, "range").select("node", "lead", (F.col("range") * F.lit(1 << 20) + F.pmod(F.xxhash64("node"), "parts")).alias("tile"))
    boxes = tiles.groupBy("tile").agg(*[f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(box) for name, f in (("lo", F.min), ("hi", F.max))])
    boxes = stage(boxes, "vectors-boxes")
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    # Tiles meet through cells of the leading coordinate as wide as the gap, then their boxes decide.
    cell = lambda c: F.floor(F.col(c) / gap)
    a = boxes.withColumn("cell", F.explode(F.sequence(cell("lo0"), cell("hi0"))))
    b = boxes.select(*[F.col(c).alias("b_" + c) for c in boxes.columns])
    b = b.withColumn("cell", F.explode(F.sequence(cell("b_lo0") - 1, cell("b_hi0") + 1)))
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"b_hi{k}")), F.lit(2)) for k in range(box)), F.lit(0.0))
    pairs = a.join(b, "cell").where("tile <= b_tile").where(apart <= gap * gap).select(F.col("tile").alias("i"), F.col("b_tile").alias("j")).distinct()
    pairs = stage(pairs, "vectors-pairs")
    ends = pairs.select("i", "j", F.col("i").alias("tile"), F.lit(0).alias("side")).union(pairs.where("i <> j").select("i", "j", F.col("j").alias("tile"), F.lit(1).alias("side")))
    held = tiles.select("node", "tile").join(classes.select("node", "weight", "v"), "node")
    work = held.join(ends, "tile").select("i", "j", "side", "node", "weight", "v")

    def run(table: pa.Table) -> pa.Table:
        side, node, weight = (table[c].to_numpy() for c in ("side", "node", "weight"))
        flat = table["v"].combine_chunks()
        x = unit(np.stack(flat.to_numpy(zero_copy_only=False)))
        make = lambda m: Side(node[m], weight[m], x[m], rotation)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        a = make(side == 0)
        b = a if same else make(side == 1)
        fa, fb = compare(a, b, threshold, same)
        who, count = (a.ids, a.count) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([a.count, b.count]))
        who, count = who[count > 0], count[count > 0]
        return pa.table({"node": pa.array(np.concatenate([who, fa]), pa.int64()), "n": pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(fa), pa.int64())]), "to": pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(fb, pa.int64())])})

    links = stage(work.groupBy("i", "j").applyInArrow(run, "node long, n long, to long"), "vectors-links")
    counts = links.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(links.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")), "vectors-components")
    least = comp.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    tied = counts.join(comp, "node").join(least, "component").select("node", "n", "least")
    return classes.join(tied, "node", "left").select(F.col("v").alias("v_"), "rep", "weight", "n", "least")
