"""Near duplicates among embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into two halves, each with a codebook of its own; the product of the
codebooks is a grid of cells, and each vector is listed in the cell of its two nearest codewords. A vector's
search visits cells by rising excess (how much further, squared, the cell's codewords are than the nearest
ones) in multi-sequence order, up to an excess that is fitted so that of the pairs that stand just at the threshold
the share ``TARGET`` is met by a visit of either side. What a visit meets is verified by the cosine itself.

Equal vectors of a label are one class, so copies are compared once. A cell is cut into blocks of some ``BLOCK``
vectors and each visitor goes to all of them, so a hot cell spreads over tasks; a task keeps one block and reads its
visitors as a stream. Pairs never leave a task: it gives sums of links and a forest that joins what is linked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agendry.llm.arrow import small_batches
from agendry.operators.graph import connected_components
from agendry.runtime import cut

#: Least cosine of a link.
THRESHOLD = 0.93
#: Classes that codebooks are fitted on, about; codewords of a half at most; classes of a cell that the grid aims at.
SAMPLE, MOST_WORDS, AIM = 16_384, 512, 128
#: Share of pairs just at the threshold that visits meet, and pairs made up for each sampled vector to find it.
TARGET, MADE = 0.999, 4
#: Vectors of a block, and visitors compared with it at once.
BLOCK, VISITORS = 2048, 1024
#: Rows of a table of hot cells that may be broadcast; a larger one is joined by a shuffle.
HOT_CELLS = 100_000


class Grid(NamedTuple):
    """Two codebooks, and the excess up to which cells are visited."""

    first: np.ndarray
    second: np.ndarray
    excess: float

    def excesses(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how much each codeword of each half is further, squared, than the nearest one."""
        half = self.first.shape[1]
        out = []
        for book, part in ((self.first, units[:, :half]), (self.second, units[:, half : half + self.second.shape[1]])):
            d = (book * book).sum(1) - 2 * part @ book[:, : part.shape[1]].T
            out.append(d - d.min(axis=1, keepdims=True))
        return out[0], out[1]

    def homes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.argmin(1) * len(self.second) + b.argmin(1)


def traverse(a: np.ndarray, b: np.ndarray, excess: float) -> list[int]:
    """Cells i * len(b) + j by rising a[i] + b[j], while that is at most ``excess``: the multi-sequence walk.

    Both lists are walked in order; a cell comes up once both of its neighbours nearer in one list have.
    """
    i_of, j_of = np.flatnonzero(a <= excess), np.flatnonzero(b <= excess)
    i_of, j_of = i_of[np.argsort(a[i_of], kind="stable")].tolist(), j_of[np.argsort(b[j_of], kind="stable")].tolist()
    x, y = a[i_of].tolist(), b[j_of].tolist()
    heap, row, out = [(x[0] + y[0], 0, 0)], [0] * len(x), []
    while heap and heap[0][0] <= excess:
        _, i, j = heapq.heappop(heap)
        out.append(i_of[i] * len(b) + j_of[j])
        row[i] = j + 1
        if j + 1 < len(y) and (i == 0 or row[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and row[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return out


def units_of(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; large and small components don't overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _codebook(points: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    book = points[rng.choice(len(points), words, replace=False)].copy()
    for _ in range(rounds):
        near = ((book * book).sum(1) - 2 * points @ book.T).argmin(1)
        n = np.bincount(near, minlength=words)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(points[order], np.minimum(np.cumsum(n) - n, len(points) - 1), axis=0)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def fit(sample: np.ndarray, words: int, threshold: float = THRESHOLD, target: float = TARGET) -> Grid:
    """Codebooks of ``words`` words each, and the excess that meets ``target`` of made-up pairs of cosine ``threshold``.

    A pair is a sampled vector and one turned away from it in a random direction up to the threshold. It is
    met if either of the two visits the other's cell.
    """
    rng, half = np.random.default_rng(0), -(-sample.shape[1] // 2)
    words = min(words, len(sample))
    grid = Grid(_codebook(sample[:, :half], words, rng), _codebook(sample[:, half:], words, rng), 0.0)
    needs = []
    a, b = grid.excesses(sample)
    at = np.arange(len(sample))
    for _ in range(MADE):
        aside = rng.normal(size=sample.shape)
        aside -= (aside * sample).sum(1, keepdims=True) * sample
        norm = np.sqrt((aside * aside).sum(1, keepdims=True))
        c, d = grid.excesses(threshold * sample + np.sqrt(1 - threshold**2) * aside / np.where(norm > 0, norm, 1))
        needs.append(np.minimum(a[at, c.argmin(1)] + b[at, d.argmin(1)], c[at, a.argmin(1)] + d[at, b.argmin(1)]))
    return grid._replace(excess=float(np.quantile(np.concatenate(needs), target)))


def classes(vectors: DataFrame, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have vec_id, the keys of their class, null if they link with nothing; classes cid, keys, lab, n, first_id, vec.

    ``lab`` stands for the label and the vector's length. A class is all rows of a label with the same vector.
    """
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col(label_col).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))
    key = lambda seed: F.when(F.col("valid"), F.xxhash64(F.lit(seed), "label", "vec"))
    rows = vectors.select("vec_id", F.col(label_col).alias("label"), vec.alias("vec"), valid.alias("valid")).withColumns({"h1": key(1), "h2": key(2)})
    found = rows.where("valid").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return rows.select("vec_id", "h1", "h2"), cut(found.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", F.xxhash64("label", F.size("vec")).alias("lab"), "n", "first_id", "vec"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, or of binary doubles, padded with zeros to the longest, or to ``width``."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        parts = [np.frombuffer(x, "<f8") for x in column.to_pylist()]
    else:
        at = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        parts = [flat[a:z] for a, z in zip(at, at[1:])]
    out = np.zeros((len(parts), max([width or 0, *map(len, parts)])))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _dealt(found: DataFrame, grid: Grid, width: int) -> DataFrame:
    """(lab, cell, visitor, home, cid, n, vec): each class at its home, and as a visitor at each cell that it visits."""
    names = ["lab", "cell", "visitor", "home", "cid", "n", "vec"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            raw = _matrix(b.column("vec"))
            a, c = grid.excesses(units_of(np.pad(raw, ((0, 0), (0, max(0, width - raw.shape[1]))))))
            home = grid.homes(a, c)
            visits = [traverse(x, y, grid.excess) for x, y in zip(a, c)]
            times = np.array([len(v) for v in visits])
            rows = np.concatenate([np.arange(len(b)), np.repeat(np.arange(len(b)), times)])
            cells = np.concatenate([home, *[np.array(v, np.int64) for v in visits]])
            sizes = np.diff(b.column("vec").offsets.to_numpy()).tolist()
            packed = pa.array([raw[i, :n].tobytes() for i, n in enumerate(sizes)], pa.binary())
            for s in range(0, len(rows), 4000):
                at, part = pa.array(rows[s : s + 4000]), slice(s, s + 4000)
                kind = np.arange(s, min(s + 4000, len(rows))) >= len(b)
                yield pa.RecordBatch.from_arrays([b.column("lab").take(at), pa.array(cells[part]), pa.array(kind), pa.array(home[rows[part]]), b.column("cid").take(at), b.column("n").take(at), packed.take(at)], names)

    return small_batches(found).select("lab", "cid", "n", "vec").mapInArrow(deal, "lab long, cell long, visitor boolean, home long, cid long, n long, vec binary")


class _Block:
    """The classes at home in one block, and what is linked with them."""

    def __init__(self, grid: Grid, width: int, cid: np.ndarray, n: np.ndarray, vec: np.ndarray):
        self.grid, self.width, self.cid, self.n, self.units = grid, width, cid, n, units_of(vec)
        self.a, self.b = grid.excesses(np.pad(self.units, ((0, 0), (0, max(0, width - vec.shape[1])))))
        self.found, self.tree = np.zeros(len(cid), np.int64), np.arange(len(cid))

    def meet(self, threshold: float, home: np.ndarray, cid: np.ndarray, n: np.ndarray, vec: np.ndarray) -> list[tuple[int, int | None, int]]:
        """(class, other class, 0) of a forest of links with these visitors, and (class, null, rows linked) for each that has any.

        A link that is met from both sides is counted at each for its visitor; one met from one side is counted for both there.
        """
        near = units_of(vec) @ self.units.T >= threshold
        near &= cid[:, None] != self.cid[None, :]
        v, h = np.nonzero(near)
        if not len(v):
            return []
        second = len(self.grid.second)
        once = self.a[h, home[v] // second] + self.b[h, home[v] % second] > self.grid.excess
        np.add.at(self.found, h[once], n[v[once]])
        out = [(int(c), None, int(s)) for c, s in zip(cid, near @ self.n) if s]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        for s, z in zip(starts, np.append(starts[1:], len(v))):
            roots, at = np.unique(self.tree[h[s:z]], return_index=True)
            out += [(int(cid[v[s]]), int(self.cid[h[s + i]]), 0) for i in at]
            if len(roots) > 1:
                self.tree[np.isin(self.tree, roots)] = roots[0]
        return out

    def ended(self) -> list[tuple[int, int | None, int]]:
        return [(int(self.cid[i]), None, int(self.found[i])) for i in np.flatnonzero(self.found)]


def _met(dealt: DataFrame, grid: Grid, width: int, threshold: float) -> DataFrame:
    """(a, b, n): links of a forest, and with a null b the rows linked with a, in part; ``dealt`` is sorted by block, homes first."""

    def out(rows: list) -> pa.RecordBatch:
        a, b, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, homes, block = None, [], None
        for batch in batches:
            lab, cell = (batch.column(i).to_numpy() for i in (0, 1))
            visitor = batch.column(2).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, (lab[1:] != lab[:-1]) | (cell[1:] != cell[:-1]) | (visitor[1:] != visitor[:-1]))) if len(batch) else []
            for s, z in zip(new, np.append(new[1:], len(batch))):
                if own != (lab[s], cell[s]):
                    if block:
                        yield out(block.ended())
                    own, homes, block = (lab[s], cell[s]), [], None
                home, cid, n = (batch.column(i).to_numpy()[s:z] for i in (3, 4, 5))
                vec = _matrix(batch.column(6).slice(s, z - s))
                if not visitor[s]:
                    homes.append((cid, n, vec))
                    continue
                if block is None and homes:
                    block = _Block(grid, width, *(np.concatenate(x) for x in zip(*homes)))
                if block:
                    for i in range(0, z - s, VISITORS):
                        part = slice(i, i + VISITORS)
                        yield out(block.meet(threshold, home[part], cid[part], n[part], vec[part]))
        if block:
            yield out(block.ended())

    return small_batches(dealt).mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null, their vectors equally long and the cosine, in double
    precision, is ``threshold`` or more; all links given are verified, and of those at the threshold itself about
    ``target`` are found, of nearer ones more. ``n_links`` counts other rows, copies among them. component_id is the
    least vec_id that links reach; rows without vec_id take part in links but name no component. ``kept``
    tells whether that is the row's own vec_id, so of rows repeated under an id all are kept; a component without any
    id has a null component_id and its rows are kept. Vectors that are null, empty, zero or hold a null, NaN or infinity link with nothing.
    Codebooks are fitted on some ``SAMPLE`` classes that a hash picks; all are listed and searched. An empty table gives no rows;
    other columns are not read.
    """
    rows, found = classes(vectors.withColumnRenamed(id_col, "vec_id") if id_col != "vec_id" else vectors, vec_col, label_col)
    total, width = found.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if total:
        share = -(-(SAMPLE << 30) // total)
        picked = found.where(F.pmod("h1", F.lit(1 << 30)) < share).select("vec").toArrow().column("vec").combine_chunks() if total > 1 else None
        if picked is None or not len(picked):
            picked = found.select("vec").limit(1).toArrow().column("vec").combine_chunks()
        grid = fit(units_of(_matrix(picked, width)), min(MOST_WORDS, 1 << max(2, round(np.log2(total / AIM) / 2))), threshold, target)
        dealt = _dealt(found, grid, width)
        # Cells of more than a block: their homes are dealt over blocks by a hash, their visitors go to each.
        hot = cut(dealt.where("not visitor").groupBy("lab", "cell").count().where(F.col("count") > BLOCK).select("lab", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        joined = dealt.join(F.broadcast(hot) if hot.count() <= HOT_CELLS else hot, ["lab", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        salted = joined.withColumn("salt", F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
        blocks = salted.select("lab", (F.col("cell") * (1 << 32) + F.col("salt")).alias("cell"), "visitor", "home", "cid", "n", "vec")
        met = cut(_met(blocks.repartition("lab", "cell").sortWithinPartitions("lab", "cell", "visitor"), grid, width, threshold))
    else:
        met = found.select(F.col("cid").alias("a"), F.col("cid").alias("b"), "n")
    linked = met.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    node = connected_components(met.where("b is not null"), "a", "b").select(F.col("node").alias("cid"), "component")
    each = found.select("cid", "h1", "h2", "n", "first_id").join(linked, "cid", "left").join(node, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = each.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = each.join(least, "component").select("h1", "h2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
