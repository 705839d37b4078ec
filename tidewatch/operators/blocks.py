"""Products of columns of a matrix in long form, block by block, with only what is wanted of a block leaving its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.tables import cut

COLUMNS, ROWS = 256, 4096
PAIR = "i int, p int, j int, q int, value double"

Finish = Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _places(names: DataFrame, name: str, own: str, size: int) -> DataFrame:
    """Each name's block (own) and its place in it, in order of names."""
    every = names.select(name).distinct()
    blocks = max(1, -(-every.count() // size))
    block = every.withColumn(own, F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int"))
    return cut(block.withColumn(f"{own}_place", (F.row_number().over(W.partitionBy(own).orderBy(name)) - 1).cast("int")))


def block_pairs(left: DataFrame, right: DataFrame | None, row: str, column: str, value: str, finish: Finish, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """(a, b, value) of pairs of columns of two matrices (row, column, value) over the same rows, or of one with itself (right None; each pair once, and
    a block with itself). Cells that are missing are zeros.

    A task has a block of columns of either and reads their rows band by band, adding up products and squares, so it holds two blocks of a
    band and one product whatever the number of rows. finish(i, j, products, squares of the left, of the right) then says which
    places are wanted and with what value: (places left, places right, values). Each cell is sent once for each block of the other side:
    this is for up to some ten thousand columns."""
    cells = [cut(df.select(F.col(row).alias("_row"), F.col(column).alias("_column"), F.col(value).cast("double").alias("_value"))) for df in ([left] if right is None else [left, right])]
    names = [_places(c, "_column", "own", columns) for c in cells]
    lines = _places(cells[0] if right is None else cells[0].unionByName(cells[1]), "_row", "band", rows)
    counts = [(n.agg(F.max("own")).first()[0] or 0) + 1 for n in names]
    shape = ["i", "j", "band", "side", "own_place", "band_place", "_value"]

    def sent(side: int, to: object) -> DataFrame:
        return cells[side].join(names[side], "_column").join(lines, "_row").withColumn("at", F.explode(to)).select("at.*", "band", "own_place", "band_place", "_value").select(*shape)

    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = F.col("own")
    if right is None:
        dealt = sent(0, F.transform(each(counts[0]), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"), (k < own).cast("int").alias("side"))))
    else:
        dealt = sent(0, F.transform(each(counts[1]), lambda k: F.struct(own.alias("i"), k.alias("j"), F.lit(0).alias("side")))).unionByName(sent(1, F.transform(each(counts[0]), lambda k: F.struct(k.alias("i"), own.alias("j"), F.lit(1).alias("side")))))

    def grown(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(np.maximum(x.shape, shape))
        out[tuple(slice(0, s) for s in x.shape)] = x
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        total, squares = np.zeros((0, 0)), [np.zeros(0), np.zeros(0)]

        def add() -> None:
            nonlocal total
            side, place, line, cell = (np.concatenate(x) for x in zip(*held, strict=True))
            blocks, height = [], line.max() + 1
            for k in (0, 1):
                mine = side == k
                block = np.zeros((height, place[mine].max() + 1 if mine.any() else 0))
                block[line[mine], place[mine]] = cell[mine]
                blocks.append(block)
            if alone and now[0] == now[1]:
                blocks[1] = blocks[0]
            new = blocks[0].T @ blocks[1]
            total = grown(total, new.shape)
            total[: new.shape[0], : new.shape[1]] += new
            for k, b in enumerate(blocks):
                squares[k] = grown(squares[k], b.shape[1:])
                squares[k][: b.shape[1]] += (b * b).sum(0)
            held.clear()

        def found() -> pa.RecordBatch:
            n = (len(squares[0]), len(squares[1]))
            p, q, values = finish(now[0], now[1], grown(total, n), squares[0], squares[1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), now[0], np.int32)), pa.array(p.astype(np.int32)), pa.array(np.full(len(p), now[1], np.int32)), pa.array(q.astype(np.int32)), pa.array(values.astype(float))], names=["i", "p", "j", "q", "value"])

        for batch in batches:
            parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key = np.stack(parts[:3], axis=1)
            edges = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            for s, e in zip(np.append(0, edges), np.append(edges, len(key)), strict=True):
                new = tuple(key[s].tolist()) if len(key) else now
                if now is not None and new != now:
                    add()
                    if new[:2] != now[:2]:
                        yield found()
                        total, squares = np.zeros((0, 0)), [np.zeros(0), np.zeros(0)]
                now = new
                held.append(tuple(x[s:e] for x in parts[3:]))
        if now is not None:
            add()
            yield found()

    alone = right is None
    pairs = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "band").mapInArrow(run, PAIR)
    named = lambda k, x, y, to: names[k].select(F.col("own").alias(x), F.col("own_place").alias(y), F.col("_column").alias(to))
    both = pairs.join(named(0, "i", "p", "a"), ["i", "p"]).join(named(0 if alone else 1, "j", "q", "b"), ["j", "q"])
    return both.select("a", "b", "value")


def strong_pairs(values: DataFrame, row: str, column: str, value: str, least: float, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """(a, b, product) of the pairs of columns, a < b, whose sum of products over rows is at least `least` in size."""

    def finish(i: int, j: int, total: np.ndarray, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = np.abs(total) >= least
        p, q = np.nonzero(np.triu(keep, 1) if i == j else keep)
        return p, q, total[p, q]

    found = block_pairs(values, None, row, column, value, finish, columns, rows)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("value").alias("product"))


def nearest_columns(queries: DataFrame, reference: DataFrame | None, row: str, column: str, value: str, k: int, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """(a, b, distance): for each column of queries the k columns of the reference at the least Euclidean distance, ties to the smaller name; without a
    reference, of the queries themselves, a column not being its own neighbour.

    Of each pair of blocks k rows a column leave the task, and the k least of these are kept."""
    alone = reference is None

    def finish(i: int, j: int, total: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = np.sqrt(np.maximum(left[:, None] + right[None, :] - 2 * total, 0.0))
        if alone and i == j:
            np.fill_diagonal(far, np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, :k]
        p = np.repeat(np.arange(len(far)), order.shape[1])
        q = order.ravel()
        d = far[p, q]
        return p[d < np.inf], q[d < np.inf], d[d < np.inf]

    pairs = block_pairs(queries, queries if alone else reference, row, column, value, finish, columns, rows).withColumnRenamed("value", "distance")
    place = F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")
