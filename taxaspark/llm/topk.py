"""Exact top-k search by inner product, with bounds from segment statistics at several resolutions.

Over a segment of a vector, the inner product is at most length x (mean x mean + deviation x deviation),
so the sum over segments bounds the score from above: coarse with few segments, finer with more.

Vectors are dealt to blocks by the signs of their segments' sums, so like ones lie together, and each block is written
once with what its vectors' statistics span. Each block of queries first meets one block of its own kind: the k-th
best there is a query's floor. Then whole blocks are bounded: a block meets a block of queries only if for some query
the bound over the block's span reaches the floor, and that is known before any vector is shuffled. In a
meeting, only vectors whose coarse and then finer bounds reach the floor are scored, by one dense product
where most survive. A meeting returns k rows per query, and the k best of these are the answer, by
score and then by smaller id; nothing is approximate.

How much is saved depends on the vectors: clusters are skipped whole, while evenly spread vectors of many
dimensions can't be told apart by any bound that costs less than the product, and are all scored. The queries are a
stated set and meet the vectors in blocks; no task holds more than a meeting, and meetings are dealt out by block.

Null or empty vectors and vectors that hold null, NaN or infinite components take no part; neither do rows with
a null id. Vectors of different lengths don't meet. Of several rows of a query's id the least vector asks. Rows of
the query's own id are left out; other repeated rows count each. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, bounded_batches

K, EVERY = 20, 20
SCALE = 64
QUERY_BLOCK, VECTOR_BLOCK = 1024, 2048
LEVELS = (2, 8, 32)
#: Segments whose signs tell kinds of vectors apart, and blocks whose spans are bounded together.
SIGNS, SPANS = 8, 4096
_INNER = 1 << 53


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False))


def integers(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of the segments, and their lengths."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / n
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / n
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)), n


def upper(q: np.ndarray, v: np.ndarray, segments: int) -> np.ndarray:
    """A bound from above of every inner product, with room for rounding."""
    (qm, qd, n), (vm, vd, _) = statistics(q, segments), statistics(v, segments)
    out = np.hstack([qm * n, qd * n]) @ np.hstack([vm, vd]).T
    return out + 1e-9 * np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :] + 1e-6


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's k best that reach its floor; ids come sorted. Sums must stay below 2^53."""
    own = q_ids[:, None] == ids[None, :]
    floor = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    alive = ~own
    if len(ids) > 4 * k:
        bound = upper(q, v, LEVELS[0])
        bound[own] = -np.inf
        seed = np.argpartition(bound, -2 * k, axis=1)[:, -2 * k :]
        first = np.einsum("ij,ikj->ik", q, v[seed])
        first[np.take_along_axis(own, seed, 1)] = -np.inf
        floor = np.maximum(floor, np.partition(first, -k, axis=1)[:, -k])
        alive &= bound >= floor[:, None]
        for segments in LEVELS[1:]:
            if segments >= q.shape[1] or alive.mean() > 0.9:  # a finer bound costs segments / dimensions of a product and must save more
                break
            some = np.flatnonzero(alive.any(0))
            finer = np.zeros_like(alive)
            finer[:, some] = upper(q, v[some], segments) >= floor[:, None]
            alive &= finer
    columns = np.flatnonzero(alive.any(0))
    left = alive[:, columns]
    score = np.where(left, q @ v[columns].T, -np.inf) if left.size and left.mean() > 0.05 else _sparse(q, v, columns, left)
    if len(columns) > k:
        kth = np.maximum(np.partition(score, -k, axis=1)[:, -k], floor)
    else:
        kth = floor
    for r in range(len(q)):
        at = np.flatnonzero((score[r] >= kth[r]) & (score[r] > -np.inf))
        at = at[np.lexsort((ids[columns[at]], -score[r][at]))][:k]
        yield int(q_ids[r]), ids[columns[at]], score[r][at]


def _sparse(q: np.ndarray, v: np.ndarray, columns: np.ndarray, left: np.ndarray) -> np.ndarray:
    score = np.full(left.shape, -np.inf)
    for r in range(len(q)):
        at = np.flatnonzero(left[r])
        score[r, at] = v[columns[at]] @ q[r]
    return score


def _large(q_ids, q, ids, v, k) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """The same in whole numbers of any size; scores beyond a long are held at its ends."""
    for qi, x in zip(q_ids.tolist(), q.tolist(), strict=True):
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in zip(ids.tolist(), v.tolist(), strict=True) if i != qi)[:k]
        yield qi, np.array([i for _, i in found], np.int64), [max(-(2**63), min(2**63 - 1, -s)) for s, _ in found]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and their components one after the other."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _kinds(bits: int):
    """Adds n (the length) and code: the signs of the first segments' sums, as many as there are bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = _matrix(b.column("v"))
            code, begin = np.zeros(len(sizes), np.int64), np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = flat[begin[at][:, None] + np.arange(n)].astype(float)
                mean, _, _ = statistics(x, SIGNS)
                for k in range(min(bits, mean.shape[1])):
                    code[at] |= (mean[:, k] > 0).astype(np.int64) << k
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(sizes.astype(np.int64)), pa.array(code)], names=["id", "v", "n", "code"])

    return run


def _span(x: np.ndarray) -> np.ndarray:
    """Per segment of the finest level but one: the least and greatest mean, and the greatest deviation."""
    mean, deviation, _ = statistics(x, LEVELS[1])
    return np.stack([mean.min(0), mean.max(0), deviation.max(0)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, code, block, id, v) come by block, and by id within: one row per block, with ids, components and span."""
    held: list[pa.RecordBatch] = []
    last = None

    def out() -> pa.RecordBatch:
        ids = np.concatenate([p.column("id").to_numpy() for p in held])
        x = np.concatenate([_matrix(p.column("v"))[1] for p in held])
        n, code, block = (held[0].column(c)[0].as_py() for c in ("n", "code", "block"))
        kind = next((t for t in ("i1", "i2", "i4") if x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max), "i8")
        span = _span(x.reshape(-1, n).astype(float))
        cols = [[n], [code], [block], [ids.astype("<i8").tobytes()], [kind], [x.astype(f"<{kind}").tobytes()], [span.tobytes()]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4]), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.binary())], names=["n", "code", "block", "ids", "kind", "x", "span"])

    for b in batches:
        key = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if held and key[i] != last:
                    yield out()
                    held.clear()
                held.append(b.slice(i, j - i))
                last = key[i]
    if held:
        yield out()


_BLOCK = "n bigint, code bigint, block bigint, ids binary, kind string, x binary, span binary"


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of about `size` vectors of one length and kind; rows of one id are dealt apart."""
    counts = rows.groupBy("n", "code").agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_blocks"))  # lengths x 2^SIGNS rows
    put = rows.join(F.broadcast(counts), ["n", "code"])
    block = F.col("n") * 2**40 + F.col("code") * 2**30 + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("_blocks"))
    put = put.select("n", "code", block.cast("bigint").alias("block"), "id", "v")
    return put.repartition("block").sortWithinPartitions("block", "id").mapInArrow(_blocks, _BLOCK)


def _read(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}x"], f"<{row[f'{side}kind']}").reshape(-1, row["n"])


def _meet(row: dict, k: int, floor: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    (qi, q), (ids, v) = _read(row, "q"), _read(row, "")
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * row["n"]
    if top < _INNER:
        yield from best(qi, q.astype(float), ids, v.astype(float), k, floor)
    else:
        yield from _large(qi, q, ids, v, k)


def _floors(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per block of queries: what each query's k-th best must reach, by the block of its own kind."""
    for batch in batches:
        for row in batch.to_pylist():
            floor = np.full(len(row["qids"]) // 8, -np.inf)
            if row["ids"] is not None:
                for r, (_, ids, scores) in enumerate(_meet(row, k, None)):
                    if len(ids) == k:
                        floor[r] = float(scores[-1]) * (1 - 1e-15) - 1 if abs(float(scores[-1])) >= _INNER else scores[-1]
            yield pa.RecordBatch.from_arrays([pa.array([row["qblock"]]), pa.array([floor.tobytes()], pa.binary())], names=["qblock", "floor"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a block of queries with its floors and a list of (block, span): the blocks that may hold an answer."""
    for batch in batches:
        for row in batch.to_pylist():
            _, q = _read(row, "q")
            floor = np.frombuffer(row["floor"])
            mean, deviation, n = statistics(q.astype(float), LEVELS[1])
            blocks = np.array([x["block"] for x in row["spans"]], np.int64)
            spans = np.stack([np.frombuffer(x["span"]).reshape(3, -1) for x in row["spans"]])
            low, high, wide = (spans[:, i] for i in range(3))
            up, down = np.maximum(mean, 0) * n, np.minimum(mean, 0) * n
            bound = up @ high.T + down @ low.T + (deviation * n) @ wide.T
            slack = 1e-9 * (np.abs(mean) * n) @ np.maximum(np.abs(low), np.abs(high)).T + 1e-9 * np.abs(bound) + 1e-6
            some = blocks[(bound + slack >= floor[:, None]).any(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["qblock"])), pa.array(some)], names=["qblock", "block"])


class Search:
    """The steps of a search: `vectors` and `queries` in blocks, `floors`, the `meetings` that are left, and the answer."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE):
        spark, self.k, self.scratch = vectors.sparkSession, k, Scratch(vectors.sparkSession)
        bounded_batches(spark)
        keep = self.scratch.keep
        rows = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector), scale).alias("v"))
        bits = min(SIGNS, max(0, (rows.count() // VECTOR_BLOCK).bit_length() - 1))
        rows = rows.mapInArrow(_kinds(bits), "id bigint, v array<bigint>, n bigint, code bigint")
        self.vectors = keep(_in_blocks(rows, VECTOR_BLOCK))
        asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "n", "code")).alias("r")).select("id", "r.*")
        self.queries = keep(_in_blocks(asked, QUERY_BLOCK).toDF("n", "code", "qblock", "qids", "qkind", "qx", "_span").drop("_span"))
        self.parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        home = self.vectors.groupBy("n", "code").agg(F.min("block").alias("block"))
        own = self.queries.join(home, ["n", "code"], "left").join(self.vectors.select("block", "ids", "kind", "x"), "block", "left")
        self.floors = keep(own.drop("code", "block").repartition(self.parts, "qblock").mapInArrow(lambda b: _floors(b, k), "qblock bigint, floor binary"))
        # spans are gathered in lists of a bounded number, and every list of its length meets every block of queries
        lists = self.vectors.select("n", "block", "span", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-self.vectors.count() // SPANS)))).alias("_list"))
        lists = lists.groupBy("n", "_list").agg(F.collect_list(F.struct("block", "span")).alias("spans"))
        pairs = self.queries.join(self.floors, "qblock").join(lists, "n").drop("code", "_list")
        self.meetings = keep(pairs.mapInArrow(_reached, "qblock bigint, block bigint"))

    def answer(self) -> DataFrame:
        k = self.k

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    out = [(a, b, int(s)) for a, bs, ss in _meet(row, k, np.frombuffer(row["floor"])) for b, s in zip(bs.tolist(), ss, strict=True)]
                    a, b, s = zip(*out, strict=True) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, s)], names=["query_id", "vec_id", "score"])

        asked = self.meetings.join(self.queries.drop("code").join(self.floors, "qblock"), "qblock").repartition(self.parts, "block")
        met = asked.join(self.vectors.select("block", "ids", "kind", "x").repartition(self.parts, "block"), "block")
        found = met.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each id divisible by `every`, its k highest integer inner products."""
    return Search(vectors, id_col, vector, k, every, scale).answer()
