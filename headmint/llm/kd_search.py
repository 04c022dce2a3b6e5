"""Exact top-k by inner product: KD-trees over shards that are dealt by space.

1. A tree of median splits, fitted on a bounded sample (SAMPLE_ROWS), cuts space into cells;
   every vector goes to its cell, so cells follow the data. Each cell's tight box and its
   largest norm are gathered (MAX_CELLS boxes at most). A cell of more than SHARD_ROWS vectors,
   such as one of many equal vectors, is dealt to several shards by hash.
2. A query first searches the cell that promises most. Its k-th score there is its floor.
3. The floor is sent with the query to the other cells, but only to those whose bound (the
   largest inner product that any point of the box could have) reaches it.
4. A shard builds its own tree by median splits on the widest side, with a tight box and the
   largest norm at each node, and answers each query best-first: the node of the highest bound
   is opened next, until the bound falls below the query's k-th score.

A bound is the lesser of the box's and of |query| * largest norm; both are rounded upwards, so
no node is skipped by mistake. Where vectors lie in clusters, few cells and leaves are opened.
Where they fill all directions of many dimensions alike, no box of any exact tree rules much
out, and the cost is that of all products.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headmint.llm.common import shared_dir, stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
SAMPLE_ROWS = 16_384
MAX_CELLS = 1024
LEAF = 128
MOST = (1 << 63) - 1  # scores beyond a long are shown as this, after ranking by the exact ones
EXACT, LONG = float(1 << 53), float(1 << 62)  # up to here products of doubles, of 64-bit integers, are exact


def quantised(column: pa.Array, scale: int = 256) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the rows that take part, and floor(scale * x) of them: a byte for the width
    (4 or 8) and integers of that width, or a 0 and decimal numbers where they are larger."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = np.flatnonzero(np.asarray(column.is_valid()) & (bad[ends] == bad[ends - lengths]))
    x = np.where(np.isfinite(x), x, 0)
    huge = np.abs(x) >= LONG / scale
    q = np.floor(scale * np.where(huge, 0, x)).astype(np.int64)
    wide = np.concatenate([[0], np.cumsum(np.abs(q) >= 1 << 31)])
    over = np.concatenate([[0], np.cumsum(huge)])
    low, high = (ends - lengths)[good], ends[good]
    narrow = q.astype(np.int32)
    out = []
    for a, b, w, o in zip(low.tolist(), high.tolist(), (wide[high] > wide[low]).tolist(), (over[high] > over[low]).tolist(), strict=True):
        if o:  # a double this large is a whole number
            out.append(b"\x00" + ",".join(str(int(x[i]) * scale if huge[i] else int(q[i])) for i in range(a, b)).encode())
        else:
            out.append(b"\x08" + q[a:b].tobytes() if w else b"\x04" + narrow[a:b].tobytes())
    return good, out


def numbers(vector: bytes) -> np.ndarray:
    if vector[0] == 0:
        return np.array([int(x) for x in vector[1:].split(b",")], object)
    return np.frombuffer(vector, np.int32 if vector[0] == 4 else np.int64, offset=1)


def width_of(vector: bytes) -> int:
    return len(numbers(vector)) if vector[0] == 0 else (len(vector) - 1) // vector[0]


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width), object if any(v[0] == 0 for v in vectors) else np.int64)
    for k, v in enumerate(vectors):
        a = numbers(v)
        out[k, : len(a)] = a
    return out


def ordered(score: int) -> bytes:
    """A whole number of any size as bytes of the same order."""
    size = (abs(score).bit_length() + 7) // 8
    out = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + out if score >= 0 else b"\x00" + bytes(255 - x for x in out)


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Of each query and box, in doubles: no point of the box has a larger inner product."""
    with np.errstate(all="ignore"):
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        box = positive @ high.T + negative @ low.T
        slack = (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T) * ((queries.shape[1] + 4) * 2.0**-52)
        ball = np.sqrt((queries * queries).sum(axis=1))[:, None] * norm * (1 + (queries.shape[1] + 4) * 2.0**-52)
        out = np.minimum(box + slack, ball)
    return np.where(np.isnan(out), np.inf, out)


def exact_floats(m: np.ndarray) -> np.ndarray:
    """As doubles; what is too large for one becomes infinite, so that bounds rule nothing out."""
    return m.astype(np.float64) if m.dtype != object else np.array([[float(x) if abs(x) < 1 << 1000 else math.copysign(math.inf, x) for x in r] for r in m], np.float64).reshape(m.shape)


def outward(m: np.ndarray, to: float) -> np.ndarray:
    """Box sides as doubles, rounded away from the box where doubles don't hold them."""
    f = exact_floats(m)
    return np.where(np.abs(f) < EXACT, f, np.nextafter(f, to))


def exact_kind(largest: float) -> type:
    """The number type in which sums of products up to `largest` are exact."""
    return np.float64 if largest < EXACT else np.int64 if largest < LONG else object


class KDTree:
    """Median splits on the widest side; a tight box, and the largest norm, at each node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points = points
        self.sides: list[tuple[np.ndarray, np.ndarray]] = []
        self.split: list[tuple[int, float] | None] = []  # side and the least value above
        self.child: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        if len(points):
            self._grow(0, len(points), leaf)
        self.sorted = points[self.order]
        with np.errstate(over="ignore"):
            f = exact_floats(self.sorted)
            size = np.sqrt((f * f).sum(axis=1)) * (1 + (points.shape[1] + 4) * 2.0**-52)
        self.norm = np.array([size[a:b].max() for a, b in self.span])
        self.low = np.array([outward(x[None], -np.inf)[0] for x, _ in self.sides])
        self.high = np.array([outward(x[None], np.inf)[0] for _, x in self.sides])

    def _grow(self, a: int, b: int, leaf: int) -> int:
        part = self.points[self.order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        node = len(self.child)
        self.sides.append((low, high))
        self.span.append((a, b))
        self.child.append(None)
        self.split.append(None)
        if b - a > leaf and (high > low).any():
            side, mid = int((high - low).argmax()), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, side], mid)]
            self.split[node] = (side, self.points[self.order[a + mid], side])
            self.child[node] = (self._grow(a, a + mid, leaf), self._grow(a + mid, b, leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return reach(exact_floats(queries), self.low, self.high, self.norm)

    def search(self, query: np.ndarray, bound: list[float], ids: np.ndarray, skip: int, k: int, floor) -> tuple[list[tuple], int]:
        """The k best (score, -id, point) of scores from floor on, and how many points were scored; skip: a point's number, or -1."""
        best: list[tuple] = []  # a heap whose first is the worst kept
        todo = [(-bound[0], 0)] if len(bound) else []
        scored = 0
        while todo:
            b, node = heapq.heappop(todo)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -b < least:
                break
            if self.child[node] is not None:
                for c in self.child[node]:
                    if least is None or bound[c] >= least:
                        heapq.heappush(todo, (-bound[c], c))
                continue
            x, y = self.span[node]
            scores = self.sorted[x:y] @ query
            scored += y - x
            for j in range(y - x) if least is None else np.flatnonzero(scores >= least).tolist():
                p = int(self.order[x + j])
                if p == skip:
                    continue
                entry = (int(scores[j]), -int(ids[p]), p)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry[:2] > best[0][:2]:
                    heapq.heapreplace(best, entry)
        return best, scored


class Cells:
    """Cells of space: the leaves of a tree over a sample, and of each the box of what it holds."""

    def __init__(self, sample: np.ndarray, cells: int):
        points = exact_floats(sample)
        points = np.where(np.isfinite(points), points, np.sign(points) * np.finfo(np.float64).max)
        with np.errstate(all="ignore"):
            tree = KDTree(points, max(1, -(-len(points) // max(1, cells))))
        self.split, self.child = tree.split, tree.child
        leaves = [n for n, c in enumerate(tree.child) if c is None]
        self.cell = {n: i for i, n in enumerate(leaves)}

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))] if self.child else []
        while todo:
            node, at = todo.pop()
            if self.child[node] is None:
                out[at] = self.cell[node]
                continue
            side, value = self.split[node]
            above = points[at, side] >= value if side < points.shape[1] else np.full(len(at), 0 >= value)
            todo += [(self.child[node][0], at[~above]), (self.child[node][1], at[above])]
        return out


def _placed(cells: Cells):
    """Quantised rows with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, vectors = quantised(b.column(1))
            points = exact_floats(matrix(vectors, max(map(width_of, vectors), default=0)))
            yield pa.record_batch({"vec_id": b.column(0).take(pa.array(at)), "vector": pa.array(vectors, pa.binary()), "cell": pa.array(cells.of(points), pa.int32())})

    return run


BOX_SCHEMA = "cell int, n bigint, low binary, high binary, norm double"


def _box(cell: int, n: int, low: np.ndarray, high: np.ndarray, norm: float) -> dict:
    return {"cell": cell, "n": n, "low": low.tobytes(), "high": high.tobytes(), "norm": norm}


def _box_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"cell": pa.int32(), "n": pa.int64(), "low": pa.binary(), "high": pa.binary(), "norm": pa.float64()}
    return pa.record_batch({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A box for each cell of a batch."""
    for b in batches:
        vectors, cell = b.column(0).to_pylist(), b.column(1).to_numpy()
        if not vectors:
            continue
        points = matrix(vectors, max(map(width_of, vectors)))
        low, high = outward(points, -np.inf), outward(points, np.inf)
        with np.errstate(all="ignore"):
            far = np.maximum(np.abs(low), np.abs(high))
            norm = np.sqrt((far * far).sum(axis=1)) * (1 + (points.shape[1] + 4) * 2.0**-52)
        yield _box_rows([_box(int(c), int((m := cell == c).sum()), low[m].min(axis=0), high[m].max(axis=0), float(norm[m].max())) for c in np.unique(cell)])


def _one_box(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The box around all boxes of a cell; a shorter vector has zeros at its end."""
    low, high = ([np.frombuffer(x) for x in t.column(c).to_pylist()] for c in ("low", "high"))
    width = max(map(len, low))
    full = lambda rows: np.array([np.pad(x, (0, width - len(x))) for x in rows])
    return pa.Table.from_batches([_box_rows([_box(key[0].as_py(), pc.sum(t.column("n")).as_py(), full(low).min(axis=0), full(high).max(axis=0), pc.max(t.column("norm")).as_py())])])


def _routes(boxes: list[dict], best_only: bool):
    """Cells of each query: the one of the highest bound, or all others whose bound reaches the floor."""
    width = max((len(b["low"]) // 8 for b in boxes), default=0)
    wide = lambda x: np.pad(np.frombuffer(x), (0, width - len(x) // 8))
    number = np.array([b["cell"] for b in boxes], np.int32)
    low, high = np.array([wide(b["low"]) for b in boxes]), np.array([wide(b["high"]) for b in boxes])
    norm = np.array([b["norm"] for b in boxes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).to_pylist()
            if not vectors:
                continue
            bound = reach(exact_floats(matrix(vectors, width)), low, high, norm)
            best = bound.argmax(axis=1)
            if best_only:
                at, cell = np.arange(len(best)), best
            else:
                floor = np.array([-math.inf if x is None or len(x) > 300 else float(x) for x in b.column(3).to_pylist()])
                going = bound >= np.where(np.isinf(floor), floor, floor - np.abs(floor) * 2.0**-52)[:, None]
                going[np.arange(len(best)), best] = False
                at, cell = np.nonzero(going)
            rows = b.take(pa.array(at))
            yield pa.record_batch({"row": rows.column(0), "vec_id": rows.column(1), "vector": rows.column(2), "floor": rows.column(3), "cell": pa.array(number[cell], pa.int32())})

    return run


ASKED_SCHEMA = "row bigint, vec_id bigint, vector binary, floor string, cell int"
FOUND_SCHEMA = "asked bigint, query_id bigint, vec_id bigint, place binary, score bigint, exact string"


def _answer(k: int):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows and block.num_rows:
            vectors, asked = shard.column("vector").to_pylist(), block.column("vector").to_pylist()
            width = max(width_of(v) for v in [*vectors, *asked])
            points, queries = (matrix(v, width) for v in (vectors, asked))
            largest = float(min(np.abs(points).max(initial=0), 1 << 500)) * float(min(np.abs(queries).max(initial=0), 1 << 500)) * max(1, width)
            floors = [None if x is None else int(x) for x in block.column("floor").to_pylist()]
            kind = exact_kind(max([largest, *(float(min(abs(x), 1 << 500)) for x in floors if x is not None)]))
            points, queries = points.astype(kind), queries.astype(kind)
            rows, asked_rows = shard.column("row").to_numpy(), block.column("row").to_numpy()
            ids, asked_ids = shard.column("vec_id").to_numpy(), block.column("vec_id").to_numpy()
            place = {r: p for p, r in enumerate(rows.tolist())}
            tree = KDTree(points)
            bounds = tree.bounds(queries)
            for q in range(len(queries)):
                best, _ = tree.search(queries[q], bounds[q].tolist(), ids, place.get(int(asked_rows[q]), -1), k, floors[q])
                out += [(int(asked_rows[q]), int(asked_ids[q]), -vec_id, ordered(score), max(-MOST, min(MOST, score)), str(score)) for score, vec_id, _ in best]
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.int64(), pa.string()]
        return pa.table({n: pa.array(c, t) for n, t, c in zip(("asked", "query_id", "vec_id", "place", "score", "exact"), kinds, cols, strict=True)})

    return run


def kd_topk(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that the condition is_query holds for, the k
    rows of highest integer inner product, its own left out, ties to the smaller id.

    Components become floor(256 * x). Ranks are by exact scores of any size; where one passes
    a long, the largest long is shown. Rows with a null id, a null vector or a null or
    non-finite component take no part. Shorter vectors are filled up with zeros.
    Repeated rows are rows of their own: each is a candidate, and each that is a query is
    answered. Fewer than k candidates give fewer rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    v = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    total = v.count()
    some = v.select("vector").sample(min(1.0, SAMPLE_ROWS / max(1, total)), seed=7).limit(2 * SAMPLE_ROWS).toArrow()  # decides where cells lie, not what is found
    _, some = quantised(some.column("vector")) if some.num_rows else (None, [])
    cells = Cells(matrix(some, max(map(width_of, some), default=0)), min(MAX_CELLS, len(some) // 16, -(-2 * total // shard_rows)))
    v = stored(v.mapInArrow(_placed(cells), "vec_id bigint, vector binary, cell int").withColumn("row", F.monotonically_increasing_id()), f"{folder}/vectors")
    boxes = v.select("vector", "cell").mapInArrow(_boxes, BOX_SCHEMA).groupBy("cell").applyInArrow(_one_box, BOX_SCHEMA).toArrow().to_pylist()  # MAX_CELLS at most
    shards = spark.createDataFrame([(b["cell"], max(1, -(-b["n"] // shard_rows))) for b in boxes], "cell int, shards int")
    asked = v.filter(is_query(F.col("vec_id"))).select("row", "vec_id", "vector")

    def search(queries: DataFrame, name: str) -> DataFrame:
        """Answers of the cells that queries (as ASKED_SCHEMA) are sent to."""
        queries = stored(queries, f"{folder}/{name}")
        size = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks")).join(F.broadcast(shards), "cell")  # a row a cell
        left = v.join(F.broadcast(size), "cell").withColumn("shard", F.pmod(F.xxhash64("row"), "shards").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = queries.join(F.broadcast(size), "cell").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        left = left.select("cell", "shard", "block", "row", "vec_id", "vector")
        right = right.select("cell", "shard", "block", "row", "vec_id", "vector", "floor")
        found = left.groupBy("cell", "shard", "block").cogroup(right.groupBy("cell", "shard", "block")).applyInArrow(_answer(k), FOUND_SCHEMA)
        return stored(found, f"{folder}/{name}_found")

    by_score = Window.partitionBy("asked").orderBy(F.desc("place"), "vec_id")
    home = search(asked.withColumn("floor", F.lit(None).cast("string")).mapInArrow(_routes(boxes, True), ASKED_SCHEMA), "home")
    floors = home.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select(F.col("asked").alias("row"), F.col("exact").alias("floor"))
    rest = search(asked.join(floors, "row", "left").select("row", "vec_id", "vector", "floor").mapInArrow(_routes(boxes, False), ASKED_SCHEMA), "rest")
    found = home.unionByName(rest).withColumn("rank", F.row_number().over(by_score))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
