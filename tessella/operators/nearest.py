"""Exact nearest vectors, block by block.

Vectors are packed into blocks; every block of questions meets every block of chunks of its scope. A product of float32
matrices tells which pairs can't be among the nearest, with a margin that covers its rounding. For l1 it is a sum over the
dimensions: of whole steps in bytes as soon as a question has a distance to beat, and in float32 of what they leave. The rest get their distance in float64, summed in order, so that it is the same as functions.vectors.distance to
the last bit. A pair of blocks returns at most `limit` rows a question. A task keeps for each question the `limit`
least distances that it has met (of the first KEPT values' questions; of others only what one block reached). What it finds
waits in the task, up to WAITING_BYTES, so that what turns out to be farther is left out.

Few questions are sent to the chunks where they lie; for more, chunks are dealt out first, to as many tasks as they and the
cores need: every task returns its own first rows of a question, so more tasks are more rows to rank. Blocks of questions are broadcast
after a check of their bytes, otherwise joined by shuffle. Without a scope they are sent to the Python workers, so that neither
they nor the chunks go through the JVM once for every pair of blocks.

Vectors that are null, hold null, NaN or infinity, are very large or small or of another length than their block's are
compared pair by pair. Distances are then what the expressions give, but for null distances, which come last as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.sizes import MAX_BYTES, MAX_ROWS
from tessella.functions.vectors import METRICS

CHUNKS, QUESTIONS = 2048, 1024  # rows of a block
BLOCK_BYTES = 4 << 20
FEW = 64  # so many questions are not worth a shuffle of the chunks
PARTS = 4  # of a list
TILE = {"l1": 1 << 17}
TILE_OTHERWISE = 1 << 20
STEPS, TILE_OF_STEPS = 127, 1 << 18  # two differences of steps fit into a byte
TASK_CHUNKS, TASKS_PER_CORE = 32 * CHUNKS, 3
VALUES_AT_ONCE = 1 << 22
KEPT = 1 << 23  # distances that a task keeps
WAITING_BYTES = 32 << 20


def packed(rows: DataFrame, vector: str, names: list[str], by: list[str], most: int) -> DataFrame:
    """(by, no, n, dim, sizes, vectors, rows): blocks of at most `most` rows with the same values of `by`, in the partitions' order.

    sizes: int32, -1 for vectors without a value; vectors: float64, filled up with zeros; rows: the names' columns as an Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        key, n, no = None, 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes, m = _matrix(table[vector].combine_chunks() if table[vector].num_chunks != 1 else table[vector].chunk(0))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(names).schema) as out:
                out.write_table(table.select(names))
            made = [table[c].slice(0, 1).combine_chunks() for c in by]
            made = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in made]
            made += [pa.array([no], pa.int64()), pa.array([len(sizes)], pa.int32()), pa.array([m.shape[1]], pa.int32())]
            made += [pa.array([x], pa.binary()) for x in (sizes.tobytes(), m.tobytes(), sink.getvalue().to_pybytes())]
            return pa.RecordBatch.from_arrays(made, [*by, "no", "n", "dim", "sizes", "vectors", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows - 1, bool)
            for c in by:
                column = batch.column(c)
                changes |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            width = max(1, batch.nbytes // batch.num_rows)
            room = max(1, min(most, BLOCK_BYTES // width))
            edges = [0, *(np.flatnonzero(changes) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                own = tuple(batch.column(c)[a].as_py() for c in by)
                if held and own != key:
                    yield block()
                    held, n, no = [], 0, no + 1
                key = own
                while a < b:
                    some = min(b - a, max(1, room - n))
                    held.append(batch.slice(a, some))
                    a, n = a + some, n + some
                    if n >= room:
                        yield block()
                        held, n, no = [], 0, no + 1
        if held:
            yield block()

    fields = [T.StructField(rows.schema[c].name, rows.schema[c].dataType) for c in by]
    rest = "no long, n int, dim int, sizes binary, vectors binary, rows binary"
    return rows.mapInArrow(pack, T.StructType([*fields, *T.StructType.fromDDL(rest).fields]))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    values = column.flatten()
    holes = np.zeros(len(sizes), bool)
    if values.null_count:
        holes[np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))[values.is_null().to_numpy(zero_copy_only=False)]] = True
        values = values.fill_null(0.0)
    dim = max(int(sizes.max()), 0)
    m = np.zeros((len(sizes), dim))
    m[np.arange(dim)[None, :] < sizes[:, None]] = values.to_numpy(zero_copy_only=False)
    m[holes] = 0
    sizes[holes] = -1
    return sizes, m


class _Side(NamedTuple):
    sizes: np.ndarray
    m: np.ndarray  # float64
    norm: np.ndarray
    near: np.ndarray  # float32; of unit length for angles
    reach: np.ndarray  # what the margin grows with
    odd: np.ndarray  # compared pair by pair

    def some(self, rows) -> _Side:
        return _Side(*[x[rows] for x in self])


def _total(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from left to right."""
    return products.cumsum(1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _side(sizes: np.ndarray, m: np.ndarray, dim: int, usual: int, metric: str) -> _Side:
    """dim: of both sides' widest; usual: the length that most vectors of the block of chunks have."""
    if m.shape[1] < dim:
        m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
    with np.errstate(all="ignore"):
        norm = np.sqrt(_total(m * m))
        if metric == "cosine":
            near, reach = m / np.where(norm == 0, 1.0, norm)[:, None], np.ones(len(m))
            odd = ~((norm == 0) & ~m.any(1) | (norm > 1e-150) & (norm < 1e150))
        else:
            near, reach = m, np.abs(m).sum(1) if metric == "l1" else norm
            odd = ~(reach <= 1e15)
        odd |= sizes != usual
        near = np.where(odd[:, None], 0.0, near).astype(np.float32)
    return _Side(sizes, m, norm, near, np.where(odd, 0.0, reach), odd)


def _rough(q: _Side, c: _Side, across: np.ndarray, metric: str) -> np.ndarray:
    """What grows with the distance: minus the dot product, the squared distance or the distance. across: c.near, transposed."""
    if metric == "l1":
        out, step = np.zeros((len(q.near), len(c.near)), np.float32), np.empty((len(q.near), len(c.near)), np.float32)
        for j in range(across.shape[0]):
            np.subtract(across[j][None, :], q.near[:, j : j + 1], out=step)
            np.abs(step, out=step)
            out += step
        return out
    out = q.near @ across  # one of them with the other sign
    if metric == "l2":
        out *= 2
        out += (q.reach * q.reach).astype(np.float32)[:, None]
        out += (c.reach * c.reach).astype(np.float32)[None, :]
    return out


def _across(c: _Side, metric: str) -> np.ndarray:
    return np.ascontiguousarray(c.near.T if metric == "l1" else -c.near.T)


def _limits(q: _Side, c: _Side, bound: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Up to where pairs at most at `bound` lie by _rough(), and the margin for rounding in it."""
    most = c.reach.max(initial=0.0)
    dim = c.m.shape[1]
    scale = {"cosine": 1.0, "inner_product": most * q.reach, "l2": (most + q.reach) ** 2, "l1": most + q.reach}[metric]
    margin = (dim + 8) * 2.0**-22 * scale + (2.0**-50 if metric in ("cosine", "inner_product") else 0.0) + 1e-36 * (dim + 1)
    limits = {"cosine": bound - 1, "inner_product": bound - 1, "l2": bound * bound * (1 + 1e-12), "l1": bound}[metric] + margin
    return limits, np.broadcast_to(margin, len(bound))


def _may_be_near(rough: np.ndarray, q: _Side, c: _Side, bound: np.ndarray, limit: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(question, chunk) of the pairs that may be among the first `limit` of this block and at most at `bound`."""
    limits, margin = _limits(q, c, bound, metric)
    floor = -1.0 if metric in ("cosine", "inner_product") else 0.0  # all below have the distance 0
    odd, width = np.flatnonzero(c.odd), rough.shape[1]
    if len(odd):
        rough[:, odd] = np.inf
    with np.errstate(over="ignore"):
        mask = rough <= np.nextafter(limits.astype(np.float32), np.float32(np.inf))[:, None]
        if width > limit:
            # places in the flat mask: NumPy finds those much faster than pairs of places
            if np.count_nonzero(mask) > mask.size // 16:
                per = np.count_nonzero(mask, axis=1)
            else:
                per = np.diff(np.searchsorted(np.flatnonzero(mask), np.arange(len(mask) + 1) * width))
            many = np.flatnonzero(per > 4 * limit)
            if len(many):
                part = rough[many]
                kth = np.partition(part, limit - 1, axis=1)[:, limit - 1].astype(np.float64)
                nearer = np.minimum(limits[many], np.maximum(kth, floor) + 2 * margin[many])
                mask[many] = part <= np.nextafter(nearer.astype(np.float32), np.float32(np.inf))[:, None]
    if len(odd):
        mask[:, odd] = True
    if q.odd.any():
        mask[q.odd] = True
    return np.divmod(np.flatnonzero(mask), width)


class _Steps(NamedTuple):
    """A block of chunks in whole steps, for l1: the distance of two vectors is at least that of their steps less what
    either is off by."""

    low: float
    step: float
    across: np.ndarray  # uint8, transposed
    off: float  # the most of the block

    @staticmethod
    def of(c: _Side) -> _Steps | None:
        usual = c.m[~c.odd]
        low, high = (float(usual.min()), float(usual.max())) if usual.size else (0.0, 0.0)
        step = (high - low) / STEPS
        if not 1e-30 < step < np.inf:
            return None
        made = _Steps(low, step, np.empty((0, 0), np.uint8), 0.0)
        codes, off = made.codes(c)
        return made._replace(across=np.ascontiguousarray(codes.T), off=float(off[~c.odd].max()))

    def codes(self, side: _Side) -> tuple[np.ndarray, np.ndarray]:
        m = np.where(side.odd[:, None], 0.0, side.m)
        codes = np.clip(np.rint((m - self.low) / self.step), 0, STEPS)
        return codes.astype(np.uint8), np.abs(m - (self.low + codes * self.step)).sum(1)

    def near(self, q: _Side, codes: np.ndarray, off: np.ndarray, c: _Side, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(question, chunk) of the pairs that may be at most at `bound`, which is finite; None if they are many. codes, off: of q."""
        dim, width = self.across.shape
        total = np.zeros((len(codes), width), np.uint16 if dim * STEPS < 1 << 16 else np.uint32)
        more, less, two = (np.empty(total.shape, np.uint8) for _ in range(3))
        for j in range(dim):
            x, y = self.across[j][None, :], codes[:, j : j + 1]
            np.maximum(x, y, out=more)
            np.minimum(x, y, out=less)
            if j % 2 == 0:
                np.subtract(more, less, out=two)
            else:
                more -= less
                two += more
            if j % 2 or j == dim - 1:
                total += two
        limits, _ = _limits(q, c, bound, "l1")
        steps = np.floor((limits + off + self.off) / self.step * (1 + 1e-9)) + 1
        mask = total <= np.minimum(steps, np.iinfo(total.dtype).max).astype(total.dtype)[:, None]
        if c.odd.any():
            mask[:, c.odd] = True
        if np.count_nonzero(mask) > mask.size // 16:
            return None
        qi, ci = np.divmod(np.flatnonzero(mask), width)
        rough = np.empty(len(qi), np.float32)
        at_once = max(1, VALUES_AT_ONCE // max(1, dim))
        for i in range(0, len(qi), at_once):
            rough[i : i + at_once] = np.abs(c.near[ci[i : i + at_once]] - q.near[qi[i : i + at_once]]).sum(1)
        kept = (rough <= np.nextafter(limits.astype(np.float32), np.float32(np.inf))[qi]) | c.odd[ci]
        return qi[kept], ci[kept]


def _distances(q: _Side, c: _Side, qi: np.ndarray, ci: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """functions.vectors.distance of pairs of rows, and where it is null."""
    d, null = np.empty(len(qi)), np.zeros(len(qi), bool)
    step = max(1, VALUES_AT_ONCE // max(1, c.m.shape[1]))
    for i in range(0, len(qi), step):
        a, b = ci[i : i + step], qi[i : i + step]
        x, y = c.m[a], q.m[b]
        some = (c.sizes[a] >= 0) & (q.sizes[b] >= 0)
        same = some & (c.sizes[a] == q.sizes[b])
        with np.errstate(all="ignore"):
            if metric == "cosine":
                lengths = c.norm[a] * q.norm[b]
                cosine = _total(x * y) / lengths
                # of numbers and NaN, the expression's least is the number
                got = np.where(same, 1 - np.where(np.isnan(cosine), 1.0, np.clip(cosine, -1.0, 1.0)), 2.0)
                got[some & (lengths == 0)] = 1.0
            elif metric == "inner_product":
                got = np.where(same, np.maximum(0.0, 1 - _total(x * y)), 0.0)
            else:
                got = np.where(same, np.sqrt(_total((x - y) * (x - y))) if metric == "l2" else _total(np.abs(x - y)), 0.0)
                null[i : i + step] = ~same
        d[i : i + step] = got
    return d, null


def _nearest_of(q: _Side, c: _Side, across: np.ndarray, bound: np.ndarray, limit: int, metric: str, most: float | None, best: np.ndarray | None, some: tuple[np.ndarray, np.ndarray] | None = None):
    """(question, chunk, distance, null) of each question's first `limit` chunks of a block; bound is brought down.

    best: the least distances so far, `limit` of each question, which are brought up to date. some: the pairs to look at, if it is known that others are farther than bound."""
    qi, ci = _may_be_near(_rough(q, c, across, metric), q, c, bound, limit, metric) if some is None else some
    d, null = _distances(q, c, qi, ci, metric)
    if most is not None:
        kept = (d <= most) & ~null
        qi, ci, d, null = qi[kept], ci[kept], d[kept], null[kept]
    order = np.lexsort((ci, d, null, qi))
    qi, ci, d, null = qi[order], ci[order], d[order], null[order]
    start = np.searchsorted(qi, np.arange(len(bound) + 1))
    place = np.arange(len(qi)) - start[qi]
    first = place < limit
    qi, ci, d, null, place = qi[first], ci[first], d[first], null[first], place[first]
    if not len(qi):
        return qi, ci, d, null
    met = np.flatnonzero(start[1:] > start[:-1])
    new = np.full((len(met), place.max() + 1), np.inf)
    new[np.searchsorted(met, qi), place] = np.where(null | np.isnan(d), np.inf, d)
    if best is None:
        reached = new[:, limit - 1] if new.shape[1] == limit else np.inf
    else:
        least = np.partition(np.concatenate([best[met], new], 1), limit - 1, axis=1)[:, :limit]
        best[met], reached = least, least[:, -1]
    bound[met] = np.fmin(bound[met], reached)
    kept = ~np.isfinite(bound[qi]) | (d <= bound[qi]) & ~null
    return qi[kept], ci[kept], d[kept], null[kept]


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Waiting:
    """Rows that a task has found and that may turn out to be farther than a question's first ones."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []
        self.size = 0

    def add(self, bound: np.ndarray, qi: np.ndarray, d: np.ndarray, null: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """bound: of all the block's questions; it is brought down later. Yields all rows once they are too many."""
        self.held.append((bound, qi, d, null, table))
        self.size += table.nbytes + 24 * len(qi)
        if self.size > WAITING_BYTES:
            self._leave_out()
            if self.size > WAITING_BYTES // 2:
                yield from self.all()

    def _leave_out(self) -> None:
        held, self.held, self.size = self.held, [], 0
        for bound, qi, d, null, table in held:
            near = ~np.isfinite(bound[qi]) | (d <= bound[qi]) & ~null
            if not near.all():
                qi, d, null, table = qi[near], d[near], null[near], table.filter(pa.array(near))
            if len(qi):
                self.held.append((bound, qi, d, null, table))
                self.size += table.nbytes + 24 * len(qi)

    def all(self) -> Iterator[pa.RecordBatch]:
        self._leave_out()
        tables, self.held, self.size = [x[-1] for x in self.held], [], 0
        if tables:
            yield from pa.concat_tables(tables).combine_chunks().to_batches(max_chunksize=1 << 16)


def tasks_for(chunks: DataFrame) -> int:
    """How many tasks chunks are dealt to: by their number and the cores, whatever the number of shuffle partitions."""
    return max(TASKS_PER_CORE * chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // TASK_CHUNKS))


def nearest(chunks: DataFrame, queries: DataFrame, *, keys: list[str], names: list[str], scope: list[str], metric: str, limit: int, maximum_distance: float | None = None, lists: bool = False) -> DataFrame:
    """(keys, names, distance): of every query, chunks among which are its first `limit` by distance and chunk id.

    chunks: names, scope, embedding. queries: keys, scope, query_embedding. lists: a query meets only the chunks whose
    list_no is among its lists."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    double = lambda c: F.col(c).cast("array<double>").alias(c)
    asked = queries.select(*dict.fromkeys([*keys, *scope, *(["lists"] if lists else [])]), double("query_embedding"))
    if scope:
        asked = asked.dropna(subset=scope).repartition(parts, *scope).sortWithinPartitions(*scope)
    asking = packed(asked, "query_embedding", [*keys, *(["lists"] if lists else [])], scope, QUESTIONS)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    n_asked, n_blocks, n_bytes = asking.agg(total("n"), F.count("*"), total(F.octet_length("vectors") + F.octet_length("rows"))).first()
    by = [*scope, *(["list_no"] if lists else [])]
    lean = chunks.select(*dict.fromkeys([*names, *by]), double("embedding")).dropna(subset=by) if by else chunks.select(*names, double("embedding"))
    if n_asked > FEW and lists:
        lean = lean.repartition(parts, "list_no", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
    elif n_asked > FEW:
        lean = lean.repartition(tasks_for(lean), "chunk_id")
    blocks = packed(lean.sortWithinPartitions(*by, "chunk_id"), "embedding", names, by, CHUNKS)
    asking = asking.select(*scope, *[F.col(c).alias(f"q_{c}") for c in ("no", "n", "dim", "sizes", "vectors", "rows")])
    few_bytes, sent = n_blocks <= MAX_ROWS and n_bytes <= MAX_BYTES, None
    if few_bytes and not scope:
        pairs, sent = blocks, chunks.sparkSession.sparkContext.broadcast(_stream(asking.toArrow()))
    else:
        asking = F.broadcast(asking) if few_bytes else asking
        pairs = blocks.join(asking, scope) if scope else blocks.crossJoin(asking)
    most = None if maximum_distance is None else float(maximum_distance)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
        kept = 0
        held = None, None, None, 0, None
        asked = None if sent is None else [(b, j) for b in pa.ipc.open_stream(sent.value).read_all().to_batches() for j in range(b.num_rows)]
        waiting = _Waiting()

        def values(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.frombuffer(batch.column(f"{prefix}sizes")[i].as_buffer(), np.int32)
            return sizes, np.frombuffer(batch.column(f"{prefix}vectors")[i].as_buffer(), np.float64).reshape(len(sizes), batch.column(f"{prefix}dim")[i].as_py())

        for batch, i, ask, j in ((b, i, *a) for b in batches for i in range(b.num_rows) for a in ([(b, i)] if asked is None else asked)):
            dim = max(batch.column("dim")[i].as_py(), ask.column("q_dim")[j].as_py())
            if held[0] != (batch.column("no")[i].as_py(), dim):
                sizes, m = values(batch, i, "")
                usual = int(np.bincount(np.maximum(sizes, 0)).argmax())
                side = _side(sizes, m, dim, usual, metric)
                held = (batch.column("no")[i].as_py(), dim), side, _across(side, metric), usual, _Steps.of(side) if metric == "l1" else None
            _, c, across, usual, steps = held
            asks = pa.ipc.open_stream(ask.column("q_rows")[j].as_buffer()).read_all()
            q = _side(*values(ask, j, "q_"), dim, usual, metric)
            asker = ask.column("q_no")[j].as_py()
            if asker not in bounds:
                kept += len(q.sizes) * limit
                bounds[asker] = np.full(len(q.sizes), np.inf if most is None else most), np.full((len(q.sizes), limit), np.inf) if kept <= KEPT else None
            bound, best = bounds[asker]
            rows = np.arange(len(q.sizes))
            if lists:
                own = asks["lists"].combine_chunks()
                owner = np.repeat(rows, pc.list_value_length(own).fill_null(0).to_numpy(zero_copy_only=False))
                rows = np.unique(owner[own.flatten().to_numpy(zero_copy_only=False) == batch.column("list_no")[i].as_py()])
            found = []
            tile = max(1, TILE.get(metric, TILE_OTHERWISE) // len(c.sizes))
            stepped = np.zeros(len(rows), bool) if steps is None else np.isfinite(bound[rows]) & ~q.odd[rows]
            codes, off = steps.codes(q) if stepped.any() else (None, None)
            tiles = [(own[at : at + n], by) for own, n, by in ((rows[stepped], max(1, TILE_OF_STEPS // len(c.sizes)), True), (rows[~stepped], tile, False)) for at in range(0, len(own), n)]
            while tiles:
                some, by_steps = tiles.pop()
                theirs, reached = q.some(some), bound[some]
                near = steps.near(theirs, codes[some], off[some], c, reached) if by_steps else None
                if by_steps and near is None and len(some) > tile:
                    tiles += [(some[at : at + tile], False) for at in range(0, len(some), tile)]
                    continue
                least = None if best is None else best[some]
                qi, ci, d, null = _nearest_of(theirs, c, across, reached, limit, metric, most, least, near)
                bound[some] = reached
                if best is not None:
                    best[some] = least
                found.append((some[qi], ci, d, null))
            if not found:
                continue
            qi, ci, d, null = (np.concatenate(x) for x in zip(*found))
            theirs = pa.ipc.open_stream(batch.column("rows")[i].as_buffer()).read_all()
            asks, theirs = asks.take(pa.array(qi)), theirs.take(pa.array(ci))
            table = pa.table({n: asks[n] if n in keys else theirs[n] for n in out} | {"distance": pa.array(d, mask=null)})
            yield from waiting.add(bound, qi, d, null, table)
        yield from waiting.all()

    out = list(dict.fromkeys([*keys, *names]))
    schema = T.StructType([T.StructField(n, (queries if n in keys else chunks).schema[n].dataType) for n in out] + [T.StructField("distance", T.DoubleType())])
    return pairs.mapInArrow(meet, schema)
