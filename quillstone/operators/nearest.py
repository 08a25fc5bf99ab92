"""The k nearest vectors of many queries by blocked matrix products, exact: what single precision can't tell is scored in double."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Vectors that are looked at together, in bytes; queries and vectors of one product.
HELD, ROWS, COLUMNS = 1 << 25, 256, 4096


@dataclass(frozen=True)
class Asked:
    """Distinct query vectors by dimension: {dim: (numbers, vectors)}; the ids of number n are ids[at[n]:at[n + 1]]."""

    by_dim: dict[int, tuple[np.ndarray, np.ndarray]]
    ids: pa.Array
    at: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Asked:
        """Of a table (query_id, v)."""
        ids, column = (table.column(c).combine_chunks() for c in ("query_id", "v"))
        by_dim, order, times = {}, [], []
        for dim, rows, m in _matrices(column):
            first, of = _distinct(m)
            by_dim[dim] = np.arange(len(times), len(times) + len(first), dtype=np.int32), m[first]
            order.append(rows[np.argsort(of, kind="stable")])
            times += np.bincount(of, minlength=len(first)).tolist()
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        return cls(by_dim, ids.take(pa.array(order)), np.concatenate(([0], np.cumsum(times, dtype=np.int64))))


def _matrices(column: pa.Array):
    """(dim, rows, vectors) of a list column, by dimension; vectors that have no cosine are left out."""
    bounds = column.offsets.to_numpy()
    size, flat = np.diff(bounds), column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        m = flat[bounds[rows][:, None] + np.arange(dim)]
        good = np.isfinite(m).all(1) & (_norm(m) > 0)
        if good.any():
            yield dim, rows[good], m[good]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first element to the last as SQL does."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def _norm(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_dot(m, m))


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct row, which of these each row is)."""
    raw = np.ascontiguousarray(m + 0.0).view(f"V{m.shape[1] * 8}").ravel()  # + 0.0: -0.0 is 0.0
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    return first, of.ravel()


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


class _Best:
    """The k best (score, id) of each query of a dimension so far; ties go to the lesser id."""

    def __init__(self, vectors: np.ndarray, k: int, digits: int | None, kind):
        self.q, self.k, self.digits = vectors, k, digits
        self.norm = _norm(vectors)
        self.unit = (vectors / self.norm[:, None]).astype(np.float32)
        self.score, self.id = np.full((len(vectors), k), -np.inf), np.zeros((len(vectors), k), kind)
        # a product of unit vectors in single precision is off by (dim + 4) units in the last place at most
        self.slack = 2 * (vectors.shape[1] + 4) * 2.0**-24 + (0 if digits is None else 10.0**-digits)

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, m = ids[by_id], m[by_id]
        first, of = _distinct(m)
        group = np.argsort(of, kind="stable")  # rows of equal vectors, by id: the k first of each can be wanted
        start = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(first)))))
        m = m[first]
        norm = _norm(m)
        unit = (m / norm[:, None]).astype(np.float32)
        for a in range(0, len(self.q), ROWS):
            for c in range(0, len(m), COLUMNS):
                near = self.unit[a : a + ROWS] @ unit[c : c + COLUMNS].T
                floor = self.score[a : a + ROWS, -1] - self.slack
                live = np.flatnonzero(near.max(1) >= floor)
                if not len(live):
                    continue
                near, floor = near[live], floor[live]
                if near.shape[1] > self.k:
                    floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k] - 2 * self.slack)
                row, col = np.nonzero(near >= floor[:, None])
                row, col = live[row] + a, col + c
                score = _rounded(_dot(m[col], self.q[row]) / (norm[col] * self.norm[row]), self.digits)
                times = np.minimum(start[col + 1] - start[col], self.k)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                self._merge(np.repeat(row, times), np.repeat(score, times), ids[group[np.repeat(start[col], times) + nth]])

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which = np.unique(row)
        row = np.concatenate([np.repeat(which, self.k), row])
        score = np.concatenate([self.score[which].ravel(), score])
        ids = np.concatenate([self.id[which].ravel(), ids])
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids.astype(str), return_inverse=True)[1], -score, row))
        begin = np.searchsorted(row[order], which)
        take = order[begin[:, None] + np.arange(self.k)]
        self.score[which], self.id[which] = score[take], ids[take]


def best(asked, k: int, digits: int | None):
    """Of batches (id, v): (query_id, id, score) of the k best that this task has for each distinct query of asked."""

    def run(batches):
        held, size, found, kind = [], 0, {}, pa.int64()

        def settle():
            ids = pa.concat_arrays([b.column(0) for b in held])
            ids = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(kind) else np.array(ids.to_pylist(), object)
            for dim, rows, m in _matrices(pa.concat_arrays([b.column(1) for b in held])):
                if dim in asked.value.by_dim:
                    if dim not in found:
                        found[dim] = _Best(asked.value.by_dim[dim][1], k, digits, ids.dtype)
                    found[dim].add(ids[rows], m)

        for b in batches:
            kind = b.schema.field(0).type
            held.append(b)
            size += b.nbytes
            if size >= HELD:
                settle()
                held, size = [], 0
        if held:
            settle()
        for dim, x in found.items():
            some, step = asked.value.by_dim[dim][0], max(1, 100_000 // k)
            for a in range(0, len(some), step):
                have = np.isfinite(x.score[a : a + step])
                number = np.repeat(some[a : a + step], k).reshape(have.shape)
                yield pa.RecordBatch.from_arrays([pa.array(number[have], pa.int32()), pa.array(x.id[a : a + step][have], kind), pa.array(x.score[a : a + step][have])], ["query_id", "id", "score"])

    return run


def named(asked):
    """Rows (own, id, rank, score) of distinct queries as rows of every query that has this vector."""

    def run(batches):
        for b in batches:
            at, number = asked.value.at, b.column(0).to_numpy()
            times = at[number + 1] - at[number]
            cut = np.searchsorted(np.cumsum(times), np.arange(100_000, times.sum() + 100_000, 100_000), "left") + 1
            for a, e in zip([0, *cut], [*cut, len(times)], strict=True):
                t = times[a:e]
                if not len(t):
                    continue
                nth = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                row = pa.array(np.repeat(np.arange(a, min(e, len(times))), t))
                ids = asked.value.ids.take(pa.array(np.repeat(at[number[a:e]], t) + nth))
                yield pa.RecordBatch.from_arrays([ids, b.column(1).take(row), b.column(3).take(row), b.column(2).take(row)], ["query_id", "id", "score", "rank"])

    return run
