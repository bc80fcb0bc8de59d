"""Scoring kernels: a block of queries against batches of corpus rows.

A query block (``DenseQueries``, ``LexicalQueries``) is prepared once and then
sees Arrow batches of corpus rows; a running ``TopK`` keeps each query's k best
rows. What can no longer reach a query's k best is not scored: dense rows by the
triangle inequality against a pivot of their block and by the expanded square,
lexical queries by the greatest impact of their terms in the batch. Both bounds
are safe; only rows that pass are scored exactly, by the same arithmetic
everywhere, so bounds, blocks and partitions never change a result.

Query ids, row ids and payload are Arrow columns of any type. Ties are broken by
row id, so that local and global cuts agree.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle

# The kernels run on executors, which need not have this package installed:
# ship this module's code with the task (it only needs numpy and pyarrow).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CELLS = 4_000_000      # (row, query) cells of one matrix product
BLOCK_PAIRS = 500_000        # term-posting expansions scored at a time, about 100 bytes each
BLOCK_TOKENS = 500_000       # corpus tokens taken at a time, likewise
PIVOTS = 16
PACK_ROWS, PACK_BYTES = 4096, 4 << 20


class TopK:
    """Running k best ``rows`` (an Arrow table whose first column is the id) per
    query. ``kth`` is each query's k-th best distance so far, infinite before.
    With ``distinct`` equal ids count once (rows of one id are equal)."""

    def __init__(self, k: int, n_q: int, schema: pa.Schema, distinct: bool = False):
        self.k, self.distinct = k, distinct
        self.kth = np.full(n_q, np.inf)
        self.q, self.dist, self.rows = np.empty(0, np.int64), np.empty(0), schema.empty_table()
        self.waiting: list = []
        self.held = 0

    def add(self, q: np.ndarray, dist: np.ndarray, rows: pa.Table) -> None:
        if len(q):
            self.waiting.append((q, dist, rows))
            self.held += len(q)
            if self.held >= max(256, len(self.q) // 2):
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        q = np.concatenate([self.q, *(w[0] for w in self.waiting)])
        dist = np.concatenate([self.dist, *(w[1] for w in self.waiting)])
        rows = pa.concat_tables([self.rows, *(w[2] for w in self.waiting)])
        self.waiting, self.held = [], 0
        keep, rank = best(q, dist, rows.column(0), self.k, self.distinct)
        self.q, self.dist, self.rows = q[keep], dist[keep], rows.take(pa.array(keep))
        full = rank == self.k - 1
        self.kth[self.q[full]] = self.dist[full]


def best(q, dist, ids: pa.ChunkedArray, k: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the k smallest (distance, id) per query, and their ranks from 0."""
    if not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((code, dist, q))
    if distinct:
        s, c = q[order], code[order]
        order = order[np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]]
    s = q[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    return order[rank < k], rank[rank < k]


def _values(column) -> np.ndarray:
    """The numbers of a list column's lists, one after the other, NULL as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat numbers of a list column, and each list's start and length (-1: NULL)."""
    lens = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lens = np.where(valid, lens, 0)
    return _values(column), np.cumsum(lens) - lens, np.where(valid, lens, -1)


def _matrix(flat, starts, dim, rows):
    return flat[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))


class DenseQueries:
    """Columns of the block: query id, vector, and, if ``filtered``, the value a
    row must have. With ``centroids`` a row belongs to the cell of its nearest
    centroid, and a query is asked of ``probes`` cells only (``cell_order``)."""

    def __init__(self, batch: pa.RecordBatch, metric: str = "l2sq", filtered: bool = False,
                 centroids: np.ndarray | None = None, spread: np.ndarray | None = None, probes: int = 0):
        if metric not in ("l2sq", "cosine"):
            raise ValueError(f"unknown metric {metric!r}")
        self.qids, self.metric, self.filtered, self.centroids = batch.column(0), metric, filtered, centroids
        self.n = batch.num_rows
        self.seen = self.scored = 0
        flat, starts, lens = _lists(batch.column(1))
        self.parts = {}                                     # dimension -> (queries, matrix, {value: some of them})
        for dim in np.unique(lens[lens >= 0]):
            at = np.flatnonzero(lens == dim)
            q = _matrix(flat, starts, dim, at)
            groups = None
            if filtered:
                groups = {}
                for i, v in enumerate(batch.column(2).take(pa.array(at)).to_pylist()):
                    if v is not None:
                        groups.setdefault(v, []).append(i)
            elif centroids is not None and dim == centroids.shape[1] and len(q):
                near = cell_order(q, centroids, spread)[:, :probes]
                groups = {}
                for i, cells in enumerate(near):
                    for c in cells:
                        groups.setdefault(int(c), []).append(i)
            self.parts[int(dim)] = (at, q, None if groups is None else {v: np.array(i) for v, i in groups.items()})

    def process(self, b: pa.RecordBatch, top: TopK, carried: pa.Table) -> None:
        flat, starts, lens = _lists(b.column(1))
        for dim, (at, q, groups) in self.parts.items():
            rows = np.flatnonzero(lens == dim)
            if not len(rows):
                continue
            x = _matrix(flat, starts, dim, rows)
            if groups is None:
                self._scan(x, rows, q, at, top, carried)
                continue
            if self.filtered:
                coded = pc.dictionary_encode(b.column(2).take(pa.array(rows)))
                code, values = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            else:
                code, values = nearest(x, self.centroids), range(len(self.centroids))
            for c, value in enumerate(values):
                if value in groups and len(mine := np.flatnonzero(code == c)):
                    some = groups[value]
                    self._scan(x[mine], rows[mine], q[some], at[some], top, carried)

    def _scan(self, x, rows, q, at, top, carried):
        """Rows ``x`` against queries ``q``, whose numbers are ``rows`` and ``at``."""
        factor = 1.0
        u, v = x, q
        if self.metric == "cosine":                         # squared distance of unit vectors is twice the cosine's
            with np.errstate(all="ignore"):
                u, v = (m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (x, q))
            ok = np.isfinite(v).all(axis=1)
            q, v, at = q[ok], v[ok], at[ok]
            ok = np.isfinite(u).all(axis=1)
            x, u, rows = x[ok], u[ok], rows[ok]
            factor = 2.0
        if not len(at) or not len(rows):
            return
        with np.errstate(all="ignore"):
            size = (u * u).sum(axis=1)
        odd = ~np.isfinite(size)
        if odd.any():                                       # infinite lengths: scored one by one
            r = np.flatnonzero(odd & ~np.isnan(u).any(axis=1))
            self._exact(x, rows, q, at, np.repeat(r, len(at)), np.tile(np.arange(len(at)), len(r)), top, carried)
            x, u, rows, size = x[~odd], u[~odd], rows[~odd], size[~odd]
        step = max(64, BLOCK_CELLS // len(at))
        if len(rows) > step:                                # rows near one pivot next to each other
            pivots = u[:: max(1, len(u) // PIVOTS)][:PIVOTS]
            far = _square(u, pivots)
            mine = far.argmin(axis=1)
            order = np.lexsort((far[np.arange(len(u)), mine], mine))
            x, u, rows, size = x[order], u[order], rows[order], size[order]
        q_size = (v * v).sum(axis=1)
        for s in range(0, len(rows), step):
            ub, sb = u[s:s + step], size[s:s + step]
            limit = top.kth[at] * factor
            slack = 16 * (ub.shape[1] + 8) * 2.0 ** -53 * (sb.max(initial=0) + q_size) + 1e-300
            alive = np.arange(len(at))
            if np.isfinite(limit).any():
                pivot = ub.mean(axis=0)
                r_far = np.sqrt(((ub - pivot) ** 2).sum(axis=1))
                q_far = np.sqrt(((v - pivot) ** 2).sum(axis=1))
                gap = np.maximum(0, np.maximum(q_far - r_far.max(), r_far.min() - q_far)) * (1 - 1e-9)
                alive = np.flatnonzero(~(gap * gap > limit + slack))
            self.seen += len(ub) * len(at)
            self.scored += len(ub) * len(alive)
            if not len(alive):
                continue
            near = sb[:, None] + q_size[alive][None] - 2.0 * (ub @ v[alive].T)
            limit = limit[alive]
            if not np.isfinite(limit).all() and len(ub) > top.k:
                limit = np.minimum(limit, np.partition(near, top.k - 1, axis=0)[top.k - 1])
            r, c = np.nonzero(near <= limit + 2 * slack[alive])
            self._exact(x[s:s + step], rows[s:s + step], q, at, r, alive[c], top, carried)

    def _exact(self, x, rows, q, at, r, c, top, carried):
        for s in range(0, len(r), 200_000):
            i, j = r[s:s + 200_000], c[s:s + 200_000]
            a, b = x[i], q[j]
            with np.errstate(all="ignore"):
                if self.metric == "l2sq":
                    diff = a - b
                    d = np.einsum("nd,nd->n", diff, diff)
                else:
                    d = 1.0 - np.einsum("nd,nd->n", a, b) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            ok = ~np.isnan(d)
            top.add(at[j[ok]], d[ok], carried.take(pa.array(rows[i[ok]])))


def _square(x, y):
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; -1 for rows without a distance."""
    with np.errstate(all="ignore"):
        far = _square(x, centroids)
    return np.where(np.isfinite(x).all(axis=1), np.nan_to_num(far, nan=np.inf).argmin(axis=1), -1)


def cell_order(q: np.ndarray, centroids: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Each query's cells by the mean squared distance of their members: the
    centroid's plus what is left of the members beyond it (their residuals)."""
    with np.errstate(all="ignore"):
        far = _square(q, centroids) + spread[None]
    return np.argsort(np.nan_to_num(far, nan=np.inf), axis=1, kind="stable")


class LexicalQueries:
    """Columns of the block: query id, terms, their counts, and the tag that a
    row's joined tags must contain (NULL: any). Score: 1 - dot / sqrt(|q|^2 |c|^2)
    with integer dot and norms."""

    def __init__(self, batch: pa.RecordBatch, tagged: bool = False):
        self.qids, self.n, self.tagged = batch.column(0), batch.num_rows, tagged
        terms, tfs = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lens = np.diff(terms.offsets.to_numpy())
        coded = pc.dictionary_encode(terms.flatten())
        self.vocab = coded.dictionary
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        query = np.repeat(np.arange(self.n), lens)
        self.by_query = (query, term, tfs)
        self.norm = np.bincount(query, weights=(tfs * tfs).astype(np.float64), minlength=self.n).astype(np.int64)
        order = np.lexsort((query, term))
        self.post_q, self.post_tf, self.post_term = query[order], tfs[order], term[order]
        if tagged:
            coded = pc.dictionary_encode(batch.column(3))
            self.tags = coded.dictionary.to_pylist()
            self.q_tag = coded.indices.fill_null(len(self.tags)).to_numpy(zero_copy_only=False)

    def process(self, whole: pa.RecordBatch, top: TopK, carried: pa.Table) -> None:
        """``whole``: id, tokens and, if tagged, joined tags."""
        lens = np.diff(whole.column(1).offsets.to_numpy())
        start = held = 0
        for i, n in enumerate(lens):
            if held and held + n > BLOCK_TOKENS:
                self._score(whole.slice(start, i - start), top, carried.slice(start, i - start))
                start, held = i, 0
            held += int(n)
        if whole.num_rows > start:
            self._score(whole.slice(start), top, carried.slice(start))

    def _score(self, b, top, carried):
        n, n_v = b.num_rows, max(1, len(self.vocab))
        flat = b.column(1).flatten()
        if not len(flat) or not len(self.vocab):
            return
        row_of = np.repeat(np.arange(n, dtype=np.int64), np.diff(b.column(1).offsets.to_numpy()))
        # squared term counts per row (the row's norm)
        coded = pc.dictionary_encode(flat)
        code, n_codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        keys, counts = np.unique(row_of * n_codes + code, return_counts=True)
        rows, code = keys // n_codes, keys % n_codes
        norm = np.bincount(rows, weights=counts.astype(np.float64) ** 2, minlength=n)
        # (row, term of the queries, count)
        known = pc.index_in(coded.dictionary, value_set=self.vocab).fill_null(-1).to_numpy(zero_copy_only=False)[code]
        hit = known >= 0
        if not hit.any():
            return
        rr, vv, cc = rows[hit], known[hit].astype(np.int64), counts[hit].astype(np.int64)
        post_q, post_tf, post_term = self.post_q, self.post_tf, self.post_term
        if np.isfinite(top.kth).any():
            # a query's best score here is at most that of every term at its greatest impact
            impact = np.zeros(n_v)
            np.maximum.at(impact, vv, cc / np.sqrt(norm[rr]))
            query, term, tf = self.by_query
            most = np.bincount(query, weights=tf * impact[term], minlength=self.n) / np.sqrt(np.maximum(self.norm, 1))
            alive = 1.0 - most <= top.kth + 1e-9
            if not alive.all():
                keep = alive[post_q]
                post_q, post_tf, post_term = post_q[keep], post_tf[keep], post_term[keep]
        ptr = np.searchsorted(post_term, np.arange(n_v + 1))
        allow = None
        if self.tagged:
            coded = pc.dictionary_encode(b.column(2))
            row_tag = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            allow = np.zeros((len(coded.dictionary) + 1, len(self.tags) + 1), bool)
            allow[:, -1] = True
            for t, tag in enumerate(self.tags):
                allow[:-1, t] = pc.match_substring(coded.dictionary, tag).to_numpy(zero_copy_only=False)
        fan = np.diff(ptr)[vv]
        # row blocks whose posting expansion stays bounded
        starts = np.r_[0, np.flatnonzero(np.diff(rr)) + 1, len(rr)]
        cum = np.r_[0, np.cumsum(fan)]
        lo = 0
        while lo < len(starts) - 1:
            hi = max(lo + 1, int(np.searchsorted(cum[starts], cum[starts[lo]] + BLOCK_PAIRS, "right")) - 1)
            a, z = starts[lo], starts[hi]
            f, total = fan[a:z], int(cum[z] - cum[a])
            lo = hi
            if not total:
                continue
            post = np.repeat(ptr[vv[a:z]], f) + np.arange(total) - np.repeat(np.cumsum(f) - f, f)
            pair = np.repeat(rr[a:z], f) * self.n + post_q[post]
            pair, inverse = np.unique(pair, return_inverse=True)
            dots = np.bincount(inverse, weights=(np.repeat(cc[a:z], f) * post_tf[post]).astype(np.float64))
            prow, pq = pair // self.n, pair % self.n
            dist = 1.0 - dots / np.sqrt(self.norm[pq].astype(np.float64) * norm[prow])
            ok = dist <= top.kth[pq]
            if allow is not None:
                ok &= allow[row_tag[prow], self.q_tag[pq]]
            prow, pq, dist = prow[ok], pq[ok], dist[ok]
            keep, _ = best(pq, dist, carried.column(0).take(pa.array(prow)), top.k, top.distinct)
            top.add(pq[keep], dist[keep], carried.take(pa.array(prow[keep])))


# -- tasks ------------------------------------------------------------------

def pack(names=("part", "n", "data")):
    """Rows of a partition -> blocks of bounded size, each an Arrow stream."""
    def run(batches):
        for batch in batches:
            step = max(1, min(PACK_ROWS, PACK_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes)))
            for s in range(0, batch.num_rows, step):
                out = pa.BufferOutputStream()
                some = pa.Table.from_batches([batch.slice(s, step)]).combine_chunks()
                with pa.ipc.new_stream(out, some.schema) as w:
                    w.write_table(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(some)], pa.int64()),
                    pa.array([out.getvalue().to_pybytes()], pa.binary())], names=list(names))
    return run


def _batch(data) -> pa.RecordBatch:
    """A packed block's rows as one batch."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if len(table) else pa.RecordBatch.from_pylist([], schema=table.schema)


def _results(queries, top: TopK, schema: pa.Schema):
    top.settle()
    for s in range(0, len(top.q), 4096):
        some = top.rows.slice(s, 4096).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [queries.qids.take(pa.array(top.q[s:s + 4096])), some.column(0).combine_chunks(), pa.array(top.dist[s:s + 4096]),
             *(c.combine_chunks() for c in some.columns[1:])], schema=schema)


def _carried(b: pa.RecordBatch, schema: pa.Schema) -> pa.Table:
    """Id and payload of a batch."""
    names = [schema.names[1], *schema.names[3:]]
    return pa.Table.from_arrays([b.column(b.schema.get_field_index(n)) for n in names],
                                schema=pa.schema([schema.field(n) for n in names]))


def broadcast_search(blocks, prepare, k: int, schema: pa.Schema, distinct: bool = False):
    """Corpus batches against every broadcast query block; one k best per partition."""
    def run(batches):
        asked = [prepare(_batch(data)) for data in blocks.value]
        carried = pa.schema([schema.field(1), *(schema.field(i) for i in range(3, len(schema)))])
        tops = [TopK(k, q.n, carried, distinct) for q in asked]
        for b in batches:
            if b.num_rows:
                rows = _carried(b, schema)
                for q, top in zip(asked, tops):
                    q.process(b, top, rows)
        for q, top in zip(asked, tops):
            yield from _results(q, top, schema)
    return run


def cell_search(prepare, k: int, schema: pa.Schema, distinct: bool = False):
    """Rows of (query block, corpus block); one k best per cell."""
    def run(batches):
        carried = pa.schema([schema.field(1), *(schema.field(i) for i in range(3, len(schema)))])
        for cells in batches:
            for asked, data in zip(cells.column(0), cells.column(1)):
                q, b = prepare(_batch(asked.as_buffer())), _batch(data.as_buffer())
                top = TopK(k, q.n, carried, distinct)
                if b.num_rows:
                    q.process(b, top, _carried(b, schema))
                yield from _results(q, top, schema)
    return run
