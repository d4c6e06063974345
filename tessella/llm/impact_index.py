"""Exact top-k by inner product with an impact-ordered index, processed score at a time.

Vectors become integers floor(`SCALE` * x). They are dealt by a hash of the row into partitions of about
`PART_ROWS` vectors; each partition is an index of its own: for every dimension, postings in segments of
equal quantised value, `LEVELS` levels between the dimension's smallest and largest. A segment's impact on a query is the
most that it can move a score away from that of the dimensions' medians, up or down. Segments of all dimensions are
processed by descending impact into accumulators: the most and least that a vector's seen components add, and their number.
At each check the segments still ahead bound what a vector's unseen components can add; processing stops only
when that proves that at most `FEW` times k vectors can be among the best k, or when all segments are done. Possible members are
rescored exactly, and the best k of the partitions are merged.

Queries are every row whose id is divisible by `every`. A partition's index is built once and all queries stream past it, so a
task holds one partition and one batch of queries, whatever the table's size.

Defined results. Vectors that are null, empty, or hold null or non-finite components take no part, as query
or candidate. Shorter vectors count as padded with zeros. A query's own row isn't its candidate; other rows of its id are, and
each row of a repeated id is a query of its own. Fewer than k candidates: all. Ties go to the smaller id. Null ids take no part.
Vectors with components too large for exact doubles aren't indexed but scored with whole numbers; scores beyond a long are
cut to its ends, behind the ranking. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.vectors import SCALE, cut, falling, matrix, padded, part_runs, past_parts, product, small_rows, sound_vectors, whole

PART_ROWS = 16_384
LEVELS = 64
#: Possible members are few if there are at most so many for each of the k.
FEW = 16
#: The bound is checked after these shares of all postings.
CHECKS = (0.25, 0.5, 0.75, 0.875, 0.9375, 1.0)


class ImpactIndex:
    """Postings of integer vectors (rows of doubles), by dimension and level."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n, dims = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.step = np.maximum(1, np.ceil((high - low + 1) / LEVELS))
        level = ((vectors - low) // self.step).astype(np.int64)
        self.sizes = np.stack([np.bincount(level[:, d], minlength=LEVELS) for d in range(dims)])  # by dimension and level
        self.rows = np.concatenate([np.argsort(level[:, d], kind="stable") for d in range(dims)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes.ravel())])
        self.middle = np.floor(np.median(vectors, axis=0))
        self.least = low[:, None] + np.arange(LEVELS)[None, :] * self.step[:, None] - self.middle[:, None]  # smallest deviation of each level
        self.used = np.flatnonzero(self.sizes.ravel())
        #: What the queries so far took: postings processed and rows rescored.
        self.processed = self.rescored = 0

    def _postings(self, segments: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
        """Sums of each weight over the rows of segments (dimension * LEVELS + level, rising)."""
        jumps = np.flatnonzero(np.diff(segments) != 1) + 1
        spans = zip(segments[np.concatenate([[0], jumps])].tolist(), segments[np.concatenate([jumps - 1, [len(segments) - 1]])].tolist(), strict=True)
        rows = np.concatenate([self.rows[self.starts[a] : self.starts[b + 1]] for a, b in spans])
        sizes = self.sizes.ravel()[segments]
        self.processed += len(rows)
        return [np.bincount(rows, np.repeat(w[segments], sizes), len(self.vectors)) for w in weights]

    def best(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best, the k best among them for certain."""
        n, dims = self.vectors.shape
        if n <= k:
            self.rescored += n
            return np.arange(n)
        ends = query[:, None] * self.least, query[:, None] * (self.least + self.step[:, None] - 1)
        most, width = np.maximum(*ends), np.abs(query) * (self.step - 1)  # a level adds at most `most`, at least `width` less
        least = most - width[:, None]
        impact = np.maximum(most, -least).ravel()
        order = self.used[np.argsort(-impact[self.used], kind="stable")]
        upto = np.cumsum(self.sizes.ravel()[order])
        # Three sums over seen components: most, width and number. Whole numbers; where they fit, one double holds all three.
        spread = np.repeat(width, LEVELS)
        for_number, for_width = 1 << dims.bit_length(), 1 << int(width.sum()).bit_length()
        packed = np.abs(most).max(axis=1).sum() * for_number * for_width < 2**52
        weights = [(most.ravel() * for_width + spread) * for_number + 1] if packed else [most.ravel(), spread, np.ones(dims * LEVELS)]
        sums = [np.zeros(n) for _ in weights]
        ahead = np.zeros(dims * LEVELS, bool)
        ahead[order] = True
        start = 0
        for share in CHECKS:
            stop = int(np.searchsorted(upto, share * n * dims, side="right"))
            if stop <= start:
                continue
            for total, more in zip(sums, self._postings(np.sort(order[start:stop]), weights), strict=True):
                total += more
            ahead[order[start:stop]] = False
            if packed:
                rest = np.floor(sums[0] / for_number)
                seen_most = np.floor(rest / for_width)
                seen_width, seen = rest - seen_most * for_width, sums[0] - rest * for_number
            else:
                seen_most, seen_width, seen = sums
            # Unseen components add at most the largest of the dimensions' bounds ahead, as many as are unseen.
            open_ = ahead.reshape(dims, LEVELS)
            up, down = np.where(open_, np.maximum(most, 0), 0).max(axis=1), np.where(open_, np.minimum(least, 0), 0).min(axis=1)
            unseen = dims - seen.astype(np.int64)
            above = seen_most + np.concatenate([[0], np.cumsum(np.sort(up)[::-1])])[unseen]
            below = seen_most - seen_width + np.concatenate([[0], np.cumsum(np.sort(down))])[unseen]
            found = np.flatnonzero(above >= np.partition(below, n - k)[n - k])
            if len(found) <= FEW * k:
                break
            start = stop
        self.rescored += len(found)
        return found


class Part:
    """The rows of one part: those of small components in an index, others beside it."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        self.ids, self.numbers = table.column("vec_id").to_numpy(), table.column("number").to_numpy()
        self.rows = matrix(table.column("vector").combine_chunks())
        small = small_rows(self.rows)
        self.plain = np.flatnonzero(small)
        self.huge = [(i, whole(self.rows[i])) for i in np.flatnonzero(~small).tolist()]
        self._index()

    def _index(self) -> None:
        self.index = ImpactIndex(np.floor(SCALE * self.rows[self.plain])) if len(self.plain) else None

    def best(self, query: np.ndarray, number: int, k: int, small: bool) -> list[tuple[int, int, int]]:
        """(falling score, id, number) of the k best rows but the query's own."""
        found: list[tuple[int, int, int]] = []
        if len(query) > self.rows.shape[1]:
            self.rows = padded(self.rows, len(query))
            self._index()
        if self.index is not None and small:
            asked = np.zeros(self.rows.shape[1])
            asked[: len(query)] = np.floor(SCALE * query)
            rows = self.index.best(asked, k + 1)  # one may be the query itself
            rows = rows[self.numbers[self.plain[rows]] != number]
            scores = self.index.vectors[rows] @ asked
            order = np.lexsort((self.numbers[self.plain[rows]], self.ids[self.plain[rows]], -scores))[:k]
            found = [(-int(scores[i]), int(self.ids[self.plain[rows[i]]]), int(self.numbers[self.plain[rows[i]]])) for i in order.tolist()]
        rest = self.huge if small else [*self.huge, *((i, whole(self.rows[i])) for i in self.plain.tolist())]
        if rest:
            asked = whole(query)
            found += [(-product(asked, v), int(self.ids[i]), int(self.numbers[i])) for i, v in rest if self.numbers[i] != number]
        return sorted(found)[:k]


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own = None, [], None
        for part, asked, rows in part_runs(batches):
            if part != now:
                now, held, own = part, [], None
            if not asked:
                held.append(rows)
                continue
            if not held:
                continue  # a part without candidates
            own = own or Part(held)
            queries = matrix(rows.column("vector"))
            small = small_rows(queries)
            out = []
            for q, (i, number) in enumerate(zip(rows.column("vec_id").to_pylist(), rows.column("number").to_pylist(), strict=True)):
                out += [(i, number, v, n, cut(-less), str(-less)) for less, v, n in own.best(queries[q], number, k, bool(small[q]))]
            names = ["query_id", "query_number", "vec_id", "number", "score", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.string() if c == 5 else pa.int64()) for c in range(6)], names=names)

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query."""
    rows = sound_vectors(vectors)
    parts = max(1, -(-rows.count() // PART_ROWS))
    schema = "query_id long, query_number long, vec_id long, number long, score long, exact string"
    found = past_parts(rows, rows.where(F.col("vec_id") % every == 0), parts, _searched(k), schema)
    best = Window.partitionBy("query_number").orderBy(*falling(), "vec_id", "number")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL for `exact_top_k` on vectors of one length."""
    return f"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS number, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.number AS query_number, c.vec_id, c.number, CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.number <> c.number WHERE q.vec_id % {every} = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_number ORDER BY score DESC, vec_id, number) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
