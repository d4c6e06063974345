"""Hard negatives by branch and bound in ball trees.

Vectors become integers floor(256 * x); rows are dealt by a hash into parts of about `PART_ROWS`. Each part has ball trees: one
for each label with at least `LEAF` rows there, and one for all rarer labels. A node knows its centre and radius, so an inner
product with any of its rows lies within |query| * radius of that with the centre. Anchors pass a part's trees in
blocks. A block goes down from the root with the anchors that are still open there; an anchor leaves at a node whose bounds lie outside
its window of scores, or strictly beneath the k-th best score it has. Before that each anchor has gone straight down to
one promising leaf, which gives it a first k-th score. Leaves are scored exactly, ties go to the smaller id.

There are two such searches: for each anchor its best rows of the same label (the positives), then for each anchor and positive the
best rows of other labels with low * positive <= score <= high * positive. Results of the parts are merged by rank.

Defined results. Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part. Shorter
vectors count as padded with zeros. An anchor's own row isn't its positive; other rows of its id are, and each row of a repeated id
is an anchor of its own. A positive score below zero has an empty window. Vectors with components too large for exact
doubles are scored with whole numbers; scores beyond a long are cut to its ends, behind the ranking. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import durable
from tessella.llm.vectors import SCALE, cut, falling, matrix, padded, part_runs, past_parts, product, small_rows, sound_vectors, whole

PART_ROWS = 16_384
LEAF = 128
#: Anchors that go down the trees together.
BLOCK = 2_048
#: Window of the negatives' scores, in hundredths of the positive's.
LOW, HIGH = 50, 95


class BallTree:
    """Nested balls around rows, halved along the line between two distant rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, labels: np.ndarray) -> None:
        order = np.arange(len(rows))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        self._grow(rows, order, 0, len(rows), centres, radii)
        self.rows, self.ids, self.numbers, self.labels = rows[order], ids[order], numbers[order], labels[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def _grow(self, rows: np.ndarray, order: np.ndarray, a: int, b: int, centres: list, radii: list) -> int:
        node, own = len(self.spans), rows[order[a:b]]
        centre = own.mean(axis=0)
        far = np.linalg.norm(own - centre, axis=1)
        self.spans.append((a, b)), self.children.append(None), centres.append(centre), radii.append(float(far.max()))
        if b - a > LEAF:
            one = own[far.argmax()]
            other = own[np.linalg.norm(own - one, axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - one), half)]
            self.children[node] = self._grow(rows, order, a, a + half, centres, radii), self._grow(rows, order, a + half, b, centres, radii)
        return node


class Asks:
    """Open searches of one block: for each a query, a window of scores, and the k best rows so far."""

    def __init__(self, queries: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, labels: np.ndarray, numbers: np.ndarray, same: bool) -> None:
        self.queries, self.query, self.low, self.high, self.k, self.same = queries, query, low, high, k, same
        self.labels, self.numbers = labels, numbers  # of each query
        self.norms = np.linalg.norm(queries, axis=1)
        self.scores = np.full((len(query), k), -np.inf)
        self.ids = np.zeros((len(query), k), np.int64)
        self.rows = np.zeros((len(query), k), np.int64)
        #: Scores computed, to tell what bounds save.
        self.scored = 0

    def _bounds(self, tree: BallTree, nodes: np.ndarray | int, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most that a row of the node can score, with room for rounding."""
        own, norms = self.queries[self.query[asks]], self.norms[self.query[asks]]
        centres = tree.centres[nodes]
        middle = own @ centres if centres.ndim == 1 else np.einsum("ij,ij->i", own, centres)
        reach = norms * tree.radii[nodes] * (1 + 1e-9) + 1e-9 * norms * np.linalg.norm(centres, axis=-1) + 1e-6
        return middle - reach, middle + reach

    def _score(self, tree: BallTree, node: int, asks: np.ndarray) -> None:
        a, b = tree.spans[node]
        used, place = np.unique(self.query[asks], return_inverse=True)
        scores = (self.queries[used] @ tree.rows[a:b].T)[place]
        self.scored += scores.size
        own = self.query[asks]
        fits = (scores >= np.maximum(self.low[asks], self.scores[asks, -1])[:, None]) & (scores <= self.high[asks][:, None])
        fits &= (self.labels[own][:, None] == tree.labels[a:b][None, :]) == self.same
        fits &= self.numbers[own][:, None] != tree.numbers[a:b][None, :]
        which, row = np.nonzero(fits)
        if not len(which):
            return
        # The rows found join the best so far; the first k of each ask stay.
        touched = np.unique(which)
        at = np.concatenate([which, np.repeat(touched, self.k)])
        score = np.concatenate([scores[which, row], self.scores[asks[touched]].ravel()])
        ids = np.concatenate([tree.ids[a:b][row], self.ids[asks[touched]].ravel()])
        numbers = np.concatenate([tree.numbers[a:b][row], self.rows[asks[touched]].ravel()])
        order = np.lexsort((numbers, ids, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        order, into = order[rank < self.k], (asks[at[rank < self.k]], rank[rank < self.k])
        self.scores[into], self.ids[into], self.rows[into] = score[order], ids[order], numbers[order]

    def search(self, tree: BallTree, asks: np.ndarray) -> None:
        # Straight down to one leaf each, for a first k-th score.
        at = np.zeros(len(asks), np.int64)
        while (inner := np.flatnonzero([tree.children[n] is not None for n in at.tolist()])).size:
            pairs = np.array([tree.children[n] for n in at[inner].tolist()])
            one, other = (self._bounds(tree, pairs[:, side], asks[inner])[1] for side in (0, 1))
            at[inner] = np.where(one >= other, pairs[:, 0], pairs[:, 1])
        for leaf in np.unique(at).tolist():
            self._score(tree, leaf, asks[at == leaf])
        # Then all that the bounds leave open.
        stack = [(0, np.arange(len(asks)))]
        while stack:
            node, open_ = stack.pop()
            least, most = self._bounds(tree, node, asks[open_])
            keep = (most >= np.maximum(self.low[asks[open_]], self.scores[asks[open_], -1])) & (least <= self.high[asks[open_]])
            open_, most = open_[keep], most[keep]
            if not len(open_):
                continue
            pair = tree.children[node]
            if pair is None:
                open_ = open_[at[open_] != node]
                if len(open_):
                    self._score(tree, node, asks[open_])
            else:
                upper = [self._bounds(tree, child, asks[open_])[1].mean() for child in pair]
                stack += [(child, open_) for _, child in sorted(zip(upper, pair, strict=True))]  # the better one is taken first


class Forest:
    """The ball trees of one part; rows with large components stand beside them."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        self.ids, self.numbers = table.column("vec_id").to_numpy(), table.column("number").to_numpy()
        names = table.column("label").to_pylist()
        rows = matrix(table.column("vector").combine_chunks())
        small = small_rows(rows)
        self.plain = SCALE * rows[small]
        np.floor(self.plain, out=self.plain)
        self.code = {label: c for c, label in enumerate(sorted(set(names)))}
        labels = np.array([self.code[x] for x in names], np.int64)
        self.names, self.small, self.width = names, np.flatnonzero(small), rows.shape[1]
        self.large = [(int(i), whole(rows[i])) for i in np.flatnonzero(~small).tolist()]
        ids, numbers, labels = self.ids[small], self.numbers[small], labels[small]
        counts = np.bincount(labels, minlength=len(self.code)) if len(labels) else np.zeros(0, np.int64)
        rare = counts[labels] < LEAF
        groups = [(-1, np.flatnonzero(rare))] + [(c, np.flatnonzero(labels == c)) for c in np.flatnonzero(counts >= LEAF).tolist()]
        self.trees = [(c, BallTree(self.plain[g], ids[g], numbers[g], labels[g])) for c, g in groups if len(g)]

    def _beside(self, query: np.ndarray, label: str, number: int, same: bool, is_small: bool) -> Iterator[tuple[int, int, int]]:
        """(score, id, number) of the rows that trees don't hold, or of all if the query itself has large components."""
        rest = self.large if is_small else [*self.large, *((int(i), whole(v / SCALE)) for i, v in zip(self.small, self.plain, strict=True))]
        if rest:
            own = whole(query)
            for i, other in rest:
                if (self.names[i] == label) == same and self.numbers[i] != number:
                    yield product(own, other), int(self.ids[i]), int(self.numbers[i])

    def best(self, block: pa.RecordBatch, k: int, windows: list[list[tuple[int, int]]] | None) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(query, window, [(score, id, number)]) in the block; without windows, of the same label, else of others."""
        rows, same = matrix(block.column("vector")), windows is None
        small = small_rows(rows)
        labels, numbers = block.column("label").to_pylist(), block.column("number").to_numpy()
        spans = [[(-(2**62), 2**62)]] * len(rows) if windows is None else windows
        pairs = [(q, w) for q in range(len(rows)) for w in range(len(spans[q]))]
        query = np.array([q for q, _ in pairs], np.int64)
        low, high = (np.array([float(max(-(2**62), min(2**62, spans[q][w][e]))) for q, w in pairs]) for e in (0, 1))
        self.width = max(self.width, rows.shape[1])
        codes = np.array([self.code.get(x, -1) for x in labels], np.int64)
        asks = Asks(padded(np.floor(SCALE * np.where(small[:, None], rows, 0)), self.width), query, low, high, k, codes, numbers, same)
        fit = small[query]
        for code, tree in self.trees:
            tree.rows, tree.centres = padded(tree.rows, self.width), padded(tree.centres, self.width)
            open_ = np.flatnonzero(fit & ((code < 0) | ((codes[query] == code) == same)))
            if len(open_):
                asks.search(tree, open_)
        for p, (q, w) in enumerate(pairs):
            found = [(int(s), int(i), int(n)) for s, i, n in zip(asks.scores[p], asks.ids[p], asks.rows[p], strict=True) if s > -np.inf]
            if self.large or not small[q]:
                a, b = spans[q][w] if windows is not None else (None, None)
                found += [f for f in self._beside(rows[q], labels[q], int(numbers[q]), same, bool(small[q])) if a is None or a <= f[0] <= b]
                found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:k]
            yield q, w, found


def _searched(k: int, low: int, high: int, windowed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None
        for part, asked, rows in part_runs(batches):
            if part != now:
                now, held, forest = part, [], None
            if not asked:
                held.append(rows)
                continue
            if not held:
                continue  # a part without candidates
            forest = forest or Forest(held)
            for start in range(0, rows.num_rows, BLOCK):
                block = rows.slice(start, BLOCK)
                windows = None
                if windowed:  # low * positive <= 100 * score <= high * positive, in whole numbers
                    positives = [[int(x) for x in own] for own in block.column("positives").to_pylist()]
                    windows = [[(-(-low * p // 100), high * p // 100) for p in own] for own in positives]
                number = block.column("number").to_pylist()
                out = [(number[q], w, i, n, cut(s), str(s)) for q, w, found in forest.best(block, k, windows) for s, i, n in found]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                names = ["anchor", "nth", "vec_id", "number", "score", "exact"]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=names)

    return run


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are rows whose vec_id is divisible by `every`."""
    if positives < 1 or negatives < 1 or every < 1:
        raise ValueError("positives, negatives and every are at least 1")
    rows = sound_vectors(vectors.where(F.col("label").isNotNull()), F.col("label").cast("string").alias("label"))
    anchors = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-rows.count() // PART_ROWS))
    schema = "anchor long, nth int, vec_id long, number long, score long, exact string"
    ranked = lambda found, keys: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*falling(), "vec_id", "number")))
    same = past_parts(rows, anchors, parts, _searched(positives, low, high, windowed=False), schema)
    best = ranked(same, ["anchor"]).where(F.col("rank") <= positives).select("anchor", "rank", "vec_id", "score", "exact")
    of_anchor = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "exact"))).alias("own"))  # at most `positives`
    joined = anchors.join(of_anchor, anchors["number"] == of_anchor["anchor"])
    asking = durable(joined.select("vec_id", "vector", "number", "label", F.col("own.exact").alias("positives"), F.transform("own", lambda p: F.struct(p.vec_id.alias("vec_id"), p.score.alias("score"))).alias("own")))
    other = past_parts(rows, asking.drop("own"), parts, _searched(negatives, low, high, windowed=True), schema)
    chosen = ranked(other, ["anchor", "nth"]).where(F.col("rank") <= negatives).select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = asking.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("own").alias("nth", "positive"))
    return chosen.join(known, ["anchor", "nth"]).select("anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", "negative_id", F.col("positive.score").alias("positive_score"), "negative_score")


def moved_labels(vectors: DataFrame) -> DataFrame:
    """The rows, of whose labels those of vec_ids divisible by 7 move on to the next of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def negatives_sql(positives: int = 5, negatives: int = 3, every: int = 50, low: int = LOW, high: int = HIGH) -> str:
    """DuckDB SQL for `hard_negatives` over `moved_labels`, on vectors of one length."""
    return f"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS number, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.number AS anchor, c.vec_id, c.number, a.label = c.label AS same, CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score
  FROM v a JOIN v c ON a.number <> c.number WHERE a.vec_id % {every} = 0),
positive AS (
  SELECT anchor_id, anchor, vec_id AS positive_id, number AS positive, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, number) <= {positives})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id, s.number) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND {low} * p.positive_score <= 100 * s.score AND 100 * s.score <= {high} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id, s.number) <= {negatives}"""
