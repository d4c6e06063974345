"""What searches over vectors share: sound rows, parts that queries stream past, and exact scores of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable

#: Components become floor(SCALE * x).
SCALE = 256
LONG = 2**63


def sound_vectors(vectors: DataFrame, *also: Column) -> DataFrame:
    """vec_id, vector (doubles), a number of the row's own and further columns, of rows with an id and a vector of finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return durable(vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"), F.monotonically_increasing_id().alias("number"), *also))


def part_of(parts: int) -> Column:
    """The part that a hash of the row's number deals it to."""
    return F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias("part")


def past_parts(candidates: DataFrame, queries: DataFrame, parts: int, search, schema: str) -> DataFrame:
    """`search` over the rows of each part, its candidates first and then all queries, in batches of one (part, is_query).

    A task holds the candidates of one part and one batch of queries; the sort in front of it spills.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = queries.select("*", every, F.lit(True).alias("is_query"))
    held = candidates.withColumns({"part": part_of(parts), "is_query": F.lit(False)})
    return held.unionByName(asked, allowMissingColumns=True).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_query").mapInArrow(search, schema)


def part_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(part, is_query, rows) for each run of a batch's rows that agree in both."""
    for batch in batches:
        part, asked = batch.column("part").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(part) | (asked[1:] != asked[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
            if b > a:
                yield int(part[a]), bool(asked[a]), batch.slice(a, b - a)


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of doubles; shorter vectors are padded with zeros."""
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def small_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of components whose products sum up exactly in doubles, at a width of up to the rows' own or 4,096."""
    return (np.abs(rows) < (2.0**52 / max(rows.shape[1], 4096)) ** 0.5 / SCALE).all(axis=1)


def whole(vector: np.ndarray) -> list[int]:
    """The integers of a vector, exact at any size."""
    return [int(np.floor(SCALE * x)) if abs(x) < 2.0**40 else SCALE * int(x) for x in vector.tolist()]


def product(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b, strict=False))  # what the shorter lacks is zero


def cut(score: int) -> int:
    """The score, cut to the ends of a long."""
    return max(-LONG, min(LONG - 1, score))


def falling(score: str = "score", exact: str = "exact") -> list[Column]:
    """Order by falling score; scores cut to a long's ends are told apart by their digits, of which more, or later ones, are larger beyond zero."""
    ends = F.col(score).isin(LONG - 1, -LONG)
    size = F.when(ends, F.when(F.col(score) > 0, 1).otherwise(-1) * F.length(exact)).otherwise(F.lit(0))
    return [F.desc(score), size.desc(), F.when(F.col(score) == LONG - 1, F.col(exact)).otherwise("").desc(), F.when(F.col(score) == -LONG, F.col(exact)).otherwise("").asc()]
