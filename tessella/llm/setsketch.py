"""MinHash near-duplicates by SetSketch registers: band, estimate jointly by likelihood, then verify.

A document is the set of its distinct `width`-word shingles (A-Z lowered, words between ASCII white
space). Documents are linked when their exact Jaccard similarity is at least `similarity`; a group is a
connected component of links and keeps its smallest id.

Registers: for each of `REGISTERS` hash functions the smallest exponential variate over the set,
on a logarithmic scale (base `BASE`) and truncated to 16 bits, so that sketches of parts merge by
maximum. Documents that agree in all registers of a band are candidates. At a similarity of 0.8 a pair is
missed with probability (1 - 0.8**4)**20 < 3e-5. A pair goes on to the exact check unless the joint
maximum-likelihood estimate of its similarity lies `DEVIATIONS` standard deviations below the threshold.

Within a bucket no pairs are emitted: members are joined with one hub, its smallest node, and verified links make
components. In a bucket whose members aren't one component yet, the members outside its largest component are compared
with all its members in blocks of about `BLOCK_BYTES`, each pair of blocks in a group of its own; a pair of documents that
share several buckets is compared in that of their first band only, and of buckets with the same members only the first is
looked at. Inside a pair of blocks only documents that share one of their rarest shingles meet (a prefix filter, exact for the
threshold), so a family of texts that share a template but differ elsewhere costs little more than reading it. A pair of blocks gives out a spanning forest of its verified links. So every candidate is decided,
whatever a bucket's size, in bounded memory, and buckets that merely overlap are never compared as a whole.

Nodes are distinct shingle sets by a 128-bit hash, so exact copies are one node and rows of one id with different texts are
different nodes. Texts are not shuffled while the nodes that share a bucket are few enough to broadcast.

Defined results. Null or blank text: empty set, linked with nothing. Fewer words than `width`: one shingle
of the whole sequence. Repeated rows: one output row each, in one class. Rows without an id link nothing and
are kept, with a null component. Empty table: no rows. Extra columns are ignored by `near_duplicates`
and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import durable, fresh, shingle_sets, text_slices
from tessella.llm.components import connected_components

REGISTERS = 128
BANDS, ROWS = 20, 4
BASE, RATE, TOP = 1.02, 20.0, 65535
#: Bytes of sets and sketches that are compared with as many others at a time.
BLOCK_BYTES = 8 << 20
#: What a compared row counts besides its set.
ROW_BYTES = 2 * REGISTERS + 1024
#: Ids up to this number (some 40 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 50_000
#: Standard deviations below the threshold at which an estimate still leads to the exact check.
DEVIATIONS = 5

_SEEDS = np.random.default_rng(7)
_XOR = _SEEDS.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_MUL = (_SEEDS.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(len(_MUL), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        x = low[None, at : at + 4096] ^ _XOR
        x *= _MUL
        np.minimum(least, x.min(axis=1), out=least)
    arrival = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(arrival) / np.log(BASE)) + 1000, 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from set sizes and the numbers of larger and smaller registers."""
    m = len(_MUL)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0, 1, 101)[:, None] * np.minimum(u / v, v / u)[None, :]
    tail = lambda x: -np.log(np.maximum(1 - np.maximum(x, 0) * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    more, less = tail(u - v * grid), tail(v - u * grid)
    log = lambda p: np.log(np.maximum(p, 1e-12))
    likelihood = above * log(more) + below * log(less) + (m - above - below) * log(1 - more - less)
    return np.take_along_axis(grid, likelihood.argmax(axis=0)[None, :], 0)[0]


def node_of(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sizes, nodes, sketches = [], [], []
                for shingles in shingle_sets(part.column("text"), width):
                    sizes.append(len(shingles))
                    nodes.append(node_of(shingles) if len(shingles) else None)
                    sketches.append(registers(shingles).tobytes() if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "version", "n_shingles", "node", "sketch"]
                )

    return run


def _sets(width: int):
    """The sets of the texts of given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = [(node_of(s), s.tobytes()) for s in shingle_sets(part.column("text"), width)]
                same = pa.array([a == b for (a, _), b in zip(found, part.column("node").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([m for _, m in found], pa.binary())], names=["node", "members"]).filter(same)

    return run


def _likely(least: float):
    """Keep pairs whose similarity by likelihood isn't far below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x, np.uint16) for x in batch.column(c).to_pylist()]) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            estimate = joint_estimate(n_a, n_b, (a > b).sum(axis=1), (a < b).sum(axis=1))
            yield batch.select(["a", "b"]).filter(pa.array(estimate >= least))

    return run


def _is_linked(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """100 * intersection >= share * union. Shared members of sorted sets repeat in their merged order."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= share * (len(both) - shared)


def _verified(share: int):
    """Keep pairs that are linked on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            kept = [_is_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def prefixes(sets: list[np.ndarray], share: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, shingle's number) of each set's rarest shingles; sets that are similar enough share one of them.

    Two sets of similarity t share at least t * n elements of either, so the rarest n - ceil(t * n) + 1 of both, in any one order, meet.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((number, counts[number], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = order[place < np.repeat(sizes - -(-share * sizes // 100) + 1, sizes)]
    return owner[order], number[order]


def _forest(share: int, least: float):
    """Verified links between the minor members of a block and all members of another, as far as they join components.

    Only members that share a rare shingle meet (see `prefixes`). Pairs that share a band before the bucket's own are left to that one.
    """

    def run(group: pa.Table) -> pa.Table:
        is_minor = group.column("is_minor").to_numpy(zero_copy_only=False)
        ids, parts = group.column("node").to_pylist(), group.column("part").to_pylist()
        number: dict[bytes, int] = {}
        parts = np.array([number.setdefault(p, len(number)) for p in parts])
        sizes = group.column("n_shingles").to_numpy().astype(np.float64)
        sketches = np.stack([np.frombuffer(x, np.uint16) for x in group.column("sketch").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
        band = int(group.column("band")[0].as_py())
        bands = sketches[:, : band * ROWS].copy().view(np.uint64).reshape(len(ids), band)  # a band's four registers are one number
        root = list(range(len(number)))

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        found = []
        owner, number_of = prefixes(sets, share)
        ahead = np.flatnonzero(~is_minor[owner])
        ahead = ahead[np.argsort(number_of[ahead], kind="stable")]  # postings of the members that aren't minor, by shingle
        listed = number_of[ahead]
        upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        for i in np.flatnonzero(is_minor).tolist():
            own = number_of[upto[i] : upto[i + 1]]
            spans = zip(np.searchsorted(listed, own).tolist(), np.searchsorted(listed, own, side="right").tolist(), strict=True)
            j = np.unique(np.concatenate([owner[ahead[a:b]] for a, b in spans]))
            j = j[(parts[j] != parts[i]) & (100 * np.minimum(sizes[j], sizes[i]) >= share * np.maximum(sizes[j], sizes[i]))]
            j = j[~(bands[j] == bands[i]).any(axis=1)]
            if not len(j):
                continue
            above, below = (sketches[i] > sketches[j]).sum(axis=1), (sketches[i] < sketches[j]).sum(axis=1)
            near = above + below <= (1 - least) * sketches.shape[1] + 8  # what the estimate can't put above `least` anyway
            j, above, below = j[near], above[near], below[near]
            estimate = joint_estimate(np.full(len(j), sizes[i]), sizes[j], above, below) if len(j) else np.zeros(0)
            for k in j[np.argsort(-estimate, kind="stable")][: int((estimate >= least).sum())].tolist():
                p, q = find(int(parts[i])), find(int(parts[k]))
                if p != q and _is_linked(sets[i], sets[k], share):
                    root[p] = q
                    found.append((ids[i], ids[k]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return run


def _open_buckets(members: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (key, band, node, part, n_shingles, sketch, minor) of the buckets with several components, and their numbers of blocks."""
    sized = members.join(parts, "node", "left").join(nodes.select("node", "n_shingles"), "node")
    placed = durable(sized.select("key", "band", "node", F.coalesce("part", "node").alias("part"), (ROW_BYTES + 8 * F.col("n_shingles")).alias("bytes")))
    by_part = placed.groupBy("key", "part").agg(F.first("band").alias("band"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("names"))
    buckets = by_part.groupBy("key").agg(
        F.first("band").alias("band"), F.max(F.struct("bytes", "part")).alias("most"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.sum("names").alias("names"), F.count("*").alias("parts")
    )
    buckets = buckets.where("parts > 1").groupBy("n", "names", "bytes").agg(F.min(F.struct("band", "key", "most")).alias("first"))  # the same members: the first band's
    buckets = buckets.select(
        "first.key", F.col("first.most.part").alias("most"), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("all_blocks"), F.ceil((F.col("bytes") - F.col("first.most.bytes")) / BLOCK_BYTES).cast("int").alias("minor_blocks")
    )
    return placed.join(durable(buckets), "key").select("key", "band", "node", "part", (F.col("part") != F.col("most")).alias("minor"), "all_blocks", "minor_blocks")


def _grouped(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles, node and its component's smallest (component_id, component_version) for each row.

    Rows without a node (no words or no id) have no component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    sketched = durable(docs.mapInArrow(_sketches(width), "doc_id long, version long, n_shingles long, node binary, sketch binary"))
    share = round(similarity * 100)
    least = similarity - DEVIATIONS * (similarity * (1 - similarity) / REGISTERS) ** 0.5

    # Exact copies are one node, with the smallest id.
    low = durable(sketched.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("low")))
    nodes = durable(sketched.join(low, "node").where("doc_id = low").groupBy("node").agg(*(F.min(c).alias(c) for c in ("low", "version")), *(F.first(c).alias(c) for c in ("n_shingles", "sketch"))))

    # Buckets of two nodes or more, each with its hub.
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    rows = nodes.select("node", F.posexplode(bands).alias("band", "key"))
    hubs = durable(rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub"))
    members = durable(rows.join(hubs, "key"))
    pairs = durable(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())

    # The full sets of nodes in such buckets.
    wanted = durable(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("doc_id"), "version"))
    n_wanted = wanted.count()
    full = durable(docs.join(F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted, ["doc_id", "version"]).mapInArrow(_sets(width), "node binary, members binary"))
    if full.count() > n_wanted:  # repeated rows
        full = durable(full.dropDuplicates(["node"]))

    sides = {
        k: (nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")), full.select(F.col("node").alias(k), F.col("members").alias(f"set_{k}"))) for k in ("a", "b")
    }
    sized = pairs.join(sides["a"][0], "a").join(sides["b"][0], "b").where(F.least("n_a", "n_b") * 100 >= share * F.greatest("n_a", "n_b"))
    likely = sized.mapInArrow(_likely(least), "a binary, b binary")
    links = durable(likely.join(sides["a"][1], "a").join(sides["b"][1], "b").mapInArrow(_verified(share), "a binary, b binary"))

    # Buckets that aren't one component yet: minor members against all, block by block.
    parts = durable(connected_components(links).select(F.col("id").alias("node"), F.col("component_id").alias("part")))
    open_rows = _open_buckets(members.select("key", "band", "node"), parts, nodes).join(nodes.select("node", "n_shingles", "sketch"), "node").join(full, "node")
    spread = lambda n: F.pmod(F.xxhash64("node"), n)
    of_all = open_rows.withColumn("block", spread(F.col("all_blocks"))).withColumn("minor_block", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1))).withColumn("is_minor", F.lit(False))
    of_minor = open_rows.where("minor").withColumn("minor_block", spread(F.col("minor_blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1))).withColumn("is_minor", F.lit(True))
    columns = ["key", "band", "minor_block", "block", "node", "part", "is_minor", "n_shingles", "sketch", "members"]
    more = durable(of_all.select(columns).union(of_minor.select(columns)).groupBy("key", "minor_block", "block").applyInArrow(_forest(share, least), "a binary, b binary"))
    # Components are joined by what the buckets added.
    named = parts.select(F.col("node").alias("a"), F.col("part").alias("b"))
    labels = parts.select(F.col("node").alias("id"), F.col("part").alias("component_id")) if more.isEmpty() else connected_components(named.union(more))

    # A component is named by the smallest id of its nodes, and of that id's texts by the smallest hash.
    labelled = nodes.select("node", "low", "version").join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "low", "version", F.coalesce("component_id", "node").alias("component"))
    names = labelled.groupBy("component").agg(F.min(F.struct("low", "version")).alias("least"))
    named = durable(labelled.join(names, "component").select("node", F.col("least.low").alias("component_id"), F.col("least.version").alias("component_version")))
    return sketched.select("doc_id", "version", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")


def near_duplicates(docs: DataFrame, width: int = 4, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is its component's smallest id) for each row."""
    out = _grouped(docs, width, similarity)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs of which one document of each group of near duplicates stays, the smallest id.

    A document is an id with a text: rows of one id with different texts are judged each by its own group, and if a
    group holds several texts of its smallest id, that of the smallest hash stays. Repeated rows of an id and text
    are one document: one of them stays. Rows without an id stay.
    """
    stays = F.col("node").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("version") == F.col("component_version")))
    doc, version = fresh(docs, "of_doc", "of_version")
    verdict = _grouped(docs, width, similarity).where(~stays).select(F.col("doc_id").alias(doc), F.col("version").alias(version)).distinct()
    keyed = docs.where("doc_id is not null").select("*", F.col("doc_id").cast("long").alias(doc), F.xxhash64(F.col("text").cast("string")).alias(version))
    named = keyed.join(durable(verdict), [doc, version], "left_anti")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates([doc, version])
    return named.drop(doc, version).unionByName(docs.where("doc_id is null"))
