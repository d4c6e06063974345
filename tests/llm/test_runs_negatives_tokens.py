"""Runs of words, hard negatives and byte-level BPE against brute force, a reference tokenizer and round trips, and on odd rows."""

import base64
import hashlib
import math
import random
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, hard_negatives, queries, runs
from tests.conftest import SCHEMA, documents
from tests.llm.test_operators import ODD, SF, WORD, table

# 11


def brute_runs(sequence, least_length=6, least_exponent=4):
    """Every maximal stretch of every period, the smallest period of each."""
    n, out = len(sequence), {}
    for q in range(1, n // least_exponent + 1):
        same = [sequence[i] == sequence[i + q] for i in range(n - q)]
        edges = [i for i, (a, b) in enumerate(pairwise([False, *same, False])) if a != b]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + q >= max(least_length, least_exponent * q):
                out.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2], r[1]))


def brute_report(doc_id, text, plant):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (2, 2), (5, 3), (3, 2)]))
def test_runs_of_few_words_match_brute_force(sequence, least):
    assert runs.periodic_runs(sequence, *least) == brute_runs(sequence, *least)


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_repeated_blocks_match_brute_force(least):
    rng = random.Random(1)
    for _ in range(300):
        sequence = []
        while len(sequence) < 120:
            sequence += [rng.randrange(4) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
            if rng.random() < 0.4:
                sequence += sequence[rng.randrange(len(sequence)) :]
        assert runs.periodic_runs(sequence[:250], *least) == brute_runs(sequence[:250], *least)


def test_stretches_cut_no_run():
    rng = random.Random(2)
    for least in ((6, 4), (2, 2), (5, 3), (12, 2)):
        for _ in range(100):
            texts = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(4)]
            codes, first = np.array(sum(texts, []), np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            found = [(a + s, n, q) for a, b in runs.stretches(codes, first, *least) for s, n, q in runs.periodic_runs(codes[a:b].tolist(), *least)]
            assert sorted(found) == sorted((int(f) + s, n, q) for f, t in zip(first, texts, strict=False) for s, n, q in brute_runs(t, *least))


def test_factors_copy_from_before():
    rng = random.Random(3)
    for _ in range(200):
        sequence = [rng.randrange(3) for _ in range(rng.randrange(60))]
        out = runs.factors(sequence)
        assert [i for a, b, _ in out for i in range(a, b)] == list(range(len(sequence)))
        for a, b, source in out:
            assert b == len(sequence) or not any(sequence[s : s + b + 1 - a] == sequence[a : b + 1] for s in range(a)) or source < 0
            assert (source < 0 and b == a + 1 and sequence[a] not in sequence[:a]) or (0 <= source < a and sequence[source : source + b - a] == sequence[a:b])


def test_runs_of_periodic_texts_take_linear_time_and_find_one_run():
    for period in (1, 7, 1000):
        assert runs.periodic_runs([i % period for i in range(20_000)]) == [(0, 20_000, period)]


def test_word_runs_match_brute_force_over_documents(spark):
    docs = table(spark, "documents")
    got = sorted(tuple(r) for r in queries.op11_word_runs(spark, SF).collect())
    assert got == sorted(brute_report(r.doc_id, r.text, plant=True) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_word_runs_of_odd_rows(spark):
    odd = [*ODD, "a b " * 40 + "c", "x " * 5, "x " * 6, "Ab aB " * 9, "w\x85x " * 30]
    rows = [*enumerate(odd), (None, "z z z z z z z"), (3, "z z z z z z z"), (3, "z z z z z z z")]
    want = sorted((brute_report(i, t, plant=False) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in runs.run_report(documents(spark, rows, extra=True)).collect()), key=str) == want
    assert runs.run_report(spark.createDataFrame([], SCHEMA)).count() == 0
    planted = runs.planted_periods(documents(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.text) for r in planted if r.doc_id is None) == [("None", "z z z z z z z")] and len(planted) == len(rows)
    text = runs.collapse_runs(documents(spark, ["go a b a b a b a b stop"])).first()
    assert (text.n_words, text.collapsed, [tuple(r) for r in text.runs]) == (10, "go a b stop", [(1, 8, 2)])


def test_rejects_exponents_that_are_no_runs():
    with pytest.raises(ValueError):
        runs.periodic_runs([1, 1], 2, 1)


# 12


def brute_negatives(rows, positives=5, negatives=3, every=50, low=50, high=95):
    whole = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, n, label, [math.floor(256 * x) if abs(x) < 2**40 else 256 * int(x) for x in v]))
    out = []
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, n, label, v in whole:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), c, m, other == label) for c, m, other, w in whole if m != n]
        for s, c, m, _ in sorted(x for x in scored if x[3])[:positives]:
            fits = sorted(x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, c, r, d, clip(-s), clip(-t)) for r, (t, d, _, _) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def mined(df, **how):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in hard_negatives.hard_negatives(df, **how).collect())


def clustered(rng, n, dims, labels):
    centres = [[rng.gauss(0, 0.5) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("labels", [1, 3, 400])
def test_hard_negatives_match_brute_force(spark, monkeypatch, labels):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 500)  # several parts; labels of one tree, many trees, and none
    rng = random.Random(labels)
    rows = clustered(rng, 1500, 8, labels)
    rows += [(2000, None, 1), (2050, [], 1), (2100, [float("nan")] * 8, 1), (2150, [None] * 8, 1), (2200, [0.5] * 4, 1), (2250, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(3000 + i, rows[0][1], i % 2) for i in range(60)]  # ties
    rows += [(50, rows[50][1], rows[50][2])] * 2  # repeated rows
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("number", "rank", "score", "part", "anchor", "own", "nth"):
        df = df.withColumn(c, F.lit(1))
    assert mined(df) == brute_negatives(rows)


def test_hard_negatives_of_other_windows_and_few_rows(spark):
    rows = clustered(random.Random(4), 300, 5, 4)
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df, positives=2, negatives=7, every=10, low=-20, high=100) == brute_negatives(rows, 2, 7, 10, -20, 100)
    assert mined(df.where("vec_id < 1")) == [] and mined(df.where("vec_id < 0")) == []
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(df, positives=0)


def test_hard_negatives_of_huge_values(spark):
    rng = random.Random(5)
    rows = [(i * 5, [rng.gauss(0.5, 1) * 10 ** rng.choice((0, 0, 5, 9)) for _ in range(4)], i % 3) for i in range(150)]
    rows += [(1000, [1e17, -1.0, 0.0, 3.0], 1), (1050, [1e300, 1e300, 0.0, 0.0], 1), (1051, [0.9e300, 0.0, 0.0, 0.0], 2), (1052, [1e300, 0.0, 0.0, 0.0], 1)]
    rows += [(2000 + i, [0.5] * w, i % 2) for i, w in enumerate((9, 2, 9, 7))]  # wider than the others
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


def test_bounds_spare_most_of_clustered_rows():
    rng = np.random.default_rng(6)
    rows = np.floor(256 * (rng.normal(0, 1, (40, 16))[rng.integers(0, 40, 8000)] + rng.normal(0, 0.05, (8000, 16))))
    number = np.arange(len(rows))
    tree = hard_negatives.BallTree(rows, number, number, np.zeros(len(rows), np.int64))
    queries_ = rows[:200]
    none = np.full(200, 2.0**62)
    asks = hard_negatives.Asks(queries_, np.arange(200), -none, none, 5, np.zeros(200, np.int64), number[:200], same=True)
    asks.search(tree, np.arange(200))
    scores = queries_ @ rows.T
    scores[np.arange(200), np.arange(200)] = -np.inf
    assert (asks.scores == -np.sort(-scores, axis=1)[:, :5]).all()
    assert asks.scored < 0.35 * scores.size


def test_ball_tree_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, "embeddings").collect()]
    got = sorted(tuple(r) for r in queries.op12_ball_tree_negatives(spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows)


# 13


@pytest.fixture(scope="module")
def reference():
    """The same ranks in tiktoken."""
    import public_tokenizers
    import tiktoken

    with open(byte_bpe._ranks(None), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def agrees(texts, reference):
    model, octets = byte_bpe.model(byte_bpe._ranks(None)), byte_bpe.token_bytes(byte_bpe._ranks(None))
    rows, ids, starts, ends = model.encode(pa.array(texts, pa.string()))
    assert len(rows) == len(texts) + 1
    for text, a, b in zip([t or "" for t in texts], rows[:-1], rows[1:], strict=True):
        assert ids[a:b].tolist() == reference.encode_ordinary(text)
        place, raw = 0, text.encode()
        for token, start, end in zip(ids[a:b].tolist(), starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
            size = len(reference.decode_single_token_bytes(token))
            # The characters that hold the token's bytes, and no more.
            assert len(text[:start].encode()) <= place < len(text[: start + 1].encode())
            assert len(text[: end - 1].encode()) < place + size <= len(text[:end].encode())
            place += size
        assert place == len(raw)
    assert octets.decode(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))) == [(t or "").encode() for t in texts]


EDGES = ["", None, "  's it's 'll", "don't we've '''s \n's\t's '", "x \n", "\n", " ", "  ", "a  b", "a \n b", "'r", "'re", "x'rex", "<|endoftext|>", "naïve 中😀 ok", "a" * 5000 + "!" * 5000, "\x1c\x85　  x", "Ᲊ\U00010d40\U00011380"]


def test_ids_and_offsets_of_edges(reference):
    agrees(EDGES, reference)
    agrees([], reference)
    agrees([None, ""], reference)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_ids_and_offsets_of_any_text(reference, texts):
    agrees(texts, reference)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'srevldmtAé1٣!-中😀́　\x85\x00", max_size=15), max_size=5))
def test_ids_and_offsets_of_blanks_and_contractions(reference, texts):
    agrees(texts, reference)


def test_a_worker_forgets_pieces_without_changing_ids(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 10)
    for k in range(5):
        agrees([f"words of round {k} and more of {k * 7} kinds", "and some again"], reference)


def test_byte_bpe_matches_reference_over_documents(spark, reference):
    got = sorted(tuple(r) for r in queries.op13_byte_bpe(spark, SF).collect())
    want = []
    for r in table(spark, "documents").collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_long_batches_are_decoded_in_slices(spark, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_IDS", 7)
    ids = [reference.encode_ordinary(t or "") for t in EDGES]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), pa.array([None, *ids[1:]], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    slices = list(byte_bpe.id_slices(batch))
    assert sum(s.num_rows for s in slices) == len(ids) < sum(map(len, ids)) and len(slices) > 5
    found = [b for s in slices for b in byte_bpe.token_bytes(byte_bpe._ranks(None)).decode(s.column("ids"))]
    assert found == [None, *((t or "").encode() for t in EDGES[1:])]


def test_decoding_of_split_characters_unknown_and_null_ids(spark, reference):
    ids = reference.encode_ordinary("中😀")
    rows = [(1, ids), (2, ids[:-1]), (3, []), (4, None), (5, [0, None]), (6, [0, 60_000]), (7, [-1]), (None, ids)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("x"))
    got = {r.doc_id: (None if r.octets is None else bytes(r.octets), r.text) for r in byte_bpe.decoded(df).collect()}
    cut = reference.decode_bytes(ids[:-1])
    assert got == {1: ("中😀".encode(), "中😀"), 2: (cut, cut.decode(errors="replace")), 3: (b"", ""), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), None: ("中😀".encode(), "中😀")}


def test_byte_bpe_of_odd_rows(spark, reference):
    rows = [*enumerate(ODD), (None, "null id"), (2, "repeated"), (2, "repeated")]
    out = byte_bpe.encoded(documents(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in out) == sorted((str(i), tuple(reference.encode_ordinary(t or ""))) for i, t in rows)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in out)
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
