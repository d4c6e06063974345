"""The pipeline, stage by stage, against brute force over each stage's own input."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import ordinal, raking, setsketch
from tessella.llm.common import stored
from tests.conftest import SCHEMA, documents
from tests.llm.test_operators import CLASHING, ODD, SF, brute_components, cut_by_all, words_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_brute_force(spark):
    docs, kept, names = spark.read.parquet(f"{SF}/documents.parquet"), {}, [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        kept[name] = docs
        assert name == names[-1] or docs.columns == COLUMNS
    texts = {n: {r.doc_id: r.text for r in kept[n].collect()} for n in names[:-1]}

    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & texts["toxicity"].keys()) <= 0.4 * len(toxic)  # 11 labelled toxic texts in four languages
    report = ordinal.toxicity_report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts["toxicity"] == {r.doc_id: whole[r.doc_id] for r in report.where("kept").collect()}

    every = cut_by_all(texts["toxicity"])
    lost = lambda out: words_of(texts["toxicity"]) - words_of(out)
    assert lost(texts["line_dedup"]) >= 0.99 * lost(every) > 0
    for i, t in texts["line_dedup"].items():
        left = iter(t.split("\n"))
        assert t == every[i] or every[i] == "" or all(x in left for x in every[i].split("\n"))
    assert {r.doc_id: r.n_chars for r in kept["line_dedup"].collect()} == {i: len(t) for i, t in texts["line_dedup"].items()}

    components = brute_components(list(texts["line_dedup"].items()), 5)
    assert texts["near_dedup"] == {i: t for i, t in texts["line_dedup"].items() if components[i][1] == i}

    near = kept["near_dedup"].toPandas()  # noqa: F841 - DuckDB reads it by name
    sampled = duckdb.sql(f"SELECT doc_id FROM ({raking.mixing_sql(documents='near')}) WHERE kept").fetchall()
    assert texts["mixing"].keys() == {i for (i,) in sampled}

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in kept["packing"].collect():
        own = [*tokenizer.encode(texts["mixing"][r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.doc_tokens, r.ids_crc32) == (len(own), zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()))
        pieces[r.doc_id].append((r.start, r.start + r.length))
    assert pieces.keys() == texts["mixing"].keys()
    for spans in pieces.values():
        assert all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))

    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in kept["packing"].collect()}


def odd_tables(spark):
    """Rows of every odd kind, repeated ids and rows, toxic words, shared passages, clashing columns; and no rows."""
    passage = "\n".join(f"the passage line number {k} has quite a few words in it" for k in range(6))
    texts = [*ODD, f"first own words\n{passage}", f"second own words\n{passage}", passage, (3, passage), (3, "one"), (None, passage), (None, None), (8, "x" * 200_000)]
    odd = documents(spark, [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)], extra=True)
    odd = odd.unionByName(documents(spark, [(70, "null source"), (71, None)], extra=True).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    for k, c in enumerate(CLASHING):
        odd = odd.withColumn(c, F.lit(f"own {k}"))
    return odd, spark.createDataFrame([], SCHEMA)


def test_stages_of_odd_rows(spark):
    odd, none = odd_tables(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert stage(spark, none, SF).count() == 0
        kept[name] = [(r.doc_id, r.text) for r in rows] if name != "packing" else rows
        if name != "packing":
            assert out.columns == odd.columns and all(r[c] == f"own {k}" for r in rows for k, c in enumerate(CLASHING))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(str, kept["toxicity"])) == sorted(map(str, rows))  # nothing toxic
    assert len(kept["line_dedup"]) == len(rows)  # id 3 holds the passage first
    assert {(9, "first own words"), (10, "second own words"), (11, "")} <= set(kept["line_dedup"]) and (3, rows[12][1]) in kept["line_dedup"]
    assert {t for i, t in kept["line_dedup"] if i is None} == {t for i, t in rows if i is None}
    assert len(kept["near_dedup"]) < len(rows) and {i for i, _ in kept["near_dedup"]} >= {None, 0, 1, 2, 3, 5, 70, 71}
    assert set(map(str, kept["mixing"])) <= set(map(str, rows)) and len(kept["mixing"]) > len(rows) / 2
    assert {r.doc_id for r in kept["packing"]} == {i for i, _ in rows}


def test_near_copies_are_caught_in_the_pipeline(spark):
    """Every link of five-word shingles at a similarity of 0.8 is found: recall over the links of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    got = {r.doc_id for r in setsketch.drop_near_duplicates(docs).collect()}
    assert got == {i for i, (_, c) in want.items() if c == i}
    assert len(got) < len(want)
