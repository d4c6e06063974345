"""The evaluation protocol: the stages of an attempt, the events that lead from one to the next, and what is an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: For each event the stages from which it may come and the stage that it leads to. A rated stage keeps its verdict.
OK, FAILED = "initial-rated/acceptable", "initial-rated/failed"
MOVES: dict[str, tuple[tuple[str, ...], str]] = {
    "rate-initial+": (("sample-loaded",), OK),
    "rate-initial-": (("sample-loaded",), FAILED),
    "accept-original": ((OK,), "accepted"),
    "start-editing": ((FAILED,), "editing"),
    "confirm-editing": (("editing",), "confirmed"),
    "cancel-editing": (("editing",), "cancelled"),
    "record-error": ((OK, FAILED, "editing", "confirmed"), "error"),
    "rate-corrected-mask": (("confirmed",), "corrected-mask-rated"),
    "rate-blind-pattern": (("corrected-mask-rated",), "blind-pattern-rated"),
    "export": (("accepted", "cancelled", "error", "blind-pattern-rated"), "exported"),
}
STAGES = ["sample-loaded", *dict.fromkeys(stage for _, stage in MOVES.values())]
#: Why an event is refused; the first that holds counts.
ERRORS = ["time", "unknown-event", "stage", "rating", "payload"]
EVENTS = ["rate-initial", *(e for e in MOVES if not e.startswith("rate-initial"))]


def _outcome(symbol: str, stage: str) -> tuple[str, str | None]:
    """Stage after an event, and the error, if it is refused."""
    if symbol in ("!time", "!unknown-event"):
        return stage, symbol[1:]
    kind = symbol.rstrip("!")
    allowed, after = MOVES["rate-initial+" if kind == "rate-initial" else kind]
    if stage not in allowed:
        rated = kind in ("accept-original", "start-editing") and stage in (OK, FAILED)
        return stage, "rating" if rated else "stage"
    return (stage, "payload") if symbol.endswith("!") else (after, None)


SYMBOLS = ["!time", "!unknown-event", *MOVES, *(f"{e}!" for e in ("rate-initial", "confirm-editing", "record-error", "rate-corrected-mask", "rate-blind-pattern"))]


def _place(stage: str, error: str | None) -> int:
    """The number of a stage, or of a stage at which an error ended the attempt."""
    k = STAGES.index(stage)
    return k if error is None else len(STAGES) * (1 + ERRORS.index(error)) + k


#: For each symbol the number after it by the number before, both as bytes; ended attempts stay as they are.
TABLES = {s: bytes(_place(*_outcome(s, stage)) for stage in STAGES) + bytes(range(len(STAGES), 256)) for s in SYMBOLS}


def symbol() -> Column:
    """What an event (type, at, acceptable, choice, code, message, has_snapshot) is to the protocol."""
    at, kind = F.col("at"), F.col("type")
    texts = lambda *names: F.coalesce(sum(((F.trim(n) != "").cast("int") for n in names), F.lit(0)) == len(names), F.lit(False))
    payload = (
        F.when(kind.isin("rate-initial", "rate-corrected-mask"), F.col("acceptable").isNotNull())
        .when(kind == "rate-blind-pattern", F.coalesce(F.col("choice").isin("left", "right", "tie"), F.lit(False)))
        .when(kind == "record-error", texts("code", "message"))
        .when(kind == "confirm-editing", F.coalesce("has_snapshot", F.lit(False)))
        .otherwise(F.lit(True))
    )
    verdict = F.when(kind == "rate-initial", F.when(F.col("acceptable"), "+").otherwise("-")).otherwise("")
    finite = at.isNotNull() & ~F.isnan(at) & (F.abs(at) < float("inf"))
    return F.when(~finite, "!time").when(~F.coalesce(kind.isin(*EVENTS), F.lit(False)), "!unknown-event").when(~payload, F.concat(kind, F.lit("!"))).otherwise(F.concat(kind, verdict))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each attempt's run of sorted events its first event and the number it leads to from every stage."""
    first, reached, schema = None, b"", None

    def out(rows: list[tuple[dict, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([r[f.name] for r, _ in rows], f.type) for f in schema]
        return pa.RecordBatch.from_arrays([*columns, pa.array([list(m) for _, m in rows], pa.list_(pa.int32()))], names=[*schema.names, "reached"])

    for batch in batches:
        schema, done = batch.schema, []
        for k, (attempt, what) in enumerate(zip(batch.column("attempt_id").to_pylist(), batch.column("symbol").to_pylist(), strict=True)):
            if first is None or attempt != first["attempt_id"]:
                if first is not None:
                    done.append((first, reached))
                first, reached = {c: batch.column(c)[k].as_py() for c in schema.names}, bytes(range(len(STAGES)))
            reached = reached.translate(TABLES[what])
        yield out(done)
    if first is not None:
        yield out([(first, reached)])


def stage_maps(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """First event of each attempt and range of events, and reached: the numbers that the range leads to from each stage.

    Ranges are of (attempt, order), so that an attempt of any number of events is spread over many; each is folded as a stream.
    """
    keys = ["attempt_id", "ord", "symbol"]
    ranged = events.withColumn("symbol", symbol()).select(keys)
    ranged = ranged.repartitionByRange(ranges, *keys) if ranges else ranged.repartitionByRange(*keys)
    fields = [T.StructField(f.name, f.dataType) for f in ranged.schema]
    return ranged.sortWithinPartitions(*keys).mapInArrow(_folded, T.StructType([*fields, T.StructField("reached", T.ArrayType(T.IntegerType()))]))


def replayed(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """attempt_id, stage (of the last event that was taken), acceptable (the first verdict) and error (why the next was refused, if one was)."""
    log = stage_maps(events, ranges).groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol", "reached"))).alias("log"))  # one element a range
    last = F.aggregate("log", F.lit(0), lambda at, e: F.when(at < len(STAGES), F.element_at(e["reached"], F.least(at, F.lit(len(STAGES) - 1)) + 1)).otherwise(at))
    return named(log.select("attempt_id", last.alias("at")))


def named(ended: DataFrame) -> DataFrame:
    """ended with stage, rated and error instead of at, the number of a stage or of an attempt that an error ended."""
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("at") % len(STAGES) + 1)
    error = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ERRORS)), F.floor(F.col("at") / len(STAGES)).cast("int") + 1)
    rest = [c for c in ended.columns if c not in ("attempt_id", "at")]
    return ended.select("attempt_id", F.split(stage, "/")[0].alias("stage"), F.when(stage == OK, True).when(stage == FAILED, False).alias("rated"), error.alias("error"), *rest)
