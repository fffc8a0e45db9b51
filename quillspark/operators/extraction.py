"""Extraction in rounds (G28): an outside extractor is asked again, with what was wrong, until its output holds or it gives up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

ATTEMPTS = 3
#: Outcomes of a chunk; a worker's output counts only under the epoch of the lease that is on the chunk now.
DONE, SALVAGED, FAILED, FENCED = "DONE", "SALVAGED", "FAILED", "FENCED"
#: What may be wrong with an output besides an issue of the check itself.
EMPTY, TRUNCATED, EMPTY_AFTER_INVALID = "OUTPUT_EMPTY", "OUTPUT_TRUNCATED", "OUTPUT_EMPTY_AFTER_INVALID"
_EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_extractor(name: str, ask: Callable[[DataFrame], DataFrame]) -> None:
    """ask() takes (chunk_id, content, attempt, feedback) and gives chunk_id with output (a string or null), finished (false if it
    was cut off) and facts (an array): a join, an Arrow function or columns, as its author likes."""
    if name in _EXTRACTORS:
        raise ValueError(f"{name} is registered")
    _EXTRACTORS[name] = ask


def extract(work: DataFrame, extractor: str, issue: Column, rest: Column, leases: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(chunk_id, outcome, attempts, code, facts) for work (chunk_id, content, epoch).

    Each round asks for the chunks that are still open, with the last code as feedback, and is written to the shared folder, so
    a lost executor costs one round. issue is what is wrong with a row (content, output, facts), or null; an output that was
    cut off or is empty is wrong by itself, and so are no facts after an output that was. In the last round, rest (the facts
    that hold) is taken instead if there are any. Chunks whose lease (leases: chunk_id, epoch) has another epoch by then, or
    none, are fenced: their facts are left out. Null contents are extracted like empty ones; a chunk_id has one row.
    """
    ask = _EXTRACTORS[extractor]
    open_ = work.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), "epoch", F.lit(None).cast("string").alias("feedback"), F.lit(False).alias("rejected"))
    out = None
    for attempt in range(1, attempts + 1):
        asked = ask(open_.select("chunk_id", "content", F.lit(attempt).alias("attempt"), "feedback")).select("chunk_id", "output", "finished", "facts")
        got = open_.join(asked, "chunk_id", "left")
        bare = F.coalesce(F.trim("output"), F.lit("")) == ""
        none = F.coalesce(F.size("facts"), F.lit(0)) <= 0
        code = F.when(~F.coalesce("finished", F.lit(True)), TRUNCATED).when(bare, EMPTY).otherwise(F.coalesce(issue, F.when(none & F.col("rejected"), EMPTY_AFTER_INVALID)))
        got = got.withColumn("code", code)
        kept = F.when(F.col("code").isNull(), F.col("facts")).when(F.lit(attempt == attempts) & ~F.col("code").isin(EMPTY, TRUNCATED, EMPTY_AFTER_INVALID), rest)
        some = F.coalesce(F.size(kept), F.lit(0)) > 0
        state = F.when(F.col("code").isNull(), DONE).when(some, SALVAGED).when(F.lit(attempt == attempts), FAILED)
        told = written(got.select("chunk_id", "content", "epoch", "code", "rejected", state.alias("outcome"), F.when(state.isin(DONE, SALVAGED), kept).alias("facts")), f"extraction-{attempt}")
        ended = told.where("outcome is not null").select("chunk_id", "epoch", "outcome", F.lit(attempt).alias("attempts"), "code", "facts")
        out = ended if out is None else out.unionByName(ended)
        rejected = F.col("rejected") | (F.col("code") != EMPTY)
        open_ = told.where("outcome is null").select("chunk_id", "content", "epoch", F.col("code").alias("feedback"), rejected.alias("rejected"))
    if leases is None:
        return out.drop("epoch")
    j = out.join(leases.select("chunk_id", F.col("epoch").alias("_now")), "chunk_id", "left")
    fenced = ~F.col("epoch").eqNullSafe(F.col("_now")) | F.col("_now").isNull()
    return j.select("chunk_id", F.when(fenced, FENCED).otherwise(F.col("outcome")).alias("outcome"), "attempts", "code", F.when(~fenced, F.col("facts")).alias("facts"))
