"""Structured Streaming: continuous validation, violation counts and incremental history."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import diff, patch
from ..operators.rules import violations
from ..plans.rules import Shape


def validate(stream: DataFrame, shapes: list[Shape], keep: list[str]) -> DataFrame:
    """Violations of each arriving object; stateless, so the batch's columns serve as they are."""
    return violations(stream, shapes, keep)


def counts(found: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Violations by level and window; rows later than ``late`` are left out."""
    return found.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "enforcement_level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "enforcement_level", "n")


def distinct_stages(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Stages without those that arrive twice."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


_OUT = "object long, seq long, path array<string>, op string, old string, new string"


def running_history(stream: DataFrame) -> DataFrame:
    """Deltas against each object's running value, which is kept as state.

    ``stream``: object long, seq long, value JSON string, and, if stages may be
    rejected in part, rejected array<array<string>> (paths whose deltas are
    dropped). Within a batch stages of an object go by seq. A stage that is not
    newer than the last one seen changes nothing and comes out as a row with the
    op ``late`` (its value as ``new``); a delta that can't be applied as one
    with the op ``failed``.
    """
    partly = "rejected" in stream.columns

    def fold(key, batches, state):
        seq, value = state.get if state.exists else (None, None)
        running = json.loads(value) if value is not None else None
        rows = []
        frames = list(batches)
        whole = pd.concat(frames).sort_values("seq", kind="stable") if frames else pd.DataFrame({"seq": [], "value": [], "rejected": []})
        for s, text, rejected in zip(whole["seq"], whole["value"], whole["rejected"] if partly else [None] * len(whole)):
            if seq is not None and s <= seq:
                rows.append((key[0], int(s), [], "late", None, text))
                continue
            stage = json.loads(text)
            if seq is None:
                running = stage
            else:
                dropped = {tuple(p) for p in (rejected if rejected is not None else [])}
                deltas = [d for d in diff(running, stage, False, False) if d.path not in dropped]
                running, trace = patch(running, deltas)
                lost = set(trace.failed)
                rows += [(key[0], int(s), list(d.path), "failed" if d.path in lost else d.op, json.dumps(d.old), json.dumps(d.new)) for d in deltas]
            seq = int(s)
        if seq is not None:
            state.update((seq, json.dumps(running)))
        yield pd.DataFrame(rows, columns=["object", "seq", "path", "op", "old", "new"])

    return stream.groupBy("object").applyInPandasWithState(fold, _OUT, "seq long, value string", "append", "NoTimeout")
