"""Named conditions: edits of pitch frames under which a meter is tried."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signal

Condition = Callable[[DataFrame], DataFrame]

CONDITIONS: dict[str, Condition] = {
    "original": lambda frames: frames,
    "roundtrip": lambda frames: frames,  # in the F0 domain nothing is lost by going there and back
    "flat": signal.flatten,
    "half": lambda frames: signal.scale_excursion(frames, 0.5),
}


def register(name: str, edit: Condition) -> None:
    CONDITIONS[name] = edit


def applied(frames: DataFrame, windows: DataFrame, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """frames and windows under each condition, one table each; clip_id becomes condition|clip."""
    out_f = out_w = None
    for name in names or list(CONDITIONS):
        keyed = F.concat(F.lit(f"{name}|"), F.col("clip_id").cast("string"))
        f = CONDITIONS[name](frames).select(keyed.alias("clip_id"), "t", "f0")
        w = windows.select(keyed.alias("clip_id"), "tbu_idx", "target", "t0", "t1")
        out_f, out_w = (f, w) if out_f is None else (out_f.unionByName(f), out_w.unionByName(w))
    return out_f, out_w


def of(column: str = "clip_id"):
    """The condition in an id that ``applied`` made."""
    return F.substring_index(column, "|", 1)
