"""SQL functions that return tables, which Catalyst inlines: no Python runs for them.

A body is one generator and nothing else, so that a lateral call becomes a
generator over the caller's rows; a filter or a subquery around it would become
a join of the rows with their distinct arguments.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import register

FRAMES = "ARRAY<STRUCT<t: DOUBLE, f0: DOUBLE>>"
#: f0 of a frame x under a condition, m being the clip's mean pitch; the SQL side of ``conditions.CONDITIONS``.
EDITS = {"original": "x.f0", "roundtrip": "x.f0", "flat": "CASE WHEN x.f0 IS NOT NULL THEN m END", "half": "m + 0.5D * (x.f0 - m)"}
MEAN = "aggregate(filter(transform(frames, y -> y.f0), v -> v IS NOT NULL), named_struct('s', 0D, 'n', 0L), (a, v) -> named_struct('s', a.s + v, 'n', a.n + 1L), a -> CASE WHEN a.n > 0 THEN a.s / a.n END)"


def _with_mean(expression: str) -> str:
    """The expression with m bound to the clip's mean pitch, computed once a clip."""
    return f"transform(array({MEAN}), m -> {expression})[0]"


def register_tables(spark: SparkSession, edits: dict[str, str] | None = None) -> list[str]:
    """Makes temporary table functions; their names.

    * ``tbu_rows(text)``: tbu_idx and target of a text's tone-bearing units.
    * ``condition_rows(frames, name)``: t and f0 of a clip's frames under a
      condition; an unknown name gives no rows. edits adds conditions, as SQL
      over x.t, x.f0 and m.
    * ``all_conditions(frames)``: condition, t and f0 under each condition.
    """
    register.register(spark)
    every = EDITS | (edits or {})
    names = ", ".join(f"'{n}'" for n in every)
    f0 = f"CASE name {' '.join(f"WHEN '{n}' THEN {e}" for n, e in every.items())} END"
    edited = f"transform(frames, x -> named_struct('t', x.t, 'f0', {f0}))"
    edited_each = f"transform(frames, x -> named_struct('condition', name, 't', x.t, 'f0', {f0}))"
    own = {
        "tbu_rows(t STRING) RETURNS TABLE (tbu_idx INT, target STRING)": f"SELECT posexplode(array_remove(split({register.tone_string()}, ''), ''))",
        f"condition_rows(frames {FRAMES}, name STRING) RETURNS TABLE (t DOUBLE, f0 DOUBLE)": f"SELECT inline(CASE WHEN name IN ({names}) THEN {_with_mean(edited)} ELSE array() END)",
        f"all_conditions(frames {FRAMES}) RETURNS TABLE (condition STRING, t DOUBLE, f0 DOUBLE)": f"SELECT inline({_with_mean(f'flatten(transform(array({names}), name -> {edited_each}))')})",
    }
    for head, body in own.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return sorted(h.split("(")[0] for h in own)
