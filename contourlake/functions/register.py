"""SQL names for the engine's functions, as expression functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as X

FUNCTIONS = {
    "norm_key(t STRING) RETURNS STRING": "trim(regexp_replace(lower(CASE WHEN t IS NOT NULL THEN reflect('com.ibm.icu.text.Normalizer', 'compose', t, false) END), '\\\\s+', ' '))",
    "semitone(hz DOUBLE) RETURNS DOUBLE": "CASE WHEN hz IS NOT NULL THEN 12D * log2(greatest(hz, 1e-6D) / 100D) END",
    "wilson_lo(k DOUBLE, n DOUBLE) RETURNS DOUBLE": "CASE WHEN n > 0 THEN greatest(0D, (k / n + 1.920721601D / n) / (1D + 3.841443202D / n) - 1.95996D * sqrt(k / n * (1D - k / n) / n + 3.841443202D / (4D * n * n)) / (1D + 3.841443202D / n)) END",
    "wilson_hi(k DOUBLE, n DOUBLE) RETURNS DOUBLE": "CASE WHEN n > 0 THEN least(1D, (k / n + 1.920721601D / n) / (1D + 3.841443202D / n) + 1.95996D * sqrt(k / n * (1D - k / n) / n + 3.841443202D / (4D * n * n)) / (1D + 3.841443202D / n)) END",
}


def _marked(tones: dict[str, str]) -> str:
    """``text.marked_units`` of t as SQL: tone-bearing letters as their tones' stand-ins, then letters with loose marks."""
    whole = f"translate(t, '{''.join(tones)}', '{''.join(X.STAND_IN[v] for v in tones.values())}')"
    loose = whole
    for mark, tone in X.TONE_OF_MARK.items():
        loose = f"regexp_replace({loose}, '(?:\\\\p{{L}}|{X.STAND_IN['M']})[\\\\x{{302}}\\\\x{{303}}\\\\x{{305}}-\\\\x{{36F}}]*{mark}', '{X.STAND_IN[tone]}')"
    return f"CASE WHEN t RLIKE '[{''.join(X.TONE_OF_MARK)}]' THEN {loose} ELSE {whole} END"


def tone_string() -> str:
    """The tones of t as SQL, for bodies in which no other SQL function may stand."""
    stand = "".join(X.STAND_IN.values())
    return f"translate(regexp_replace({_marked(X.tone_letters())}, '[^{stand}]', ''), '{stand}', '{''.join(X.STAND_IN)}')"


def register(spark: SparkSession) -> list[str]:
    """Makes temporary SQL functions norm_key, semitone, wilson_lo, wilson_hi, cer_text and tone_string; their names."""
    bare = X.bare_letters()
    own = {
        "cer_text(t STRING) RETURNS STRING": f"trim(regexp_replace(lower(regexp_replace(translate(t, '{''.join(bare)}', '{''.join(bare.values())}'), '[\\\\x{{300}}-\\\\x{{36F}}]', '')), '[^\\\\p{{L}}\\\\p{{N}}_]+', ' '))",
        "tone_string(t STRING) RETURNS STRING": tone_string(),
    }
    for head, body in (FUNCTIONS | own).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return sorted(h.split("(")[0] for h in FUNCTIONS | own)
