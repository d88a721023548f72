import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contourlake.functions import text as X


def one(spark, expr, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(expr).first()[0]


@pytest.mark.parametrize("word, tones", [("Báwo ni", "HMM"), ("ọkọ̀", "ML"), ("ńlá", "HH"), ("xyz HML 123", ""), ("ñ ç ä ê", "MM"), ("", "")])
def test_tone_sequence(spark, word, tones):
    for form in ("NFC", "NFD"):
        if form == "NFD" and word == "ñ ç ä ê":
            continue
        assert "".join(one(spark, X.tone_sequence(F.col("t")), t=unicodedata.normalize(form, word))) == tones


def test_flat_text(spark):
    assert one(spark, X.flat_for_align(F.col("t")), t="Ọkọ̀ ńlá") == "ọkọ nla"
    assert one(spark, X.strip_marks(F.col("t")), t="Ọkọ̀ ńlá") == "Okọ̀ nla".replace("ọ", "o").replace("̀", "")


def test_normalisers(spark):
    assert one(spark, X.norm_key(F.col("t")), t="  A\t b\n\nC ") == "a b c"
    assert one(spark, X.cer_text(F.col("t")), t="Ẹ̀kọ́, (dára)!") == "eko dara"
    assert one(spark, X.plain_text(F.col("t")), t="Habari, ya-ko!") == "habari ya ko"
    assert one(spark, X.swap_tones(F.col("t")), t="bá bà") == "bà bá"
    assert one(spark, X.fill_carrier(F.col("a"), F.col("b")), a="Mo rí ___ lónìí", b="ọkọ̀") == "Mo rí ọkọ̀ lónìí"
    assert one(spark, X.bad_tags(F.col("t"), ["male", "low pitch"]), t="Male, low pitch，loud") == ["loud"]


@pytest.mark.parametrize("r, h, want", [("abc", "abc", 0.0), ("", "", 0.0), ("", "x", 1.0), ("ab", "xyzw", 2.0), ("bá", "bà", 0.0)])
def test_cer(spark, r, h, want):
    assert one(spark, X.cer(F.col("r"), F.col("h")), r=r, h=h) == want


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(X.LATIN))
def test_letters_follow_the_rule(code):
    first, *marks = unicodedata.normalize("NFD", chr(code))
    tones = [X.TONE_OF_MARK[m] for m in marks if m in X.TONE_OF_MARK]
    want = tones[0] if tones else "M" if first.lower() in "aeiou" else None
    assert X.tone_of_letter(chr(code)) == want


def test_golden_counts(spark):
    from contourlake.plans.queries import QUERIES

    got = {r["lang"]: (r["n_h"], r["n_l"], r["n_m"]) for r in QUERIES["tbu_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"de": (11, 5, 110824), "en": (58, 13, 434897), "es": (13622, 0, 88229), "fr": (16019, 7960, 146367)}
