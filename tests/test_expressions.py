"""Edges of every column expression, on literal rows."""

import pytest
from pyspark.sql import functions as F

from phraselens.functions import ratio as fr, text as ft, vectors as fv, words as fw


def column(spark, values, type_, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_text_gate_strips_all_white_space(spark):
    texts = ["", " \t\n", "  ab　", " abc ", "ab", "abc", None]
    assert column(spark, texts, "string", lambda c: ft.has_min_chars(c, 3)) == [False, False, False, True, False, True, None]
    assert column(spark, texts, "string", lambda c: ft.has_min_chars(c, 1)) == [False, False, True, True, True, True, None]


@pytest.mark.parametrize("n,limit", [(0, 2), (1, 2), (15, 2), (16, 3), (20, 3), (21, 4)])
def test_ngram_limit_by_word_count(spark, n, limit):
    text = "  " + "  ".join(["w"] * n) + "\n"
    assert column(spark, [text], "string", ft.word_count) == [n]
    assert column(spark, [text], "string", lambda c: ft.ngram_limit(ft.word_count(c))) == [limit]


def test_tokens(spark):
    texts = ["Don't STOP a b_c x1 é", "ΑΒΓ Привет ça!", "", "a b c"]
    assert column(spark, texts, "string", ft.tokens) == [["don", "stop", "b_c", "x1"], ["αβγ", "привет", "ça"], [], []]


def test_clean_flag_preview(spark):
    assert column(spark, ["  Not Me "], "string", ft.clean_phrase) == ["not me"]
    assert column(spark, ["not me", "knot me"], "string", lambda c: ft.has_any_word(c, fw.BOOST_WORDS)) == [True, False]
    assert column(spark, ["x" * 100, "y" * 101], "string", ft.preview) == ["x" * 100, "y" * 100 + "..."]


def test_ratio_and_bands(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (1, 16), (33, 100), (66, 100), (67, 100), (5, 5)], "p long, t long")
    rows = df.select(fr.ratio(F.col("p"), F.col("t")).alias("r"), fr.ratio_milli(F.col("p"), F.col("t")).alias("m"))
    rows = rows.select("r", "m", fr.phrase_band(F.col("r")), fr.cluster_band(F.col("r")), fr.percent_text(F.col("m"))).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, 0.0625, 0.33, 0.66, 0.67, 1.0]
    assert [r[1] for r in rows] == [0, 0, 63, 330, 660, 670, 1000]
    assert [r[2] for r in rows] == ["LOW HATE", "LOW HATE", "LOW HATE", "LOW HATE", "NEUTRAL", "HIGH HATE", "HIGH HATE"]
    assert [r[3] for r in rows] == ["LOW HATE", "LOW HATE", "LOW HATE", "NEUTRAL", "NEUTRAL", "HIGH HATE", "HIGH HATE"]
    assert [r[4] for r in rows] == ["0.0%", "0.0%", "6.3%", "33.0%", "66.0%", "67.0%", "100.0%"]


def test_percent_parsing(spark):
    assert column(spark, ["12.3%", " 7 %", "n/a", None], "string", fr.parse_percent) == [pytest.approx(0.123), pytest.approx(0.07), None, None]


def test_thresholds_and_verdicts(spark):
    sims = [-1.0, 0.49, 0.5, 0.64, 0.65, 0.79, 0.8, 0.89, 0.9, 1.0]
    assert column(spark, sims, "double", fr.adaptive_threshold) == [.85, .85, .80, .80, .75, .75, .70, .70, .65, .65]
    assert column(spark, [0.5, 0.501], "double", fr.phrase_verdict) == ["Non-hate speech", "Hate speech"]
    assert column(spark, [0.75, 0.76], "double", lambda c: fr.text_verdict(c, F.lit(0.75))) == ["Non-hate speech", "Hate speech detected"]
    assert column(spark, [0.59, 0.6], "double", fr.low_confidence) == [True, False]


def test_display_texts(spark):
    assert column(spark, [0, 5, 123, 1000], "long", fr.three_decimals) == ["0.000", "0.005", "0.123", "1.000"]
    assert column(spark, [250], "long", lambda c: fr.summary_text(10, c))[0].endswith("10 nearest phrases (avg hate ratio: 0.250)")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(fv.l2_normalise(F.col("a")), fv.cosine(F.col("a"), F.col("b")), fv.dot(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx([0.6, 0.8]) and rows[0][1] == pytest.approx(0.96) and rows[0][2] == 24.0
    assert rows[1][0] == [0.0, 0.0] and rows[1][1] == 0.0


def test_stop_word_algebra(spark):
    as_list = fw.custom_stop_words()
    as_table = fw.custom_stop_word_table(
        fw.word_table(spark, fw.base_stop_words()), fw.word_table(spark, fw.RELEVANT_WORDS), fw.word_table(spark, fw.EXTRA_STOP_WORDS))
    assert sorted(r[0] for r in as_table.collect()) == as_list
    assert "not" not in as_list and "said" in as_list and "the" in as_list
