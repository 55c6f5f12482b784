"""Names, sounds, similarity and the score ladder."""

import pytest
from pyspark.sql import functions as F

from lodestead.functions import names as N
from lodestead.functions.phonetics import double_metaphone
from lodestead.functions.similarity import partial_ratio, ratio, token_sort_ratio
from lodestead.operators import resolve as C


@pytest.mark.parametrize("name, norm", [
    ("Ann B. Cole", "ann cole"), ("A. B. Cole", "cole"), ("Ann  Cole Jr.", "ann cole"), ("Ann Cole III", "ann cole"),
    ("Ann Cole Jr Sr", "ann cole jr"), ("Jr.", "jr."), ("ANN B COLE", "ann b cole"), ("", ""), ("Ann Cole", "ann cole")])
def test_normal_form(spark, name, norm):
    assert spark.range(1).select(N.normalize_name(F.lit(name))).first()[0] == norm


@pytest.mark.parametrize("name, first, last", [("Ann", "Ann", ""), ("", "", ""), ("  ", "", ""), ("Ann B. Cole Jr.", "Ann", "Jr.")])
def test_tokens(spark, name, first, last):
    assert tuple(spark.range(1).select(N.first_token(F.lit(name)), N.last_token(F.lit(name))).first()) == (first, last)


@pytest.mark.parametrize("token, codes", [
    ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Thomas", ("TMS", "")), ("Knight", ("NT", "")), ("Wright", ("RT", "")),
    ("Catherine", ("K0RN", "KTRN")), ("Michael", ("MKL", "MXL")), ("Phillip", ("FLP", "")), ("", ("", "")), ("123", ("", ""))])
def test_double_metaphone(token, codes):
    assert double_metaphone(token) == codes


def test_similarity():
    assert (ratio("abcd", "abxd"), ratio("", "a"), ratio("ab", "ab")) == (75, 0, 100)
    assert token_sort_ratio("Cole, Ann", "ann cole") == 100
    assert partial_ratio("old rod", "cold rod") == 100 and partial_ratio("", "x") == 0


def _score(spark, a, b, threshold=0.85):
    x = spark.createDataFrame([(a, 1)], "name string, rank bigint")
    y = spark.createDataFrame([(b, 2)], "name string, rank bigint")
    pair = spark.createDataFrame([(1, 2)], "rank_a bigint, rank_b bigint")
    r = C.match_names(x, y, pair, threshold).first()
    return r.score, r.method, r.confidence


@pytest.mark.parametrize("a, b, score, method, confidence", [
    ("Ann B. Cole", "ann cole", 100, "exact_normalized", 1.0),
    ("Ann Cole", "Ann Baker", 0, "different_surname", 0.0),
    ("William Cole", "Bill Cole", 95, "known_nickname", 0.95),
    ("Bill", "Will Cole", 95, "known_nickname", 0.95),
    ("Anne Cole", "Ann Cole", 94, "fuzzy_with_phonetic", 0.94),
    ("Steve Cole", "Stephen Baker", 0, "different_surname", 0.0),
    ("Zoe Cole", "Karl Cole", 59, "no_match", 0.0)])
def test_ladder(spark, a, b, score, method, confidence):
    got = _score(spark, a, b)
    assert got[1:] == (method, confidence) if method == "no_match" else got == (score, method, confidence)


def test_partial_date(spark):
    rows = spark.createDataFrame([([3, 4, 1950],), ([0, 4, 1950],), ([3, 0, 1950],), ([3, 4, 0],), ([],), (None,)], "d array<int>")
    assert [r[0] for r in rows.select(N.partial_date(F.col("d"))).collect()] == ["1950-04-03", "1950-04", "1950", None, None, None]
