"""Text columns against stated cases."""

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text as T


def values(spark, rows, f):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k long, x string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("x"))).collect()]


def test_fold_and_normalized(spark):
    assert values(spark, ["Švicarska", "SVICARSKA", "Đorđe", "Djordje", "ČĆŽ", None, "Straße ﬁn", "e\u0301ȷ", "ạ２"], T.fold) == ["svicarska", "svicarska", "dorde", "dorde", "ccz", None, "strasse fin", "eȷ", "a2"]
    assert values(spark, ["UNICEF - United  Nations", "a_b, č!"], T.normalized) == ["unicef united nations", "a_b c"]


def test_employer_key(spark):
    names = ["UNICEF u Bosni i Hercegovini", "UNICEF - United Nations Children’s Fund", "unicef", "Unicef Partner"]
    assert values(spark, names, T.employer_key) == ["unicef", "unicef", "unicef", "unicef partner"]


@pytest.mark.parametrize(
    "left,right",
    [
        ("https://employer.test/job/42", "http://www.employer.test/job/42/?utm_source=x&fbclid=1#top"),
        ("https://jobs.unicef.org/cw/en-us/job/596053/long-title?utm_source=x", "https://jobs.unicef.org/en-us/job/596053"),
        ("https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/requisitions/job/7", "https://x.oraclecloud.com/hcmUI/CandidateExperience/fr/sites/CX_1/preview/7/"),
        ("https://a.test/j?b=2&a=1", "https://a.test/j?a=1&b=2"),
    ],
)
def test_url_keys_agree(spark, left, right):
    a, b = values(spark, [left, right], T.url_key)
    assert a == b != ""


def test_url_keys_differ_or_are_empty(spark):
    assert len(set(values(spark, ["https://ats.test/job?id=1", "https://ats.test/job?id=2"], T.url_key))) == 2
    assert values(spark, ["https://ats.test/careers", "mailto:x@y", "no url", None, "https://ats.test/"], T.url_key) == [""] * 5
    assert values(spark, ["HTTPS://A.test/x/?b=2&utm_a=1#f", "ftp://a/b"], T.canonical_url) == ["https://a.test/x?b=2&utm_a=1", None]


def test_stems_and_plurals(spark):
    assert sorted(values(spark, ["Consultants and the consultant, Evaluation"], T.stems)[0]) == ["consul", "evalua"]
    rows = [(n,) for n in (1, 2, 5, 11, 12, 21, 22, 25, 101, 111)]
    got = spark.createDataFrame(rows, "n int").select(T.bs_plural(F.col("n"), "a", "b", "c")).collect()
    assert [r[0] for r in got] == ["a", "b", "c", "c", "c", "a", "b", "c", "a", "c"]


def test_slug_and_search(spark):
    assert values(spark, ["  Šef, Odjel -- 2! ", "x" * 100], T.slug) == ["sef-odel-2", "x" * 80]
    found = values(spark, ["Švicarska ambasada Sarajevo", "Ambasada"], lambda x: T.all_words(x, F.lit("svicarska  SARAJEVO")))
    assert found == [True, False]


def test_language(spark):
    texts = [
        "the board of the office is in the city and will be open to all of the people that have come from the region with this form",
        "u radu sa ljudima i za potrebe ureda koji se nalazi na ulici od koje je sve počelo ili da su svi tu kao što treba biti",
        "il candidato deve presentare la domanda che sono le condizioni del bando per la selezione non al di sotto della soglia",
        "short text",
        None,
    ]
    assert values(spark, texts, T.language) == ["en", "bs", "it", "", ""]
