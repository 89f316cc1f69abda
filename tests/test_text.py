import pytest
from pyspark.sql import functions as F

from riskframe.functions import text as t
from riskframe.functions.judge import parse_reply
from riskframe.functions.measures import clamp, cosine, display_band, risk_label
from riskframe.plans.features import columns_of, readiness, text_features


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first().x


def features(spark, question, context, answer):
    df = spark.createDataFrame([("s", question, context, answer)], "sample_id string, question string, context string, answer string")
    return text_features(df).first().asDict()


def test_length(spark):
    f = features(spark, "q", "c", "Snow fell late. Did anyone ski? Yes!")
    assert (f["n_words"], f["n_sentences"], f["n_chars"]) == (7, 3, 36)
    assert f["avg_word_len"] == pytest.approx(36 / 7)


def test_empty_answer(spark):
    f = features(spark, "q", "c", "")
    assert (f["n_words"], f["n_sentences"], f["avg_word_len"], f["overlap_answer_context"]) == (0, 1, 0, 0)


def test_null_texts_are_empty(spark):
    f = features(spark, None, None, None)
    assert (f["n_chars"], f["novel_numbers"], f["entity_overlap_ratio"]) == (0, 0, 1.0)


def test_overlap(spark):
    f = features(spark, "Which river feeds the lake?", "Two streams and the Orla feed the lake.", "The Orla feeds it")
    assert f["overlap_answer_context"] == pytest.approx(2 / 4) and f["overlap_answer_question"] == pytest.approx(2 / 4)
    assert f["jaccard_ans_ctx"] == pytest.approx(2 / 9) and f["jaccard_ans_q"] == pytest.approx(2 / 7)
    f = features(spark, "q", "Bees dance.", "dance BEES, dance!")
    assert (f["overlap_answer_context"], f["jaccard_ans_ctx"]) == (1.0, 1.0)
    f = features(spark, "q", "", "Nothing to lean on")
    assert (f["overlap_answer_context"], f["jaccard_ans_ctx"]) == (0, 0)


def test_numbers(spark):
    f = features(spark, "How tall?", "The tower has 310 steps.", "It has 301 steps on 12 floors, 12 in all")
    assert (f["novel_numbers"], f["number_overlap_ratio"], f["n_numbers_answer"], f["n_numbers_context"]) == (2, 0, 2, 1)
    f = features(spark, "q", "It has 310 steps.", "It has very many")
    assert (f["novel_numbers"], f["number_overlap_ratio"]) == (0, 1.0)


@pytest.mark.parametrize("text, want", [("5% of", ["5"]), ("5%x", ["5%"]), ("3.14abc 2.5. 1,000", ["3", "2.5", "1", "000"]), ("12th abc12", [])])
def test_number_tokens(spark, text, want):
    assert one(spark, t.found(F.col("a"), t.NUMBER), a=text) == want


def test_hedges(spark):
    f = features(spark, "q", "c", "Reportedly the bridge could reopen in May, possibly in June.")
    assert (f["hedge_count"], f["hedge_density"]) == (3, pytest.approx(3 / 10))
    assert one(spark, t.hedge_count(F.col("a")), a="maybe MAYBE, it seems unlikely") == 5


@pytest.mark.parametrize("text", ["\xa0 a b\x1c\u3000", "\u2003\x85\r\n", "", None, "x", "\u200bz \u1680"])
def test_strip(spark, text):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(t.strip(F.col("a")).alias("x")).first().x == (text or "").strip()


def test_unicode_words_and_sentences(spark):
    assert one(spark, t.n_words(F.col("a")), a="a\x1cb c\xa0d") == 4
    assert one(spark, t.n_sentences(F.col("a")), a="Hi. There! ... ? ok") == 3
    assert one(spark, t.tokens(F.col("a")), a="x‿y") == ["x", "y"]


@pytest.mark.parametrize("p, want", [(0.70, "high_risk"), (0.6999, "medium_risk"), (0.30, "medium_risk"), (0.2999, "low_risk")])
def test_risk_label(spark, p, want):
    assert one(spark, risk_label(clamp(F.col("p"))), p=p) == want


def test_band_rounds_first(spark):
    assert one(spark, display_band(F.col("p")), p=0.696) == "high"
    assert one(spark, display_band(F.col("p"), F.col("l")), p=0.696, l="low_risk") == "low"


@pytest.mark.parametrize(
    "reply, want",
    [
        ('```json\n{"judgment": "hallucinated", "confidence": 0.9}\n```', ("hallucinated", 0.9, True)),
        ('Sure: {"judgment": "grounded"} done', ("grounded", 0.5, True)),
        ("I say it is Hallucinated", ("hallucinated", 0.5, False)),
        ("fine", ("grounded", 0.5, False)),
        (None, ("grounded", 0.5, False)),
    ],
)
def test_judge_replies(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string").select(parse_reply(F.col("reply")).alias("v")).select("v.*").first()
    assert (df.judgment, df.confidence, df.parsed) == want


def test_cosine(spark):
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.c for r in vectors.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0]


def test_groups_and_readiness(spark):
    df = text_features(spark.createDataFrame([("s", "q", "c", "a")], "sample_id string, question string, context string, answer string")).drop("hedge_count")
    assert "hedge_density" not in columns_of(df) and "n_chars" in columns_of(df)
    with pytest.raises(ValueError):
        columns_of(df.select("sample_id"))
    row = readiness(df, ["n_chars", "cosine_q_ans"]).first()
    assert (row.missing, row.ready) == (["cosine_q_ans"], False)
