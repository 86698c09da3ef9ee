"""Scalar rules on literals, with values worked out by hand."""

from pyspark.sql import functions as F

from offerloom.functions import hygiene as H, labels as L, numbers as N, scoring as S, text as T


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, *t) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)],
                                 "i int, a string" + (", b string" if isinstance(texts[0], tuple) else ""))
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_normalized_text(spark):
    got = values(spark, ["  Química--Sanguínea (6) ", "STRASSE ß æ", "", "!!"], T.norm_text("a"))
    assert got == ["quimica sanguinea 6", "strasse ss ae", "", ""]


def test_similarities_match_the_documented_examples(spark):
    pair = [("word", "two words")]
    assert abs(values(spark, pair, T.trgm_similarity("a", "b"))[0] - 0.363636) < 1e-5
    assert abs(values(spark, pair, T.trgm_word_similarity("a", "b"))[0] - 0.8) < 1e-6


def test_word_similarity_with_repeated_trigrams_equals_brute_force(spark):
    def grams(text):
        return [("  " + w + " ")[i:i + 3] for w in text.split() for i in range(len(w) + 1)]

    def best(a, b):
        needle, hay = set(grams(a)), grams(b)
        return max(len(needle & set(hay[i:j])) / len(needle | set(hay[i:j])) for i in range(len(hay)) for j in range(i + 1, len(hay) + 1))

    pairs = [("banana", "anana banana ana"), ("ring", "small ring"), ("la la", "la lala la"), ("gear", "bolt")]
    got = values(spark, pairs, T.trgm_word_similarity("a", "b"))
    for (a, b), value in zip(pairs, got):
        assert abs(value - best(a, b)) < 1e-6, (a, b)


def test_prices(spark):
    texts = ["$250.00", "MXN 1,299.50", "$1,500", "sin costo", "1.234,5", "1.234", "12,5", "$9,999,999"]
    assert values(spark, texts, N.price_minor("a")) == [25000, 129950, 150000, None, 123450, 123400, 1250, 999999900]
    assert values(spark, ["$1,000 hoy $900.50", "$0 $5"], N.dollar_prices("a")["online"]) == [90050, None]


def test_token_scores(spark):
    pairs = [("glucosa", "glucosa"), ("hemog", "hemograma"), ("trigliceridos", "triglicerdos"), ("glucoas", "glucosa"),
             ("elcetro", "electrocardiograma"), ("orina", "orinas"), ("vitamina12", "vitamina13"), ("abc", "abd")]
    assert values(spark, pairs, S.token_score("a", "b")) == [100, 80, 62, 0, 50, 0, 0, 0]


def test_qualifiers(spark):
    pairs = [("t4 libre", "t3 libre"), ("bilirrubina total", "bilirrubina libre total"), ("insulina", "insulina basal")]
    assert values(spark, pairs, S.preserves_qualifiers("a", "b")) == [False, False, True]


def test_intent_and_redaction(spark):
    assert values(spark, ["Análisis de sangre", "orina", "sangre oculta"], S.specimen_intent(T.norm_text("a"))) == ["blood", "urine", None]
    got = values(spark, ["GET https://a.b/c?token=1 failed\nBearer abc", "x?api_key=9&y=1"], H.redact_text("a"))
    assert got == ["GET [REDACTED] failed Bearer [REDACTED]", "x?api_key=[REDACTED]&y=1"]


def test_deep_json_is_kept_whole(spark):
    deep = "[" * 40 + "1" + "]" * 40
    rows = spark.createDataFrame([('{"a":{"refresh_token":"x","b":[1]}}',), (deep,), ("nope",)], "payload string")
    got = [r[0] for r in H.redact_json(rows, "payload").collect()]
    assert got[0] == '{"a":{"b":[1],"refresh_token":"[REDACTED]"}}' and got[1] == deep and got[2] is None


def test_label_context_rules(spark):
    rows = spark.createDataFrame([("Rx abdomen de pie",), ("Rx pie derecho",), ("TAC simple y contrastada",), ("Factores VIII",), ("sin contraste",)], "x string")
    facts = {(r.nl, r.dimension, r.value) for r in L.label_attributes(rows, "x").collect()}
    assert ("rx abdomen de pie", "anatomy", "foot") not in facts and ("rx pie derecho", "anatomy", "foot") in facts
    assert {v for n, d, v in facts if n.startswith("tac") and d == "contrast"} == {"with", "without"}
    assert ("factores viii", "coagulation_factor_literal", "viii") in facts
    assert {v for n, d, v in facts if n == "sin contraste" and d == "contrast"} == {"without"}


def test_mojibake(spark):
    assert values(spark, ["ClÃ­nica", "Clínica", "âœ", None], T.repair_text("a"))[:2] == ["Clínica", "Clínica"]


def test_digest_ignores_order(spark):
    a = spark.range(100).repartition(7)
    assert H.table_digest(a).collect() == H.table_digest(spark.range(100).orderBy(F.desc("id"))).collect()


def test_initials_come_from_one_pass_over_the_text(spark):
    texts = ["biometria hematica completa", "analisis de la sangre", "t4 libre", "estado entre los dos", "vitamina12 abc", "", "de la", "conde unas unase"]
    expected = ["bhc", "as", "l", "ed", "a", None, None, "cuu"]
    assert values(spark, texts, T.initialism("a")) == expected
    assert values(spark, texts, T.initialism("a", 2, 2)) == [None, "as", None, "ed", None, None, None, None]
    plan = spark.createDataFrame([("x",)], "a string").select(T.initialism("a").alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_replace") == 1, plan
