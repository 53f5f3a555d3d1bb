import random
import zlib

from augsearch.llm.langid import FEATURES, fit, held_out, identify, query


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: (r.lang, len(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = query(spark, d).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    long = [r for r in rows if r.held_out and lang[r.doc_id][1] >= 100]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in long) / len(long) > 0.97


def test_defined_cases(spark):
    en, de = "the and of this that with from have been ", "der die und das nicht ein ist auch werden "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de", "x") for i in range(200)]
    rows += [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 $%", "en", "x"), (1003, de * 20_000, None, "x"), (None, en, None, None), (5, en * 3, "en", "x"), (1004, "𝒜𐐀", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1000, 1001, 1002))
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "en" and by[1004].lang_pred in ("en", "de")
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None and r.doc_id < 200)
    assert identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in identify(df.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_sample_stays_in_a_task(spark, monkeypatch):
    """The model alone comes to the driver, not the rows that it is fitted on."""
    r = random.Random(3)
    rows = [(i, "".join(chr(r.randrange(0x4E00, 0x5600)) for _ in range(1000)) + " the and of" * (i % 2), "en" if i % 2 else "zh") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    came = []
    monkeypatch.setattr(type(df), "toArrow", lambda self, to=type(df).toArrow: came.append(to(self)) or came[-1])
    model = fit(df, ~held_out())
    assert model.labels == ["en", "zh"] and model.weights.shape == (2, FEATURES) and model.temperature >= 1
    assert model.predict(["the and of the and of"])[0] == ["en"]
    # frequencies (16 bytes a feature) and weights (4 bytes a feature and label); the sample's counts are 8 bytes for each of 2000 n-grams of each text
    assert len(came) == 2 and sum(x.nbytes for x in came) < 24 * FEATURES + 1000
