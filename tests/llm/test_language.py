from larkspur.llm import language
from larkspur.llm.kit import bucket


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(odd, none):
    rows = language.predictions(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 8))
    assert by[0].lang_pred == by[1].lang_pred and by[0].score == by[1].score
    assert by[7].lang_pred != "und"
    assert language.predictions(none).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id BIGINT, text STRING, lang STRING")
    assert language.predictions(df).first().lang_pred == "und"


def test_held_out_labels_are_not_learned_from(spark, documents):
    from pyspark.sql import functions as F

    changed = documents.withColumn("lang", F.when(bucket("doc_id", 5) == 0, "xx").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.predictions(d).collect()} for d in (documents, changed))
    assert a == b


def test_whole_text_counts():
    en, fr = "the cat sat on the mat with the other cat " * 40, "le chat et la souris sont dans la maison avec les autres " * 40
    model = language.Classifier({"en": language.normalised(en), "fr": language.normalised(fr)}, {"en": 2, "fr": 1})
    assert model.classify(en)[0] == "en" and model.classify("le chat dans la maison")[0] == "fr"
    assert model.classify("the cat " + fr * 30)[0] == "fr"
    assert model.classify("THE CAT!! SAT!! ON!! THE!! MAT!!")[0] == "en"
    assert model.classify("zzqq")[:2] == ("en", model.classify("zzqq")[1]) and model.classify("zzqq")[2]


def test_every_language_is_learned_also_without_ids(spark):
    """200 languages, one of 800 rows without an id and one of as many copies of one text."""
    import random

    rng = random.Random(4)
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26) + rng.choice("aeiou") + rng.choice("klmnst")
    rows = [(None, " ".join(word(0) for _ in range(30)), "l0") for _ in range(800)]
    rows += [(None, "always the same words zzyzx", "same")] * 800
    rows += [(i * 10 + j, " ".join(word(i) for _ in range(30)), f"l{i}") for i in range(1, 200) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    model = language.learn(df)
    assert set(model.dictionaries) == {f"l{i}" for i in range(200)} | {"same"}
    assert sum(model.classify(" ".join(word(i) for _ in range(30)))[0] == f"l{i}" for i in range(200)) >= 196


def test_dictionaries_hold_whole_texts(spark):
    rows = [(i, f"text{'abcdefgh'[i]} " * 20, "en") for i in range(8)] + [(9, "long " * 400, "fr"), (10, "longer " * 400, "fr")]
    model = language.learn(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), capacity=500)
    parts = {language.normalised(t) + b" " for _, t, _ in rows}
    data = model.dictionaries["en"]
    assert len(data) <= 500 and data == b"".join(p for p in sorted(parts, key=data.find) if data.find(p) >= 0) and len(data) >= 450
    assert model.dictionaries["fr"] == language.normalised("long " * 400) + b" "


def test_only_letters_and_their_marks_are_kept():
    assert language.normalised("Ab1c—d٣é\u0301 日本。«x» ½ हिन्दी") == "ab c d é\u0301 日本 x हिन्दी".encode()
    assert language.normalised("A1b, c_d") == b"a b c d"


def test_predictions_against_a_plain_loop(spark, documents):
    """The query against a loop over all texts with one-shot compressors of the same dictionaries."""
    import math

    import zstandard

    model = language.learn(documents, held_out=bucket("doc_id", 5) == 0)
    got = {r.doc_id: r for r in language.predictions(documents).collect()}
    for d in documents.limit(60).collect():
        data = language.normalised(d.text or "")
        size = {}
        for name in model.names:
            raw = zstandard.ZstdCompressionDict(model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, source_size=language.BLOCK, dict_size=len(raw.as_bytes()), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=raw).compress(b"0" * 32 + data[i : i + language.BLOCK])) for i in range(0, len(data), language.BLOCK))
        if not any(map(str.isalpha, d.text or "")):
            assert got[d.doc_id].lang_pred == "und"
            continue
        best = min(model.names, key=lambda n: (size[n], -model.rows[n], n))
        score = 1 / sum(math.exp(-0.5 * min(120, s - size[best])) for s in size.values())
        assert got[d.doc_id].lang_pred == best and abs(got[d.doc_id].score - score) < 1e-9
