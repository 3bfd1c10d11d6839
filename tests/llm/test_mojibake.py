from shobdo.llm.mojibake import CHAINS, garble, garbled_forms, garbled_records, restore_token, restored_texts

CLEAN = ["আমি ভাত খাই।", "বাংলা ভাষা", "café résumé naïve", "Привет 25°C ½ kg §4 Ångström", "ভালো 🔥 ‘ঠিক’"]


def test_signs_restore_every_lossless_chain():
    for word in ("আমি", "খাই।", "🔥", "’"):
        for chain in CHAINS:
            g = garble(word, chain)
            if "�" in g:
                continue
            assert restore_token(g)[:2] == (word, True), (word, chain, g)


def test_meant_letters_are_left():
    for word in ("café", "NAÏVE", "Ångström", "ÀÉÎ", "25°C", "½", "€20", "Привет", "спасибо", "АССЕЅЅ", "আমি", "São"):
        assert restore_token(word)[1] is False, word


def test_records(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN)]
    rows += [(10, garble("আমি ভাত", ("cp1252",))), (11, "ভাত" + garble("।", ("latin-1",))), (12, "শেষ�"), (13, None), (14, ""), (15, garble("ভাষা", ("cp1252?",)) + " xyz"), (10, garble("আমি ভাত", ("cp1252",)))]
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], "record_id long, text string, core string, form string")
    assert {r.record_id for r in garbled_records(df).collect()} == {10, 11, 12, 15}
    back = {r.record_id: (r.text, r.n_lost) for r in restored_texts(df).collect()}
    assert back[10] == ("আমি ভাত", 0) and back[11] == ("ভাত।", 0) and back[12] == ("শেষ�", 1)
    assert back[15] == ("ভাষা xyz", 0)  # lost bytes, regained because the word is in the corpus
    assert garbled_records(df.limit(0)).count() == 0
    assert garbled_forms(df).where("original is null").count() == 0


def test_rows_are_found_by_the_join(spark, monkeypatch):
    """Without the table of forms most rows are lost: the table of signs alone answers for no word of the corpus."""
    from pyspark.sql import functions as F
    from shobdo.llm import mojibake

    words = ["আমি", "ভাত", "খাই", "বাংলা", "ভাষা", "লেখা", "পড়ি", "নতুন", "কাজ", "দেখল"]
    rows = [(i, " ".join(words)) for i in range(3)]
    rows += [(10 + i, "x " + garble(w, c) + " y") for i, (w, c) in enumerate((w, c) for w in words for c in (("cp1252",), ("mac_roman",), ("cp1252?",)))]
    rows += [(100, garble("লেপ", ("cp1252",))), (101, "fiancé" + garble("লা", ("latin-1",)))]  # of pieces that words have
    rows += [(200, "ВIКЕ\xa0bіkе\xa0ভাত"), (201, "Привет"), (202, "В\xa0নতুন")]  # meant as they stand
    df = spark.createDataFrame(rows, "record_id long, text string")
    by = {r.record_id: r.by for r in mojibake.garbled_tokens(df).collect()}
    assert set(by) == {r[0] for r in rows if 10 <= r[0] < 200}
    assert by[10] == "word" and by[100] == "piece" and by[101] == "piece" and "sign" not in by.values()
    monkeypatch.setattr(mojibake, "garbled_forms", lambda records: spark.createDataFrame([], "form string, original string"))
    left = {r.record_id for r in mojibake.garbled_tokens(df).where(~F.col("by").isin("sign")).collect()}
    assert left <= {r[0] for r in rows if "\ufffd" in r[1]}
