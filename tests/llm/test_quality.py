import numpy as np

from prosopa.llm import quality as q

PROSE = "The school should be opened by their mayor, until the\nmarket was declared near our river. Her late engine\nwould be repaired for that library. Every large mill\nwas visited after the storm."
LIST = "1. Large surveyor\n2. Public ferry\n3. Old harvest\n4. Heavy mill\n5. Serious engine"
NAMES = "Lunzagate, Grevabury; Risvamund.\nGrevaster, Sedzaton; Ithawick.\nVorniwen, Sedzaley; Falziwen."
TABLE = "Askuton         827   1008     96     70\nIthaford        551    801   1080   1054\nVorniric        914     50    273    388"
JUNK = "whhj bql th\ncktvmw gxzwhtc bzdnd\njxft qflxlj\n;./j§,°§;l^«  •~;"
SCHEMA = "doc_id long, text string, lines int"


def kinds(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in q.quality(df).collect()}


def test_kinds(spark):
    got = kinds(spark, [PROSE, LIST, TABLE, JUNK, NAMES, "", None, " \n\n", PROSE + "\n" + LIST])
    assert [got[i].kind for i in range(6)] == ["prose", "list", "table", "junk", "list", None]
    assert 6 not in got and got[7].lines == 0 and got[8].kind == "list" and got[0].language == "en"
    assert got[8].lines == 9 and got[8].other_share == 5 / 9


def test_basic_counts(spark):
    r = kinds(spark, ["ab cde.\n\nfgh, ij§"])[0]
    assert (r.lines, r.words, r.ends_in_stop) == (2, 4, 0.5)
    assert abs(r.mean_word_length - 13 / 4) < 1e-9 and abs(r.symbol_ratio - 1 / 13) < 1e-9


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, PROSE, 0), (1, PROSE, 1), (1, LIST, 0), (None, LIST, 0)], SCHEMA)
    assert q.quality(df).count() == 2
    assert q.quality(df.limit(0)).count() == 0


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    texts = [PROSE, "\n".join([LIST, PROSE, "", " ", TABLE, NAMES] * 20), "x" * 3000, "", TABLE, "\n\n" + JUNK * 9]
    whole = q.judge(texts)
    for size in (40, 200, 1000):
        monkeypatch.setattr(q, "CHUNK", size)
        out = np.zeros_like(whole)
        for where, group, spans in q._pieces(texts):
            np.add.at(out, where, q.judge(group, spans=spans))
        assert (out == whole).all()


def test_profiles_fit_labelled_pages(spark):
    pages = [(PROSE, "prose"), (LIST, "list"), (TABLE, "table"), (JUNK, "junk")] * 30
    fitted = q.fit_profiles([t for t, _ in pages] + [None, "x"], [k for _, k in pages] + ["list", "other"])
    rough = q.rough_profiles()
    assert all(np.allclose(fitted[lang][k].sum(axis=1), 1) for lang in q.LANGUAGES for k in q.KINDS)
    moved = [abs(fitted["en"][k] - rough["en"][k]).max() for k in q.KINDS]
    assert min(moved) > 0.01 and (fitted["fr"]["prose"] == rough["fr"]["prose"]).all()
    assert q.fit_profiles([], [])["de"]["junk"].tolist() == rough["de"]["junk"].tolist()
    docs = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(pages)] + [(None, "x", 0), (999, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, k) for i, (_, k) in enumerate(pages)] + [(None, "list"), (3, None), (999, "list")], "doc_id long, page_kind string")
    texts, kinds = q.labelled_sample(docs, labels, pages=8)
    assert len(texts) == 8 and kinds == ["prose", "list", "table", "junk"] * 2
    assert q.labelled_sample(docs, labels.limit(0)) == ([], [])


def test_texts_without_gaps_or_words():
    for text in ["a", "é", "§", "word", " ", "1", "a b", ". .", "|"]:
        assert q.judge([text])[0][0] == (text != " ")
    assert (q.judge(["word", PROSE])[1] == q.judge([PROSE])[0]).all()
