import unicodedata

from prosopa.llm import confusables as c


def test_skeletons_of_lookalikes():
    same = [
        ("右獄理察所提舉", "右⽟理察所提舉".replace("⽟", "獄")),
        ("北百工樓", "北百エ樓"),
        ("料院", "料院"),
        ("（第2員）", "(第２員)"),
        ("Qiū Sī", unicodedata.normalize("NFD", "Qiū Sī")),
        ("Qiū Sī", "　Qiū Sī​"),
        ("八口", "ハロ"),
        ("B班", "Β班"),
        ("B班", "В班"),
        ("a·b", "a・b"),
        ("科醫", "科\U000e0101醫"),
    ]
    for a, b in same:
        assert c.skeleton_of(a) == c.skeleton_of(b), (a, b)
    for a, b in [("監", "鑒"), ("東", "东"), ("Qiū", "Qiu"), ("前房", "權前房"), ("abc", "abd")]:
        assert c.skeleton_of(a) != c.skeleton_of(b), (a, b)


def test_skeletons_of_the_public_table():
    for a, b in [("ꓐ", "B"), ("Ꭰ", "D"), ("Ꮃ", "W"), ("ⲟ", "o"), ("Ԛ", "Q"), ("rn", "m"), ("ϲ", "c"), ("к", "k"), ("㎏", "kg"), ("´", "'")]:
        assert c.skeleton_of(a) == c.skeleton_of(b), (a, b)
    assert len(c.public_table()) > 6000 and all(len(form) == 1 for form in c.SUPPLEMENT.values())


def test_table_as_sql():
    import duckdb

    sql = c.skeleton_sql("look", [ord(x) for x in "Ａ'ꓐa"])
    assert set(duckdb.sql(f"WITH {sql} SELECT c, s FROM look").fetchall()) == {("Ａ", "A"), ("ꓐ", "B")}


def test_skeleton_is_stable():
    for text in ["", " ​", "Αβγ…½ﬁ", "x" * 10_000, "権︀力"]:
        once = c.skeleton_of(text)
        assert c.skeleton_of(once) == once


def test_disguised_values(spark):
    values = spark.createDataFrame([("工部",), ("エ部",), ("エ部",), ("土部",), (None,), ("",), ("​",), ("工部 ",)], "v string")
    refs = spark.createDataFrame([("工部", 1), (None, 2), ("‍", 3)], "r string, v int")
    got = {tuple(r) for r in c.disguised(values, "v", refs, "r").collect()}
    assert got == {("エ部", "工部"), ("工部 ", "工部")}
    assert c.disguised(values.limit(0), "v", refs, "r").count() == 0
    one = {r.v: r.form for r in c.with_one_form(values, "v", refs, "r", "form").where("v is not null").collect()}
    assert one["エ部"] == "工部" and one["土部"] == "土部"


def test_disguised_by_key(spark):
    values = spark.createDataFrame([(1, 7, "エ"), (2, 8, "エ"), (3, 7, "工"), (4, None, "エ"), (5, 7, None)], "k int, p long, v string")
    refs = spark.createDataFrame([(7, "工"), (7, "別"), (7, "工"), (8, "口"), (None, "工")], "p long, r string")
    assert [tuple(r) for r in c.disguised_by_key(values, ["k"], "v", refs, "p", "r").collect()] == [(1, "工")]


def test_skeleton_classes(spark):
    df = spark.createDataFrame([("カ",), ("力",), ("力",), ("刀",), (None,)], "v string")
    got = {tuple(r) for r in c.skeleton_classes(df, "v").collect()}
    assert got == {("カ", "カ", 2, 1), ("力", "カ", 2, 2), ("刀", "刀", 1, 1)}
