import unicodedata
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import decompose as D
from recordloom.functions import similarity as S
from recordloom.functions import text as T
from recordloom.vocab import DEFAULT, Vocabulary, bare


def one(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_normalize(spark):
    cases = {
        "PT nội soi cắt TLT": "phẫu thuật nội soi cắt tiền liệt tuyến",
        "SA ổ bụng": "siêu âm ổ bụng",
        "Phẫu thuật sa tử cung": "phẫu thuật sa tử cung",
        "sa tử cung": "siêu âm tử cung",
        "ĐM/TM": "động mạch và tĩnh mạch",
        "CS vết thương": "chăm sóc vết thương",
        "Mổ đẻ": "phẫu thuật lấy thai",
        "PT mổ đẻ": "phẫu thuật lấy thai",
        "***": "",
        None: "",
        "Đặt NKQ (cấp cứu)": "đặt ống nội khí quản cấp cứu",
    }
    got = one(spark, [(k,) for k in cases], "x string", y=T.normalize(F.col("x"), DEFAULT))
    assert [r["y"] for r in got] == list(cases.values())


def test_folding(spark):
    got = one(spark, [("Đường TRÀNG",), ("é", ), (None,)], "x string", y=T.keyword(F.col("x")), z=T.clean_lite(F.col("x")))
    assert [r["y"] for r in got] == ["duong trang", "e", ""]
    assert got[0]["z"] == "đường tràng"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abcdđeéê ạ-/.", max_size=20), min_size=1, max_size=20))
def test_lite_is_stable(spark, xs):
    clean = [r["y"] for r in one(spark, [(x,) for x in xs], "x string", y=T.clean_lite(F.col("x")))]
    again = [r["y"] for r in one(spark, [(x,) for x in clean], "x string", y=T.clean_lite(F.col("x")))]
    assert clean == again


def test_tokens_fall_back_to_single_letters(spark):
    assert [r["y"] for r in one(spark, [("a bc d",), ("a b",), ("",)], "x string", y=T.tokens(F.col("x")))] == [["bc"], ["a", "b"], []]


def test_word_boundaries(spark):
    got = one(spark, [("phẫu thuật mở",), ("x mo mo y",)], "x string", a=T.has(F.col("x"), "mở|mo mo"), u=T.has(F.col("x"), "mở|mo mo", ascii_words=False))
    assert [(r["a"], r["u"]) for r in got] == [(False, True), (True, True)]


def test_highlight(spark):
    got = one(spark, [("Khâu Mắt trái", "mat")], "n string, q string", y=T.highlight(F.col("n"), F.col("q")))
    assert [t.hit for t in got[0]["y"]] == [False, True, False]


def test_chapter_headers(spark):
    rows = [("IX. Tai mũi họng", "", ""), ("Ngoại khoa", "II", ""), ("Chương 3 Mắt", "", ""), ("Khâu da", "12", "01.02"), ("SAU SINH", "", ""), ("Khâu da", "12", ""), ("A. Nội khoa", "", "")]
    got = one(spark, rows, "n string, t string, c string", y=T.chapter_header(F.col("n"), F.col("t"), F.col("c"), F.lit(False), DEFAULT.specialties))
    assert [r["y"] for r in got] == ["IX. Tai mũi họng", "II. Ngoại khoa", "Chương 3 Mắt", None, "SAU SINH", None, "A. Nội khoa"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", max_size=12), st.text("abcd", max_size=12)), min_size=1, max_size=30))
def test_similarities(spark, pairs):
    got = one(spark, pairs, "a string, b string", lev=S.levenshtein_ratio(F.col("a"), F.col("b"), 0.35), seq=S.sequence_ratio(F.col("a"), F.col("b")))
    for (a, b), r in zip(pairs, got, strict=True):
        assert 0 <= r["lev"] <= 1 and (r["lev"] == 1) == (a == b)
        if a and b and abs(len(a) - len(b)) <= 0.65 * max(len(a), len(b)):
            assert r["seq"] == SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_barriers(spark):
    rows = spark.createDataFrame([("khâu rách âm hộ", "khâu bờ mi"), ("cắt gan", "cắt túi mật"), ("khâu", "khâu da"), ("chụp phổi", "chụp màng phổi")], "a string, b string")
    a = D.decompose(rows.select("a"), "a", DEFAULT).select("a", F.col("anatomy").alias("aa"), F.col("category").alias("ac"))
    b = D.decompose(rows.select("b"), "b", DEFAULT).select("b", F.col("anatomy").alias("ba"), F.col("category").alias("bc"))
    got = {r.a: r.s for r in rows.join(a, "a").join(b, "b").select("a", D.anatomy_status(F.col("aa"), F.col("ba"), F.col("ac"), F.col("bc")).alias("s")).collect()}
    assert got == {"khâu rách âm hộ": "SEVERE_CONFLICT", "cắt gan": "SAME_ORGAN_SYSTEM", "khâu": "GENERIC", "chụp phổi": "EXACT_MATCH"}


def test_removal_keeps_the_second_of_adjacent_terms(spark):
    got = D.decompose(spark.createDataFrame([("cắt gan gan x",)], "t string"), "t", DEFAULT).first()
    assert got.rest == "cắt gan x" and got.modality == "SURGERY"


def test_empty_vocabulary(spark):
    got = D.decompose(spark.createDataFrame([("abc",), ("",)], "t string"), "t", Vocabulary()).collect()
    assert [(r.anatomy, r.modality, r.core) for r in got] == [([], None, "abc"), ([], None, "")]


def test_bare():
    assert bare("đường") == "duong" and unicodedata.is_normalized("NFC", bare("ệ"))
