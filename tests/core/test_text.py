import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "function, value, want",
    [
        (T.normalize, " \t x y\n　", "x y"),
        (T.normalize, None, ""),
        (T.search_form, " ÀB ", "àb"),
        (T.ascii_lower, "ÀB", "Àb"),
        (T.collapse, " a  \n b ", "a b"),
        (T.labelize, "repair_log", "Repair Log"),
        (T.labelize, "iOS", "IOS"),
        (T.labelize, "", "Not set"),
        (T.base_name, "/a/b.c/d.PDF", "d.PDF"),
        (T.extension, "a.b.Pdf", ".Pdf"),
        (T.extension, ".profile", ""),
        (T.title_from_filename, "x/front_brake--pads v2.pdf", "front brake pads v2"),
        (T.title_from_filename, "___.pdf", "Untitled Document"),
        (T.title_from_filename, None, "document"),
        (T.safe_filename, "My <Report>: v1?.pdf", "My-Report-v1-.pdf"),
        (T.safe_filename, "con.txt", "con-file.txt"),
        (T.safe_filename, "A.PDF", "A.PDF.pdf"),
        (T.safe_filename, "", "document"),
        (T.mime_type, "a.PDF", "application/pdf"),
        (T.extraction_class, None, "not_attempted"),
        (T.extraction_class, "failed: x", "failed"),
        (T.extraction_class, "new", "other"),
        (T.display_time, "2024-03-05 15:07:00", "Mar 5, 2024, 3:07 PM"),
        (T.display_time, "soon", "Not available"),
        (T.positive_id, "12", 12),
        (T.positive_id, "1.5", None),
        (T.positive_id, "-3", None),
    ],
)
def test_scalars(spark, function, value, want):
    assert one(spark, function(F.lit(value).cast("string"))) == want


def test_wildcards_go_through_a_text_once(spark):
    import time

    text = spark.createDataFrame([("a" * 1_000_000,)], "t string")
    for query in ("%zq", "a%b", "%a%a%b%", "%zq%", "a_a%b"):
        start = time.perf_counter()
        assert text.filter(F.col("t").rlike(T.wildcard_pattern(query))).count() == 0
        assert time.perf_counter() - start < 20  # going back to every place would take over an hour
    like = lambda q, t: one(spark, F.lit(t).rlike(T.wildcard_pattern(q)))
    for q, t, want in [("%", "", True), ("%%", "x", True), ("_", "", False), ("_", "\n", True), ("a%b%a", "xaYbZa", True), ("ab%ba", "aba", False), ("ab%ba", "ABxBA", True), ("a_%_c", "abc", False), ("a_%_c", "abbc", True), ("%.%", "ab", False), ("\\%\\", "a\\b\\", True), ("É", "é", False)]:
        assert like(q, t) is want, (q, t)


def test_numbers_are_read_in_one_way(spark):
    cases = {"12": 12, " 7 ": 7, "3.0": 3, "+7.": 7, "1e2": 100, ".5e1": 5, "0x10": 16, "0b101": 5, "0o17": 15, "0X00000000000000000001": 1, "9007199254740993": 9007199254740992}
    bad = ["", " ", "1_0", "3d", "4f", "abc", "1.5", "-3", "0", "0x", "-0x10", "1e", "٣", "Infinity", "NaN", "1e300", "9223372036854775808", "0xFFFFFFFFFFFFFFFFFF", "1 2", "0x1p3", "1e999"]
    rows = spark.createDataFrame([(t,) for t in [*cases, *bad]], "t string").select("t", T.positive_id(F.col("t")).alias("id")).collect()
    assert {r.t: r.id for r in rows} == cases | dict.fromkeys(bad)
    for text, want in cases.items():
        assert T.number(text) == want
    assert T.number(None) != T.number(None) and T.number(True) == 1 and T.number(10**400) == float("inf") and T.number("") == 0


def test_lists(spark):
    array = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, T.distinct_values(array(" Engine", "ENGINE", "", "Body"))) == ["Engine", "Body"]
    assert one(spark, T.parse_list(F.lit('["a", 1, "A", "b"]'), ["x"])) == ["a", "b"]
    for bad in ("{", "[]", "", None, "3"):
        assert one(spark, T.parse_list(F.lit(bad).cast("string"), ["x"])) == ["x"]
    assert one(spark, T.parse_lines(F.lit("a\r\n b \n\nA"))) == ["a", "b"]
    assert one(spark, T.format_lines(array("a", "b"))) == "a\nb"
    assert one(spark, T.positive_ids(array("3", "x", "3", "-1", "2"))) == [3, 2]
    assert one(spark, T.toggle(array(1, 2), F.lit(2))) == [1] and one(spark, T.toggle(array(1), F.lit(2))) == [1, 2]
    assert one(spark, T.join_parts(F.lit(2012), F.lit(" Volvo "), F.lit(""), F.lit(None).cast("string"), F.lit("S"))) == "2012 Volvo S"


def test_links_and_sentences(spark):
    assert one(spark, T.entity_link(F.lit("note"), F.lit(4))) == "/notes?noteId=4#note-library"
    assert one(spark, T.entity_link(F.lit("car"), F.lit(4))) == one(spark, T.entity_link(F.lit("note"), F.lit(0))) == "/dashboard"
    assert one(spark, T.count_sentence(F.lit(1), F.lit(1), "symptom")) == "Showing all 1 symptom"
    assert one(spark, T.count_sentence(F.lit(2), F.lit(3), "symptom")) == "Showing 2 of 3 symptoms"


def test_codes(spark):
    value = T.enum_value(F.lit(" HIGH "), ["low", "high"], "low", "confidence")
    assert one(spark, value) == "high" and one(spark, T.enum_value(F.lit(""), ["low"], "low", "confidence")) == "low"
    with pytest.raises(Exception, match="unknown confidence"):
        one(spark, T.enum_value(F.lit("x"), ["low"], "low", "confidence"))


def test_stored_names(spark):
    assert one(spark, T.stored_filename(F.lit("My File.PDF"), F.lit("-17-abc0"))) == "My-File.PDF-17-abc0.pdf"


def test_requests():
    assert T.request({"q": " a ", "system": "", "n": 3, "sort": ["x"], "t": "\xa0"}) == {"q": "a"}


def test_distinct_values_of_long_lists(spark):
    values = [f" v{i % 700}" if i % 3 else f"V{i % 700} " for i in range(3000)]
    want, seen = [], set()
    for v in (x.strip() for x in values):
        if v.lower() not in seen:
            seen.add(v.lower())
            want.append(v)
    assert one(spark, T.distinct_values(F.array(*map(F.lit, values)))) == want
    assert one(spark, T.distinct_values(F.lit(None).cast("array<string>"))) == [] == one(spark, T.distinct_values(F.array(F.lit(" "), F.lit(None))))
