"""Text functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from cognatus.functions import text

A, B, C, D = ("a" * 40, "b" * 40, "c" * 40, "d" * 40)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("body", "clean"),
    [
        ("", ""),
        (None, ""),
        ("Only-by: x y", ""),
        ("A\nKey:\n", "a key:"),
        ("A  b\n\n[ rjw: x ]\n\nbug #12 foo", "a b"),
        ("A\nLink: u\nB", "a link: u b"),
        (f"Fix edge case in parser\n\nThis fixes an unhandled null dereference.\n\nSigned-off-by: Test User <test@example.com>\n(cherry picked from commit {A})\n",
         "fix edge case in parser this fixes an unhandled null dereference."),
        ("Öne two three\x0bKey: v", "öne two three"),
        ("x\r\n\r\nK: v\r\n", "x"),
    ],
)
def test_strip_trailers(spark, body, clean):
    assert one(spark, text.strip_trailers("x"), body) == clean


def test_normalize_diff(spark):
    diff = "diff --git a/f b/f\nindex 123abc..456def 100644\n--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@ ctx\n a\n+@@ -9 +9 @@ in text\n"
    assert one(spark, text.normalize_diff("x"), diff) == "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ ctx\n a\n+@@ in text"


@pytest.mark.parametrize(
    ("body", "sha"),
    [
        (f"Some commit message\n\n(cherry picked from commit {A})", A),
        ("plain", None),
        ("(cherry picked from commit abc1234)", None),
        (f"(cherry picked from commit {A.upper()}) (cherry picked from commit {B})", A),
        (f"(Cherry picked from commit {A})", None),
        (None, None),
    ],
)
def test_tag(spark, body, sha):
    assert one(spark, text.picked_from("x"), body) == sha


def test_patch_headers(spark):
    value = f"Git-commit: {A}\nalt-commit: <{B.upper()}>\nAlt-commit: [ {C} ]\nAlt-commit: abc\nX Git-commit: {D}\n"
    assert one(spark, text.header_shas("x", text.GIT_HEADER), value) == [A]
    assert one(spark, text.header_shas("x", text.ALT_HEADER), value) == [B, C]
    assert one(spark, text.header_shas("x", text.GIT_HEADER), f"Git-commit: {A}ff") == [A]


def test_small_functions(spark):
    assert one(spark, text.safe_long("x"), "12") == 12
    assert one(spark, text.safe_long("x"), "x") == 0
    assert one(spark, text.sha_text(text.sha_bytes("x")), A) == A
    sizes = [one(spark, text.human_size(F.col("x").cast("long")), v) for v in ("0", "1023", "1536", str(5 << 30), str(3 << 40))]
    assert sizes == ["0.00 B", "1023.00 B", "1.50 KB", "5.00 GB", "3.00 TB"]
    assert one(spark, text.normalize_phrase("x"), "  A\tB  c ") == "a b c"
