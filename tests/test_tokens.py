from pyspark.sql import functions as F

from plantscope.functions import tokens
from plantscope.session import local_table


def column_of(spark, cells, expr):
    df = local_table(spark, list(enumerate(cells)), "id int, raw string")
    return [r[0] for r in df.orderBy("id").select(expr(F.col("raw"))).collect()]


def test_null_words_in_any_case_and_with_unicode_spaces(spark):
    cells = [w for word in tokens.NULL_WORDS for w in (word, word.lower(), f" {word}\t", f" {word}　")] + ["", "  ", None]
    assert set(column_of(spark, cells, tokens.null_tokens)) == {None}


def test_other_text_is_only_trimmed(spark):
    assert column_of(spark, [" a b ", "n.a.", "nanometre", "---"], tokens.null_tokens) == ["a b", "n.a.", "nanometre", "---"]


def test_parse_words_are_exact(spark):
    assert column_of(spark, ["null", "nUll", " NA", "NA ", "-"], tokens.parse_nulls) == [None, "nUll", None, "NA ", None]


def test_numbers(spark):
    cells = ["1,234.5", "−3", " 7 ", ".5", "5.", "1e3", "+2", "1d", "inf", "nan", "1.2.3", "", "--", "12f", None]
    want = [1234.5, -3.0, 7.0, 0.5, 5.0, 1000.0, 2.0] + [None] * 8
    assert column_of(spark, cells, tokens.to_number) == want


def test_lenient_numbers(spark):
    cells = ["1.234.567", "12 kg", "3 400", "-5", "5-", "abc", "1,000.5"]
    assert column_of(spark, cells, tokens.to_number_lenient) == [1234567.0, 12.0, 3400.0, -5.0, None, None, 1000.5]


def test_missing_stages(spark):
    cells = [None, " ", "None", "_", "#DIV/0!", "#n/a", "#SPILL!", "#Unknown!", "ok", "0"]
    assert column_of(spark, cells, tokens.missing_stage) == [1, 1, 1, 1, 2, 2, 3, 3, 0, 0]
