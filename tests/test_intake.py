import pytest
from pyspark.sql import functions as F

from plantscope.operators import cleaning, profile
from plantscope.session import local_table, scratch_path
from plantscope.sources import tables


def classes(spark, columns, **options):
    names = list(columns)
    rows = list(zip(*columns.values()))
    df = local_table(spark, rows, ", ".join(f"`{n}` string" for n in names))
    return {r["column"]: r["sub_category"] for r in profile.column_classes(df, **options).collect()}


def test_column_classes(spark):
    n = 40
    columns = {
        "nothing": [None] * n,
        "mark": ["O", "x", None, "-"] * 10,
        "whole": [f"{i},000" for i in range(n)],
        "real": [f"{i}.5" for i in range(n)],
        "most_numbers": ["bad"] * 4 + [str(i) for i in range(36)],
        "too_few_numbers": ["bad"] * 5 + [str(i) for i in range(35)],
        "iso": ["2024-1-5"] * n,
        "mixed_dates": ["2024-1-5", "2024/1/5"] * 20,
        "minutes": ["2024/01/05 7:30"] * n,
        "korean": ["2024년1월5일 오전"] * n,
        "group": ["a", "b"] * 20,
        "free": [f"t{i}" for i in range(n)],
        "day": [str(45000 + i) for i in range(n)],
    }
    assert classes(spark, columns) == {
        "nothing": "empty", "mark": "boolean", "whole": "integer", "real": "real", "most_numbers": "integer",
        "too_few_numbers": "text", "iso": "date", "mixed_dates": "category", "minutes": "date", "korean": "date",
        "group": "category", "free": "text", "day": "integer",
    } | {"mixed_dates": "date"}  # both forms match the loose year.month.day prefix
    assert classes(spark, {"day": columns["day"]}, serial_dates_first=True) == {"day": "date"}
    assert classes(spark, {"day": columns["day"]}, identifiers_first=True) == {"day": "identifier"}


def test_cast_by_class_agrees_with_the_label(spark):
    df = local_table(spark, [("1", "O"), ("2,5", "X"), (None, None)], "a string, b string")
    typed = profile.cast_by_class(df, profile.column_classes(df))
    assert dict(typed.dtypes) == {"a": "bigint", "b": "string"}
    assert [tuple(r) for r in typed.collect()] == [(1, "1"), (25, "0"), (None, None)]


def test_boolean_columns_keep_their_nulls(spark):
    df = local_table(spark, [("o", 1.0, "a"), (None, None, "b"), ("X", 0.0, "1")], "m string, n double, t string")
    out = cleaning.normalize_boolean(df, ["m", "n", "t"]).collect()
    assert [tuple(r) for r in out] == [("1", "1", "a"), (None, None, "b"), ("0", "0", "1")]


def test_header_roles(spark):
    df = local_table(spark, [(1.0, 2.0, "a", 3)], "`Yield (varY)` double, `Temp (varX)` double, ` Mode (varX) ` string, other int")
    df = tables.trim_column_names(df)
    found = cleaning.roles_from_header(df, cleaning.numeric_columns(df), ["Mode (varX)"])
    assert (found.roles.y, found.roles.x_numeric, found.roles.x_categorical) == ("Yield", ("Temp",), ("Mode",))
    assert cleaning.apply_header_roles(df, found).columns == ["Yield", "Temp", "Mode"]
    with pytest.raises(ValueError):
        cleaning.roles_from_header(df.withColumn("b (varY)", F.lit(1)), ["Yield (varY)"], [])
    with pytest.raises(ValueError):
        cleaning.roles_from_header(df, [], [])
    assert cleaning.roles_from_header(df.select("other"), ["other"], []) is None


def test_roles_are_checked(spark):
    df = local_table(spark, [(1.0, "a")], "y double, c string")
    with pytest.raises(ValueError):
        cleaning.select_roles(df, cleaning.Roles("y"))
    with pytest.raises(ValueError):
        cleaning.select_roles(df, cleaning.Roles("c", ("y",)))
    with pytest.raises(ValueError):
        cleaning.gate_numeric(df, ["c"])


@pytest.mark.parametrize("rows_per_bucket", [1000, 4])
def test_fill_forward_over_bucket_edges(spark, rows_per_bucket):
    values = [None, None, 3.0, None, 5.0] + [None] * 12 + [8.0, None]
    df = local_table(spark, list(enumerate(values)), "t int, v double").repartition(3)
    out = cleaning.fill_forward(df, "v", "t", rows_per_bucket=rows_per_bucket).orderBy("t")
    assert [r["v"] for r in out.collect()] == [0.0, 0.0, 3.0, 3.0] + [5.0] * 13 + [8.0, 8.0]


def test_encoding_is_found_from_the_whole_file(spark):
    from pathlib import Path

    def written(text: str, encoding: str) -> str:
        path = scratch_path(spark, "enc") + ".csv"
        Path(path).write_bytes(text.encode(encoding))
        return path

    korean = "이름,값\n" + "plain,1\n" * 500 + "공정,2\n"
    assert tables.detect_encoding(spark, written(korean, "utf-8")) == "utf-8"
    assert tables.detect_encoding(spark, written(korean, "utf-8-sig")) == "utf-8"
    assert tables.read_csv(spark, written(korean, "utf-8-sig")).columns == ["이름", "값"]
    df, encoding = tables.read_csv_any_encoding(spark, written(korean, "cp949"))
    assert encoding == "cp949" and df.columns == ["이름", "값"] and df.where("`이름` = '공정'").count() == 1


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = local_table(spark, [(i, str(i % 7)) for i in range(50)], "a int, b string")
    first = tables.fingerprint(df).first()
    assert first == tables.fingerprint(df.orderBy(F.desc("a")).repartition(3)).first()
    assert first != tables.fingerprint(df.withColumn("a", F.col("a") + (F.col("a") == 3).cast("int"))).first()


def test_cleaned_name():
    assert tables.cleaned_name("plant.data.xlsx") == "plant.data_cleaned.csv"
    assert tables.cleaned_name("plant") == "plant_cleaned.csv"


def test_fill_forward_on_large_keys_ties_and_text(spark):
    from plantscope.operators import cleaning

    big = 2**53
    rows = [(big + i, f"k{i:03}", float(i) if i % 3 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "t long, name string, v double").repartition(5)
    want = {big + i: float(i - i % 3) for i in range(60)}
    for key in ("t", "name"):
        got = cleaning.fill_forward(df, "v", key, rows_per_bucket=7)
        assert {r["t"]: r["v"] for r in got.collect()} == want
    tied = spark.createDataFrame([(1, i, None if i % 2 else float(i)) for i in range(100)], "t long, n int, v double")
    got = {r["n"]: r["v"] for r in cleaning.fill_forward(tied, "v", "t", tie_break=["n"], rows_per_bucket=10).collect()}
    assert got == {i: float(i - i % 2) for i in range(100)}


def test_long_integers_stay_exact(spark):
    from plantscope.operators import profile

    df = spark.createDataFrame([("9007199254740993",), ("9,007,199,254,740,995",), ("12.0",)], "lot string")
    classes = spark.createDataFrame([("lot", True, "integer")], "column string, is_numeric boolean, sub_category string")
    assert [r["lot"] for r in profile.cast_by_class(df, classes).collect()] == [9007199254740993, 9007199254740995, 12]


def test_quoted_quotes_and_line_breaks(spark, tmp_path):
    from plantscope.sources import tables

    (tmp_path / "notes.csv").write_text('id,note\n1,"He said ""hi"", ok"\n2,"two\nlines"\n3,plain\n')
    got = {r["id"]: r["note"] for r in tables.read_csv(spark, str(tmp_path / "notes.csv")).collect()}
    assert got == {"1": 'He said "hi", ok', "2": "two\nlines", "3": "plain"}


def test_single_line_reading_splits_a_large_file(spark, tmp_path):
    from plantscope.sources import tables

    path = tmp_path / "big.csv"
    path.write_text("id,note\n" + "".join(f'{i},"say ""{i}"""\n' for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = tables.read_csv(spark, str(path), multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 200_000 and {r["note"] for r in got[:3]} <= {f'say "{i}"' for i in range(200_000)}
    assert tables.read_csv(spark, str(path)).rdd.getNumPartitions() == 1
