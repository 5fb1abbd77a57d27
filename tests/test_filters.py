import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tableprobe import Filter, FilterError
from tableprobe.operators import apply_filters, compile_filters, filters_from_request, parse_filter_entry


def ids(df, *filters, **options):
    return sorted(r.id for r in apply_filters(df, filters, **options).select("id").collect())


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Anna Żółw", 10, 1.5), (2, "ŻÓŁW", 20, float("nan")), (3, None, None, None), (4, "a.c", 30, 2.0), (5, "abc", -1, -0.5), (6, "", 7, float("inf"))],
        "id int, name string, n bigint, x double",
    )


def test_substring_is_case_sensitive_unless_told(people):
    assert ids(people, Filter("name", "żó")) == []
    assert ids(people, Filter("name", "Żó")) == [1]
    assert ids(people, Filter("name", "żó"), case_insensitive=True) == [1, 2]


def test_null_reads_as_token(people):
    assert ids(people, Filter("name", "null")) == [3]
    assert ids(people, Filter("name", "(NULL)"), case_insensitive=True) == [3]
    assert ids(people, Filter("n", "null")) == [3]
    assert ids(people, Filter("name", r"^\(null\)$"), use_regex=True) == [3]


def test_regex_and_its_fallback(people):
    assert ids(people, Filter("name", "a.c")) == [4]
    assert ids(people, Filter("name", "a.c"), use_regex=True) == [4, 5]
    assert ids(people, Filter("name", "^żó"), use_regex=True, case_insensitive=True) == [2]
    assert ids(people, Filter("name", "(a"), use_regex=True) == []
    assert ids(people, Filter("name", "^$"), use_regex=True) == [6]


def test_value_list_takes_nulls_and_empty_texts(people):
    assert ids(people, Filter("name", ("abc", "(null)", ""), "values")) == [3, 5, 6]
    assert ids(people, Filter("name", ("ABC", "(NULL)"), "values"), case_insensitive=True) == [3, 5]
    assert ids(people, Filter("n", ("10", "7"), "values")) == [1, 6]


@pytest.mark.parametrize(
    "entry, operator, expected",
    [("10", ">", [2, 4]), ("10.5", ">", [2, 4]), ("9.5", ">=", [1, 2, 4]), ("10.5", "<", [1, 5, 6]), ("10.5", "=", []),
     ("1e1", "=", [1]), ("-1", "<=", [5]), ("99999999999999999999", "<", [1, 2, 4, 5, 6]), ("99999999999999999999", ">", []),
     ("inf", "<", [1, 2, 4, 5, 6]), ("nan", ">", [])],
)
def test_integer_comparisons(people, entry, operator, expected):
    assert ids(people, Filter("n", entry, "number", operator)) == expected


@pytest.mark.parametrize(
    "entry, operator, expected",
    [("1", ">", [1, 4, 6]), ("1.5", ">=", [1, 4, 6]), ("0", "<", [5]), ("inf", "=", [6]), ("inf", "<", [1, 4, 5]),
     ("nan", "=", []), ("2", "=", [4])],
)
def test_float_comparisons_are_false_for_nan(people, entry, operator, expected):
    assert ids(people, Filter("x", entry, "number", operator)) == expected


def test_wide_unsigned_integers_are_compared_exactly(spark):
    df = spark.createDataFrame(
        [(1, Decimal(9223372036854775808)), (2, Decimal(12)), (3, Decimal(18446744073709551615))], "id int, u decimal(20,0)"
    )
    assert ids(df, Filter("u", "100", "number", ">")) == [1, 3]
    assert ids(df, Filter("u", "9223372036854775808", "number", ">")) == [3]
    assert ids(df, Filter("u", "9223372036854775807.5", "number", ">=")) == [1, 3]
    assert ids(df, Filter("u", "18446744073709551616", "number", ">=")) == []


def test_decimal_columns_keep_their_scale(spark):
    df = spark.createDataFrame([(1, Decimal("1.25")), (2, Decimal("1.26")), (3, None)], "id int, d decimal(6,2)")
    assert ids(df, Filter("d", "1.255", "number", ">")) == [2]
    assert ids(df, Filter("d", "1.255", "number", "<=")) == [1]
    assert ids(df, Filter("d", "1.255", "number", "=")) == []
    assert ids(df, Filter("d", "1.250", "number", "=")) == [1]


def test_filters_that_say_nothing_are_skipped(people):
    wanted = [Filter("nope", "x"), Filter("name", ""), Filter("n", "many", "number", ">"), Filter("n", "1", "number", "=>")]
    compiled = compile_filters(people, wanted)
    assert compiled.predicate is None and [f for f, _ in compiled.skipped] == wanted
    assert len(ids(people, *wanted)) == 6


def test_number_filter_on_text_is_an_error(people):
    with pytest.raises(FilterError):
        compile_filters(people, [Filter("name", "1", "number", ">")])


def test_all_filters_must_pass(people):
    assert ids(people, Filter("name", "a"), Filter("n", "0", "number", ">")) == [1, 4]


def test_entries(spark):
    number = T.LongType()
    assert parse_filter_entry("n", ">= 10", number) == Filter("n", "10", "number", ">=")
    assert parse_filter_entry("n", "10", number) == Filter("n", "10", "number", "=")
    assert parse_filter_entry("n", "<>3", number) == Filter("n", "3", "number", "<>")
    assert parse_filter_entry("n", "  ", number) is None
    assert parse_filter_entry("s", ">= 10", T.StringType()) == Filter("s", ">= 10")


def test_json_form():
    spec = {"a": {"type": "number", "value": "1", "operator": "<"}, "b": {"type": "text", "value": "x"}, "c": {"type": "text", "value": "^(u|v)$", "valueList": ["u", "v"]}}
    assert filters_from_request(spec) == [Filter("a", "1", "number", "<"), Filter("b", "x"), Filter("c", ("u", "v"), "values")]


def test_names_with_any_character(spark):
    df = spark.createDataFrame([(1, "x")], ["id", 'a.b `c` "d"'])
    assert ids(df, Filter('a.b `c` "d"', "x")) == [1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparisons_and_lists_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = plan_of(apply_filters(orders, [Filter("o_custkey", "10.5", "number", ">"), Filter("o_orderstatus", ("F", "O"), "values")]).select("o_orderkey"))
    assert "GreaterThan(o_custkey,10)" in plan and "In(o_orderstatus, [F,O])" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    assert "StringContains(o_orderpriority,URG)" in plan_of(apply_filters(orders, [Filter("o_orderpriority", "URG")]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.decimals(-50, 50, places=2), st.sampled_from([">", "<", ">=", "<=", "="]))
def test_integer_comparison_agrees_with_arithmetic(spark, value, operator):
    df = spark.range(-60, 60)
    python = {">": lambda a: a > value, "<": lambda a: a < value, ">=": lambda a: a >= value, "<=": lambda a: a <= value, "=": lambda a: a == value}
    assert ids(df, Filter("id", str(value), "number", operator)) == [i for i in range(-60, 60) if python[operator](i)]


def test_text_forms_are_searched(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 0.5, False)], "id int, x double, b boolean").withColumn("t", F.timestamp_seconds("id").cast("timestamp_ntz"))
    assert ids(df, Filter("x", "^1$"), use_regex=True) == [1]
    assert ids(df, Filter("b", "true")) == [1]
    assert ids(df, Filter("t", "00:00:02.000000")) == [2]


@pytest.mark.parametrize("entry, operator, want", [
    ("1e-3000000", ">", [1, 5]), ("1e-30000000", ">=", [1, 5]), ("-1e-3000000", "<", [-2]), ("-1e-3000000", ">", [0, 1, 5]),
    ("1e3000000", "<", [-2, 0, 1, 5]), ("0e-3000000", "=", [0]), ("1e-3000000", "=", []), ("sNaN", ">", [-2, 0, 1, 5]),
])
@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(9,2)"])
def test_extreme_entries_neither_raise_nor_stall(spark, entry, operator, want, kind):
    df = spark.createDataFrame([(-2,), (0,), (1,), (5,)], "v int").select(F.col("v").cast(kind).alias("v"))
    got = apply_filters(df, [Filter("v", entry, "number", operator)])
    assert sorted(int(r.v) for r in got.collect()) == want


def test_value_lists_compare_in_the_type_of_the_column(spark, tmp_path):
    rows = [(5, dt.date(2024, 1, 2)), (-7, dt.date(2024, 2, 29)), (0, None), (None, dt.date(999, 1, 1))]
    spark.createDataFrame(rows, "n int, d date").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def kept(name, *wanted, **options):
        return sorted([r.n if r.n is not None else 99 for r in apply_filters(df, [Filter(name, wanted, "values")], **options).collect()])

    assert kept("n", "5", "-7", "05", "+5", "5.0", "x", "", "9" * 400, str(2**31)) == [-7, 5]
    assert kept("n", "-0", "٥") == [] and kept("n", "0", "(null)") == [0, 99] and kept("n", "(NULL)") == []
    assert kept("n", "(NULL)", case_insensitive=True) == [99]
    assert kept("d", "2024-01-02", "2024-02-30", "2024-1-2", "20240229", "0999-01-01") == [5, 99]
    assert kept("d", "2024-02-29", "(null)") == [-7, 0] and kept("d", "+2024-02-29", "2024-01-02") == [5]
    plan = apply_filters(df, [Filter("n", ("5", "-7"), "values")])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(n, [-7,5])]" in plan or "PushedFilters: [In(n, [5,-7])]" in plan
