import datetime as dt
import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tableprobe.errors import SheetLimitError
from tableprobe.functions import (
    blob_placeholder, blob_size_text, double_text, file_size_text, hex_text, row_json, simplify_type, slugify,
    text_number_kind, text_to_double, text_to_long, truncate_text, wire_view,
)
from tableprobe.functions.types import null_columns_to_string
from tableprobe.operators.sheet import check_sheet_limits, to_sheet_safe
from tableprobe.sources.headers import case_unique_names, header_names


def mapped(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def _size_by_rule(n):
    """Half up to one decimal, no trailing .0, in the largest unit that is not below 1 (up to MB)."""
    unit = min(2, max(0, (n.bit_length() - 1) // 10))
    tenths = (n * 10 * 2 + (1 << 10 * unit)) // (2 << 10 * unit) if unit else n * 10
    return f"{tenths // 10}{'.' + str(tenths % 10) if tenths % 10 else ''} {'B KB MB'.split()[unit]}"


# around every bound, and spread between
BLOBS = {n: _size_by_rule(n) for k in (0, 7, 10, 14, 20, 24) for n in (2**k - 1, 2**k, 2**k + 1, 2**k * 11 // 10, 2**k * 17 // 4)}


def test_blob_sizes(spark):
    assert mapped(spark, list(BLOBS), "bigint", blob_size_text) == [f"<BLOB {t}>" for t in BLOBS.values()]
    assert mapped(spark, [b"", None, b"\x00" * 2048], "binary", blob_placeholder) == ["<BLOB 0 B>", None, "<BLOB 2 KB>"]


def test_file_sizes(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1048576, 123456789, 5 * 1024**4, 3000 * 1024**4]
    assert mapped(spark, sizes, "bigint", file_size_text) == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "117.74 MB", "5 TB", "3000 TB"]


def test_double_texts(spark):
    values = [1.0, 0.1, 1e20, 1e15, 123456789012345.6, 1e-5, 1.234567890123e-05, 1e-7, 12345678.9, math.nan, math.inf, -math.inf, -2.5, 1.5e300, None]
    assert mapped(spark, values, "double", double_text) == [
        "1", "0.1", "1e+20", "1e+15", "1.234567890123456e+14", "0.00001", "0.00001234567890123", "1e-7", "12345678.9", "nan",
        "inf", "-inf", "-2.5", "1.5e+300", None,
    ]


def test_texts_as_numbers(spark):
    texts = ["1", "-1", "01", "+1", "1.0", " 1", "1 ", "1_0", "", "x", "9223372036854775807", "9223372036854775808", "1d"]
    assert mapped(spark, texts, "string", text_to_long) == [1, -1, 1] + [None] * 7 + [9223372036854775807, None, None]
    texts = ["1", "+1", "1.", ".5", "-.5", "1e3", "1E+3", "inf", "-Infinity", "1d", "1f", " 1", "", "-", "1e", "0x1F"]
    assert mapped(spark, texts, "string", text_to_double) == [1.0, 1.0, 1.0, 0.5, -0.5, 1e3, 1e3, math.inf, -math.inf] + [None] * 7
    assert math.isnan(mapped(spark, ["NaN"], "string", text_to_double)[0])


@pytest.mark.parametrize("texts, kind", [(["1", None, "-20"], "int"), (["1", "2.5"], "float"), (["1", "x"], None), (["1", ""], None), ([None], "int"), (["9223372036854775808"], "float")])
def test_text_number_kind(spark, texts, kind):
    assert text_number_kind(spark.createDataFrame([(t,) for t in texts], "t string"), "t") == kind


def test_small_texts(spark):
    assert mapped(spark, ["Sales 2024", "--A--b__", "", None, "żółw!"], "string", slugify) == ["sales_2024", "a_b", "sheet", "sheet", "w"]
    assert mapped(spark, ["abcd", "abc", None], "string", lambda c: truncate_text(c, 3)) == ["abc...", "abc", None]
    assert mapped(spark, ["abcd"], "string", lambda c: truncate_text(c, 0)) == ["abcd"]
    assert mapped(spark, [b"\xff\xfe\x00png"], "binary", hex_text) == ["fffe00706e67"]


def test_wire_form(spark):
    schema = "i bigint, f double, t timestamp_ntz, d date, m decimal(5,2), b binary, l array<int>, s struct<a:int,b:string>, o boolean"
    rows = [
        (2**53 + 1, math.nan, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2), Decimal("1.20"), b"a\xff", [1, None], (1, None), True),
        (1, 1.5, dt.datetime(2024, 1, 2, 3, 4, 5, 600), None, None, None, None, None, None),
    ]
    got = wire_view(spark.createDataFrame(rows, schema)).collect()
    assert got[0] == (2**53 + 1, None, "2024-01-02T03:04:05", "2024-01-02", 1.2, "a�", "[1,null]", '{"a":1,"b":null}', True)
    assert got[1][:3] == (1, 1.5, "2024-01-02T03:04:05.000600")


def test_rows_as_json(spark):
    df = spark.createDataFrame([(1, 2**53 + 1, "a/\"b", None), (2, -5, None, math.inf)], "row_index int, i bigint, s string, f double")
    assert [json.loads(r[0]) for r in df.select(row_json(df)).collect()] == [{"i": str(2**53 + 1), "s": 'a/"b', "f": None}, {"i": -5, "s": None, "f": None}]


def test_type_names(spark):
    df = spark.sql("SELECT 1Y a, 1L b, 1.0D c, 1.5BD d, true e, 'x' f, X'00' g, DATE'2024-01-01' h, TIMESTAMP_NTZ'2024-01-01' i, array(1) j, struct(1) k, NULL l, CAST(1 AS DECIMAL(20,0)) m")
    names = [simplify_type(f.dataType) for f in df.schema.fields]
    assert names == ["int", "int", "float", "decimal", "boolean", "string", "binary", "date", "datetime", "list", "struct", "string", "int"]
    assert isinstance(null_columns_to_string(df).schema["l"].dataType, T.StringType)


@pytest.mark.parametrize("cells, names", [
    (["w", "w.2", "w", "w"], ["w", "w.2", "w.1", "w.3"]),
    (["k.1", "k", "k", "k"], ["k.1", "k", "k.2", "k.3"]),
    (["", "  ", None, "x"], ["Unnamed: 0", "Unnamed: 1", "Unnamed: 2", "x"]),
    (["", "Unnamed: 0"], ["Unnamed: 0", "Unnamed: 0.1"]),
    (["a", "a", "a"], ["a", "a.1", "a.2"]),
])
def test_header_names(cells, names):
    assert header_names(cells) == names


def test_header_is_filled_to_its_width():
    assert header_names(["a"], 3) == ["a", "Unnamed: 1", "Unnamed: 2"]


def test_names_unique_by_case():
    assert case_unique_names(["Sum", "x", "SUM", "sum"]) == ["Sum", "x", "SUM.1", "sum.2"]
    assert case_unique_names(["a", "A", "A.1", "a"]) == ["a", "A.2", "A.1", "a.3"]


def test_sheet_safe(spark):
    df = spark.createDataFrame([(2**53 + 1, 5, b"\x01"), (None, -7, None)], "ID bigint, id bigint, b binary")
    safe = to_sheet_safe(df)
    assert [(f.name, f.dataType.simpleString()) for f in safe.schema.fields] == [("ID", "string"), ("id.1", "bigint"), ("b", "string")]
    assert safe.first() == (str(2**53 + 1), 5, "01")
    check_sheet_limits(1_048_575, 16_384)
    for size in ((1_048_576, 1), (1, 16_385)):
        with pytest.raises(SheetLimitError):
            check_sheet_limits(*size)
