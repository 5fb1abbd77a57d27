"""Random tables against an independent single-process evaluation with Arrow kernels."""

import datetime as dt
import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tableprobe import Filter, page, profile, value_counts, with_row_index
from tableprobe.operators import compile_filters

ROWS = 400


@pytest.fixture(scope="module", params=[1, 2])
def table(request, spark, tmp_path_factory):
    r = random.Random(request.param)

    def column(make, nulls=0.1):
        return [None if r.random() < nulls else make() for _ in range(ROWS)]

    data = pa.table(
        {
            "i": pa.array(column(lambda: r.randint(-20, 20)), pa.int32()),
            "big": pa.array(column(lambda: r.choice((-1, 1)) * r.randint(2**53 - 3, 2**63 - 1))),
            "u": pa.array(column(lambda: r.randint(2**63 - 5, 2**64 - 1)), pa.uint64()),
            "x": pa.array(column(lambda: r.choice((math.nan, math.inf, -math.inf, 0.5, r.gauss(0, 100), float(r.randint(0, 9)))))),
            "f": pa.array(column(lambda: round(r.gauss(0, 5), 2)), pa.float32()),
            "s": pa.array(column(lambda: r.choice(("a", "B", "ab", "żó", "ŻÓ", "(null)", "", "a.b", "x\ny", "10", "9")))),
            "n": pa.array(column(lambda: r.choice(("1", "10", "2", "-3", "007", "9223372036854775807")))),
            "nf": pa.array(column(lambda: r.choice(("1.5", "1e3", ".5", "-2", "+7")))),
            "t": pa.array(column(lambda: dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=r.randint(0, 10**12))), pa.timestamp("us")),
            "d": pa.array(column(lambda: dt.date(2020, 1, 1) + dt.timedelta(days=r.randint(0, 30))), pa.date32()),
            "b": pa.array(column(lambda: r.random() < 0.5)),
        }
    )
    path = str(tmp_path_factory.mktemp("diff") / "t.parquet")
    pq.write_table(data, path)
    return data, spark.read.parquet(path)


def numeric(column):
    if not pa.types.is_string(column.type):
        return None
    for target in (pa.int64(), pa.float64()):
        try:
            return pc.cast(column, target)
        except pa.ArrowInvalid:
            pass
    return None


@pytest.mark.parametrize("ascending", [True, False])
def test_sort_order(table, ascending):
    data, df = table
    for name in data.column_names:
        key = numeric(data[name])
        key = data[name] if key is None else key
        order = pc.sort_indices(pa.table({"k": key}), sort_keys=[("k", "ascending" if ascending else "descending")]).to_pylist()
        got = [r.row_index - 1 for r in page(df, sort_by=name, ascending=ascending, limit=ROWS).select("row_index").collect()]
        assert got == order, name


def masks(df, *cases):
    """Per (filter, options) the outcome for every row, null as False, in one job."""
    predicates = [compile_filters(df, [wanted], **options).predicate for wanted, options in cases]
    columns = [F.coalesce(p, F.lit(False)).alias(f"p{i}") for i, p in enumerate(predicates)]
    rows = with_row_index(df).select("row_index", *columns).orderBy("row_index").collect()
    return [[r[i + 1] for r in rows] for i in range(len(cases))]


@pytest.mark.parametrize("needle", ["a", "ul", "żó", ".", "1", "-0", "5.", "(", "[ab]", "^a|b$", "^$", "20-01-1", "e"])
def test_text_filters(table, needle):
    data, df = table
    cases, expected = [], []
    for name in data.column_names:
        text = pc.fill_null(pc.cast(data[name], pa.string()), "(null)")
        for fold in (False, True):
            cases.append((Filter(name, needle), {"case_insensitive": fold}))
            expected.append(pc.match_substring(text, needle, ignore_case=fold).to_pylist())
        cases.append((Filter(name, needle), {"use_regex": True}))
        try:
            expected.append(pc.match_substring_regex(text, needle).to_pylist())
        except pa.ArrowInvalid:
            expected.append(pc.match_substring(text, needle).to_pylist())
    for case, got, wanted in zip(cases, masks(df, *cases), expected):
        assert got == wanted, case


def test_number_filters(table):
    data, df = table
    kernels = {">": pc.greater, "<": pc.less, ">=": pc.greater_equal, "<=": pc.less_equal, "=": pc.equal}
    cases, expected = [], []
    for name, value in [("i", 3), ("i", -20), ("big", 2**62), ("u", 2**63), ("x", 0.5), ("x", math.inf), ("f", 1.25), ("i", 2.5)]:
        exact = isinstance(value, int) and pa.types.is_integer(data[name].type)
        scalar = pa.scalar(value, data[name].type) if exact else float(value)
        for operator, kernel in kernels.items():
            cases.append((Filter(name, str(value), "number", operator), {}))
            expected.append(pc.fill_null(kernel(data[name], scalar), False).to_pylist())
    for case, got, wanted in zip(cases, masks(df, *cases), expected):
        assert got == wanted, case


def test_value_counts_in_order_of_appearance(table):
    data, df = table
    for name in data.column_names:
        counts = pc.value_counts(pc.fill_null(pc.cast(data[name], pa.string()), "(null)"))
        pairs = sorted(zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()), key=lambda p: -p[1])
        got = value_counts(df, name, 0).collect()
        assert [(r.value, r["count"]) for r in got] == pairs, name
        assert {r.total_unique for r in got} == {len(pairs)}


def test_statistics(table):
    data, df = table
    for s in profile(df).collect():
        name, column = s.column_name, data[s.column_name]
        nulls = column.null_count
        assert (s.total_rows, s.null_count, s.non_null_count) == (ROWS, nulls, ROWS - nulls)
        assert s.unique_count == pc.count_distinct(column).as_py(), name
        assert s.null_percentage == round(nulls / ROWS * 100, 1)
        values = column if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) else numeric(column)
        if values is not None:
            edges = pc.min_max(values).as_py()
            finite = [float(edges[k]) if math.isfinite(edges[k]) else None for k in ("min", "max")]
            assert [s.min_value, s.max_value] == finite, name
            if name != "x":  # infinities and NaN make most of the rest null
                doubles = pc.cast(values, pa.float64(), safe=False)
                assert s.mean == pytest.approx(pc.mean(doubles).as_py(), rel=1e-12, abs=0.006)
                assert s.std_dev == pytest.approx(pc.stddev(doubles).as_py(), rel=1e-12, abs=0.006)
            quartiles = [pc.quantile(pc.cast(values, pa.float64(), safe=False), q)[0].as_py() for q in (0.25, 0.5, 0.75)]
            assert s.median == pytest.approx(quartiles[1], rel=1e-15, abs=0.0051), name
        if pa.types.is_string(column.type):
            lengths = pc.utf8_length(pc.drop_null(column))
            assert (s.min_length, s.max_length) == tuple(pc.min_max(lengths).as_py().values())
        if pa.types.is_timestamp(column.type) or pa.types.is_date(column.type):
            first, last = pc.min(column).as_py(), pc.max(column).as_py()
            assert (s.earliest_date, s.latest_date, s.date_range_days) == (str(first), str(last), (last - first).days)
