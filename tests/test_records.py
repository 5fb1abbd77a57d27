"""Delimited files with records over several lines are read alike wherever the scan cuts them."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tableprobe import TableReadError
from tableprobe.sources import read_csv, read_tsv, records


def odd_file(rnd, delimiter):
    """A header and records with breaks, doubled quotes, delimiters and blank lines."""

    def field():
        kind = rnd.randrange(8)
        plain = "".join(rnd.choice("ab1 é") for _ in range(rnd.randrange(6))).strip() or "z"
        if kind < 3:
            return plain
        if kind == 3:
            return plain + '"x'  # a quote inside opens nothing
        inner = "".join(rnd.choice(["\n", "\r\n", '""', delimiter, "a", " ", '"",', '\n""', "é"]) for _ in range(rnd.randrange(12)))
        return f'"{plain}{inner}"'

    end = rnd.choice(["\n", "\r\n"])
    lines = [delimiter.join(["n", '"wide\nname"' if rnd.random() < 0.5 else "wide", "t"])]
    for n in range(rnd.randrange(1, 12)):
        lines.append(delimiter.join([str(n), field(), field()]))
        lines += rnd.choice([[], [], [""], ["   "], ["", "\t "]])
    return end.join(lines) + rnd.choice(["", end])


def parsed(text, delimiter):
    """The rows by Python's reader; a line of blanks alone is no row."""
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))[1:]
    return [(int(r[0]), *r[1:]) for r in rows if len(r) == 3]


@pytest.fixture
def cut(spark):
    """Call a function while files are cut into pieces of some bytes; the records it has written are read in larger ones."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def run(size, function):
        spark.conf.set(key, str(size))
        try:
            return function()
        finally:
            spark.conf.set(key, before)

    return run


@pytest.mark.parametrize("delimiter, read, sizes", [(",", read_csv, (7, 31)), ("\t", read_tsv, (13,))])
def test_records_are_the_same_wherever_files_are_cut(spark, tmp_path, cut, delimiter, read, sizes):
    rnd = random.Random(delimiter)
    texts = []
    for _ in range(200):
        text = odd_file(rnd, delimiter)
        if '"wide\nname"' in text and '"' in text.split("\n", 2)[-1]:
            texts.append(text)
    texts = texts[:4]
    expected = []
    for i, text in enumerate(texts):
        (tmp_path / f"f{i:02}.csv").write_bytes(text.encode())
        expected += parsed(text, delimiter)
    expected = [(i, *r) for i, r in enumerate(expected, 1)]
    for size in sizes:
        got = cut(size, lambda: read(spark, str(tmp_path), row_index=True, types={}))
        rows = sorted((r.row_index, int(r[0]), r[1], r[2]) for r in got.collect())
        assert [r[:2] for r in rows] == [r[:2] for r in expected], size
        assert rows == expected, size


def test_states_and_pieces_at_every_line():
    """The functions of the tasks, with splits at every line and at every second one: the records are those of the whole file."""
    import pyarrow as pa

    def lines_of(text, every):
        out = []
        for i, line in enumerate(text.split("\n")):
            out.append(("f", i // every, line, ends(line, False), ends(line, True)))
        return out

    def ends(line, inside):
        at = 0
        while True:
            if inside:
                close = at
                while close < len(line) and not (line[close] == '"' and line[close : close + 2] != '""'):
                    close += 2 if line[close] == '"' else 1
                if close >= len(line):
                    return True
                at = line.find(",", close + 1)
                if at < 0:
                    return False
                at += 1
            if at < len(line) and line[at] == '"':
                inside, at = True, at + 1
                continue
            inside = False
            at = line.find(",", at)
            if at < 0:
                return False
            at += 1

    rnd = random.Random(9)
    names = ["__file", "__block", "text", "from_out", "from_in"]
    for _ in range(300):
        text = odd_file(rnd, ",")
        whole = None
        for every in (10**6, 1, 2, 3):
            lines = lines_of(text, every)
            batch = pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in lines])
            splits = [r for b in records._compose([batch.select(["__file", "__block", "from_out", "from_in"])]) for r in b.to_pylist()]
            inside, owner, starts = False, None, {}
            for s in splits:
                starts[s["__block"]] = (inside, owner)
                begins = s["begins_in"] if inside else s["begins_out"]
                owner = s["__block"] if begins else owner
                inside = s["from_in"] if inside else s["from_out"]
            full = pa.RecordBatch.from_pylist([dict(zip(names, x)) | dict(zip(("inside", "owner"), starts[x[1]])) for x in lines], schema=pa.schema([*batch.schema, ("inside", pa.bool_()), ("owner", pa.int64())]))
            found = [r for b in records._assemble([full.slice(0, 3), full.slice(3)]) for r in b.to_pylist()]
            got = {(r["__block"], r["__seq"]): r["record"] for r in found if r["whole"]}
            across = [r for r in found if not r["whole"]]
            for block in {r["__block"] for r in across}:
                parts = sorted((r for r in across if r["__block"] == block), key=lambda r: r["part"])
                got[block, max(r["__seq"] for r in parts if r["__seq"] is not None)] = "\n".join(r["record"] for r in parts)
            ordered = [got[k] for k in sorted(got)]
            whole = whole or ordered
            assert ordered == whole
        assert [r.rstrip("\r") for r in whole[1:]] == [",".join(x) for x in raw_records(text)]


def raw_records(text):
    """The records of a file as they are written, but the header and blank lines."""
    out, held, inside = [], "", False
    for line in text.split("\n"):
        held = f"{held}\n{line}" if inside else line
        fields = held.replace('""', "")
        inside = any(f.startswith('"') and f.count('"') % 2 for f in split_fields(fields))
        if not inside and held.strip(records._BLANK):
            out.append([held.rstrip("\r")])
    return out[1:]


def split_fields(text):
    """Fields of a text without doubled quotes, as far as its last open one."""
    out, at = [], 0
    while at <= len(text):
        if text[at : at + 1] == '"':
            close = text.find('"', at + 1)
            end = -1 if close < 0 else text.find(",", close)
        else:
            end = text.find(",", at)
        if end < 0:
            return [*out, text[at:]]
        out.append(text[at:end])
        at = end + 1
    return out


def test_a_long_record_runs_over_many_splits(spark, tmp_path, cut):
    body = "\n".join(f"line {i}, with ""commas"" " for i in range(200))
    (tmp_path / "a.csv").write_text(f'id,t\n1,"{body}"\n2,x\n3,"{body}\n"\n4,y\n')
    assert cut(256, lambda: spark.read.text(f"{tmp_path}/a.csv").rdd.getNumPartitions()) > 30
    got = cut(256, lambda: read_csv(spark, f"{tmp_path}/a.csv", row_index=True, types={"id": "bigint"}))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, body, 1), (2, "x", 2), (3, body + "\n", 3), (4, "y", 4)]


def test_tasks_share_the_work(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text("id,t\n" + "".join(f'{i},"a\n{i}"\n' for i in range(2000)))
    found = cut(2048, lambda: records.spanning_records(spark, [f"{tmp_path}/a.csv"], "UTF-8", ","))
    per_split = found.groupBy("__block").count()
    assert per_split.count() > 8 and per_split.agg(F.max("count")).first()[0] < 400


def test_latin1_and_open_quotes(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_bytes("id,t\n1,\"Zü\nrich\"\n2,é\n".encode("latin-1"))
    got = cut(5, lambda: read_csv(spark, f"{tmp_path}/a.csv", types={}))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "Zü\nrich"), ("2", "é")]
    (tmp_path / "b.csv").write_text('id,t\n1,"never\nclosed\n2,x\n')
    whole = None
    for size in (10**6, 6):
        got = [tuple(r) for r in cut(size, lambda: read_csv(spark, f"{tmp_path}/b.csv", types={})).collect()]
        whole = whole or got
        assert got == whole and len(got) == 1 and "closed" in got[0][1]


def test_blank_lines_are_no_rows_in_either_kind_of_file(spark, tmp_path):
    plain, spans = "a,b\n1,x\n   \n\n2,y\n", 'a,b\n1,x\n   \n\n2,"y\nz"\n'
    (tmp_path / "p").mkdir()
    for name, text in (("p/plain.csv", plain), ("spans.csv", spans)):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/p").collect()] == [(1, "x"), (2, "y")]
    got = read_csv(spark, f"{tmp_path}/spans.csv", row_index=True)
    assert got.dtypes[0] == ("a", "bigint")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 1), (2, "y\nz", 2)]


def test_too_wide_records_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny",3\n')
    with pytest.raises(Exception, match="more than the header's 2 fields"):
        read_csv(spark, f"{tmp_path}/a.csv").collect()


def test_lines_that_end_in_carriage_returns_alone_are_not_split(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    assert not records.can_split(spark, [f"{tmp_path}/a.csv"])
    assert len(read_csv(spark, f"{tmp_path}/a.csv", types={}).collect()) == 2


@pytest.mark.parametrize(
    "line, from_out, from_in",
    [("a,b", 0, 1), ('"a', 1, 0), ('a,"b', 1, 0), ('a"b', 0, 0), ('"a""', 1, 0), ('"a"', 0, 0), ('x",y,"z', 1, 1), ('""', 0, 1), ('"a"b,"c', 1, 1), ('a,""",', 1, 0), ('""",', 1, 0), ("", 0, 1)],
)
def test_lines_under_both_assumptions(spark, line, from_out, from_in):
    df = spark.createDataFrame([(line,)], "v string")
    got = df.select(records.leaves_open("v", ",").cast("int"), records.stays_open(F.col("v"), ",").cast("int")).first()
    assert tuple(got) == (from_out, from_in)
