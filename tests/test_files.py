import csv
import io
import random
import zipfile
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from gridweave.__main__ import main
from gridweave.operators import infer_types
from gridweave.sources import (
    FILE_ORDER,
    ArrowFiles,
    append_to,
    can_open,
    copy_table,
    csv_header,
    file_report,
    open_table,
    processed_path,
    read_csv,
    read_workbook,
    register_format,
    register_reader,
    scan_directory,
    scan_workbooks,
    sheet_names,
    split_source,
    write_table,
)
from gridweave.sources import records
from gridweave.sources.csv import header_names


@pytest.fixture
def file(tmp_path):
    def write(text, name="t.csv"):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "512"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_scan_and_leading_skip(spark, file, rows):
    path = file("a,b,c\n1,2,3\n4,5,6\n")
    assert rows(read_csv(spark, path)) == [("1", "2", "3"), ("4", "5", "6")]
    skipped = read_csv(spark, path, skip=1)
    assert skipped.columns == ["1", "2", "3"] and rows(skipped) == [("4", "5", "6")]
    assert csv_header(spark, path, skip=1) == ["1", "2", "3"]


def test_skip_list_keeps_header(spark, file, rows):
    df = read_csv(spark, file("a,b\nx,y\nm,n\n"), skip=[1])
    assert df.columns == ["a", "b"] and rows(df) == [("m", "n")]


def test_skipped_lines_are_not_judged(spark, file, rows):
    path = file("a,title,with,commas\nk,v\n1,2\n9,9,9\n3,4\n")
    assert rows(read_csv(spark, path, skip="0,3")) == [("1", "2"), ("3", "4")]


def test_long_and_short_rows(spark, file, rows):
    path = file("a,b\n1,2\n3\n4,5,6\n7,8,\n")
    assert rows(read_csv(spark, path, bad_rows="skip")) == [("1", "2"), ("3", None)]
    assert rows(read_csv(spark, path, bad_rows="skip").select("a")) == [("1",), ("3",)]
    assert len(rows(read_csv(spark, path, bad_rows="keep"))) == 4
    with pytest.raises(PySparkException, match="more than 2 fields"):
        read_csv(spark, path).collect()


def test_missing_value_marks_and_quotes(spark, file, rows):
    path = file('a,b\nNA,"x,""y"""\nnone,\n007,nan\n')
    assert rows(read_csv(spark, path)) == [("007", None), ("none", None), (None, 'x,"y"')]
    assert rows(read_csv(spark, path, na_tokens=["007"]))[0] == ("NA", 'x,"y"')


def test_header_names():
    assert header_names("﻿a,b,a,,a") == ["a", "b", "a.1", "Unnamed: 3", "a.2"]
    assert header_names("a,a.1,a") == ["a", "a.1", "a.2"]
    assert header_names('"x;y";z', sep=";") == ["x;y", "z"]


def test_blank_files(spark, file):
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, file(""))
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, file("a,b\n"), skip=5)


def test_line_numbers_over_many_splits_and_files(spark, tmp_path, small_splits):
    for name, start in (("a", 0), ("b", 5000)):
        lines = "".join(f"{i},value {i}\n" for i in range(start, start + 2000))
        (tmp_path / f"{name}.csv").write_text(f"title\nsubtitle\nk,v\n{lines}")
    df = read_csv(spark, str(tmp_path), skip="0-1,3,100..199", with_order=True)
    kept = {start + i for start in (0, 5000) for i in range(2000) if i + 3 != 3 and not 100 <= i + 3 <= 199}
    found = df.collect()
    assert len(found) == len(kept) and {int(r.k) for r in found} == kept
    assert df.rdd.getNumPartitions() > 20
    in_order = [int(r.k) for r in sorted(found, key=lambda r: tuple(r[c] for c in FILE_ORDER))]
    assert in_order == sorted(kept)


def test_native_scan_keeps_file_order(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("k\n" + "".join(f"{i}\n" for i in range(3000)))
    found = read_csv(spark, str(tmp_path / "a.csv"), with_order=True).orderBy(*FILE_ORDER).collect()
    assert [int(r.k) for r in found] == list(range(3000))


def test_infer_types(spark, file):
    df = read_csv(spark, file("i,g,f,b,t\n1,1,1.5,True,x\n-2,,2,false,1\n"), infer_types=True)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "double", "boolean", "string"]
    assert infer_types(df).dtypes == df.dtypes


def test_directory(spark, tmp_path, rows):
    for name in ("a1.csv", "a2.CSV", "b.csv", "a3.txt"):
        (tmp_path / name).write_text(f"k\n{name}\n")
    assert rows(scan_directory(spark, str(tmp_path))) == [("a1.csv",), ("a2.CSV",), ("b.csv",)]
    assert rows(scan_directory(spark, str(tmp_path), "^a")) == [("a1.csv",), ("a2.CSV",)]
    assert len(rows(scan_directory(spark, str(tmp_path), "(("))) == 3
    assert rows(scan_directory(spark, str(tmp_path), "a1", skip="0")) == []


def test_dispatch(spark, file):
    assert can_open("x.CSV") and can_open("x.xlsx") and not can_open("x.bin")
    with pytest.raises(ValueError, match="no reader"):
        open_table(spark, "x.bin")
    register_reader(".bin", lambda spark, path: spark.range(3))
    assert open_table(spark, "x.bin").count() == 3
    df = spark.range(1)
    assert open_table(spark, df) is df
    assert split_source("C::d.xlsx::S1") == ("C::d.xlsx", "S1") and split_source("a.csv") == ("a.csv", None)
    assert processed_path("/d/in.csv") == "/d/in_processed.csv"


def test_write_append_and_copy(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a,b"), (2, ' "q" '), (3, None)], "k int, v string")
    path = str(tmp_path / "out.csv")
    assert write_table(df, path).rows == 3
    assert rows(read_csv(spark, path)) == [("1", "a,b"), ("2", ' "q" '), ("3", None)]
    append_to(df.where("k = 1"), path)
    assert read_csv(spark, path).count() == 4
    metrics = copy_table(spark, path, str(tmp_path / "copy.parquet"))
    assert metrics.rows == 4 and metrics.rows_per_second > 0
    assert open_table(spark, str(tmp_path / "copy.parquet")).count() == 4


def plain_records(text):
    """Rows as a reader of the whole text sees them, with the texts of records."""
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def wild_csv(seed, lines):
    """Fields with quotes, doubled quotes and all kinds of line breaks; long ones lie in several splits."""
    rng = random.Random(seed)
    pieces = ["a", "b,", "\n", "\r\n", '""', "", "cd e", ",", "x\n\ny"]
    out = ['"k\n1",two']
    for i in range(lines):
        length = rng.choice([0, 1, 2, 4, 8, 30, 1500])
        out.append(f'{i},"{"".join(rng.choice(pieces) for _ in range(length))}"' if rng.random() < 0.7 else f'{i},p"la"in')
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("seed", range(4))
def test_records_over_lines_and_splits(spark, file, small_splits, seed):
    text = wild_csv(seed, 60)
    path = file(text)
    header, *plain = plain_records(text)
    df = read_csv(spark, path, multi_line=True, na_tokens=[], with_order=True)
    assert df.columns[:2] == header == ["k\n1", "two"] == csv_header(spark, path, multi_line=True)
    found = df.orderBy("_block", "_row").collect()
    assert [(r[0], r[1] or "") for r in found] == [tuple(r) for r in plain]
    assert len({r["_block"] for r in found}) > 5


def test_records_are_skipped_by_number(spark, file, small_splits):
    text = '"title\nof, it",x,y\n\n' + wild_csv(9, 50)
    skipped = read_csv(spark, file(text), multi_line=True, skip="0, 3-5, 20", na_tokens=[])
    plain = plain_records(text)
    wanted = [tuple(r) for i, r in enumerate(plain[2:]) if i + 3 not in (3, 4, 5, 20)]
    assert sorted((r[0], r[1] or "") for r in skipped.collect()) == sorted(wanted)


def test_a_record_over_many_splits(spark, file, small_splits, rows):
    path = file('a,b\n1,"' + "line\n" * 5000 + '"\n2,z\n')
    assert rows(read_csv(spark, path, multi_line=True)) == [("1", "line\n" * 5000), ("2", "z")]


def test_an_open_quote_takes_the_rest(spark, file, rows):
    path = file('a,b\n1,x\n2,"y\n3,z\n')
    assert len(rows(read_csv(spark, path, multi_line=True, bad_rows="keep"))) == 2


def test_names_that_differ_in_case(spark, file, rows):
    df = read_csv(spark, file("Name,name,NAME.1,x\n1,2,3,4\n"))
    assert df.columns == ["Name", "name.2", "NAME.1", "x"] and rows(df) == [("1", "2", "3", "4")]


def test_other_headers_raise(spark, tmp_path):
    for i, (first, second) in enumerate([("a,a", "x,y"), ("a,", "a,b"), ("a,b", "x,y"), ("A,a", "a,A")]):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "a.csv").write_text(f"{first}\n1,2\n")
        (tmp_path / str(i) / "b.csv").write_text(f"{second}\n3,4\n")
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_csv(spark, str(tmp_path / str(i))).collect()
        if first != "a,b":
            with pytest.raises(PySparkException, match="different headers"):
                read_csv(spark, str(tmp_path / str(i)), multi_line=True).collect()


def test_blocks_joined_by_shuffle(spark, file, small_splits, monkeypatch):
    monkeypatch.setattr(records, "BROADCAST_BLOCKS", 1)
    text = wild_csv(2, 60)
    found = read_csv(spark, file(text), multi_line=True, na_tokens=[]).collect()
    assert sorted((r[0], r[1] or "") for r in found) == sorted(tuple(r) for r in plain_records(text)[1:])


def test_empty_table_still_has_a_header(spark, tmp_path):
    path = str(tmp_path / "none.csv")
    write_table(spark.createDataFrame([], "a string, b string"), path)
    assert read_csv(spark, path).columns == ["a", "b"] and read_csv(spark, path).count() == 0


def test_command_line(spark, tmp_path, file, capsys):
    main([file("a,b\n1,2\n"), str(tmp_path / "out.csv")])
    parts = list((tmp_path / "out.csv").glob("part-*"))
    assert parts[0].read_text().startswith("a,b")
    assert "1 rows" in capsys.readouterr().out


def test_file_report(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("1\n2\n")
    assert rows(file_report(spark.read.text(str(tmp_path / "a.txt")))) == [("a.txt", 4, 2)]


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(path, **sheets):
    """A small workbook: cells are (kind, value) with shared strings, numbers, dates and gaps."""
    strings, parts = [], {}
    for number, table in enumerate(sheets.values()):
        xml = []
        for r, line in enumerate(table):
            cells = ""
            for c, value in enumerate(line):
                ref = f"{chr(65 + c)}{r + 1}"
                if value is None:
                    continue
                if isinstance(value, bool):
                    cells += f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
                elif isinstance(value, datetime):
                    serial = (value - datetime(1899, 12, 30)).total_seconds() / 86400
                    cells += f'<c r="{ref}" s="1"><v>{serial}</v></c>'
                elif isinstance(value, str) and value.startswith("inline "):
                    cells += f'<c r="{ref}" t="inlineStr"><is><t>{value[7:]}</t></is></c>'
                elif isinstance(value, str):
                    strings.append(value)
                    cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    cells += f'<c r="{ref}"><v>{value}</v></c>'
            xml.append(f'<row r="{r + 1}">{cells}</row>')
        parts[f"xl/worksheets/sheet{number + 1}.xml"] = SHEET.format("".join(xml))
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
    parts["xl/workbook.xml"] = f'<workbook xmlns:r="{relation}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>"
    parts["xl/styles.xml"] = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    path.write_bytes(content.getvalue())


def test_workbooks(spark, tmp_path, rows):
    for n in range(3):
        workbook(
            tmp_path / f"b{n}.xlsx",
            First=[["title"], ["k", "v", "d"], [n, "inline x", datetime(2024, 1, 31, 12)], [n + 10, None, True], []],
            Second=[["A", "B"], [1, 4]],
        )
    assert scan_workbooks(spark, str(tmp_path)).count() == 21
    table = read_workbook(spark, str(tmp_path), skip="0", with_order=True)
    assert rows(table.select("k", "v", "d"))[:2] == [("0", "x", "2024-01-31 12:00:00"), ("1", "x", "2024-01-31 12:00:00")]
    assert table.count() == 6 and table.columns[-3:] == FILE_ORDER
    second = open_table(spark, f"{tmp_path}/b1.xlsx::Second", infer_types=True)
    assert second.dtypes == [("A", "bigint"), ("B", "bigint")] and rows(second) == [(1, 4)]
    assert rows(sheet_names(spark, f"{tmp_path}/b0.xlsx").select("sheet_number", "sheet")) == [
        (0, "First"),
        (1, "Second"),
    ]


@pytest.mark.parametrize("bad_rows", ["fail", "keep", "skip"])
def test_headers_of_all_files(spark, tmp_path, rows, bad_rows):
    def folder(name, *texts):
        (tmp_path / name).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / name / f"f {i}.csv").write_text(text)
        return str(tmp_path / name)

    turned = folder("turned", "a,b\n1,x\n", "b,a\ny,2\n")
    with pytest.raises(Exception):
        read_csv(spark, turned, bad_rows=bad_rows).collect()
    assert rows(read_csv(spark, turned, bad_rows=bad_rows, headers="each").select("a", "b")) == [("1", "x"), ("2", "y")]
    blank = folder("blank", "t\na,b\n1,x\n", "t\n\na,b\n2,y\n")
    with pytest.raises(Exception):
        read_csv(spark, blank, skip="0", bad_rows=bad_rows).collect()
    assert rows(read_csv(spark, blank, skip="0", bad_rows=bad_rows, headers="each")) == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError):
        read_csv(spark, folder("more", "a,b\n1,x\n", "a,b,c\n2,y,3\n"), headers="each")


def test_a_format_of_ones_own(spark, tmp_path, rows):
    register_format(spark, ArrowFiles())
    register_format(spark, ArrowFiles())
    path = str(tmp_path / "t.arrow")
    df = spark.sql("SELECT id, concat('v', id) AS name, array(id) AS more, IF(id % 2 = 0, NULL, id * 0.5D) AS half FROM range(1000)")
    assert write_table(df.repartition(4), path).rows == 1000
    assert can_open(path) and rows(open_table(spark, path)) == rows(df)
    append_to(df.limit(3).select("name", "id"), path)
    assert open_table(spark, path).count() == 1003 and open_table(spark, path).where("name = 'v7' AND more IS NOT NULL").count() == 1
    write_table(df.where("id < 0"), path)
    assert open_table(spark, path).columns == df.columns and open_table(spark, path).count() == 0
    assert len([p for p in (tmp_path / "t.arrow").iterdir() if p.is_dir()]) == 1
    with pytest.raises(ValueError, match="a reader already"):
        register_format(spark, type("Other", (ArrowFiles,), {"name": "other", "suffix": ".csv"})())


def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    register_format(spark, ArrowFiles())
    path = str(tmp_path / "t.arrow")
    broken = spark.range(100).repartition(4).selectExpr("IF(id = 57, raise_error('broken'), id) AS id")
    with pytest.raises(Exception, match="broken"):
        write_table(broken, path)
    assert not [p for p in (tmp_path / "t.arrow").rglob("*") if p.is_file()]
    write_table(spark.range(5), path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            write_table(broken, path, mode=mode)
        assert rows(open_table(spark, path)) == [(i,) for i in range(5)]
    assert len([p for p in (tmp_path / "t.arrow").iterdir() if p.is_dir()]) == 1
