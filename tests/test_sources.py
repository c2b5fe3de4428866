"""Reading: separators, headers, quotes, numbers, missing values, compression and workbooks."""

import datetime
import gzip
import zipfile

import pytest

from quillframe.shared import shared_dir
from quillframe.sources.files import compression, import_path, import_url, inspect_path, read_delimited, read_xlsx
from quillframe.sources.infer import infer
from quillframe.sources.sniff import sniff, tokenize


def rows(f):
    return [tuple(r)[1:] for r in f.with_rid.orderBy("_rid").collect()]


@pytest.mark.parametrize("text, sep, header, names", [
    ("a,b\n1,2\n", ",", True, ["a", "b"]), ("1;2;3\n4;5;6", ";", False, ["0", "1", "2"]), ("x|y\nq|w\n", "|", False, ["0", "1"]), ("a\tb\n1\t2", "\t", True, ["a", "b"]),
    ("1 2 3\n4 5 6", " ", False, ["0", "1", "2"]), ("# note, with 'quote\n@rel\na,b\n1,2", ",", True, ["a", "b"]), ("7\n8\n", " ", False, ["0"]), ("", ",", False, []),
])
def test_sniff(text, sep, header, names):
    s = sniff(text)
    assert (s.separator, s.header, s.names) == (sep, header, names)


@pytest.mark.parametrize("line, sep, fields", [
    ("1, 'a,b' ,\"c\"", ",", ["1", "a,b", "c"]), ('"say ""hi""",2', ",", ['say "hi"', "2"]), ("  1   2  3 ", " ", ["1", "2", "3"]), ("a,,b,", ",", ["a", "", "b", ""]), ("it's,x", ",", ["it's", "x"]),
    ('" four",1', ",", [" four", "1"]),
])
def test_tokenize(line, sep, fields):
    assert tokenize(line, sep) == fields


def test_types(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("n,x,e,t,bad,gap,mixed\n" + "\n".join(f"{k},{k}.5e1,{'uv'[k % 2]},2012-01-0{k + 1} 10:00:00,{'?' if k % 2 else k},,{'ten' if k == 3 else k}" for k in range(8)) + "\n")
    f = read_delimited(spark, str(p))
    kinds = dict(f.df.dtypes)
    assert (kinds["n"], kinds["x"], kinds["e"], kinds["t"]) == ("bigint", "double", "string", "timestamp")
    got = rows(f)
    assert got[2] == (2, 25.0, "u", datetime.datetime(2012, 1, 3, 10), None, None, 2) and got[3][6] is None and all(r[4] is None for r in got)


def test_number_forms(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("v,w\n.5,1\n+.6e102,1\n-3.,1\n$7,1\n50%,1\n1e,1\nNaN,1\n 4 ,1\n8,1\n9,1\n10,1\n11,1\n12,1\n")
    v = [r[0] for r in rows(read_delimited(spark, str(p)))]
    assert v[:8] == [0.5, 0.6e102, -3.0, 7.0, 0.5, None, None, 4.0]


def test_ragged_comments_and_ends_of_line(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(b"# one\n@two\na,b,c\r\n7,8,9\r\n1,2\r\n3,4,5,6\r\n\r\n7,8,9")
    assert rows(read_delimited(spark, str(p))) == [(7, 8, 9), (1, 2, None), (3, 4, 5), (7, 8, 9)]


def test_separator_needs_two_lines_that_agree(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(b"a,b,c\n1,2\n")
    assert rows(read_delimited(spark, str(p))) == [("a,b,c",), ("1,2",)]
    assert rows(read_delimited(spark, str(p), header=True, separator=",")) == [(1, 2, None)]


def test_blank_separated_and_quoted(spark, tmp_path):
    (tmp_path / "s.txt").write_text("  1  2 x\n  3   4 y\n")
    assert rows(read_delimited(spark, str(tmp_path / "s.txt"))) == [(1, 2, "x"), (3, 4, "y")]
    (tmp_path / "q.csv").write_text("a,b\n'x,1',1\n'y',2\n")
    assert rows(read_delimited(spark, str(tmp_path / "q.csv"))) == [("x,1", 1), ("y", 2)]


def test_compressed(spark, tmp_path):
    text = "a,b\n1,2\n3,4\n"
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.csv", text)
        z.writestr("two.csv", "9,9\n")
    for name, kind in (("g.csv.gz", "gzip"), ("z.zip", "zip")):
        assert compression((tmp_path / name).read_bytes()) == kind
        assert rows(import_path(spark, str(tmp_path / name))) == [(1, 2), (3, 4)]


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><t>size</t></si><si><r><t>b</t></r><r><t>ig</t></r></si></sst>')
        head = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{head}<row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="m"><sheetData>{head}<row><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    f = read_xlsx(spark, str(tmp_path / "w.xlsx"))
    assert f.names == ["name", "size"] and rows(f) == [("big", 4.5), (None, 7.0)]


def test_parquet_and_export(spark, tmp_path):
    from quillframe.registry import Registry

    reg = Registry(spark)
    reg.put_vector("v", [1.0, 2.0])
    reg.export("v", str(tmp_path / "out"))
    assert sorted(rows(import_path(spark, str(tmp_path / "out")))) == [(1.0,), (2.0,)]


def test_files_keep_their_order_and_only_leading_lines_go(spark, tmp_path):
    """Files by name, whatever their sizes; the header's words and comment marks further down are data."""
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.csv").write_text("#x\nname,n\nu,1\n#v,2\nname,3\n")
    (d / "b.csv").write_text("name,n\n" + "".join(f"w{k},{k}\n" for k in range(10, 3000)))
    (d / "c.csv").write_text("z,5\n")
    got = rows(read_delimited(spark, str(d), header=True, separator=","))
    assert got[:3] == [("u", 1), ("#v", 2), ("name", None)] or got[:3] == [("u", 1), ("#v", 2), ("name", 3)]
    assert got[3:5] == [("w10", 10), ("w11", 11)] and got[-1] == ("z", 5) and len(got) == 3 + 2990 + 1


def test_wide_text_is_kept_unless_given_up(spark):
    df = spark.range(70_000).selectExpr("concat('t', id) as a")
    assert infer(df, ["a"]) == {"a": "enum"} and infer(df, ["a"], give_up_wide=True) == {"a": "bad"}


def test_inspect_of_unparsed_data(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("# c\na;b\n" + "1;2\n" * 50_000)
    i = inspect_path(spark, str(p))
    assert (i["separator"], i["header"], i["names"], i["rows"][0], i["compression"]) == (";", True, ["a", "b"], ["1", "2"], "none") and abs(i["about_rows"] - 50_000) < 500
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x", "a")
    assert inspect_path(spark, str(tmp_path / "z.zip"))["compression"] == "zip"


def test_url(spark, tmp_path):
    (tmp_path / "v.csv").write_text("a,b\n1,x\n2,y\n")
    assert rows(import_url(spark, f"file://{tmp_path}/v.csv")) == [(1, "x"), (2, "y")]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_first_files_without_lines(spark, tmp_path):
    """As parts of a table that have no rows leave them: no bytes, blank lines, comments or a header alone, in folders too."""
    d = tmp_path / "d"
    (d / "a" / "none").mkdir(parents=True)
    for name, text in (("a/none/x", ""), ("a/y", "\n \n"), ("b", ""), ("c", "# c\n"), ("d", "1;u\n2;v\n"), ("e", "3;w\n")):
        (d / name).write_text(text)
    f = import_path(spark, str(d))
    assert f.names == ["0", "1"] and rows(f) == [(1, "u"), (2, "v"), (3, "w")]
    h = tmp_path / "h"
    h.mkdir()
    for name, text in (("a", "n,x\n"), ("b", "n,x\n1,u\n"), ("c", "n,x\n2,v\n")):
        (h / name).write_text(text)
    f = import_path(spark, str(h))
    assert f.names == ["n", "x"] and rows(f) == [(1, "u"), (2, "v")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a").write_text("")
    (tmp_path / "one" / "b").write_text("7\n")
    assert rows(import_path(spark, str(tmp_path / "one"))) == [(7,)]


def test_timestamps_whose_first_part_is_empty(spark, tmp_path):
    """One row group over several splits: its rows are in a later one."""
    from quillframe.plans.queries import QUERIES

    spark.range(20_000).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id) as ts", "cast(id as double) as value", "sha2(cast(id as string), 256) as props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
    try:
        assert QUERIES["csv_timestamps"](spark, str(tmp_path)).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gzip_whose_first_part_is_empty(spark, tmp_path):
    """A compressed file without lines has bytes all the same."""
    from quillframe.plans.queries import QUERIES

    d = tmp_path / "d"
    d.mkdir()
    for name, text in (("a.gz", ""), ("b.gz", "\n"), ("c.gz", " 1   2\n 3  4\n"), ("d.gz", "5 6\n")):
        with gzip.open(d / name, "wt") as f:
            f.write(text)
    assert rows(import_path(spark, str(d))) == [(1, 2), (3, 4), (5, 6)]
    assert inspect_path(spark, str(d))["rows"] == [["1", "2"], ["3", "4"]]
    spark.range(20_000).selectExpr("id as c_custkey", "sha2(cast(id as string), 256) as c_name", "cast(id % 25 as int) as c_nationkey", "cast(id as double) / 4 as c_acctbal").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
    try:
        assert QUERIES["gzip_scan"](spark, str(tmp_path)).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
