import pytest
from pyspark.sql import types as T

from sparkrinse.sources import readers
from sparkrinse.sources.metadata import dataset_metadata
from sparkrinse.sources.readers import NA_TOKENS, detect_delimiter, detect_encoding, read_dataset
from sparkrinse.sources.writers import publish_report, read_manifest, read_report, write_audit, write_table
from workload import analysis


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ragged_rows(spark, tmp_path):
    path = put(tmp_path, "ragged.csv", 'a,b,c\n1,x,2.5\n2,y\n3,z,4,5\n,,\n\n4,"p,q",1\n5,"he said ""hi""",2\n')
    assert rows(read_dataset(spark, path)) == sorted(
        [(1, "x", 2.5), (2, "y", None), (None, None, None), (4, "p,q", 1.0), (5, 'he said "hi"', 2.0)], key=str
    )


@pytest.mark.parametrize("name, sep", [("semi.csv", ";"), ("tab.tsv", "\t"), ("pipe.txt", "|"), ("comma", ",")])
def test_layouts(spark, tmp_path, name, sep):
    path = put(tmp_path, name, "\n".join(sep.join(r) for r in (("k", "v"), ("1", "a"), ("2", "b"))) + "\n")
    assert detect_delimiter(spark, path) == sep
    assert rows(read_dataset(spark, path)) == [(1, "a"), (2, "b")]


def test_single_column(spark, tmp_path):
    assert rows(read_dataset(spark, put(tmp_path, "one.csv", "v\na\nb\n"))) == [("a",), ("b",)]


def test_encodings(spark, tmp_path):
    latin = put(tmp_path, "latin.csv", "k,v\n1,été\n".encode("latin-1"))
    marked = put(tmp_path, "marked.csv", b"\xef\xbb\xbf" + "k,v\n1,été\n".encode())
    cut = put(tmp_path, "cut.csv", "k,v\n" + "1," + "a" * 32761 + "é\n")
    assert [detect_encoding(spark, p) for p in (latin, marked, cut)] == ["ISO-8859-1", "UTF-8", "UTF-8"]
    assert rows(read_dataset(spark, latin)) == rows(read_dataset(spark, marked)) == [(1, "été")]
    assert read_dataset(spark, marked).columns == ["k", "v"]
    assert read_dataset(spark, cut).first()["v"].endswith("é")


def test_missing_tokens(spark, tmp_path):
    lines = [f'{i},"{t}"' for i, t in enumerate(NA_TOKENS)] + ['98,"  "', "99,kept"]
    found = dict(rows(read_dataset(spark, put(tmp_path, "na.csv", "k,v\n" + "\n".join(lines) + "\n"))))
    assert found.pop(98) == "  " and found.pop(99) == "kept"
    assert set(found.values()) == {None} and len(found) == len(NA_TOKENS)


def test_types(spark, tmp_path):
    path = put(tmp_path, "t.csv", "i,d,b,s,n\n1,1.5,True,x,\n2,2,FALSE,1x,NA\n")
    kinds = [f.dataType.simpleString() for f in read_dataset(spark, path).schema.fields]
    assert kinds == ["bigint", "double", "boolean", "string", "double"]


def test_headers(spark, tmp_path):
    assert read_dataset(spark, put(tmp_path, "h.csv", "a,a, a, Order Date \n1,2,3,x\n")).columns == ["a", "a_2", "a_3", "Order Date"]


def test_guards(spark, tmp_path):
    for name, content in (("empty.csv", ""), ("header.csv", "a,b\n"), ("book.xlsx", "x")):
        with pytest.raises(ValueError):
            read_dataset(spark, put(tmp_path, name, content))
    with pytest.raises(Exception):
        read_dataset(spark, str(tmp_path / "absent.csv"))


def test_metadata(spark, tmp_path):
    path = put(tmp_path, "m.csv", "a,b\n1,x\n1,x\n2,\n")
    found = dataset_metadata(read_dataset(spark, path), path, "UTF-8", ",").first()
    assert (found["file_name"], found["file_size_bytes"], found["row_count"]) == ("m.csv", 15, 3)
    assert (found["missing_cells_total"], found["duplicate_rows_total"], found["has_empty_cells"]) == (1, 1, True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "step INT, v STRING")
    write_table(df, str(tmp_path / "t"), partition_by=["step"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    write_audit(df, str(tmp_path / "audit"))
    assert len(list((tmp_path / "audit").glob("*.csv"))) == 1


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x\ny, ""z"""\n2,z\n')
    (tmp_path / "b.csv").write_text('id,note\r\n3,plain\r\n')
    rows = read_dataset(spark, str(tmp_path), fmt="csv").collect()
    assert sorted((r["id"], r["note"]) for r in rows) == [(1, 'x\ny, "z"'), (2, "z"), (3, "plain")]


def test_files_with_other_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("b,a\ny,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_dataset(spark, str(tmp_path), fmt="csv")


def _split_small(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, (size, 0)):
        spark.conf.set(n, v)
    return before


def test_quoted_breaks_in_byte_ranges(spark, tmp_path):
    """Records that end in the range they began in, in the next one, and several ranges later."""
    import csv as reader
    import random

    from sparkrinse.sources import quoted_lines

    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = rng.choice(["plain", "two\nlines", 'say ""hi""\nthere, you', "\n\n", "x" * 700 + "\n" + "y, " * 300, "ä\r\nö", "", "\n".join("abcdefgh" * 9)])
        rows.append(rng.choice([f'{i},"{text}",z', f'{i},"{text}"', f"{i}", f'{i},"{text}",z,"more\nof it"', ""]))
    path = tmp_path / "broken"
    path.mkdir()
    for name, part in (("a.csv", rows[:300]), ("b.csv", rows[300:])):
        (path / name).write_text("\n".join(["id,text,last", *part, ""]), encoding="utf-8", newline="")
    expected = []
    for part in (rows[:300], rows[300:]):
        for row in reader.reader(("\n".join(part) + "\n").splitlines(keepends=True)):
            if row and len(row) <= 3:
                expected.append(tuple(x or None for x in row) + (None,) * (3 - len(row)))
    before = _split_small(spark, 900)
    try:
        blocks = {r["block"] for r in quoted_lines.quoted_records(spark, str(path)).select("block").collect()}
        found = readers.read_delimited(spark, str(path), sep=",")
        assert len(blocks) > 20
        assert sorted((tuple(x or None for x in r) for r in found.collect()), key=str) == sorted(expected, key=str)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_quotes_inside_values_are_left_to_the_parser(spark, tmp_path):
    path = tmp_path / "inches.csv"
    path.write_text('id,size\n1,5" pipe\n2,"two\nlines"\n')
    columns = T.StructType([T.StructField("c0", T.StringType()), T.StructField("c1", T.StringType())])
    assert readers._quoted_rows(spark, str(path), ",", "UTF-8", columns) is None
    assert [tuple(r) for r in readers.read_delimited(spark, str(path)).collect()] == [("1", '5" pipe'), ("2", "two\nlines")]


def test_a_report_is_all_there_or_not_there(spark, tmp_path):
    folder = str(tmp_path / "report")
    first = {"small": spark.range(3), "texts": spark.createDataFrame([("a", 1.5), (None, None)], "t STRING, x DOUBLE")}
    publish_report(first, folder)
    broken = first | {"small": spark.range(9), "broken": spark.range(5).selectExpr("raise_error('no') AS x", "id")}
    with pytest.raises(Exception, match="no"):
        publish_report(broken, folder)
    back = read_report(spark, folder)
    assert set(back) == {"small", "texts"} and back["small"].count() == 3
    assert rows(back["texts"]) == rows(first["texts"]) and back["texts"].schema == first["texts"].schema
    version = publish_report({"small": spark.range(7)}, folder, fmt="csv")
    back = read_report(spark, folder)
    assert set(back) == {"small"} and sorted(r["id"] for r in back["small"].collect()) == list(range(7))
    assert [(r["version"], r["rows"]) for r in read_manifest(spark, folder).collect()] == [(version, 7)]


def test_files_with_quoted_breaks_grow_in_number(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "é" * 50) for i in range(10)], "doc_id INT, text STRING")
    assert analysis.csv_files(rows) == 3 and analysis.csv_files(rows.limit(0)) == 3
    monkeypatch.setattr(analysis, "CSV_FILE_BYTES", 130)
    assert analysis.csv_files(rows) == 8
    monkeypatch.setattr(analysis, "CSV_FILE_BYTES", 50_000)
    back = analysis.csv_quoted_breaks(spark, "/root/testdata/sf0.001")
    assert back.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
