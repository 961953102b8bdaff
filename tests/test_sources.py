import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewise.sources import archives, files


def test_csv_as_a_careless_tool_writes_it(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(
        "﻿ order id ,note,price\n"
        'o1,"a, ""b""",1.5\n'
        "o2,N/A\n"
        "o3,x,2,surplus\n"
        "\n"
        'o4,"",NaN\n'.encode()
    )
    df = files.read_csv(spark, str(path))
    assert df.columns == ["order id", "note", "price"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("o1", 'a, "b"', "1.5"), ("o2", None, None), ("o4", None, None)]
    assert df.select("order id").count() == 3  # the surplus row is out whatever is selected


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert files.has_line_breaks_in_quotes(spark, str(path), "UTF-8")
    assert sorted(tuple(r) for r in files.read_csv(spark, str(path)).collect()) == [("1", "two\nlines"), ("2", "x")]


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("n\nGröße\n".encode())
    (tmp_path / "l.csv").write_bytes("n\nGröße\n".encode("latin-1"))
    paths = [str(tmp_path / "u.csv"), str(tmp_path / "l.csv")]
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.probe_encodings(spark, paths).collect()}
    assert found == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1"}
    tables, facts, _ = files.read_tables(spark, paths, "abcd1234-x")
    assert [t.first()[0] for t in tables.values()] == ["Größe", "Größe"]
    assert facts["abcd1234_l"]["encoding"] == "ISO-8859-1"


def test_guard(spark, tmp_path):
    for name, size in (("a.csv", 10), ("b.exe", 10), ("c.zip", 500)):
        (tmp_path / name).write_bytes(b"x" * size)
    listed = files.list_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1] for r in files.check_files(listed).collect()} == {"b.exe"}
    assert files.check_files(listed, max_bytes=100).count() == 2


def packed(**members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as out:
        for name, text in members.items():
            out.writestr(name, text)
    return raw.getvalue()


def test_zip_members(spark, tmp_path):
    content = packed(**{
        "orders.csv": "id,v\n1,2\n2,3,4\n3\n", "deep/items.csv": "k\nNA\nz\n", "__MACOSX/orders.csv": "x\n1\n",
        ".hidden.csv": "x\n1\n", "deep/.dot.csv": "x\n", "readme.txt": "no",
    })
    (tmp_path / "all.zip").write_bytes(content)
    tables = archives.archive_tables(spark, str(tmp_path / "all.zip"))
    assert sorted(tables) == ["deep/items.csv", "orders.csv"]
    assert sorted(tuple(r) for r in tables["orders.csv"].collect()) == [("1", "2"), ("3", None)]
    assert sorted(str(r[0]) for r in tables["deep/items.csv"].collect()) == ["None", "z"]


def test_broken_archives(spark):
    bad = spark.createDataFrame([("bad.zip", bytearray(b"nope"))], "path string, content binary")
    with pytest.raises(Exception, match="cannot be read as a ZIP"):
        archives.unzip_rows(bad).collect()
    good = bytearray(packed(**{"a.csv": "h\n" + "1\n" * 50, "b.csv": "h\n2\n"}))
    at = good.find(b"1\n1\n1")
    good[at : at + 4] = b"XXXX"  # checksum of one member fails
    rows = archives.unzip_rows(spark.createDataFrame([("x.zip", good)], "path string, content binary")).collect()
    assert [(r["member"], r["row_no"]) for r in rows if r["problem"]] == [("a.csv", -1)]
    assert [r["fields"] for r in rows if r["member"] == "b.csv"] == [["h"], ["2"]]


def test_equal_names_are_all_kept(spark, tmp_path):
    for folder, text in (("2023", "id\n1\n"), ("2024", "id\n2\n"), ("x/2024", "id\n3\n")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "orders.csv").write_text(text)
    for name, text in (("a", "id\n4\n"), ("b", "id\n5\n")):
        (tmp_path / f"{name}.zip").write_bytes(packed(**{"orders.csv": text}))
    paths = [str(tmp_path / p) for p in ("2023/orders.csv", "2024/orders.csv", "x/2024/orders.csv", "a.zip", "b.zip")]
    tables, facts, warnings = files.read_tables(spark, paths, "abcd1234-x")
    assert sorted(t.first()[0] for t in tables.values()) == ["1", "2", "3", "4", "5"]
    assert sorted(tables) == sorted(facts) and not warnings
    both = archives.archive_tables(spark, str(tmp_path / "*.zip"))
    assert sorted((n, t.first()[0]) for n, t in both.items()) == [("a.zip!orders.csv", "4"), ("b.zip!orders.csv", "5")]


def test_broken_members_are_reported(spark, tmp_path):
    raw = bytearray(packed(**{"a.csv": "h\n" + "1\n" * 50, "b.csv": "h\n2\n"}))
    at = raw.find(b"1\n1\n1")
    raw[at : at + 4] = b"XXXX"
    (tmp_path / "x.zip").write_bytes(raw)
    tables, _, warnings = files.read_tables(spark, [str(tmp_path / "x.zip")], "abcd1234-x")
    assert len(tables) == 1 and len(warnings) == 1 and "a.csv" in warnings[0]


def test_unsupported_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="none of the files"):
        files.read_tables(spark, [str(tmp_path / "a.txt")], "s")


def test_surplus_rows_are_counted_and_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n1,2,3\n"x,y",2\n"p,""q""",2,3\n1\n')
    (tmp_path / "b.zip").write_bytes(packed(**{"m.csv": "a,b\n1,2\n1,2,3\n"}))
    assert files.skipped_rows(spark, str(tmp_path / "a.csv")).first()["skipped"] == 2
    tables, _, warnings = files.read_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.zip")], "abcd1234-x")
    assert sorted(warnings) == ["'a.csv': 2 rows with surplus fields are left out", "'m.csv': 1 rows with surplus fields are left out"]
    assert [df.count() for df in tables.values()] == [3, 1]


def test_long_records_are_counted_in_one_pass(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n" + ",".join(["1"] * 20_000) + "\n3,4\n")
    assert files.skipped_rows(spark, str(tmp_path / "wide.csv"), multi_line=False).first()["skipped"] == 1
    assert files.read_csv(spark, str(tmp_path / "wide.csv"), multi_line=False).filter("a = '3'").count() == 1


def test_members_are_partitions_and_are_read_as_streams(spark, tmp_path, monkeypatch):
    """A large member is never whole in memory: no piece that is asked for is larger than a piece."""
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("large.csv", "id,text\n" + "".join(f"{i},{'x' * 50}\n" for i in range(200_000)))
        out.writestr("latin.csv", "n\nGröße\n".encode("latin-1"))
        out.writestr("mark.csv", "\ufeffn\nGröße\n".encode())
    reader = archives.ZipCsvReader({"archives": f'["{tmp_path}/big.zip"]'})
    parts = reader.partitions()
    assert [p.name for p in parts] == ["large.csv", "latin.csv", "mark.csv"]
    asked, plain = [], zipfile.ZipExtFile.read
    monkeypatch.setattr(zipfile.ZipExtFile, "read", lambda self, n=-1: asked.append(n) or plain(self, n))
    batches = list(reader.read(parts[0]))
    assert sum(b.num_rows for b in batches) == 200_001 and max(b.num_rows for b in batches) <= archives.ROWS_PER_BATCH
    assert 0 < min(asked) and max(asked) <= archives._PIECE
    assert batches[1].column(2)[0].as_py() == archives.ROWS_PER_BATCH
    tables = archives.archive_tables(spark, str(tmp_path / "big.zip"))
    assert tables["large.csv"].count() == 200_000
    assert [tables[n].first()[0] for n in ("latin.csv", "mark.csv")] == ["Größe", "Größe"]
    assert tables["mark.csv"].columns == ["n"]


def test_packed_archives_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 3}", None if i % 4 else 'a "q", b') for i in range(60)], "id long, kind string, note string")
    paths = archives.pack(rows, rows.kind, "rows.csv", str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["t0.zip", "t1.zip", "t2.zip"]
    tables = archives.archive_tables(spark, f"{tmp_path}/*.zip")
    assert sorted(tables) == ["t0.zip!rows.csv", "t1.zip!rows.csv", "t2.zip!rows.csv"]
    back = sorted((int(r["id"]), r["kind"], r["note"]) for df in tables.values() for r in df.collect())
    assert back == sorted((r["id"], r["kind"], r["note"]) for r in rows.collect())


def test_packing_holds_no_archive_in_a_task(spark, tmp_path):
    """One task writes an archive, but neither sorts nor gathers its rows."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).peakExecutionMemory() for i in range(found.size())}

    rows = spark.range(200_000).select("id", F.when(F.col("id") % 5 == 0, "few").otherwise("many").alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
    before = stages()
    paths = archives.pack(rows, rows.kind, "rows.csv", str(tmp_path))
    assert max(peak for stage, peak in stages().items() if stage not in before) < 4 << 20
    counts = [archives.one_table(spark, p, "rows.csv", rows.columns).agg(F.count("id"), F.countDistinct("note")).first() for p in paths]
    assert [tuple(c) for c in counts] == [(40_000, 40_000), (160_000, 160_000)]


def test_pieces_of_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "_PIECE", 1_000)
    monkeypatch.setattr(archives, "_HELD", 5_000)
    rows = spark.range(0, 30_000, 1, 2).select(F.concat(F.lit("a"), F.col("id") % 40).alias("kind"), "id")
    paths = archives.pack(rows, rows.kind, "rows.csv", str(tmp_path))
    assert len(paths) == 40
    lines = [line for p in paths for line in zipfile.ZipFile(p).read("rows.csv").decode().split("\r\n")[1:-1]]
    assert sorted(lines) == sorted(f"a{i % 40},{i}" for i in range(30_000))
    none = rows.filter("id < 0")
    assert archives.pack(none, none.kind, "rows.csv", str(tmp_path)) == []
