"""Readers and writers: types without loss, formats by suffix, torn logs, transcripts."""

import datetime as dt

import pytest

from siltstone.sources import files as R


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,zip,price,on,day,at,note,none\n1,00501,1.5,true,2024-02-29,2024-01-01T10:00:00,"a, ""b""\nc",\n2,10001,2,False,2023-01-01,2024-01-01 11:30,x,\n')
    df = R.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "zip": "string", "price": "double", "on": "boolean", "day": "date", "at": "timestamp_ntz", "note": "string", "none": "string"}
    first = df.orderBy("id").first()
    assert (first["zip"], first["note"], first["day"], first["none"]) == ("00501", 'a, "b"\nc', dt.date(2024, 2, 29), None)


def test_loss_keeps_strings(spark):
    df = R.typed(spark.createDataFrame([("2023-02-30", "12345678901234567890", "1"), ("2023-02-01", "1", "x")], "d string, n string, m string"))
    assert {t for _, t in df.dtypes} == {"string"}


def test_encoding(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("name\ncafé\n".encode("cp1252"))
    assert R.read_table(spark, str(tmp_path / "t.csv")).first()["name"] == "café"


@pytest.mark.parametrize("suffix", ["csv", "tsv", "parquet", "jsonl"])
def test_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, 'a "q"\tb', None), (2, "x,y", 2.5)], "a long, b string, c double")
    R.write_table(df, str(tmp_path / f"t.{suffix}"))
    assert sorted(R.read_table(spark, str(tmp_path / f"t.{suffix}")).select("a", "b", "c").collect()) == sorted(df.collect())


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two\n")
    (tmp_path / "b.csv").write_text("k,Body\n1,some words\n")
    (tmp_path / "c.csv").write_text("k,words\n1,the widest column\n")
    got = [sorted(r["text"] for r in R.read_texts(spark, str(tmp_path / f)).collect()) for f in ("a.txt", "b.csv", "c.csv")]
    assert got == [[" two", "one"], ["some words"], ["the widest column"]]
    with pytest.raises(ValueError):
        R.read_table(spark, "x.bin")


def test_log_and_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n{"a": 3, "b"')
    assert sorted(r["a"] for r in R.read_log(spark, str(tmp_path / "l.jsonl"), "a long, b string").collect()) == [1, 2]
    for n in ("f10.png", "f2.png"):
        (tmp_path / n).write_bytes(b"x")
    found = R.list_files(spark, str(tmp_path), "*.png")
    assert [r["path"].rsplit("/", 1)[1] for r in found.orderBy("order").collect()] == ["f2.png", "f10.png"]
    assert R.changed_files(found, found.where("path like '%f2.png'")).count() == 1


def test_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "a long, split string")
    want = {"rows": 3, "splits": {"test": 1, "train": 2}}
    assert R.write_split(df, str(tmp_path / "s")) == want == R.load_report(spark, str(tmp_path / "s/report"))


def test_transcripts(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n<v Ann>Hello\nthere\n\n00:00:03.000 --> 00:00:04.000\n<v Ann>again\n\n01:00:00.000 --> 01:00:01.000\nBob: Yes\n"
    df = spark.createDataFrame([(1, vtt), (2, "Ann: Hi\nand more\nBob: Yes: no\n"), (3, None), (4, "")], "d long, t string")
    got = [tuple(r) for r in R.parse_transcripts(df, "d", "t").orderBy("d", "turn").collect()]
    assert got == [
        (1, 1, "Ann", "Hello there again", 1.0, 4.0), (1, 2, "Bob", "Yes", 3600.0, 3601.0),
        (2, 1, "Ann", "Hi and more", None, None), (2, 2, "Bob", "Yes: no", None, None),
    ]
