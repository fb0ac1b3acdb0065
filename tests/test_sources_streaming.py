import hashlib
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillscope.sources import files, sinks
from tillscope.streaming.votes import judge_sessions, running_votes


def test_labels(spark, tmp_path):
    rows = ['image,digital annotation,handwritten annotation,forged,forgery annotations', 'a.png,x,y,True,"{""k"": ""1,2""}"', "b.jpg,,,1,", "c.jpg,,,TRUE,", "d.jpg,,,false,", ",,,True,", "e.jpg,,,,", "a.png,,,False,"]
    (tmp_path / "train.csv").write_text("\n".join(rows))
    (tmp_path / "val.txt").write_text("\n".join(rows[:3]))
    got = {(r.split, r.receipt_id): r.label for r in files.label_table(spark, str(tmp_path), ["train", "val"]).collect()}
    assert got == {("train", k): v for k, v in zip("abcde", ("REAL", "FAKE", "FAKE", "REAL", "REAL"), strict=True)} | {("val", "a"): "FAKE", ("val", "b"): "FAKE"}
    with pytest.raises(FileNotFoundError):
        files.label_table(spark, str(tmp_path), ["test"])


def test_locate(spark, tmp_path):
    for f in ("train/a.jpg", "test/a.png", "val/b.png", "raw/deep/c.jpeg"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    e = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", None), ("d", "val")], "receipt_id string, split string")
    got = {r.receipt_id: (r.path or "").rpartition("/")[2] for r in files.locate(e, files.file_index(spark, str(tmp_path)), "path").collect()}
    assert got == {"a": "a.jpg", "b": "b.png", "c": "c.jpeg", "d": ""}


def test_texts_and_hashes(spark, tmp_path):
    (tmp_path / "r1.txt").write_text("TOTAL 1.00\nx")
    assert [(r.receipt_id, r.text) for r in files.texts(spark, str(tmp_path)).collect()] == [("r1", "TOTAL 1.00\nx")]
    assert len(files.hashes(spark, str(tmp_path)).first().sha256) == 64


def test_receipt_texts_lie_in_few_files_whatever_ids_and_texts_hold(spark, tmp_path):
    """A file for each receipt does not end at 820,000 receipts, and ids in paths come back escaped."""
    odd = ["a b", "c/d", "e=1", "é:", "%41", "__HIVE_DEFAULT_PARTITION__", "", 'q"\\', "l\nm", "Ab", "aB"]
    texts = ["x", " ", "\n", "a\r\nb\n", "ends\0", "\0", '{"text": "\\u0041"}', "\ufeffz", "総計 😀\u2028", "t\t\\n", "\u0001"]
    rows = [(*r,) for r in zip(odd, texts, strict=True)] + [("n1", None), ("n2", ""), (None, "y"), ("e=1", "B"), ("e=1", "a")] + [(f"r{i}", f"TOTAL {i}") for i in range(200)]
    spark.createDataFrame(rows, "receipt_id string, cleaned_text string").write.parquet(str(tmp_path / "ocr_structured.parquet"))
    got = entry.queries()["receipt_texts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view ocr_structured as select * from '{tmp_path}/ocr_structured.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(entry.oracle_sql()["receipt_texts"]).fetchall())
    assert len(got.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_packed_texts(spark, tmp_path):
    t = spark.createDataFrame([("a", "TOTAL 1.00\nx"), ("b", "")], "receipt_id string, text string")
    long = spark.range(1).select(F.lit("c").alias("receipt_id"), F.repeat(F.lit("é"), F.lit(25_000_000)).alias("text"))
    sinks.write_texts(t.unionByName(long), str(tmp_path / "t"))
    got = files.texts(spark, str(tmp_path / "t"), one_per_file=False)
    assert sorted(tuple(r) for r in got.where("receipt_id <> 'c'").select("receipt_id", "text").collect()) == [("a", "TOTAL 1.00\nx"), ("b", "")]
    assert got.where("receipt_id = 'c'").select(F.md5("text")).first()[0] == hashlib.md5(("é" * 25_000_000).encode()).hexdigest()
    (tmp_path / "t" / "part-broken.json").write_text('{"receipt_id": "d", "text": "x')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.texts(spark, str(tmp_path / "t"), one_per_file=False).collect()


def test_archive(tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.txt", "hello")
    assert files.valid_archive(str(z)) and not files.valid_archive(str(z), "00") and files.extract_archive(str(z), str(tmp_path / "o")) and not files.extract_archive(str(z), str(tmp_path / "o"))
    calls = []

    def opener(url):
        calls.append(url)
        if len(calls) < 2:
            raise OSError("down")
        return z.open("rb")

    assert files.download("u", str(tmp_path / "b.zip"), opener, delay=0) and len(calls) == 2
    assert files.download("u", str(tmp_path / "b.zip"), opener) and len(calls) == 2
    with pytest.raises(RuntimeError):
        files.download("u", str(tmp_path / "c.zip"), lambda u: (tmp_path / "nothing").open("rb"), delay=0)


def test_json_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", float("nan"), [1.0, float("inf")], None)], "receipt_id string, x double, y array<double>, s string")
    assert json.loads(sinks.as_json(d, "receipt_id").first().json) == {"receipt_id": "a", "x": None, "y": [1.0, None], "s": None}
    m = spark.sql("select 'a' as k, map('x', double('nan'), 'y', 1d) as m")
    assert json.loads(sinks.as_json(m, "k").first().json)["m"] == {"x": None, "y": 1.0}
    sinks.write_missing(d, None, str(tmp_path / "t"))
    sinks.write_missing(d, spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_last_answer_of_a_judge_stands_in_a_stream(spark, tmp_path):
    rows = [(1, "r", "j", 1, "REAL", "2024-01-01 10:00:00"), (2, "r", "j", 2, " fake ", "2024-01-01 09:00:00"), (3, "r", "j", 2, "fake", "2024-01-01 08:00:00"), (4, "r", "k", 1, "REAL", "2024-01-01 10:00:00"), (5, "r", None, 1, "REAL", "2024-01-01 10:00:00")]
    t = spark.createDataFrame(rows, "result_id long, receipt_id string, judge_id string, attempt int, label string, judged_at string").withColumn("judged_at", F.to_timestamp("judged_at"))
    t.write.parquet(str(tmp_path / "in"))
    q = running_votes(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("last_votes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.fake, r.real, r.uncertain) for r in spark.table("last_votes").collect()] == [(2, 1, 1, 0)]


def test_probe_listing_and_metadata(spark, tmp_path):
    assert files.probe("u", lambda u: {"Content-Length": "12"}) == 12 and files.probe("u", lambda u: {}) is None

    def down(url):
        raise OSError("down")

    with pytest.raises(ConnectionError):
        files.probe("u", down)
    z, waits = tmp_path / "a.zip", []
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.txt", "hello")
    size = {"content-length": str(z.stat().st_size)}
    assert files.download("u", str(tmp_path / "b.zip"), lambda u: z.open("rb"), head=lambda u: size)
    with pytest.raises(RuntimeError):
        files.download("u", str(tmp_path / "c.zip"), lambda u: z.open("rb"), head=lambda u: {"content-length": "3"}, sleep=waits.append)
    assert waits == [5.0, 5.0]
    for f in ("train/b.jpg", "train/a.png", "val/c.png", "train/n.txt"):
        (tmp_path / "i" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "i" / f).write_bytes(b"x")
    index = files.file_index(spark, str(tmp_path / "i"))
    assert [r.stem for r in files.list_images(index, "train").collect()] == ["a", "b"] and files.list_images(index).count() == 3
    (tmp_path / "m.csv").write_text('image,forged,extra\na.png,TRUE,"1,2"\nb.png,,\n')
    assert [tuple(r) for r in files.split_info(spark, str(tmp_path / "m.csv"), "val").collect()] == [("a.png", "TRUE", "1,2", "FAKE", "val"), ("b.png", None, None, "REAL", "val")]
    with pytest.raises(FileNotFoundError):
        files.split_info(spark, str(tmp_path / "none.csv"), "val")


def test_streams(spark, tmp_path, data):
    r = spark.read.parquet(f"{data}/judge_results.parquet").select("result_id", "receipt_id", "judge_id", "label", "judged_at")
    r.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    q = running_votes(s, "3650 days").writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    n = spark.table("running").agg(F.sum("n")).first()[0]
    assert n == r.where("receipt_id is not null").select("receipt_id", "judge_id", F.window("judged_at", "1 day")).distinct().count()
    assert judge_sessions(r).agg(F.sum("n")).first()[0] == r.where("judge_id is not null").count()
