import shutil
from pathlib import Path

from pyspark.sql import functions as F

from tillscope.operators.timestamps import VERSION, _batches, dictionary, normalise

SITES = [("KUL1", "Asia/Kuala_Lumpur", "DMY"), ("NYC1", "America/New_York", "MDY"), ("TYO1", "Asia/Tokyo", "YMD"), ("BKK1", "Asia/Bangkok", "DMY"), ("BER1", "Europe/Berlin", "DMY")]
CASES = [
    ("KUL1", "DATE: 12/03/2024 18:05", "2024-03-12T10:05:00Z"), ("NYC1", "12/03/2024 6:05 PM", "2024-12-03T23:05:00Z"), ("NYC1", "13/03/2024", "2024-03-13"),
    ("TYO1", "24-01-02 00:30:15,999", "2024-01-01T15:30:15Z"), ("BKK1", "31/01/2567 07.15", "2024-01-31T00:15:00Z"), ("KUL1", "REF 47-88-8319", None), ("KUL1", "31/02/2024", None),
    ("BER1", "2024-10-27 02:30", "2024-10-27T00:30:00Z"), ("BER1", "2024-10-27 02:30 CET", "2024-10-27T01:30:00Z"), ("BER1", "2024-03-31 02:30", "2024-03-31T01:30:00Z"),
    (None, "2022-06-17 04:55:35.514113+01:00", "2022-06-17T03:55:35Z"), ("KUL1", "2023-02-11T15:40:25.146 GMT-5", "2023-02-11T20:40:25Z"), ("KUL1", "2024-05-01T00:00:00Z", "2024-05-01T00:00:00Z"),
    ("NYC1", "16:04 5/7/2025", "2025-05-07T20:04:00Z"), ("KUL1", "TXN 28 Oct 2025 - 04:55:53 AM TILL 3", "2025-10-27T20:55:53Z"), ("KUL1", "5DEC2022, 16h48", "2022-12-05T08:48:00Z"), ("KUL1", "DT:１１:３０ ０６/０９/２０２３", "2023-09-06T03:30:00Z"),
    ("KUL1", "12:00 a.m. 01/02/2024 (IST)", "2024-01-31T18:30:00Z"), ("KUL1", "VENCE 2024/8/6", "2024-08-06"), ("ZZZ", "2024-08-06 10:00", "2024-08-06T10:00:00Z"), ("KUL1", "2024-02-30 10:00", None), ("KUL1", "25:70 01/02/2024", "2024-02-01"),
    ("KUL1", "20240312", "2024-03-12"), ("KUL1", "20240312T180500Z", "2024-03-12T18:05:00Z"), ("KUL1", "20240312180500", "2024-03-12T10:05:00Z"), ("KUL1", "20240312 18:05", "2024-03-12T10:05:00Z"), ("KUL1", "20241332", None), ("KUL1", "NO 120240312", None),
    ("KUL1", "1700000000", "2023-11-14T22:13:20Z"), ("KUL1", "1700000000123", "2023-11-14T22:13:20Z"), ("KUL1", "TEL 1700000000", None), ("KUL1", "7000000000", None),
    ("KUL1", "12 Mac 2024", "2024-03-12"), ("BER1", "3. März 2024 18:05", "2024-03-03T17:05:00Z"), ("BER1", "1 août 2023", "2023-08-01"), ("NYC1", "12 de enero de 2024", "2024-01-12"), ("KUL1", "MARKET DISCOUNT 12", None),
    ("KUL1", "١٢/٠٣/٢٠٢٤", "2024-03-12"), ("KUL1", "१२/०३/२०२४ १८:०५", "2024-03-12T10:05:00Z"), ("BKK1", "๑๒/๐๓/๒๕๖๗", "2024-03-12"),
]


def rows(spark, entries):
    return spark.createDataFrame([(i, s, [None, e], "clash") for i, (s, e, *_) in enumerate(entries)], "ocr_id long, site_code string, date_candidates array<string>, zone string")


def sites(spark):
    return spark.createDataFrame(SITES, "site_code string, time_zone string, date_order string")


def test_cases(spark):
    got = {r.ocr_id: (r.pos, r.utc_value) for r in normalise(rows(spark, CASES), sites(spark)).collect()}
    assert got == {i: (1, v) for i, (_, _, v) in enumerate(CASES) if v}


def test_repeated_empty_and_null(spark):
    d = rows(spark, [CASES[0]]).unionByName(rows(spark, [CASES[0]])).unionByName(spark.createDataFrame([(9, None, None, None), (10, "KUL1", [], None)], rows(spark, CASES).schema))
    assert normalise(d, sites(spark)).count() == 2
    assert normalise(d.limit(0), sites(spark)).count() == 0


def test_long_entry(spark):
    d = rows(spark, [("KUL1", "x" * 200_000 + " 01/02/2024 " + "9" * 50_000)])
    assert [r.utc_value for r in normalise(d, sites(spark)).collect()] == ["2024-02-01"]


def test_dictionary_grows_by_new_entries_only(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    batches = lambda: [spark.read.parquet(b).count() for b in _batches(spark, f"{path}/parser={VERSION}")]
    assert normalise(rows(spark, CASES[:5]), sites(spark), path=path).count() == 5 and batches() == [5]
    assert normalise(rows(spark, CASES[3:8]), sites(spark), path=path).count() == 3 and sorted(batches()) == [3, 5]
    assert normalise(rows(spark, CASES[:8]), sites(spark), path=path).count() == 6 and sorted(batches()) == [0, 3, 5]
    e = rows(spark, CASES[:5]).select(F.col("date_candidates")[1].alias("raw"), F.lit(None).cast("string").alias("zone"), F.lit(None).cast("string").alias("date_order"))
    assert dictionary(e).count() == 5


def test_dictionary_survives_failed_and_concurrent_writes(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    want = sorted(map(tuple, normalise(rows(spark, CASES), sites(spark), path=path).collect()))
    (batch,) = _batches(spark, f"{path}/parser={VERSION}")
    folder = Path(batch.removeprefix("file:"))
    # The same entries added by another run, and what a run left that failed.
    shutil.copytree(folder, folder.with_name("batch-other"))
    shutil.copytree(folder, folder.with_name("batch-failed"))
    (folder.with_name("batch-failed") / "_SUCCESS").unlink()
    assert len(_batches(spark, f"{path}/parser={VERSION}")) == 2
    assert sorted(map(tuple, normalise(rows(spark, CASES), sites(spark), path=path).collect())) == want
