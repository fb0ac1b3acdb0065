"""Scans: label files, file indexes, images, texts, result documents, configuration, archives."""

from __future__ import annotations

import time
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.text import stem_of
from tillscope.schemas import IMAGE_EXTENSIONS, SPLITS, VERDICT

TRUE = ["True", "1", "true", "TRUE"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def split_info(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Every row and column of a metadata CSV as text, with label and split; a missing file is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    forged = F.trim("forged") if "forged" in raw.columns else F.lit("False")
    label = F.when(F.coalesce(forged.isin(TRUE), F.lit(False)), "FAKE").otherwise("REAL")
    return raw.withColumns({"label": label, "split": F.lit(split)})


def list_images(index: DataFrame, split: str | None = None) -> DataFrame:
    """The files of ``file_index``, of one split if given, in the order of their paths."""
    return (index if split is None else index.where(F.col("split") == split)).orderBy("path")


def label_csv(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(receipt_id, label, split, row_pos): ``forged`` true is FAKE, else REAL; rows with a blank image are skipped.

    Quoted fields may hold commas, quotes and line ends. Of a receipt that occurs twice the last row stands.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.withColumn("row_pos", F.monotonically_increasing_id()).where(F.length(F.trim("image")) > 0)
    label = F.when(F.trim("forged").isin(TRUE), "FAKE").otherwise("REAL")
    return raw.select(stem_of(F.trim("image")).alias("receipt_id"), label.alias("label"), "row_pos").groupBy("receipt_id").agg(F.max_by("label", "row_pos").alias("label"), F.max("row_pos").alias("row_pos")).withColumn("split", F.lit(split))


def label_table(spark: SparkSession, folder: str, splits: list[str] = SPLITS) -> DataFrame:
    """All splits; each from its metadata CSV, else from its text file, else an error. The folder may be on any file system."""

    def one(split: str) -> DataFrame:
        for name in (f"{split}.csv", f"{split}.txt"):
            if _exists(spark, f"{folder}/{name}"):
                return label_csv(spark, f"{folder}/{name}", split)
        raise FileNotFoundError(f"no labels for split {split} in {folder}")

    return reduce(DataFrame.unionByName, [one(s) for s in splits])


def file_index(spark: SparkSession, root: str, extensions: list[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, stem, split, ext_rank) of the files under a folder: one listing, contents not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    ranked = F.array_position(F.array(*[F.lit(e) for e in extensions]), ext)
    split = F.regexp_extract("path", r"/(" + "|".join(SPLITS) + r")/[^/]*$", 1)
    return files.select("path", stem_of(F.col("path")).alias("stem"), F.nullif(split, F.lit("")).alias("split"), ranked.alias("ext_rank")).where("ext_rank > 0")


def locate(entries: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Adds the first file of each receipt: in its split first, then by extension, then by path; null if none."""
    e = entries.select("receipt_id", F.col("split").alias("_split"))
    order = F.struct((~F.coalesce(F.col("split") == F.col("_split"), F.lit(False))).alias("a"), "ext_rank", "path")
    best = e.join(index, e["receipt_id"] == index["stem"]).groupBy("receipt_id").agg(F.min_by("path", order).alias(column))
    return entries.join(best, "receipt_id", "left")


def with_hint(entries: DataFrame, index: DataFrame, hint: str, column: str) -> DataFrame:
    """Adds ``column``: the hinted path where such a file exists, else the one that is found by name."""
    known = index.select(F.col("path").alias("_path"))
    found = locate(entries, index, "_found")
    kept = found.join(known, F.col("_path") == F.col(hint), "left")
    return kept.withColumn(column, F.coalesce("_path", "_found")).drop("_path", "_found")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, image) decoded; undecodable files are kept with an empty image."""
    d = spark.read.format("image").load(path)
    return d.select(F.col("image.origin").alias("origin"), "image")


def texts(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """(path, receipt_id, text): whole files, or one text to a line (as ``sinks.write_texts`` leaves them).

    In whole files bytes that are no UTF-8 become replacement characters; a line that is no such document is an error.
    """
    name = F.col("_metadata.file_path")
    if not one_per_file:
        d = spark.read.schema("receipt_id string, text string").option("mode", "FAILFAST").option("maxStringLen", 2**31 - 1).json(path)
        return d.select(name.alias("path"), "receipt_id", "text")
    d = spark.read.text(path, wholetext=True)
    return d.select(name.alias("path"), stem_of(name).alias("receipt_id"), F.col("value").alias("text"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verdicts(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Verdict documents, one to a file, or one to a line (as ``sinks.write_documents`` leaves them)."""
    return spark.read.schema(VERDICT).option("multiLine", one_per_file).json(path)


def sample_file(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.explode("receipts").alias("r")).select("r.*")


def yaml_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def judges_from_config(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(j["id"], j.get("name"), float(j.get("temperature", 0)), int(j.get("max_tokens", 1024)), j.get("focus_skills"), j.get("forensic_mode", "FULL")) for j in config.get("judges", [])]
    return spark.createDataFrame(rows, "judge_id string, judge_name string, temperature double, max_tokens int, focus_skills array<string>, forensic_mode string")


def valid_archive(path: str, sha256: str | None = None) -> bool:
    """Whether a file is a ZIP with sound members, and of the given hash."""
    import hashlib

    if not zipfile.is_zipfile(path):
        return False
    with zipfile.ZipFile(path) as z:
        if z.testzip() is not None:
            return False
    if sha256 is None:
        return True
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 16), b""):
            h.update(part)
    return h.hexdigest() == sha256


def extract_archive(path: str, target: str) -> bool:
    """Extract once; a marker file makes a second call do nothing. True if something was extracted."""
    out = Path(target)
    marker = out / ".extracted"
    if marker.exists():
        return False
    out.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path) as z:
        z.extractall(out)
    marker.touch()
    return True


def probe(url: str, head) -> int | None:
    """The size that a server reports for a file, null if it reports none. ``head(url)`` gives the headers or raises."""
    try:
        given = {k.lower(): v for k, v in head(url).items()}.get("content-length")
    except Exception as e:
        raise ConnectionError(f"{url} cannot be reached: {e}") from e
    return None if given is None else int(given)


def download(url: str, target: str, opener, sha256: str | None = None, retries: int = 3, chunk: int = 1 << 13, head=None, delay: float = 5.0, sleep=time.sleep) -> str:
    """Fetch a file to ``target`` through ``opener(url)`` (a readable), by a part file and a rename; a valid file stays.

    With ``head`` the server is asked for the size first, and what was read must have it. ``delay`` seconds lie between tries.
    """
    out = Path(target)
    if out.exists() and valid_archive(target, sha256):
        return target
    size = probe(url, head) if head else None
    last: Exception | None = None
    for i in range(retries):
        if i:
            sleep(delay)
        part = out.with_suffix(out.suffix + ".part")
        try:
            with opener(url) as src, part.open("wb") as dst:
                for b in iter(lambda src=src: src.read(chunk), b""):
                    dst.write(b)
            if size is not None and part.stat().st_size != size:
                raise ValueError(f"{part.stat().st_size} bytes instead of {size}")
            if not valid_archive(str(part), sha256):
                raise ValueError("invalid archive")
            part.replace(out)
            return target
        except Exception as e:  # noqa: BLE001
            last = e
            part.unlink(missing_ok=True)
    raise RuntimeError(f"download failed after {retries} tries: {last}")
