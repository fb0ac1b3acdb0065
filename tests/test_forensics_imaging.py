import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.operators import forensics as N
from tillscope.operators.graph import components
from tillscope.operators.imaging import kernels as K
from tillscope.operators.imaging.analyzers import copy_move, features
from tillscope.operators.imaging.headers import headers, png_bytes, read_header


@pytest.fixture(scope="module")
def receipt():
    a = np.full((128, 128, 3), 245, np.uint8)
    a[30:34, 20:108] = 0
    a[60:64, 20:108] = 0
    return a


def test_kernels(receipt):
    g = K.gray(receipt)
    assert g[0, 0] == 245 and 0 < K.entropy(g) < 1 and K.entropy(np.zeros((8, 8))) == 0
    assert 0 < K.edges(g, 80, 160).mean() < 0.2 and K.edges(np.full((32, 32), 9.0), 80, 160).sum() == 0
    assert abs(K.jpeg_roundtrip(g, 95) - g).mean() < abs(K.jpeg_roundtrip(g, 30) - g).mean()
    assert K.components(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)).max() > 0 and len(np.unique(K.components(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)))) == 3
    with pytest.raises(ValueError):
        K.tiles(np.zeros((10, 10)), 64)
    assert np.allclose(K.box_mean(np.ones((20, 20)), 8), 1)
    flat = K.mela(np.full((64, 64, 3), 100, np.uint8))
    assert flat["suspicious_ratio"] == 1.0


def test_copied_patch_is_found(spark):
    rng = np.random.default_rng(0)
    a = K.gaussian(rng.integers(0, 255, (256, 256)).astype(float), 1.0)
    a[140:220, 150:230] = a[20:100, 30:110]
    rgb = np.repeat(np.clip(a, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    d = spark.createDataFrame([("x", (256, 256, 3, bytearray(rgb[:, :, ::-1].tobytes())))], "origin string, image struct<height:int,width:int,nChannels:int,data:binary>")
    top = copy_move(d).where("rank = 1").first()
    assert abs(abs(top.bin_x) - 120 // 14) <= 1 and top.n >= 18


def test_features_and_errors(spark, receipt):
    d = spark.createDataFrame([("ok", (128, 128, 3, bytearray(receipt.tobytes()))), ("broken", (128, 128, 3, bytearray(b"123"))), ("small", (20, 20, 3, bytearray(receipt[:20, :20].tobytes())))], "origin string, image struct<height:int,width:int,nChannels:int,data:binary>")
    r = {x.origin: x for x in features(d, "FULL").collect()}
    assert r["ok"].global_.errors == {} and r["ok"].global_.brightness_mean > 200 and r["ok"].forensic.suspicious_ratio >= 0.007
    assert "image" in r["broken"].global_.errors and "blur" in r["small"].global_.errors and r["small"].global_.entropy == 0.0
    assert "global_" not in features(d, "READING").columns


def test_evidence_holds_copied_regions_and_header(spark, receipt):
    import json

    from tillscope.plans.pipeline import ReceiptAudit

    rng = np.random.default_rng(0)
    noisy = K.gaussian(rng.integers(0, 255, (256, 256)).astype(float), 1.0)
    copied = noisy.copy()
    copied[140:220, 150:230] = copied[20:100, 30:110]
    rows = []
    for name, g in (("copied", copied), ("plain", noisy), ("flat", np.full((256, 256), 99.0))):
        rgb = np.repeat(np.clip(g, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
        rows.append((name, "TOTAL 5.00", (256, 256, 3, bytearray(rgb.tobytes())), bytearray(png_bytes(rgb))))
    rows.append(("broken", "TOTAL 5.00", (256, 256, 3, bytearray(b"12")), None))
    d = spark.createDataFrame(rows, "receipt_id string, text string, image struct<height:int,width:int,nChannels:int,data:binary>, content binary")
    audit = ReceiptAudit(spark, None)
    clusters = sorted((r.receipt_id, r["rank"], r.bin_x, r.bin_y, r.n, r.src_x, r.src_y) for r in copy_move(d, "receipt_id").collect())
    for mode in ("GRAPHIC", "FULL"):
        got = {r.receipt_id: json.loads(r.evidence) for r in audit.evidence(d, mode).collect()}
        assert got["copied"]["copy_move"]["pairs_found"] >= 1 and got["copied"]["copy_move"]["pairs"][0]["n"] >= 18
        assert clusters == sorted((k, i + 1, p["bin_x"], p["bin_y"], p["n"], *p["src"][:2]) for k, e in got.items() for i, p in enumerate(e["copy_move"].get("pairs") or []))
        assert got["flat"]["copy_move"]["reason"] == "few_features"
        assert "image" in got["broken"]["copy_move"]["errors"] and got["broken"]["header"]["error"] == "no content"
        assert (got["flat"]["header"]["format"], got["flat"]["header"]["width"]) == ("PNG", 256)
    bare = json.loads(audit.evidence(d.drop("content").where("receipt_id = 'flat'"), "GRAPHIC").first().evidence)
    assert bare["header"]["error"] == "no content" and bare["copy_move"]["reason"] == "few_features"


def test_artifacts(receipt):
    heat = np.zeros((128, 128))
    heat[10:20, 10:20] = 1
    assert K.overlay(receipt, heat)[15, 15].tolist() != receipt[15, 15].tolist() and (K.overlay(receipt, heat)[100, 5] == receipt[100, 5]).all()
    assert K.crop(receipt, 120, 120, 50, 50).shape == (8, 8, 3)
    boxed = K.draw_boxes(receipt, [(10, 10, 20, 20)])
    assert boxed[10, 15].tolist() == [255, 0, 0] and boxed[15, 15].tolist() == receipt[15, 15].tolist()
    assert K.upsample(np.array([[-1.0, 2.0]]), 4, (5, 8)).max() == 1.0 and K.upsample(np.array([[-1.0, 2.0]]), 4, (5, 8)).shape == (5, 8)


def test_png_header(spark, receipt):
    b = png_bytes(receipt)
    h = read_header(b)
    assert (h["format"], h["mode"], h["width"], h["height"], h["bit_depth"], h["aspect"]) == ("PNG", "RGB", 128, 128, 24, 1.0)
    d = spark.createDataFrame([(bytearray(b),), (bytearray(b"nothing"),), (None,)], "content binary")
    assert [x.header.error for x in headers(d).collect()] == [None, "unknown format", "no content"]


def test_alpha_behind_a_long_chunk(receipt):
    b = png_bytes(receipt)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + bytes(4)
    at = b.index(b"IDAT") - 4
    text = chunk(b"tEXt", b"tRNS" + bytes(6000))
    assert read_header(b[:at] + text + chunk(b"tRNS", bytes(6)) + b[at:])["has_alpha"]
    assert not read_header(b[:at] + text + b[at:])["has_alpha"]


def test_images_are_decoded(spark, receipt, tmp_path):
    from tillscope.sources.files import images

    red = receipt.copy()
    red[:, :, 0] = 10
    (tmp_path / "r.png").write_bytes(png_bytes(red))
    im = images(spark, str(tmp_path)).first().image
    assert (K.decode(im.height, im.width, im.nChannels, bytes(im.data)) == red).all()


def test_relational(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", float("nan")), ("b", 5.0)], "g string, v double")
    a = d.where("g = 'a'")
    assert N.median_mad(a, "g", "v").first().mad == 1.0 and N.percentiles(d, "g", "v", (0.5,)).where("g = 'b'").first().p50 == 5.0
    z = [r.z for r in N.zscores(a, "g", "v").collect()]
    assert abs(sum(z)) < 1e-6 and abs(max(z) - N.tile_summary(a, "g", "v").first().max_tile_z) < 1e-9
    assert [r.v for r in N.above_percentile(a, "g", "v").collect()] == [100.0] and N.entropy(a, "g", F.col("v") > 2).count() == 1


def test_knn_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    got = {r["query"]: r for r in N.knn_ratio(d, d.where("vec_id % 10 = 0"), block_rows=10, block_queries=2).collect()}
    for q in range(0, 60, 10):
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        assert got[q].neighbour == dist.argmin() and abs(got[q].d1 - dist.min()) < 1e-9 and abs(got[q].d2 - np.sort(dist)[1]) < 1e-9


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[200] == 200 and len(got) == 44
    assert components(e.limit(0)).count() == 0


def test_quantiles_of_any_group(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 4000)] + [(None, float(x)) for x in rng.random(7)] + [("b", 1.0), ("c", None), ("d", float("nan")), ("e", 2.0), ("e", 4.0)]
    ps = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p993": 0.993, "p100": 1.0}
    got = {r.g: [r[k] for k in ps] for r in N.quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", ps).collect()}
    values = {g: [x for h, x in rows if h == g and x is not None and x == x] for g in ("a", None, "b", "e")}
    assert set(got) == set(values)
    for g, v in values.items():
        assert np.allclose(got[g], np.percentile(v, [100 * p for p in ps.values()]))
    assert N.quantiles(spark.createDataFrame([], "g string, x double"), "g", "x", ps).count() == 0
