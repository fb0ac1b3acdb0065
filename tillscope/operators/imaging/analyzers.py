"""Analyzers on image columns: one Arrow pass gives all features, and each part fails by itself.

Input is the struct of Spark's image source (height, width, nChannels, data). An undecodable image gives nulls and an
entry in ``errors``. Columns that a mode does not need are dropped from the plan by selecting that mode's structs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.forensics import translation_clusters
from tillscope.operators.imaging import kernels as K
from tillscope.operators.imaging.headers import headers

GLOBAL = "brightness_mean double, brightness_std double, sharpness double, blur_mean double, blur_std double, blur_min double, blur_max double, entropy double, edge_density double, text_ink double, skew_angle double, skew_confidence double"
FORENSIC = "suspicious_ratio double, mela_peak double, used_qualities array<int>, rois array<struct<x:int,y:int,w:int,h:int,score:double>>, max_tile_z double, mean_abs_resid double, std_tile double"

COPY_MOVE = "pairs_found int, reason string, good_matches int, pairs array<struct<bin_x:int,bin_y:int,n:int,src:array<int>,dst:array<int>>>"


def _copy_move(rgb: np.ndarray, least: int = 18, top: int = 2, bin_size: float = 14, pad: int = 12) -> dict:
    """Pairs of regions of equal translation (boxes are x, y, width, height), or the reason why there is none."""
    points, desc = K.keypoints(K.gray(rgb))
    if len(points) < 80:
        return {"pairs_found": 0, "reason": "few_features", "pairs": []}
    m = K.self_matches(points, desc)
    if len(m) < 40:
        return {"pairs_found": 0, "reason": "few_good_matches", "good_matches": len(m), "pairs": []}
    bins, at, n = np.unique(np.floor((m[:, 2:] - m[:, :2]) / bin_size).astype(int), axis=0, return_inverse=True, return_counts=True)
    at = at.reshape(-1)
    size = np.array([rgb.shape[1], rgb.shape[0]])

    def box(p: np.ndarray) -> list[int]:
        lo, hi = np.maximum(p.min(axis=0) - pad, 0), np.minimum(p.max(axis=0) + pad, size - 1)
        return [*lo.tolist(), *np.maximum(hi - lo, 1).tolist()]

    order = sorted((k for k in range(len(n)) if n[k] >= least), key=lambda k: (-n[k], *bins[k]))[:top]
    pairs = [{"bin_x": int(bins[k][0]), "bin_y": int(bins[k][1]), "n": int(n[k]), "src": box(m[at == k][:, :2]), "dst": box(m[at == k][:, 2:])} for k in order]
    return {"pairs_found": len(pairs), "reason": None if pairs else "no_cluster", "good_matches": len(m), "pairs": pairs}


def _parts(rgb: np.ndarray, which: str) -> tuple[dict, dict]:
    g = K.gray(rgb)
    steps = {
        "GLOBAL": {
            "quality": lambda: K.brightness(g),
            "blur": lambda: K.blur_tiles(g),
            "entropy": lambda: {"entropy": K.entropy(g)},
            "edges": lambda: {"edge_density": float(K.edges(g, 80, 160).mean())},
            "text": lambda: {"text_ink": K.text_ink(g)},
            "skew": lambda: K.skew(g),
        },
        "FORENSIC": {"mela": lambda: K.mela(rgb), "noise": lambda: K.noise_summary(g)},
        "COPY_MOVE": {"copy_move": lambda: _copy_move(rgb)},
    }[which]
    out, errors = {}, {}
    for name, step in steps.items():
        try:
            out |= step()
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {e}"
    return out, errors


def _analyzer(which: str, fields: str):
    names = [a for a, _ in _split(fields)]

    @F.pandas_udf(f"struct<{', '.join(f'{a}:{b}' for a, b in _split(fields))}, errors:map<string,string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hs, ws, cs, ds in batches:
            rows = []
            for h, w, c, d in zip(hs, ws, cs, ds, strict=True):
                try:
                    out, errors = _parts(K.decode(int(h), int(w), int(c), d), which)
                except Exception as e:  # noqa: BLE001
                    out, errors = {}, {"image": f"{type(e).__name__}: {e}"}
                rows.append({n: out.get(n) for n in names} | {"errors": errors})
            yield pd.DataFrame(rows, columns=[*names, "errors"])

    return run


def _split(fields: str) -> list[tuple[str, str]]:
    out, depth, part = [], 0, ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            a, b = part.strip().split(" ", 1)
            out.append((a, b))
            part = ""
        else:
            part += ch
    return out


def features(images: DataFrame, mode: str = "FULL", image: str = "image", content: str = "content") -> DataFrame:
    """Adds ``header``, ``global_``, ``forensic`` and ``copy_move`` (GRAPHIC and FULL) structs; READING needs no image.

    The header is read from the file's bytes in ``content``; without that column it says so in its error.
    """
    args = [F.col(f"{image}.{c}") for c in ("height", "width", "nChannels", "data")]
    out = images
    if mode in ("GRAPHIC", "FULL"):
        out = out.withColumn("global_", _analyzer("GLOBAL", GLOBAL)(*args)).withColumn("forensic", _analyzer("FORENSIC", FORENSIC)(*args))
        out = out.withColumn("copy_move", _analyzer("COPY_MOVE", COPY_MOVE)(*args))
        out = headers(out, content) if content in images.columns else headers(out.withColumn("_none", F.lit(None).cast("binary")), "_none").drop("_none")
    return out


def dimensions(df: DataFrame, height: str = "height", width: str = "width", length: str = "length") -> DataFrame:
    """Adds aspect (height by width), megapixels and kilobytes of image files; null where the width is 0."""
    h, w = F.col(height), F.col(width)
    return df.withColumns({"aspect": F.round(h / F.nullif(w, F.lit(0)), 2), "megapixels": F.round(h * w / 1e6, 3), "kilobytes": F.round(F.col(length) / 1024, 1)})


def copy_move(images: DataFrame, id_col: str = "origin", image: str = "image", least: int = 18) -> DataFrame:
    """(id_col, bin_x, bin_y, n, boxes, rank): the largest clusters of equal translation within each image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    m = K.self_matches(*K.keypoints(K.gray(K.decode(r.height, r.width, r.nChannels, r.data))))
                except Exception:  # noqa: BLE001
                    continue
                if len(m) >= 40:
                    yield pd.DataFrame({"id": [r.id] * len(m), "x": m[:, 0], "y": m[:, 1], "tx": m[:, 2], "ty": m[:, 3]})

    kind = images.schema[id_col].dataType.simpleString() if id_col in images.columns else "string"
    src = images.select(F.col(id_col).alias("id"), *[F.col(f"{image}.{c}") for c in ("height", "width", "nChannels", "data")])
    m = src.mapInPandas(run, f"id {kind}, x int, y int, tx int, ty int")
    return translation_clusters(m, "id", least=least).withColumnRenamed("id", id_col)


def evidence(df: DataFrame, mode: str) -> Column:
    """The evidence document of a mode as a struct: only that mode's parts are computed."""
    graphic = ["header", "global_", "forensic", "copy_move"]
    parts = {"GRAPHIC": graphic, "READING": ["semantic_checks", "checks", "arithmetic_consistent"], "FULL": [*graphic, "semantic_checks", "checks", "arithmetic_consistent"]}[mode]
    return F.struct(F.lit(mode).alias("mode"), *[F.col(c) for c in parts if c in df.columns])
