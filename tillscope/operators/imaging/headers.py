"""Image header facts from raw file bytes: format, size, depth, alpha, density, orientation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "format string, mode string, width int, height int, dpi double, has_alpha boolean, bit_depth int, orientation int, aspect double, error string"


def read_header(data: bytes) -> dict:
    out: dict = dict.fromkeys(f.split(" ")[0] for f in FIELDS.split(", "))
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, kind = struct.unpack(">IIBB", data[16:26])
            mode = {0: "I;16" if depth == 16 else "1" if depth == 1 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[kind]
            out |= {"format": "PNG", "mode": mode, "width": w, "height": h, "has_alpha": kind in (4, 6) or "tRNS" in _chunks(data)}
            at = data.find(b"pHYs")
            if at > 0:
                x, _, unit = struct.unpack(">IIB", data[at + 4 : at + 13])
                out["dpi"] = round(x * 0.0254, 2) if unit == 1 else None
        elif data[:2] == b"\xff\xd8":
            out |= {"format": "JPEG", "has_alpha": False}
            i = 2
            while i + 9 < len(data):
                if data[i] != 0xFF:
                    raise ValueError("broken marker")
                marker, size = data[i + 1], struct.unpack(">H", data[i + 2 : i + 4])[0]
                body = data[i + 4 : i + 2 + size]
                if marker == 0xE0 and body[:4] == b"JFIF" and body[7] in (1, 2):
                    out["dpi"] = struct.unpack(">H", body[8:10])[0] * (1.0 if body[7] == 1 else 2.54)
                if marker == 0xE1 and body[:4] == b"Exif":
                    out["orientation"] = _orientation(body[6:])
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w, n = struct.unpack(">HHB", body[1:6])
                    out |= {"width": w, "height": h, "mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(n)}
                    break
                i += 2 + size
        else:
            out["error"] = "unknown format"
        out["bit_depth"] = {"1": 8, "L": 8, "P": 8, "LA": 16, "RGB": 24, "RGBA": 32, "CMYK": 32, "I;16": 16}.get(out["mode"])
        if out["width"] and out["height"]:
            out["aspect"] = out["width"] / out["height"]
    except Exception as e:  # noqa: BLE001
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def _chunks(png: bytes) -> list[str]:
    """The kinds of the chunks before the pixels."""
    out, at = [], 8
    while at + 8 <= len(png) and png[at + 4 : at + 8] != b"IDAT":
        out.append(png[at + 4 : at + 8].decode("latin-1"))
        at += 12 + struct.unpack(">I", png[at : at + 4])[0]
    return out


def _orientation(tiff: bytes) -> int | None:
    end = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(end + "I", tiff[4:8])[0]
    for k in range(struct.unpack(end + "H", tiff[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(end + "HHIH", tiff[at + 2 + 12 * k : at + 12 + 12 * k])
        if tag == 274:
            return value
    return None


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``header`` from the bytes of the binaryFile source."""

    @F.pandas_udf("struct<" + ", ".join(f.replace(" ", ":", 1) for f in FIELDS.split(", ")) + ">")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in FIELDS.split(", ")]
        for s in batches:
            yield pd.DataFrame([read_header(bytes(b)) if b is not None else dict.fromkeys(names) | {"error": "no content"} for b in s], columns=names)

    return files.withColumn("header", run(F.col(content)))


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of an (H, W) or (H, W, 3) image: floats are taken as 0..1, clamped and rounded."""
    a = np.rint(np.clip(pixels, 0, 1) * 255).astype(np.uint8) if pixels.dtype.kind == "f" else pixels.astype(np.uint8)
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
