"""Pixel operations on arrays of height x width x 3 bytes, and headers of encoded images. Files are raw pixels here: codecs aren't part of this library."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def noised(img: np.ndarray, sigma: float, seed: int, per_channel: bool = True) -> np.ndarray:
    shape = img.shape if per_channel else (*img.shape[:2], 1)
    field = np.random.default_rng(int(seed)).normal(0.0, float(sigma), shape).astype(np.float32)
    return np.clip((img.astype(np.float32) / 255.0 + field) * 255.0 + 0.5, 0, 255).astype(np.uint8)


def cropped(img: np.ndarray, fraction: float) -> np.ndarray:
    h, w = img.shape[:2]
    ch, cw = (max(1, round(x * fraction)) for x in (h, w))
    top, left = (h - ch) // 2, (w - cw) // 2
    return img[top : top + ch, left : left + cw]


def resized(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with half-pixel centres."""
    h, w = img.shape[:2]

    def axis(n: int, of: int):
        x = np.clip((np.arange(n) + 0.5) * of / n - 0.5, 0, of - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, of - 1), x - low

    t, b, y = axis(height, h)
    lft, r, x = axis(width, w)
    a = img.astype(np.float64)
    y, x = y[:, None, None], x[None, :, None]
    top = a[t][:, lft] * (1 - x) + a[t][:, r] * x
    low = a[b][:, lft] * (1 - x) + a[b][:, r] * x
    return np.clip(np.rint(top * (1 - y) + low * y), 0, 255).astype(np.uint8)


def rescaled(img: np.ndarray, scale: float) -> np.ndarray:
    """Down by scale and up again."""
    h, w = img.shape[:2]
    return resized(resized(img, max(1, round(w * scale)), max(1, round(h * scale))), w, h)


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian of that standard deviation, cut at four of them, edges repeated."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    a = img.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
        a = np.apply_along_axis(np.convolve, axis, padded, k, "valid")
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def luma(img: np.ndarray) -> np.ndarray:
    return img[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def jittered(img: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """Blends with black, with the mean grey, and with the grey image, in this order."""
    step = lambda a, towards, f: np.clip(np.rint(towards + (a - towards) * f), 0, 255)
    a = step(img.astype(np.float64), 0.0, brightness)
    a = step(a, np.floor(np.rint(luma(a)).mean() + 0.5), contrast)
    return step(a, np.rint(luma(a))[..., None], saturation).astype(np.uint8)


# The standard quantisation tables, for quality 50, of brightness and of colour.
QUANTISERS = (
    (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99),
    (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32),
)


def quantisers(quality: float) -> list[np.ndarray]:
    """The tables of a quality from 1 to 100."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255).reshape(8, 8) for t in QUANTISERS]


def compressed(img: np.ndarray, quality: float) -> np.ndarray:
    """What a JPEG round trip leaves of an image: colour at half the resolution, and rounded coefficients of blocks of 8 x 8. Coding them loses nothing and is left out."""
    h, w = img.shape[:2]
    whole = np.pad(img, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.float64)
    red, green, blue = np.moveaxis(whole, -1, 0)
    grey = luma(whole)
    half = lambda c: c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean((1, 3))
    planes = [grey - 128, half((blue - grey) / 1.772), half((red - grey) / 1.402)]
    k = np.arange(8)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 16) / 2
    basis[0] /= np.sqrt(2)

    def rounded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
        blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2)
        kept = np.rint(basis @ blocks @ basis.T / table) * table
        return (basis.T @ kept @ basis).swapaxes(1, 2).reshape(plane.shape)

    bright, colour = quantisers(quality)
    y, cb, cr = (rounded(p, t) for p, t in zip(planes, (bright, colour, colour), strict=True))
    cb, cr = (c.repeat(2, 0).repeat(2, 1) for c in (cb, cr))
    y = y + 128
    r, b = y + 1.402 * cr, y + 1.772 * cb
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.rint(np.stack([r, g, b], -1)), 0, 255).astype(np.uint8)[:h, :w]


def applied(img: np.ndarray, steps: list[tuple[str, dict]], resize_back: bool = False) -> np.ndarray:
    """A plan's steps in a row; with resize_back, crops are scaled up to the size they came from."""
    for name, p in steps:
        q = {k: float(v) for k, v in p.items() if k != "seed"}
        if name == "noise":
            img = noised(img, q["sigma"], int(p["seed"]))
        elif name == "blur":
            img = blurred(img, q["sigma"])
        elif name == "resize":
            img = rescaled(img, q["scale"])
        elif name == "jitter":
            img = jittered(img, q["brightness"], q["contrast"], q["saturation"])
        elif name == "crop":
            h, w = img.shape[:2]
            img = cropped(img, q["fraction"])
            img = resized(img, w, h) if resize_back else img
        elif name == "jpeg":
            img = compressed(img, q["quality"])
        else:
            raise ValueError(f"{name} can't be applied here")
    return img


# jobs -------------------------------------------------------------------------------------------------------------------
_MADE = "file string, width int, height int, content binary, error string"
_MADE_ARROW = pa.schema([("file", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string())])


def pixels_of(content: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(content, np.uint8).reshape(height, width, 3)


def _made(todo) -> DataFrame:
    """Rows (content, width, height, outputs) mapped to files; outputs of a row are made by todo(img, output) one by one, and a failure is a row."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # one image at a time: its outputs are as large as it is
                rows = []
                for output in row["outputs"]:
                    try:
                        img = todo(pixels_of(row["content"], row["width"], row["height"]), output)
                        rows.append({"file": output["file"], "width": img.shape[1], "height": img.shape[0], "content": np.ascontiguousarray(img).tobytes(), "error": None})
                    except Exception as e:
                        rows.append({"file": output["file"], "width": None, "height": None, "content": None, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(rows, schema=_MADE_ARROW)

    return run


def _by_image(images: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """images with all their outputs as one array: an image travels once, whatever is made of it."""
    gathered = outputs.groupBy(key).agg(F.collect_list(F.struct(*[c for c in outputs.columns if c != key])).alias("outputs"))
    return images.select(key, "content", "width", "height").join(gathered, key).select("content", "width", "height", "outputs")


def _steps(output: dict) -> list[tuple[str, dict]]:
    return [(s["name"], dict(s["params"])) for s in output["steps"]]


def augmented(images: DataFrame, plans: DataFrame, existing: DataFrame | None = None, ext: str = ".png", resize_back: bool = False) -> DataFrame:
    """file, width, height, content, error of every plan (stem, idx, steps) applied to images (stem, width, height, content: raw pixels).

    Files are named <stem>_a<idx>; those that existing (file) has are left out, so that a broken run goes on where it ended.
    """
    named = plans.withColumn("file", F.format_string(f"%s_a%d{ext}", "stem", "idx")).select("stem", "file", "steps")
    named = named if existing is None else named.join(existing.select("file"), "file", "left_anti")
    return _by_image(images, named, "stem").mapInArrow(_made(lambda img, output: applied(img, _steps(output), resize_back)), _MADE)


def converted(images: DataFrame, jobs: DataFrame, ext: str = ".png") -> DataFrame:
    """file, width, height, content, error of crop jobs (src, box, rotation, size) applied to images (src, width, height, content): cut, turned, resized."""

    def convert(img: np.ndarray, job: dict) -> np.ndarray:
        box = job["box"]
        part = img[box["t"] : box["b"], box["l"] : box["r"]]
        return resized(np.rot90(part, (job["rotation"] or 0) // 90), job["size"]["w"], job["size"]["h"])

    named = jobs.select("src", F.concat("src", F.lit(ext)).alias("file"), "box", "rotation", "size")
    return _by_image(images, named, "src").mapInArrow(_made(convert), _MADE)


def compared(image: DataFrame, steps: DataFrame) -> DataFrame:
    """file, width, height, content, error of images under every round (planning.round_steps): one file <stem>_r<round> each."""
    named = steps.select("stem", F.format_string("%s_r%02d", "stem", "round").alias("file"), "steps")
    return _by_image(image, named, "stem").mapInArrow(_made(lambda img, output: applied(img, _steps(output))), _MADE)


def denormalised(x: np.ndarray) -> np.ndarray:
    """Bytes of values in -1..1."""
    return np.clip(np.rint((np.asarray(x, np.float64) + 1) * 127.5), 0, 255).astype(np.uint8)


def unpatched(rows: np.ndarray, high: int, wide: int, patch: int = 16, channels: int = 3) -> np.ndarray:
    """The image of high x wide patches, each a row of patch x patch x channels numbers; further rows are padding."""
    grid = np.asarray(rows)[: high * wide].reshape(high, wide, patch, patch, channels)
    return grid.swapaxes(1, 2).reshape(high * patch, wide * patch, channels)


# headers ----------------------------------------------------------------------------------------------------------------
def header(data: bytes | None) -> tuple[int | None, int | None, str | None, str | None, str | None]:
    """(width, height, format, mode, error) from the first bytes of a file; an error leaves the others empty."""
    try:
        if not data:
            raise ValueError("no bytes")
        for kind in (_png, _jpeg, _gif, _bmp, _webp):
            if found := kind(bytes(data)):
                return (*found, None)
        raise ValueError("unknown format")
    except Exception as e:  # whatever is wrong with a file becomes its row
        return None, None, None, None, f"{type(e).__name__}: {e}"


def _png(d: bytes):
    if d[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    w, h, depth, colour = struct.unpack(">IIBB", d[16:26])
    return w, h, "PNG", {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]


def _jpeg(d: bytes):
    if d[:3] != b"\xff\xd8\xff":
        return None
    at = 2
    while True:
        while d[at] == 0xFF and d[at + 1] == 0xFF:
            at += 1
        mark, size = d[at + 1], struct.unpack(">H", d[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, parts = struct.unpack(">HHB", d[at + 5 : at + 10])
            return w, h, "JPEG", {1: "L", 3: "RGB", 4: "CMYK"}[parts]
        at += 2 + size


def _gif(d: bytes):
    return (*struct.unpack("<HH", d[6:10]), "GIF", "P") if d[:6] in (b"GIF87a", b"GIF89a") else None


def _bmp(d: bytes):
    if d[:2] != b"BM":
        return None
    w, h, _, bits = struct.unpack("<iiHH", d[18:30])
    return w, abs(h), "BMP", {1: "1", 4: "P", 8: "P", 24: "RGB", 32: "RGBA"}[bits]


def _webp(d: bytes):
    if d[:4] != b"RIFF" or d[8:12] != b"WEBP":
        return None
    kind = d[12:16]
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", d[26:30])
        return w & 0x3FFF, h & 0x3FFF, "WEBP", "RGB"
    if kind == b"VP8L":
        bits = struct.unpack("<I", d[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WEBP", "RGBA" if bits >> 28 & 1 else "RGB"
    w, h = (int.from_bytes(d[a : a + 3], "little") + 1 for a in (24, 27))
    return w, h, "WEBP", "RGBA" if d[20] & 0x10 else "RGB"


def headers(files: DataFrame, prefix: int = 1 << 16) -> DataFrame:
    """files (path, content, ...) with width, height, format, mode and error.

    Python sees the first bytes alone, and the whole content of files that run out of bytes there.
    """
    from pyspark.sql import functions as F

    keep = [c for c in files.columns if c != "content"]
    names, types = ("width", "height", "format", "mode", "error"), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
    kind = pa.struct(list(zip(names, types, strict=True)))

    def rows(found):
        return pa.array([f and dict(zip(names, f, strict=True)) for f in found], kind)

    schema = "width int, height int, format string, mode string, error string"
    first = F.arrow_udf(lambda heads: rows([header(x) for x in heads.to_pylist()]), schema)
    again = F.arrow_udf(lambda contents: rows([None if x is None else header(x) for x in contents.to_pylist()]), schema)
    read = files.withColumn("__found", first(F.substring("content", 1, prefix)))
    short = F.regexp_like("__found.error", F.lit("^(IndexError|error):")) & (F.length("content") > prefix)
    read = read.withColumn("__found", F.coalesce(again(F.when(short, F.col("content"))), "__found"))
    return read.select(*keep, "__found.*")
