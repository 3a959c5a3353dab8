"""Images as structs of Spark's image source: operations, augmentation, unrolling, superpixels, decoding.

An image is (origin, height, width, nChannels, mode, data): rows of pixels from the top, channels of a pixel
in the order blue, green, red, alpha. Every function takes a null image to null.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
PIXELS = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
#: OpenCV's type numbers of 8-bit images by channels: fixed values.
MODES = {1: 0, 3: 16, 4: 24}
_GAP = rb"(?:\s|#[^\n]*\n)+"
HEAD = re.compile(rb"(P[56])" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)\s")


def to_array(image: dict) -> np.ndarray:
    """height x width x channels of bytes."""
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def to_image(pixels: np.ndarray, origin: str | None = None) -> dict:
    h, w, c = pixels.shape
    return {"origin": origin, "height": h, "width": w, "nChannels": c, "mode": MODES[c], "data": np.ascontiguousarray(pixels, np.uint8).tobytes()}


# Operations on arrays -----------------------------------------------------------------------------

def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres at halves."""
    h, w = x.shape[:2]
    rows = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    cols = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    r0, c0 = np.floor(rows).astype(int), np.floor(cols).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (rows - r0)[:, None, None], (cols - c0)[None, :, None]
    f = x.astype(np.float64)
    top = f[r0][:, c0] * (1 - fc) + f[r0][:, c1] * fc
    low = f[r1][:, c0] * (1 - fc) + f[r1][:, c1] * fc
    return np.rint(top * (1 - fr) + low * fr).astype(np.uint8)


def crop(x: np.ndarray, left: int, top: int, height: int, width: int) -> np.ndarray:
    if left < 0 or top < 0 or top + height > x.shape[0] or left + width > x.shape[1]:
        raise ValueError("the crop reaches over the image")
    return x[top : top + height, left : left + width]


def color_format(x: np.ndarray, to: str) -> np.ndarray:
    """``gray``, ``bgr`` or ``rgb`` (channels turned round)."""
    if to == "gray":
        if x.shape[2] == 1:
            return x
        return np.rint(x[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299]))[:, :, None].astype(np.uint8)
    if to == "bgr":
        return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, :3]
    if to == "rgb":
        return color_format(x, "bgr")[:, :, ::-1]
    raise ValueError(f"unknown color format {to}")


def flip(x: np.ndarray, code: int = 1) -> np.ndarray:
    """0 upside down, positive left to right, negative both."""
    x = x[::-1] if code <= 0 else x
    return x[:, ::-1] if code != 0 else x


def _filtered(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A separable filter; the image is mirrored at its border, the border pixel not repeated."""
    f = x.astype(np.float64)
    for axis, k in ((0, rows), (1, cols)):
        before, after = (len(k) - 1) // 2, len(k) // 2
        n = f.shape[axis]
        at = np.abs(np.arange(-before, n + after))
        at = np.where(at >= n, 2 * (n - 1) - at, at).clip(0, n - 1)
        wide = np.take(f, at, axis=axis)
        f = sum(weight * np.take(wide, np.arange(i, i + n), axis=axis) for i, weight in enumerate(k))
    return np.clip(np.rint(f), 0, 255).astype(np.uint8)


def blur(x: np.ndarray, height: float, width: float) -> np.ndarray:
    """The mean of a box."""
    return _filtered(x, np.full(int(height), 1 / int(height)), np.full(int(width), 1 / int(width)))


def gaussian(x: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """A Gaussian of ``size`` pixels; a sigma of 0 or less follows from the size."""
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return _filtered(x, k / k.sum(), k / k.sum())


def threshold(x: np.ndarray, limit: float, most: float, kind: str = "binary") -> np.ndarray:
    """``binary``, ``binary_inv``, ``trunc``, ``tozero`` or ``tozero_inv``."""
    over = x > limit
    if kind in ("binary", "binary_inv"):
        return np.where(over == (kind == "binary"), most, 0).astype(np.uint8)
    if kind == "trunc":
        return np.where(over, limit, x).astype(np.uint8)
    if kind in ("tozero", "tozero_inv"):
        return np.where(over == (kind == "tozero"), x, 0).astype(np.uint8)
    raise ValueError(f"unknown threshold {kind}")


def channels(x: np.ndarray, n: int) -> np.ndarray:
    """The image with 1, 3 or 4 channels."""
    if x.shape[2] == n:
        return x
    if n == 1:
        return color_format(x, "gray")
    three = color_format(x, "bgr")
    return three if n == 3 else np.concatenate([three, np.full((*x.shape[:2], 1), 255, np.uint8)], axis=2)


STEPS = {"resize": resize, "crop": crop, "color_format": color_format, "flip": flip, "blur": blur, "gaussian": gaussian, "threshold": threshold, "channels": channels}


# Columns ------------------------------------------------------------------------------------------

def _mapped(image: Column, fn, *more: Column) -> Column:
    """``fn(pixels, *more)`` of every image that is not null, row by row within Arrow batches."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for row, *others in zip(*[c.to_pylist() for c in columns]):
            out.append(None if row is None else to_image(fn(to_array(row), *others), row["origin"]))
        return pa.array(out, PIXELS)

    return F.arrow_udf(run, IMAGE)(image, *more)


def transform_images(df: DataFrame, steps: list[dict], input_col: str = "image", output_col: str | None = None) -> DataFrame:
    """Named steps with their arguments, one after another: ``[{"step": "resize", "height": 8, "width": 8}]``.

    A binary column is decoded first, see ``decode``; what cannot be decoded becomes null.
    """
    plan = [(STEPS[s["step"]], {k: v for k, v in s.items() if k != "step"}) for s in steps]

    def run(x: np.ndarray) -> np.ndarray:
        for fn, arguments in plan:
            x = fn(x, **arguments)
        return x

    image = F.col(f"`{input_col}`")
    if df.schema[input_col].dataType.typeName() == "binary":
        image = decode(image)
    return df.withColumn(output_col or input_col, _mapped(image, run))


def augment_images(df: DataFrame, input_col: str = "image", output_col: str = "image", left_right: bool = True, up_down: bool = False) -> DataFrame:
    """The rows, and again with the image turned left to right and upside down."""
    out = df.withColumn(output_col, F.col(f"`{input_col}`"))
    for wanted, code in ((left_right, 1), (up_down, 0)):
        if wanted:
            out = out.unionByName(transform_images(df, [{"step": "flip", "code": code}], input_col, output_col))
    return out


def unroll_images(df: DataFrame, input_col: str = "image", output_col: str = "features") -> DataFrame:
    """A vector of all values from 0 to 255: channel by channel, from the top, from the left."""

    def run(images: pa.Array) -> pa.Array:
        return pa.array([None if i is None else to_array(i).transpose(2, 0, 1).astype(float).ravel() for i in images.to_pylist()], pa.list_(pa.float64()))

    values = F.arrow_udf(run, "array<double>")(F.col(f"`{input_col}`"))
    return df.withColumn(output_col, values).withColumn(output_col, F.when(F.col(output_col).isNotNull(), array_to_vector(F.col(output_col))))


def unroll_binary_images(df: DataFrame, input_col: str, output_col: str = "features", height: int | None = None, width: int | None = None, n_channels: int | None = None) -> DataFrame:
    """Files' bytes decoded, brought to one size, and unrolled; null where they are no image."""
    steps = [{"step": "resize", "height": height, "width": width}] if height else []
    steps += [{"step": "channels", "n": n_channels}] if n_channels else []
    out = unroll_images(transform_images(df, steps, input_col, output_col), output_col, output_col)
    return out


# Superpixels --------------------------------------------------------------------------------------

def segments(x: np.ndarray, cell: float = 16.0, modifier: float = 130.0, rounds: int = 10) -> np.ndarray:
    """Cluster number of each pixel, from 0, by colour and place around centres on a grid of ``cell`` pixels.

    Distances add colour, and place in cells times ``modifier``; a pixel looks at the centres of its own
    and the neighbouring cells, so work and memory are linear in the pixels.
    """
    h, w, c = x.shape
    ny, nx = max(1, round(h / cell)), max(1, round(w / cell))
    f = x.astype(np.float64).reshape(-1, c)
    yy, xx = [a.ravel() for a in np.mgrid[0:h, 0:w].astype(float)]
    gy, gx = np.minimum((yy * ny / h).astype(int), ny - 1), np.minimum((xx * nx / w).astype(int), nx - 1)
    label = gy * nx + gx
    for _ in range(rounds):
        n = np.maximum(np.bincount(label, minlength=ny * nx), 1)
        cy, cx = np.bincount(label, yy, ny * nx) / n, np.bincount(label, xx, ny * nx) / n
        color = np.stack([np.bincount(label, f[:, k], ny * nx) / n for k in range(c)], axis=1)
        gone = np.bincount(label, minlength=ny * nx) == 0
        best, found = np.full(h * w, np.inf), label.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ty, tx = gy + dy, gx + dx
                ok = (ty >= 0) & (ty < ny) & (tx >= 0) & (tx < nx)
                t = np.where(ok, ty * nx + tx, 0)
                d = ((f - color[t]) ** 2).sum(axis=1) + (modifier / cell) ** 2 * ((yy - cy[t]) ** 2 + (xx - cx[t]) ** 2)
                d = np.where(ok & ~gone[t], d, np.inf)
                found, best = np.where(d < best, t, found), np.minimum(d, best)
        if (found == label).all():
            break
        label = found
    return np.unique(label, return_inverse=True)[1].reshape(h, w)


def superpixels(df: DataFrame, input_col: str = "image", output_col: str = "superpixels", cell: float = 16.0, modifier: float = 130.0) -> DataFrame:
    """The cluster of each pixel, from the top, from the left."""

    def run(images: pa.Array) -> pa.Array:
        return pa.array([None if i is None else segments(to_array(i), cell, modifier).ravel().astype(np.int32) for i in images.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(output_col, F.arrow_udf(run, "array<int>")(F.col(f"`{input_col}`")))


def masked(image: Column, labels: Column, state: Column) -> Column:
    """The image with the superpixels whose state is 0 in black."""

    def run(x: np.ndarray, label: list[int], on: list[float]) -> np.ndarray:
        keep = np.array(on)[np.array(label)].reshape(x.shape[:2]) > 0
        return x * keep[:, :, None]

    return _mapped(image, run, labels, state)


# Decoding -----------------------------------------------------------------------------------------

def decode_png(data: bytes) -> np.ndarray:
    """PNG of 8 bits a channel, not interlaced: gray, RGB or palette, each with or without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette = 8, b"", None
    width = height = depth = color = interlace = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if depth != 8 or interlace:
        raise ValueError("only 8 bits a channel, not interlaced")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height + 1, (width + 1) * n), np.int32)  # a pixel of zeros at the left, a row of zeros above
    for y in range(height):
        kind, line, up, out = raw[y, 0], raw[y, 1:].astype(np.int32), rows[y], rows[y + 1]
        if kind in (0, 2):
            out[n:] = (line + (up[n:] if kind == 2 else 0)) & 255
            continue
        for i in range(width * n):
            a, b, c = int(out[i]), int(up[i + n]), int(up[i])
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[i + n] = (line[i] + guess) & 255
    x = rows[1:, n:].reshape(height, width, n).astype(np.uint8)
    if color == 3:
        return palette[x[:, :, 0]][:, :, ::-1]
    if color == 4:
        return np.concatenate([np.repeat(x[:, :, :1], 3, axis=2), x[:, :, 1:]], axis=2)
    return x if n == 1 else x[:, :, [2, 1, 0, 3][:n]]


def encode_png(x: np.ndarray) -> bytes:
    """PNG of an image of 1, 3 or 4 channels."""
    h, w, n = x.shape
    rgb = x if n == 1 else x[:, :, [2, 1, 0, 3][:n]]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * n)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    """BMP of 24 or 32 bits a pixel, not compressed."""
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    first, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("only 24 or 32 bits a pixel")
    n = bits // 8
    stride = (width * n + 3) // 4 * 4
    x = np.frombuffer(data, np.uint8, stride * abs(height), first).reshape(abs(height), stride)[:, : width * n].reshape(abs(height), width, n)
    return x[::-1] if height > 0 else x


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary PGM or PPM of 8 bits."""
    head = HEAD.match(data)
    if not head:
        raise ValueError("no PGM or PPM")
    width, height, most = map(int, head.groups()[1:])
    n = {b"P5": 1, b"P6": 3}[head.group(1)]
    if most > 255:
        raise ValueError("only 8 bits")
    return np.frombuffer(data, np.uint8, width * height * n, head.end()).reshape(height, width, n)[:, :, ::-1]


def decode_bytes(data: bytes | None) -> np.ndarray | None:
    """The pixels of a PNG, BMP, PGM or PPM file; None for anything else."""
    for read in (decode_png, decode_bmp, decode_netpbm):
        try:
            return read(data) if data else None
        except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError):
            continue
    return None


def decode(content: Column, origin: Column | None = None) -> Column:
    """Files' bytes as images; null where they are none. JPEG files are read by Spark's ``image`` source."""

    def run(column: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for data, name in zip(column.to_pylist(), names.to_pylist()):
            x = decode_bytes(data)
            out.append(None if x is None else to_image(x, name))
        return pa.array(out, PIXELS)

    return F.arrow_udf(run, IMAGE)(content, F.lit(None).cast("string") if origin is None else origin)
