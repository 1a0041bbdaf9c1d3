"""Rectangles masked in 8-bit RGB or RGBA PNG images, with a check that all pixels outside are unchanged. numpy and zlib only."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from veilgrid.operators.clean import Unreadable, _png, png_chunks

MAX_PIXELS = 64_000_000
MODES = "decor delete label mosaic noise replace".split()


def parse_region(spec: str) -> tuple[int, int, int, int, str, str]:
    """x,y,w,h:mode[:arg]"""
    box, mode, *arg = spec.split(":", 2)
    x, y, w, h = map(int, box.split(","))
    if mode not in MODES or min(x, y) < 0 or min(w, h) <= 0:
        raise ValueError(f"not a region: {spec}")
    return x, y, w, h, mode, arg[0] if arg else ""


def decode_png(data: bytes) -> np.ndarray:
    chunks = png_chunks(data)
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", chunks[0][1])
    if depth != 8 or kind not in (2, 6) or lace or w * h > MAX_PIXELS:
        raise Unreadable("not 8-bit RGB or RGBA, interlaced, or too large")
    n = 3 if kind == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    zero = np.zeros(w * n, np.uint8)
    for y in range(h):
        f, line, up = raw[y, 0], raw[y, 1:].copy(), out[y - 1] if y else zero
        if f == 1:
            line = np.add.accumulate(line.reshape(w, n), 0, dtype=np.uint8).ravel()
        elif f == 2:
            line = line + up
        elif f in (3, 4):
            p, u, v = line.tolist(), up.tolist(), None
            for i in range(w * n):
                a = p[i - n] if i >= n else 0
                if f == 3:
                    v = (a + u[i]) >> 1
                else:
                    c = u[i - n] if i >= n else 0
                    d = a + u[i] - c
                    v = min((abs(d - a), 0, a), (abs(d - u[i]), 1, u[i]), (abs(d - c), 2, c))[2]
                p[i] = p[i] + v & 255
            line = np.array(p, np.uint8)
        out[y] = line
    return out.reshape(h, w, n)


def encode_png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], 1).tobytes()
    return _png([(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)), (b"IDAT", zlib.compress(raw, 9)), (b"IEND", b"")])


def mask_image(data: bytes, regions: list[str], block: int = 16) -> tuple[bytes, list[str], bool]:
    """The masked PNG, the regions applied (of overlapping ones the first), and whether all pixels outside them are as before."""
    before = decode_png(data)
    px, taken = before.copy(), []
    outside = np.ones(px.shape[:2], bool)
    for spec in regions:
        x, y, w, h, mode, arg = parse_region(spec)
        if x + w > px.shape[1] or y + h > px.shape[0]:
            raise ValueError(f"outside the image: {spec}")
        if any(x < a + c and a < x + w and y < b + d and b < y + h for a, b, c, d in taken):
            continue
        taken.append((x, y, w, h))
        r = px[y : y + h, x : x + w]
        colour = np.frombuffer(bytes.fromhex(arg.lstrip("#")), np.uint8)[:3] if arg and mode in ("replace", "label", "decor") and len(arg.lstrip("#")) == 6 else np.zeros(3, np.uint8)
        if mode == "mosaic":
            for i in range(0, h, block):
                for j in range(0, w, block):
                    part = r[i : i + block, j : j + block, :3]
                    part[:] = part.reshape(-1, 3).mean(0).astype(np.uint8)
        elif mode == "noise":
            r[..., :3] = np.random.default_rng([x, y, w, h]).integers(0, 256, (h, w, 3), dtype=np.uint8)
        elif mode == "decor":
            for edge in (r[:2], r[-2:], r[:, :2], r[:, -2:]):
                edge[..., :3] = colour
        else:
            r[..., :3] = colour
        outside[y : y + h, x : x + w] = False
    return encode_png(px), [f"{a},{b},{c},{d}" for a, b, c, d in taken], bool((px[outside] == before[outside]).all())
