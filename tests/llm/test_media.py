import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media
from tessera.llm.queries import op1_media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_round_trip(data, width):
    data = data.ljust(-(-max(1, len(data)) // width) * width, b"\0")
    samples = np.frombuffer(data, np.uint8).reshape(-1, width)
    assert (media.read_png(media.write_png(samples)) == samples).all()


def _image(kinds, samples):
    """A PNG with the filter kinds given, line by line as the format says."""
    height, width = samples.shape
    lines = []
    for y in range(height):
        row = bytearray([kinds[y]])
        for x in range(width):
            a = int(samples[y, x - 1]) if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((int(samples[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        lines.append(bytes(row))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"teXt", b"ignored") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_all_five_filters():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (25, 17), dtype=np.uint8)
    assert (media.read_png(_image([y % 5 for y in range(25)], samples)) == samples).all()


def test_damage_is_found():
    good = media.write_png(np.arange(192, dtype=np.uint8).reshape(1, 192))
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 16
        with pytest.raises(media.BadImage):
            media.read_png(bytes(bad))
    for n in range(len(good)):
        with pytest.raises(media.BadImage):
            media.read_png(good[:n])


def test_hash_against_the_definition():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, (64, 32), dtype=np.uint8).astype(float)
    small = samples.reshape(32, 2, 32).mean(1)
    n = np.arange(32)
    coefficients = np.array([[(small * np.outer(np.cos(np.pi / 32 * (n + 0.5) * u), np.cos(np.pi / 32 * (n + 0.5) * v))).sum() for v in range(8)] for u in range(8)])
    flat = np.round(coefficients.ravel(), 6)
    bits = flat > np.median(flat[1:])
    bits[0] = False
    assert media.dct_hash(samples.astype(np.uint8)) == np.packbits(bits).tobytes().hex()


def test_similar_images_have_near_hashes():
    rng = np.random.default_rng(3)
    smooth = np.kron(rng.integers(0, 256, (8, 8)), np.ones((24, 24)))
    noisy = np.clip(smooth + rng.normal(0, 4, smooth.shape), 0, 255)
    a, b = (int(media.dct_hash(x.astype(np.uint8)), 16) for x in (smooth, noisy))
    assert (a ^ b).bit_count() <= 8


def test_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_media(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        held = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]))
        image = media.write_png(np.frombuffer(held, np.uint8).reshape(-1, 192))
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert r["feature"] == media.dct_hash(np.frombuffer(held, np.uint8).reshape(-1, 192)) and r["media_error"] is None


def test_awkward_rows(spark, awkward, empty):
    stored = media.encode_texts(awkward)
    rows = media.media_features(stored, ["doc_id", "n_bytes"]).collect()
    assert len(rows) == awkward.count() and all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= 192 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["payload_sha256"], r["feature"]))
    assert len(by[1]) == len(by[None]) == 1 and by[3] == by[4]
    assert media.media_features(media.encode_texts(empty), ["doc_id"]).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no image"))], "doc_id long, media binary")
    assert [(r["payload_bytes"], r["media_error"]) for r in media.media_features(broken, ["doc_id"]).orderBy("doc_id").collect()] == [(None, "null"), (None, "no PNG signature")]
