"""Media columns against another way to the same values."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from quern.llm import media


def averages(image, height, width):
    """Area averages by the share of each sample in each cell."""

    def shares(n, cells):
        out = np.zeros((cells, n))
        for k in range(cells):
            a, b = k * n / cells, (k + 1) * n / cells
            for i in range(n):
                out[k, i] = max(0.0, min(b, i + 1) - max(a, i)) / (b - a)
        return out

    return np.einsum("ai,ij...,bj->ab...", shares(image.shape[0], height), image.astype(float), shares(image.shape[1], width))


@pytest.mark.parametrize("shape", [(5, 7), (4, 6, 3), (1, 1), (33, 64), (64, 2, 3)])
@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_round_trip_and_resize(shape, form):
    image = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    assert (media.decode(media.encode(image, form)) == image).all()
    for size in ((1, 1), (3, 2), (9, 8), (40, 70)):
        assert np.allclose(media.area_resize(image, *size), averages(image, *size))
        assert np.allclose(media.area_resize(image, *size, block=2), averages(image, *size))


@pytest.mark.parametrize("data, why", [
    (b"", "not a"), (b"P5", "not a"), (b"P5\n3", "header"), (b"P5 a b 255 ", "header"), (b"P5\n3 3\n255\nab", "fewer"), (b"P2 2 2 9 1 2 3", "fewer"),
    (b"P1 2 2\n1 0 # 1\n0", "fewer"), (b"P5 99999999 99999999 255 a", "fewer"), (b"P3 1 1 3 9 1 1", "above"), (b"P5 0 1 255 a", "positive"), (b"P2 1 1 9 -1", "fewer"),
    (b"BM", "cut off"), (media.encode_bmp(np.zeros((5, 64), np.uint8))[:100], "fewer"), (b"BM" + b"\xff" * 80, "only"), (b"P9 1 1 1", "not a"),
])
def test_broken_images(data, why):
    with pytest.raises(ValueError, match=why):
        media.decode(data)


def test_plain_forms():
    assert media.decode(b"P1 2 2\n1 0 # 1 1\n0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4 2 1\n\x80").tolist() == [[0, 255]]
    assert media.decode(b"P2 # c\n2 1 9 0 9").tolist() == [[0, 255]]
    assert media.decode(b"P5 1 1 65535\n\x80\x00").tolist() == [[128]]


def test_tiles_of_a_table(spark):
    rng = np.random.default_rng(2)
    images = {"a": rng.integers(0, 256, (100, 130), np.uint8), "b": rng.integers(0, 256, (40, 30, 3), np.uint8), "wide": rng.integers(0, 256, (10, 600), np.uint8)}
    rows = [(k, media.encode(x, f), f) for k, x in images.items() for f in ("pgm", "bmp")]
    rows += [("broken", b"P5\n3", "pgm"), ("null", None, "pgm")]
    table = spark.createDataFrame(rows, "name string, bytes binary, npy string")  # a name that the result has too
    got = media.media_tiles(table, "name", "bytes", size=256, side=64).collect()
    for name, image in images.items():
        small = image if max(image.shape[:2]) <= 256 else np.rint(averages(image, round(10 * 256 / 600), 256)).astype(np.uint8)
        whole = np.zeros_like(small)
        mine = [r for r in got if r["key"] == name]
        assert len(mine) == 2 * -(-small.shape[0] // 64) * -(-small.shape[1] // 64)  # both forms
        for r in mine:
            tile = np.load(io.BytesIO(r["npy"]))
            a, b = r["tile_row"] * 64, r["tile_column"] * 64
            whole[a : a + 64, b : b + 64] = tile
            assert (tile == small[a : a + 64, b : b + 64]).all() and r["error"] is None
            assert r["tile_hash"] == media.difference_hash(tile) and r["image_hash"] == media.difference_hash(small)
        assert (whole == small).all()
    assert [(r["key"], r["npy"], r["error"] is None) for r in got if r["key"] in ("broken", "null")] == [("broken", None, False), ("null", None, False)]
    assert media.media_tiles(table.limit(0), "name", "bytes").collect() == []


def test_op7_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op7_media_columns(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        small = np.rint(np.round(averages(np.frombuffer(payload, np.uint8).reshape(-1, 64), 32, 32), 9)).astype(np.uint8)
        parts = []
        for a in (0, 16):
            for b in (0, 16):
                out = io.BytesIO()
                np.save(out, np.ascontiguousarray(small[a : a + 16, b : b + 16]))
                parts.append(out.getvalue())
        if r["tiles_sha256"] == hashlib.sha256(b"".join(parts)).hexdigest():
            cells = np.round(averages(small, 8, 9), 9)
            assert r["feature"] == np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
        else:  # an average that lies on a half may be rounded the other way
            assert np.isclose(np.abs(averages(np.frombuffer(payload, np.uint8).reshape(-1, 64), 32, 32) % 1 - 0.5).min(), 0, atol=1e-6)
        assert r["n_tiles"] == 4 and r["thumb_bytes"] == 54 + 1024 + 1024
