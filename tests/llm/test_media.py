import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridlogic.llm import jpeg as J
from gridlogic.llm import media as M

DOCS = "doc_id long, text string, media string, n_bytes string"


def samples_of(stored):
    found = J.thumbnails([stored])[0]
    return found and found[1].tobytes()


def test_payloads_come_back_exactly():
    rng = random.Random(2)
    payloads = [bytes(rng.choices(range(256), k=192 * k)) for k in (1, 2, 7)] + [b"\0\xff" * 96, b"\xff" * 384, b" " * 192, b"ab\xff" * (64 * (J.MOST_ROWS + 5))]
    assert [x[1].tobytes() for x in J.thumbnails(J.encode(payloads))] == payloads
    assert J.encode([]) == [] and J.thumbnails([]) == []


def test_damage_and_other_formats_are_told():
    good = J.encode([b"some text".ljust(192)])[0]
    for bad in (b"", b"GIF89a", good[:-2], good[:100], good[:-30] + good[-2:], good[:20], good.replace(b"\xff\xc0", b"\xff\xc2")):
        assert J.thumbnails([bad]) == [None]
    assert samples_of(good) and J.thumbnails([good, b"bad", good])[2][1].tobytes() == samples_of(good)


@pytest.mark.parametrize(("width", "height", "gray"), [(64, 48, True), (65, 33, True), (640, 400, True), (50, 35, False), (333, 200, False)])
def test_pictures_of_another_encoder(spark, width, height, gray):
    """Javas's ImageIO writes baseline JPEGs with AC coefficients, one lane, and 4:2:0 colour."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if gray else 1)
    pixels = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width) if width * height < 5000 else range(0, width):
            v = int(127 + 90 * np.sin(x / 17) * np.cos(y / 11))
            pixels[y, x] = v
    flat = pixels.ravel().tolist()
    raster = image.getRaster()
    array = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
    for i, v in enumerate(flat):
        array[i] = v
    for band in range(1 if gray else 3):
        raster.setSamples(0, 0, width, height, band, array)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    stored = bytes(out.toByteArray())
    found = J.thumbnails([stored])[0]
    assert found is not None and (found[0].width, found[0].height) == (width, height)
    thumb = found[1].astype(int)
    rows, columns = height // 8, width // 8
    means = pixels[: rows * 8, : columns * 8].reshape(rows, 8, columns, 8).mean(axis=(1, 3))
    assert np.abs(thumb[:rows, :columns] - means).max() < 6
    assert thumb.shape == (-(-height // 8), -(-width // 8))


def test_features_with_nulls_repeats_and_long_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long \U0001f600 " * 100_000]
    rows = [(i, t, "m", "n") for i, t in enumerate(texts)] + [(None, "a", "m", "n"), (2, "a", "m", "n")]
    got = M.media_features(M.encode_media(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode()))), strict=True):
        n, payload = M.padded(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, n, len(payload)) and r.payload_bytes % 192 == 0 and r.payload_bytes > 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert by_text.setdefault(t or "", tuple(r)[2:]) == tuple(r)[2:]
    assert M.media_features(M.encode_media(spark.createDataFrame([], DOCS))).collect() == []
    odd = spark.createDataFrame([(1, 2, None), (2, 3, b"junk")], "doc_id long, n_bytes long, media binary")
    assert [r.payload_sha256 for r in M.media_features(odd).collect()] == [None, None]


def test_query_over_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = M.query(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        n, payload = M.padded(docs[r.doc_id])
        stored = J.encode([payload])[0]
        assert (r.n_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (n, hashlib.sha256(payload).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest())


def test_cut_scans_without_restart_markers():
    whole = J.encode([bytes(range(192)) * 20])[0]
    for data in (whole, *(whole[:n] for n in range(2, len(whole), 7))):
        J.thumbnails([data, whole])  # no exception, whatever is cut
    head = whole[: whole.index(b"\xff\xda")]
    scan = whole[len(head) : len(head) + 2 + int.from_bytes(whole[len(head) + 2 : len(head) + 4], "big")]
    at = head.index(b"\xff\xc0")
    for side in (64, 1024, 65528):
        frame = head[: at + 5] + side.to_bytes(2, "big") * 2 + head[at + 9 :]
        frame = re.sub(rb"\xff\xdd\x00\x04..", b"", frame, flags=re.S)  # no restart interval
        for tail in (b"", b"\xff\xd9"):
            cut = frame + scan + b"\x12\x34\x56\x78" + tail
            assert J.thumbnails([cut, whole])[0] is None and J.thumbnails([cut, whole])[1] is not None
