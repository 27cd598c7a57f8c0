import hashlib
import heapq
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import LongType, StructField, StructType

from meshwork.llm import webp
from meshwork.llm.webp import CROSS, PALETTE, PREDICTOR, SUBTRACT

from .helpers import empty, table


def images():
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (5, 7), (9, 20)):
        yield rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        yield rng.choice(np.array([[1, 2, 3, 4], [9, 8, 7, 255], [0, 0, 0, 0]], np.uint8), (h, w))
        yield np.tile(rng.integers(0, 256, (1, 3, 4)), (h, w // 3 + 1, 1))[:, :w].astype(np.uint8)


@pytest.mark.parametrize("transforms", [(), (SUBTRACT,), (PREDICTOR,), (CROSS,), (PREDICTOR, CROSS, SUBTRACT), (PALETTE,), (PALETTE, PREDICTOR)])
def test_round_trip(transforms):
    rng = np.random.default_rng(8)
    for k, im in enumerate(images()):
        for cache_bits in (0, 1, 6):
            for tile_bits in (0, 2):
                modes, crosses = rng.integers(0, 14, (4, 8)), rng.integers(0, 256, (4, 8, 4))
                data = webp.encode(im, transforms, cache_bits, copies=bool(k % 2), tile_bits=tile_bits, modes=modes, crosses=crosses)
                assert np.array_equal(webp.decode(data), im)


def test_single_pixel_by_hand():
    """One red opaque pixel, all five codes simple."""
    bits = "0" * 28 + "1" + "000"  # 1 x 1, alpha, version
    bits += "0" + "0" + "0"  # no transform, no cache, one group
    byte = lambda v: f"{v:08b}"[::-1]
    for only in (0, 255, 0, 255, 0):
        bits += "1" + "0" + ("1" + byte(only) if only > 1 else "0" + str(only))
    bits += "0" * (-len(bits) % 8)
    body = b"\x2f" + bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    body_padded = body + b"\0" * (len(body) % 2)
    data = b"RIFF" + (12 + len(body_padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body_padded
    assert webp.decode(data).tolist() == [[[255, 0, 0, 255]]]


def test_texts_come_back(spark):
    texts = ["", None, "a" * 64, "a" * 63, "ab" * 500, "é" * 3000, "x" * (64 * 16384 + 70), "the same words again and again. " * 40, "".join(map(chr, range(1, 2000)))]
    got = {r["doc_id"]: r for r in webp.read_media(webp.store_texts(table(spark, texts))).collect()}
    for k, t in enumerate(texts):
        x = (t or "").encode()
        payload = x + bytes(-len(x) % 64 if x else 64)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(x), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    assert webp.read_media(webp.store_texts(empty(spark))).count() == 0


@pytest.mark.parametrize("kinds", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes_by_content(kinds):
    """Up to 16 different bytes become a palette: the file has that transform,
    and pixels are bundled."""
    rng = np.random.default_rng(kinds)
    values = rng.permutation(256)[:kinds].astype(np.uint8)
    x = np.concatenate([values, rng.choice(values, 64 * 40 - kinds - 640), np.tile(rng.choice(values, 64), 10)]).astype(np.uint8)
    data = webp.encode_bytes(x.tobytes())
    assert np.array_equal(webp.decode(data), np.stack([x.reshape(-1, 64)] * 3 + [np.full((40, 64), 255, np.uint8)], axis=-1))
    bits = webp.Bits(data[21:])
    bits.read(28 + 1 + 3)
    assert (bits.read(1), bits.read(2)) == (1, PALETTE if kinds <= 16 else SUBTRACT)


def test_the_query_reads_a_stored_table(spark, tmp_path):
    docs = table(spark, ["some text", None, "abab" * 300])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in webp.op3_webp(spark, str(tmp_path)).collect()}
    want = {r["doc_id"]: r for r in webp.read_media(webp.store_texts(docs)).collect()}
    assert got == want and len(got) == 3


def test_broken_files():
    _, data = webp.store("some text")
    for bad in (b"", data[:12], data[:8] + b"WEBPVP8 " + data[16:], data[:24]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_limited_code_lengths():
    counts = {k: 2**k for k in range(40)}
    lengths = webp.code_lengths(counts)
    assert max(lengths.values()) <= 15 and sum(2.0**-n for n in lengths.values()) == 1


def parts_used(data):
    """Transforms, cache bits and groups of a file, by its own bits."""
    bits, kinds = webp.Bits(data[21:]), []
    bits.read(28 + 1 + 3)
    while bits.read(1):
        kinds.append(bits.read(2))
        if kinds[-1] == PREDICTOR:
            side = 1 << bits.read(3) + 2
            webp._pixels(bits, 64 // side, -(-len(webp.decode(data)) // side), False)
        elif kinds[-1] == PALETTE:
            webp._pixels(bits, bits.read(8) + 1, 1, False)
    return kinds, bits.read(4) if bits.read(1) else 0, bool(bits.read(1))


def test_the_writer_of_texts_chooses_by_content():
    rng = np.random.default_rng(7)
    smooth = (np.add.outer(np.arange(64) * 2, np.arange(64) * 3) // 2 + rng.integers(0, 3, (64, 64))).astype(np.uint8)
    recent = np.concatenate([rng.choice(rng.integers(0, 200, 2), 32) for _ in range(2 * 80)]).astype(np.uint8)
    kinds = rng.permutation(256)
    halves = np.concatenate([rng.choice(kinds[:40], 64 * 128), rng.choice(kinds[40:80], 64 * 128)]).astype(np.uint8)
    prose = np.frombuffer(b"".join(rng.choice([b"some ", b"words of ", b"which a text is made, ", b"and others "], 700).tolist()).ljust(64 * 200, b".")[: 64 * 200], np.uint8)
    noise = rng.integers(0, 256, 64 * 70).astype(np.uint8)
    used = {}
    for name, x in (("smooth", smooth.reshape(-1)), ("recent", recent), ("halves", halves), ("prose", prose), ("noise", noise)):
        data = webp.encode_bytes(x.tobytes())
        assert np.array_equal(webp.decode(data), np.stack([x.reshape(-1, 64)] * 3 + [np.full((len(x) // 64, 64), 255, np.uint8)], axis=-1))
        used[name] = *parts_used(data), len(data) / len(x)
    assert used["smooth"][0] == [SUBTRACT, PREDICTOR] and used["smooth"][3] < 0.4
    assert used["recent"][1] > 0
    assert used["halves"][2] and used["halves"][3] < 0.7
    assert used["prose"][3] < 0.3  # passages at many distances
    assert used["noise"][:3] == ([SUBTRACT], 0, False)


def test_planes_are_predicted_as_pixels_are():
    rng = np.random.default_rng(9)
    for h, w in ((1, 8), (7, 3), (20, 16)):
        rest = rng.integers(0, 256, (h, w)).astype(np.uint8)
        for modes in [np.full((5, 4), k) for k in range(14)] + [rng.integers(0, 14, (5, 4)), rng.choice([0, 2, 3, 4, 8, 9], (5, 4))]:
            whole = webp._predictor(rest.astype(np.uint32) << np.uint32(8), modes, 2, True)
            assert np.array_equal(webp._unpredicted(rest, modes, 2), whole >> np.uint32(8) & np.uint32(255))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=90), st.integers(1, 60)), min_size=1, max_size=12), st.integers(1, 4))
def test_any_bytes_come_back(blocks, times):
    x = b"".join(b * n for b, n in blocks) * times
    x += bytes(-len(x) % 64)
    assert webp.decode(webp.encode_bytes(x))[..., 1].tobytes() == x


def calls(run):
    """Calls of Python and built-in functions: the overhead of short texts."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


class Frame:
    """Stands for a DataFrame, and gives the function of batches that it is handed."""

    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_short_texts_take_few_calls():
    """Documents of a kilobyte or two cost by the calls, not by the bytes: of
    what the query does with a batch of 200, so many for each."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("etaoinshrdlucmfwyp", k=rnd.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=200)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    store, read, out = webp.store_texts(Frame()), webp.read_media(Frame()), []
    out += store([batch])
    list(read(out))  # so that what is made once is there
    assert calls(lambda: list(store([batch]))) < 450 * 200
    assert calls(lambda: list(read(out))) < 680 * 200


def test_files_do_not_depend_on_what_is_stored_with_them():
    rng = np.random.default_rng(6)
    smooth = (np.add.outer(np.arange(64) * 2, np.arange(64) * 3) // 2 + rng.integers(0, 3, (64, 64))).astype(np.uint8)
    recent = np.concatenate([rng.choice(rng.integers(0, 200, 2), 32) for _ in range(160)]).astype(np.uint8)
    kinds = rng.permutation(256)
    halves = np.concatenate([rng.choice(kinds[:40], 64 * 128), rng.choice(kinds[40:80], 64 * 128)]).astype(np.uint8)
    passage = rng.integers(0, 256, 64 * 3).astype(np.uint8)
    blocks = [x.tobytes() for x in (passage, smooth, recent, np.zeros(64, np.uint8), passage, halves, rng.choice([7, 9, 200], 64 * 90).astype(np.uint8), np.tile(passage, 120), passage[:64])]
    alone = [webp.encode_bytes(x) for x in blocks]
    assert len({parts_used(m)[0][0] for m in alone}) == 2 and len({parts_used(m)[1:] for m in alone}) > 2
    for order in (list(range(9)), [8, 5, 2, 0, 4, 1, 7, 3, 6], [0, 4], [3, 3, 3]):
        together = webp.encode_blocks([blocks[k] for k in order])
        assert together == [alone[k] for k in order]
        rows = [webp.decode(m)[..., 1] for m in together]
        assert [x.tobytes() for x in rows] == [blocks[k] for k in order]
        assert webp.features(rows) == [webp.feature(x) for x in rows]
    texts = ["a b c " * 9, None, "", "long words " * 9000, "a b c " * 9, "\u00e9\n" * 40]
    assert webp.store_many(texts) == [webp.store(t) for t in texts] and webp.store_many([]) == []


def test_features_are_means_of_cells():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 8, 9, 63, 200):
        rows = rng.integers(0, 256, (n, 64)).astype(np.uint8)
        cells = np.array([[rows[n * y // 8 : max(n * (y + 1) // 8, n * y // 8 + 1), 8 * x : 8 * x + 8].mean() for x in range(8)] for y in range(8)])
        assert webp.feature(rows) == f"{np.packbits(cells > cells.mean()).tobytes().hex()}:{rows.mean():.3f}"


def test_code_lengths_are_optimal():
    rnd = random.Random(5)
    for n in (2, 3, 19, 60, 280):
        counts = {s: int(rnd.paretovariate(0.8)) for s in rnd.sample(range(300), n)}
        heap, cost = list(counts.values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            heapq.heappush(heap, both)
            cost += both
        lengths = webp.code_lengths(counts, 40)
        assert sum(counts[s] * k for s, k in lengths.items()) == cost and sum(2.0**-k for k in lengths.values()) == 1
