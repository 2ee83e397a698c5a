import hashlib
import zlib

import numpy as np
import pytest

from weirloom.llm import media_columns, webp as w, webp_batch as b

rng = np.random.default_rng(0)


def noise(h, wide, colours=None):
    if colours:
        return rng.integers(0, 256, (colours, 4))[rng.integers(0, colours, (h, wide))].astype(np.uint8)
    return rng.integers(0, 256, (h, wide, 4)).astype(np.uint8)


SMOOTH = (np.add.outer(np.arange(23) * 3, np.arange(37) * 5)[..., None] + np.array([0, 7, 90, 3]) + rng.integers(0, 3, (23, 37, 4))).astype(np.uint8)
CASES = {
    "one pixel": (noise(1, 1), w.Options()),
    "literals": (noise(5, 7), w.Options()),
    "palette of 2": (noise(9, 31, 2), w.Options(((w.PALETTE, None),), references=True)),
    "palette of 3": (noise(9, 30, 3), w.Options(((w.PALETTE, None),))),
    "palette of 14 with cache": (noise(9, 30, 14), w.Options(((w.PALETTE, None),), cache_bits=3, references=True)),
    "palette of 200": (noise(9, 30, 200), w.Options(((w.PALETTE, None),))),
    "cache and references": (noise(40, 40, 9), w.Options(cache_bits=4, references=True)),
    "groups": (noise(40, 40, 9), w.Options(groups=rng.integers(0, 5, (10, 10)))),
    "all": (SMOOTH, w.Options(((w.PREDICTOR, (rng.integers(0, 14, (6, 10)), 2)), (w.CROSS_COLOUR, (rng.integers(-128, 128, (3, 5, 3)), 3)), (w.SUBTRACT_GREEN, None)), cache_bits=11, references=True, groups=rng.integers(0, 3, (6, 10)))),
    "flat": (np.full((50, 50, 4), 7, np.uint8), w.Options(references=True)),
    **{f"predictor {m}": (SMOOTH, w.Options(((w.PREDICTOR, (np.full((6, 10), m), 2)),))) for m in range(14)},
}


@pytest.mark.parametrize("name", CASES)
def test_round_trip(name):
    pixels, options = CASES[name]
    data = w.encode(pixels, options)
    assert (w.decode(data) == pixels).all()
    assert (b.decode_all([data])[0] == pixels).all()


def test_many_files_side_by_side():
    names = [n for n in CASES if n != "all"]
    files = [w.encode(*CASES[n]) for n in names] * 2
    for n, pixels in zip(names * 2, b.decode_all(files, b.Heads())):
        assert (pixels == CASES[n][0]).all(), n


def texts():
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 9, 300)]
    prose = [b" ".join(words[i] for i in rng.integers(0, 300, n)) for n in (1, 5, 40, 300, 3000, 40000)]
    return [b"", b"a", "aé😀".encode() * 64, bytes(range(256)), bytes(range(256)) * 4099 * 3, b"x" * 1_200_000, b"ab " * 500, prose[3] * 2, prose[3] + prose[4] + prose[3] * 3, *prose]


def padded(text):
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def test_packed_files_agree_with_the_full_reader(monkeypatch):
    payloads = [padded(t) for t in texts()]
    files = b.pack(payloads)
    assert [b.pack([p])[0] for p in payloads] == files  # whatever else is in the batch
    for window in (b.WINDOW, 5000):
        monkeypatch.setattr(b, "WINDOW", window)
        read = b.unpack(files)
        assert [p for _, p in read] == payloads
    for f, (pixels, _) in zip(files, read):
        if len(f) < 100_000:
            assert (w.decode(f) == pixels).all()


def test_packed_files_use_what_the_format_has():
    """References, colour cache and palette occur, and repeats cost next to nothing."""
    tokens, transforms, caches = set(), set(), set()
    for f in b.pack([padded(t) for t in texts() if len(t) < 20_000]):
        bits = w.Bits(w.stream_of(f))
        head = w.read_head(bits)
        coding = w.read_coding(bits, head.stored, head.height, True)
        transforms |= {kind for kind, _, _ in head.undo}
        caches.add(coding.cache_bits)
        stream = w.stream_of(f)
        if coding.codes[0][0].width:
            _, place = b._chains(stream, [bits.at], [8 * len(stream)], coding.codes[0])
            for at in place.tolist():
                value = int.from_bytes(stream[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
                symbol = coding.codes[0][0].symbols[value & ((1 << coding.codes[0][0].width) - 1)]
                tokens.add("pixel" if symbol < 256 else "copy" if symbol < 280 else "cache")
    assert tokens == {"pixel", "copy", "cache"} and transforms == {w.PALETTE} and {0, 7, 9} <= caches
    once, thrice = (len(b.pack([padded(t)])[0]) for t in (texts()[12][:1600], texts()[12][:1600] * 3))
    assert thrice < once + 200


def test_damaged_files_are_errors():
    f = w.encode(noise(20, 20), w.Options(references=True, cache_bits=2))
    for bad in (b"", f[:10], f[: len(f) // 2], b"RIFF" + f[4:20]):
        with pytest.raises((ValueError, KeyError, IndexError)):
            w.decode(bad)
        with pytest.raises((ValueError, KeyError, IndexError)):
            b.decode_all([bad])


def test_columns(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (2, None, None), (3, "", ""), (None, "é" * 40000, "z"), (4, "a" * 64, "m")]
    out = media_columns.store(spark.createDataFrame(rows, "doc_id long, text string, m_row string"))
    got = media_columns.load(out).collect()
    assert media_columns.load(out.limit(0)).count() == 0
    by = {}
    for r in got:
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by.setdefault(text or "", set()).add((r["media_sha256"], r["feature"]))
    assert len(got) == 6 and all(len(v) == 1 for v in by.values())
