"""Bytes as lossless WebP files, many at a time.

`pack` turns payloads into images of 16 pixels a row (wider where there would be too many
rows); the first pixel holds the payload's number of 64-byte blocks, and zeros fill the last
row. Each image is written with what suits its content: where at most 256 distinct pixels
repeat eight times on average, by palette, back-references and codes of its own; else by
literals, back-references and a colour cache whose size follows the image's, under the
codes of a profile for that size (codes of one's own cost more time than they save).

`unpack` reads any lossless file. Heads are read bit by bit, or recognised if read before.
Main images with one group of codes are then read side by side: of every bit position it is
looked up at once where a symbol or a pixel that began there would end, and the chain of
symbols is followed from each image's start over eight at a time. Back-references and hits
in the colour cache become pointers to earlier pixels, which pointer doubling resolves: a
cache hit names its pixel's hash, so the hash of every pixel is known before its colour.
Images with several groups are read symbol by symbol.
"""

from __future__ import annotations

import struct

import numpy as np

from weirloom.llm import webp
from weirloom.llm.webp import CACHE_FACTOR, MAX_SIDE, N_DISTANCES, N_LENGTHS, NEIGHBOURS, PALETTE, SIGNATURE, Bits, Code, Coding, Head, Options, Writer, canonical, code_lengths, put_code

ROW_PIXELS = 16
BLOCK = 64
#: Bits of the main image that are looked up at once.
WINDOW = 1 << 22
#: No symbol with its pixel or reference is longer, in bits.
REACH = 128
#: Colour cache bits by the least number of pixels.
PROFILES = ((0, 0), (128, 7), (1024, 9), (8192, 11))
SHORT = {max(1, x + y * ROW_PIXELS): i + 1 for i, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}
#: Heads that unpack has met, newest last.
KNOWN_HEADS = 16


def _weights() -> list[int]:
    """The rule behind the profiles: how often bytes are taken to occur in texts."""
    out = [1] * 256
    letters = "etaoinsrhldcumfpgwybvkxjqz"
    for i, c in enumerate(letters):
        out[ord(c)], out[ord(c.upper())] = int(4000 * 0.87**i) + 40, int(120 * 0.87**i) + 8
    for c, n in (" ", 6000), ("\n", 120), (".", 400), (",", 300), ("\0", 60):
        out[ord(c)] = n
    for i in range(128, 192):
        out[i] = 14
    out[0xC3] = 500
    for c in "0123456789!#$%&*|-()\"'":
        out[ord(c)] = 30
    return out


class Profile:
    """Codes for images with a colour cache of `cache_bits`, and the head that says so."""

    def __init__(self, cache_bits: int):
        literals = _weights()
        part = 40 if cache_bits else 4  # of a hundred pixels, so many come from the cache for each ten references
        lengths = [max(1, int(40_000 * 0.75**i)) for i in range(N_LENGTHS)]
        cached = [max(1, part * 4000 >> cache_bits)] * (1 << cache_bits) if cache_bits else []
        distances = [2 if i < 10 else 40 if i < 26 else 4 for i in range(N_DISTANCES)]
        own = [code_lengths(c) for c in (literals + lengths + cached, literals, distances)]
        self.cache_bits = cache_bits
        out = Writer()
        out.put(0, 1)  # no transform
        out.put(cache_bits > 0, 1)
        if cache_bits:
            out.put(cache_bits, 4)
        out.put(0, 1)  # one group
        put_code(out, own[0])
        for _ in range(3):
            put_code(out, own[1])
        put_code(out, own[2])
        self.head_bits = out.at + 8 * sum(map(len, out.parts))
        self.head = int.from_bytes(out.done(), "little")
        tables = []
        for lengths_ in own:
            codes = canonical(lengths_)
            value, size = np.zeros(len(lengths_), np.uint64), np.zeros(len(lengths_), np.int64)
            for symbol, (c, n) in codes.items():
                value[symbol], size[symbol] = c, n
            tables.append((value, size))
        self.green, self.other, self.distance = tables


_PROFILES = [(least, Profile(bits)) for least, bits in PROFILES]


def _shape(pixels: int) -> tuple[int, int]:
    rows = -(-pixels // ROW_PIXELS)
    wide = max(1, -(-rows // MAX_SIDE))
    return wide * ROW_PIXELS, -(-rows // wide)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra, bits of extra) of lengths or distance codes from 1."""
    v = np.maximum(values.astype(np.int64) - 1, 0)
    top = np.where(v < 4, 1, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1).astype(np.int64)
    second = v >> (top - 1) & 1
    small = v < 4
    return np.where(small, v, 2 * top + second), np.where(small, 0, v & ((1 << (top - 1)) - 1)), np.where(small, 0, top - 1)


def _last_equal(keys: np.ndarray) -> np.ndarray:
    """For each place, the last one before it with an equal key, or -1."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    out = np.full(len(keys), -1, np.int64)
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    out[order[same + 1]] = order[same]
    return out


def _hash(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits)


def _matches(pixels: np.ndarray, image: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, length) of the references that a greedy pass takes, each of three pixels or more."""
    n = len(pixels)
    if n < 4:
        return []
    wide = pixels.astype(np.uint64)
    three = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:]
    three = (three ^ (three >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + image[:-2].astype(np.uint64)
    before = _last_equal(three)
    at = np.flatnonzero(before >= 0)
    earlier = before[at]
    sure = (image[at] == image[earlier]) & (at + 3 <= ends[at])
    for k in range(3):
        sure &= pixels[at + k] == pixels[earlier + k]
    at, back = at[sure], at[sure] - earlier[sure]
    if not len(at):
        return []
    # runs of places that refer equally far back make longer references
    new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(back) != 0)))
    size = np.diff(np.append(new, len(at)))
    length = np.minimum(np.repeat(new + size, size) - np.arange(len(at)) + 2, 4096)
    out, done = [], 0
    for i, d, m in zip(at.tolist(), back.tolist(), length.tolist(), strict=True):
        if i >= done:
            out.append((i, d, m))
            done = i + m
    return out


def _by_profile(profile: Profile, images: list[np.ndarray], shapes: list[tuple[int, int]]) -> list[bytes]:
    """Files of images (ARGB numbers in a row) under one profile's codes."""
    sizes = np.array([len(x) for x in images], np.int64)
    pixels, image = np.concatenate(images), np.repeat(np.arange(len(images)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    found = _matches(pixels, image, ends)
    at, back, length = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    inside = np.zeros(len(pixels) + 1, np.int32)
    np.add.at(inside, at + 1, 1)
    np.add.at(inside, at + length, -1)
    token = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
    copy = np.zeros(len(pixels), bool)
    copy[at] = True
    copies = copy[token]
    cached = np.zeros(len(token), bool)
    if profile.cache_bits:
        place = _hash(pixels, profile.cache_bits)
        last = _last_equal(place + (image << profile.cache_bits))
        hit = (last >= 0) & (pixels == pixels[last])
        cached = hit[token] & ~copies
    plain = np.flatnonzero(~copies & ~cached)
    value, size = np.zeros((len(token), 4), np.uint64), np.zeros((len(token), 4), np.int64)
    colour = pixels[token[plain]]
    for k, (shift, (codes, bits)) in enumerate(((8, profile.green), (16, profile.other), (0, profile.other), (24, profile.other))):
        byte = (colour >> np.uint32(shift)) & np.uint32(255)
        value[plain, k], size[plain, k] = codes[byte], bits[byte]
    codes, bits = profile.green
    if profile.cache_bits:
        symbol = 256 + N_LENGTHS + place[token[cached]]
        value[cached, 0], size[cached, 0] = codes[symbol], bits[symbol]
    short = np.zeros(max(SHORT) + 1, np.int64)
    short[list(SHORT)] = list(SHORT.values())
    near = (back < len(short)) & (short[np.minimum(back, len(short) - 1)] > 0) & np.array([w == ROW_PIXELS for w, _ in shapes])[image[at]]
    distance = np.where(near, short[np.minimum(back, len(short) - 1)], back + 120)
    prefix, extra, more = _prefixes(length)
    value[copies, 0], size[copies, 0], value[copies, 1], size[copies, 1] = codes[256 + prefix], bits[256 + prefix], extra, more
    prefix, extra, more = _prefixes(distance)
    value[copies, 2], size[copies, 2], value[copies, 3], size[copies, 3] = profile.distance[0][prefix], profile.distance[1][prefix], extra, more
    tokens = np.bincount(image[token], minlength=len(images))
    return _streams(profile, value.reshape(-1), size.reshape(-1), 4 * tokens, shapes)


def _streams(profile: Profile, value: np.ndarray, size: np.ndarray, each: np.ndarray, shapes: list[tuple[int, int]]) -> list[bytes]:
    """Files whose main images are `each` consecutive (value, bits) after the profile's head."""
    front = 40 + profile.head_bits
    at = np.cumsum(size) - size
    heads = np.cumsum(each) - each
    base = at[heads]
    ends = np.append(base[1:], int(size.sum()))
    # every stream starts at a multiple of 64 bits, with room for its head
    room = -(-(ends - base + front) // 64) * 64 + 64
    starts = np.cumsum(room) - room
    at += np.repeat(starts + front - base, each)
    low = value << (at & 31).astype(np.uint64)
    word = at >> 5
    words = np.zeros(int(room.sum()) // 32 + 2, np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[first]] += np.add.reduceat(low & np.uint64(0xFFFFFFFF), first)
    words[word[first] + 1] += np.add.reduceat(low >> np.uint64(32), first)
    raw = words.astype("<u4").tobytes()
    out, head = [], -(-front // 8)
    for (w, h), s, n in zip(shapes, starts.tolist(), (ends - base).tolist(), strict=True):
        stream = raw[s // 8 : s // 8 + -(-(front + n) // 8)]
        mixed = int.from_bytes(stream[:head], "little") | SIGNATURE | (w - 1) << 8 | (h - 1) << 22 | 1 << 36 | profile.head << 40
        out.append(webp.wrapped(mixed.to_bytes(head, "little") + stream[head:]))
    return out


def pack(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload of a positive multiple of 64 bytes."""
    images, shapes = [], []
    for p in payloads:
        w, h = _shape(1 + len(p) // 4)
        raw = struct.pack("<I", len(p) // BLOCK) + p
        rgba = np.frombuffer(raw + bytes(4 * w * h - len(raw)), np.uint8).reshape(-1, 4).astype(np.uint32)
        images.append((rgba[:, 3] << 24) | (rgba[:, 0] << 16) | (rgba[:, 1] << 8) | rgba[:, 2])
        shapes.append((w, h))
    out: list = [None] * len(payloads)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(images):
        # a few hundred pixels tell most texts from what repeats all through
        if len(x) >= 128 and len(np.unique(x[:1024])) <= 128 and 8 * (n := len(np.unique(x))) <= len(x) and n <= 256:
            rgba = webp._argb_to_rgba(x).reshape(shapes[i][1], shapes[i][0], 4)
            out[i] = webp.encode(rgba, Options(transforms=((PALETTE, None),), references=True))
        else:
            groups.setdefault(max(k for k, (least, _) in enumerate(_PROFILES) if len(x) >= least), []).append(i)
    for k, own in groups.items():
        for i, data in zip(own, _by_profile(_PROFILES[k][1], [images[i] for i in own], [shapes[i] for i in own]), strict=True):
            out[i] = data
    return out


# --- reading -----------------------------------------------------------------------------------


class Heads:
    """Heads without transforms, by their bits, so that one that comes again need not be read symbol by symbol."""

    def __init__(self) -> None:
        self.known: list[tuple[int, int, Coding]] = []

    def read(self, stream: bytes) -> tuple[Head, Coding, int]:
        """(head, coding, place of the main image's first pixel in bits)."""
        sides = int.from_bytes(stream[1:5], "little")
        plain = Head((sides & 16383) + 1, (sides >> 14 & 16383) + 1, sides >> 28 & 1, [], (sides & 16383) + 1)
        if stream[:1] == bytes([SIGNATURE]):
            for n, bits, coding in reversed(self.known):
                if (int.from_bytes(stream[5 : 5 + -(-n // 8)], "little") ^ bits) & ((1 << n) - 1) == 0:
                    return plain, coding, 40 + n
        bits = Bits(stream)
        head = webp.read_head(bits)
        coding = webp.read_coding(bits, head.stored, head.height, True)
        if not head.undo and coding.block is None:
            n = bits.at - 40
            self.known = [*self.known[1 - KNOWN_HEADS :], (n, int.from_bytes(stream[5 : 5 + -(-n // 8)], "little") & ((1 << n) - 1), coding)]
        return head, coding, bits.at


def _chains(data: bytes, starts: list[int], ends: list[int], codes: list[Code]) -> tuple[np.ndarray, np.ndarray]:
    """(image, place in bits) of all symbols from each start to each end (both in order) of one buffer."""
    raw = np.frombuffer(data + bytes(64), np.uint8)
    words = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw.data, 0, (1,))
    green, colours, distance = codes[0], codes[1:4], codes[4]
    extra_length = np.array([max(0, (i - 2) >> 1) if i >= 4 else 0 for i in range(N_LENGTHS)], np.int32)
    extra_distance = np.array([max(0, (i - 2) >> 1) if i >= 4 else 0 for i in range(N_DISTANCES)], np.int32)
    images, places, k, at = [], [], 0, starts[0]
    while k < len(starts):
        first = at >> 3
        size = min(WINDOW + REACH, 8 * (len(data) - first) + 64)
        near = (words[first : first + size // 8, None] >> np.arange(8, dtype=np.uint64)).astype(np.uint16).reshape(-1)
        size = len(near)
        last = size - 1  # a sink
        here = np.arange(size, dtype=np.int32)

        def hop(code: Code, near: np.ndarray = near, here: np.ndarray = here, last: int = last) -> np.ndarray:
            out = here + code.sizes.astype(np.uint8)[near & np.uint16((1 << code.width) - 1)]
            out[-16:] = np.minimum(out[-16:], last)
            return out

        index = near & np.uint16((1 << green.width) - 1)
        kind = (1 * (green.symbols >= 256) + (green.symbols >= 256 + N_LENGTHS)).astype(np.uint8)[index]
        step = after = hop(green)
        for i, code in enumerate(colours):
            if not i or not np.array_equal(code.sizes, colours[i - 1].sizes):
                own_hop = hop(code)
            step = own_hop[step]
        cached, refer = np.flatnonzero(kind == 2), np.flatnonzero(kind == 1)
        step[cached] = after[cached]
        to = np.minimum(after[refer] + extra_length[green.symbols[index[refer]] - 256], last)
        bits = near[to] & np.uint16((1 << distance.width) - 1)
        step[refer] = np.minimum(to + distance.sizes[bits] + extra_distance[distance.symbols[bits]], last)
        eight = step
        for _ in range(3):
            eight = eight[eight]
        eight = memoryview(np.ascontiguousarray(eight))
        own, heads = [], []
        limit = last if 8 * (len(data) - first) + 64 <= WINDOW + REACH else size - 8 * REACH
        while k < len(starts):
            p, end = at - 8 * first, ends[k] - 8 * first
            while p < end and p < limit:
                own.append(k)
                heads.append(p)
                p = eight[p]
            if p < end:
                at = 8 * first + p
                break
            k += 1
            at = starts[k] if k < len(starts) else at
            if at - 8 * first >= limit:
                break
        grid = np.empty((len(heads), 8), np.int64)
        grid[:, 0] = heads
        for j in range(1, 8):
            grid[:, j] = step[grid[:, j - 1]]
        image = np.repeat(np.array(own, np.int64), 8)
        place = grid.reshape(-1) + 8 * first
        keep = place < np.array(ends, np.int64)[image] if len(image) else np.zeros(0, bool)
        images.append(image[keep])
        places.append(place[keep])
    return np.concatenate(images), np.concatenate(places)


def _resolve(to: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places (or to themselves) end."""
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def _main_images(coding: Coding, streams: list[bytes], firsts: list[int], shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The main images (ARGB numbers) of streams that share one group of codes."""
    codes = coding.codes[0]
    data = b"".join(streams)
    base = np.cumsum([0, *map(len, streams)])[:-1] * 8
    counts = np.array([w * h for w, h in shapes], np.int64)
    wanted = np.cumsum(counts) - counts
    if all(c.width == 0 for c in codes[:4]):  # no bits at all: every pixel is the same
        v = (int(codes[3].symbols[0]) << 24) | (int(codes[1].symbols[0]) << 16) | (int(codes[0].symbols[0]) << 8) | int(codes[2].symbols[0])
        return [np.full((h, w), v, np.int64) for w, h in shapes]
    image, place = _chains(data, (base + np.array(firsts)).tolist(), (base + 8 * np.array([len(s) for s in streams])).tolist(), codes)
    raw = np.frombuffer(data + bytes(64), np.uint8)
    words = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw.data, 0, (1,))

    def peek(at: np.ndarray) -> np.ndarray:
        return words[at >> 3] >> (at & 7).astype(np.uint64)

    def read(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = (peek(at) & np.uint64((1 << code.width) - 1)).astype(np.int64)
        return code.symbols[bits].astype(np.int64), at + code.sizes[bits]

    def extended(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        extra = (peek(at) & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << more) + extra) + 1, at + more

    symbol, after = read(codes[0], place)
    length = np.ones(len(place), np.int64)
    copies = np.flatnonzero((symbol >= 256) & (symbol < 256 + N_LENGTHS))
    length[copies], then = extended(symbol[copies] - 256, after[copies])
    prefix, then = read(codes[4], then)
    code, _ = extended(prefix, then)
    # pixels before each symbol within its image; what follows an image's last pixel is padding
    starts = np.searchsorted(image, np.arange(len(streams)))
    offset = np.cumsum(length) - length
    offset -= offset[np.minimum(starts, max(0, len(offset) - 1))][image] if len(offset) else 0
    keep = offset < counts[image]
    if np.any(np.bincount(image[keep], weights=length[keep], minlength=len(streams)) != counts):
        raise ValueError("the stream ends too early, or a back-reference leaves the image")
    first = offset + wanted[image]
    total = int(counts.sum())
    to, value = np.arange(total), np.zeros(total, np.uint32)
    plain = np.flatnonzero((symbol < 256) & keep)
    at, argb = after[plain], symbol[plain].astype(np.uint32) << np.uint32(8)
    for shift, c in zip((16, 0, 24), codes[1:4], strict=True):
        byte, at = read(c, at)
        argb |= byte.astype(np.uint32) << np.uint32(shift)
    value[first[plain]] = argb
    good = keep[copies]
    own, code = copies[good], code[good]
    width = np.array([w for w, _ in shapes], np.int64)[image[own]]
    step = np.array([(0, 0), *NEIGHBOURS], np.int64)[np.minimum(code, 120)]
    back = np.where(code > 120, code - 120, np.maximum(1, step[:, 0] + step[:, 1] * width))
    if np.any(back > offset[own]):
        raise ValueError("a back-reference leaves the image")
    size = length[own]
    inner = np.repeat(first[own], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    to[inner] = inner - np.repeat(back, size)
    to = _resolve(to)
    if coding.cache_bits:
        hits = np.flatnonzero((symbol >= 256 + N_LENGTHS) & keep)
        from_cache = first[hits]
        known = _hash(value, coding.cache_bits)
        known[from_cache] = symbol[hits] - 256 - N_LENGTHS
        known = known[to]
        last = _last_equal(known + (np.repeat(np.arange(len(streams)), counts) << coding.cache_bits))[from_cache]
        to[from_cache] = np.where(last >= 0, last, from_cache)  # an empty place of the cache is 0
        to = _resolve(to)
    value = value[to].astype(np.int64)
    return [value[a : a + n].reshape(h, w) for a, n, (w, h) in zip(wanted.tolist(), counts.tolist(), shapes, strict=True)]


def decode_all(files: list[bytes], heads: Heads | None = None) -> list[np.ndarray]:
    """The pixels (height, width, 4) of each file; heads keeps those read before."""
    heads, out = heads or Heads(), [None] * len(files)
    groups: dict[int, list[tuple]] = {}
    for i, data in enumerate(files):
        stream = webp.stream_of(data)
        head, coding, at = heads.read(stream)
        if coding.block is None and (coding.codes[0][0].width or coding.codes[0][0].largest < 256):
            groups.setdefault(id(coding), []).append((i, coding, stream, at, head))
        else:
            out[i] = webp.decode_stream(stream)
    for own in groups.values():
        mains = _main_images(own[0][1], [x[2] for x in own], [x[3] for x in own], [(x[4].stored, x[4].height) for x in own])
        for (i, _, _, _, head), main in zip(own, mains, strict=True):
            out[i] = webp.restored(main, head)
    return out


def unpack(files: list[bytes], heads: Heads | None = None) -> list[tuple[np.ndarray, bytes]]:
    """(pixels, payload) of each file that pack has written."""
    out = []
    for pixels in decode_all(files, heads):
        raw = pixels.tobytes()
        out.append((pixels, raw[4 : 4 + BLOCK * struct.unpack_from("<I", raw)[0]]))
    return out
