"""Lossless WebP (VP8L): a writer, and a reader that decodes prefix codes, back-references and colour cache and inverts all transforms.

Pixels are rows of (red, green, blue, alpha). The reader is complete, and so is the writer:
its options name every feature of the format. This module works on one image, symbol by
symbol; webp_batch reads and writes the main images of many files side by side.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import numpy as np

SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
#: Fixed by the format: the order in which the lengths of the code length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
N_LENGTHS, N_DISTANCES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
#: The 120 short distance codes: neighbours above and to the left, nearest first.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits, least significant first; zeros follow the end, up to a limit."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size, self.data = 0, 0, 0, data
        self.next = 0

    def _fill(self) -> None:
        self.value |= int.from_bytes(self.data[self.next : self.next + 8], "little") << self.size
        self.size += 64
        self.next += 8
        if self.next > len(self.data) + 64:
            raise ValueError("the stream ends too early")

    def read(self, n: int) -> int:
        if self.size < n:
            self._fill()
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.size -= n
        self.at += n
        return out

    def symbol(self, table: list[tuple[int, int]], width: int) -> int:
        if self.size < width:
            self._fill()
        symbol, n = table[self.value & ((1 << width) - 1)]
        self.value >>= n
        self.size -= n
        self.at += n
        return symbol


def _reverse(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length); a lone symbol takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
        raise ValueError("the code is not complete")
    out, code, last = {}, 0, 0
    for n, s in sorted(used):
        code <<= n - last
        out[s] = (_reverse(code, n), n)
        code, last = code + 1, n
    return out


class Code:
    """A prefix code: a table over `width` bits of (symbol, length)."""

    def __init__(self, lengths: list[int]):
        codes = canonical(lengths)
        self.width = max(n for _, n in codes.values())
        self.largest = max(codes)
        symbols, sizes = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
        for s, (c, n) in codes.items():
            symbols[c :: 1 << n] = s
            sizes[c :: 1 << n] = n
        self.symbols, self.sizes = symbols, sizes
        self.table = list(zip(symbols.tolist(), sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        return bits.symbol(self.table, self.width)


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            lengths[at : at + n] = [last if s == 16 else 0] * n
            at += n
    if len(lengths) != alphabet:
        raise ValueError("a run of code lengths is too long")
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _argb_to_rgba(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint32)
    return np.stack([v >> 16, v >> 8, v, v >> 24], axis=-1).astype(np.uint8)


@dataclass
class Coding:
    """How an entropy-coded image is coded: cache, groups of prefix codes (green, red, blue, alpha, distance), and the group of each block."""

    cache_bits: int
    codes: list[list[Code]]
    block: list[list[int]] | None
    shift: int


def read_coding(bits: Bits, width: int, height: int, main: bool) -> Coding:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width // (1 << shift))
        found = (_image(bits, across, -(-height // (1 << shift)), False) >> 8) & 0xFFFF
        groups, block = int(found.max()) + 1, found.tolist()
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    return Coding(cache_bits, [[_read_code(bits, n) for n in sizes] for _ in range(groups)], block, shift)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height, width) of ARGB numbers."""
    return read_pixels(bits, width, height, read_coding(bits, width, height, main))


def read_pixels(bits: Bits, width: int, height: int, coding: Coding) -> np.ndarray:
    cache_bits, codes, block, shift = coding.cache_bits, coding.codes, coding.block, coding.shift
    count = width * height
    out: list[int] = []
    cache, drop = [0] * (1 << cache_bits), 32 - cache_bits
    fresh = 0  # pixels from here on are not in the cache yet
    while len(out) < count:
        at = len(out)
        green, red, blue, alpha, distance = codes[block[(at // width) >> shift][(at % width) >> shift] if block else 0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append((alpha.read(bits) << 24) | (r << 16) | (s << 8) | b)
        elif s < 256 + N_LENGTHS:
            length = _extended(bits, s - 256)
            code = _extended(bits, distance.read(bits))
            if code > 120:
                back = code - 120
            else:
                x, y = NEIGHBOURS[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > count:
                raise ValueError("a back-reference leaves the image")
            for i in range(at - back, at - back + length):
                out.append(out[i])
        else:
            for v in out[fresh:]:
                cache[((CACHE_FACTOR * v) & 0xFFFFFFFF) >> drop] = v
            fresh = at
            out.append(cache[s - 256 - N_LENGTHS])
    return np.array(out, np.int64).reshape(height, width)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _clip(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255)


def _toward_zero_half(a: np.ndarray) -> np.ndarray:
    return np.where(a < 0, -(-a >> 1), a >> 1)


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The format's 14 predictions from the left, top, top-right and top-left pixels, channels last."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])  # black, opaque, in the order red, green, blue, alpha
    if mode == 11:
        # what the gradient left + top - corner is nearer to, by the sum over channels
        to_left, to_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    average = _average(left, top)
    simple = {1: left, 2: top, 3: right, 4: corner, 7: average}
    if mode in simple:
        return simple[mode]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 12:
        return _clip(left + top - corner)
    return _clip(average + _toward_zero_half(average - corner))


def _unpredict(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Adds predictions to residuals, pixel by pixel."""
    height, width, _ = image.shape
    out = image.astype(np.int64)
    for y in range(height):
        for x in range(width):
            if y == 0:
                own = np.array([0, 0, 0, 255]) if x == 0 else out[0, x - 1]
            elif x == 0:
                own = out[y - 1, 0]
            else:
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                own = predict(int(modes[y >> shift, x >> shift]), out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + own) & 255
    return out


def residuals(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """What _unpredict takes to give `image`."""
    height, width, _ = image.shape
    src = image.astype(np.int64)
    out = src.copy()
    for y in range(height):
        for x in range(width):
            if y == 0:
                own = np.array([0, 0, 0, 255]) if x == 0 else src[0, x - 1]
            elif x == 0:
                own = src[y - 1, 0]
            else:
                right = src[y - 1, x + 1] if x + 1 < width else src[y, 0]
                own = predict(int(modes[y >> shift, x >> shift]), src[y, x - 1], src[y - 1, x], right, src[y - 1, x - 1])
            out[y, x] = (src[y, x] - own) & 255
    return out


def _cross(image: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) the colour that channels have in common; elements: (rows, columns, 3) signed: green to red, green to blue, red to blue."""
    height, width, _ = image.shape
    out = image.astype(np.int64)
    e = elements[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    signed = lambda a: ((a + 128) & 255) - 128
    green = signed(out[..., 1])
    red = out[..., 0]
    new_red = (red + sign * ((e[..., 0] * green) >> 5)) & 255
    blue = out[..., 2] + sign * ((e[..., 1] * green) >> 5)
    out[..., 2] = (blue + sign * ((e[..., 2] * signed(new_red if sign > 0 else red)) >> 5)) & 255
    out[..., 0] = new_red
    return out


def _side(length: int, shift: int) -> int:
    return -(-length // (1 << shift))


def stream_of(data: bytes) -> bytes:
    """The lossless stream within a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    return data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, 4) of a lossless WebP file."""
    return decode_stream(stream_of(data))


@dataclass
class Head:
    """What stands before the main image: its sides, whether alpha counts, what undoes the transforms (in order), and the width the main image is stored with."""

    width: int
    height: int
    alpha: int
    undo: list[tuple]
    stored: int


def read_head(bits: Bits) -> Head:
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha, _ = bits.read(1), bits.read(3)
    undo, seen, own_width = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            undo.append((kind, shift, _image(bits, _side(own_width, shift), _side(height, shift), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _argb_to_rgba(_image(bits, n, 1, False))[0]
            table = (np.cumsum(table.astype(np.int64), axis=0) & 255).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, (table, own_width)))
            own_width = _side(own_width, pack)
        else:
            undo.append((kind, 0, None))
    return Head(width, height, alpha, undo, own_width)


def restored(main: np.ndarray, head: Head) -> np.ndarray:
    """The pixels (height, width, 4) of a main image of ARGB numbers (height, stored width)."""
    image = _argb_to_rgba(main)
    if head.undo:
        image = image.astype(np.int64)
    for kind, shift, more in reversed(head.undo):
        if kind == PREDICTOR:
            image = _unpredict(image, (more >> 8) & 15, shift)
        elif kind == CROSS_COLOUR:
            raw = _argb_to_rgba(more).astype(np.int64)
            signed = ((raw + 128) & 255) - 128
            image = _cross(image, np.stack([signed[..., 2], signed[..., 1], signed[..., 0]], axis=-1), shift, 1)
        elif kind == SUBTRACT_GREEN:
            image[..., 0] = (image[..., 0] + image[..., 1]) & 255
            image[..., 2] = (image[..., 2] + image[..., 1]) & 255
        else:
            table, wide = more
            each = 1 << shift
            green = image[..., 1][:, :, None] >> (np.arange(each) * (8 >> shift)) & ((1 << (8 >> shift)) - 1)
            green = green.reshape(head.height, -1)[:, :wide]
            full = np.zeros((256, 4), np.int64)
            full[: len(table)] = table
            image = full[green]
    out = image.astype(np.uint8)
    if not head.alpha:
        out[..., 3] = 255
    return out


def decode_stream(stream: bytes) -> np.ndarray:
    bits = Bits(stream)
    head = read_head(bits)
    return restored(_image(bits, head.stored, head.height, True), head)


# --- writing -----------------------------------------------------------------------------------


class Writer:
    def __init__(self) -> None:
        self.value, self.at = 0, 0
        self.parts: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n
        if self.at >= 4096:
            whole = self.at // 8
            self.parts.append((self.value & ((1 << (8 * whole)) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.at -= 8 * whole

    def done(self) -> bytes:
        return b"".join([*self.parts, self.value.to_bytes(-(-self.at // 8), "little")])


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Prefix code lengths of at most `most` for symbols that occur; one symbol alone has length 1."""
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) <= 1:
        out[used[0] if used else 0] = 1
        return out
    floor = 1
    while True:
        heap = [(max(counts[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        floor = 2 * floor + 1


def put_code(out: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(used[0], 8)
        return canonical(lengths)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, bits of extra
    i = 0
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        left, value = run, lengths[i]
        if value == 0:
            while left >= 3:
                n = min(left, 138)
                tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
                left -= n
        else:
            tokens.append((value, 0, 0))
            left -= 1
            while left >= 3:
                n = min(left, 6)
                tokens.append((16, n - 3, 2))
                left -= n
        tokens += [(value, 0, 0)] * left
        i += run
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    own = code_lengths(counts, 7)
    codes = canonical(own)
    n = max(i for i in range(19) if own[LENGTH_ORDER[i]]) + 1
    out.put(0, 1)
    out.put(max(n, 4) - 4, 4)
    for i in range(max(n, 4)):
        out.put(own[LENGTH_ORDER[i]], 3)
    out.put(0, 1)
    for t, extra, size in tokens:
        out.put(*codes[t])
        out.put(extra, size)
    return canonical(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra, bits of extra) of a length or a distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _put_image(out: Writer, pixels: np.ndarray, cache_bits: int = 0, references: bool = False, groups: np.ndarray | None = None, group_shift: int = 2, main: bool = False) -> None:
    """pixels: (height, width) ARGB numbers; groups: a group number for each block of the main image."""
    height, width = pixels.shape
    flat = pixels.reshape(-1).tolist()
    tokens: list[tuple] = []
    seen: dict[tuple, int] = {}
    cache, drop = [None] * (1 << cache_bits), 32 - cache_bits
    short = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}
    i = 0
    while i < len(flat):
        length = 0
        if references and i + 3 <= len(flat):
            j = seen.get(tuple(flat[i : i + 3]))
            if j is not None:
                while i + length < len(flat) and length < 4096 and flat[j + length] == flat[i + length]:
                    length += 1
        place = ((CACHE_FACTOR * flat[i]) & 0xFFFFFFFF) >> drop if cache_bits else 0
        if length >= 3:
            tokens.append((i, "copy", length, short.get(i - j, i - j + 120)))
        elif cache_bits and cache[place] == flat[i]:
            tokens.append((i, "cache", place))
            length = 1
        else:
            tokens.append((i, "pixel", flat[i]))
            length = 1
        for k in range(i, i + length):
            if references and k + 3 <= len(flat):
                seen[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[((CACHE_FACTOR * flat[k]) & 0xFFFFFFFF) >> drop] = flat[k]
        i += length
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(groups is not None, 1)
        if groups is not None:
            out.put(group_shift - 2, 3)
            _put_image(out, groups.astype(np.int64) << 8)
    n = int(groups.max()) + 1 if groups is not None else 1
    of = lambda i: int(groups[(i // width) >> group_shift, (i % width) >> group_shift]) if groups is not None else 0
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    counts = [[[0] * s for s in sizes] for _ in range(n)]
    todo = []
    for t in tokens:
        g = of(t[0])
        if t[1] == "pixel":
            v = t[2]
            puts = [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24 & 255, 0, 0)]
        elif t[1] == "cache":
            puts = [(0, 256 + N_LENGTHS + t[2], 0, 0)]
        else:
            a, b = _prefix(t[2]), _prefix(t[3])
            puts = [(0, 256 + a[0], *a[1:]), (4, *b)]
        for which, symbol, _, _ in puts:
            counts[g][which][symbol] += 1
        todo.append((g, puts))
    codes = [[put_code(out, code_lengths(c)) for c in own] for own in counts]
    for g, puts in todo:
        for which, symbol, extra, size in puts:
            out.put(*codes[g][which][symbol])
            out.put(extra, size)


@dataclass
class Options:
    """What encode() uses: transforms in order as (kind, parameter), and how the image is coded.

    Parameters: PREDICTOR (modes, shift); CROSS_COLOUR (elements, shift); SUBTRACT_GREEN and PALETTE None.
    """

    transforms: tuple = ()
    cache_bits: int = 0
    references: bool = False
    groups: np.ndarray | None = None
    group_shift: int = 2


def _numbers(rgba: np.ndarray) -> np.ndarray:
    v = rgba.astype(np.int64)
    return (v[..., 3] << 24) | (v[..., 0] << 16) | (v[..., 1] << 8) | v[..., 2]


def wrapped(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(rgba: np.ndarray, options: Options | None = None) -> bytes:
    """A lossless WebP file of pixels (height, width, 4)."""
    options = options or Options()
    height, width, _ = rgba.shape
    out = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    image = rgba.astype(np.int64)
    for kind, how in options.transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PREDICTOR:
            modes, shift = how
            out.put(shift - 2, 3)
            _put_image(out, np.asarray(modes, np.int64) << 8)
            image = residuals(image, modes, shift)
        elif kind == CROSS_COLOUR:
            elements, shift = how
            out.put(shift - 2, 3)
            e = np.asarray(elements, np.int64) & 255
            _put_image(out, (255 << 24) | (e[..., 2] << 16) | (e[..., 1] << 8) | e[..., 0])
            image = _cross(image, np.asarray(elements, np.int64), shift, -1)
        elif kind == SUBTRACT_GREEN:
            image[..., 0] = (image[..., 0] - image[..., 1]) & 255
            image[..., 2] = (image[..., 2] - image[..., 1]) & 255
        else:
            table, index = np.unique(_numbers(image), return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(table) - 1, 8)
            rows = _argb_to_rgba(table).astype(np.int64)
            _put_image(out, _numbers(np.diff(rows, axis=0, prepend=0) & 255)[None, :])
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = index.reshape(height, -1)
            wide = _side(index.shape[1], pack)
            padded = np.zeros((height, wide << pack), np.int64)
            padded[:, : index.shape[1]] = index
            green = (padded.reshape(height, wide, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=-1)
            image = np.zeros((height, wide, 4), np.int64)
            image[..., 1], image[..., 3] = green, 255
    out.put(0, 1)
    _put_image(out, _numbers(image), options.cache_bits, options.references, options.groups, options.group_shift, main=True)
    return wrapped(out.done())
