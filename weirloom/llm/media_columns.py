"""Media columns: texts (or any bytes) as lossless WebP images, and features of what is read back.

`store` pads a text's UTF-8 bytes with zero bytes to a positive multiple of 64, takes four
bytes for a pixel (red, green, blue, alpha), and writes one image each, whose first pixel
holds the payload's size. `load` decodes the images again and computes digests and features.

Defined results: null text is empty, so its payload is 64 zero bytes; equal texts give equal
files and features; an empty table gives an empty one; other columns are kept, those with
the names of the result's are replaced. Null media gives null results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirloom.llm import webp_batch
from weirloom.llm.common import slices

BLOCK = 64
SLICE = 256 << 10


def feature(pixels: np.ndarray) -> str:
    """Size, channel sums, mean absolute step along rows and down columns, and number of distinct bytes, as one string."""
    wide = pixels.astype(np.int32)
    sums = ",".join(map(str, wide.sum(axis=(0, 1), dtype=np.int64).tolist()))
    along, down = int(np.abs(np.diff(wide, axis=1)).sum()), int(np.abs(np.diff(wide, axis=0)).sum())
    return f"{pixels.shape[1]}x{pixels.shape[0]};sum={sums};dx={along};dy={down};distinct={int((np.bincount(pixels.reshape(-1), minlength=256) > 0).sum())}"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with n_bytes and media (a WebP file)."""
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), "n_bytes", "media")]
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("m_row"), docs[text].alias("m_text"))
    out = T.StructType([rows.schema["m_row"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "m_text", SLICE):
                raw, sizes = data.tobytes(), np.diff(offsets)
                payloads = [raw[a:b] + bytes(max(BLOCK, -(-(b - a) // BLOCK) * BLOCK) - (b - a)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("m_row"), pa.array(sizes), pa.array(webp_batch.pack(payloads), pa.binary())], out.names)

    return rows.mapInArrow(run, out).select("m_row.*", "n_bytes", "media")


FIELDS = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))


def load(images: DataFrame, media: str = "media") -> DataFrame:
    """The columns of images but the media, with digests and features of the decoded pixels."""
    names = [n for n, _ in FIELDS]
    keep = [c for c in images.columns if c.lower() not in (media.lower(), *names)]
    rows = images.select(F.struct(*(images[c] for c in keep)).alias("m_row"), images[media].alias("m_media"))
    out = T.StructType([rows.schema["m_row"], *(T.StructField(n, t) for n, t in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = webp_batch.Heads()
        for batch in batches:
            for part, _, _ in slices(batch, "m_media", SLICE):
                files = part.column("m_media").to_pylist()
                read = iter(webp_batch.unpack([f for f in files if f is not None], heads))
                found = []
                for f in files:
                    if f is None:
                        found.append((None,) * len(names))
                        continue
                    pixels, payload = next(read)
                    found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), feature(pixels)))
                columns = [pa.array([x[i] for x in found], pa.string() if isinstance(t, T.StringType) else pa.int64()) for i, (_, t) in enumerate(FIELDS)]
                yield pa.RecordBatch.from_arrays([part.column("m_row"), *columns], out.names)

    return rows.mapInArrow(run, out).select("m_row.*", *names)
