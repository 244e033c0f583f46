"""Media columns: texts stored in baseline JPEG files, read back, with thumbnail hashes.

The payload's bytes are the quantised coefficients of the image's blocks (the byte
less 128 for the DC coefficient, the byte itself for the others), which entropy coding
keeps without loss; a DCT of samples would not.

Cases: null and empty texts are one block of zeros; equal texts give equal files; long
texts are coded in groups of blocks; an empty table gives no rows; only the id and the
text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from engramix.llm import jpeg
from engramix.llm.common import arrow_schema, chunks, id_type, lean, record_batch, text_frame


def payload(text: bytes) -> np.ndarray:
    """The text with zeros up to a positive multiple of 64, as blocks."""
    return np.frombuffer(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0"), np.uint8).reshape(-1, 64)


def stored(texts: list[bytes]) -> list[bytes]:
    return jpeg.encode([payload(t) for t in texts])


def features(files: list[bytes]) -> Iterator[tuple[bytes, int, int, np.ndarray]]:
    """(payload, width, height, thumbnail) read from each file."""
    for image, coefficients in jpeg.decode(files):
        own = coefficients[: image.payload_blocks]
        data = own.astype(np.uint8)
        data[:, 0] = own[:, 0] + 128
        yield data.tobytes(), image.width, image.height, jpeg.thumbnail(image, coefficients)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """doc_id, sizes and digests of payload and file, width, height, thumbnail hash; ``with_media`` adds the file and the thumbnail."""
    fields = [T.StructField("doc_id", id_type(docs, id_col))] + [T.StructField(n, t) for n, t in (
        ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()),
    )]
    schema = T.StructType(fields + [T.StructField("media", T.BinaryType()), T.StructField("thumbnail", T.BinaryType())] * with_media)
    out = arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 1 << 20):
            files = stored(texts)
            rows: list[list] = [[] for _ in range(9 + 2 * with_media)]
            for text, file, (data, width, height, thumb) in zip(texts, files, features(files), strict=True):
                row = [len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"{width}x{height}:{jpeg.thumbnail_hash(thumb)}", width, height]
                for column, x in zip(rows, row + [file, thumb.tobytes()] * with_media, strict=True):
                    column.append(x)
            yield record_batch(out, ids, *rows)

    return text_frame(docs, id_col, text_col).mapInArrow(lean(kernel), schema)
