"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles in NPY form, difference hashes.

A media row is decoded, kept losslessly as an NPY array, and described by a
thumbnail tile and its difference hash.  Bytes that are no image give an
array of null and a reason, never an error.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of the image that holds a text's bytes.
WIDTH = 64
#: Rows of an image that are summed at a time.
BAND = 8192
#: Bit fields of a 32-bit BMP whose bytes are blue, green, red.
PLAIN_FIELDS = bytes.fromhex("0000ff00" "00ff0000" "ff000000")


def decode(data: bytes):
    """The array of a Netpbm (P1 to P6) or uncompressed BMP image: (rows, columns) or (rows, columns, 3); 16-bit samples stay 16-bit.

    Bitmaps (P1, P4) are 0 or 1, 1 being black.  BMP colours come as red, green, blue; palettes are applied.
    Raises ValueError for anything else.
    """
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes):
    import re

    import numpy as np

    kind, at, header = int(data[1:2]), 2, []
    field = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")
    while len(header) < (2 if kind in (1, 4) else 3):
        m = field.match(data, at)
        if not m:
            raise ValueError("no Netpbm header")
        header.append(int(m[1]))
        at = m.end()
    width, height, top = *header[:2], header[2] if len(header) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("maximum sample value out of range")
    if not width or not height:
        raise ValueError("no samples")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = width * height * (3 if kind in (3, 6) else 1)
    if kind == 1:
        found = np.frombuffer(re.sub(rb"#[^\n\r]*|\s+", b"", data[at:])[:n], np.uint8) - ord("0")
    elif kind < 4:
        try:
            found = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
        except OverflowError:
            raise ValueError("sample over the maximum") from None
    elif kind == 4:
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, count=stride * height, offset=at + 1) if len(data) >= at + 1 + stride * height else np.zeros(0, np.uint8)
        if len(packed) < stride * height:
            raise ValueError("too few samples")
        return np.unpackbits(packed.reshape(height, stride), axis=1)[:, :width]
    else:
        sample = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(data) < at + 1 + n * sample.itemsize:
            raise ValueError("too few samples")
        found = np.frombuffer(data, sample, count=n, offset=at + 1).astype(sample.newbyteorder("="))
    if len(found) < n:
        raise ValueError("too few samples")
    if kind < 4 and (found.max() > top or found.min() < 0):
        raise ValueError("sample over the maximum")
    return found.astype(np.uint8 if top < 256 else np.uint16, copy=False).reshape(shape)


def _bmp(data: bytes):
    import struct

    import numpy as np

    if len(data) < 54:
        raise ValueError("BMP header cut short")
    start, head, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    fields = data[54:66] if packing == 3 else PLAIN_FIELDS
    if head < 40 or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or (packing, bits) not in [*((0, b) for b in (1, 4, 8, 24, 32)), (3, 32)] or fields != PLAIN_FIELDS:
        raise ValueError("BMP of a kind that isn't read")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if len(data) < start + stride * rows:
        raise ValueError("too few samples")
    lines = np.frombuffer(data, np.uint8, count=stride * rows, offset=start).reshape(rows, stride)
    lines = lines[::-1] if height > 0 else lines
    if bits >= 24:
        return np.ascontiguousarray(lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, count=4 * colours, offset=14 + head).reshape(-1, 4)[:, 2::-1]
    split = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)
    index = (split * (1 << np.arange(bits)[::-1])).sum(axis=2)[:, :width]
    if index.max() >= colours:
        raise ValueError("colour beyond the palette")
    return palette[index]


def encode_pgm(samples) -> bytes:
    """A raw PGM image of a two-dimensional array of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def area_resize(image, rows: int, columns: int):
    """The image as float64 means over equal areas, fractions of samples included, from one integral image.

    The integral image is made band by band; only the lines at edges of cells are kept.
    """
    import numpy as np

    height, width = image.shape[:2]

    def edges(n: int, cells: int):
        at = np.arange(cells + 1) * (n / cells)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (r, fr), (c, fc) = edges(height, rows), edges(width, columns)
    wanted = np.union1d(r, r + 1)
    sums, above = np.zeros((len(wanted), width + 1)), np.zeros(width)
    for at in range(0, height, BAND):
        band = image[at : at + BAND]
        band = np.cumsum(band.mean(axis=2) if band.ndim == 3 else band, axis=0, dtype=np.float64) + above
        above = band[-1].copy()
        inside = (wanted > at) & (wanted <= at + len(band))
        sums[inside, 1:] = np.cumsum(band[wanted[inside] - at - 1], axis=1)
    at = np.searchsorted(wanted, r)
    lines = sums[at] * (1 - fr)[:, None] + sums[at + 1] * fr[:, None]
    corners = lines[:, c] * (1 - fc) + lines[:, c + 1] * fc
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells / (height / rows * (width / columns))


def difference_hash(image) -> str:
    """16 hex digits: bit by bit, whether a cell of the 8 x 9 thumbnail is darker than its right neighbour."""
    import numpy as np

    small = np.rint(area_resize(image, 8, 9) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array) -> bytes:
    """The array as an NPY file."""
    import io

    import numpy as np

    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes):
    import io

    import numpy as np

    return np.load(io.BytesIO(data), allow_pickle=False)


def text_image(text: bytes | None) -> bytes:
    """A text's bytes, with zeros up to a positive multiple of WIDTH, as a PGM image."""
    import numpy as np

    data = text or b""
    rows = max(1, -(-len(data) // WIDTH))
    return encode_pgm(np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


def write_tiles(media: DataFrame, path: str, id_column: str, media_column: str, to_image=None, tile: int = 32) -> None:
    """Write (id, n_bytes, media, tile, dhash, error) as Parquet: the whole array and a tile x tile thumbnail, both NPY.

    to_image turns a media value into image bytes where it isn't one yet.
    Null or unreadable media give null arrays and the reason in `error`.
    Repeated rows all appear, null ids too; an empty table gives files without
    rows; other columns, whatever their names, are left out.
    """

    def tiles(batches):
        import numpy as np
        import pyarrow as pa

        names = ["id", "n_bytes", "media", "tile", "dhash", "error"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, rows = whole.slice(at, 64), []
                for value in batch.column(1).cast(pa.binary()):
                    data = value.as_py()
                    try:
                        if data is None and to_image is None:
                            raise ValueError("null")
                        array = decode(to_image(data) if to_image else data)
                        small = np.rint(area_resize(array, tile, tile)).astype(array.dtype)
                        rows.append((len(data or b""), npy(array), npy(small), difference_hash(array), None))
                    except ValueError as why:
                        rows.append((len(data or b""), None, None, None, str(why)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kind = dict(media.dtypes)[id_column]
    rows = media.select(F.col(id_column).alias("id"), F.col(media_column)).mapInArrow(tiles, f"id {kind}, n_bytes long, media binary, tile binary, dhash string, error string")
    rows.write.mode("overwrite").options(compression="zstd").parquet(path)


def describe(stored: DataFrame) -> DataFrame:
    """From tiles read back: id, n_bytes, payload and stored form digests, and the difference hash of the array as stored.

    A row for each stored one; where no array is stored all but id and n_bytes are null.
    """

    def digest(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for value in batch.column(2):
                if (data := value.as_py()) is None:
                    rows.append((None,) * 6)
                    continue
                array = from_npy(data)
                payload = array.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(array)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = dict(stored.dtypes)["id"]
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("id", "n_bytes", "media").mapInArrow(digest, schema)
