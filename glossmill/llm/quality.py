"""Quality rules for documents: counts of words, symbols and repeats, and bands of compression.

A text that zstandard shrinks too well repeats itself, one that it hardly
shrinks isn't language.  What is too much depends on the length, since a short
text has nothing to refer back to: so limits go by bytes, for the whole text
and for chunks of CHUNK bytes of it.  Chunks find what the whole hides: a long
text part of which is out of band.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Level of zstandard, and bytes of a chunk; the last chunk of a text may be shorter.
LEVEL, CHUNK = 3, 4096
#: (bytes from, least ratio, greatest ratio) of compressed to plain bytes.  Below 256 bytes the frame outweighs the text.
LIMITS = [(0, 0.0, 2.0), (256, 0.25, 1.0), (512, 0.22, 0.85), (1024, 0.2, 0.75), (4096, 0.18, 0.68), (65536, 0.12, 0.62)]
#: A text goes if chunks with more than this share of its bytes are out of their band.
SHARE = 0.25
#: Limits of the base rules: fewer words, or a larger percentage of them in repeated windows, fail.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, bytes_out long"
#: Bytes that aren't the first of a word's characters: white space, and all but the first byte of a character in UTF-8.
NOT_CHARACTERS = bytes([*range(0x09, 0x0E), 0x20, *range(0x80, 0xC0)])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a run of `window` words that is found twice or more."""
    import numpy as np

    count = len(words) - window + 1
    if count < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    runs = ids[:count]
    for k in range(1, window):  # a run's number and the next word's make the longer run's; numbers stay below the words'
        runs = np.unique(runs * len(known) + ids[k : k + count], return_inverse=True)[1]
    again = (np.bincount(runs) > 1)[runs]
    inside = np.zeros(len(words), bool)
    for k in range(window):
        inside[k : k + count] |= again
    return int(inside.sum())


def band(size: int, limits: list = LIMITS) -> tuple[float, float]:
    """The limits for a text of so many bytes."""
    return next((low, high) for least, low, high in reversed(limits) if size >= least)


def compression(data: bytes, packer, chunk: int = CHUNK, limits: list = LIMITS) -> tuple[float, int, bool]:
    """(ratio of the whole, bytes in chunks out of their band, whether the text is in its bands); an empty text has ratio 1."""
    out_of = lambda part, ratio: not band(len(part), limits)[0] <= ratio <= band(len(part), limits)[1]
    if not data:
        return 1.0, 0, True
    whole = len(packer.compress(data)) / len(data)
    parts = [data] if len(data) <= chunk else [data[at : at + chunk] for at in range(0, len(data), chunk)]
    lost = sum(len(part) for part in parts if out_of(part, whole if part is data else len(packer.compress(part)) / len(part)))
    return whole, lost, not out_of(data, whole) and lost <= SHARE * len(data)


def judged(data: bytes, packer, chunk: int = CHUNK, limits: list = LIMITS) -> tuple:
    """The values of COLUMNS for a text in UTF-8."""
    words = data.split()  # at ASCII white space
    lines = [line for line in data.split(b"\n") if not line.isspace() and line]
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    ratio, lost, inside = compression(data, packer, chunk, limits)
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    return len(words), len(data.translate(None, NOT_CHARACTERS)), symbols, len(lines) - len(set(lines)), repeats, failed, not failed and inside, len(data), round(ratio, 6), lost


def judge(docs: DataFrame, columns: list[str], text_column: str = "text", chunk: int = CHUNK, limits: list = LIMITS) -> DataFrame:
    """The named columns of docs and those of COLUMNS, for each row; added names follow store.free.

    Null texts are empty; they and texts without a word fail the base rules.
    Every row is judged by itself, so repeated rows get equal values; an empty
    table gives none.
    """
    names = [part.split(" ")[0] for part in COLUMNS.split(", ")]
    kinds = [part.split(" ")[1] for part in COLUMNS.split(", ")]
    own = docs.select(*[store.column(c) for c in columns])
    added = store.free(own, *names)
    text, *_ = store.free(own, "judged_text")

    def rows(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [judged(x.as_py() or b"", packer, chunk, limits) for x in batch.column(batch.num_columns - 1).cast(pa.binary())]
                extra = [pa.array(c, arrow[kind]) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], [*batch.schema.names[:-1], *added])

    texts = docs.select(*[store.column(c) for c in columns], store.column(text_column).alias(text))
    return store.mapped(texts, rows, [*own.dtypes, *zip(added, kinds, strict=True)])


def keep(docs: DataFrame, text_column: str = "text", chunk: int = CHUNK, limits: list = LIMITS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever these are called."""
    kept, *_ = store.free(docs, "kept")
    return judge(docs, docs.columns, text_column, chunk, limits).where(store.column(kept)).select(*map(store.column, docs.columns))
