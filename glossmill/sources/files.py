"""Files as rows: discovery, manifests, decompression by extension, plain text, lists."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions import strings
from glossmill.session import dealt

def discover(spark: SparkSession, path: str, pattern: str = "*", recurse: bool = False, expression: str | None = None) -> DataFrame:
    """(path, content) of the files below path whose names fit the glob pattern, and the regular expression if there is one."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recurse or not set(path) & set("*?[{"):  # without a guess at columns in the names of folders
        found = reader.option("recursiveFileLookup", "true").load(path).select("path", "content")
    else:
        found = reader.load(path).select("path", "content")
    if not recurse and not set(path) & set("*?[{"):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        root = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()
        found = found.where((F.col("path") == root) | (F.regexp_replace("path", "/[^/]*$", "") == root))
    return found.where(F.substring_index("path", "/", -1).rlike(expression)) if expression else found


#: Files, or bytes of files, that a worker reads before it gives them away.
READ_FILES, READ_BYTES = 256, 1 << 22


def discover_wide(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files in the folders right below path, for more files than the driver should know of.

    The driver lists these folders alone; each is a row, and executors list the files in it and read them one after the other.
    """
    from glossmill.sources.outputs import file_system

    def read(batches):
        from fnmatch import fnmatch

        import pyarrow as pa
        from pyarrow import fs as pyarrow_fs

        def given(found):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], ["path", "content"])

        found, held = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                fs, there = file_system(folder)
                for info in fs.get_file_info(pyarrow_fs.FileSelector(there)):
                    if info.type != pyarrow_fs.FileType.File or not fnmatch(info.base_name, pattern):
                        continue
                    with fs.open_input_stream(info.path, compression=None) as own:
                        found.append((f"{folder}/{info.base_name}", own.read()))
                    held += info.size
                    if len(found) >= READ_FILES or held >= READ_BYTES:
                        yield given(found)
                        found, held = [], 0
        yield given(found)

    from pyarrow import fs as pyarrow_fs

    fs, there = file_system(path)
    below = [(f"{path}/{info.base_name}",) for info in fs.get_file_info(pyarrow_fs.FileSelector(there)) if info.type == pyarrow_fs.FileType.Directory]
    rows = spark.createDataFrame(below, "folder string").repartition(max(1, min(len(below), 4 * spark.sparkContext.defaultParallelism)))
    return rows.mapInArrow(read, "path string, content binary")


def labelled(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Discovered files that a manifest names, with their labels; a manifest's file is told by its name or by the end of its path."""
    name = F.substring_index("file", "/", -1).alias("_name")
    named = listed.select("file", "label", name)
    at = F.substring_index("path", "/", -1)
    return found.join(named, (at == F.col("_name")) & (F.col("path").endswith(F.concat(F.lit("/"), F.col("file"))) | (F.col("file") == F.col("_name")) | (F.col("path") == F.col("file")) | (F.regexp_replace("path", "^[a-z]+:/*", "/") == F.col("file")))).drop("_name", "file")


def manifest(lines: DataFrame) -> DataFrame:
    """(file, label) from (value) lines `file <tab> label`; blank lines and # comments are passed over, others with a wrong number of fields raise."""
    rows = lines.where("trim(value) <> '' and value not like '#%'").select(F.split("value", "\t").alias("f"))
    bad = F.raise_error(F.concat(F.lit("manifest line without two fields: "), F.array_join("f", " ")))
    label = F.when(F.size("f") == 2, F.regexp_replace(F.col("f")[1], "/*$", "/")).otherwise(bad)
    return rows.select(F.col("f")[0].alias("file"), label.alias("label"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, lines numbered from 0 in their order, in as many tasks as the file has blocks; of several files one after the other, by path."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row for each block
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return rows.join(bases, ["file", "block"]).select((F.col("at") + F.col("base")).alias("line_no"), "value")


def unpack(name: str, content: bytes) -> bytes:
    """The content of a file, unpacked as its name says."""
    import bz2
    import gzip

    return gzip.decompress(content) if name.endswith(".gz") else bz2.decompress(content) if name.endswith(".bz2") else content


def parsed(files: DataFrame, parser, schema: str, columns: list[str] | None = None) -> DataFrame:
    """parser(name, bytes) gives dicts, or tuples in the schema's order, for each file of (path, content); files that can't be read give one row with only path and error.

    The result has schema, or only these columns of it, path and error.  Only parsing is Python; a file is a row, so a task holds one tree at a time, and rows of small files leave it some thousands at a time.
    """

    from pyspark.sql.pandas.types import to_arrow_schema

    whole = [field.split()[0].strip("`") for field in split_schema(schema)]
    schema = ",".join(f for f, name in zip(split_schema(schema), whole, strict=True) if not columns or name in columns)
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    spots = [whole.index(name) for name in kinds.names]

    def rows(batches):
        import gc
        from itertools import accumulate, chain

        import pyarrow as pa

        text = pa.string()
        nothing = (None,) * len(whole)

        def tuples(made) -> list[tuple]:
            made = list(made)
            return [tuple(map(row.get, whole)) for row in made] if made and isinstance(made[0], dict) else made

        def column(own, kind):
            if not (pa.types.is_map(kind) or pa.types.is_list(kind)):
                return pa.array(own, kind)
            if None in own:
                return pa.array([None if x is None else list(x.items()) for x in own] if pa.types.is_map(kind) else own, kind)
            if pa.types.is_map(kind):
                offsets = pa.array(accumulate(map(len, own), initial=0), pa.int32())
                keys, items = (pa.array(list(chain.from_iterable(x)), t) for x, t in ((own, kind.key_type), ([x.values() for x in own if x], kind.item_type)))
                return pa.MapArray.from_arrays(offsets, keys, items).cast(kind)
            at, each = {}, []  # rows often share a list, as children of a node do its path
            for x in own:
                if id(x) not in at:
                    at[id(x)] = len(at)
                    each.append(x)
            if len(each) == len(own):
                return pa.array(own, kind)
            return pa.array(each, kind).take(pa.array([at[i] for i in map(id, own)], pa.int32()))

        def batches_of(read):
            """Batches of some 5000 rows of files (path, rows, error)."""
            made, where, why = ([x for _, own, _ in read for x in own], [p for p, own, _ in read for _ in own], [e for _, own, e in read for _ in own])
            for at in range(0, len(made), 5000):
                part = slice(at, at + 5000)
                owns = list(zip(*made[part], strict=True))
                yield pa.RecordBatch.from_arrays([*[column(owns[k], f.type) for k, f in zip(spots, kinds, strict=True)], pa.array(where[part], text), pa.array(why[part], text)], [*kinds.names, "path_", "error"])

        def given(read):
            """Batches of files; where their rows don't fit the schema, of each file by itself, with its error."""
            try:
                return list(batches_of(read))
            except Exception as error:  # noqa: BLE001
                if len(read) > 1:
                    return [b for one in read for b in given([one])]
                return list(batches_of([(read[0][0], [nothing], f"{type(error).__name__}: {error}")]))

        waiting, n = [], 0
        gc.disable()  # rows live until they are given away; what a parser leaves in cycles is collected then
        try:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    try:
                        own, error = tuples(parser(path, unpack(path, content.as_py()))), None
                    except Exception as why:  # noqa: BLE001  one broken file must not stop the others
                        own, error = [nothing], f"{type(why).__name__}: {why}"
                    waiting.append((path, own, error))
                    n += len(own)
                    if n >= 5000:
                        del own
                        yield from given(waiting)
                        waiting, n = [], 0
                        gc.collect(1)
            yield from given(waiting)
        finally:
            gc.enable()

    return dealt(files.select("path", "content")).mapInArrow(rows, f"{schema}, path_ string, error string")


def split_schema(schema: str) -> list[str]:
    """The fields of a DDL schema, commas inside <> left alone."""
    parts, depth, own = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(own)
            own = ""
        else:
            own += c
    return [*parts, own]


def good(rows: DataFrame) -> DataFrame:
    """The rows of files that could be read."""
    return rows.where("error is null").drop("path_", "error")


def quarantine(rows: DataFrame) -> DataFrame:
    """(path, error) of files that could not be read."""
    return rows.where("error is not null").select(F.col("path_").alias("path"), "error")


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text", hyphens: str = strings.HYPHENS) -> DataFrame:
    """(doc_id, par, word_no, word, hyphen, br) of plain text: blank lines end paragraphs, white space ends words.

    A hyphen at a word's end is parted from it; the last word of a line has
    br unless it lost a hyphen or ends its paragraph.  A line of one
    zero-width non-joiner is blank.
    """
    word = lambda w, i, n: F.struct(w.alias("raw"), (i == n - 1).alias("ends"))
    of_line = lambda line: strings.let(strings.words(line), lambda ws: F.transform(ws, lambda w, i: word(w, i, F.size(ws))))
    made = _paragraphs(docs, doc, text).select("doc_id", "par", F.flatten(F.transform(F.split("lines", "\n"), of_line)).alias("ws"))
    words = made.select("doc_id", "par", F.size("ws").alias("n"), F.posexplode("ws").alias("word_no", "w"))
    parts = words.select("doc_id", "par", "word_no", "n", "w.ends", strings.without_final_hyphen(F.col("w.raw"), hyphens).alias("h"))
    br = F.col("ends") & F.col("h.hyphen").isNull() & (F.col("word_no") < F.col("n") - 1)
    return parts.select("doc_id", "par", "word_no", F.col("h.stem").alias("word"), F.col("h.hyphen").alias("hyphen"), br.alias("br"))


def _paragraphs(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, par, lines): the lines of each paragraph of a text, cut within its row; blank lines part them."""
    blank = lambda line: F.trim(F.regexp_replace(line, r"[\u200c\s]+", " ")) == ""
    bare = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(blank(line), "").otherwise(line)), "\n")
    some = docs.select(F.col(doc).alias("doc_id"), F.regexp_replace(bare, r"^\n+|\n+$", "").alias("bare")).where("bare <> ''")
    return some.select("doc_id", F.posexplode(F.split("bare", r"\n{2,}")).alias("par", "lines"))


def paragraph_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", hyphens: str = strings.HYPHENS) -> DataFrame:
    """(doc_id, par, text): paragraph_text(paragraphs(...)) of texts that are a row each, without a shuffle."""
    end = lambda w: strings.let(strings.without_final_hyphen(w, hyphens), lambda h: F.when(h["hyphen"].isNotNull(), h["stem"]).otherwise(F.concat(h["stem"], F.lit(" "))))
    return _paragraphs(docs, doc, text).select("doc_id", "par", F.rtrim(F.array_join(F.transform(strings.words(F.col("lines")), end), "")).alias("text"))


def paragraph_text(words: DataFrame) -> DataFrame:
    """(doc_id, par, text): paragraphs of paragraphs(), words that were broken at a line's end put together."""
    gathered = words.groupBy("doc_id", "par").agg(F.array_sort(F.collect_list(F.struct("word_no", F.when(F.col("hyphen").isNotNull(), F.col("word")).otherwise(F.concat("word", F.lit(" "))).alias("w")))).alias("ws"))
    return gathered.select("doc_id", "par", F.rtrim(F.array_join("ws.w", "")).alias("text"))


def frequency_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, gram, cnt) of tab-separated lists of two or four columns; other lines are passed over."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", "\t").alias("f")).where("size(f) in (2, 4)")
    return rows.select("file", F.col("f")[0].alias("gram"), F.col("f")[1].try_cast("long").alias("cnt")).where("cnt is not null")


def write_list(freq: DataFrame, path: str, columns: tuple = ("gram", "cnt"), by: tuple = ("lang", "n"), compression: str = "none") -> None:
    """A ranked list (… rnk) as tab-separated text, in a folder for each value of `by`; numbers have six significant digits at most."""
    shown = [F.regexp_replace(F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+$", "$1"), r"\.$", "") if dict(freq.dtypes)[c] == "double" else F.col(c).cast("string") for c in columns]
    ordered = freq.repartitionByRange(*by, "rnk").sortWithinPartitions(*by, "rnk")
    ordered.select(*by, F.concat_ws("\t", *shown).alias("value")).write.mode("overwrite").option("compression", compression).partitionBy(*by).text(path)


def write_table(rows: DataFrame, path: str, order: list, header: bool = False, footer: DataFrame | None = None, compression: str = "none", by: tuple = ()) -> None:
    """Rows as tab-separated text in order, with the columns' names first and the rows of `footer` below if asked; one sorted list over several files, in a folder for each value of `by`."""

    def put(some: DataFrame, at: str, keys: list) -> None:
        shown = F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in some.columns if c not in by]).alias("value")
        ordered = some.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys) if by else some.orderBy(*keys)
        out = ordered.select(*by, shown).write.mode("overwrite").option("compression", compression)
        (out.partitionBy(*by) if by else out).text(at)

    put(rows, path, order)
    if header:
        names = "\t".join(c for c in rows.columns if c not in by)
        rows.sparkSession.createDataFrame([(names,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.header")
    if footer is not None:
        put(footer, f"{path}.footer", ["lang"])


def write_texts(texts: DataFrame, path: str, packed: str = "none", clear: bool = False) -> int:
    """A text file for each document (doc_id, text) that has text; see outputs.write_files."""
    from glossmill.sources import outputs

    rows = texts.where("text <> ''").select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.concat("text", F.lit("\n")).alias("content"))
    return outputs.write_files(rows, path, packed, clear)
