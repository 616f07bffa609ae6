"""Files as outputs: one for each document, whole or absent, packed if asked, and never written twice without need."""

import contextlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}


def file_system(uri: str):
    """A pyarrow file system and the path in it, for a URI of any scheme that pyarrow knows; a path without scheme is a local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextlib.contextmanager
def whole_file(uri: str):
    """A binary output that takes its name only when complete, so a lost or repeated task leaves no part of a file."""
    fs, path = file_system(uri)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with fs.open_output_stream(draft, compression=None) as out:
            yield out
        fs.move(draft, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(draft)
        raise


def exists(uri: str) -> bool:
    """Whether there is a file or folder of that name."""
    from pyarrow import fs as pyarrow_fs

    fs, path = file_system(uri)
    return fs.get_file_info(path).type != pyarrow_fs.FileType.NotFound


def names_below(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name), relative to path and without what packing adds, of the files below it: one listing, which Spark shares out."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], "name string")
    root = fs.makeQualified(jvm_path).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    bare = F.regexp_replace(F.expr(f"substring(path, {len(root) + 2})"), r"\.(gz|bz2)$", "")
    return found.select(bare.alias("name")).where(~F.col("name").endswith(".draft"))


def pending(rows: DataFrame, path: str, name: str = "name", pattern: str = "*") -> DataFrame:
    """The rows of whose file `name` below path there is none yet, packed or not; pattern: of the files' names."""
    there = names_below(rows.sparkSession, path, pattern).select(F.col("name").alias("_there"))
    return rows.join(there, F.col(name) == F.col("_there"), "left_anti")


# Runs that add to an output.  A run writes its tables in folders of their own, run=..., then a note that it is prepared,
# then files of documents, then that it is done.  What is found without a note has never been prepared and goes; what is
# prepared only needs its files, so whatever step a run ends at, the next one gives what a whole one gives.


def new_run() -> str:
    """A name for a run."""
    return f"r{uuid.uuid4().hex}"


def table_path(output: str, name: str, run: str) -> str:
    """Where a run writes a table; the folder above has those of all runs."""
    return f"{output}/{name}.parquet/run={run}"


def note(output: str, run: str, state: str, replaces: list[str] = (), clear: bool = False) -> None:
    """Say that a run is prepared, or done; replaces: the runs whose tables go when it is."""
    fs, there = file_system(f"{output}/_runs/{run}.json")
    fs.create_dir(there.rpartition("/")[0], recursive=True)
    with whole_file(f"{output}/_runs/{run}.json") as out:
        out.write(json.dumps({"state": state, "replaces": list(replaces), "clear": clear}).encode())


def notes(output: str) -> dict[str, dict]:
    """What is noted of each run."""
    from pyarrow import fs as pyarrow_fs

    fs, there = file_system(f"{output}/_runs")
    out = {}
    for info in fs.get_file_info(pyarrow_fs.FileSelector(there, allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as own:
                out[info.base_name.removesuffix(".json")] = json.loads(own.read())
    return out


def drop_runs(output: str, keep, tables: tuple) -> None:
    """Delete the tables of runs that keep(run) doesn't want."""
    from pyarrow import fs as pyarrow_fs

    for name in tables:
        fs, there = file_system(f"{output}/{name}.parquet")
        for info in fs.get_file_info(pyarrow_fs.FileSelector(there, allow_not_found=True)):
            run = info.base_name.removeprefix("run=")
            if info.base_name.startswith("run=") and not keep(run):
                fs.delete_dir(info.path)


#: Folders that many files are dealt to.
FOLDERS = 512


def dealt_name(name: Column) -> Column:
    """A file's name in one of FOLDERS folders, so that none has too many; see files.discover_wide."""
    return F.concat(F.lpad(F.pmod(F.xxhash64(name), F.lit(FOLDERS)).cast("string"), 3, "0"), F.lit("/"), name)


def write_files(rows: DataFrame, path: str, packed: str = "none", clear: bool = False, pattern: str = "*") -> int:
    """A file for each row (name, content) below path, and how many were written; a name may have folders in it.

    Files that are there already, packed or not, are left alone unless clear
    says otherwise.  Rows without name or content are passed over; of rows
    with one name some one is written.
    """
    todo = rows.where("name is not null and content is not null").select("name", "content")
    extension = PACKED[packed]

    def write(batches):
        import bz2
        import gzip

        import pyarrow as pa

        made = set()
        pack = {"none": bytes, "gzip": lambda x: gzip.compress(x, mtime=0), "bzip2": bz2.compress}[packed]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                target = f"{path}/{name.as_py()}{extension}"
                fs, there = file_system(target)
                if (folder := there.rpartition("/")[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with whole_file(target) as out:
                    out.write(pack(content.as_py().encode()))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    some = todo if clear else pending(todo, path, pattern=pattern)
    return some.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
