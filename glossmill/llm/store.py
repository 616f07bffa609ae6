"""The folder that driver and executors share, and tables and files in it."""

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import new_folder, shared_dir
from glossmill.sources.outputs import file_system, whole_file

__all__ = ["column", "drop", "file_system", "free", "lean", "mapped", "new_folder", "quoted", "shared_dir", "stage", "task_name", "tokenizer_path", "whole_file"]


def free(table: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes not to be a column of the table.

    This is the rule for all columns that operators add: a table's own columns keep their names and values.
    """
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as SQL and schemas take it, whatever is in it."""
    return f"`{name.replace('`', '``')}`"


def column(name: str) -> Column:
    """The column of just that name: a dot in it is no path."""
    return F.col(quoted(name))


def lean(function):
    """function, of batches, after whose last batch the process gives its free memory back: workers are used again, and would hold the most that any task took."""

    def run(batches):
        import ctypes
        from contextlib import suppress

        import pyarrow as pa

        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def mapped(rows: DataFrame, function, fields: list[tuple[str, str]]) -> DataFrame:
    """rows.mapInArrow(function) with fields (name, type), for columns of any name.

    The function sees batches under the columns' own names; Spark, which takes a dot for a path, sees numbers.
    """
    given, inner = rows.columns, [f"c{k}" for k in range(len(fields))]

    def renamed(batches):
        import pyarrow as pa

        for batch in function(pa.RecordBatch.from_arrays(b.columns, given) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inner)

    numbered = rows.toDF(*[f"c{k}" for k in range(len(given))])
    made = numbered.mapInArrow(lean(renamed), ", ".join(f"{name} {kind}" for name, (_, kind) in zip(inner, fields, strict=True)))
    return made.toDF(*[name for name, _ in fields])


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def task_name() -> str:
    """A name for this attempt at a partition of a stage: another attempt, whose rows may come in another order, writes files of its own."""
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId():x}"


def tokenizer_path() -> str:
    """The vocabulary file of byte_bpe_50k; TOKENIZER_FILE names another."""
    if named := os.environ.get("TOKENIZER_FILE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
