"""Arrow IPC files, which Spark has no reader for, as a Python data source with partitions and pushed filters.

``register(spark)`` makes ``spark.read.format("arrow_files")`` and the writer of that name known; ``open_source`` does so
itself for sources of type ``arrow``. Paths are those pyarrow reaches: local or mounted folders, ``hdfs``, ``s3``, ``gs``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

NAME = "arrow_files"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of a file that one task reads, and the list of files that a finished write names.
SLICE_BYTES = 128 << 20
COMMITTED = "_committed"


def _source():
    """The data source's class, made here so that it is sent to the workers by value."""
    import math
    import uuid

    from pyspark.sql import datasource as D
    from pyspark.sql import types as T

    committed, name = COMMITTED, NAME

    def store(path):
        from pyarrow import fs

        plain = path[5:] if path.startswith("file:") else path
        if "://" in path and not path.startswith("file:"):
            return fs.FileSystem.from_uri(path)
        return fs.LocalFileSystem(), "/" + plain.lstrip("/") if plain.startswith("/") else plain

    def files(path):
        """(file, bytes): those a finished write names, else all of the folder's Arrow files; a single file is itself."""
        from pyarrow import fs

        system, root = store(path)
        whole = system.get_file_info(root)
        if whole.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if whole.is_file:
            return [(root, whole.size)]
        every = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root)) if f.extension == "arrow")
        if system.get_file_info(f"{root}/{committed}").type == fs.FileType.NotFound:
            return every
        with system.open_input_stream(f"{root}/{committed}") as f:
            named = set(f.read().decode().split("\n"))
        return [(p, size) for p, size in every if p.rsplit("/", 1)[-1] in named]

    class Slice(D.InputPartition):
        def __init__(self, file, turn, of):
            self.file, self.turn, self.of = file, turn, of

    class Reader(D.DataSourceReader):
        """Tasks read every ``of``-th share of a file's record batches; the driver lists files and opens none."""

        exact = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType, T.DateType, T.TimestampNTZType, T.BooleanType)
        signs = {D.EqualTo: "==", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}

        def __init__(self, path, schema, slice_bytes):
            self.path, self.schema, self.slice_bytes, self.wanted = path, schema, slice_bytes, []

        def pushFilters(self, filters):
            """Comparisons on whole numbers, text, dates and times without zone are applied here; Spark keeps the others,
            among them all on floating numbers, whose NaN Arrow compares otherwise."""
            for f in filters:
                column = ".".join(getattr(f, "attribute", ()))
                known = column in self.schema.names and isinstance(self.schema[column].dataType, self.exact)
                if known and type(f) in self.signs:
                    self.wanted.append((self.signs[type(f)], column, f.value))
                elif known and isinstance(f, D.IsNotNull):
                    self.wanted.append(("known", column, None))
                else:
                    yield f

        def partitions(self):
            found = []
            for file, size in files(self.path):
                of = max(1, math.ceil(size / self.slice_bytes))
                found += [Slice(file, turn, of) for turn in range(of)]
            return found or [Slice(None, 0, 1)]

        def read(self, part):
            import operator

            import pyarrow as pa
            import pyarrow.compute as pc
            from pyspark.sql.pandas.types import to_arrow_schema

            if part.file is None:
                return
            signs = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
            target = to_arrow_schema(self.schema)
            test = None
            for sign, column, value in self.wanted:
                held = pc.field(column)
                one = held.is_valid() if sign == "known" else signs[sign](held, pa.scalar(value, target.field(column).type))
                test = one if test is None else test & one
            system, _ = store(self.path)
            with system.open_input_file(part.file) as f:
                batches = pa.ipc.open_file(f)
                n = batches.num_record_batches
                for i in range(part.turn * n // part.of, (part.turn + 1) * n // part.of):
                    rows = pa.Table.from_batches([batches.get_batch(i)]).select(target.names).cast(target)
                    yield from (rows.filter(test) if test is not None else rows).to_batches()

    class Named(D.WriterCommitMessage):
        def __init__(self, file):
            self.file = file

    class Writer(D.DataSourceArrowWriter):
        """Every task writes a file of its own name; the list of files appears when all are there, so what a lost or
        repeated task left is never read."""

        def __init__(self, path, schema, overwrite):
            self.path, self.schema, self.overwrite, self.before = path, schema, overwrite, []
            if not overwrite:
                try:
                    self.before = [p.rsplit("/", 1)[-1] for p, _ in files(path)]
                except FileNotFoundError:
                    pass

        def write(self, iterator):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            system, root = store(self.path)
            system.create_dir(root)
            target, file = to_arrow_schema(self.schema), f"part-{uuid.uuid4().hex}.arrow"
            with system.open_output_stream(f"{root}/{file}") as out, pa.ipc.new_file(out, target) as sink:
                for batch in iterator:
                    sink.write_table(pa.Table.from_batches([batch]).cast(target))
            return Named(file)

        def commit(self, messages):
            system, root = store(self.path)
            system.create_dir(root)
            listed = [*self.before, *(m.file for m in messages if m is not None)]
            # Moved into place in one step.
            fresh = f"{root}/_fresh-{uuid.uuid4().hex}"
            with system.open_output_stream(fresh) as out:
                out.write("\n".join(listed).encode())
            system.move(fresh, f"{root}/{committed}")

        def abort(self, messages):
            """Files of a failed write are in no list; they stay unread."""

    class ArrowFiles(D.DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            import pyarrow as pa
            from pyspark.sql.pandas.types import from_arrow_schema

            found = files(self.options["path"])
            if not found:
                raise ValueError(f"no Arrow file in {self.options['path']}; give a schema")
            system, _ = store(self.options["path"])
            with system.open_input_file(found[0][0]) as f:
                return from_arrow_schema(pa.ipc.open_file(f).schema, prefer_timestamp_ntz=True)

        def reader(self, schema):
            return Reader(self.options["path"], schema, int(self.options.get("sliceBytes", SLICE)))

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], schema, overwrite)

    SLICE = SLICE_BYTES
    return ArrowFiles


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let it take filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(_source())


def read_arrow(spark: SparkSession, options: Mapping) -> DataFrame:
    """``path``, ``schema`` (DDL or StructType, else that of the first file), ``slice_bytes``."""
    register(spark)
    reader = spark.read.format(NAME).option("path", options["path"]).option("sliceBytes", options.get("slice_bytes", SLICE_BYTES))
    return (reader.schema(options["schema"]) if options.get("schema") else reader).load()


def write_arrow(df: DataFrame, path: str, replace: bool = False) -> None:
    """The rows as Arrow files, one a task, added to those of ``path`` or read instead of them."""
    register(df.sparkSession)
    df.write.format(NAME).mode("overwrite" if replace else "append").option("path", path).save()
