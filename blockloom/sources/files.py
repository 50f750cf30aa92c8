"""Files in and out: binary scans, byte-range block scan as a data source, and a committing file sink."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blockloom.functions import bits
from blockloom.functions import expressions as E


def granule(mode: str, level: int = 9) -> int:
    """Bytes to a read: whole blocks' worth to compress, fixed sizes otherwise."""
    return {"compress": level * 100_000, "expand": 256 * 1024, "small": 32 * 1024, "copy": 64 * 1024}[mode]


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_id, length, content) of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file_id"), "length", "content")


def operands(manifest: DataFrame, mode: str = "compress", force: bool = False, keep: bool = False) -> DataFrame:
    """Adds skip: why an operand is left out, null where it is not.

    manifest has name, regular (boolean) and links (count). Force overrides the checks of
    kind and links, but not that of the name.
    """
    reasons = []
    if not force:
        reasons.append(F.when(~F.col("regular"), "not a regular file"))
        if not keep:
            reasons.append(F.when(F.col("links") > 1, "more than one links"))
    if mode == "compress":
        reasons.append(F.when(E.is_compressed_name(F.col("name")), "compressed suffix"))
    return manifest.withColumn("skip", F.coalesce(*reasons, F.lit(None).cast("string")))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", 64 << 20))

    def partitions(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [_Range(f.path, at, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")) for at in range(0, f.size, self.chunk)]

    def read(self, partition):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.path) as f:
            data = f.read_at(min(self.chunk + 6, partition.size - partition.start), partition.start)
        for kind, magic in (("block", bits.BLOCK_MAGIC), ("end", bits.END_MAGIC)):
            for at in bits.find_magics(data, magic):
                if at < 8 * self.chunk:
                    yield partition.path, 8 * partition.start + at, kind


class BlockSource(DataSource):
    """format("bz2blocks"): (file_id, bit_off, kind) of all magics below a path, a task per byte range."""

    @classmethod
    def name(cls):
        return "bz2blocks"

    def schema(self):
        return "file_id string, bit_off bigint, kind string"

    def reader(self, schema):
        return _BlockReader(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        names = []
        try:
            for row in rows:
                names.append((f"{root}/.{uuid.uuid4().hex}", f"{root}/{quote(row['name'], safe=' ')}"))  # distinct names stay distinct
                with files.open_output_stream(names[-1][0]) as out:
                    out.write(bytes(row["content"]))
        except BaseException:  # a task that fails sends no message, so abort() would not know its files
            for temporary, _ in names:
                if files.get_file_info(temporary).type != fs.FileType.NotFound:
                    files.delete_file(temporary)
            raise
        return _Written(names)

    def commit(self, messages):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for temporary, name in m.names if m else []:
                if not self.overwrite and files.get_file_info(name).type != fs.FileType.NotFound:
                    files.delete_file(temporary)
                    raise FileExistsError(name)
                files.move(temporary, name)

    def abort(self, messages):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for temporary, _name in m.names if m else []:
                files.delete_file(temporary)


class FileSink(DataSource):
    """format("bz2files"): writes (name, content) as files; they get their names when all have been written."""

    @classmethod
    def name(cls):
        return "bz2files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the data sources and the table functions known to the session."""
    from pyspark.sql.functions import udtf

    from blockloom.functions import codec

    spark.dataSource.register(BlockSource)
    spark.dataSource.register(FileSink)

    class Headers:
        def eval(self, content):
            _, streams = codec.walk(bytes(content or b""))
            for i, s in enumerate(streams):
                for j, b in enumerate(s.blocks):
                    yield i, j, b.bit_off, b.end_bit, s.level, b.stored_crc, b.n_used, b.n_trees, b.n_selectors, b.status

    class Magics:
        def eval(self, content):
            for kind, magic in (("block", bits.BLOCK_MAGIC), ("end", bits.END_MAGIC)):
                for at in bits.find_magics(bytes(content or b""), magic):
                    yield at, kind

    spark.udtf.register("bz_headers", udtf(Headers, returnType="stream_no int, block_no int, bit_off bigint, end_bit bigint, level int, stored_crc bigint, n_used int, n_trees int, n_selectors int, status int"))
    spark.udtf.register("bz_blocks", udtf(Magics, returnType="bit_off bigint, kind string"))
