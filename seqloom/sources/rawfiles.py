"""Raw byte files: a committed sink and a byte-range source on Spark's Python data source API.

``write_raw`` appends the rows of a frame to plain files. Every task writes below a staging
folder of the job; only the attempt whose message reaches the driver is renamed into place, so
a retried or speculative task never leaves a second file, and a failed job leaves none. The
list of committed files (name, bytes) is written last, as ``_manifest.json``; a reader takes the
files it names, or without one the files it finds.

``read_u16`` reads fixed-length records (little-endian uint16) by byte ranges: a file is cut
into ranges of whole records that are dealt to tasks, so one large file is read in parallel.

The zeros of a row's ``pad`` are left out of local files as holes: the file has its full length and
every reader finds the zeros, but the disk holds only the ids (other file systems get them written).

Paths are opened through Arrow's file systems (local and mounted folders, and the schemes they
know); they must be reachable from driver and executors, like the checkpoint folder.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
RANGE_BYTES = 64 << 20
ROW_IDS = 1 << 16  # ids of one row that the range reader returns
U16 = 2
NULL_SPLIT = "__null__"  # folder of stream rows without a split


def open_fs(path: str):
    """Arrow file system and path inside it; ``file:/x`` and plain paths are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """``(name below path, bytes)`` of the committed files, or of the files found where no
    manifest is, in name order."""
    import json

    from pyarrow import fs

    system, root = open_fs(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            found = [(m["file"], m["bytes"]) for m in json.loads(f.read())]
    else:
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [(i.path[len(root) + 1:], i.size) for i in infos if i.type == fs.FileType.File]
        found = [(n, b) for n, b in found if not any(p.startswith(("_", ".")) for p in n.split("/"))]
    return sorted((n, b) for n, b in found if n.endswith(suffix))


class Committed(WriterCommitMessage):
    def __init__(self, files):
        self.files = files  # (name, staged path, bytes)


class RawWriter(DataSourceArrowWriter):
    """Rows ``file`` and ``data`` (bytes), or ``ids`` (an int array, written as uint16) with an optional
    ``pad`` (zero ids that follow). All rows of a file must be neighbours in one task."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _pieces(self, batch):
        import numpy as np
        import pyarrow.compute as pc

        names = batch.schema.names
        if "ids" not in names:
            yield from ((x or b"", 0) for x in batch.column("data").to_pylist())
            return
        lists = batch.column("ids")
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        flat = pc.list_flatten(lists)
        if flat.null_count:
            raise ValueError("an id is null")
        flat = flat.to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() > 65535):
            raise ValueError(f"id outside uint16: {int(flat.min() if flat.min() < 0 else flat.max())}")
        flat = flat.astype("<u2")
        pads = batch.column("pad").to_pylist() if "pad" in names else [0] * batch.num_rows
        for i, pad in enumerate(pads):
            yield flat[ends[i]:ends[i + 1]].tobytes(), U16 * (pad or 0)

    def write(self, iterator):
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = open_fs(self.path)
        stage = f"{root}/_staging-{self.job}/{TaskContext.get().taskAttemptId()}"
        done: dict[str, tuple[str, int]] = {}
        name, out, size = None, None, 0
        zeros = bytes(1 << 16)
        local = isinstance(system, fs.LocalFileSystem)

        def close():
            if out is not None:
                if local:
                    out.truncate(size)  # a hole at the end belongs to the file, too
                out.close()
                done[name] = (f"{stage}/{len(done):06d}", size)

        try:
            for batch in iterator:
                for target, (data, pad) in zip(batch.column("file").to_pylist(), self._pieces(batch)):
                    if target != name:
                        close()
                        out = None
                        if target in done:
                            raise ValueError(f"the rows of {target} are not neighbours")
                        system.create_dir(stage, recursive=True)
                        name, size = target, 0
                        at = f"{stage}/{len(done):06d}"
                        out = open(at, "wb") if local else system.open_output_stream(at)
                    out.write(data)
                    size += len(data) + pad
                    if local and pad > 0:
                        out.seek(size)
                    while pad > 0 and not local:
                        out.write(zeros[:pad])
                        pad -= min(pad, len(zeros))
            close()
            out = None
        finally:
            if out is not None:
                out.close()
        return Committed([(n, p, b) for n, (p, b) in done.items()])

    def commit(self, messages):
        import json

        from pyarrow import fs

        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        kept = [] if self.overwrite else list_files(self.path)
        names = [f[0] for f in files] + [n for n, _ in kept]
        if len(set(names)) < len(names):
            self.abort(messages)
            names.sort()
            raise ValueError(f"written twice: {[a for a, b in zip(names, names[1:]) if a == b][:5]}")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name != f"_staging-{self.job}":
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for name, staged, _ in files:
            system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            system.move(staged, f"{root}/{name}")
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([{"file": n, "bytes": b} for n, b in sorted(kept + [(n, b) for n, _, b in files])]).encode())
        self._clean(system, root)

    def abort(self, messages):
        self._clean(*open_fs(self.path))

    def _clean(self, system, root):
        from pyarrow import fs

        stage = f"{root}/_staging-{self.job}"
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges  # (file, begin, end)


def _joined(ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Ranges that follow each other in a file as one."""
    out: list[tuple[str, int, int]] = []
    for name, begin, end in ranges:
        if out and out[-1][0] == name and out[-1][2] == begin:
            begin = out.pop()[1]
        out.append((name, begin, end))
    return out


class U16Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, range_bytes: int, row_ids: int, tasks: int):
        self.path, self.suffix, self.row_ids, self.tasks = path, suffix, row_ids, tasks
        self.step = max(range_bytes // U16, 1) * U16  # ranges hold whole records

    def partitions(self):
        out = []
        for name, size in list_files(self.path, self.suffix):
            if size % U16:
                raise ValueError(f"{name}: {size} bytes are no whole number of records")
            out += [(name, at, min(at + self.step, size)) for at in range(0, size, self.step)]
        # many small ranges share a task: starting one takes longer than reading a range
        each = -(-len(out) // self.tasks) or 1
        return [Ranges(_joined(out[at:at + each])) for at in range(0, len(out), each)] or [Ranges([])]

    def read(self, partition):
        system, root = open_fs(self.path)
        for file, begin, end in partition.ranges:
            with system.open_input_file(f"{root}/{file}") as f:
                yield from self._rows(f, file, begin, end)

    def _rows(self, f, file, at, end):
        import numpy as np

        f.seek(at)
        while at < end:
            data = f.read(min(U16 * self.row_ids, end - at))
            if not data or len(data) % U16:
                raise ValueError(f"{file} ends inside a record")
            ids = pa.array(np.frombuffer(data, "<u2").astype("int32"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([at // U16], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["file", "first", "ids"])
            at += len(data)


class RawFiles(DataSource):
    """``format("seqloom_raw")``: see the module."""

    @classmethod
    def name(cls):
        return "seqloom_raw"

    def schema(self):
        return "file string, first long, ids array<int>"

    def reader(self, schema):
        o = self.options
        return U16Reader(o["path"], o.get("suffix", ""), int(o.get("range_bytes", RANGE_BYTES)), int(o.get("row_ids", ROW_IDS)),
                         int(o.get("tasks", 1 << 30)))

    def writer(self, schema, overwrite):
        return RawWriter(self.options["path"], overwrite)


def write_raw(df: DataFrame, path: str, mode: str = "overwrite") -> list[tuple[str, int]]:
    """Write the rows of ``df`` (``file`` with ``data``, or with ``ids`` and ``pad``) in their order to the
    files they name, each by one task. Returns the committed ``(file, bytes)``."""
    df.sparkSession.dataSource.register(RawFiles)
    df.write.format(RawFiles.name()).mode(mode).option("path", path).save()
    return list_files(path)


def read_u16(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES, row_ids: int = ROW_IDS) -> DataFrame:
    """``(file, first, ids)``: the uint16 ids of every file, ``first`` counted in ids from the file's begin.

    Neighbouring ranges share a task where there are more than eight a core."""
    spark.dataSource.register(RawFiles)
    tasks = 8 * spark.sparkContext.defaultParallelism
    return (spark.read.format(RawFiles.name()).option("path", path).option("suffix", suffix)
            .option("range_bytes", range_bytes).option("row_ids", row_ids).option("tasks", tasks).load())


def map_u16(spark: SparkSession, path: str, each, schema, suffix: str = "", range_bytes: int = RANGE_BYTES, row_ids: int = ROW_IDS) -> DataFrame:
    """``each(batches)`` of what ``read_u16`` gives, a task's batches at a time, called where the bytes are read: the ids
    need not travel to be summed up."""
    reader = U16Reader(path, suffix, range_bytes, row_ids, 8 * spark.sparkContext.defaultParallelism)
    parts = reader.partitions()

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from each(reader.read(parts[i]))

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, schema)
