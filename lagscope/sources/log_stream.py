"""A stored log as a stream: offsets, admission limits, one task per range.

A Python data source (``lagscope_log``) over the folders that
``log_files.append_log`` writes, a folder per (topic, partition). The stream's
offset is where every folder began and its next record's offset:

* where segments begin and end stands in their footers; the driver reads the
  footers of files it has not seen, and keeps one (from, to) pair a file;
* a trigger admits at most ``maxOffsetsPerTrigger`` offsets over all folders,
  shared in proportion to what waits in each, so a folder that holds a third of
  the log neither starves the others nor passes the limit;
* a micro-batch has one task per folder and ``maxOffsetsPerTask`` offsets. A
  task opens the files that overlap its range, skips row groups by their
  statistics and hands Arrow batches on, so no folder is one task and memory is
  a batch of rows;
* segments may land in any order: an offset that is missing holds its folder
  (``gaps=wait``) until the segment that has it lands. Of a compacted log,
  whose gaps never fill, ``gaps=skip`` passes over them.

The engine tells a reader the range of every batch that it plans, and after a
restart the last range of its checkpoint before it asks for a new one; the
reader goes on from there, so limits and ranges are exact over restarts, and a
batch that was planned but not finished is read again by the same range.

Defined results: an empty or missing folder gives no rows and no batch. A
folder begins at its lowest offset when it is first admitted, or at
``startingOffset``; what lands behind a folder's position later is not read.
Repeated offsets are read as often as they are stored within a range. Null keys
and empty topics are the null folder; other columns of the files are not read,
and a missing ``timestamp`` is null. A file without statistics of ``offset``
stops the stream with its name, and so does a folder whose admitted segments
were deleted before they were read (except with ``gaps=skip``)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Iterator, NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lagscope import schemas as S
from lagscope.operators.offsets import merge_bounds, offset_bounds
from lagscope.streaming.jobs import _run, publish

FORMAT = "lagscope_log"
OFFSETS_PER_TASK = 1_000_000
FOOTER_THREADS = 32
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class Segment(NamedTuple):
    """A file and its offsets, both ends included."""
    first: int
    last: int
    path: str


class LogRange(InputPartition):
    """Offsets ``start`` to before ``end`` of a folder, and the files that hold them."""

    def __init__(self, folder: str, start: int, end: int, paths: list[str]) -> None:
        self.folder, self.start, self.end, self.paths = folder, start, end, paths


def filesystem(root: str):
    """``(file system, path)`` of a local path or a URI."""
    from pyarrow.fs import FileSystem
    uri = "s3://" + root[len("s3a://"):] if root.startswith("s3a://") else root
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return FileSystem.from_uri(uri)


def folder_keys(folder: str) -> tuple[str | None, int | None]:
    """Topic and partition of a folder name as the Parquet writer makes it."""
    topic, partition = (unquote(part.split("=", 1)[1]) for part in folder.split("/"))
    return (None if topic == NULL_FOLDER else topic), (None if partition == NULL_FOLDER else int(partition))


def _offset_stats(row_group, path: str) -> tuple[int, int]:
    for i in range(row_group.num_columns):
        column = row_group.column(i)
        if column.path_in_schema == "offset":
            stats = column.statistics
            if stats is not None and stats.has_min_max:
                return stats.min, stats.max
    raise ValueError(f"no statistics of offset in {path}")


def segment_of(fs, path: str) -> Segment | None:
    """A file's segment from its footer; None where it has no rows."""
    import pyarrow.parquet as pq
    with fs.open_input_file(path) as f:
        meta = pq.read_metadata(f)
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    ends = [_offset_stats(g, path) for g in groups if g.num_rows]
    return Segment(min(a for a, _ in ends), max(b for _, b in ends), path) if ends else None


def reach(segments: list[Segment], start: int, skip_gaps: bool) -> int:
    """The offset up to which a folder can be read from ``start`` on."""
    end = start
    for s in sorted(segments):
        if s.first > end and not skip_gaps:
            break
        end = max(end, s.last + 1)
    return end


def admit(waiting: dict[str, int], limit: int | None) -> dict[str, int]:
    """How many of the waiting offsets of each folder enter: all, or ``limit``
    shared in proportion, what rounding leaves going to the largest remainders
    (ties: by folder name)."""
    total = sum(waiting.values())
    if limit is None or total <= limit:
        return waiting
    share = {k: limit * n // total for k, n in waiting.items()}
    by_rest = sorted(waiting, key=lambda k: (-(limit * waiting[k] % total), k))
    for k in by_rest[:limit - sum(share.values())]:
        share[k] += 1
    return share


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        limit = options.get("maxOffsetsPerTrigger")
        self.limit = None if limit is None else int(limit)
        self.per_task = int(options.get("maxOffsetsPerTask", OFFSETS_PER_TASK))
        first = options.get("startingOffset", "earliest")
        self.first = None if first == "earliest" else int(first)
        gaps = options.get("gaps", "wait")
        if gaps not in ("wait", "skip"):
            raise ValueError(f"gaps is wait or skip, not {gaps}")
        if self.per_task < 1 or (self.limit is not None and self.limit < 1):
            raise ValueError("limits are at least 1")
        self.skip_gaps = gaps == "skip"
        self.position: dict[str, list[int]] = {}   # folder -> [began at, next]
        self.known: dict[str, Segment | None] = {}

    # --- on the driver: file names and footers ---

    def segments(self) -> dict[str, list[Segment]]:
        """The segments there are, by folder; only footers of new files are read."""
        from pyarrow.fs import FileSelector, FileType
        fs, root = filesystem(self.root)
        base = root.rstrip("/")
        infos = fs.get_file_info(FileSelector(base, allow_not_found=True, recursive=True))
        paths = {}
        for info in infos:
            parts = info.path[len(base):].strip("/").split("/")
            if info.type == FileType.File and len(parts) == 3 and not any(p[0] in "_." for p in parts):
                paths[info.path] = "/".join(parts[:2])
        self.known = {p: s for p, s in self.known.items() if p in paths}
        new = [p for p in paths if p not in self.known]
        if new:
            with ThreadPoolExecutor(FOOTER_THREADS) as pool:
                self.known.update(zip(new, pool.map(lambda p: segment_of(fs, p), new)))
        out: dict[str, list[Segment]] = {}
        for path, folder in paths.items():
            if self.known[path] is not None:
                out.setdefault(folder, []).append(self.known[path])
        return out

    def _begin(self, folder: str, segments: list[Segment]) -> tuple[int, int]:
        """Where the folder began and where its next record stands."""
        if folder in self.position:
            return tuple(self.position[folder])
        first = min(s.first for s in segments) if self.first is None else self.first
        return first, first

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        segments = self.segments()
        begin = {k: self._begin(k, v) for k, v in segments.items()}
        waiting = {k: reach(v, begin[k][1], self.skip_gaps) - begin[k][1] for k, v in segments.items()}
        admitted = admit({k: n for k, n in waiting.items() if n > 0}, self.limit)
        moved = {k: [begin[k][0], begin[k][1] + n] for k, n in admitted.items() if n > 0}
        return dict(sorted({**self.position, **moved}.items()))

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        self.position = dict(end)
        ranges = {k: (start[k][1] if k in start else begin, stop) for k, (begin, stop) in end.items()}
        ranges = {k: r for k, r in ranges.items() if r[1] > r[0]}
        segments = self.segments() if ranges else {}
        out = []
        for folder, (begin, stop) in ranges.items():
            mine = sorted(s for s in segments.get(folder, []) if s.first < stop and s.last >= begin)
            if not self.skip_gaps and reach(mine, begin, False) < stop:
                raise ValueError(f"segments of {folder} are gone from offsets {begin} to {stop}, which were admitted")
            for lo in range(begin, stop, self.per_task):
                hi = min(stop, lo + self.per_task)
                paths = [s.path for s in mine if s.first < hi and s.last >= lo]
                if paths:
                    out.append(LogRange(folder, lo, hi, paths))
        return out

    # --- in tasks ---

    def read(self, partition: LogRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        fs, _ = filesystem(self.root)
        topic, number = folder_keys(partition.folder)
        schema = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()),
                            ("timestamp", pa.timestamp("us", "UTC"))])
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                file = pq.ParquetFile(f, coerce_int96_timestamp_unit="us")
                stats = {i: _offset_stats(file.metadata.row_group(i), path) for i in range(file.num_row_groups)
                         if file.metadata.row_group(i).num_rows}
                groups = [i for i, (a, b) in stats.items() if a < partition.end and b >= partition.start]
                columns = [c for c in ("offset", "timestamp") if c in file.schema_arrow.names]
                for batch in file.iter_batches(row_groups=groups, columns=columns):
                    offset = batch.column("offset")
                    batch = batch.filter(pc.and_(pc.greater_equal(offset, partition.start),
                                                 pc.less(offset, partition.end)))
                    n = batch.num_rows
                    if not n:
                        continue
                    at = batch.column("timestamp") if "timestamp" in columns else pa.nulls(n)
                    if pa.types.is_timestamp(at.type) and at.type.tz is None:
                        at = at.cast(pa.timestamp("us"), safe=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([topic] * n, pa.string()), pa.array([number] * n, pa.int32()),
                         batch.column("offset").cast(pa.int64()), at.cast(pa.timestamp("us", "UTC"), safe=False)],
                        schema=schema)


class LogStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return S.RECORDS

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def read_log_stream(spark: SparkSession, root: str, **options) -> DataFrame:
    """The stored log under ``root`` as a stream of records; options as above."""
    spark.dataSource.register(LogStreamSource)
    reader = spark.readStream.format(FORMAT)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(root)


def bounds_stream(records: DataFrame, out: str, ckpt: str):
    """Publishes the offset bounds of every micro-batch under ``out/batch_id=N``:
    a row per (topic, partition) that it touched. A replayed batch finds its
    folder and leaves it; ``published_bounds`` merges them."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        publish(offset_bounds(batch), out, batch_id)
    return _run(records.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt), available_now=False)


def published_bounds(spark: SparkSession, out: str) -> DataFrame:
    return merge_bounds(spark.read.schema(
        "topic string, partition int, oldest_offset bigint, newest_offset bigint").parquet(out))


def drain(query) -> None:
    """Run a stream until nothing waits, over as many triggers as its limit
    needs, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
