"""Light-curve archives as a Spark data source: partitions planned from file names, files outside the filters never opened."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from photospark.plans.lineage import pin
from photospark.schema import DAY_US

# Fixed value: archive file names, e.g. tic0000000022529346_s0001_raw.npz
FILE_NAME = r"tic(\d{1,16})_s(\d{1,4})_(\w+)\.npz$"

FORMAT = "series_archive"
ROWS = (
    "tic_id bigint, sector int, kind string, time_us bigint, time double, flux double, flux_err double, "
    "quality int, gap_mask boolean, error string"
)
_ARROW = pa.schema([
    ("tic_id", pa.int64()), ("sector", pa.int32()), ("kind", pa.string()), ("time_us", pa.int64()), ("time", pa.float64()), ("flux", pa.float64()),
    ("flux_err", pa.float64()), ("quality", pa.int32()), ("gap_mask", pa.bool_()), ("error", pa.string()),
])
#: Columns that a file name tells.
KEYS = ("tic_id", "sector", "kind")
#: Bytes of archives in a partition, and what opening a file counts for.
PARTITION_BYTES = 64 << 20
OPEN_BYTES = 1 << 20
#: Partitions of a read; with very many files they hold more bytes.
MAX_PARTITIONS = 4000
#: Rows of a batch.
BATCH_ROWS = 50_000
#: Arrays of an archive that hold cadences.
COLUMNS = ("time", "flux", "flux_err", "quality", "gap_mask")
_HEADERS: dict = {}
_LAYOUTS: dict = {}


def store_of(path: str):
    """(file system, folder in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def encode(**arrays: np.ndarray) -> bytes:
    """Arrays as a compressed archive, as ``numpy.savez_compressed`` writes it."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as file:
        for name, array in arrays.items():
            array = np.ascontiguousarray(array) if np.ndim(array) else np.asarray(array)
            shape = (array.dtype.str, array.shape)
            if shape not in _HEADERS:
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
                _HEADERS[shape] = head.getvalue()
            file.writestr(f"{name}.npy", _HEADERS[shape] + array.tobytes())
    return buffer.getvalue()


def _member(data: bytes) -> np.ndarray:
    """The array of an archive member; headers that were seen before are not parsed again."""
    start = 10 + int.from_bytes(data[8:10], "little")
    if data[:8] != b"\x93NUMPY\x01\x00" or len(data) < start:
        return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)
    head = data[10:start]
    if head not in _LAYOUTS:
        if len(_LAYOUTS) > 10_000:
            _LAYOUTS.clear()
        _LAYOUTS[head] = np.lib.format.read_array_header_1_0(io.BytesIO(data[8:start]))
    shape, fortran, kind = _LAYOUTS[head]
    if kind.hasobject or fortran:
        return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)
    return np.frombuffer(data, kind, int(np.prod(shape)), start).reshape(shape)


def decode(content: bytes | None) -> dict[str, np.ndarray | None]:
    """The cadences of an archive as columns."""
    if (content or b"")[:2] != b"PK":
        with np.load(io.BytesIO(content), allow_pickle=False) as data:  # tells what it is instead
            raise ValueError(f"no archive: {type(data).__name__}")
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        names = set(file.namelist())
        found = {name: _member(file.read(f"{name}.npy")) for name in COLUMNS if f"{name}.npy" in names}
    out = {name: np.asarray(found[name], float) for name in ("time", "flux", "flux_err")}
    for name, kind in (("quality", np.int64), ("gap_mask", bool)):
        out[name] = found[name].astype(kind) if name in found else None
    if any(column is not None and column.shape != (len(out["time"]),) for column in out.values()):
        raise ValueError("columns of an archive differ in length")
    return out


def told(error: Exception) -> str:
    """The text for an archive that cannot be decoded."""
    return f"{type(error).__name__}: {error}"[:200]


def _rows(part: list) -> pa.RecordBatch:
    """(tic_id, sector, kind, columns or error text) of some archives as ``ROWS``."""
    sizes = [1 if isinstance(columns, str) else len(columns["time"]) for *_, columns in part]
    none = [np.zeros(n, bool) for n in sizes]

    def keys(i: int, kind: pa.DataType) -> pa.Array:
        return pa.array([p[i] for p in part], kind).take(pa.array(np.repeat(np.arange(len(part)), sizes)))

    def joined(name: str, kind) -> tuple[np.ndarray, np.ndarray]:
        have = [not isinstance(p[3], str) and p[3][name] is not None for p in part]
        values = [p[3][name] if h else np.zeros(n, kind) for p, h, n in zip(part, have, sizes)]
        return np.concatenate(values), np.concatenate([z if h else ~z for z, h in zip(none, have)])

    time, missing = joined("time", float)
    valid = np.isfinite(time) & ~missing
    columns = [pa.array(np.round(np.where(valid, time, 0.0) * DAY_US).astype(np.int64), pa.int64(), mask=~valid)]
    for name in ("time", "flux", "flux_err"):
        values, missing = joined(name, float)
        columns.append(pa.array(values, pa.float64(), mask=missing | np.isnan(values)))
    for name, kind, plain in (("quality", pa.int32(), np.int64), ("gap_mask", pa.bool_(), bool)):
        values, missing = joined(name, plain)
        columns.append(pa.array(values, mask=missing).cast(kind))
    errors = pa.array([p[3] if isinstance(p[3], str) else None for p in part], pa.string()).take(pa.array(np.repeat(np.arange(len(part)), sizes)))
    return pa.RecordBatch.from_arrays([keys(0, pa.int64()), keys(1, pa.int32()), keys(2, pa.string()), *columns, errors], schema=_ARROW)


def batches(archives: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(tic_id, sector, kind, function that gives the content) as batches of ``ROWS``; a broken archive is one row."""
    part, n = [], 0
    for tic, sector, kind, content in archives:
        try:
            columns = decode(content())
        except Exception as error:  # noqa: BLE001 - a broken file is a row of its own, the others are read
            columns = told(error)
        part.append((tic, sector, kind, columns))
        n += 1 if isinstance(columns, str) else len(columns["time"])
        if n >= BATCH_ROWS or len(part) >= BATCH_ROWS:
            yield from pa.Table.from_batches([_rows(part)]).to_batches(max_chunksize=BATCH_ROWS)
            part, n = [], 0
    if part:
        yield from pa.Table.from_batches([_rows(part)]).to_batches(max_chunksize=BATCH_ROWS)


@dataclass
class Files(ds.InputPartition):
    """Archives of one partition: (path, tic_id, sector, kind)."""

    files: list = field(default_factory=list)


class Reader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if isinstance(f, (ds.IsNotNull, ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, key: dict) -> bool:
        """Whether a file name passes the filters on its parts."""
        def holds(f: ds.Filter) -> bool:
            have = key[f.attribute[0]]
            tests = {ds.IsNotNull: lambda v: True, ds.EqualTo: lambda v: have == v, ds.In: lambda v: have in v, ds.GreaterThan: lambda v: have > v,
                     ds.GreaterThanOrEqual: lambda v: have >= v, ds.LessThan: lambda v: have < v, ds.LessThanOrEqual: lambda v: have <= v}
            return tests[type(f)](getattr(f, "value", None))

        return all(map(holds, self.filters))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = store_of(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            name = re.search(FILE_NAME, info.base_name) if info.is_file else None
            if name and name.start() == 0:
                key = {"tic_id": int(name[1]), "sector": int(name[2]), "kind": name[3]}
                if self.wanted(key):
                    found.append((info.path, *key.values(), info.size or 0))
        limit = max(PARTITION_BYTES, sum(f[-1] + OPEN_BYTES for f in found) // MAX_PARTITIONS)
        parts, size = [], 0
        for *file, n in sorted(found, key=lambda f: f[1:4]):
            if not parts or size + n + OPEN_BYTES > limit:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append(tuple(file))
            size += n + OPEN_BYTES
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)

        def content(path: str) -> bytes:
            with store.open_input_stream(path) as file:
                return file.read()

        yield from batches((tic, sector, kind, lambda path=path: content(path)) for path, tic, sector, kind in partition.files)


class SeriesArchive(ds.DataSource):
    """``spark.read.format("series_archive").load(path)``: a row per cadence; filters on tic_id, sector and kind choose files by name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All archives under ``path`` as ``ROWS``; an archive that cannot be decoded is one row with ``error``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesArchive)
    return spark.read.format(FORMAT).load(path)


def write_archives(files: DataFrame, path: str) -> DataFrame:
    """Write ``files`` (tic_id, sector, kind, content) as archives under ``path``; returns the names and sizes.

    Names follow from the keys and a file is complete before it has its name,
    so a task that runs again writes the same files. Writes while it is built.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = store_of(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for tic, sector, kind, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                name = f"tic{tic:016d}_s{sector:04d}_{kind}.npz"
                part = f"{base}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{name}")
                names.append(name)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return pin(files.select("tic_id", "sector", "kind", "content").mapInArrow(write, "name string, bytes bigint"))
