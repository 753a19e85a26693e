"""Point records of LAS files as a Python data source, read in record ranges.

Columns that aren't wanted aren't decoded, a window on x and y is applied before other fields are touched, and a stride skips records
without reading their fields. Comparisons of x, y and point_index with constants in a query's filters reach the reader, which skips
whole partitions by point_index. Options: path, columns (comma-separated), step, x_min, x_max, y_min, y_max, partition_rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import files

HEADER_BYTES = 227
#: Fixed values of the format: where colour starts in a record, by point format. Format 3 has a time before it.
COLOUR_AT = {2: 20, 3: 28}
FIELDS = {"point_index": "long", "x": "double", "y": "double", "z": "double", "r": "int", "g": "int", "b": "int"}
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def las_header(path: str) -> dict:
    """The header fields; an error if the file is no LAS file."""
    data = files.read_range(path, 0, HEADER_BYTES)
    if len(data) < HEADER_BYTES or data[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    start, fmt, length, count = struct.unpack_from("<IxxxxBHI", data, 96)
    return {"version": (data[24], data[25]), "point_data_offset": start, "point_format": fmt, "record_length": length, "point_count": count, "scale": struct.unpack_from("<3d", data, 131), "offset": struct.unpack_from("<3d", data, 155)}


def checked_header(path: str) -> dict:
    found = las_header(path)
    if found["point_format"] not in COLOUR_AT:
        raise ValueError(f"point format {found['point_format']} has no supported colour layout")
    if found["record_length"] < COLOUR_AT[found["point_format"]] + 6:
        raise ValueError(f"records of {found['record_length']} bytes are too short for the point format")
    return found


COMPARED = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def total_points(path: str) -> int:
    """Of all files that a path, folder or pattern names."""
    return sum(checked_header(p)["point_count"] for p in files.listed(path, ".las"))


class Records(InputPartition):
    def __init__(self, path: str, first: int, last: int, base: int):
        self.path, self.first, self.last, self.base = path, first, last, base


class LasReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        get = lambda k, d: type(d)(options.get(k, d))
        self.step, self.rows = get("step", 1), get("partition_rows", 2_000_000)
        if self.step < 1:
            raise ValueError("step must be at least 1")
        self.window = [get(k, d) for k, d in (("x_min", -np.inf), ("x_max", np.inf), ("y_min", -np.inf), ("y_max", np.inf))]
        self.tests: list = []  # (column, comparison, constant)
        self.paths = files.listed(options["path"], ".las")
        if not self.paths:
            raise FileNotFoundError(options["path"])
        self.headers = {p: checked_header(p) for p in self.paths}

    def pushFilters(self, filters):
        """Bounds of x, y and point_index are applied here; Spark applies all others."""
        for f in filters:
            column = f.attribute[0] if type(f) in COMPARED and len(f.attribute) == 1 else None
            if column in ("x", "y", "point_index"):
                self.tests.append((column, COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        found, base = [], 0
        for p in self.paths:
            n = self.headers[p]["point_count"]
            found += [Records(p, a, min(a + self.rows, n), base) for a in range(0, n, self.rows)]
            base += n
        return [r for r in found if self._may_hold(r.base + r.first, r.base + r.last - 1)] or [Records(self.paths[0], 0, 0, 0)]

    def _may_hold(self, first: int, last: int) -> bool:
        """Whether some index from first to last can pass: the largest must meet lower bounds, the smallest upper ones."""
        return all((test(last, v) if test in (np.greater, np.greater_equal) else test(first, v)) for c, test, v in self.tests if c == "point_index")

    def read(self, part):
        h = self.headers[part.path]
        size, colour = h["record_length"], COLOUR_AT[h["point_format"]]
        kind = np.dtype({"names": ["xyz", "rgb"], "formats": [("<i4", 3), ("<u2", 3)], "offsets": [0, colour], "itemsize": size})
        for at in range(part.first, part.last, 250_000):
            end = min(at + 250_000, part.last)
            raw = files.read_range(part.path, h["point_data_offset"] + at * size, (end - at) * size)
            if len(raw) < (end - at) * size:
                raise ValueError(f"{part.path} ends within its points")
            records, index = np.frombuffer(raw, kind), part.base + np.arange(at, end)
            axis = lambda k: records["xyz"][:, k] * h["scale"][k] + h["offset"][k]
            chosen = index % self.step == 0
            records, index = records[chosen], index[chosen]
            for column, test, value in [*self.tests, *(("xxyy"[k], (np.greater_equal, np.less)[k % 2], v) for k, v in enumerate(self.window) if np.isfinite(v))]:
                chosen = test(index if column == "point_index" else axis("xy".index(column)), value)
                records, index = records[chosen], index[chosen]
            if not len(records):
                continue
            make = {"point_index": lambda: index.astype(np.int64), **{c: (lambda k=k: axis(k)) for k, c in enumerate("xyz")}, **{c: (lambda k=k: records["rgb"][:, k].astype(np.int32)) for k, c in enumerate("rgb")}}
            yield pa.RecordBatch.from_arrays([pa.array(make[n]()) for n in self.names], self.names)


class LasSource(DataSource):
    """spark.read.format("las").option("path", ...)"""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        wanted = [c.strip() for c in self.options.get("columns", ",".join(FIELDS)).split(",")]
        return ", ".join(f"{c} {FIELDS[c]}" for c in wanted)

    def reader(self, schema):
        return LasReader(schema, self.options)


def read_las(spark, path: str, columns: list[str] | None = None, step: int = 1, window: tuple | None = None, partition_rows: int = 2_000_000):
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "step": step, "partition_rows": partition_rows} | ({"columns": ",".join(columns)} if columns else {})
    if window:
        options |= dict(zip(("x_min", "x_max", "y_min", "y_max"), window, strict=True))
    return spark.read.format("las").options(**options).load()


def las_bytes(raw_xyz: np.ndarray, rgb: np.ndarray, scale, offset, point_format: int = 2, padding: int = 0) -> bytes:
    """A LAS 1.2 file of these points."""
    size = COLOUR_AT[point_format] + 6 + padding
    kind = np.dtype({"names": ["xyz", "rgb"], "formats": [("<i4", 3), ("<u2", 3)], "offsets": [0, COLOUR_AT[point_format]], "itemsize": size})
    records = np.zeros(len(raw_xyz), kind)
    records["xyz"], records["rgb"] = raw_xyz, rgb
    head = bytearray(HEADER_BYTES)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<IxxxxBHI", head, 96, HEADER_BYTES, point_format, size, len(records))
    struct.pack_into("<3d3d", head, 131, *scale, *offset)
    return bytes(head) + records.tobytes()


def write_las(path: str, raw_xyz: np.ndarray, rgb: np.ndarray, scale, offset, point_format: int = 2, padding: int = 0) -> None:
    files.write_whole(path, [las_bytes(raw_xyz, rgb, scale, offset, point_format, padding)])


def write_las_folder(points, folder: str, order: str, scale, offset, part_rows: int = 2_000_000, point_format: int = 2, parts: int | None = None) -> list[str]:
    """Points (raw_x, raw_y, raw_z, r, g, b) as LAS files in the given order, written by executors; reading the folder gives that order again.

    A partition's rows may make several files; names sort by partition, then by file.
    """
    spark = points.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, rows, k, task = [], 0, 0, TaskContext.get()

        def out():
            data = np.concatenate(held)
            name = f"{folder}/part-{task.partitionId():06d}-{k:06d}.las"
            files.write_whole(name, [las_bytes(data[:, :3], data[:, 3:], scale, offset, point_format)], f".{task.taskAttemptId()}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], ["name", "n"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            rows += batch.num_rows
            if rows >= part_rows:
                yield out()
                held, rows, k = [], 0, k + 1
        if rows:
            yield out()

    ordered = points.repartitionByRange(n, order).sortWithinPartitions(order).select("raw_x", "raw_y", "raw_z", "r", "g", "b")
    return sorted(r["name"] for r in ordered.mapInArrow(run, "name string, n long").collect())  # a row a file
