"""PLY: ascii and binary of either byte order, scalar and list properties.

Written from the published description of the format.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import file_at, parsed, read_files

# fixed values: scalar types of the format, their NumPy letters and Spark types (unsigned ones a size up)
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}


def header(raw: bytes) -> tuple[str, list[tuple[str, int, list]], list[str], int]:
    """(format, elements, comments, where the data begins); an element is (name, count, [(name, type, length type or None)])."""
    if not raw.startswith(b"ply"):
        raise ValueError("not a PLY file")
    end = raw.find(b"end_header")
    if end < 0:
        raise ValueError("the header doesn't end")
    start = raw.index(b"\n", end) + 1
    form, elements, comments = None, [], []
    for line in raw[:end].decode("ascii", "replace").splitlines()[1:]:
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            form = words[1]
        elif words[0] in ("comment", "obj_info"):
            comments.append(line.partition(" ")[2])
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            if words[1] == "list":
                elements[-1][2].append((words[4], TYPES[words[3]], TYPES[words[2]]))
            else:
                elements[-1][2].append((words[2], TYPES[words[1]], None))
        else:
            raise ValueError(f"unknown header line: {line}")
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format: {form}")
    return form, elements, comments, start


def decode(raw: bytes) -> dict[str, dict[str, list | np.ndarray]]:
    """Columns of each element."""
    form, elements, _, at = header(raw)
    order = ">" if form == "binary_big_endian" else "<"
    lines = iter(raw[at:].decode("ascii").splitlines()) if form == "ascii" else None
    out = {}
    for name, count, props in elements:
        if lines is not None:
            rows = []
            for _ in range(count):
                words = next(lines, None)
                if words is None:
                    raise ValueError(f"{name}: early end of file")
                words = words.split()
                row = []
                for _, kind, length in props:
                    n = int(words.pop(0)) if length else 1
                    if len(words) < n:
                        raise ValueError(f"{name}: early end of line")
                    vals = [np.dtype(kind).type(float(w) if kind[0] == "f" else int(w)) for w in words[:n]]
                    words = words[n:]
                    row.append(vals if length else vals[0])
                if words:
                    raise ValueError(f"{name}: more values than properties")
                rows.append(row)
            out[name] = {p[0]: [row[i] for row in rows] for i, p in enumerate(props)}
        elif not any(p[2] for p in props):
            kind = np.dtype([(p[0], order + p[1]) for p in props])
            if len(raw) < at + count * kind.itemsize:
                raise ValueError(f"{name}: early end of file")
            table = np.frombuffer(raw, kind, count, at)
            at += count * kind.itemsize
            out[name] = {p[0]: table[p[0]] for p in props}
        else:
            cols: dict[str, list] = {p[0]: [] for p in props}
            for _ in range(count):
                for p, kind, length in props:
                    n = 1
                    if length:
                        n = int(np.frombuffer(raw, order + length, 1, at)[0])
                        at += np.dtype(length).itemsize
                    if len(raw) < at + n * np.dtype(kind).itemsize:
                        raise ValueError(f"{name}: early end of file")
                    vals = np.frombuffer(raw, order + kind, n, at)
                    at += vals.nbytes
                    cols[p].append(vals.tolist() if length else vals[0])
            out[name] = cols
    return out


def encode(columns: dict[str, tuple[str, np.ndarray | list]], form: str = "binary_little_endian", element: str = "vertex", comments: tuple[str, ...] = ()) -> bytes:
    """A file of one element. columns: name to (type, values); a type "list uchar int" has lists as values."""
    n = len(next(iter(columns.values()))[1]) if columns else 0
    head = ["ply", f"format {form} 1.0", *(f"comment {c}" for c in comments), f"element {element} {n}", *(f"property {t} {c}" for c, (t, _) in columns.items()), "end_header", ""]
    raw = "\n".join(head).encode("ascii")
    if form == "ascii":
        cell = lambda t, v: " ".join([str(len(v)), *map(_plain, v)]) if t.startswith("list") else _plain(v)
        return raw + "".join(" ".join(cell(t, vs[i]) for t, vs in columns.values()) + "\n" for i in range(n)).encode("ascii")
    order = ">" if form == "binary_big_endian" else "<"
    if not any(t.startswith("list") for t, _ in columns.values()):
        table = np.empty(n, [(c, order + TYPES[t]) for c, (t, _) in columns.items()])
        for c, (_, v) in columns.items():
            table[c] = v
        return raw + table.tobytes()
    parts = [raw]
    for i in range(n):
        for t, v in columns.values():
            if t.startswith("list"):
                _, length, kind = t.split()
                parts += [np.array([len(v[i])], order + TYPES[length]).tobytes(), np.array(v[i], order + TYPES[kind]).tobytes()]
            else:
                parts.append(np.array([v[i]], order + TYPES[t]).tobytes())
    return b"".join(parts)


def _plain(v) -> str:
    return repr(v.item() if hasattr(v, "item") else v)


COLUMNS = ("x", "y", "z", "red", "green", "blue")


def point_rows(_: str, raw: bytes):
    """x, y, z and colours of the vertices."""
    v = decode(raw)["vertex"]
    names = COLUMNS
    n = len(v["x"])
    kinds = [("f8", pa.float64()) if c in "xyz" else ("i2", pa.int16()) for c in names]
    yield pa.table([pa.array(np.asarray(v[c]).astype(k), t) if c in v else pa.nulls(n, t) for c, (k, t) in zip(names, kinds)], names=list(names))


def read_points(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """(x, y, z, red, green, blue) of the vertices of all files; colours are null where there are none."""
    return parsed(read_files(spark, path), point_rows, "x double, y double, z double, red smallint, green smallint, blue smallint", errors)


def read_points_by_ranges(spark: SparkSession, path: str, rows: int = 1_000_000, pattern: str = "*.ply") -> DataFrame:
    """``read_points`` for binary files of any size: a task reads ``rows`` vertices of a file at their place in it, so no
    task holds a file. Vertices of scalar properties only, and as the file's first element; a file that ends early fails."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")  # no content is read

    def parts(batches):
        for b in batches:
            out = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = file_at(name)
                with store.open_input_file(at) as f:
                    head = f.read(1 << 20)
                form, elements, _, start = header(head)
                element, count, props = elements[0]
                if element != "vertex" or form == "ascii" or any(p[2] for p in props):
                    raise ValueError(f"{name}: not a binary file of vertices with scalar properties")
                width = sum(np.dtype(p[1]).itemsize for p in props)
                if size < start + count * width:
                    raise ValueError(f"{name}: early end of file")
                out += [(name, start + i * width, min(rows, count - i)) for i in range(0, count, rows)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "start", "n"])

    def read(batches):
        for b in batches:
            for name, start, n in zip(*(c.to_pylist() for c in b.columns)):
                store, at = file_at(name)
                with store.open_input_file(at) as f:
                    form, elements, _, _ = header(f.read(1 << 20))
                    kind = np.dtype([(p[0], (">" if form == "binary_big_endian" else "<") + p[1]) for p in elements[0][2]])
                    f.seek(start)
                    table = np.frombuffer(f.read(n * kind.itemsize), kind)
                for i in range(0, n, 100_000):
                    part = table[i : i + 100_000]
                    cols = [pa.array(part[c].astype("f8" if c in "xyz" else "i2")) if c in kind.names else pa.nulls(len(part), pa.int16()) for c in COLUMNS]
                    yield pa.RecordBatch.from_arrays(cols, names=list(COLUMNS))

    ranges = found.mapInArrow(parts, "path string, start long, n long")
    return ranges.repartition("path", "start").mapInArrow(read, "x double, y double, z double, red smallint, green smallint, blue smallint")


def point_files(points: DataFrame, name: str = "points", double: bool = True, comments: tuple[str, ...] = ()) -> DataFrame:
    """(path, content): a PLY file for each partition of (x, y, z and, if they are there, red, green, blue).

    The header has the number of points, so a partition is gathered first: partition by size."""
    colours = [c for c in ("red", "green", "blue") if c in points.columns]
    kind = "double" if double else "float"

    def run(batches):
        from pyspark import TaskContext

        rows = list(batches)
        pdf = pd.concat(rows) if rows else pd.DataFrame(columns=["x", "y", "z", *colours])
        cols = {c: (kind, pdf[c].to_numpy(float)) for c in "xyz"} | {c: ("uchar", pdf[c].to_numpy(np.uint8)) for c in colours}
        yield pd.DataFrame({"path": [f"{name}-{TaskContext.get().partitionId():05d}.ply"], "content": [encode(cols, comments=comments)]})

    return points.select("x", "y", "z", *colours).mapInPandas(run, "path string, content binary")


__all__ = ["decode", "encode", "header", "point_files", "point_rows", "read_points", "read_points_by_ranges"]
