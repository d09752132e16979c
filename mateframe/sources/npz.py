"""NumPy archives as a Spark data source: one partition per file, Arrow batches out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MLP_SCHEMA = "x array<float>, wdl int, dtz int"
GRAPH_SCHEMA = "p_ids array<int>, node_tac array<int>, edges array<int>, edge_counts int, wdl int, dtz int, turn int"
SCHEMAS = {"mlp": MLP_SCHEMA, "graph": GRAPH_SCHEMA}
#: How arrays are kept: type and, beyond one dimension, the shape of a row (None: rows are filled up to the widest).
LAYOUT = {"x": (np.float32, (-1,)), "p_ids": (np.int8, (64,)), "node_tac": (np.uint8, (64, 4)), "edges": (np.uint16, None), "edge_counts": (np.uint16, ()), "wdl": (np.int8, ()), "turn": (np.int8, ()), "dtz": (np.int16, ())}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class NpzReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str]):
        self.path, self.fields = path, fields

    def partitions(self) -> list[InputPartition]:
        files, base = _filesystem(self.path)
        found = files.get_file_info(pafs.FileSelector(base, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".npz")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.path)
        with files.open_input_file(partition.path) as source, np.load(source) as data:
            columns = {k: data[k] for k in self.fields}
            n = len(columns[self.fields[0]])
            for at in range(0, n, 8192):
                arrays = []
                for k in self.fields:
                    part = columns[k][at : at + 8192]
                    if k == "edges":  # padded to a fixed width: keep the edges that count
                        counts = columns["edge_counts"][at : at + 8192] if "edge_counts" in columns else np.full(len(part), part.shape[1])
                        arrays.append(pa.array([row[:c].astype(np.int32) for row, c in zip(part, counts, strict=True)], pa.list_(pa.int32())))
                    elif part.ndim > 1:
                        flat = part.reshape(len(part), -1)
                        kind = pa.float32() if flat.dtype.kind == "f" else pa.int32()
                        arrays.append(pa.array(list(flat.astype(np.float32 if kind == pa.float32() else np.int32)), pa.list_(kind)))
                    else:
                        arrays.append(pa.array(part.astype(np.int32)))
                if arrays:
                    yield pa.RecordBatch.from_arrays(arrays, self.fields)


class NpzSource(DataSource):
    """``format("npz")`` with a schema that names the arrays to read; others stay on disk."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "mlp")]

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options["path"], [f.name for f in schema.fields])


def read(spark: SparkSession, path: str, kind: str = "mlp") -> DataFrame:
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("kind", kind).load(path)


#: Rows of one archive.
ARCHIVE = 1 << 16


def _array(name: str, column: pa.ChunkedArray) -> np.ndarray:
    """A column as the array that an archive holds."""
    kind, shape = LAYOUT[name]
    x = column.combine_chunks()
    if shape == ():
        flat = x.to_numpy(zero_copy_only=False)
        # distances take 16 bits, or 32 where an archive needs them
        return flat.astype(np.int32 if name == "dtz" and len(flat) and abs(flat.astype(np.int64)).max() >= 1 << 15 else kind)
    if shape is not None:
        width = len(x.flatten()) // max(len(x), 1)
        return x.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape((len(x), width) if shape == (-1,) else (len(x), *shape))
    lengths = np.diff(x.offsets.to_numpy())
    out = np.zeros((len(x), int(lengths.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < lengths[:, None]] = x.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return out


def write(df: DataFrame, path: str, rows: int = ARCHIVE, kind: str = "mlp") -> DataFrame:
    """Vectors (x, wdl, dtz) or graphs (as in ``GRAPH_SCHEMA``) as archives of about ``rows`` rows (less than twice as many); returns file names and rows.

    An archive is written under a temporary name and moved when complete, so a task that runs
    again replaces its own. Lists of edges are filled up with zeros; their counts tell where they end.
    """
    from pyspark import TaskContext

    names = StructType.fromDDL(SCHEMAS[kind]).names

    def part(batches):
        held, number = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                if sum(b.num_rows for b in held) >= rows:
                    yield save(held, number)
                    held, number = [], number + 1
        if held:
            yield save(held, number)

    def save(held, number):
        t = pa.Table.from_batches(held)
        files, base = _filesystem(path)
        files.create_dir(base, recursive=True)
        name = f"shard_{TaskContext.get().partitionId():05d}_{number:04d}.npz"
        temporary = f"{base}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as out:
            np.savez_compressed(out, **{c: _array(c, t[c]) for c in names})
        files.move(temporary, f"{base}/{name}")
        return pa.RecordBatch.from_pydict({"file": [f"{base}/{name}"], "rows": [t.num_rows]})

    return df.select(*names).mapInArrow(part, "file string, rows long")
