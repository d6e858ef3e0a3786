"""Archives and opaque members: inventories without interpretation, extraction through pinned digests, restricted ids."""

from __future__ import annotations

import hashlib
import io
import pickle
import tarfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "archive string, name string, kind string, size long, sha256 string"


def safe_name(name: str) -> str:
    """A member's path with forward slashes; an error for absolute ones, those that climb, and empty ones."""
    path = PurePosixPath(name.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or not path.parts or (len(path.parts[0]) > 1 and path.parts[0][1] == ":"):
        raise ValueError(f"unsafe member path: {name}")
    return str(path)


def members(data: bytes, nested: bool = True) -> list[tuple[str, str, int, str | None]]:
    """(name, kind, size, sha256) of a tar, sorted by name; members of a tar inside it as parent::child, one level deep.
    Links and devices are errors."""
    out: list[tuple[str, str, int, str | None]] = []
    seen: set[str] = set()
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for m in tar:
            name = safe_name(m.name)
            if name in seen:
                raise ValueError(f"repeated member: {name}")
            seen.add(name)
            if m.isdir():
                out.append((name, "directory", 0, None))
                continue
            if not m.isfile():
                raise ValueError(f"member is neither file nor directory: {name}")
            content = tar.extractfile(m).read()
            out.append((name, "file", len(content), hashlib.sha256(content).hexdigest()))
            if nested and name.lower().endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
                out += [(f"{name}::{n}", k, s, h) for n, k, s, h in members(content, nested=False)]
    return sorted(out)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """MEMBER rows of the archives at a path; each archive is opened in the task that reads it."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = members(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))]], ["archive", "name", "kind", "size", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(opened, MEMBER)


def classify(rows: DataFrame, documented: list[str], separate: list[str]) -> DataFrame:
    """One row: documented members present and missing, separate identity members, and the class that follows: hard-stop
    if a documented one is missing, identity-source-available if a separate one is there, else entangled."""
    base = F.element_at(F.split(F.element_at(F.split("name", "::"), -1), "/"), -1)
    have = rows.where("kind = 'file'").agg(F.coalesce(F.collect_set(F.when(base.isin(*documented, *separate), base)), F.array().cast("array<string>")).alias("have"))
    listed = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    present, missing, own = F.array_sort(F.array_intersect(listed(documented), "have")), F.array_sort(F.array_except(listed(documented), "have")), F.array_sort(F.array_intersect(listed(separate), "have"))
    kind = F.when(F.size(missing) > 0, "hard-stop").when(F.size(own) > 0, "identity-source-available").otherwise("identity-source-entangled-with-functional-values")
    return have.select(present.alias("present"), missing.alias("missing"), own.alias("separate"), kind.alias("classification"))


def extract_member(data: bytes, chain: list[tuple[str, int, str]]) -> bytes:
    """The file at the end of a chain of (member, size, sha256), each a tar inside the one before; every level is checked."""
    for name, size, sha in chain:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            found = [m for m in tar if safe_name(m.name) == safe_name(name)]
            if len(found) != 1 or not found[0].isfile():
                raise ValueError(f"{name} is not one regular member")
            data = tar.extractfile(found[0]).read()
        if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
            raise ValueError(f"{name}: size or digest differs")
    return data


#: What a pickled id vector may name. Fixed values.
ALLOWED = {("numpy", "dtype"), ("numpy", "ndarray"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}


class _Restricted(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed")
        return super().find_class(module, name)


def restricted_load(data: bytes) -> object:
    return _Restricted(io.BytesIO(data)).load()


def positive_ids(values: object) -> list[int]:
    """A flat vector of different positive 64-bit integers; floats, booleans, repeats and other shapes are errors."""
    import numpy as np

    a = np.asarray(values)
    if a.ndim != 1 or a.dtype == bool or a.dtype.kind not in "iuO" or (a.dtype.kind == "O" and any(isinstance(v, bool) or not isinstance(v, int) for v in a.tolist())):
        raise ValueError("ids must be a flat vector of integers")
    out = [int(v) for v in a.tolist()]
    if any(not 0 < v < 2**64 for v in out) or len(set(out)) != len(out):
        raise ValueError("ids must be positive, of at most 64 bits, and different")
    return out


def id_table(spark: SparkSession, values: object, column: str = "segment_id") -> DataFrame:
    from decimal import Decimal

    return spark.createDataFrame([(Decimal(v),) for v in positive_ids(values)], f"{column} decimal(20,0)")


def pickled_table(spark: SparkSession, data: bytes, *, size: int, git_sha1: str) -> DataFrame:
    """A pickled pandas table as a DataFrame, only after its size and git blob digest are what was stated."""
    from latticebits.operators.digest import git_blob_sha1

    if len(data) != size or git_blob_sha1(data) != git_sha1:
        raise ValueError("size or git blob digest differs")
    return spark.createDataFrame(pickle.loads(data))
