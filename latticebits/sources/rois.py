"""ROI identities of optical sessions in HDF5-like trees: ids only, nothing else is read."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLANE = re.compile(r"^PlaneSegmentation([1-9][0-9]*)$")
ROOT = "processing/ophys/ImageSegmentation"
SCHEMA = "asset_path string, plane string, roi_id int, mask_id int, session int, scan_idx int, field int"


def _scalar(value: object) -> str:
    value = value[()] if hasattr(value, "__getitem__") and not isinstance(value, (str, bytes, list, Mapping)) else value
    return value.decode() if isinstance(value, bytes) else str(value)


def _session(text: str) -> tuple[int, int]:
    if not re.fullmatch("[0-9]+-scan-[0-9]+", text):
        raise ValueError(f"not a session id: {text}")
    parts = text.split("-")
    return int(parts[0]), int(parts[2])


def _path_session(path: str) -> tuple[int, int]:
    found = re.findall(r"_ses-([0-9]+)-scan-([0-9]+)_", path)
    if len(found) != 1:
        raise ValueError(f"no single session in path: {path}")
    return int(found[0][0]), int(found[0][1])


def roi_rows(tree: Mapping, asset_path: str, *, session_from_path: bool = False) -> Iterator[tuple]:
    """SCHEMA rows of one asset. Only session_id (unless the path tells it) and each plane's `id` are read; a plane of
    another name, a repeated mask id and an id that isn't a whole number are errors."""
    session, scan = _path_session(asset_path) if session_from_path else _session(_scalar(tree["session_id"]))
    planes = tree
    for name in ROOT.split("/"):
        planes = planes[name]
    for plane in sorted(planes, key=lambda n: (len(n), n)):
        m = PLANE.match(plane)
        if not m:
            raise ValueError(f"not a plane: {plane}")
        ids = planes[plane]["id"]
        values = list(ids[:] if hasattr(ids, "__getitem__") else ids)
        if any(isinstance(v, bool) or int(v) != v or v < 0 for v in values):
            raise ValueError(f"{plane}: an id isn't a whole number")
        if len({int(v) for v in values}) != len(values):
            raise ValueError(f"{plane}: ids repeat")
        for k, v in enumerate(values):
            yield asset_path, plane, k, int(v), session, scan, int(m[1])


class RoiSource(DataSource):
    """spark.read.format("rois") over HDF5 files (option paths, comma-separated): one partition a file, needs h5py there."""

    @classmethod
    def name(cls) -> str:
        return "rois"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RoiReader(self.options)


class _RoiReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split(",")
        self.from_path = options.get("sessionFromPath", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import h5py

        with h5py.File(partition.value, "r") as tree:
            yield from roi_rows(tree, partition.value, session_from_path=self.from_path)


def roi_table(spark: SparkSession, trees: Mapping[str, Mapping], **kwargs) -> DataFrame:
    """Rows of opened trees by asset path: for a driver that holds the handles, and for tests."""
    return spark.createDataFrame([r for path, tree in sorted(trees.items()) for r in roi_rows(tree, path, **kwargs)], SCHEMA)
