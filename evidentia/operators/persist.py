"""Saving fitted models that hold tables: parameters and settings as JSON metadata, tables as Parquet next to it.

Models are ``MLWritable``, so a fitted ``Pipeline`` that holds some of them is saved and loaded as a whole.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

State = dict[str, Any]
Tables = dict[str, DataFrame]


class TableModel(Model, MLWritable, MLReadable):
    """A model that is made of settings and tables. ``state`` takes it apart, ``from_state`` puts it together."""

    def state(self) -> tuple[State, Tables]:
        raise NotImplementedError

    @classmethod
    def from_state(cls, state: State, tables: Tables) -> TableModel:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def save(self, path: str) -> None:
        """Save, in place of what is there."""
        self.write().overwrite().save(path)

    @classmethod
    def load(cls, *where) -> TableModel:
        """``load(path)``; a session may come first."""
        return cls.read().load(where[-1])


class _Writer(MLWriter):
    def __init__(self, model: TableModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        state, tables = self.model.state()
        extra = {"state": state, "tables": {f"table-{i}": name for i, name in enumerate(tables)}}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        for i, table in enumerate(tables.values()):
            table.write.parquet(f"{path}/table-{i}")


class _Reader(MLReader):
    def __init__(self, cls: type[TableModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        tables = {name: spark.read.parquet(f"{path}/{place}") for place, name in metadata["tables"].items()}
        model = self.cls.from_state(metadata["state"], tables)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def named(prefix: str, tables: Tables) -> Tables:
    """Tables of a part of a model among those of the whole."""
    return {f"{prefix}/{name}": table for name, table in tables.items()}


def under(prefix: str, tables: Tables) -> Tables:
    """What ``named`` has put in."""
    return {name[len(prefix) + 1 :]: table for name, table in tables.items() if name.startswith(f"{prefix}/")}
