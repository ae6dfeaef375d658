"""A store of one JSON file per day in several places, as a Spark data source: the first place that has a day in order wins."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, StringType, StructType

#: Under which names a file that is no list holds its rows.
SHAPES = ("events", "data", "matches")


class Day(InputPartition):
    def __init__(self, day: str):
        self.day = day


class DayStore(DataSource):
    """Option `places`: folders, best first, separated by `|`, each with files `<day>.json` that hold a list of objects or one
    under `events`, `data` or `matches`. A day is read from the first place where its file is there and whole; places are not
    mixed within a day. A day that no place has whole gives no rows, or an error if `strict` is true. Columns are the
    fields of the objects by the given schema; `day` and `place` (the number of the place) are filled in where it has them.

    One task reads one day. Any store that pyarrow reaches by its address will do."""

    @classmethod
    def name(cls) -> str:
        return "day_store"

    def schema(self) -> str:
        return "day string, place int, id string, status string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Days(schema, self.options)


class Days(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.places = [p for p in options.get("places", "").split("|") if p]
        self.strict = str(options.get("strict", "false")).lower() == "true"

    @staticmethod
    def _store(place: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(place)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        days = set()
        for place in self.places:
            store, path = self._store(place)
            found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
            days |= {f.base_name.removesuffix(".json") for f in found if f.is_file and f.base_name.endswith(".json")}
        return [Day(d) for d in sorted(days)] or [Day("")]

    def _rows(self, place: str, day: str) -> list[dict]:
        """The rows of a whole file; ValueError or OSError otherwise."""
        store, path = self._store(place)
        with store.open_input_stream(f"{path}/{day}.json") as f:
            held = json.loads(f.read())
        if isinstance(held, dict):
            held = next((held[s] for s in SHAPES if isinstance(held.get(s), list)), None)
        if not isinstance(held, list) or not all(isinstance(r, dict) for r in held):
            raise ValueError("no list of objects")
        return held

    def _value(self, row: dict, name: str, kind) -> object:
        v = row.get(name)
        if v is None or isinstance(kind, BooleanType) != isinstance(v, bool):
            return None if not isinstance(kind, StringType) or v is None else json.dumps(v)
        if isinstance(kind, StringType):
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        try:
            return int(v) if isinstance(kind, IntegralType) else float(v) if isinstance(kind, DoubleType | FloatType) else v
        except (TypeError, ValueError):
            return None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        day = partition.day
        for at, place in enumerate(self.places if day else ()):
            try:
                rows = self._rows(place, day)
            except (OSError, ValueError):
                continue
            for row in rows:
                filled = {"day": day, "place": at}
                yield tuple(filled[n] if n in filled else self._value(row, n, k) for n, k in self.fields)
            return
        if self.strict and day:
            raise ValueError(f"no place has the day {day} whole")


def read_days(spark: SparkSession, places: list[str], schema: str, strict: bool = False) -> DataFrame:
    spark.dataSource.register(DayStore)
    return spark.read.format("day_store").schema(schema).option("places", "|".join(places)).option("strict", str(strict).lower()).load()
