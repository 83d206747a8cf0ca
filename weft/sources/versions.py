"""Keyed tables in versions: an upsert writes its own rows, not the table.

A table is a folder with ``data`` (parquet runs) and ``log`` (one small file a version, the
list of its runs, oldest first). An upsert writes a run with the given rows and commits a
version that has it at the end; a row of a later run replaces those of its key in earlier
ones. Runs are merged by size as they come, newest first, as long as the next older run is
less than twice what is being merged: so runs at least double from one to the next older,
their number grows with the logarithm of the rows, and a row is written again as often.

A version is committed by moving its finished list into place. A reader takes one list and
reads its runs, which never change, so what it sees is one version, also during an upsert.
Nothing is deleted but by :meth:`KeyedTable.vacuum`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = "_wf_run"


class KeyedTable:
    """A versioned table of one row per key under ``root``, a path that all executors see."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, key: Sequence[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        missing = [k for k in self.key if k not in self.schema.names]
        if missing or not self.key:
            raise ValueError(f"key columns not in the schema: {missing}")

    # ---- the log

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, folder = self._fs(), self._path("log")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def runs(self, version: int | None = None, before: int | None = None) -> list[dict]:
        """Runs (folder, rows) of a version: the given one, else the latest (``before`` a number, if set)."""
        known = [v for v in self.versions() if (version is None or v == version) and (before is None or v < before)]
        if not known:
            if version is not None:
                raise ValueError(f"no version {version} in {self.root}")
            return []
        [row] = self.spark.read.text(f"{self.root}/log/{known[-1]:020d}.json", wholetext=True).collect()  # one short line a run
        return json.loads(row[0])["runs"]

    def _commit(self, version: int, runs: list[dict]) -> None:
        fs = self._fs()
        draft, place = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{version:020d}.json")
        fs.mkdirs(self._path("log"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"runs": runs}).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise ValueError(f"version {version} of {self.root} was committed by another writer")

    # ---- rows

    def _read(self, runs: list[dict]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{r['folder']}").withColumn(_RUN, F.lit(k)) for k, r in enumerate(runs)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.union(p)
        return self._latest(rows) if len(parts) > 1 else rows.drop(_RUN)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of the rows of a key (one a run) that of the last run; combined before the shuffle."""
        values = [c for c in self.schema.names if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(F.lit(0).alias("_wf_any"), *values), _RUN).alias("_wf_row"))
        return newest.select(*[F.col(c) if c in self.key else F.col(f"_wf_row.{c}").alias(c) for c in self.schema.names])

    def load(self, version: int | None = None, before: int | None = None) -> DataFrame:
        """The rows of a version: the given one, else the latest (``before`` a number, if set); no version, no rows."""
        return self._read(self.runs(version, before))

    def upsert(self, rows: DataFrame, version: int | None = None, keep: Column | None = None) -> int:
        """Commit ``rows`` (one per key) over the latest version; returns the number of the new one.

        A given ``version`` that is already committed is left as it is, so a repeated
        micro-batch changes nothing; it builds on the latest version below it. Rows that
        ``keep`` doesn't hold for any more are left out of the runs that this call writes.
        """
        known = self.versions()
        if version is None:
            version = known[-1] + 1 if known else 0
        elif version in known:
            return version
        old = self.runs(before=version)
        folder = uuid.uuid4().hex
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        rows.write.parquet(f"{self.root}/data/{folder}")
        new = {"folder": folder, "rows": self._rows(folder)}
        merged = [new]
        # by size, so that the rows of an upsert move into ever larger runs
        while old and old[-1]["rows"] < 2 * sum(r["rows"] for r in merged):
            merged.insert(0, old.pop())
        if len(merged) > 1:
            folder = uuid.uuid4().hex
            whole = self._read(merged)
            (whole.where(keep) if keep is not None else whole).write.parquet(f"{self.root}/data/{folder}")
            self._fs().delete(self._path(f"data/{new['folder']}"), True)  # no version has it
            new = {"folder": folder, "rows": self._rows(folder)}
        self._commit(version, [*old, new])
        return version

    def replace(self, rows: DataFrame, version: int | None = None) -> int:
        """Commit ``rows`` as the whole of a new version; one that exists is left as it is."""
        known = self.versions()
        if version is None:
            version = known[-1] + 1 if known else 0
        elif version in known:
            return version
        folder = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.parquet(f"{self.root}/data/{folder}")
        self._commit(version, [{"folder": folder, "rows": self._rows(folder)}])
        return version

    def _rows(self, folder: str) -> int:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{folder}").count()  # from the files' footers

    def compact(self) -> int:
        """Commit the latest version again as a single run."""
        return self.replace(self.load())

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and the runs that none of these has."""
        known = self.versions()
        fs = self._fs()
        kept = {r["folder"] for v in known[-keep:] for r in self.runs(v)}
        gone = {r["folder"] for v in known[:-keep] for r in self.runs(v)} - kept
        for v in known[:-keep]:
            fs.delete(self._path(f"log/{v:020d}.json"), False)
        for folder in gone:
            fs.delete(self._path(f"data/{folder}"), True)
