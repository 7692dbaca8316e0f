"""Tables at rest: Parquet with a sidecar, source partitions, a catalog, lookups."""
from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.governance import require_provenance
from lodestone.operators.reshape import union_drift


class TableStore:
    """Named tables under one folder, by source: each write is a new version in a folder of its own, and a small file names the version that counts.

    Any store that Spark writes to will do.  A version is whole, with its note, before the name changes to it by one rename, so readers see the old table or the new one, and a
    write that fails leaves the old one.  Writers don't share folders; of two at once the last to rename counts.  The version before the new one stays for those who still read it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _hadoop(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, name: str, source: str) -> list[str]:
        """The version that counts and the one before it."""
        path, fs = self._hadoop(f"{self.root}/_current/{name}/{source}")
        return self.spark.read.text(str(path)).first()[0].split() if fs.exists(path) else []

    def _version(self, name: str, source: str, version: str) -> str:
        return f"{self.root}/table={name}/source={source}/version={version}"

    def _path(self, name: str, source: str) -> str:
        named = self._named(name, source)
        if not named:
            raise FileNotFoundError(f"table {name} has no source {source}; run the step that writes it")
        return f"{self._version(name, source, named[0])}/data"

    def write(self, df: DataFrame, name: str, producer: str, source: str = "main", provenance: bool = False) -> None:
        """Writes a version with its note, then names it."""
        if provenance:
            require_provenance(df)
        version = uuid.uuid4().hex
        folder = self._version(name, source, version)
        df.write.parquet(f"{folder}/data")
        rows = self.spark.read.schema(df.schema).parquet(f"{folder}/data").count()
        note = {"table": name, "source": source, "version": version, "rows": rows, "producer": producer, "created_at": datetime.now(UTC).isoformat(), "schema": json.loads(df.schema.json())}
        self._text(json.dumps(note), f"{folder}/note")
        before = self._named(name, source)
        self._rename(" ".join([version, *before[:1]]), f"{self.root}/_current/{name}/{source}")
        for old in before[1:]:
            path, fs = self._hadoop(self._version(name, source, old))
            fs.delete(path, True)

    def _text(self, text: str, path: str) -> None:
        at, fs = self._hadoop(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _rename(self, text: str, path: str) -> None:
        """A file with this text takes the place of another at once."""
        fresh = f"{path}.{uuid.uuid4().hex}.new"
        self._text(text, fresh)
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._hadoop(path)[0].toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(fs.Path(fresh), fs.Path(path), options)

    def sources(self, name: str) -> list[str]:
        base, fs = self._hadoop(f"{self.root}/_current/{name}")
        if not fs.exists(base):
            raise FileNotFoundError(f"table {name} is not there; run the step that writes it")
        return sorted(n for s in fs.listStatus(base) if not (n := s.getPath().getName()).endswith(".new") and not n.startswith("."))

    def read(self, name: str, columns: list[str] | None = None, source: str | None = None) -> DataFrame:
        """One source, or all of them stacked: a column that a source lacks is null, conflicting types go to the common one."""
        frames = [self.spark.read.parquet(self._path(name, s)) for s in ([source] if source else self.sources(name))]
        out = frames[0] if len(frames) == 1 else union_drift(frames)
        return out.select(*columns) if columns else out

    def notes(self, name: str) -> list[dict]:
        paths = [f"{self._path(name, s).removesuffix('/data')}/note" for s in self.sources(name)]
        return [json.loads(r.value) for r in self.spark.read.text(paths).collect()]

    def register(self, names: list[str], views: dict[str, str] | None = None) -> None:
        """A temp view for each table, and public views by SQL over them; a view over a missing table is an error."""
        for n in names:
            self.read(n).createOrReplaceTempView(n)
        for view, sql in (views or {}).items():
            self.spark.sql(sql).createOrReplaceTempView(view)

    def lookup(self, name: str, where: dict, columns: list[str] | None = None, limit: int = 50, order: list[str] | None = None) -> list[dict]:
        """A point lookup: equality or membership filters, which reach the scan, an order and a limit."""
        df = self.read(name)
        for c, v in where.items():
            df = df.filter(F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c) == v)
        df = df.orderBy(*(order or df.columns[:1])).limit(limit)
        return [r.asDict(recursive=True) for r in (df.select(*columns) if columns else df).collect()]
