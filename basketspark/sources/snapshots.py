"""Versioned tables: all of a version is seen or none of it.

A commit writes its files beside those of other versions, then a manifest (which folders make
up the version, and what it knows of streams), and at last claims the next number in the log
with a file that only one writer can create; that file names the manifest. The version with
the largest complete number is the table. Readers keep the folders of the version they
found; a writer that dies leaves files that no manifest names, which ``retain`` deletes.

    prices/data/<id>/[_p_store=7/]*.parquet    prices/manifests/<id>.json    prices/log/00000012

Partition columns stay in the files as well; folders only serve scoped swaps and ``where``.
Writers of disjoint scopes at one time both succeed: who comes second takes up the other's
version and tries the next number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Partition values of a folder, as text; None for null.
Values = Mapping[str, str | None]


class Refused(ValueError):
    """A guard objected; nothing was committed."""


@dataclass(frozen=True)
class Manifest:
    schema: str
    folders: tuple[tuple[str, tuple[tuple[str, str | None], ...]], ...] = ()
    rows: int = 0
    #: The last epoch of each stream that is in the table.
    epochs: Mapping[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"schema": self.schema, "folders": [[p, list(v)] for p, v in self.folders], "rows": self.rows, "epochs": dict(self.epochs)})

    @staticmethod
    def of(text: str) -> Manifest:
        x = json.loads(text)
        return Manifest(x["schema"], tuple((p, tuple((k, w) for k, w in v)) for p, v in x["folders"]), x["rows"], x["epochs"])


class Snapshots:
    """The versions of the table at ``path``, which has a folder for each value of ``partitions``."""

    def __init__(self, spark: SparkSession, path: str, *partitions: str):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _list(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _write(self, name: str, text: str) -> bool:
        """Create a file unless there is one."""
        try:
            out = self._fs.create(self._at(f"{self.path}/{name}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, name: str) -> str:
        file = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    # versions

    def versions(self) -> dict[int, str]:
        """Complete versions with their manifests' ids; a log entry whose writer died before its end is none."""
        named = {int(n): self._read(f"log/{n}") for n in self._list("log") if n.isdigit()}
        return {n: name for n, name in named.items() if len(name) == 32}

    def version(self) -> int:
        """The current version, 0 for a table that has none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest | None:
        all_ = self.versions()
        version = max(all_, default=0) if version is None else version
        if version == 0:
            return None
        if version not in all_:
            raise LookupError(f"{self.path} has no version {version}")
        return Manifest.of(self._read(f"manifests/{all_[version]}.json"))

    def read(self, version: int | None = None, where: Callable[[Values], bool] | None = None) -> DataFrame:
        """A version's rows, or those in the folders for whose partition values ``where`` holds."""
        found = self.manifest(version)
        if found is None:
            raise LookupError(f"{self.path} has no version")
        return self._rows(found, [p for p, v in found.folders if where is None or where(dict(v))])

    def _rows(self, found: Manifest, folders: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(found.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in folders))

    # writing

    def commit(
        self,
        rows: DataFrame,
        replaces: Callable[[Values], bool] | None = None,
        *,
        figures: Mapping[str, Column] | None = None,
        guards: Iterable[Callable[[dict], str | None]] = (),
        facts: Mapping[str, float] | None = None,
        epoch: tuple[str, int] | None = None,
    ) -> int:
        """Make ``rows`` the table, or that part of it for whose partition values ``replaces`` holds; the new version's number.

        ``figures`` are aggregates that Spark observes while it writes; each guard gets them,
        with ``rows``, ``previous`` (rows of what is replaced) and ``facts``, and says what is
        wrong, if anything. ``epoch`` (stream, number) is remembered with the version; if the
        table has it already nothing is written.
        """
        if replaces is not None and not self.partitions:
            raise ValueError("only a table with partitions can be replaced in part")
        old = self.manifest()
        if epoch and old and old.epochs.get(epoch[0], -1) >= epoch[1]:
            return self.version()
        seen, name = Observation(), uuid.uuid4().hex
        hidden = [f"_p_{p}" for p in self.partitions]
        staged = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (figures or {}).items()))
        staged = staged.withColumns({h: F.col(p).cast("string") for h, p in zip(hidden, self.partitions, strict=True)}) if hidden else staged
        (staged.write.partitionBy(*hidden) if hidden else staged.write).parquet(f"{self.path}/data/{name}")
        found = dict(seen.get)
        made = self._folders(f"data/{name}")
        while True:
            version, old = self.version(), self.manifest()
            if epoch and old and old.epochs.get(epoch[0], -1) >= epoch[1]:
                return version
            out = [f for f in (old.folders if old else ()) if replaces is None or replaces(dict(f[1]))]
            previous = (old.rows if replaces is None else self._rows(old, [p for p, _ in out]).count()) if old and out else 0
            wrong = [w for g in guards if (w := g({**found, "previous": previous, **(facts or {})}))]
            if wrong:
                self._fs.delete(self._at(f"{self.path}/data/{name}"), True)
                raise Refused("; ".join(wrong))
            kept = tuple(f for f in (old.folders if old else ()) if f not in out)
            epochs = {**(old.epochs if old else {}), **(dict([epoch]) if epoch else {})}
            new = Manifest(rows.schema.json(), (*kept, *made), (old.rows if old else 0) - previous + found["rows"], epochs)
            if self._publish(version + 1, new):
                return version + 1

    def _folders(self, at: str) -> tuple:
        """The folders under ``at`` that have rows, with their partition values."""
        if not self.partitions:
            return ((at, ()),)
        depth = "/".join(f"_p_{p}=*" for p in self.partitions)
        out = []
        for status in self._fs.globStatus(self._at(f"{self.path}/{at}/{depth}")) or ():
            parts = status.getPath().toString().split("/")[-len(self.partitions) :]
            decode = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            values = [decode(x.split("=", 1)[1]) for x in parts]
            out.append(("/".join([at, *parts]), tuple(zip(self.partitions, (None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values), strict=True))))
        return tuple(sorted(out, key=str))

    def _publish(self, version: int, manifest: Manifest) -> bool:
        name = uuid.uuid4().hex
        self._write(f"manifests/{name}.json", manifest.text())
        taken = max((int(n) for n in self._list("log") if n.isdigit()), default=0)  # also by writers that died
        return self._write(f"log/{max(version, taken + 1 if taken not in self.versions() else version):08d}", name)

    def retain(self, versions: int = 2) -> None:
        """Delete all but the last versions, and files that none of these has; not while others write or read older ones."""
        all_ = self.versions()
        kept = sorted(all_)[-versions:]
        manifests = {all_[v]: Manifest.of(self._read(f"manifests/{all_[v]}.json")) for v in kept}
        for n in self._list("log"):
            if n.isdigit() and int(n) not in kept and int(n) < max(kept, default=0):
                self._fs.delete(self._at(f"{self.path}/log/{n}"), False)
        for n in self._list("manifests"):
            if n.removesuffix(".json") not in manifests:
                self._fs.delete(self._at(f"{self.path}/manifests/{n}"), False)
        used = {p for m in manifests.values() for p, _ in m.folders}
        roots = {"/".join(p.split("/")[:2]) for p in used}
        for n in self._list("data"):
            if f"data/{n}" not in roots:
                self._fs.delete(self._at(f"{self.path}/data/{n}"), True)
            else:
                for p, _ in self._folders(f"data/{n}"):
                    if p not in used:
                        self._fs.delete(self._at(f"{self.path}/{p}"), True)


# guards: each gets figures and says what is wrong, or None


def least_coverage(share: float = 0.20, rows: int = 1000) -> Callable[[dict], str | None]:
    """Of many cards a share has matches (figure ``matched``)."""
    return lambda f: f"{f['matched'] or 0} of {f['rows']} have a match" if f["rows"] >= max(rows, 1) and (f["matched"] or 0) < share * f["rows"] else None


def least_size(share: float = 0.70, previous: int = 1000) -> Callable[[dict], str | None]:
    """No less than a share of what there was, if that were more than ``previous`` rows."""
    return lambda f: f"{f['rows']} rows after {f['previous']}" if f["previous"] > previous and f["rows"] < share * f["previous"] else None


def least_rows(rows: int = 8000) -> Callable[[dict], str | None]:
    return lambda f: f"{f['rows']} rows are too few" if f["rows"] < rows else None


def no_shrinking(share: float = 0.50, existing: int = 20) -> Callable[[dict], str | None]:
    """A store keeps half of its offers at least, if it had some."""
    return least_size(share, existing - 1)


def few_failures(share: float = 0.15) -> Callable[[dict], str | None]:
    """Of the tasks that read a store (facts ``tasks`` and ``failed``) few failed."""
    return lambda f: f"{f['failed']} of {f['tasks']} tasks failed" if f.get("failed", 0) > share * f.get("tasks", 0) else None


#: The guards of a run, of a serving table and of a store's feed.
RUN, SERVING, FEED = (least_coverage(), least_size()), (least_rows(), least_coverage(0.25, 0)), (no_shrinking(), few_failures(), least_size(0.60, 100))


# additive counters


def counted_into(table: Snapshots, stream: str, keys: Sequence[str], sums: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the batch's sums by key are added to those of the table, each epoch once.

    Sums and the epoch's number are committed together, so an epoch that is written again
    after a failure changes nothing. Only the folders that the batch has rows for are read
    and written; late rows add up as all others do.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        if not table.partitions:
            touched = None
        else:
            found = {tuple(r) for r in new.select(*(F.col(p).cast("string") for p in table.partitions)).distinct().collect()}
            touched = lambda v: tuple(v[p] for p in table.partitions) in found
        if table.version():
            new = new.unionByName(table.read(where=touched)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        table.commit(new, touched, epoch=(stream, epoch))

    return write
