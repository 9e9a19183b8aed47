"""Tables of plain Parquet files that can be changed: point reads, lists, upserts and deletes that overwrite the partitions they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.functions import access, text


class Table:
    """A Parquet table at `path`, partitioned by a hash of its keys (column _part), so that a change reads and overwrites only the partitions that its keys fall
    into (dynamic partition overwrite). Any Spark reader can read the folder. A change is written aside first, so a failed one can be run again; changes to
    one table go one after the other, and a reader may meet one half done.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], parts: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts

    @property
    def folder(self) -> str:
        """Where the rows are: a folder named by the keys."""
        return f"{self.path}/by-{'-'.join(self.keys)}"

    def _files(self, path: str):
        """(file system, path) of the JVM."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._files(self.folder)
        return fs.exists(p)

    def create(self) -> None:
        """Makes the table if there is none."""
        if not self.exists():
            self._write(self._placed(self.spark.createDataFrame([], self.schema)))

    def drop(self) -> None:
        if self.exists():
            session.delete_path(self.spark, self.folder)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _all(self) -> DataFrame:
        if not self.exists():
            return self._placed(self.spark.createDataFrame([], self.schema))
        return self.spark.read.schema(f"{self.schema}, _part int").parquet(self.folder)

    def read(self) -> DataFrame:
        return self._all().drop("_part")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.folder)

    def _change(self, keys: DataFrame, added: DataFrame | None) -> None:
        """Takes rows of the keys out and puts others in; only partitions of the keys are read and written."""
        touched = sorted(r[0] for r in self._placed(keys.select(*self.keys)).select("_part").distinct().collect())  # `parts` numbers at most
        left = self._all().where(F.col("_part").isin(touched)).join(keys.select(*self.keys).distinct(), self.keys, "left_anti")
        after = session.written(left if added is None else left.unionByName(self._placed(added)), "table-change")
        held = {r[0] for r in after.select("_part").distinct().collect()}
        self._write(after)
        for part in set(touched) - held:  # what has no rows left is not overwritten
            fs, p = self._files(f"{self.folder}/_part={part}")
            fs.delete(p, True)

    def upsert(self, rows: DataFrame) -> None:
        """Puts rows in place of those of equal keys, or beside them; of several with equal keys one is taken."""
        rows = session.written(rows.select(*self.read().columns).dropDuplicates(self.keys), "table-rows")
        self._change(rows, rows)

    def delete(self, keys: DataFrame) -> int:
        """Removes rows of the given keys and returns how many there were."""
        keys = keys.select(*self.keys).distinct()
        n = self.read().join(keys, self.keys, "left_semi").count()
        if n:
            self._change(keys, None)
        return n

    def rekey(self, keys: list[str], filled: dict[str, str] | None = None) -> None:
        """Gives the table other keys: null key columns are filled, and of rows with equal new keys one stays. Nothing is done if the keys are these already."""
        if keys == self.keys:
            return
        rows = self.read().fillna(filled or {})
        if not rows.where(" or ".join(f"{k} is null" for k in keys)).isEmpty():
            raise ValueError("a key column is null")
        after = Table(self.spark, self.path, self.schema, list(keys), self.parts)
        after.drop()
        after._write(after._placed(rows.dropDuplicates(keys)))
        self.drop()
        self.keys = list(keys)

    def vacuum(self) -> None:
        """Deletes what failed changes have left in the folder."""
        if self.exists():
            fs, p = self._files(self.folder)
            for f in fs.listStatus(p):
                if f.getPath().getName().startswith((".spark-staging", "_temporary")):
                    fs.delete(f.getPath(), True)


def resource(table: DataFrame, uris: DataFrame, workspace_id: str, who, kind: str) -> DataFrame:
    """(uri, status, text) of asked uris: NOT_FOUND (an entity gives a stub), PERMISSION_DENIED or OK with masked text."""
    own = table.where(F.col("workspace_id") == workspace_id).select("uri", "text", "acl_allow", F.lit(True).alias("_has"))
    missing = F.col("_has").isNull()
    allowed = access.strict(F.col("acl_allow"), who)
    status = F.when(missing, "STUB" if kind == "entity" else "NOT_FOUND").when(allowed, "OK").otherwise("PERMISSION_DENIED")
    return uris.select("uri").distinct().join(own, "uri", "left").select("uri", status.alias("status"), F.when(~missing & allowed, text.redact(F.col("text"))).otherwise(F.lit("")).alias("text"))


def of_owner(table: DataFrame, workspace_id: str, subject: str | None = None) -> DataFrame:
    """Rows of a workspace, and of one subject in it if named; both reach the scan."""
    mine = table.where(F.col("workspace_id") == workspace_id)
    return mine if subject is None else mine.where(F.col("subject") == subject)


def of_documents(table: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (chunks, say) of the documents (doc_uri)."""
    return table.join(docs.select("doc_uri").distinct(), "doc_uri", "left_semi")


#: Fields that a point read of each kind gives; a table may have more.
FIELDS = {
    "doc": ["uri", "title", "source", "source_path", "workspace_id", "acl_allow", "tags", "updated_at", "checksum"],
    "chunk": ["uri", "doc_uri", "text", "span", "entity_uris", "workspace_id", "acl_allow", "source", "tags", "updated_at"],
    "entity": ["uri", "name", "aliases", "canonical_key", "workspace_id", "acl_allow"],
    "memory": ["uri", "type", "text", "citations", "confidence", "workspace_id", "subject"],
}


def get(table: DataFrame, uris: DataFrame, kind: str, workspace_id: str, subject: str | None = None) -> DataFrame:
    """uri, found and the fields of its kind for each asked uri (uri), of one workspace; memory is its owner's. A field that the table has not is left out."""
    own = of_owner(table, workspace_id, subject if kind == "memory" else None)
    fields = [c for c in FIELDS[kind] if c in own.columns]
    return uris.select("uri").distinct().join(own.select(*fields, F.lit(True).alias("found")), "uri", "left").withColumn("found", F.coalesce("found", F.lit(False)))
