"""Exact deduplication by a streaming query over disk-backed keyed state.

Documents are appended to a content table; a streaming aggregation without watermark, so without expiry, keeps for every
SHA-256 digest of a normalised text the group's size, the identifier of the row that stays and the locator of its content.
Every further hit is then checked byte for byte against the located content. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTERED, few, settings, text_or_empty, work_dir, written

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a group that one copy of the kept text is compared with in one task.
ROWS_A_SALT = 2048

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # there may be many small stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # of all stores in an executor
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores that are done go soon, with their memory and files
}


def normalised(text: Column) -> Column:
    return F.translate(text_or_empty(text), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _fold(rows: DataFrame, *keys: str) -> DataFrame:
    """Each group's size and the row that stays: most code points, then smallest identifier (null last), then smallest locator."""
    first = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("id").isNull().alias("unnamed"), "id", "locator"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), first.alias("best"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _state_of(content: DataFrame, folder: str) -> DataFrame:
    """Run what is new in the content table through the keyed state; returns the state's rows, one for each digest."""
    spark, table = content.sparkSession, f"{folder}/groups"
    schema = _fold(content, "digest").schema
    with settings(spark, _STATE):
        arriving = spark.readStream.schema(content.schema).parquet(f"{folder}/content").select("digest", "id", "points", "locator")
        query = (
            _fold(arriving, "digest").writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            .foreachBatch(lambda changed, n: changed.write.mode("overwrite").parquet(f"{table}/turn={n}"))
            .start()
        )
        query.awaitTermination()
    if not _there(spark, table):
        return spark.createDataFrame([], schema)
    changed = spark.read.schema(schema.add("turn", "long")).parquet(table)
    if changed.select("turn").distinct().count() > 1:  # a digest may have changed in several turns: its last state counts
        changed = changed.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "turn").alias("s")).select("digest", "s.*")
    return changed.select("digest", "group_size", "best")


def _unequal(content: DataFrame, many: DataFrame, path: str) -> DataFrame:
    """The digests of groups in which some text differs from the one that stays, byte for byte.

    Only texts of groups with several rows need to move: a Bloom filter of those groups' digests keeps the others where they
    are. The text that stays is copied for every ROWS_A_SALT rows of its group.
    """
    moved = content.join(few(many), "digest")
    stays = F.col("locator") == F.col("best.locator")
    salts = F.ceil(F.col("group_size") / ROWS_A_SALT).cast("int")
    hits = moved.where(~stays).select("digest", F.pmod(F.hash("locator"), salts).alias("salt"), "body")
    located = moved.where(stays).select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("body").alias("located"))
    unequal = hits.join(located, ["digest", "salt"]).where("body <> located").select("digest").distinct()
    with settings(content.sparkSession, FILTERED):
        return written(unequal, path)


class _Found:
    """The content table, its groups, and the digests whose texts are not all equal."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest, folder: str | None, batch: int) -> None:
        spark = docs.sparkSession
        self.folder = folder = folder or work_dir(spark, "exact-dedup")
        plain = normalised(docs[text_col])
        content = docs.select(
            F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.char_length(text_or_empty(docs[text_col])).alias("points"),
            digest(plain).alias("digest"), sha256(plain).alias("text_sha256"), F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")).alias("locator"),
        )
        place = f"{folder}/content/batch={batch}"
        if not _there(spark, f"{place}/_SUCCESS"):
            content.write.mode("overwrite").parquet(place)
        self.content = spark.read.schema(content.schema).parquet(f"{folder}/content")
        self.groups = _state_of(self.content, folder)
        self.body = normalised(F.col(f"row.{text_col}")).cast("binary").alias("body")
        # The groups of several rows, mostly few, decide alone which rows go: as a table of their own they can be broadcast while they
        # are few; the condition, which all its rows meet, lets Spark make a Bloom filter of it beyond that.
        self.many = written(self.groups.where("group_size > 1"), f"{folder}/many-{batch}").where("group_size > 1")
        self.unequal = _unequal(self.content.select("digest", "locator", self.body), self.many, f"{folder}/unequal-{batch}")

    def apart(self) -> DataFrame:
        """The rows of unequal digests, in groups by their full texts."""
        apart = self.content.join(self.unequal, "digest", "left_semi").withColumn("body", self.body)
        return apart.join(_fold(apart, "digest", "body"), ["digest", "body"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, folder: str | None = None, batch: int = 0) -> DataFrame:
    """For every row of `docs`: `row` (all its columns), `id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when identical after deleting every blank of `BLANKS`; null counts as empty. Of equal texts the row with
    the most code points stays, then the one with the smallest identifier (null comes last); of rows that tie in both, such as
    repeated rows, exactly one stays. An empty table gives an empty result. Other columns, whatever their names, stay in `row`.
    `digest` may be any function of the normalised text: rows that collide in it are told apart by their full texts.

    `folder` is a work folder on shared storage, which the result reads from. One that holds the state of earlier batches is
    continued: `docs`, with a `batch` number of its own, are added to those, and the result has the rows of all batches. A batch
    that has been stored isn't stored again, so a call that failed may be repeated. A locator is the batch, and the part and
    the row in it where the content stands.
    """
    found = _Found(docs, id_col, text_col, digest, folder, batch)
    stays = F.col("locator") == F.col("best.locator")
    linked = found.content.join(found.groups, "digest")
    out = [F.col("id"), F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256"]
    if found.unequal.isEmpty():
        return linked.select("row", *out)
    return linked.join(found.unequal, "digest", "left_anti").select("row", *out).unionByName(found.apart().select("row", *out))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, folder: str | None = None, batch: int = 0) -> DataFrame:
    """The rows that stay, with all their columns. Only the locators of the others are joined, so that texts don't move as long as
    those are at most FEW."""
    found = _Found(docs, id_col, text_col, digest, folder, batch)
    goes = F.col("locator") != F.col("best.locator")
    gone = found.content.select("digest", "locator").join(few(found.many), "digest").where(goes)
    if not found.unequal.isEmpty():
        gone = gone.join(found.unequal, "digest", "left_anti").select("locator").unionByName(found.apart().where(goes).select("locator"))
    gone = written(gone.select("locator"), f"{found.folder}/gone-{batch}")
    return found.content.join(few(gone), "locator", "left_anti").select("row.*")
