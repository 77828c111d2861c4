"""Readers and writers of memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.functions import fixed_values as fv
from mnemoframe.operators.mutations import only_new, union_all


def read_parquet(spark: SparkSession, path: str, spread_by: tuple[str, ...] = ()) -> DataFrame:
    """A parquet table; one with fewer splits than cores is spread by its row key first.

    A table of one row group is read by one task, and the text work behind it would
    run there too.  A large table has more splits than cores and is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *spread_by)
    return df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; bad lines are an error, not a null row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int,
              parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` key ranges."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, **options)
            .option("partitionColumn", key).option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", parts).load())


def write_facts(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Facts laid out by tenant and scope, so scoped searches prune partitions."""
    facts.write.mode(mode).partitionBy("tenant_id", "scope").parquet(path)


def export_scope(facts: DataFrame, entities: DataFrame, edges: DataFrame,
                 sessions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Facts, sessions, their tenants' entities and edges as ``kind, id, body`` rows.

    ``body`` is the JSON of the row.  Edges found from both ends appear once.
    """
    keys = ["tenant_id", "scope", "scope_id"]
    asked = scopes.select(*keys).distinct()
    tenants = scopes.select("tenant_id").distinct()

    def packed(df: DataFrame, kind: str, row_id: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(row_id).cast("string").alias("id"),
                         F.to_json(F.struct(*df.columns)).alias("body"))

    own_entities = entities.join(tenants, "tenant_id", "left_semi")
    return union_all([
        packed(facts.join(asked, keys, "left_semi"), "fact", "fact_id"),
        packed(own_entities, "entity", "entity_id"),
        packed(edges.join(tenants, "tenant_id", "left_semi"), "edge", "edge_id"),
        packed(sessions.join(asked, keys, "left_semi"), "session", "session_id"),
    ])


def import_rows(existing: DataFrame, exported: DataFrame, kind: str, schema: str,
                key: str) -> DataFrame:
    """Rows of one kind from an export that the table does not have yet."""
    rows = exported.where(F.col("kind") == kind).select(
        F.from_json("body", schema).alias("r")).select("r.*")
    return only_new(existing, rows, key)


def sync_counts(local: dict[str, DataFrame], remote: dict[str, DataFrame],
                keys: dict[str, str]) -> DataFrame:
    """Dry run of a sync: rows per table that one side has and the other lacks."""
    parts = []
    for name, key in keys.items():
        for side, (a, b) in {"to_remote": (local, remote), "to_local": (remote, local)}.items():
            parts.append(a[name].join(b[name].select(key), key, "left_anti").groupBy().agg(
                F.lit(name).alias("tbl"), F.lit(side).alias("direction"),
                F.count(F.lit(1)).alias("rows")).select("tbl", "direction", "rows"))
    return union_all(parts)


TRANSCRIPT = ("type string, timestamp timestamp, sessionId string, "
              "message struct<role:string, content:string>")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Conversation entries of JSON-lines transcripts with their file and text."""
    rows = read_json(spark, path, TRANSCRIPT)
    return rows.select(
        F.input_file_name().alias("file"), "timestamp", "sessionId", "type",
        F.when(F.col("type") == "human", "user").otherwise(F.col("type")).alias("role"),
        F.col("message.content").alias("content")).where(
        F.col("type").isin("human", "assistant"))


def transcript_stream(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts as a file stream; the checkpoint is the resume marker."""
    return spark.readStream.schema(TRANSCRIPT).json(path)


def key_source_files(spark: SparkSession, root: str, depth: int, top: int) -> DataFrame:
    """The ``top`` source files of a code tree worth reading first: entry files, then the smallest.

    Hidden folders and files do not count; ``depth`` is the number of folders below the root.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    relative = F.split_part(F.col("path"), F.lit(root.rstrip("/") + "/"), F.lit(-1))
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    entry = F.when(name.rlike("|".join(fv.SOURCE_ENTRY_NAMES)), 0).otherwise(1)
    shown = ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*fv.SKIPPED_FOLDERS))
    return (files.where(shown & (F.size(parts) <= depth + 1) & name.rlike(fv.SOURCE_EXTENSIONS))
            .withColumn("priority", entry).orderBy("priority", "length", "path").limit(top))
