"""Sinks: facts published whole or not at all, tiles, JSON lines, search indexes and results as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, SHA-256) of a table's content, whatever its order: rows are hashed, and sums of the hashes' parts are too."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    r = df.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws(",", "n", *[f"s{i}" for i in range(8)]), 256).alias("h")).first()
    return r["n"], r["h"]


def publish(df: DataFrame, path: str, schema_version: int = 1, schema: str | None = None) -> dict:
    """Write a table to a staging folder, check it, then put it in place with a sidecar of its rows and digest.

    With ``schema``, its columns are taken by name and cast to it first. A table that is there already is moved aside, and
    only deleted once the new one is in place, so a crash in between leaves one of them whole.
    """
    if schema:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema])
    spark, staging = df.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    rows, sha = digest(spark.read.schema(df.schema).parquet(staging))
    entry = {"schema": schema_version, "rows": rows, "sha256": sha, "complete": True}
    _put_in_place(spark, staging, path)
    _write_text(spark, f"{path.rstrip('/')}.manifest.json", json.dumps(entry, sort_keys=True))
    return entry


def _put_in_place(spark: SparkSession, staging: str, path: str) -> None:
    source, fs = _fs(spark, staging)
    target, _ = _fs(spark, path)
    aside, _ = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"could not put {path} in place")
    if there:
        fs.delete(aside, True)


def publish_kinds(rows: DataFrame, path: str, kinds: dict[str, str], schema_version: int = 1) -> dict:
    """Write the tables of several kinds (kind: schema) from one pass over ``rows``, which has ``kind`` and their columns.

    Kinds are partitions of one staging folder. Their rows are counted while they are written, each table is read back
    and must have as many, and one rename puts all in place or none; the sidecar tells rows and digest of each.
    """
    spark, staging = rows.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    counted = Observation()
    watched = rows.observe(counted, *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).alias("_other"))
    watched.write.partitionBy("kind").parquet(staging)
    told = counted.get
    entry = {"schema": schema_version, "complete": True, "kinds": {}}
    for kind, schema in kinds.items():
        n, sha = digest(kind_rows(spark, staging, kind, schema))
        entry["kinds"][kind] = {"rows": n, "sha256": sha}
    if told["_other"] or any(entry["kinds"][k]["rows"] != told[k] for k in kinds):
        folder, fs = _fs(spark, staging)
        fs.delete(folder, True)
        raise ValueError(f"{path}: {told} rows were written, {entry['kinds']} are there")
    _put_in_place(spark, staging, path)
    _write_text(spark, f"{path.rstrip('/')}.manifest.json", json.dumps(entry, sort_keys=True))
    return entry


def kind_rows(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of one kind; no file of another is opened."""
    return spark.read.schema(f"{schema}, kind STRING").parquet(path).where(F.col("kind") == kind).drop("kind")


def verified_kind(spark: SparkSession, path: str, kind: str, schema: str, schema_version: int = 1) -> DataFrame:
    """One table of ``publish_kinds``, once its version, rows and digest are as the sidecar says; else an error."""
    entry = json.loads(read_text(spark, f"{path.rstrip('/')}.manifest.json"))
    df, told = kind_rows(spark, path, kind, schema), entry["kinds"].get(kind, {})
    if not entry.get("complete") or entry["schema"] != schema_version or digest(df) != (told.get("rows"), told.get("sha256")):
        raise ValueError(f"{kind} of {path} is not what was published")
    return df


def verified(spark: SparkSession, path: str, schema: str, schema_version: int = 1) -> DataFrame:
    """A published table, once its version, rows and digest are as its sidecar says; else an error."""
    entry = json.loads(read_text(spark, f"{path.rstrip('/')}.manifest.json"))
    df = spark.read.schema(schema).parquet(path)
    if not entry.get("complete") or entry["schema"] != schema_version or digest(df) != (entry["rows"], entry["sha256"]):
        raise ValueError(f"{path} is not what was published")
    return df


def write_tiles(df: DataFrame, path: str, size: float, shards: int = 256) -> None:
    """Parquet partitioned by tile; each tile is written by one task, so it is one file, unless it holds many rows."""
    t = df.withColumn("tx", F.floor(F.col("x") / size).cast("int")).withColumn("ty", F.floor(F.col("y") / size).cast("int"))
    t.repartition(shards, "tx", "ty").write.partitionBy("tx", "ty").option("maxRecordsPerFile", 1_000_000).mode("overwrite").parquet(path)


def road_tiles(steps: DataFrame, size: float, most_class: tuple[int, ...]) -> DataFrame:
    """Road pieces (road_class, x1, y1, x2, y2) by level of detail and the tile of their middle, relative to its corner."""
    lods = F.array(*[F.struct(F.lit(i).alias("lod"), F.lit(c).alias("most")) for i, c in enumerate(most_class)])
    s = steps.withColumn("l", F.explode(lods)).where("road_class <= l.most")
    tile = lambda a, b: F.floor((F.col(a) + F.col(b)) * 0.5 / size).cast("int")
    s = s.withColumn("tx", tile("x1", "x2")).withColumn("ty", tile("y1", "y2"))
    near = [(F.col(f"{a}{i}") - F.col(f"t{a}") * size).alias(f"{a}{i}") for i in (1, 2) for a in "xy"]
    return s.select(F.col("l.lod").alias("lod"), "tx", "ty", "road_class", *near)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_search_index(indexed: DataFrame, posted: DataFrame, path: str) -> None:
    """Records and posting lists as two tables; lists are clustered by trigram, so a query opens few files."""
    indexed.write.mode("overwrite").parquet(f"{path}/records")
    posted.repartitionByRange("g").sortWithinPartitions("g", "id").write.mode("overwrite").parquet(f"{path}/postings")


def merge_manifest(spark: SparkSession, path: str, key: str, entry: dict) -> dict:
    """Set one entry of a JSON manifest and write it back."""
    p, fs = _fs(spark, path)
    manifest = json.loads(read_text(spark, path)) if fs.exists(p) else {}
    manifest[key] = entry
    _write_text(spark, path, json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def as_json(*columns: Column | str) -> Column:
    """One JSON line of some columns, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
