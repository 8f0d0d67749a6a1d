"""Collections: catalog tables of points.

Vector size, distance, layout and declared payload fields live in the table properties.
A change of the layout writes a new table and puts it in the old one's place. Changes of
points can be kept beside the table (``changes.py``); reading merges them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.distance import check_distance
from nearfield.operators.analytics import collection_stats
from nearfield.operators.pairs import hyperplane_code
from nearfield.schema import DEFAULT_SHARDS, POINT_SCHEMA, check_collection_name
from nearfield.session import broadcast_if_small, shared_dir

_PREFIX = "nearfield."

# Bytes of a part of a collection laid out for changes.
PART_BYTES = 256 << 20

# The kinds of payload field, and the column type of each.
FIELD_TYPES = {
    "keyword": "string",
    "integer": "bigint",
    "float": "double",
    "geo": "struct<lon: double, lat: double>",
}


def _quoted(name: str) -> str:
    """The collection's table. Catalog names know no hyphen."""
    return "`" + check_collection_name(name).replace("-", "_dash_") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def collection_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """What the collection was created with: dim, distance, vector, shards, shard_key, field.*"""
    restore(spark, name)
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()
    return {r.key[len(_PREFIX) :]: r.value for r in rows if r.key.startswith(_PREFIX)}


def list_fields(spark: SparkSession, name: str) -> dict[str, str]:
    """Declared payload fields and their kinds."""
    given = collection_properties(spark, name)
    return {k[len("field.") :]: v for k, v in given.items() if k.startswith("field.")}


def part_of(id_col: str, count: int) -> Column:
    """The part that an id's point lies in, of so many."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(count)).cast("int")


def parts_for(size: int, least: int = DEFAULT_SHARDS, part_bytes: int = PART_BYTES) -> int:
    """Parts of a collection of so many bytes, at least ``least``."""
    return max(least, -(-size // part_bytes))


def layout_columns(given: dict[str, str]) -> list[str]:
    """Columns by which the collection's files lie in folders, made from others."""
    return ["part"] if "parts" in given else ["code"] if "code_bits" in given else []


def _arranged(points: DataFrame, given: dict[str, str]) -> DataFrame:
    """The points as the collection's files want them.

    Parts: each task holds one part of the ids. Codes: points of one hyperplane code lie
    together, a crowded code is split by id. Declared fields: neighbouring values share
    files, whose min and max then skip them; the id splits a value that very many points
    have. Shard key: one value's rows lie together, a crowded value is split by size.
    Otherwise: each task holds one bucket.
    """
    spark, shards, key = points.sparkSession, int(given["shards"]), given.get("shard_key")
    if "parts" in given:
        count = int(given["parts"])
        return points.drop("part").withColumn("part", part_of("id", count)).repartitionById(count, F.col("part"))
    if "code_bits" in given:
        vector = given.get("vector", "dense")
        coded = points.drop("code").withColumn("code", hyperplane_code(vector, int(given["code_bits"])))
        return coded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "code", "id")
    fields = [k[len("field.") :] for k in given if k.startswith("field.")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if fields:
        order = [*([key] if key else []), *[f for f in fields if f != key], "id"]
        order = [f"`{c}`" for c in order]
        return points.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    if key:
        return points.hint("rebalance", F.col(f"`{key}`"))
    return points.repartition(shards * -(-tasks // shards), "id")


def _write(spark: SparkSession, name: str, points: DataFrame, given: dict[str, str]) -> None:
    writer = _arranged(points, given).write.format("parquet")
    if layout_columns(given):
        writer = writer.partitionBy(*layout_columns(given))
    elif given.get("shard_key"):
        writer = writer.partitionBy(given["shard_key"])
    elif not any(k.startswith("field.") for k in given):
        writer = writer.bucketBy(int(given["shards"]), "id").sortBy("id")
    if given.get("external") == "true":
        writer = writer.option("path", shared_dir(spark, "collections", name))
    writer.saveAsTable(_quoted(name))
    pairs = ", ".join(f"{_literal(_PREFIX + k)} = {_literal(v)}" for k, v in given.items())
    spark.sql(f"ALTER TABLE {_quoted(name)} SET TBLPROPERTIES ({pairs})")


def create_collection(
    spark: SparkSession,
    name: str,
    dim: int,
    distance: str = "Cosine",
    sparse: bool = False,
    shards: int = DEFAULT_SHARDS,
    shard_key: str | None = None,
    external: bool = False,
    vector: str = "dense",
    parts: int | None = None,
    code_bits: int | None = None,
) -> None:
    """An empty collection; one of that name must not exist.

    ``vector`` names the column of dense vectors, by custom after their model.
    Without a shard key, points are bucketed by id into ``shards``. With one, each of
    its values gets a partition. With ``parts`` (see ``parts_for``) they lie in so many
    parts by id, which ``changes`` rewrites one by one; with ``code_bits`` by their
    hyperplane code, for approximate search. ``external`` puts the files in the shared
    folder instead of the warehouse.
    """
    check_distance(distance)
    if dim <= 0 or shards <= 0 or (parts is not None and parts <= 0):
        raise ValueError("dim, shards and parts must be positive")
    if sum(x is not None for x in (shard_key, parts, code_bits)) > 1:
        raise ValueError("a collection is laid out by shard key, parts or codes, not by several")
    empty = spark.createDataFrame([], POINT_SCHEMA)
    if vector != "dense" and vector in empty.columns:
        raise ValueError(f"vector name {vector!r}: that column holds something else")
    empty = empty.withColumnRenamed("dense", vector)
    if not sparse:
        empty = empty.drop("sparse")
    if shard_key and shard_key not in empty.columns:
        empty = empty.withColumn(shard_key, F.lit(None).cast("string"))
    given = {"dim": str(dim), "distance": distance, "vector": vector, "shards": str(shards)}
    if shard_key:
        given["shard_key"] = shard_key
    if parts is not None:
        given["parts"] = str(parts)
    if code_bits is not None:
        given["code_bits"] = str(code_bits)
    if external:
        given["external"] = "true"
    _write(spark, name, empty, given)


def recreate_collection(spark: SparkSession, name: str, dim: int, **options) -> None:
    """Replaces the collection, if there is one, by an empty one."""
    for table in (changes_name(name), journal_name(name), f"{name}__rejected", name):
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")
    create_collection(spark, name, dim, **options)


def prepare_collection(
    spark: SparkSession, name: str, dim: int, recreate: bool = False, **options
) -> bool:
    """Makes the collection ready for a first load; False if it already has points."""
    restore(spark, name)
    if recreate:
        recreate_collection(spark, name, dim, **options)
    elif not spark.catalog.tableExists(_quoted(name)):
        create_collection(spark, name, dim, **options)
    else:
        return open_collection(spark, name).isEmpty()
    return True


def open_collection(spark: SparkSession, name: str, shards: list | None = None) -> DataFrame:
    """The points; ``shards`` reads only the partitions of those shard key values."""
    restore(spark, name)
    points = _with_changes(spark, name, spark.table(_quoted(name)))
    if shards is None:
        return points
    key = collection_properties(spark, name).get("shard_key")
    if key is None:
        raise ValueError(f"collection {name!r} has no shard key")
    return points.filter(F.col(f"`{key}`").isin(shards))


def changes_name(name: str) -> str:
    return f"{name}__changes"


def journal_name(name: str) -> str:
    return f"{name}__journal"


def overwrite_partitions(rows: DataFrame, table: str) -> None:
    """Puts ``rows`` in place of the partitions of ``table`` that they lie in, and of no other."""
    conf, key = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")
    try:
        rows.select(*rows.sparkSession.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        conf.set(key, before)


def side_table(
    spark: SparkSession, name: str, kind: str, like: DataFrame | None = None, partition_by: list[str] | None = None
) -> str | None:
    """The name of a table kept beside the collection; ``like`` makes it, empty, where it is missing."""
    table = _quoted(f"{name}__{kind}")
    if not spark.catalog.tableExists(table):
        if like is None:
            return None
        writer = like.limit(0).write.format("parquet").partitionBy(*(partition_by or []))
        if collection_properties(spark, name).get("external") == "true":
            writer = writer.option("path", shared_dir(spark, "collections", f"{name}__{kind}"))
        writer.saveAsTable(table)
    return table


def pending_changes(spark: SparkSession, name: str, given: dict[str, str]) -> DataFrame | None:
    """The last change of each id that the table does not hold yet: point columns, deleted, version."""
    version, compacted = int(given.get("version", 0)), int(given.get("compacted", 0))
    if version <= compacted:
        return None
    # A version beyond the committed one is left from a write that broke off.
    pending = spark.table(_quoted(changes_name(name))).filter(F.col("version").between(compacted + 1, version))
    last = pending.groupBy("id").agg(F.max("version").alias("version"))
    return pending.join(last, ["id", "version"])


def merge_changes(points: DataFrame, pending: DataFrame | None) -> DataFrame:
    """The points with pending changes in place of those of the same ids."""
    if pending is None:
        return points
    unchanged = points.join(broadcast_if_small(pending.select("id")), "id", "left_anti")
    return unchanged.unionByName(pending.filter("NOT deleted").select(*points.columns))


def _with_changes(spark: SparkSession, name: str, points: DataFrame) -> DataFrame:
    """What the collection holds: without its part column, with changes kept beside it."""
    if "part" not in points.columns:
        return points
    given = collection_properties(spark, name)
    if "parts" not in given:
        return points
    # Rows without an id mark parts that have lost all their points.
    return merge_changes(points.filter("id IS NOT NULL").drop("part"), pending_changes(spark, name, given))


def _of_size(vector: Column, dim: int) -> Column:
    """The vector, if it has the collection's size; the write fails where it has not."""
    wrong = F.raise_error(F.concat(F.lit(f"vector size must be {dim}, not "), F.size(vector)))
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(wrong)


def add_points(spark: SparkSession, name: str, points: DataFrame) -> None:
    """Appends points whose ids are new; ``replace_points`` saves an upsert.

    Columns the points lack stay null; a column that the collection lacks and a vector of
    another size are errors.
    """
    given = collection_properties(spark, name)
    _arranged(as_points(spark, name, points, given), given).write.insertInto(_quoted(name))


def as_points(spark: SparkSession, name: str, points: DataFrame, given: dict[str, str]) -> DataFrame:
    """``points`` with the collection's columns, but for those of its layout, and their types."""
    made = layout_columns(given)
    schema = [f for f in spark.table(_quoted(name)).schema if f.name not in made]
    unknown = set(points.columns) - {f.name for f in schema}
    if unknown:
        raise ValueError(f"collection {name!r} has no columns {sorted(unknown)}")
    columns = []
    for f in schema:
        value = F.col(f"`{f.name}`") if f.name in points.columns else F.lit(None)
        value = value.cast(f.dataType)
        if f.name == given.get("vector", "dense"):
            value = _of_size(value, int(given["dim"]))
        columns.append(value.alias(f.name))
    return points.select(*columns)


def describe_collection(spark: SparkSession, name: str) -> DataFrame:
    """One row: what the points hold, beside the size and distance declared."""
    given = collection_properties(spark, name)
    points = open_collection(spark, name).withColumnRenamed(given.get("vector", "dense"), "dense")
    return collection_stats(points).select(
        F.lit(name).alias("collection"),
        "*",
        F.lit(int(given["dim"])).alias("declared_size"),
        F.lit(given["distance"]).alias("distance"),
    )


def _swap(spark: SparkSession, name: str, points: DataFrame, given: dict[str, str]) -> None:
    following, former = f"{name}__next", f"{name}__former"
    restore(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(following)}")
    _write(spark, following, points, given)
    # The collection itself is there, so this one is left from a swap that ended.
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(former)}")
    spark.sql(f"ALTER TABLE {_quoted(name)} RENAME TO {_quoted(former)}")
    spark.sql(f"ALTER TABLE {_quoted(following)} RENAME TO {_quoted(name)}")
    files = _location(spark, former) if given.get("external") == "true" else None
    spark.sql(f"DROP TABLE {_quoted(former)}")
    if files is not None:
        _remove_version(spark, name, files)


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {_quoted(name)}").filter("col_name = 'Location'")
    return rows.first().data_type


def _remove_version(spark: SparkSession, name: str, files: str) -> None:
    """Deletes the files of a version that no table names any more.

    Only what ``_write`` put into the shared folder for this collection is deleted.
    """
    if f"/nearfield/collections/{name}/" not in files and f"/nearfield/collections/{name}__next/" not in files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(files)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def restore(spark: SparkSession, name: str) -> None:
    """Gives a collection its name back if a swap broke off after taking it away."""
    former = f"{name}__former"
    if not spark.catalog.tableExists(_quoted(name)) and spark.catalog.tableExists(_quoted(former)):
        spark.sql(f"ALTER TABLE {_quoted(former)} RENAME TO {_quoted(name)}")


def replace_points(spark: SparkSession, name: str, points: DataFrame) -> None:
    """Saves a new version, which may well be computed from the present one.

    The present table stays until the new one is written in full. It holds all changes
    made so far.
    """
    given = collection_properties(spark, name)
    if "version" in given:
        given["compacted"] = given["version"]
    _swap(spark, name, points, given)


def typed_field(field: str, kind: str) -> Column:
    """A payload value as a column of the declared kind; null where it does not fit.

    Geo values are JSON objects with lon and lat.
    """
    if kind not in FIELD_TYPES:
        raise ValueError(f"field kind {kind!r}: must be one of {', '.join(FIELD_TYPES)}")
    value = F.try_element_at("payload", F.lit(field))
    if kind == "geo":
        place = F.from_json(value, "lon double, lat double")
        known = place["lon"].isNotNull() & place["lat"].isNotNull()
        return F.when(known, place)
    return value.try_cast(FIELD_TYPES[kind])


def declare_field(spark: SparkSession, name: str, field: str, kind: str = "keyword") -> None:
    """Gives a payload field a typed column of its own and lays the table out by it.

    Filters on the column then reach the scan and skip row groups. A column that the
    table has already must be of the declared type.
    """
    points = open_collection(spark, name)
    if field in points.columns and field not in list_fields(spark, name):
        if kind not in FIELD_TYPES:
            raise ValueError(f"field kind {kind!r}: must be one of {', '.join(FIELD_TYPES)}")
        has = points.schema[field].dataType.simpleString()
        if has != FIELD_TYPES[kind].replace(": ", ":").replace(", ", ","):
            raise ValueError(f"column {field!r} is {has}, not {FIELD_TYPES[kind]} as {kind} fields are")
        typed = points
    else:
        typed = points.withColumn(field, typed_field(field, kind))
    given = {**collection_properties(spark, name), f"field.{field}": kind}
    _swap(spark, name, typed, given)


def drop_field(spark: SparkSession, name: str, field: str) -> None:
    """Undoes ``declare_field``; the payload keeps the value."""
    given = collection_properties(spark, name)
    if given.pop(f"field.{field}", None) is None:
        return
    own = {c.split(" ")[0] for c in POINT_SCHEMA.replace("<", " ").split(", ")} | {given.get("vector")}
    points = open_collection(spark, name)
    kept = points if field in own or field == given.get("shard_key") else points.drop(field)
    _swap(spark, name, kept, given)


