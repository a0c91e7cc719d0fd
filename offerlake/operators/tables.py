"""Table maintenance on plain Parquet: dedup, insert-only merge, retention, deletes, cascades, schema alignment.

All of these are joins and aggregates the optimizer plans; nothing is collected. Deletes are
expressed as the rows that remain (anti/semi joins), which a caller writes to a new location.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def dedup_first(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order`` (ascending, nulls last). No key column -> unchanged.

    Written as ``min(struct(order, row))`` per key rather than a ``row_number`` window: the aggregate
    is combined map-side, so a key that holds a third of the table is reduced to one row per input
    partition before the shuffle instead of being sorted in a single task.
    """
    keys, order = _cols(keys), _cols(order)
    if not all(k in df.columns for k in keys):
        return df
    others = [c for c in df.columns if c not in keys]
    ordering = [F.struct(F.col(o).isNull().alias("n"), F.col(o).alias("v")).alias(f"o{i}") for i, o in enumerate(order)]
    packed = F.struct(*ordering, F.struct(*[F.col(c) for c in others]).alias("row"))
    first = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.row.{c}").alias(c) for c in others]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order`` (newest wins). Same map-side-combined shape as dedup_first."""
    keys, order = _cols(keys), _cols(order)
    others = [c for c in df.columns if c not in keys]
    ordering = [F.struct(F.col(o).isNotNull().alias("n"), F.col(o).alias("v")).alias(f"o{i}") for i, o in enumerate(order)]
    packed = F.struct(*ordering, F.struct(*[F.col(c) for c in others]).alias("row"))
    last = df.groupBy(*keys).agg(F.max(packed).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.row.{c}").alias(c) for c in others]).select(*df.columns)


def insert_only_rows(source: DataFrame, target: DataFrame, key: str, order: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of ``source`` to append to ``target`` under an insert-only merge.

    Null keys are rejected (they never match, so they would be inserted again on every run); the
    source is first reduced to one row per key (first by ``order``; without one, by a hash of the row, so
    that a repeated run keeps the same row); keys already in the target are left alone. Only the target's
    key column is read.
    """
    src = source.filter(F.col(key).isNotNull())
    if order is not None:
        src = dedup_first(src, key, order)
    else:
        hashed = [f"`{f.name}`" for f in src.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        src = dedup_first(src.withColumn("_row_hash", F.xxhash64(*hashed)), key, "_row_hash").drop("_row_hash")
    return src.join(target.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def merge_insert_only(source: DataFrame, target: DataFrame, key: str, order: str | Sequence[str] | None = None) -> DataFrame:
    """The target after an insert-only merge: existing rows unchanged, new keys appended."""
    new = insert_only_rows(source, target, key, order)
    return target.unionByName(schema_align(new, target.schema), allowMissingColumns=False)


def unprocessed(source: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Rows whose key has no entry in ``done`` yet."""
    return source.join(done.select(F.col(done_key or key).alias(key)), key, "left_anti")


def retention(df: DataFrame, date_col: str, as_of: str, days: int) -> DataFrame:
    """Rows kept by retention: ``date >= as_of - days``; rows with a null date are kept (reported)."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    return df.filter(F.col(date_col).isNull() | (F.col(date_col) >= cutoff))


def retention_report(df: DataFrame, date_col: str, as_of: str, days: int) -> DataFrame:
    """One row: rows kept, deleted, and with a null date."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    d = F.col(date_col)
    return df.agg(
        F.count_if(d.isNull() | (d >= cutoff)).cast("long").alias("kept"),
        F.count_if(d < cutoff).cast("long").alias("deleted"),
        F.count_if(d.isNull()).cast("long").alias("null_dates"),
    )


def drop_expired(spark, path: str, as_of: str, days: int, date_col: str = "ingestion_date") -> DataFrame:
    """Retention of a table stored by date: whole partitions older than ``as_of - days`` go, the others are neither read nor
    written; a partition without a date stays. Returns ``(date_col, deleted)``, one row for each dropped partition, counted
    before it went."""
    import datetime

    from offerlake.sources.folders import drop_folder, partition_values

    cutoff = (datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days)).isoformat()
    expired = [v for v in partition_values(spark, path, date_col) if v[:1].isdigit() and v < cutoff]
    schema = f"`{date_col}` date, deleted long"
    if not expired:
        return spark.createDataFrame([], schema)
    stored = spark.read.option("basePath", path).parquet(*[f"{path}/{date_col}={v}" for v in expired])
    gone = {str(r[0]): r[1] for r in stored.groupBy(date_col).count().collect()}  # one row a date
    for v in expired:
        drop_folder(spark, f"{path}/{date_col}={v}")
    return spark.createDataFrame([(datetime.date.fromisoformat(v), gone.get(v, 0)) for v in expired], schema)


def delete_keys(df: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """``DELETE ... WHERE key IN (keys)`` as the rows that remain."""
    return df.join(keys.select(F.col(keys_col or key).alias(key)), key, "left_anti")


def cascade_delete(child: DataFrame, parent_kept: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Children whose parent survived (``ON DELETE CASCADE``)."""
    return child.join(parent_kept.select(F.col(pk or fk).alias(fk)), fk, "left_semi")


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Children without a parent row (they would abort a load into a table with a foreign key)."""
    return child.join(parent.select(F.col(pk or fk).alias(fk)), fk, "left_anti")


def keep_latest_date(df: DataFrame, date_col: str) -> DataFrame:
    """Rows of the newest ``date_col``: a scalar subquery (``max``) used as a filter, no collect.

    When ``df`` is partitioned on ``date_col`` on disk, the subquery value prunes partitions at run time.
    """
    return df.filter(F.col(date_col) == df.select(F.max(date_col)).scalar())


def _align_col(col: Column, src: T.DataType, dst: T.DataType) -> Column:
    if src == dst:
        return col
    if isinstance(src, T.StructType) and isinstance(dst, T.StructType):
        src_fields = {f.name: f.dataType for f in src.fields}
        parts = []
        for f in dst.fields:
            if f.name in src_fields:
                parts.append(_align_col(col[f.name], src_fields[f.name], f.dataType).alias(f.name))
            else:
                parts.append(F.lit(None).cast(f.dataType).alias(f.name))
        return F.when(col.isNull(), F.lit(None).cast(dst)).otherwise(F.struct(*parts))
    if isinstance(src, T.ArrayType) and isinstance(dst, T.ArrayType):
        return F.transform(col, lambda x: _align_col(x, src.elementType, dst.elementType))
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(src, nested) and isinstance(dst, T.StringType):
        return F.to_json(col)
    if isinstance(src, T.StringType) and isinstance(dst, nested):
        return F.from_json(col, dst)
    if isinstance(src, nested) or isinstance(dst, nested):
        return F.lit(None).cast(dst)
    return col.try_cast(dst)


def schema_align(df: DataFrame, target: T.StructType) -> DataFrame:
    """Project ``df`` onto ``target``: same order and types; missing columns and fields become null,
    extra ones are dropped, values that do not convert become null (``try_cast``) instead of failing."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in target.fields:
        if f.name in have:
            out.append(_align_col(F.col(f"`{f.name}`"), have[f.name], f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


_NUMERIC_ORDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


_INTEGER_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    ia = next((i for i, t in enumerate(_NUMERIC_ORDER) if isinstance(a, t)), None)
    ib = next((i for i, t in enumerate(_NUMERIC_ORDER) if isinstance(b, t)), None)
    if ia is not None and ib is not None:
        wide = _NUMERIC_ORDER[max(ia, ib)]
        # a float holds integers of 24 bits only
        exact = wide is not T.FloatType or _NUMERIC_ORDER[min(ia, ib)] in (T.ByteType, T.ShortType, T.FloatType)
        return wide() if exact else T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        other = b if isinstance(a, T.DecimalType) else a
        if isinstance(other, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        if isinstance(other, (T.DecimalType, *_INTEGER_DIGITS)):
            sizes = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_INTEGER_DIGITS[type(t)], 0) for t in (a, b)]
            whole, scale = max(s[0] for s in sizes), max(s[1] for s in sizes)
            # no decimal type holds the digits of both: their text does
            return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if isinstance(a, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(b, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _supertype(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_supertype(a.elementType, b.elementType))
    return T.StringType()


def relaxed_schema(dfs: Sequence[DataFrame]) -> T.StructType:
    """Union of the columns of ``dfs`` in first-seen order, each at a type every input converts to."""
    fields: dict[str, T.DataType] = {}
    for df in dfs:
        for f in df.schema.fields:
            fields[f.name] = _supertype(fields[f.name], f.dataType) if f.name in fields else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def union_relaxed(dfs: Sequence[DataFrame], target: T.StructType | None = None) -> DataFrame:
    """Concatenate frames with different columns and types: missing -> null, types relaxed to a
    common supertype (or cast to ``target``). Each input is aligned before the union, so Spark's own
    union coercion (which would resolve ``string`` with ``date`` to ``date``) never decides."""
    schema = target or relaxed_schema(dfs)
    return reduce(lambda a, b: a.unionByName(b), [schema_align(df, schema) for df in dfs])
