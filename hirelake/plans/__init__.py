"""Plan-shape helpers: distributed sequence numbers, lineage cuts."""


from pyspark.sql import DataFrame as _DF


def left_join_nonnull(left: _DF, right: _DF, key: str) -> _DF:
    """Left join on a nullable key without shuffling the NULL-key rows: they cannot
    match, and hashed together they would all land in one task. They bypass the join
    and get NULL right-side columns."""
    from pyspark.sql import functions as F
    matched = left.where(F.col(key).isNotNull()).join(right, key, "left")
    rest = left.where(F.col(key).isNull())
    for field in right.schema.fields:
        if field.name != key:
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return matched.unionByName(rest)

