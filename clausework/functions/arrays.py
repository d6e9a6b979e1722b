"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_with_pos(df: DataFrame, keep: list, arr: Column, pos: str, value: str) -> DataFrame:
    """Rows ``keep + (pos BIGINT, value)``, one per array element, none for an
    empty or NULL array.

    An inner ``posexplode`` makes Catalyst infer ``size(arr) > 0`` and push
    that filter below the projection that builds ``arr`` -- inlining the
    whole array expression (e.g. the paragraph split and every keyword scan)
    a second time.  The outer form infers nothing; the NULL row it emits for
    an empty array is dropped after the generator, where no filter can move
    below it.
    """
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, value))
            .where(F.col(pos).isNotNull())
            .withColumn(pos, F.col(pos).cast("bigint")))
