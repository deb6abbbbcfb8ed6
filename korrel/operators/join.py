"""Inner equi-joins on one pair of fields, with a choice of physical strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from korrel.schema import Table, column, joined_fields

#: Estimated bytes up to which the first table is broadcast.
BROADCAST_BYTES = 64 << 20
STRATEGIES = ("auto", "broadcast", "shuffle_hash", "merge")
_MOST_PARTITIONS = 1 << 20


def estimated_bytes(table: Table) -> int:
    """The optimiser's estimate of a table's size."""
    return int(str(table.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_join(r: Table, s: Table, r_field: str, s_field: str, strategy: str = "broadcast", nan_equal: bool = True) -> Table:
    """Rows of r and s with equal fields: r's fields, then s's, named ``table.field``.

    r should be the smaller table. ``broadcast`` sends it to all executors if its
    estimated size allows, and sort-merges otherwise. Fields of different types
    raise. NaN keys are equal unless ``nan_equal`` is off.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy must be one of {STRATEGIES}")
    kinds = r.kind(r_field), s.kind(s_field)
    if kinds[0] != kinds[1]:
        raise TypeError(f"{r.name}.{r_field} is {kinds[0]}, {s.name}.{s_field} is {kinds[1]}")
    if kinds[0] == "float" and not nan_equal:
        r = Table(r.name, r.df.filter(~F.isnan(column(r_field))))
    names = joined_fields(r, s)
    n = len(r.fields)
    left, right = r.df.toDF(*names[:n]), s.df.toDF(*names[n:])
    if strategy == "broadcast":
        left = F.broadcast(left) if estimated_bytes(r) <= BROADCAST_BYTES else left.hint("merge")
    elif strategy != "auto":
        left = left.hint(strategy)
    on = column(names[r.fields.index(r_field)]) == column(names[n + s.fields.index(s_field)])
    return Table(f"join({r.name}.{r_field} = {s.name}.{s_field})", left.join(right, on))


def hybrid_join(r: Table, s: Table, r_field: str, s_field: str, in_memory_fraction: float, partitions: int, bloom: bool = False) -> Table:
    """The same join with both tables partitioned on the key.

    Spark decides itself what stays in memory, so the fraction is only checked;
    ``partitions`` sets the exchange. ``bloom`` reduces s to rows whose key r has before
    it is shuffled: by r's keys themselves, broadcast if their estimated size allows,
    else that is left to Spark's own runtime filter.
    """
    if not 0 < in_memory_fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    if not 0 < partitions <= _MOST_PARTITIONS:
        raise ValueError(f"partitions must be in 1..{_MOST_PARTITIONS}")
    if bloom and r.kind(r_field) == s.kind(s_field):
        key = "key"
        while key in s.fields:
            key += "_"
        keys = Table(r.name, r.df.select(column(r_field).alias(key)).distinct())
        if estimated_bytes(keys) <= BROADCAST_BYTES:
            s = Table(s.name, s.df.join(F.broadcast(keys.df), column(s_field) == column(key), "left_semi"))
    r = Table(r.name, r.df.repartition(partitions, column(r_field)))
    s = Table(s.name, s.df.repartition(partitions, column(s_field)))
    return hash_join(r, s, r_field, s_field, "shuffle_hash")
