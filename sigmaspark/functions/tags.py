"""Tag maps (string to string) as column expressions; keys compare by their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove(tags: Column, *keys: str) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*keys))


def put(tags: Column, key: str, value: Column) -> Column:
    """Set a key; a null value removes it."""
    rest = F.map_filter(tags, lambda k, v: k != key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))


def merge(dest: Column, src: Column, overwrite: bool = True) -> Column:
    """All keys of both; of a key in both, the value of ``src`` only if ``overwrite``."""
    win, lose = (src, dest) if overwrite else (dest, src)
    return F.map_concat(F.map_filter(lose, lambda k, v: ~F.map_contains_key(win, k)), win)


def in_order(tags: Column) -> Column:
    """Entries by key."""
    return F.array_sort(F.map_entries(tags))
