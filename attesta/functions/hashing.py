"""Content and record digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def record_hash(**fields: Column) -> Column:
    """Digest of a record: keys sorted, absent values dropped."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def storage_key(owner: Column, digest: Column) -> Column:
    return F.concat_ws("/", owner, F.substring(digest, 1, 2), digest)
