"""What stateful stream operators share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trajlake.session import DEFAULTS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def require_rocksdb(spark: SparkSession) -> None:
    """Raise an error unless the session keeps stream state in RocksDB, as ``build_session`` sets it."""
    if spark.conf.get(PROVIDER, None) != DEFAULTS[PROVIDER]:
        raise ValueError(f"set {PROVIDER} to {DEFAULTS[PROVIDER]}")
