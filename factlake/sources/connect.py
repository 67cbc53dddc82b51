"""Connection settings: object stores, log stores and loggers. Secrets become configuration and are never logged."""

from __future__ import annotations

import logging
import os
from typing import Any

from pyspark.sql import SparkSession

from factlake.sources.lake import Lake, normal_root
from factlake.sources.log import LogStoreType
from factlake.sources.stores import TABLE, Database


def s3_default_chain(region: str | None = None, endpoint: str | None = None) -> dict[str, str]:
    """Hadoop settings for credentials from the environment's default chain."""
    return _without_nulls({"fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider", "fs.s3a.endpoint.region": region, "fs.s3a.endpoint": endpoint})


def s3_explicit(key: str, secret: str, token: str | None = None, region: str | None = None, endpoint: str | None = None, path_style: bool | None = None) -> dict[str, str]:
    return _without_nulls(
        {
            "fs.s3a.access.key": key,
            "fs.s3a.secret.key": secret,
            "fs.s3a.session.token": token,
            "fs.s3a.endpoint.region": region,
            "fs.s3a.endpoint": endpoint,
            "fs.s3a.path.style.access": None if path_style is None else str(path_style).lower(),
        }
    )


def postgres_options(dbname: str, host: str | None = None, port: int | None = None, user: str | None = None, password: str | None = None) -> dict[str, str]:
    """JDBC options; what is left out falls back to the driver's defaults."""
    where = f"//{host or 'localhost'}{f':{port}' if port else ''}/{dbname}"
    return _without_nulls({"url": f"jdbc:postgresql:{where}", "user": user, "password": password, "driver": "org.postgresql.Driver"})


def _without_nulls(options: dict[str, Any]) -> dict[str, str]:
    return {k: str(v) for k, v in options.items() if v is not None}


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in settings.items():
        conf.set(name, value)
    logging.getLogger("factlake").info("applied settings %s", sorted(settings))


def connect(
    spark: SparkSession, root: str, store: LogStoreType = LogStoreType.FILE, settings: dict[str, str] | None = None, schema: str | None = None, database: dict[str, str] | None = None, table: str = TABLE, **options: Any
) -> Lake:
    """A lake at ``root``; with ``schema``, its levels are created (unless the lake is read-only).

    With ``LogStoreType.JDBC`` its log is in a table behind ``database``, the options of postgres_options() or of any other JDBC driver.
    """
    if settings:
        apply_settings(spark, settings)
    if (store is LogStoreType.JDBC) != (database is not None):
        raise ValueError("a log in a database needs its options, and only that does")
    lake = Lake(spark, root, store=Database(spark, database, normal_root(root), table) if database else None, **options)
    if schema and not lake.read_only:
        lake.create_schema(schema)
    return lake


def init_logger(name: str = "factlake", path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The named logger, with one file handler however often it is asked for (by default logs/<name>.log)."""
    logger = logging.getLogger(name)
    target = os.path.abspath(path or os.path.join(os.getcwd(), "logs", f"{name}.log"))
    if not any(getattr(h, "baseFilename", None) == target for h in logger.handlers):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        handler = logging.FileHandler(target)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
