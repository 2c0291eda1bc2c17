"""Shared helpers of the training-data operators: scratch tables, text rules, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The white space of every contract: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a missing doc_id where ids are compared or ordered; missing ids count as one document, below all others.
NO_ID = -(2**63)


def store(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no rework before it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_none(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; a missing text is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), with columns of `docs` whose names begin with __, as the operators' own do, under free names meanwhile."""
    theirs = [c for c in docs.columns if c.startswith("__")]
    free = "theirs"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    names = {c: f"{free}{i}" for i, c in enumerate(theirs)}
    done = work(docs.withColumnsRenamed(names))
    return done.withColumnsRenamed({new: old for old, new in names.items()})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_by_hash(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first `n` rows in the order of a 32-bit hash of `keys`, a sample that is the same however the rows are dealt.

    Rows beyond twice the share that is needed are left out before the sort, so the tasks together send about 2 n rows,
    whatever the number of tasks.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 32))
    share = 2 * n / max(1, rows.count())
    near = rows if share > 0.5 else rows.where(place < F.lit(int(share * (1 << 32))))
    return near.orderBy(place, *keys).limit(n)
