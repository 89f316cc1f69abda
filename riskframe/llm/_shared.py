"""What the operators share: tables in the shared folder, ASCII case folding, wide keys."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def scratch_root(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and the master is local (tests) a local one is made and set."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="riskframe-"))
        root = context.getCheckpointDir()
    return f"{qualified(spark, root).rstrip('/')}/riskframe-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other letters stay."""
    return F.translate(text, UPPER, LOWER)


def known_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Select wanted columns under the given names; other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{have}`").alias(name) for name, have in wanted.items()])


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df, whose column of ids must hold whole numbers: another type raises before any work is done."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"ids must be whole numbers: {column} is {kind.simpleString()}")
    return df


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as it takes to differ from the taken ones (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, uri: str) -> str:
    """The URI with its scheme: a plain path is one of the cluster's default file system, which need not be the local one."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return uri
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def local_path(uri: str) -> str | None:
    """The path of a file: URI, which every machine sees if the folder is shared, or of a plain one; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None
