"""Typed registry load (explicit schemas, no inference) and idempotent table writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh.schemas import model_schemas

SUPPLIED = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def load_supplied(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SUPPLIED[name]).parquet(f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType] | None = None,
                names=None) -> dict[str, DataFrame]:
    """Read ``folder/<table>`` for every table in the registry with its declared schema."""
    schemas = schemas or model_schemas()
    return {
        name: spark.read.schema(schemas[name]).parquet(f"{folder}/{name}")
        for name in (names or schemas)
    }


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` plus those of ``new`` whose natural key is not there yet.

    Repeated keys inside ``new`` keep one row, the smallest over all columns, so a replay gives the same result.
    """
    fresh = new.join(target.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return target.unionByName(one.select(*keys, "_row.*").select(*new.columns), allowMissingColumns=True)


def replace_rules(new: DataFrame, path: str, partition: str | None = None) -> None:
    """Whole-table replacement of a rule set, or of the partitions ``new`` holds.

    Written in place; ``commit_replacement`` never shows readers a table that is half there.
    """
    writer = new.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append-only audit sink; rows are sealed first, see ``operators.seal``. ``commit_append`` takes a repeated job once."""
    rows.write.mode("append").parquet(path)


# --- tables with commits: data folders that count once a commit names them -----------------------------

COMMIT = "number BIGINT, batch STRING, replaces BOOLEAN, folder STRING"


def _commits(spark: SparkSession, path: str) -> list:
    """The commits in order; one small row for every batch ever written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema(COMMIT).parquet(f"{path}/commits/*").orderBy("number").collect()


def _commit(rows: DataFrame, path: str, batch: str, replaces: bool) -> bool:
    """Write ``rows`` to a folder of their own and then name it in a commit; false if ``batch`` was committed before.

    The commit is written aside and renamed, so it is there as a whole or not at all; a job that fails before that
    leaves a folder nothing reads. Writers of one table take turns.
    """
    spark = rows.sparkSession
    done = _commits(spark, path)
    if any(c["batch"] == batch for c in done):
        return False
    folder, number = f"data/{uuid.uuid4().hex}", (done[-1]["number"] + 1 if done else 0)
    rows.write.parquet(f"{path}/{folder}")
    aside = f"{path}/aside/{uuid.uuid4().hex}"
    spark.createDataFrame([(number, batch, replaces, folder)], COMMIT).coalesce(1).write.parquet(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(f"{path}/commits"))
    if not files.rename(hadoop.Path(aside), hadoop.Path(f"{path}/commits/{number:012d}")):
        raise OSError(f"commit {number} of {path} was not possible")
    return True


def commit_append(rows: DataFrame, path: str, batch: str) -> bool:
    """Append ``rows`` once under the name ``batch``: a job that is repeated adds nothing. Whether it was added."""
    return _commit(rows, path, batch, False)


def commit_replacement(rows: DataFrame, path: str, batch: str) -> bool:
    """Let ``rows`` stand for all rows before; readers see the old table until the new one is whole."""
    return _commit(rows, path, batch, True)


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table as committed: the last replacement and what was appended since; empty before the first commit."""
    commits = _commits(spark, path)
    first = max((n for n, c in enumerate(commits) if c["replaces"]), default=0)
    folders = [f"{path}/{c['folder']}" for c in commits[first:]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def object_key(org, case, doc, version):
    """Storage path ``org/case/doc/v<version>`` of one document version."""
    return F.concat_ws("/", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                              for c in (org, case, doc)),
                       F.concat(F.lit("v"), (F.col(version) if isinstance(version, str) else version).cast("string")))


def write_by_case(docs: DataFrame, path: str) -> None:
    """Write documents under ``org_id=/case_id=`` folders.

    Ranges over (org, case, document) keep a folder's rows together while splitting a very large case over
    several tasks.
    """
    docs.repartitionByRange("org_id", "case_id", "doc_id").write.mode("append").partitionBy("org_id", "case_id").parquet(path)


def export_cohort(cohort: DataFrame, path: str) -> None:
    """De-identified cohort as quoted CSV with a header."""
    cohort.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
