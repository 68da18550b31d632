"""Reading tables and files, and writing results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTED_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("rule_code", T.StringType()), T.StructField("level", T.StringType()),
        T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("embedding_text", T.StringType()),
        T.StructField("parent_path", T.ArrayType(T.StringType())), T.StructField("token_count", T.IntegerType()),
        T.StructField("keywords", T.ArrayType(WEIGHTED_TERM)), T.StructField("is_searchable", T.BooleanType()),
        T.StructField("doc_type", T.StringType()), T.StructField("effective_date", T.StringType()), T.StructField("status", T.StringType()),
    ]
)
FEEDBACK = "timestamp string, query string, result_id string, rule_code string, rating int, comment string, matched_intents array<string>, rewritten_query string"


def node_schema(depth: int = 4) -> T.StructType:
    """Schema of a tree node with so many levels of children below it; what lies deeper is kept as JSON text."""
    fields = [
        T.StructField(n, k)
        for n, k in (
            ("id", T.StringType()), ("type", T.StringType()), ("display_no", T.StringType()), ("title", T.StringType()), ("text", T.StringType()),
            ("embedding_text", T.StringType()), ("is_searchable", T.BooleanType()), ("metadata", T.MapType(T.StringType(), T.StringType())),
        )
    ]
    fields.append(T.StructField("children", T.ArrayType(node_schema(depth - 1)) if depth else T.StringType()))
    return T.StructType(fields)


def document_schema(depth: int = 4) -> T.StructType:
    nodes = T.ArrayType(node_schema(depth))
    return T.StructType(
        [
            T.StructField("docs", T.ArrayType(T.StructType([
                T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("doc_type", T.StringType()), T.StructField("rule_code", T.StringType()),
                T.StructField("status", T.StringType()), T.StructField("is_index_duplicate", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
                T.StructField("content", nodes), T.StructField("addenda", nodes),
            ])))
        ]
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than that, as a file of a single row group; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may name none; it gets a temporary one."""
    told, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not told and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return told or "file://" + tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows does not compute it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def read_documents(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """One row per document of document JSON files: index pages and documents without a code are skipped."""
    docs = spark.read.schema(document_schema(depth)).option("multiLine", True).json(path).select(F.inline("docs"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    code = F.coalesce(blank(F.col("rule_code")), blank(F.col("metadata")["rule_code"]), blank(F.get("content", F.lit(0))["metadata"]["rule_code"]), blank(F.col("id")))
    kept = ~F.coalesce("is_index_duplicate", F.lit(False)) & ~F.coalesce("doc_type", F.lit("")).isin("toc", "index_alpha", "index_dept", "index")
    return docs.withColumn("rule_code", code).where(kept & F.col("rule_code").isNotNull())


def flatten_nodes(docs: DataFrame, depth: int = 4) -> DataFrame:
    """(rule_code, position array<int>, level, id, type, title, text): nodes in pre-order by position, content before addenda.

    Trees of any depth: every ``depth`` levels, what is left as JSON text is read by the same schema, until nothing is left.
    """
    level = docs.select("rule_code", F.posexplode(F.concat(F.coalesce("content", F.array()), F.coalesce("addenda", F.array()))).alias("p", "node")).select("rule_code", F.array("p").alias("position"), "node")
    out, n = None, 1
    while True:
        part = level.select("rule_code", "position", F.lit(n).alias("level"), "node.id", "node.type", "node.title", "node.text", F.coalesce("node.is_searchable", F.lit(True)).alias("is_searchable"))
        out, n = part if out is None else out.unionByName(part), n + 1
        children = F.col("node.children")
        if isinstance(level.schema["node"].dataType["children"].dataType, T.StringType):
            level = level.where(F.length(children) > 2)
            if level.isEmpty():
                return out
            children = F.from_json(children, T.ArrayType(node_schema(depth)))
        level = level.select("rule_code", "position", F.posexplode(children).alias("p", "node")).select("rule_code", F.concat("position", F.array("p")).alias("position"), "node")


def read_json_lines(spark: SparkSession, path: str, schema: str = FEEDBACK) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite", format: str = "parquet") -> None:
    writer = df.write.mode(mode).format(format)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def upsert(store: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``store`` with the rows whose key is in ``rows`` replaced; of equal keys in ``rows`` the caller keeps one."""
    return store.join(rows.select(*key), key, "left_anti").unionByName(rows)
