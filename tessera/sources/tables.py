"""Scans and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType() if v is str else v) for k, v in fields.items()])


#: Schemas of the raw records; read with these, never inferred.
RAW = {
    "clinicaltrials": _s(
        protocolSection=_s(
            identificationModule=_s(nctId=str, briefTitle=str, officialTitle=str), descriptionModule=_s(briefSummary=str), sponsorCollaboratorsModule=_s(leadSponsor=_s(name=str)),
            contactsLocationsModule=_s(locations=T.ArrayType(_s(facility=str))),
        ), _source_url=str, _retrieved_date=str,
    ),
    "uspto": _s(patent_id=str, patent_title=str, patent_abstract=str, inventors=STRINGS, assignees=STRINGS, cpc_codes=STRINGS, pharma_keywords=STRINGS, _source_url=str, _retrieved_date=str),
    "openalex": _s(
        id=str, title=str, abstract_inverted_index=T.MapType(T.StringType(), T.ArrayType(T.IntegerType())),
        authorships=T.ArrayType(_s(author=_s(display_name=str), institutions=T.ArrayType(_s(display_name=str)))), concepts=T.ArrayType(_s(display_name=str)), _retrieved_date=str,
    ),
    "sbir": _s(award_id=str, award_title=str, abstract=str, firm=str, pi_name=str, _source_url=str, _retrieved_date=str),
    "autm": _s(listing_id=str, tech_title=str, description=str, university=str, inventors=STRINGS, _source_url=str, _retrieved_date=str),
}
QRELS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("relevant_doc_ids", STRINGS)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, folder: str, sources: list[str] | None = None) -> dict[str, DataFrame]:
    """JSON lines by source; a source without a folder or file is left out."""
    out = {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for source in sources or list(RAW):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{source}.jsonl")
        if path.getFileSystem(conf).exists(path):
            out[source] = spark.read.schema(RAW[source]).option("mode", "FAILFAST").json(path.toString())
    return out


def stamped(df: DataFrame, day: str) -> DataFrame:
    """_retrieved_date filled with the given day where it is absent."""
    have = F.col("_retrieved_date") if "_retrieved_date" in df.columns else F.lit(None).cast("string")
    return df.withColumn("_retrieved_date", F.coalesce(have, F.lit(day)))


#: The one schema of records.
DOCUMENT = T.StructType(
    [T.StructField(f, T.StringType()) for f in ("doc_id", "source", "title", "abstract")]
    + [T.StructField(f, STRINGS) for f in ("inventors", "organizations", "experts", "facilities", "cpc_codes", "keywords")]
    + [T.StructField(f, T.StringType()) for f in ("source_url", "retrieved_date", "embedding_text")]
    + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
NODES = T.StructType([T.StructField(f, T.StringType()) for f in ("node_id", "ntype", "label", "doc_id")])
EDGES = T.StructType([T.StructField(f, T.StringType()) for f in ("src", "dst", "rel")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped, a line that does not parse raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Records in DOCUMENT; a field that it does not have, or a record without doc_id, raises when read."""
    named = ", ".join(f"'{f.name}'" for f in DOCUMENT)
    lines = spark.read.text(path).filter("trim(value) <> ''")
    odd = F.expr(f"array_except(json_object_keys(value), array({named}))")
    got = lines.select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d"), odd.alias("odd"))
    good = F.when(F.coalesce(F.size("odd"), F.lit(1)) != 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join("odd", ", "))))
    good = good.when(F.col("d.doc_id").isNull(), F.raise_error(F.lit("a record without doc_id"))).otherwise(F.col("d"))
    return got.select(good.alias("d")).select("d.*")


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines, keys sorted; replaces what is there. Gives the number of records."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, QRELS)


def write_qrels(queries: DataFrame, path: str) -> int:
    """(query_id, query, relevant_doc_ids) as JSON lines; query_id as text."""
    return write_jsonl(queries.select(F.col("query_id").cast("string").alias("query_id"), "query", F.col("relevant_doc_ids").cast(STRINGS).alias("relevant_doc_ids")), path)


def write_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame, folder: str) -> dict[str, int]:
    """nodes, edges and the counts (kind, name, n) of a graph under a folder."""
    have = [f.name for f in NODES if f.name in nodes.columns]
    counts = {"nodes": write_jsonl(nodes.select(have), f"{folder}/nodes"), "edges": write_jsonl(edges.select(EDGES.names), f"{folder}/edges")}
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")  # a row a type and relation
    return counts


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_jsonl(spark, f"{folder}/nodes", NODES), read_jsonl(spark, f"{folder}/edges", EDGES)


def manifest(products: DataFrame) -> DataFrame:
    """(product, file, uri, bytes) of product records with bags of files; products: (product, bags: array<struct<files: array<struct<name, uri, size>>>>)."""
    files = products.select("product", F.explode("bags").alias("b")).select("product", F.explode("b.files").alias("f"))
    return files.select("product", F.col("f.name").alias("file"), F.col("f.uri").alias("uri"), F.coalesce(F.col("f.size").cast("long"), F.lit(0)).alias("bytes"))


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("bytes"))
