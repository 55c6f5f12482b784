"""The engine's tables as views of star-schema tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by ``key`` over four tasks a core: a narrow table lies in few pieces, and much work on each row would stay in as few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per line item: its order is the document, its part the subject, written in four ways."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    x = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    way = F.pmod(F.col("l_suppkey"), F.lit(4))
    head, tail = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    subject = (F.when(way == 0, F.col("p_name")).when(way == 1, F.concat_ws(" ", head, F.lit("Q."), tail))
               .when(way == 2, F.concat(F.col("p_name"), F.lit(" Jr."))).otherwise(F.upper("p_name")))
    kind = F.when(F.col("l_returnflag") == "A", "person_death_date").when(F.col("l_returnflag") == "R", "person_birth_date").otherwise("relationship")
    return x.select(
        F.col("l_orderkey").alias("document_id"), kind.alias("fact_type"), subject.alias("subject_name"),
        F.when(F.col("l_linenumber") == 1, "deceased_primary").otherwise("child").alias("subject_role"),
        F.col("p_type").alias("fact_value"),
        F.when(F.col("l_quantity") > 25, F.col("p_brand")).alias("related_name"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).otherwise("").alias("relationship_type"),
        (F.lit(1) - F.col("l_discount")).cast("decimal(3,2)").alias("confidence_score"),
        F.col("l_suppkey").alias("entity_id"),
        F.when(F.pmod(F.col("l_suppkey"), F.lit(3)) == 0, F.concat(F.lit("I"), F.col("l_suppkey").cast("string"))).alias("registry_person_id"),
        F.when(F.col("l_linestatus") == "O", "unresolved").otherwise("clustered").alias("resolution_status"))


#: The same in SQL, to open a query with.
CLAIMS_SQL = """WITH claims AS (
  SELECT l_orderkey AS document_id,
    CASE l_returnflag WHEN 'A' THEN 'person_death_date' WHEN 'R' THEN 'person_birth_date' ELSE 'relationship' END AS fact_type,
    CASE l_suppkey % 4 WHEN 0 THEN p_name
      WHEN 1 THEN split_part(p_name, ' ', 1) || ' Q. ' || split_part(p_name, ' ', -1)
      WHEN 2 THEN p_name || ' Jr.' ELSE upper(p_name) END AS subject_name,
    CASE WHEN l_linenumber = 1 THEN 'deceased_primary' ELSE 'child' END AS subject_role,
    p_type AS fact_value, CASE WHEN l_quantity > 25 THEN p_brand END AS related_name,
    CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE '' END AS relationship_type,
    CAST(1 - l_discount AS DECIMAL(3,2)) AS confidence_score, l_suppkey AS entity_id,
    CASE WHEN l_suppkey % 3 = 0 THEN 'I' || CAST(l_suppkey AS VARCHAR) END AS registry_person_id,
    CASE WHEN l_linestatus = 'O' THEN 'unresolved' ELSE 'clustered' END AS resolution_status
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://docs.example/"), F.col("o_orderkey").cast("string")).alias("url"),
        status.alias("processing_status"), F.col("o_orderdate").alias("fetch_timestamp"))


DOCUMENTS_SQL = """documents_of AS (
  SELECT o_orderkey AS id, 'https://docs.example/' || CAST(o_orderkey AS VARCHAR) AS url,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS processing_status,
    o_orderdate AS fetch_timestamp FROM orders)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation per event: users are registry persons, every seventh id a document."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") * 7).alias("document_id"),
        F.pmod(F.col("event_id"), F.lit(97)).alias("entity_id"), F.concat(F.lit("I"), F.col("user_id").cast("string")).alias("registry_person_id"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) > 0, F.concat(F.lit("Notice "), F.col("event_type"))).alias("document_name"),
        F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "very_high", "odd"))), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int")).alias("confidence"),
        F.col("ts").alias("created_timestamp"))


CITATIONS_SQL = """citations_of AS (
  SELECT event_id AS id, event_id * 7 AS document_id, event_id % 97 AS entity_id, 'I' || CAST(user_id AS VARCHAR) AS registry_person_id,
    CASE WHEN event_id % 3 > 0 THEN 'Notice ' || event_type END AS document_name,
    ['low', 'medium', 'high', 'very_high', 'odd'][event_id % 5 + 1] AS confidence, ts AS created_timestamp FROM events)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with an id, one per event: users are the documents, event types and hours the names."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("person_name", "person_nickname", "maiden_name", "relationship"))), (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), kind.alias("fact_type"),
        F.concat(F.col("event_type"), F.lit(" "), F.pmod(F.col("event_id"), F.lit(7)).cast("string")).alias("subject_name"),
        F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, "deceased_primary").otherwise("child").alias("subject_role"),
        F.concat(F.lit("v"), F.pmod(F.col("event_id"), F.lit(3)).cast("string")).alias("fact_value"),
        F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, F.col("event_type")).alias("related_name"),
        F.lit("").alias("relationship_type"), F.pmod(F.col("event_id"), F.lit(97)).alias("entity_id"),
        F.lit("0.90").cast("decimal(3,2)").alias("confidence_score"))


MENTIONS_SQL = """mentions AS (
  SELECT event_id AS id, user_id AS document_id,
    ['person_name', 'person_nickname', 'maiden_name', 'relationship'][event_id % 4 + 1] AS fact_type,
    event_type || ' ' || CAST(event_id % 7 AS VARCHAR) AS subject_name,
    CASE WHEN event_id % 5 = 0 THEN 'deceased_primary' ELSE 'child' END AS subject_role,
    'v' || CAST(event_id % 3 AS VARCHAR) AS fact_value, CASE WHEN event_id % 2 = 0 THEN event_type END AS related_name,
    '' AS relationship_type, event_id % 97 AS entity_id, CAST(0.90 AS DECIMAL(3,2)) AS confidence_score FROM events)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry people from parts: the first word of the name is given, the last the surname."""
    p = table(spark, sf_dir, "part")
    name = F.struct(F.initcap(F.substring_index("p_name", " ", 1)).alias("given"), F.array(F.initcap(F.substring_index("p_name", " ", -1))).alias("surnames"))
    none = F.expr("cast(array() as array<struct<given:string,surnames:array<string>>>)")
    return p.select(
        F.concat(F.lit("I"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("registry_id"), F.col("p_partkey").cast("string").alias("handle"),
        F.lit(1).alias("gender"), name.alias("primary_name"), none.alias("alternate_names"),
        F.array(F.concat(F.lit("e"), F.col("p_partkey").cast("string")), F.concat(F.lit("e"), (F.col("p_partkey") * 3).cast("string"))).alias("event_refs"))


def registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry events, one per customer: births and deaths with partial dates."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("e"), k.cast("string")).alias("handle"), F.when(F.pmod(k, F.lit(2)) == 0, "Birth").otherwise("Death").alias("type"),
        F.array(F.pmod(k, F.lit(29)), F.pmod(k, F.lit(13)), F.when(F.pmod(k, F.lit(11)) > 0, 1900 + F.pmod(k, F.lit(100))).otherwise(F.lit(0))).cast("array<int>").alias("dateval"),
        F.col("c_mktsegment").alias("place"))
