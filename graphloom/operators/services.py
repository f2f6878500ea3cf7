"""Services resolved from infrastructure resources and their wiring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resource types that are services of their own (fixed values).
SERVICE_TYPES = (
    "aws_lambda_function", "aws_ecs_service", "aws_apprunner_service", "aws_instance",
    "google_cloud_run_service", "google_cloud_run_v2_service", "google_cloudfunctions_function", "google_cloudfunctions2_function",
    "azurerm_function_app", "azurerm_linux_function_app", "azurerm_container_app",
)
#: Resource types that are stores (fixed values).
STORE_TYPES = (
    "aws_s3_bucket", "aws_dynamodb_table", "aws_rds_cluster", "aws_db_instance", "aws_elasticache_cluster",
    "aws_elasticache_replication_group", "aws_efs_file_system", "aws_secretsmanager_secret", "aws_ssm_parameter",
    "google_storage_bucket", "google_sql_database_instance", "google_bigquery_dataset", "google_firestore_database",
    "azurerm_storage_account", "azurerm_cosmosdb_account", "azurerm_mssql_database",
)
#: Wiring resources (fixed values): type, shape, two attributes, edge kind.
WIRING = (
    ("aws_lambda_event_source_mapping", "channel", "event_source_arn", "function_name", "queue"),
    ("aws_sns_topic_subscription", "channel", "topic_arn", "endpoint", "event"),
    ("aws_api_gateway_integration", "direct", "rest_api_id", "uri", "http"),
    ("aws_apigatewayv2_integration", "direct", "api_id", "integration_uri", "http"),
)


def assign(resources: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Add ``service``: a configured one, else the module, else itself if it is a service; stores and glue have none.

    ``resources``: (address, type, name, module); ``configured``: (address, service).
    """
    rows = resources if configured is None else resources.join(configured.withColumnRenamed("service", "given"), "address", "left")
    given = F.col("given") if configured is not None else F.lit(None).cast("string")
    store = F.col("type").isin(*STORE_TYPES)
    own = F.coalesce(given, F.when(~store, F.coalesce("module", F.when(F.col("type").isin(*SERVICE_TYPES), F.col("address")))))
    return rows.select("address", "type", "name", "module", own.alias("service"), (store & given.isNull()).alias("is_store"))


def _attribute(assigned: DataFrame, refs: DataFrame, kind: str, attr: str, name: str) -> DataFrame:
    wires = assigned.filter(F.col("type") == kind).select("address")
    return refs.filter(F.split_part("attr", F.lit("."), F.lit(-1)) == attr).join(wires, "address").select("address", F.col("ref_address").alias(name))


def wired(assigned: DataFrame, refs: DataFrame, rules: tuple = WIRING) -> DataFrame:
    """(source, target, kind, via) of typed wiring. Direct: between the services of both attributes.
    Channel: from every service that references the channel to the consumer, ``via`` the channel."""
    home = assigned.filter("service is not null").select("address", "service")
    of = lambda end, name: home.select(F.col("address").alias(end), F.col("service").alias(name))
    wiring = [r[0] for r in rules]
    producers = refs.join(assigned.filter(~F.col("type").isin(*wiring)).select("address"), "address", "left_semi").join(of("address", "source"), "address").select(F.col("ref_address").alias("first"), "source")
    out = None
    for kind, shape, first, second, edge in rules:
        ends = _attribute(assigned, refs, kind, first, "first").join(_attribute(assigned, refs, kind, second, "second"), "address").join(of("second", "target"), "second")
        if shape == "direct":
            found = ends.join(of("first", "source"), "first").withColumn("via", F.lit(None).cast("string"))
        else:
            found = ends.join(producers, "first").withColumn("via", F.col("first"))
        found = found.filter("source <> target").select("source", "target", F.lit(edge).alias("kind"), "via")
        out = found if out is None else out.unionByName(found)
    return out


def service_edges(assigned: DataFrame, refs: DataFrame, rules: tuple = WIRING) -> DataFrame:
    """(source, target, kind, weight): typed wiring, and ``depends`` for other references across services.

    ``refs``: (address, attr, ref_address). A typed edge supersedes ``depends`` of the same pair.
    """
    typed = wired(assigned, refs, rules)
    home = assigned.filter("service is not null").select("address", "service")
    a, b = home.select("address", F.col("service").alias("source")), home.select(F.col("address").alias("ref_address"), F.col("service").alias("target"))
    plain = refs.join(a, "address").join(b, "ref_address").filter("source <> target").select("source", "target", F.lit("depends").alias("kind"))
    weighed = typed.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("weight"))
    rest = plain.join(typed.select("source", "target").distinct(), ["source", "target"], "left_anti").groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("weight"))
    return weighed.unionByName(rest)


def store_edges(assigned: DataFrame, refs: DataFrame) -> DataFrame:
    """(service, store) pairs, each once."""
    home = assigned.filter("service is not null").select("address", "service")
    stores = assigned.filter("is_store").select(F.col("address").alias("ref_address"))
    return refs.join(stores, "ref_address").join(home, "address").select("service", F.col("ref_address").alias("store")).distinct()


def resource_code(file_service: DataFrame, files: DataFrame) -> DataFrame:
    """(service, loc, files): Σ LoC of each service's files."""
    return file_service.join(files, "path").groupBy("service").agg(F.sum("loc").cast("long").alias("loc"), F.count(F.lit(1)).alias("files"))
