"""Spans, arrivals and payloads made from the star-schema test tables.

span_reports: an order is a trace. Its root span comes from `orders`, with span id 0 and so not
valid where the order is pending; each lineitem is one report of span order*16 + line, below order*16 + line/2. Line
numbers repeat and have gaps, so there are duplicate reports and missing parents. Reports
with return flag R keep their clock before 2020; the others are moved on by 30 years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.numbers import format_id
from spanloom.schema import SPAN_COLUMNS

SHIFT_NS = 10_950 * 86_400 * 1_000_000_000
DAY_US = 86_400 * 1_000_000
HOUR_US = 3_600 * 1_000_000
WRITERS = 96  # tasks that write many small files
SHELVES = 16  # folders that they are in


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timestamp(name: str) -> Column:
    return F.col(name).cast("timestamp")


def _long(c: Column) -> Column:
    return c.cast("bigint")


def lineitem_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order = _long(F.col("l_linenumber")), F.col("l_orderkey")
    at = F.unix_micros(_timestamp("l_shipdate"))
    start = at * 1000 + F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.lit(SHIFT_NS))
    length = F.when(F.col("l_quantity") == 1, F.lit(500)).otherwise(
        _long(F.col("l_quantity")) * 1_000_000
    )
    role = (F.col("l_partkey") + F.col("l_suppkey")) % 4  # 0 client, 1 server, 2 both, 3 none
    ahead = (F.col("l_suppkey") % 7 - 3) * 1_000_001
    client, server = role.isin(0, 2), role.isin(1, 2)
    s, d, a = F.col("start_ns"), F.col("duration_ns"), F.col("ahead")
    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    error = (
        F.when(F.col("l_discount") == 0, "0")
        .when(F.col("l_discount") == 0.01, "false")
        .when(F.col("l_discount") == 0.02, "")
        .when(F.col("l_discount") == 0.03, "timeout")
    )
    tags = F.filter(
        F.array(
            entry("flag", F.col("l_returnflag")),
            entry("part", (F.col("l_partkey") % 100).cast("string")),
            entry("error", error),
        ),
        lambda t: t["value"].isNotNull(),
    )
    zero = F.lit(0).cast("bigint")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            order.alias("trace_id"),
            (order * 16 + line).alias("span_id"),
            (order * 16 + F.call_function("div", line, F.lit(2).cast("bigint"))).alias("parent_id"),
            F.when(F.col("l_tax") == 0, "")
            .otherwise(F.concat(F.lit("line-"), line, F.lit("-"), F.col("l_linestatus")))
            .alias("name"),
            F.when(F.col("l_tax") == 0.01, "")
            .otherwise(F.concat(F.lit("supplier-"), F.col("l_suppkey") % 10))
            .alias("service"),
            start.alias("start_ns"), _long(length).alias("duration_ns"),
            _long(ahead).alias("ahead"), client.alias("client"), server.alias("server"),
            F.map_from_entries(tags).alias("tags"),
            _timestamp("l_shipdate").alias("received_at"),
            F.col("l_partkey").alias("payload_id"), F.col("l_suppkey").alias("pos"),
        )
        .select(
            "*",
            F.when(F.col("client"), s).otherwise(zero).alias("cs"),
            F.when(F.col("client"), s + d).otherwise(zero).alias("cr"),
            F.when(F.col("server"), s + d + a).otherwise(zero).alias("ss"),
            F.when(F.col("server"), s + a).otherwise(zero).alias("sr"),
        )
        .select(*SPAN_COLUMNS)
    )


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, zero = F.col("o_orderkey"), F.lit(0).cast("bigint")
    at = F.unix_micros(_timestamp("o_orderdate"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            order.alias("trace_id"),
            F.when(F.col("o_orderstatus") == "P", zero).otherwise(order * 16).alias("span_id"),
            zero.alias("parent_id"),
            F.concat(F.lit("order-"), "o_orderstatus").alias("name"),
            F.concat(F.lit("customer-"), F.col("o_custkey") % 10).alias("service"),
            (at * 1000 + F.lit(SHIFT_NS)).alias("start_ns"),
            F.lit(2_000_000_000).cast("bigint").alias("duration_ns"),
            *[zero.alias(c) for c in ("cs", "cr", "ss", "sr")],
            F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("tags"),
            _timestamp("o_orderdate").alias("received_at"),
            F.lit(-1).cast("bigint").alias("payload_id"), zero.alias("pos"),
        )
        .select(*SPAN_COLUMNS)
    )


def span_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_reports(spark, sf_dir).unionByName(lineitem_reports(spark, sf_dir))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a trace id, an event is a span. Ids start at 0, so some are invalid."""
    zero = F.lit(0).cast("bigint")
    at = F.unix_micros(_timestamp("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"),
        F.call_function("div", F.col("event_id"), F.lit(2).cast("bigint")).alias("parent_id"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("user-"), F.col("user_id") % 10).alias("service"),
        (at * 1000).alias("start_ns"),
        _long(F.round(F.col("value") * 1000) * 1000).alias("duration_ns"),
        *[zero.alias(c) for c in ("cs", "cr", "ss", "sr")],
        F.create_map(F.lit("props"), F.col("props")).alias("tags"),
        _timestamp("ts").alias("received_at"),
        F.col("event_id").alias("payload_id"), zero.alias("pos"),
    )


# --- payloads --------------------------------------------------------------------------


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per lineitem; ids as hex text, times in microseconds."""
    number = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 8 + F.col("l_linenumber")
    at = F.unix_micros(_timestamp("l_shipdate")) + F.lit(SHIFT_NS // 1000)
    line = _long(F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        "*",
        _long(number).alias("payload_id"),
        _timestamp("l_shipdate").alias("received_at"),
        format_id(F.col("l_orderkey")).alias("trace"),
        format_id(F.col("l_orderkey") * 16 + line).alias("span"),
        format_id(
            F.col("l_orderkey") * 16 + F.call_function("div", line, F.lit(2).cast("bigint"))
        ).alias("parent"),
        at.alias("at_us"),
        _long(F.col("l_quantity") * 1000 - 1000).alias("long_us"),
        F.concat(F.lit("line-"), line).alias("name"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey") % 10).alias("service"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 4).alias("role"),
        (F.col("l_partkey") % 50 == 0).alias("spoilt"),
    )


def _raw(df: DataFrame, protocol: str, body: Column) -> DataFrame:
    return df.select(
        "payload_id", "received_at", F.lit(protocol).alias("protocol"),
        F.lit("application/json; charset=utf-8").alias("content_type"), body.alias("body"),
    )


def raw_zipkin_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of two spans each; every 50th part number sends a quoted timestamp."""
    client, server = F.col("role").isin(0, 2), F.col("role").isin(1, 2)

    def annotation(value: str, at: Column) -> Column:
        endpoint = F.struct(F.col("service").alias("serviceName"))
        return F.struct(at.alias("timestamp"), F.lit(value).alias("value"), endpoint.alias("endpoint"))

    at, end = F.col("at_us"), F.col("at_us") + F.col("long_us")
    none = F.array().cast(
        "array<struct<timestamp:bigint,value:string,endpoint:struct<serviceName:string>>>"
    )
    annotations = F.concat(
        F.when(client, F.array(annotation("cs", at), annotation("cr", end))).otherwise(none),
        F.when(server, F.array(annotation("sr", at + 7), annotation("ss", end + 5))).otherwise(none),
        # The fifth one, if all four are there, is not read any more.
        F.when(client & server, F.array(annotation("cr", end + 1))).otherwise(none),
    )
    endpoint = F.struct(F.lit("fallback").alias("serviceName")).alias("endpoint")
    first = F.struct(
        F.col("trace").alias("traceId"), F.col("span").alias("id"), F.col("parent").alias("parentId"),
        F.col("name"), at.alias("timestamp"), F.col("long_us").alias("duration"),
        annotations.alias("annotations"),
        F.array(
            F.struct(F.lit("flag").alias("key"), F.col("l_returnflag").alias("value"), endpoint),
        ).alias("binaryAnnotations"),
    )
    # The second span has a number as a tag value, which to_json cannot mix with texts.
    second = F.concat(
        F.lit('{"id":"'), F.substring("span", 9, 8), F.lit('","traceId":"'), F.upper("trace"),
        F.lit('","parentId":null,"unknown":[1,{"a":null}],"binaryAnnotations":[{"key":"part","value":'),
        F.col("l_partkey"), F.lit('},{"key":"part","value":'), F.col("l_partkey") % 7,
        F.lit('},{"key":"none","value":null}],"timestamp":'),
        F.when(F.col("spoilt"), F.concat(F.lit('"'), at, F.lit('"'))).otherwise(at.cast("string")),
        F.lit("}"),
    )
    body = F.concat(F.lit("["), F.to_json(first), F.lit(","), second, F.lit("]"))
    return _raw(_payload(spark, sf_dir), "json-v1", body)


def raw_zipkin_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span each; every 50th part number sends an id of 17 hex digits."""
    kind = (
        F.when(F.col("role") == 0, "CLIENT").when(F.col("role") == 1, "Server")
        .when(F.col("role") == 2, "PRODUCER")
    )
    span = F.struct(
        F.when(F.col("spoilt"), F.concat(F.lit("1"), "trace")).otherwise(F.col("trace")).alias("traceId"),
        F.col("span").alias("id"), F.col("parent").alias("parentId"), F.col("name"),
        F.struct(F.col("service").alias("serviceName")).alias("localEndpoint"),
        F.create_map(
            F.lit("flag"), F.col("l_returnflag"), F.lit("protocolVersion"), F.lit("mine")
        ).alias("tags"),
        kind.alias("kind"), F.col("at_us").alias("timestamp"), F.col("long_us").alias("duration"),
    )
    return _raw(_payload(spark, sf_dir), "json-v2", F.to_json(F.array(span)))


def raw_jaeger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data entries with one span each; every 50th part number sends a negative time."""
    kind = F.when(F.col("role").isin(0, 2), "client").otherwise("server")

    def tag(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit("string").alias("type"), value.alias("value"))

    def data(span_id: Column, references: Column, start: Column) -> Column:
        span = F.struct(
            F.col("trace").alias("traceID"), span_id.alias("spanID"),
            F.col("name").alias("operationName"), references.alias("references"),
            start.alias("startTime"), F.col("long_us").alias("duration"),
            F.when(F.col("role") == 3, "p9").otherwise("p1").alias("processID"),
            F.array(
                tag("component", F.col("l_returnflag")), tag("internal.span.format", F.lit("json")),
                tag("span.kind", kind), tag("status", F.col("l_linestatus")),
            ).alias("tags"),
        )
        process = F.struct(F.col("service").alias("serviceName"))
        return F.struct(
            F.array(span).alias("spans"), F.create_map(F.lit("p1"), process).alias("processes")
        )

    def reference(kind: str, span_id: Column) -> Column:
        return F.struct(F.lit(kind).alias("refType"), span_id.alias("spanID"))

    # The last CHILD_OF counts; the second span has none, so it is its own parent.
    references = F.array(
        reference("CHILD_OF", F.lit("1")), reference("CHILD_OF", F.col("parent")),
        reference("FOLLOWS_FROM", F.lit("2")),
    )
    follows = F.array(reference("FOLLOWS_FROM", F.col("parent")))
    start = F.when(F.col("spoilt"), -F.col("at_us")).otherwise(F.col("at_us"))
    both = F.array(
        data(F.col("span"), references, F.col("at_us")),
        data(F.concat(F.lit("f"), F.substring("span", 2, 15)), follows, start),
    )
    return _raw(_payload(spark, sf_dir), "jaeger", F.to_json(F.struct(both.alias("data"))))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three protocols, as one table."""
    return (
        raw_zipkin_v1(spark, sf_dir)
        .unionByName(raw_zipkin_v2(spark, sf_dir))
        .unionByName(raw_jaeger(spark, sf_dir))
    )


def write_supplier_payloads(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A gzip file per supplier, each with one v2 payload of one span."""
    key = F.col("s_suppkey")
    span = F.struct(
        format_id(_long(F.col("s_nationkey")) + 1).alias("traceId"), format_id(key).alias("id"),
        F.col("s_name").alias("name"), F.lit("SERVER").alias("kind"),
        (key * 1000 + F.lit(SHIFT_NS // 1000)).alias("timestamp"), (key % 100).alias("duration"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("tags"),
    )
    lines = table(spark, sf_dir, "supplier").select(key.alias("file"), F.to_json(F.array(span)).alias("value"))
    # One row per file, in a few folders, each moved there by the task that wrote it. Files cost time by
    # their number, so a fixed number of tasks is given: by size they would all be one task's.
    dealt = lines.repartition(max(WRITERS, spark.sparkContext.defaultParallelism), "file")
    files = dealt.groupBy("file").agg(F.concat_ws("\n", F.collect_list("value")).alias("value")).select(
        F.pmod(F.hash("file"), F.lit(SHELVES)).alias("shelf"), "value"
    )
    options = {"compression": "gzip", "maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    files.write.partitionBy("shelf").options(**options).text(path)
