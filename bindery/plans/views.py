"""Bundle-shaped views over the analytics tables, used by queries and bench.

Each view covers its whole table. Defects in `flawed` and `requests` stand in
for what real submitters send; they are derived from the row, none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindery.functions import fingerprint as fp
from bindery.operators import blobs as blob_ops, fetch
from bindery.operators.chain import active_versions, with_audit_log, with_successor
from bindery.operators.facts import content_facts
from bindery.operators.patch import resolve_keys
from bindery.operators.route import route, version_rows
from bindery.plans.current import for_lookups
from bindery.schemas import KEY4
from bindery.session import compressed, fresh_path
from bindery.sources.inline import build_payload

_stored: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A table of the registry, written once per session to the shared folder.

    Lookups, retention and export work on a stored registry, so their queries
    read one and do not route all bundles again each time.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = fresh_path(spark, name)
        compressed(build().write).mode("overwrite").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def as_bundles(texts: DataFrame) -> DataFrame:
    """Text columns to binary contents."""
    out = texts
    for short in ("json", "sql", "tpl"):
        out = out.withColumn(f"{short}_content", F.col(f"{short}_text").cast("binary"))
    return out.drop("json_text", "sql_text", "tpl_text")


def _csi(number: Column) -> Column:
    return F.concat(F.lit("CSI-"), F.lpad(number.cast("string"), 4, "0"))


def _region(number: str) -> Column:
    return F.expr(
        f"CASE CAST({number} % 5 AS INT) WHEN 0 THEN 'APAC' WHEN 1 THEN 'EMEA' WHEN 2 THEN 'US'"
        " WHEN 3 THEN 'UK' ELSE 'LATAM' END"
    )


def _report_json(name: Column) -> Column:
    return F.concat(F.lit('{"report":{"name":"R'), name, F.lit('"}}'))


def _whole(number: Column) -> Column:
    return F.floor(number).cast("int").cast("string")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle per event; the event id is the processing order."""
    has_tpl = F.col("event_id") % 3 != 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("uploaded_at"),
        _csi(F.col("user_id")).alias("csi_id"),
        _region("user_id").alias("region"),
        F.upper("event_type").alias("regulation"),
        F.format_string("report_%d.json", F.col("event_id") % 2).alias("json_name"),
        _report_json(_whole(F.col("value") / 20)).alias("json_text"),
        F.format_string("q_%d.sql", F.col("event_id") % 7).alias("sql_name"),
        F.concat(F.lit("SELECT "), F.length("props").cast("string")).alias("sql_text"),
        F.when(has_tpl, F.format_string("t_%d.txt", F.col("event_id") % 4)).alias("tpl_name"),
        F.when(has_tpl, F.concat(F.lit("tpl "), _whole(F.col("value") / 40))).alias("tpl_text"),
    )


def order_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle per order, for the key of its customer: a second batch."""
    regulation = F.expr(
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CLICK' WHEN '2' THEN 'VIEW'"
        " WHEN '3' THEN 'ERROR' WHEN '4' THEN 'SIGNUP' ELSE 'PURCHASE' END"
    )
    has_tpl = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("uploaded_at"),
        _csi(F.col("o_custkey")).alias("csi_id"),
        _region("o_custkey").alias("region"),
        regulation.alias("regulation"),
        F.format_string("report_%d.json", F.col("o_orderkey") % 2).alias("json_name"),
        _report_json(_whole(F.col("o_totalprice") / 100000)).alias("json_text"),
        F.format_string("q_%d.sql", F.col("o_orderkey") % 7).alias("sql_name"),
        F.concat(F.lit("SELECT "), F.col("o_orderstatus")).alias("sql_text"),
        F.when(has_tpl, F.lit("t_0.html")).alias("tpl_name"),
        F.when(has_tpl, F.concat(F.lit("tpl "), _whole(F.col("o_totalprice") / 200000))).alias(
            "tpl_text"
        ),
        "o_orderstatus",
        "o_orderpriority",
    )


def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as the SQL part; one record per source and language."""
    is_long = F.col("n_chars") > 1500
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("uploaded_at"),
        F.col("source").alias("csi_id"),
        F.upper("lang").alias("region"),
        F.lit("DOCS").alias("regulation"),
        F.lit("doc.json").alias("json_name"),
        F.concat(
            F.lit('{"report":{"name":"'), F.col("source"), F.lit(" "), F.col("lang"),
            F.lit('"},"chars":'), F.col("n_chars").cast("string"), F.lit("}"),
        ).alias("json_text"),
        F.format_string("body_%d.sql", F.col("doc_id")).alias("sql_name"),
        F.col("text").alias("sql_text"),
        F.when(is_long, F.lit("long.html")).alias("tpl_name"),
        F.when(
            is_long, F.concat(F.lit("<p>"), _whole(F.col("n_chars") / 1000), F.lit("k</p>"))
        ).alias("tpl_text"),
    )


def chat_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per conversation; its turns, whole, are submitted in order."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1048576 + F.col("turn")).alias("seq"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("uploaded_at"),
        F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")).alias("csi_id"),
        F.lit("CHAT").alias("region"),
        F.lit("TURNS").alias("regulation"),
        F.lit("chat.json").alias("json_name"),
        F.concat(F.lit('{"report":{"name":"'), F.col("role"), F.lit('"}}')).alias("json_text"),
        F.lit("turn.sql").alias("sql_name"),
        F.col("text").alias("sql_text"),
        F.lit(None).cast("string").alias("tpl_name"),
        F.lit(None).cast("string").alias("tpl_text"),
    )


def page_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole web pages as templates; addresses are poor tokens."""
    page = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("uploaded_at"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("csi_id"),
        F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/]*)", 1).alias("region"),
        F.element_at(F.split("url", "/"), -1).alias("regulation"),
        F.lit("page.json").alias("json_name"),
        F.concat(F.lit('{"report":{"name":"page '), page, F.lit('"}}')).alias("json_text"),
        F.concat(F.lit("sql/page_"), page, F.lit(".sql")).alias("sql_name"),
        F.concat(F.lit("SELECT "), page).alias("sql_text"),
        F.lit("page.html").alias("tpl_name"),
        F.col("html").alias("tpl_text"),
    )


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions with typical mistakes in some of them."""

    def every(n: int) -> Column:
        return F.col("seq") % n == 0

    def but(n: int, column: str, instead: Column) -> Column:
        return F.when(every(n), instead).otherwise(F.col(column))

    text = F.lit(None).cast("string")
    sub = submissions(spark, sf_dir)
    json = F.when(every(19), '{"report":').when(every(29), '{"report":{"name":7}}')
    json = json.when(every(41), text).when(every(43), "").when(every(47), "[1]")
    json = json.when(every(53), '{"name":"x"}').when(every(59), '{"report":{"name":" "}}')
    return sub.withColumns(
        {
            "csi_id": but(11, "csi_id", F.replace("csi_id", F.lit("-"), F.lit(" "))),
            "region": but(13, "region", F.lit("  ")),
            "regulation": but(31, "regulation", text),
            "json_name": but(61, "json_name", F.lit("report.yaml")),
            "json_text": json.otherwise(F.col("json_text")),
            "sql_name": but(17, "sql_name", F.lit("q.txt")),
            "sql_text": but(23, "sql_text", F.lit(" \t\n")),
            "tpl_name": F.when(every(37) & F.col("tpl_text").isNotNull(), "t.pdf").otherwise(
                F.col("tpl_name")
            ),
        }
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of up to eight entries; some have no list, or an empty one."""
    sub = submissions(spark, sf_dir)
    entry = F.struct(
        "csi_id", "region", "regulation",
        F.col("json_name").alias("json_config"), F.col("sql_name").alias("sql_file"),
        F.col("tpl_name").alias("template"),
    )
    entry = F.when(F.col("tpl_text") == "tpl 0", F.lit(None)).otherwise(entry)
    group = F.floor(F.col("seq") / 8)
    grouped = sub.groupBy(group.alias("manifest")).agg(
        F.sort_array(F.collect_list(F.struct("seq", entry.alias("e")))).alias("rows"),
        F.min_by("regulation", "seq").alias("first"),
    )
    entries = F.transform("rows", lambda r: r["e"])
    none = F.filter(entries, lambda e: F.lit(False))
    return grouped.select(
        F.format_string("manifest_%d", "manifest").alias("source"),
        F.when(F.col("first") == "ERROR", F.lit(None))
        .when(F.col("first") == "SIGNUP", none)
        .otherwise(entries)
        .alias("bundles"),
    )


def disk_entries(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """One manifest entry per supplier, its files laid out below `folder`: some are
    missing, some are empty, and some are folders."""
    key = F.col("s_suppkey")
    at = F.concat((key % 10).cast("string"), F.lit("/"), key.cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.lit(f"{folder}/manifest.yaml").alias("source"),
        key.cast("long").alias("index"),
        _csi(key).alias("csi_id"), _region("s_suppkey").alias("region"),
        F.lit("DISK").alias("regulation"),
        F.concat(at, F.lit("/config.json")).alias("json_config"),
        F.concat(at, F.lit("/./query.sql")).alias("sql_file"),
        F.when(key % 3 != 0, F.concat(at, F.lit("/x/../t.txt"))).alias("template"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, "")
        .otherwise(_report_json(F.col("s_name"))).alias("json_text"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, "")
        .otherwise(F.concat(F.lit("SELECT "), key.cast("string"))).alias("sql_text"),
        F.when(key % 17 == 0, F.lit(None)).when(key % 19 == 0, "")
        .otherwise(F.repeat(F.col("s_name"), (key % 1000).cast("int"))).alias("tpl_text"),
        (key % 2 == 0).alias("as_folder"),
    )


def lay_out(entries: DataFrame) -> None:
    """Write the files of `disk_entries`; a null text is a folder in every other row."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                root = row["source"].rpartition("/")[0]
                fs, _ = FileSystem.from_uri(f"file://{root}")
                home = f"{root}/{row['json_config'].rpartition('/')[0]}"
                fs.create_dir(home)
                for name, short in (("config.json", "json"), ("query.sql", "sql"), ("t.txt", "tpl")):
                    if (content := row[f"{short}_text"]) is not None:
                        with fs.open_output_stream(f"{home}/{name}") as out:
                            out.write(content.encode())
                    elif row["as_folder"]:
                        fs.create_dir(f"{home}/{name}")
            yield batch.select(["index"])

    entries.mapInArrow(task, "index long").write.format("noop").mode("overwrite").save()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed forms of the submissions, some with texts that are not base64."""
    good = build_payload(as_bundles(submissions(spark, sf_dir)))
    sql = F.col("sql_file_content")
    return good.withColumns(
        {
            "sql_file_content": F.when(F.col("seq") % 47 == 0, F.concat(sql, F.lit("A")))
            .when(F.col("seq") % 53 == 0, F.concat(F.lit("*"), sql))
            .otherwise(sql),
            "template_filename": F.when(F.col("seq") % 5 != 0, F.col("template_filename")),
        }
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per order, by report id; some name no file or no record, and
    some rename the config. Landed once, as patches arrive as a table."""
    return stored(spark, sf_dir, "patches", lambda: _patches(spark, sf_dir))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = order_bundles(spark, sf_dir)
    held = resolve_keys(orders, active(spark, sf_dir)).drop("error")
    urgent, high = "1-URGENT", "2-HIGH"
    json = F.col("o_orderpriority").isin(urgent, high)
    sql, tpl = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    moved = F.concat(F.lit("moved_"), F.substring("csi_id", -1, 1), F.lit(".json"))
    return held.select(
        "seq",
        F.coalesce("report_id", fp.report_id(KEY4, "none", "seq")).alias("report_id"),
        "uploaded_at",
        F.when(json, F.when(F.col("o_orderpriority") == high, moved).otherwise(F.col("json_name")))
        .alias("json_name"),
        F.when(json, F.col("json_text")).alias("json_text"),
        F.when(sql, F.col("sql_name")).alias("sql_name"),
        F.when(sql, F.col("sql_text")).alias("sql_text"),
        F.when(tpl, F.col("tpl_name")).alias("tpl_name"),
        F.when(tpl, F.col("tpl_text")).alias("tpl_text"),
    )


def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one batch of bundles, patches by key and patches by id; of the last
    some bring no config, some keep its name and some move the record to another
    key, which others have given up or still hold."""
    orders = order_bundles(spark, sf_dir)
    held = resolve_keys(orders, active(spark, sf_dir)).drop("error")
    turn, way = F.col("seq") % 5, F.floor(F.col("seq") / 5) % 4
    by_id, by_key = turn > 2, turn == 2
    target = F.when(way == 1, "report_0.json").when(way == 2, "report_1.json")
    target = target.when(way == 3, "moved.json")
    json = ~by_id | (way > 0)
    sql = (turn < 2) | (F.col("o_orderstatus") == "O")
    tpl = (turn < 2) | (F.col("o_orderstatus") == "F")
    unknown = F.coalesce("report_id", fp.report_id(KEY4, "none", "seq"))
    rows = held.select(
        "seq", "csi_id", "region", "regulation", "uploaded_at",
        F.when(by_id, "patch_id").when(by_key, "patch_key").otherwise("bundle").alias("kind"),
        F.when(by_id, unknown).alias("report_id"),
        F.when(by_id, target).otherwise(F.col("json_name")).alias("json_name"),
        F.when(json, F.col("json_text")).alias("json_text"),
        *[F.when(sql, F.col(f"sql_{c}")).alias(f"sql_{c}") for c in ("name", "text")],
        *[F.when(tpl, F.col(f"tpl_{c}")).alias(f"tpl_{c}") for c in ("name", "text")],
    )
    return content_facts(as_bundles(rows))


def routed(bundles: DataFrame, **options) -> DataFrame:
    return route(content_facts(as_bundles(bundles)), **options)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all submissions: version rows as stored."""
    build = lambda: version_rows(routed(submissions(spark, sf_dir)))
    return stored(spark, sf_dir, "versions", build)


def stored_for_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions once more, in files that serve point lookups."""
    key = (spark.sparkContext.applicationId, sf_dir, "lookups")
    if key not in _stored:
        path = fresh_path(spark, "lookups")
        for_lookups(versions(spark, sf_dir).repartitionByRange("report_id")).parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions as extended JSON, in a form that goes by the report id: cut off,
    without a key, as a counter, and with the ways to write times and numbers."""
    digit = F.substring("report_id", 1, 1)
    place = F.concat_ws("_v", "report_id", F.col("version").cast("string"))
    record = fetch.as_json(with_audit_log(versions(spark, sf_dir))).select(
        place.alias("place"), digit.alias("digit"), "record", "version",
        F.get_json_object("record", "$.uploaded_at").alias("at"),
    )
    oid = F.concat(F.lit('{"_id":{"$oid":"'), F.substring(F.md5("place"), 1, 24), F.lit('"},'))
    counter = F.lit('{"_id":"report_id_seq",')
    text = F.concat(
        F.when(F.col("digit") == "2", counter).otherwise(oid), F.expr("substr(record, 2)")
    )
    millis = F.unix_millis(F.to_timestamp("at")).cast("string")
    quoted = F.concat(F.lit('"uploaded_at":"'), F.col("at"), F.lit('"'))
    number = F.concat(F.lit('"version":'), F.col("version").cast("string"))
    iso = F.concat(F.lit('"uploaded_at":{"$date":"'), F.col("at"), F.lit('"}'))
    long = F.concat(F.lit('"uploaded_at":{"$date":{"$numberLong":"'), millis, F.lit('"}}'))
    wrapped = F.concat(F.lit('"version":{"$numberInt":"'), F.col("version").cast("string"), F.lit('"}'))
    form = (
        F.when(F.col("digit") == "0", F.expr("substr(_text, 1, length(_text) - 9)"))
        .when(F.col("digit") == "1", F.replace("_text", F.lit('"csi_id":'), F.lit('"csi":')))
        .when(F.col("digit").isin("3", "4"), F.replace("_text", quoted, iso))
        .when(F.col("digit").isin("5", "6"), F.replace("_text", quoted, long))
        .when(F.col("digit") == "7", F.replace("_text", number, wrapped))
        .otherwise(F.col("_text"))
    )
    return record.withColumn("_text", text).select("place", form.alias("record"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_versions(versions(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with their `active` flag."""
    return with_successor(versions(spark, sf_dir))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written out: retention goes over it several times."""
    return stored(spark, sf_dir, "marked", lambda: current(spark, sf_dir))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the contents of the second batch."""
    build = lambda: content_facts(as_bundles(order_bundles(spark, sf_dir)))
    return stored(spark, sf_dir, "order_facts", build)


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the documents' contents; texts are read once for it."""
    build = lambda: content_facts(as_bundles(document_bundles(spark, sf_dir)))
    return stored(spark, sf_dir, "document_facts", build)


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: version_rows(route(document_facts(spark, sf_dir)))
    return stored(spark, sf_dir, "document_versions", build)


def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of the documents: some damaged, some lost, and the benchmark texts
    as uploads that nothing refers to."""

    def build() -> DataFrame:
        plan = blob_ops.upload_plan(blob_ops.uploads(route(document_facts(spark, sf_dir))))
        texts = blob_ops.contents(as_bundles(document_bundles(spark, sf_dir)))
        at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        good = blob_ops.new_blobs(plan, texts, at)
        digit = F.substring("blob_id", 8, 1)
        damaged = F.concat("content", F.lit("!").cast("binary"))
        kept = good.where(digit != "f").withColumn(
            "content", F.when(digit == "0", damaged).otherwise(F.col("content"))
        )
        body = F.col("text").cast("binary")
        loose = table(spark, sf_dir, "benchmark").select(
            fp.checksum(body).alias("blob_id"),
            F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias(
                "filename"
            ),
            F.lit("text/plain").alias("content_type"),
            fp.byte_size(body).alias("length"),
            at.alias("upload_date"),
            fp.checksum(body).alias("checksum"),
            body.alias("content"),
        )
        return kept.unionByName(loose)

    return stored(spark, sf_dir, "document_blobs", build)
