"""Queries that read archives back: the sources, the store, the export and the sync, run whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise
from ..operators import export, stats, storing, tables, verify
from ..operators.filters import Mail, label_rows
from ..operators.store import Archive
from ..sources import api, pst
from ..sources import mail as sources
from ..streaming import sync
from . import generated
from .catalog import BATCH, batch, mail, query
from .generated import START
from .views import duck, view

RECORDED = "postloom.sources.api:Recorded"
NATIONS = "SELECT n_nationkey AS c_custkey, n_name AS c_name, n_regionkey AS c_nationkey, 'S' || n_regionkey AS c_mktsegment FROM nation"
TEXT = "regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\n+$', '')"


def first_of(role: str, field: str):
    return F.get(F.filter("addresses", lambda a: a["role"] == role), F.lit(0))[field]


def bytes_of(attachments: str):
    return F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["size"], F.lit(0)))


# Sources ---------------------------------------------------------------------------------------

@query("mbox_read", f"SELECT concat('thunderbird:<doc', doc_id, '@x.example>') AS id, concat('Local Folders/', source, '/', doc_id % {generated.STORES}) AS folder, concat('Dokument é ', doc_id) AS subject, strftime(make_timestamp(({START} + 60 * doc_id) * 1000000), '%a, %d %b %Y %H:%M:%S +0000') AS date, ({START} + 60 * doc_id) * 1000 AS internal_date_ms, 'Doe, J (x) [y] @z' AS from_name, concat('doc', doc_id, '@mail.example') AS from_address, 3 AS people, sha256({TEXT}) AS body, (doc_id % 4 = 0)::INT AS files, CASE WHEN doc_id % 4 = 0 THEN 3 + len(doc_id::VARCHAR) ELSE 0 END::BIGINT AS bytes FROM documents")
def mbox_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = generated.folder(spark, "profile")
    generated.write_profile(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri)
    labels = spark.createDataFrame(sources.folder_labels(uri), "label_ids string, folder string")
    rows = sources.mbox(spark, uri, chunk="1000000").join(F.broadcast(labels), "label_ids", "left")  # a row for each store
    return rows.select("id", "folder", "subject", "date", "internal_date_ms", first_of("from", "name").alias("from_name"), first_of("from", "address").alias("from_address"), F.size("addresses").alias("people"), F.sha2(normalise.body(F.col("body_text")), 256).alias("body"), F.size("attachments").alias("files"), bytes_of("attachments").alias("bytes"))


@query("mbox_folder_counts", f"SELECT concat('Local Folders/', source, '/', doc_id % {generated.STORES}) AS name, count(*) AS n FROM documents GROUP BY ROLLUP (1)")
def mbox_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = generated.folder(spark, "profile")
    generated.write_profile(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri)
    return stats.per_folder(sources.mbox(spark, uri), spark.createDataFrame(sources.folder_labels(uri), "id string, name string"))


API_SQL = "lower(concat(replace(c_name, '#', '.'), '@', c_mktsegment, '.example')) AS from_address"


@query("api_read", f"SELECT concat('gmail:c', c_custkey) AS id, concat('t', c_nationkey) AS thread_id, concat('Account ', c_custkey) AS subject, ({START} + c_custkey) * 1000 AS internal_date_ms, concat(c_mktsegment, ',INBOX') AS label_ids, concat('Hello ÿ ', c_custkey) AS body_text, concat('<p>Hello ÿ ', c_custkey, '</p>') AS body_html, c_name AS from_name, {API_SQL}, 2 AS people FROM customer")
def api_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = generated.folder(spark, "box")
    generated.write_box(spark.read.parquet(f"{sf_dir}/customer.parquet"), uri, "Hello")
    rows = api.mailbox(spark, RECORDED, uri)
    return rows.select("id", "thread_id", "subject", "internal_date_ms", "label_ids", "body_text", "body_html", first_of("from", "name").alias("from_name"), first_of("from", "address").alias("from_address"), F.size("addresses").alias("people"))


def synced(spark: SparkSession, sf_dir: str) -> Archive:
    """An archive of nation's messages, synced whole and again after some changed and some came."""
    uri, archive = generated.folder(spark, "box"), Archive(spark, generated.folder(spark, "archive"))
    rows = spark.sql(NATIONS.replace("FROM nation", "FROM {nation}"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    generated.write_box(rows, uri, "Hello")
    generated.put(f"{uri}/labels.json", b'[{"id": "INBOX", "name": "Inbox"}, {"id": "S1", "name": "One"}]')
    generated.put(f"{uri}/history.json", b'[[5, "c1"]]')
    cp = generated.folder(spark, "checkpoints")
    sync.sync(archive, RECORDED, uri, cp)
    generated.write_box(rows.filter("c_custkey % 5 = 3"), uri, "Again")
    generated.write_box(rows.filter("c_custkey % 5 = 2"), uri, "Fresh", "n")
    changed = ['[5, "c1"]'] + [f'[{6 + k}, "{"c" if k % 5 == 3 else "n"}{k}"]' for k in range(25) if k % 5 in (2, 3)]
    generated.put(f"{uri}/history.json", f"[{', '.join(changed)}]".encode())
    sync.sync(archive, RECORDED, uri, cp)
    return archive


SYNCED = f"n AS ({NATIONS}), m AS (SELECT *, 'c' AS p, CASE WHEN c_custkey % 5 = 3 THEN 'Again' ELSE 'Hello' END AS word FROM n UNION ALL SELECT *, 'n', 'Fresh' FROM n WHERE c_custkey % 5 = 2)"


@query("api_sync", f"WITH {SYNCED} SELECT concat('gmail:', p, c_custkey) AS id, substr(concat(word, ' ÿ ', c_custkey), 1, 9) AS snippet, concat(word, ' ÿ ', c_custkey) AS body_text, concat(c_mktsegment, ',INBOX') AS label_ids, 2 AS people FROM m")
def api_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = synced(spark, sf_dir)
    people = archive.read("addresses").groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("people"))
    return archive.read("messages").join(people, "id", "left").select("id", "snippet", "body_text", "label_ids", "people")


@query("api_sync_labels", f"WITH {SYNCED}, l AS (SELECT unnest([c_mktsegment, 'INBOX']) AS l FROM m) SELECT CASE l WHEN 'INBOX' THEN 'Inbox' WHEN 'S1' THEN 'One' ELSE l END AS name, count(*) AS n FROM l GROUP BY 1")
def api_sync_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = synced(spark, sf_dir)
    return label_rows(archive.read("messages"), archive.read("labels")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("pst_read", f"SELECT concat('outlook:<n', n_nationkey, '@x>') AS id, concat('outlook:Region ', n_regionkey) AS label_ids, concat('Re: ', n_name) AS subject, concat('Body é of ', n_name) AS body_text, ({START}::BIGINT + n_nationkey) * 1000 AS internal_date_ms, lower(concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN '@Where.example' ELSE '@who.example' END)) AS from_address, concat('To É <to', n_nationkey, '@x.example>') AS recipient, concat('cc', n_nationkey, '@x.example') AS cc, concat(n_name, '.csv') AS filename, (3 + len(n_nationkey::VARCHAR))::BIGINT AS size, sha256(concat('n,', n_nationkey, chr(10))) AS content_sha256 FROM nation")
def pst_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = generated.folder(spark, "pst") + "/nations.pst"
    held = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows at any scale
    generated.put(uri, generated.personal_folders([tuple(r) for r in held]))
    rows = pst.pst(spark, uri, withAttachments="true", chunk="7")
    file = F.get("attachments", F.lit(0))
    return rows.select("id", "label_ids", "subject", "body_text", "internal_date_ms", first_of("from", "address").alias("from_address"), "recipient", "cc", *[file[c].alias(c) for c in ("filename", "size", "content_sha256")])


# The archive -----------------------------------------------------------------------------------

def as_source(rows: DataFrame) -> DataFrame:
    """rows with all columns of a source, those they lack null. Not by a union with an empty table, which
    would hide how rows are dealt and have them shuffled again."""
    schema = rows.sparkSession.createDataFrame([], sources.SCHEMA).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail views as rows of a source, with the contents that hashes are known of."""
    held = mail(spark, sf_dir)
    people = held.addresses.groupBy(F.col("message_id").alias("id")).agg(F.collect_list(F.struct("role", "address", "name")).alias("addresses"))
    content = F.when(F.col("content_sha256").isNotNull(), F.regexp_extract("filename", "part-(.*)\\.bin", 1).cast("binary"))
    none = F.lit(None).cast("string")
    file = F.struct(F.lit(0).alias("ord"), none.alias("attachment_id"), "filename", "mime_type", "size", "content_sha256", none.alias("content_id"), content.alias("content"))
    files = held.attachments.groupBy(F.col("message_id").alias("id")).agg(F.collect_list(file).alias("attachments"))
    rows = held.messages.drop("fetched_at").join(people, "id", "left").join(files, "id", "left").withColumn("seq", F.lit(0).cast("long"))
    return as_source(rows)


def taken(spark: SparkSession, sf_dir: str) -> Archive:
    """An archive that took in all messages, then some again, some twice and some under new ids."""
    archive = Archive(spark, generated.folder(spark, "archive"))
    rows = nested(spark, sf_dir)
    archive.take(rows)
    new = F.array(F.struct(F.lit("from").alias("role"), F.lit("new@example.org").alias("address"), F.lit(None).cast("string").alias("name")))
    again = batch(view(spark, sf_dir, "m_messages").select("id", "subject")).withColumn("addresses", new)
    archive.take(as_source(again))
    return archive


TAKEN = f"{duck('m_messages', 'm_addresses', 'm_attachments')}, {BATCH}, l AS (SELECT id, arg_max(subject, seq) AS subject FROM b GROUP BY id), f AS (SELECT coalesce(l.id, m.id) AS id, coalesce(l.subject, m.subject) AS subject, l.id IS NOT NULL AS fresh FROM m_messages m FULL JOIN l ON l.id = m.id)"


@query("archive_upsert", f"{TAKEN}, a AS (SELECT message_id AS id, count(*) AS n FROM m_addresses GROUP BY 1), t AS (SELECT message_id AS id, count(*) AS n, sum(CASE WHEN content_sha256 IS NULL THEN size ELSE len(regexp_extract(filename, 'part-(.*)\\.bin', 1)) END)::BIGINT AS bytes FROM m_attachments GROUP BY 1) SELECT f.id, f.subject, CASE WHEN fresh THEN 1 ELSE coalesce(a.n, 0) END AS people, CASE WHEN fresh THEN 0 ELSE coalesce(t.n, 0) END AS files, CASE WHEN fresh THEN 0 ELSE coalesce(t.bytes, 0) END AS bytes FROM f LEFT JOIN a USING (id) LEFT JOIN t USING (id)")
def archive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = taken(spark, sf_dir)
    people = archive.read("addresses").groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("people"))
    files = archive.read("attachments").groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return archive.read("messages").select("id", "subject").join(people, "id", "left").join(files, "id", "left").na.fill(0)


@query("archive_blobs", f"{duck('m_attachments')} SELECT DISTINCT content_sha256, regexp_extract(filename, 'part-(.*)\\.bin', 1) AS content FROM m_attachments WHERE content_sha256 IS NOT NULL")
def archive_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark, sf_dir).read("blobs").select("content_sha256", F.col("content").cast("string").alias("content"))


@query("archive_postings", f"{TAKEN}, t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(subject), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM f) SELECT term, count(DISTINCT id) AS df, count(*) AS n FROM t GROUP BY 1")
def archive_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taken(spark, sf_dir).read("postings").filter("col = 'subject'")
    return rows.groupBy("term").agg(F.count_distinct("id").alias("df"), F.count(F.lit(1)).alias("n"))


# Export and storing ----------------------------------------------------------------------------

SUPPLIERS = f"SELECT concat('outlook:a/b', repeat('x', CAST(s_suppkey % 3 * 60 AS INT)), CAST(s_suppkey AS STRING)) AS id, concat('Subject é ', s_name) AS subject, CASE WHEN s_suppkey % 5 > 0 THEN ({START} + s_suppkey * 86400) * 1000 END AS internal_date_ms, concat(s_name, ' <s', CAST(s_suppkey AS STRING), '@x.example>') AS sender, concat('Body ÿ of ', s_name) AS body_text, 'text/plain' AS body_mime_type, 'A' AS label_ids FROM supplier"


def supplier_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SUPPLIERS.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def tree_of(rows: DataFrame) -> DataFrame:
    """Messages written as a tree of EML files and read back."""
    spark = rows.sparkSession
    files = spark.createDataFrame([], "message_id string, filename string, mime_type string, size long, content_sha256 string")
    uri = generated.folder(spark, "tree")
    ready = export.candidates(Mail(rows, spark.createDataFrame([("A", "Work")], "id string, name string"), files, files))
    generated.each(export.write_tree(generated.spread(ready), uri), lambda _: None)
    return sources.exported_tree(spark, uri, content=True)


@query("export_tree", f"WITH m AS ({SUPPLIERS}) SELECT id, concat(CASE WHEN internal_date_ms IS NULL THEN 'unknown' ELSE strftime(make_timestamp(internal_date_ms * 1000), '%Y/%m') END, '/', CASE WHEN len(id) > 120 THEN sha256(id) ELSE regexp_replace(id, '[/:]', '_', 'g') END, '.eml') AS path, subject, body_text, 'Work' AS labels FROM m")
def export_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tree_of(supplier_messages(spark, sf_dir))
    return back.select("id", F.element_at(F.split("path", "/tree-[0-9a-f]+/"), -1).alias("path"), "subject", normalise.body(F.col("body_text")).alias("body_text"), F.array_join("label_names", ",").alias("labels"))


@query("tree_differences", f"WITH m AS (SELECT *, split_part(subject, '#', 2)::BIGINT AS k FROM ({SUPPLIERS})) SELECT id, '<row>' AS field FROM m WHERE k % 7 = 0 UNION ALL SELECT id, 'subject' FROM m WHERE k % 7 > 0 AND k % 3 = 0 UNION ALL SELECT id, 'body_text' FROM m WHERE k % 7 > 0 AND k % 4 = 0")
def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_messages(spark, sf_dir)
    key = F.split_part("subject", F.lit("#"), F.lit(2)).cast("long")
    other = rows.filter(key % 7 > 0).withColumns({"subject": F.when(key % 3 == 0, F.concat("subject", F.lit("!"))).otherwise(F.col("subject")), "body_text": F.when(key % 4 == 0, "other").otherwise(F.col("body_text"))})
    return verify.tree_differences(tree_of(rows), tree_of(other)).select("id", "field")


@query("store_run", "SELECT concat('gmail:', n_nationkey) AS id, true AS stored, (n_nationkey % 2 = 0)::INT AS dropped FROM nation")
def store_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation's messages put into a mailbox that takes no large ones, in two runs."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.concat(F.lit("gmail:"), "n_nationkey")
    rows = nations.select(key.alias("id"), F.col("n_name").alias("subject"), F.lit("a@b.example").alias("sender"), F.lit("text").alias("body_text"), F.lit(START * 1000).alias("internal_date_ms"), F.lit("L").alias("label_ids"))
    files = nations.filter("n_nationkey % 2 = 0").select(key.alias("message_id"), F.lit("a.bin").alias("filename"), F.lit("image/png").alias("mime_type"), F.lit(9000).cast("long").alias("size"), F.sha2("n_name", 256).alias("content_sha256"), F.repeat("n_name", F.lit(1500)).cast("binary").alias("content"))
    ready = export.candidates(Mail(rows, spark.createDataFrame([("L", "Work")], "id string, name string"), files, files))
    box, book = generated.folder(spark, "box"), generated.folder(spark, "ledger")
    for limit in (9, None):
        storing.store_messages(spark, ready, RECORDED, box, book, limit, batch=8, rate=1e6, largest=5000)
    return storing.ledger(spark, book).select("id", F.col("remote_id").isNotNull().alias("stored"), "dropped")


# Comparison ------------------------------------------------------------------------------------

@query("normal_headers", f"SELECT c_custkey, concat('a ', c_name, ' b') AS header, concat('A, Q <a@q.r>; ', c_name, ' <b', c_custkey, '@x.y>') AS people, ({START} + 60 * c_custkey) * 1000 AS ms FROM customer")
def normal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_format(F.timestamp_seconds(F.lit(START) + 60 * F.col("c_custkey")), "EEE, dd MMM yyyy HH:mm:ss +0000")
    people = F.concat("c_name", F.lit(" <B"), "c_custkey", F.lit('@X.y>, "A, Q" <a@q.r>'))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", verify.header(F.concat(F.lit("  a \t"), "c_name", F.lit("\n b "))).alias("header"), verify.address_list(people).alias("people"), verify.date_ms(date).alias("ms"))


@query("label_differences", f"{duck('m_messages', 'm_labels')}, e AS (SELECT id, split_part(label_ids, ',', 1) AS l FROM m_messages WHERE label_ids <> '') SELECT e.id, CASE WHEN right(e.id, 1) = '4' THEN coalesce(n.name, e.l) ELSE '' END AS missing, CASE WHEN right(e.id, 1) = '5' THEN 'X' ELSE '' END AS extra FROM e LEFT JOIN m_labels n ON n.id = e.l WHERE right(e.id, 1) IN ('4', '5')")
def label_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = label_rows(view(spark, sf_dir, "m_messages"), view(spark, sf_dir, "m_labels"))
    left = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("label_names"))
    last = F.substring("id", -1, 1)
    right = left.select("id", F.when(last == "4", F.slice("label_names", 2, 99)).when(last == "5", F.concat("label_names", F.array(F.lit("X")))).otherwise(F.col("label_names")).alias("label_names"))
    return verify.label_differences(left, right).select("id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("mailbox_differences", f"{duck('m_messages')}, p AS (SELECT id, concat('back:', id) AS back_id, right(id, 1) AS k FROM m_messages WHERE right(id, 2) <> '66') SELECT id, NULL::VARCHAR AS back_id, '<row>' AS field FROM m_messages WHERE right(id, 2) = '66' UNION ALL SELECT id, back_id, 'body_text' FROM p WHERE k = '4' UNION ALL SELECT id, back_id, 'labels' FROM p WHERE k = '5'")
def mailbox_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages against what came back: some lost, some with another body, some without the run's label."""
    rows = view(spark, sf_dir, "m_messages")
    names = label_rows(rows, view(spark, sf_dir, "m_labels")).groupBy("id").agg(F.collect_list("name").alias("label_names"))
    sent = rows.join(names, "id", "left").withColumn("label_names", F.coalesce("label_names", F.array().cast("array<string>")))
    last = F.substring("id", -1, 1)
    back = (
        sent.filter("substring(id, -2) <> '66'").withColumn("body_text", F.when(last == "4", "other").otherwise(F.col("body_text")))
        .withColumn("label_names", F.when(last == "5", F.col("label_names")).otherwise(F.concat("label_names", F.array(F.lit("run-7"))))).withColumn("id", F.concat(F.lit("back:"), "id"))
    )
    return verify.mailbox_differences(sent, back, "run-").select("id", "back_id", "field")


@query("merge_ignore", f"{duck('m_messages')} SELECT id, subject FROM m_messages WHERE right(id, 1) NOT IN ('1', '2') UNION ALL SELECT id, concat('p0 ', subject) FROM m_messages WHERE right(id, 1) IN ('1', '2') UNION ALL SELECT concat(id, '-n'), concat('p1 ', subject) FROM m_messages WHERE right(id, 1) = '5'")
def merge_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_messages").select("id", "subject")
    last = F.substring("id", -1, 1)
    parts = [rows.filter(last.isin("1", "2", "3")).withColumn("subject", F.concat(F.lit("p0 "), "subject")), rows.filter(last.isin("2", "5")).select(F.when(last == "5", F.concat("id", F.lit("-n"))).otherwise(F.col("id")).alias("id"), F.concat(F.lit("p1 "), "subject").alias("subject"))]
    return tables.insert_or_ignore(rows.filter(~last.isin("1", "2")), parts)


@query("row_differences", f"{duck('m_addresses')} SELECT message_id, address, 'left' AS side FROM m_addresses WHERE role = 'cc' UNION ALL SELECT message_id, 'x', 'right' FROM m_addresses WHERE role = 'from'")
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_addresses").select("message_id", "address", "role")
    right = rows.filter("role <> 'cc'").unionByName(rows.filter("role = 'from'").withColumn("address", F.lit("x")))
    return verify.row_differences(rows, right).select("message_id", "address", "side")


@query("attachment_differences", f"{duck('m_attachments')}, o AS (SELECT *, row_number() OVER (PARTITION BY message_id, filename ORDER BY content_sha256 NULLS FIRST, size) AS n FROM m_attachments) SELECT message_id, filename, n::INT AS n, CASE WHEN right(message_id, 1) = '4' THEN '<row>' ELSE 'size' END AS field FROM o WHERE right(message_id, 1) IN ('4', '6')")
def attachment_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = view(spark, sf_dir, "m_attachments").withColumn("content_id", F.lit(None).cast("string"))
    last = F.substring("message_id", -1, 1)
    right = left.filter(last != "4").withColumn("size", F.col("size") + F.when(last == "6", 1).otherwise(0))
    return verify.attachment_differences(left, right).select("message_id", "filename", "n", "field")
