"""Queries by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise
from ..functions.terms import postings
from ..operators import export, filters, search, stats, tables, verify
from ..operators.filters import Mail
from ..sources import mail as sources
from . import generated
from .views import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FILTERED = "subject:urgent after:1996/01/01 has:attachment"
ALL = ("m_messages", "m_labels", "m_addresses", "m_attachments")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def mail(spark: SparkSession, sf_dir: str) -> Mail:
    return Mail(*[view(spark, sf_dir, v) for v in ALL])


# Filters ---------------------------------------------------------------------------------------

def who(role: str, value: str) -> str:
    return f"EXISTS (SELECT 1 FROM m_addresses a WHERE a.message_id = m.id AND a.role = '{role}' AND (contains(lower(a.address), '{value}') OR contains(lower(coalesce(a.name, '')), '{value}')))"


def labelled(value: str) -> str:
    return f"EXISTS (SELECT 1 FROM (SELECT unnest(string_split(m.label_ids, ',')) AS l) x LEFT JOIN m_labels n ON n.id = x.l WHERE m.label_ids <> '' AND contains(lower(coalesce(n.name, x.l)), '{value}'))"


HAS = "EXISTS (SELECT 1 FROM m_attachments t WHERE t.message_id = m.id)"
URGENT = f"contains(lower(subject), 'urgent') AND internal_date_ms >= 820454400000 AND internal_date_ms <> 0 AND {HAS}"
FILTERS = {
    "bare": ("BUILDING", "(contains(lower(subject), 'building') OR contains(lower(body_text), 'building'))"),
    "subject": ("subject:1-urgent", "contains(lower(subject), '1-urgent')"),
    "label": ("label:inbox", labelled("inbox")),
    "from": ("from:customer.00000001", who("from", "customer.00000001")),
    "to": ("to:supplier#00000000", who("to", "supplier#00000000")),
    "cc": ("cc:supplier.00000000", who("cc", "supplier.00000000")),
    "bcc": ("bcc:supplier.00000000", who("bcc", "supplier.00000000")),
    "after": ("after:1997/06/30", "internal_date_ms >= 867628800000 AND internal_date_ms <> 0"),
    "before": ("before:1996/2/1", "internal_date_ms < 823132800000 AND internal_date_ms <> 0"),
    "has": ("has:attachment", HAS),
    "and": (f"{FILTERED} from:machinery label:open", f"{URGENT} AND {who('from', 'machinery')} AND {labelled('open')}"),
}


def filter_query(text: str) -> Query:
    return lambda spark, sf_dir: filters.matching(mail(spark, sf_dir), text).select("id", "subject", "internal_date_ms")


for _name, (_text, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"{duck(*ALL)} SELECT id, subject, internal_date_ms FROM m_messages m WHERE {_sql}")(filter_query(_text))


@query("label_resolution", f"{duck('m_messages', 'm_labels')}, e AS (SELECT id, unnest(string_split(label_ids, ',')) AS l, generate_subscripts(string_split(label_ids, ','), 1) AS p FROM m_messages WHERE label_ids <> '') SELECT e.id, string_agg(coalesce(n.name, e.l), ',' ORDER BY p) AS names FROM e LEFT JOIN m_labels n ON n.id = e.l GROUP BY e.id")
def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.label_rows(view(spark, sf_dir, "m_messages"), view(spark, sf_dir, "m_labels"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",").alias("names"))


# Statistics ------------------------------------------------------------------------------------

SUMMARY = "count(*) AS messages, count(DISTINCT thread_id) AS threads, min(internal_date_ms) AS first_ms, max(internal_date_ms) AS last_ms, strftime(min(fetched_at), '%Y-%m-%d %H:%M:%S') AS first_fetched, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS last_fetched"


@query("stats_summary", f"{duck('m_messages')} SELECT {SUMMARY} FROM m_messages")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(view(spark, sf_dir, "m_messages"))


@query("stats_summary_filtered", f"{duck(*ALL)} SELECT {SUMMARY} FROM m_messages m WHERE {URGENT}")
def stats_summary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(filters.matching(mail(spark, sf_dir), FILTERED))


@query("stats_top_labels", f"{duck('m_messages', 'm_labels')}, e AS (SELECT unnest(string_split(label_ids, ',')) AS label_id FROM m_messages WHERE label_ids <> ''), t AS (SELECT label_id, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, label_id LIMIT 15) SELECT label_id, coalesce(l.name, label_id) AS name, n FROM t LEFT JOIN m_labels l ON l.id = t.label_id")
def stats_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_labels(view(spark, sf_dir, "m_messages"), view(spark, sf_dir, "m_labels"))


def top_sql(role: str, more: str = "") -> str:
    return f"SELECT address, CASE WHEN coalesce(name, '') <> '' THEN concat(name, ' <', address, '>') ELSE address END AS shown, n FROM (SELECT address, max(name) AS name, count(*) AS n FROM m_addresses a WHERE role = '{role}' {more} GROUP BY 1 ORDER BY n DESC, address LIMIT 15)"


for _role in ("from", "to", "cc"):
    query(f"stats_top_{_role}", f"{duck('m_addresses')} {top_sql(_role)}")(lambda spark, sf_dir, role=_role: stats.top_addresses(view(spark, sf_dir, "m_addresses"), role))


@query("stats_top_from_filtered", f"{duck(*ALL)} {top_sql('from', f'AND EXISTS (SELECT 1 FROM m_messages m WHERE m.id = a.message_id AND {URGENT})')}")
def stats_top_from_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = mail(spark, sf_dir)
    return stats.top_addresses(stats.of(held, filters.matching(held, FILTERED)).addresses, "from")


@query("stats_attachments", f"{duck('m_attachments')} SELECT count(*) AS attachments, coalesce(sum(size), 0)::BIGINT AS bytes FROM m_attachments")
def stats_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.attachments(view(spark, sf_dir, "m_attachments"))


# Export ----------------------------------------------------------------------------------------

@query("message_attachment_nest", f"{duck('m_messages', 'm_attachments')} SELECT m.id, count(t.filename) AS n, coalesce(string_agg(concat(t.filename, '|', t.mime_type, '|', t.size), ';' ORDER BY t.filename, t.mime_type, t.size) FILTER (t.filename IS NOT NULL), '') AS files FROM m_messages m LEFT JOIN m_attachments t ON t.message_id = m.id GROUP BY m.id")
def message_attachment_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.nested_attachments(view(spark, sf_dir, "m_messages"), view(spark, sf_dir, "m_attachments"))
    return rows.select("id", F.size("attachments").cast("long").alias("n"), F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["filename"], a["mime_type"], a["size"])), ";").alias("files"))


@query("export_manifest", f"""{duck('m_messages')} SELECT id, CASE WHEN coalesce(internal_date_ms, 0) = 0 THEN 'unknown' ELSE strftime(make_timestamp(internal_date_ms * 1000), '%Y/%m') END AS bucket, concat(regexp_replace(id, '[/\\\\:*?"<>|]', '_', 'g'), '.md') AS file FROM m_messages""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.manifest(view(spark, sf_dir, "m_messages"))


@query("size_format", f"{duck('m_attachments')} SELECT filename, message_id, CASE WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) ELSE printf('%.1f MB', size / 1048576.0) END AS shown FROM m_attachments")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "m_attachments").select("filename", "message_id", export.shown_size(F.col("size")).alias("shown"))


@query("mime_lossless", f"{duck('m_attachments')} SELECT CASE WHEN split_part(mime_type, '/', 1) IN ('image', 'audio', 'video', 'application') THEN mime_type ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM m_attachments GROUP BY 1")
def mime_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "m_attachments").groupBy(export.lossless_type(F.col("mime_type")).alias("mime")).agg(F.count(F.lit(1)).alias("n"))


# Keyed tables ----------------------------------------------------------------------------------

def batch(messages: DataFrame) -> DataFrame:
    """Some messages again, some twice, with new subjects, and some under new ids."""
    some = messages.filter("substring(id, -1) IN ('3', '7')")
    again = some.select("id", F.concat(F.lit("again "), "subject").alias("subject"), F.lit(1).cast("long").alias("seq"))
    third = some.filter("id LIKE '%7'").select("id", F.concat(F.lit("third "), "subject").alias("subject"), F.lit(2).cast("long").alias("seq"))
    fresh = some.select(F.concat("id", F.lit("-new")).alias("id"), "subject", F.lit(3).cast("long").alias("seq"))
    return again.unionByName(third).unionByName(fresh)


BATCH = "b AS (SELECT id, concat('again ', subject) AS subject, 1 AS seq FROM m_messages WHERE right(id, 1) IN ('3', '7') UNION ALL SELECT id, concat('third ', subject), 2 FROM m_messages WHERE right(id, 1) = '7' UNION ALL SELECT concat(id, '-new'), subject, 3 FROM m_messages WHERE right(id, 1) IN ('3', '7'))"


@query("upsert_last_wins", f"{duck('m_messages')}, {BATCH}, l AS (SELECT id, arg_max(subject, seq) AS subject FROM b GROUP BY id) SELECT coalesce(l.id, m.id) AS id, coalesce(l.subject, m.subject) AS subject FROM m_messages m FULL JOIN l ON l.id = m.id")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = view(spark, sf_dir, "m_messages").select("id", "subject")
    return tables.upsert(current, batch(current))


@query("replace_by_key", f"{duck('m_messages', 'm_addresses')}, {BATCH} SELECT message_id, role, address FROM m_addresses WHERE message_id NOT IN (SELECT id FROM b) UNION ALL SELECT DISTINCT id, 'from', 'new@example.org' FROM b")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = batch(view(spark, sf_dir, "m_messages")).select(F.col("id").alias("message_id")).distinct()
    new = changed.select("message_id", F.lit("from").alias("role"), F.lit("new@example.org").alias("address"))
    return tables.replace_rows(view(spark, sf_dir, "m_addresses").select("message_id", "role", "address"), new, changed, "message_id")


@query("resume_candidates", f"{duck('m_messages')} SELECT id, subject FROM m_messages WHERE id NOT LIKE '%1' ORDER BY id LIMIT 200")
def resume_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_messages").select("id", "subject")
    return tables.resume(rows, rows.filter("id LIKE '%1'"), 200)


@query("blob_dedup", "SELECT count(*) AS n_rows, count(DISTINCT sha256(text)) AS blobs FROM documents")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2("text", 256).alias("sha"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sha").alias("blobs"))


OTHER = "r AS (SELECT id, CASE WHEN right(id, 1) = '4' THEN concat(subject, '!') ELSE subject END AS subject, CASE WHEN right(id, 1) = '5' THEN NULL ELSE internal_date_ms END AS internal_date_ms FROM m_messages WHERE right(id, 2) <> '66')"


def other(rows: DataFrame) -> DataFrame:
    last = F.substring("id", -1, 1)
    return rows.filter("substring(id, -2) <> '66'").select("id", F.when(last == "4", F.concat("subject", F.lit("!"))).otherwise(F.col("subject")).alias("subject"), F.when(last == "5", None).otherwise(F.col("internal_date_ms")).alias("internal_date_ms"))


@query("roundtrip_diff", f"{duck('m_messages')}, {OTHER}, j AS (SELECT m.id, m.subject AS s1, r.subject AS s2, m.internal_date_ms AS d1, r.internal_date_ms AS d2, r.id AS rid FROM m_messages m LEFT JOIN r ON r.id = m.id) SELECT id, '<row>' AS field, 'present' AS left_value, NULL::VARCHAR AS right_value FROM j WHERE rid IS NULL UNION ALL SELECT id, 'subject', s1, s2 FROM j WHERE rid IS NOT NULL AND s1 IS DISTINCT FROM s2 UNION ALL SELECT id, 'internal_date_ms', d1::VARCHAR, d2::VARCHAR FROM j WHERE rid IS NOT NULL AND d1 IS DISTINCT FROM d2")
def roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_messages").select("id", "subject", "internal_date_ms")
    return tables.differences(rows, other(rows))


@query("pair_unique", f"{duck('m_messages')}, {OTHER}, a AS (SELECT thread_id AS t, internal_date_ms AS d, min(id) AS left_id FROM m_messages GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT m.thread_id AS t, r.internal_date_ms AS d, min(r.id) AS right_id FROM r JOIN m_messages m ON m.id = r.id GROUP BY 1, 2 HAVING count(*) = 1) SELECT left_id, right_id FROM a JOIN b ON a.t IS NOT DISTINCT FROM b.t AND a.d IS NOT DISTINCT FROM b.d")
def pair_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_messages").select("id", "thread_id", "subject", "internal_date_ms")
    right = other(rows).join(rows.select("id", "thread_id"), "id")
    return tables.pair_unique(rows, right, ["thread_id", "internal_date_ms"])


# Normal forms ----------------------------------------------------------------------------------

@query("body_normalize", "SELECT doc_id, sha256(regexp_replace(regexp_replace(concat(text, chr(13), chr(10)), '\\r\\n?', chr(10), 'g'), '\\n+$', '')) AS body FROM documents")
def body_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(normalise.body(F.concat("text", F.lit("\r\n"))), 256).alias("body"))


@query("html_normalize", "SELECT page_id, sha256(trim(regexp_replace(html, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS html FROM pages")
def html_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(normalise.html(F.col("html")), 256).alias("html"))


def by_name(rows: DataFrame, key: str, name: str, f: Callable[[str], str], kind: str) -> DataFrame:
    """(key, name): f of a column, as the mbox reader calls it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(key), pa.array(list(map(f, batch.column("path").to_pylist())))], [key, name])

    return rows.mapInArrow(run, f"{key} long, {name} {kind}")


@query("folder_path_clean", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('Mail/', replace(url, 'e', '.sbd/')), '^(Mail|ImapMail)/', ''), '(?i)\\.sbd/', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS path FROM pages")
def folder_path_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("Mail/"), F.replace("url", F.lit("e"), F.lit(".sbd/")))
    return by_name(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), path.alias("path")), "page_id", "path", sources.folder_of, "string")


@query("store_file_predicate", "SELECT p_partkey, (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) AS store FROM part")
def store_file_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 7 == 0, ".").otherwise("x"), F.lit("Inbox"), F.when(F.col("p_partkey") % 5 == 0, ".MSF").otherwise(""))
    return by_name(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long"), name.alias("path")), "p_partkey", "store", sources.is_store, "boolean")


# Full text -------------------------------------------------------------------------------------

TERMS = """, t AS (SELECT id, col, p - 1 AS pos, w[p] AS term FROM (SELECT id, col, w, unnest(range(1, len(w) + 1)) AS p FROM (
    SELECT id, 'subject' AS col, list_filter(regexp_split_to_array(lower(strip_accents(subject)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM m_docs
    UNION ALL SELECT id, 'body_text', list_filter(regexp_split_to_array(lower(strip_accents(body_text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') FROM m_docs))),
 dl AS (SELECT id, count(*) AS dl FROM t GROUP BY id), g AS (SELECT (SELECT count(*) FROM m_docs) AS n, (SELECT count(*) FROM t) AS total)"""


def rank_sql(phrases: list[str], condition: str) -> str:
    """phrases: SQL for (id) with a row for each hit; condition: on id, over h0, h1, ..."""
    hits = ", ".join(f"h{i} AS (SELECT id, count(*) AS tf FROM ({p}) GROUP BY id)" for i, p in enumerate(phrases))
    each = " UNION ALL ".join(f"SELECT id, tf, (SELECT count(*) FROM h{i}) AS df FROM h{i}" for i in range(len(phrases)))
    score = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))"
    return f"{duck('m_docs')}{TERMS}, {hits} SELECT id, round(-sum({score}), 4) + 0.0 AS rank FROM ({each}) e JOIN dl USING (id), g WHERE {condition} GROUP BY id"


def hit(term: str, more: str = "") -> str:
    return f"SELECT id FROM t WHERE term = '{term}' {more}"


def inside(i: int) -> str:
    return f"id IN (SELECT id FROM h{i})"


SEARCHES = {
    "term": ("license", [hit("license")], "true"),
    "and": ("apache version", [hit("apache"), hit("version")], f"{inside(0)} AND {inside(1)}"),
    "or": ("pour OR erheit", [hit("pour"), hit("erheit")], "true"),
    "not": ("the NOT is", [hit("the")], "id NOT IN (SELECT id FROM t WHERE term = 'is')"),
    "prefix": ("lic*", ["SELECT id FROM (SELECT DISTINCT id, col, pos FROM t WHERE starts_with(term, 'lic'))"], "true"),
    "phrase": ('"apache license"', ["SELECT a.id FROM t a JOIN t b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'apache' AND b.term = 'license'"], "true"),
    "column": ("subject:the", [hit("the", "AND col = 'subject'")], "true"),
    "columns": ("{subject}: (license OR the)", [hit("license", "AND col = 'subject'"), hit("the", "AND col = 'subject'")], "true"),
    "group": ("(apache OR pour) AND version", [hit("apache"), hit("pour"), hit("version")], f"({inside(0)} OR {inside(1)}) AND {inside(2)}"),
}


_INDEXES: dict[tuple[str, str], search.Index] = {}


def indexed(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored index of the documents, built at a session's first search."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = search.build(view(spark, sf_dir, "m_docs"), generated.folder(spark, "index"))
    return _INDEXES[key]


def search_query(text: str, limit: int = -1, ranks: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.search(view(spark, sf_dir, "m_docs"), text, limit, indexed(spark, sf_dir))
        return found.select("id", (F.round("rank", 4) + 0.0).alias("rank")) if ranks else found.select("id")

    return run


for _name, (_text, _hits, _on) in SEARCHES.items():
    query(f"search_{_name}", rank_sql(_hits, _on))(search_query(_text))
query("search_limited", f"SELECT id, rank FROM ({rank_sql([hit('license')], 'true')}) ORDER BY rank, id LIMIT 7")(search_query("license", 7))
query("search_near", f"{duck('m_docs')}{TERMS} SELECT DISTINCT a.id FROM t a JOIN t b ON a.id = b.id AND a.col = b.col WHERE a.term = 'apache' AND b.term = 'version' AND abs(a.pos - b.pos) - 1 <= 3")(search_query("NEAR(apache version, 3)", ranks=False))
query("search_first", f"{duck('m_docs')}{TERMS} SELECT DISTINCT id FROM t WHERE term = 'the' AND pos = 0")(search_query("^the", ranks=False))


@query("fts_index_totals", f"{duck('m_docs')}{TERMS} SELECT (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT term) FROM t) AS terms, (SELECT count(DISTINCT id) FROM t) AS ids")
def fts_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = indexed(spark, sf_dir)
    told = held.postings.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"))
    return told.crossJoin(F.broadcast(held.lengths.agg(F.count(F.lit(1)).alias("ids"))))  # a length for each id; one row on either side


@query("fts_postings_stats", f"{duck('m_docs')}{TERMS} SELECT term, count(DISTINCT id) AS df, count(*) AS n FROM t GROUP BY term")
def fts_postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(view(spark, sf_dir, "m_docs"))
    return rows.groupBy("term").agg(F.count_distinct("id").alias("df"), F.count(F.lit(1)).alias("n"))


@query("snippet_topk")
def snippet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.results(view(spark, sf_dir, "m_docs"), "license OR apache", 20, indexed(spark, sf_dir)).drop("rank")


# Files -----------------------------------------------------------------------------------------

@query("parse_addresses", f"{duck('m_addresses')} SELECT message_id, role, address, name FROM m_addresses WHERE role = 'from'")
def parse_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.address_rows(view(spark, sf_dir, "m_messages").select("id", "sender"))


@query("parse_eml_roundtrip", f"{duck('m_messages', 'm_labels', 'm_attachments')}, e AS (SELECT id, unnest(string_split(label_ids, ',')) AS l, generate_subscripts(string_split(label_ids, ','), 1) AS p FROM m_messages WHERE label_ids <> ''), n AS (SELECT e.id, string_agg(coalesce(n.name, e.l), ',' ORDER BY p) AS labels FROM e LEFT JOIN m_labels n ON n.id = e.l GROUP BY 1), a AS (SELECT message_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM m_attachments GROUP BY 1) SELECT m.id, m.thread_id, m.sender, m.subject, coalesce(internal_date_ms, 0) AS internal_date_ms, coalesce(labels, '') AS labels, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, sha256(body_text) AS body FROM m_messages m LEFT JOIN n ON n.id = m.id LEFT JOIN a ON a.message_id = m.id")
def parse_eml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = sources.rows_back(export.as_eml(export.candidates(mail(spark, sf_dir))))
    size = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["size"])
    return back.select("id", "thread_id", "sender", "subject", "internal_date_ms", F.array_join("label_names", ",").alias("labels"), F.size("attachments").cast("long").alias("files"), size.alias("bytes"), F.sha2(normalise.body(F.col("body_text")), 256).alias("body"))
