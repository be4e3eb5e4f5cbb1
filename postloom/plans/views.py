"""The relational mail model, and views of the driver's tables in its shape.

The views' SQL is shared with DuckDB; two functions differ and are filled in for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ID = "concat(CASE {k} % 3 WHEN 0 THEN 'gmail:' WHEN 1 THEN 'outlook:' ELSE 'thunderbird:' END, CAST({k} AS STRING))"
PERSON = "concat(lower(replace(c.c_name, '#', '.')), '@', lower(c.c_mktsegment), '.example')"

VIEWS = {
    "m_messages": f"""
SELECT {ID.format(k="o.o_orderkey")} AS id, CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_custkey AS STRING) END AS thread_id,
       concat(c.c_name, ' <', {PERSON}, '>') AS sender, concat(o.o_orderpriority, ' order ', CAST(o.o_orderkey AS STRING)) AS subject,
       CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 89 = 0 THEN 0 ELSE $ms(o.o_orderdate) END AS internal_date_ms,
       CASE WHEN o.o_orderkey % 50 = 0 THEN '' WHEN o.o_orderkey % 51 = 0 THEN NULL ELSE concat(o.o_orderstatus, ',', o.o_orderpriority) END AS label_ids,
       concat('Segment ', c.c_mktsegment, ' nation ', CAST(c.c_nationkey AS STRING)) AS body_text, CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY AS fetched_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "m_labels": "SELECT * FROM (VALUES ('O', 'Inbox/Open'), ('F', 'Archive/Finished'), ('1-URGENT', 'Flags/Urgent')) AS t(id, name)",
    "m_addresses": f"""
SELECT {ID.format(k="o.o_orderkey")} AS message_id, 'from' AS role, {PERSON} AS address, c.c_name AS name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL
SELECT DISTINCT {ID.format(k="l.l_orderkey")} AS message_id, CASE WHEN l.l_linenumber = 7 THEN 'bcc' WHEN l.l_linenumber % 3 = 0 THEN 'cc' ELSE 'to' END AS role,
       concat(lower(replace(s.s_name, '#', '.')), '@supplier.example') AS address, CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE s.s_name END AS name
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "m_attachments": f"""
SELECT {ID.format(k="l.l_orderkey")} AS message_id, concat('part-', CAST(l.l_partkey AS STRING), '.bin') AS filename,
       CASE l.l_returnflag WHEN 'A' THEN 'application/pdf' WHEN 'R' THEN 'image/png' ELSE 'text/plain' END AS mime_type,
       CAST(l.l_quantity * 1024 AS BIGINT) AS size, CASE WHEN l.l_linestatus = 'F' THEN $sha(CAST(l.l_partkey AS STRING)) END AS content_sha256
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber >= 4""",
    "m_docs": "SELECT concat('doc:', CAST(doc_id AS STRING)) AS id, source AS thread_id, concat(lang, ',', source) AS label_ids, text AS body_text, substr(text, 1, 60) AS subject FROM documents",
}
TABLES = {"m_messages": ("orders", "customer"), "m_labels": (), "m_addresses": ("orders", "customer", "lineitem", "supplier"), "m_attachments": ("orders", "lineitem"), "m_docs": ("documents",)}


def duck(*names: str) -> str:
    """The views as CTEs for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('$ms', 'epoch_ms').replace('$sha', 'sha256')})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("$ms(o.o_orderdate)", "unix_millis(CAST(o.o_orderdate AS TIMESTAMP))").replace("$sha(CAST(l.l_partkey AS STRING))", "sha2(CAST(l.l_partkey AS STRING), 256)")
    for t in TABLES[name]:
        sql = sql.replace(f" {t} ", f" {{{t}}} ").replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})
