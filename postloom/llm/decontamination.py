"""Benchmark decontamination in DataFrame operations only.

An item is in a document if the document has at least ``share`` of the item's distinct 5-word
shingles (words folded A-Z; an item of fewer words is one shingle, one without words is in none).
An item of n shingles of which ``need`` = ceil(share n) must be there can miss at most n - need of
them, so among its n - need + 1 shingles of least hash at least one is in every document that
contains it. Those bottom-k sketches are the index. Their size, and the fewest shingles that a
document needs, follow from n, so items are dealt by size class: a document is only looked up in
classes that it is long enough for. Unlike with banded signatures of whole documents, a hit
doesn't get less likely with the document's length, and none is missed.

Documents stream past the index: their shingle hashes are exploded and equi-joined with the
sketches (Spark broadcasts them only while they are below its size threshold, and shuffles
beyond). Candidate pairs are then verified on the shingles' text.

Nulls, empty texts: no shingles, no pairs. A null doc_id or item_id gives pairs with null in its
place. Repeated rows give the pair once; of texts that share their ids the pair with most shingles
counts, and of equal counts the larger item. A text of any length is read whole, its shingles'
hashes in one row at a time. Empty tables give no pairs. Other columns are left aside, or pass
through ``without_items`` in a struct, so their names can't clash. Rows are told apart by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, store
from .words import BLANKS, LOWER, UPPER, folded, word_list

SHINGLE = 5
SHARE = 0.8


def shingles(df: DataFrame, text: str, hashed: bool, size: int = SHINGLE) -> DataFrame:
    """Adds ``grams``: the distinct shingles of a text, or (hashed) a hash of the word hashes of
    each shingle, repeats included. Words are bound to a lambda's variable ``w``: as a column
    they would be made anew for each shingle."""
    if hashed:
        words = F.transform(word_list(folded(F.col(text))), lambda x: F.xxhash64(x))
        parts = ", ".join(["x", *[f"get(w, i + {k})" for k in range(1, size)]])
        short, each = "xxhash64(w)", f"transform(slice(w, 1, size(w) - {size - 1}), (x, i) -> xxhash64({parts}))"
    else:
        words = word_list(folded(F.col(text)))
        short, each = "array_join(w, ' ')", f"array_distinct(transform(sequence(1, size(w) - {size - 1}), i -> array_join(slice(w, i, {size}), ' ')))"
    listed = f"CASE WHEN size(w) = 0 THEN array() WHEN size(w) < {size} THEN array({short}) ELSE {each} END"
    return df.withColumn("_words", words).withColumn("grams", F.expr(f"element_at(transform(array(_words), w -> {listed}), 1)")).drop("_words")


def index_of(items: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The sketches (gram hash, item, class) and the items (item, item_id, n, need, shingles)."""
    told = items.select("item_id", "text").distinct()
    hashes = shingles(told, "text", True).withColumnRenamed("grams", "hashes")
    sized = (
        shingles(hashes, "text", False)
        .withColumn("item", F.xxhash64("item_id", "text"))
        .withColumn("n", F.size("grams")).filter("n > 0")
        .withColumn("need", F.ceil(F.col("n") * F.lit(f"{share}").cast("decimal(6,5)")).cast("int"))
        .withColumn("class", F.floor(F.log2("need")).cast("int"))
        .withColumn("hashes", F.array_sort(F.array_distinct("hashes")))
        .select("item", "item_id", "n", "need", "class", "grams", "hashes")
    )
    sized = store(sized, "items")
    sketch = sized.select("item", "class", F.explode(F.slice("hashes", 1, F.col("n") - F.col("need") + 1)).alias("gram"))
    return store(sketch, "sketches"), sized


def row_key(*names: str) -> Column:
    return F.struct(F.xxhash64(*names), F.xxhash64(F.lit(1), *names[::-1]))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for each item contained in a document."""
    sketch, sized = index_of(items, share)
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row"))
    # s shingles take s + 4 words with blanks between, so at least 2 s bytes (a single short one: 1).
    most = F.greatest(F.lit(1), F.octet_length("text") / 2).alias("most")
    # The outer explode: for the inner one Catalyst infers a filter that makes the shingles twice.
    seen = shingles(keyed, "text", True).select("row", most, F.explode_outer("grams").alias("gram"))
    pairs = store(seen.join(sketch, "gram").filter("most >= pow(2, class)").select("row", "item").distinct(), "pairs")
    # A shingle is in a text if it stands between blanks in the text's joined words; one of fewer
    # words than SHINGLE must be the whole text.
    told = keyed.join(pairs, "row").join(sized.drop("hashes", "class"), "item").withColumn("_words", F.concat(F.lit(" "), F.array_join(word_list(folded(F.col("text"))), " "), F.lit(" ")))
    there = f"filter(grams, g -> contains(t, concat(' ', g, ' ')) AND (t = concat(' ', g, ' ') OR size(split(g, ' ')) = {SHINGLE}))"
    return (
        told.withColumn("n_shared", F.expr(f"element_at(transform(array(_words), t -> size({there})), 1)").cast("long"))
        .filter("n_shared >= need").groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", F.col("n").cast("long").alias("n_shingles"))).alias("best")).select("doc_id", "item_id", "best.*")
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the rows that contain an item. Rows are told by doc_id and text."""
    rows = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key"), "text")
    hit = contained(rows.select(F.col("key").alias("doc_id"), "text"), items, share)
    return rows.select("row", "key").join(hit.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{BLANKS}'), lambda x: x <> '')"


GRAMS_SQL = f"CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END"
ORACLE = f"""
WITH iw AS MATERIALIZED (SELECT DISTINCT item_id, text, {words_sql("text")} AS w FROM benchmark),
     i AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {GRAMS_SQL} AS grams FROM iw WHERE len(w) > 0),
     g AS MATERIALIZED (SELECT item, item_id, len(grams) AS n, unnest(grams) AS gram FROM i),
     u AS (SELECT DISTINCT doc_id, text FROM documents),
     dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words_sql("text")} AS w FROM u),
     d AS MATERIALIZED (SELECT r, doc_id, unnest({GRAMS_SQL}) AS gram FROM dw WHERE len(w) > 0),
     p AS (SELECT r, doc_id, item, item_id, n, count(*) AS n_shared FROM d JOIN g USING (gram) GROUP BY ALL),
     h AS (SELECT doc_id, item_id, max(struct_pack(n_shared := n_shared, n := n)) AS best FROM p WHERE n_shared >= ceil(n * {SHARE}::DECIMAL(6,5)) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, best.n_shared::BIGINT AS n_shared, best.n::BIGINT AS n_shingles FROM h
"""
