"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked through hubs (here: equal texts). Every round is a few joins: count the
members of each hub by shard, let each linked document wish for the shard that holds most of its
neighbours, grant wishes that cross each other and beyond these as many as the target has
unattached documents to send the other way, so that after each round as before it the row counts
differ by one at most. A shard that could take nobody is closed, and wishes go to the next best. Rounds go on until no wish is granted or ``PATIENCE`` rounds in turn brought
documents no more neighbours into their own shard; the best round's shards are kept. Of equal wishes
the one whose row hashes lower goes first. The law kept is ``rows``.

A hub of any size costs one row per shard: its members are counted before the shuffle. Quotas,
counts and offsets are per shard, so the driver holds a few numbers for each shard.

Nulls, empty texts: a null text counts 1 byte and crc32 0, and is linked with empty texts. Null
doc_ids keep their row. Repeated rows are rows of their own. An empty table gives an empty
result. A text of any length is hashed where it is and never moved. Columns other than doc_id and
text are left aside.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, number_rows, parts_for, spread_join, store

SHARDS = 16
PATIENCE = 2
#: Beyond so many rounds something is wrong.
ROUNDS = 100
CELL_ROWS = 50_000


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def by_cuts(position: Column, sizes: list[int]) -> Column:
    """The index of the interval of ``sizes`` in which a position lies."""
    ends = list(accumulate(sizes))
    out = F.lit(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        out = F.when(position < ends[i], F.lit(i)).otherwise(out)
    return out.cast("int")


def counted(df: DataFrame, key: str, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    return [got.get(s, 0) for s in range(shards)]


def inflow(grant: dict[tuple[int, int], int], shards: int) -> list[int]:
    net = [0] * shards
    for (source, to), n in grant.items():
        net[to] += n
        net[source] -= n
    return net


def granted(wish: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many wishes from shard to shard are granted: a shard takes as many more rows than leave
    it by a wish of their own as it has free rows to send away."""
    grant = dict(wish)
    while True:
        net = inflow(grant, len(free))
        over = [t for t, n in enumerate(net) if n > free[t]]
        if not over:
            return grant
        for t in over:
            less = net[t] - free[t]
            for pair in sorted((p for p in grant if p[1] == t), key=lambda p: (grant[p], p)):
                taken = min(less, grant[pair])
                grant[pair] -= taken
                less -= taken


def hub_counts(state: DataFrame, members: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The members with their shard, and (hub, n0..) the members of each hub by shard."""
    placed = members.join(state, "uid")
    return placed, placed.groupBy("hub").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"n{s}") for s in range(shards)])


def neighbours(placed: DataFrame, hubs: DataFrame, shards: int) -> DataFrame:
    """(uid, shard, n0..): for each linked row, its hubs' members by shard, itself included."""
    held = [f"n{s}" for s in range(shards)]
    return spread_join(placed, hubs, ["hub"], "uid").groupBy("uid", "shard").agg(*[F.sum(h).alias(h) for h in held])


def together(hubs: DataFrame, shards: int) -> int:
    """How far hubs are in one shard: for each its size times the share of its pairs that are together, in thousandths."""
    n = " + ".join(f"n{s}" for s in range(shards))
    return hubs.agg(F.sum(F.expr(f"({' + '.join(f'n{s} * n{s}' for s in range(shards))}) * 1000 div ({n})"))).first()[0] or 0


def one_round(state: DataFrame, placed: DataFrame, hubs: DataFrame, rows: int, shards: int, closed: set[int]) -> DataFrame:
    """state after one round of wishes; state itself if none was granted. Shards that could take
    nobody are added to ``closed``, and nobody wishes for them any more."""
    quota = quotas(rows, shards)
    cells = parts_for(rows, CELL_ROWS, 8)
    held = [F.col(f"n{s}") for s in range(shards)]
    mates = F.element_at(F.array(*held), F.col("shard") + 1)
    # All members of a hub turn the same way where counts are equal; a shard full of them draws none.
    turn = F.pmod(F.xxhash64(*held), F.lit(shards))
    best = F.greatest(*[F.when((n < q) & (F.lit(s not in closed) | (F.col("shard") == s)), F.struct(n.alias("n"), F.pmod(F.lit(s) + turn, F.lit(shards)).alias("turn"), F.lit(s).alias("s"))) for s, (n, q) in enumerate(zip(held, quota, strict=True))])
    seen = (
        neighbours(placed, hubs, shards).withColumn("mates", mates).withColumn("best", best)
        .withColumn("full", F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1) <= F.col("mates"))
        .withColumn("to", F.when((F.col("best.s") != F.col("shard")) & ~F.col("full") & (F.col("best.n") >= F.col("mates")), F.col("best.s")))
        .select("uid", "mates", "to", (F.col("best.n") - F.col("mates")).alias("gain"))
    )
    wide = store(state.join(seen, "uid", "left"), "wishes")
    wishes = wide.filter("to is not null")
    free = wide.filter("to is null and coalesce(mates, 1) <= 1")
    wish = {(r[0], r[1]): r[2] for r in wishes.groupBy("shard", "to").count().collect()}
    grant = granted(wish, counted(free, "shard", shards))
    closed |= {t for _, t in wish} - {t for (_, t), n in grant.items() if n}
    if not any(grant.values()):
        return state
    at = F.element_at(F.create_map(*[F.lit(x) for (s, t), n in grant.items() for x in (s * shards + t, n)]), F.col("shard") * shards + F.col("to"))
    queue = number_rows(wishes, ["shard", "to"], [-F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(20)), F.col("uid")], "at", cells)
    moved = queue.filter(F.col("at") < at).select("uid", F.col("to").alias("new"))
    net = inflow(grant, shards)
    excess, lack = [max(0, x) for x in net], [max(0, -x) for x in net]
    before = [0, *accumulate(excess)][:-1]
    leaving = number_rows(free.select("uid", "shard"), ["shard"], [F.lit(0), F.col("uid")], "at", cells)
    leaving = leaving.filter(F.col("at") < F.element_at(F.array(*[F.lit(e) for e in excess]), F.col("shard") + 1))
    place = F.element_at(F.array(*[F.lit(b) for b in before]), F.col("shard") + 1) + F.col("at")
    fill = leaving.select("uid", by_cuts(place, lack).alias("new"))
    changes = moved.unionByName(fill)
    after = store(state.join(changes, "uid", "left").select("uid", F.coalesce("new", "shard").alias("shard")), "state")
    drop(wide)
    return after


def balanced(nodes: DataFrame, members: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(uid, shard) for ``nodes(uid)`` linked through ``members(uid, hub)``: row counts differ
    by one at most, and linked rows share a shard as far as the quotas allow."""
    rows = nodes.count()
    cells = parts_for(rows, CELL_ROWS, 8)
    dealt = number_rows(nodes.withColumn("all", F.lit(0)), ["all"], [F.lit(0), F.col("uid")], "at", cells * shards)
    state = store(dealt.select("uid", by_cuts(F.col("at"), quotas(rows, shards)).alias("shard")), "state")
    several = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub")
    linked = store(spread_join(members, several, ["hub"], "uid"), "members")

    def counted_hubs(now: DataFrame) -> tuple[DataFrame, DataFrame]:
        placed, hubs = hub_counts(now, linked, shards)
        return placed, store(hubs, "hubs")

    placed, hubs = counted_hubs(state)
    best, most, idle = state, together(hubs, shards), 0
    closed: set[int] = set()
    for _ in range(ROUNDS):
        was = len(closed)
        after = one_round(state, placed, hubs, rows, shards, closed)
        if after is state:
            if len(closed) == was:
                break
            continue
        drop(hubs, *([] if state is best else [state]))
        state = after
        placed, hubs = counted_hubs(state)
        now = together(hubs, shards)
        if now > most:
            drop(best)
            best, most, idle = state, now, 0
        elif (idle := idle + 1) == PATIENCE:
            break
    else:
        raise RuntimeError("shards didn't settle")
    return best


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = store(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("hub"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "rows",
    )
    placed = balanced(rows.select("uid"), rows.select("uid", "hub"), shards)
    cells = parts_for(rows.count(), CELL_ROWS, 8)
    slots = number_rows(rows.drop("hub").join(placed, "uid"), ["shard"], [F.lit(0), F.col("doc_id"), F.col("uid")], "slot", cells)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
