"""Every operator against a brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from postloom.llm import common, decontamination, encoding, orderminhash, packing, quality, queries, resemblance, sharding, simhash, substrings, tokencounts, tokenfiles, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, starts int, score string, _row int, `a b` int, `a.b` int, `a-b` int"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [None, "", "   ", "one", "one", "two words", "Same text of five words.", "same TEXT of five words.", PASSAGE, f"before {PASSAGE} after", f"{PASSAGE} {PASSAGE}", LONG, LONG, "tab\tand\n\nlines \x85 é日本 \x1c", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i != 3 else None, t, None, "s", None, i, "r", i, "z", i, i, i, i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[8]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i > 8)) for i in range(15)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "one"), (3, None), (None, "two WORDS"), (5, "absent words that no document has at all")], "item_id long, text string")


def small(spark, kind="documents"):
    return spark.read.parquet(f"{SF}/{kind}.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in small(spark).select("doc_id", "text").collect())


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def components(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


# SimHash ----------------------------------------------------------------------------------------

def slow_fingerprint(text):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, seed=42) >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_simhash_equals_all_pairs(spark, docs):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    fps = [slow_fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = components(len(fps), pairs)
    assert [(got[i].fingerprint, got[i].component_id) for i, _ in docs] == [(f"{f:016x}", docs[r][0]) for f, r in zip(fps, root, strict=True)]


@pytest.mark.parametrize("tile", [4, 8192])
def test_dense_groups_keep_their_links_in_tiles(spark, tile):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**62, 40)}
    for x in list(fps)[:3]:
        for _ in range(60):
            for b in rng.integers(0, 12, 3):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    nodes = {r.node: r.root for r in common.connected(simhash.near_links(rows, 4, tile)).collect()}
    root = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [nodes.get(x, x) for x in fps] == [fps[r] for r in root]


def test_more_blocks_for_more_fingerprints():
    assert simhash.blocks_for(10**5, 4) == 5 and simhash.blocks_for(10**9, 4) == 6
    for m in (5, 6, 7):
        masks = simhash.masks_for(m, 4)
        rng = np.random.default_rng(m)
        for _ in range(200):
            bits = rng.choice(64, 4, replace=False)
            x = sum(1 << int(b) for b in bits)
            assert any(x & mask == 0 for mask in masks)


def shingle_sets(texts, k=5):
    out = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        out.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def test_one_stays_of_planted_copies(spark):
    rng = np.random.default_rng(5)
    texts, likes = [], []
    for edits in (1, 2, 4, 7, 9) * 12:  # of 400 words, up to 5 shingles each
        base = [f"v{x}" for x in rng.integers(0, 5000, 400)]
        copy = list(base)
        for at in rng.choice(400, edits, replace=False):
            copy[at] = "edited"
        texts += [" ".join(base), " ".join(copy)]
        a, b = shingle_sets(texts[-2:])
        likes.append(len(a & b) / len(a | b))
    assert sum(0.8 <= x < 0.85 for x in likes) > 5 and sum(0.9 < x <= 0.95 for x in likes) > 5
    far = " ".join(texts[0].split()[:300] + [f"n{i}" for i in range(100)])
    rows = [(i, t) for i, t in enumerate([*texts, far])]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, len(texts)} | {2 * i for i in range(len(likes))} | {2 * i + 1 for i, x in enumerate(likes) if x < 0.8}


@pytest.mark.parametrize("tile", [2, 512])
def test_similar_groups_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(resemblance, "TILE", tile)
    held = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    docs = sorted((r.doc_id, r.text or "") for r in held.collect())
    sets = shingle_sets([t for _, t in docs])
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b) - 1e-9]
    root = components(len(docs), pairs)
    assert sorted(r.doc_id for r in simhash.one_of_each(held).collect()) == [i for k, (i, _) in enumerate(docs) if root[k] == k]


def test_clashing_ids_lose_no_group(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (1, b), (2, c), (5, c + " z"), (5, c + " y"), (5, b), (7, a), (7, a)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b), (2, c)]
    led = [(1, a), (4, a), (4, b), (9, b)]  # (4, a) has the smaller text and is led by 1
    kept = simhash.one_of_each(spark.createDataFrame(led, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (4, b)]
    nameless = [(None, a), (5, a), (None, b), (None, b), (6, c), (5, c + " z"), (3, a), (9, "q")]
    kept = simhash.one_of_each(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(3, a), (-1, b), (5, c + " z"), (9, "q")])
    tied = [(3, c + " z"), (3, c + " y"), (3, c + " y"), (4, c)]
    assert [r.text for r in simhash.one_of_each(spark.createDataFrame(tied, "doc_id long, text string")).collect()] == [c + " y"]


def test_candidates_come_from_fingerprints(spark, monkeypatch):
    text = [f"v{i}" for i in range(100)]
    rows = spark.createDataFrame([(0, " ".join(text)), (1, " ".join([*text, "z"]))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each(rows).collect()] == [0]
    monkeypatch.setattr(simhash, "alike_links", lambda known, m, number: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect()) == [0, 1]


@pytest.mark.parametrize("m, number, cell", [(8, 10, 2048), (8, 10, 8), (6, 18, 2048), (5, 30, 2048), (4, 64, 2048)])
def test_fingerprints_find_similar_sets(spark, m, number, cell):
    rng = np.random.default_rng(m)
    rows = []
    for size, only in [(4, 0), (8, 1), (36, 4), (360, 40)] * 20:  # in both, and in one each: 0.8 (4 of 5 for the least)
        both = rng.integers(0, 1 << 63, size, np.uint64)
        sets = [np.concatenate([both, rng.integers(0, 1 << 63, n, np.uint64)]) for n in ((0, 1) if not only else (only, only))]
        rows += [(len(rows) + k, resemblance.words_of_bits(x, number).view(np.int64).tolist()) for k, x in enumerate(sets)]
    # A group in which each is like the next only: of all its pairs most aren't.
    chain = rng.integers(0, 1 << 63, 1000, np.uint64)
    start = len(rows)
    rows += [(start + k, resemblance.words_of_bits(chain[20 * k : 20 * k + 200], number).view(np.int64).tolist()) for k in range(40)]
    links = simhash.alike_links(spark.createDataFrame(rows, "node long, fps array<long>"), m, number, cell)
    root = {r.node: r.root for r in common.connected(links).collect()}
    assert [root.get(i, i) for i, _ in rows] == [min(i - i % 2, start) for i, _ in rows]


def test_links_of_a_group_grow_with_its_texts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(simhash, "connected", lambda edges: made.append(edges.count()) or common.connected(edges))
    rng = np.random.default_rng(5)
    both = rng.integers(0, 1 << 63, 200, np.uint64)
    rows = [(i, resemblance.words_of_bits(np.append(both, rng.integers(0, 1 << 63, 10, np.uint64)), 10).view(np.int64).tolist()) for i in range(600)]
    for n in (300, 600):  # in tiles of 32, so that a bucket of most texts is cut into 55 and 190 pairs of tiles
        links = simhash.alike_links(spark.createDataFrame(rows[:n], "node long, fps array<long>"), 8, 10, 32)
        made.append(links.count())
        root = {r.node: r.root for r in common.connected(links).collect()}
        assert [root.get(i, i) for i in range(n)] == [0] * n
        assert made[-1] <= 2 * n
    # At most a link for each block of the first fingerprint.
    assert len(made) == 4 and made[0] <= 8 * 300 and made[2] <= 8 * 600


# Sharding ---------------------------------------------------------------------------------------

def test_shards_are_even_and_groups_together(spark):
    rows = queries.op2_sharding(spark, SF).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    held = {r.doc_id: (r.text or "").encode() for r in small(spark).collect()}
    assert all(r.size == len(held[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(held[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in rows)
    groups = defaultdict(set)
    for r in rows:
        groups[held[r.doc_id]].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 1


def test_a_hot_group_is_split_over_full_shards(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}") for i in range(400)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 8).collect()
    assert set(Counter(r.shard for r in rows).values()) == {50}


def test_groups_end_in_the_fewest_shards(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"g{i // 9 % 40}" if i % 3 == 1 else f"t{i}") for i in range(1600)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 16).collect()
    assert set(Counter(r.shard for r in rows).values()) == {100}
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.text_crc32][r.shard] += 1
    sizes = sorted((sum(g.values()), len(g), max(g.values())) for g in groups.values() if sum(g.values()) > 1)
    hot = sizes.pop()
    assert hot[0] == 534 and hot[1] <= 8 and hot[2] == 100  # six could hold it, were it alone
    cut = sum(n - most for n, _, most in sizes)
    assert cut <= 0.05 * sum(n for n, *_ in sizes)


# Tokens -----------------------------------------------------------------------------------------

ODD = ["a\n", "\na", " a", "a ", "a\n\nb", "a \nb", "x.\nY", "it's. don't,", "é́. ςΣ", "日本. 日", "0 1 0", "  ", "\x1c a", "a\xa0b \xa0", "wo,rd; next: (x)!"]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_as_the_whole(docs, name, spaced):
    enc = encoding.Encoder(encoding.tokenizer_path(name), spaced)
    texts = [t for _, t in docs] + ODD + [a + b for a in ODD for b in ODD]
    for _ in range(2):  # the second time all pieces are known
        whole = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.ids(texts)] == whole


LETTERS = ["a", "b", "It's", "don", "'ll", "'s", "İ", "I", "i̇", "ς", "Σ", "é", "e\u0301", "\u0307", "ß", "ǰ", "ǅ", "ŉ", ".", ",", ";", ":", "!", "?", "..", "?!", " ", "  ", "\n", "\n\n", " \n", "\t", "\xa0", "\u2003", "\x85", "日", "本", "가", "\u1100", "\u1161", "0", "1", "²", "_", "<", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\u200d", "😀", "ﬁ", "A", "\x1c", "ʰ", "ª"]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_random_texts_encode_as_the_library_does(name, spaced):
    from tokenizers import Tokenizer

    enc, plain = encoding.Encoder(encoding.tokenizer_path(name), spaced), Tokenizer.from_file(encoding.tokenizer_path(name))
    rng = np.random.default_rng(11)
    for _ in range(40):
        texts = ["".join(LETTERS[k] for k in rng.integers(0, len(LETTERS), n)) for n in rng.integers(0, 10, 1500)]
        whole = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.ids(texts)] == whole


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.tokenizer_path(name))
    return t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_read_back(spark, docs):
    got = {r.doc_id: r for r in queries.op3_token_files(spark, SF).collect()}
    at = 0
    for i, t in docs:
        ids = [*ids_of("byte_bpe_50k.json", t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_sequences_are_views_of_the_file(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    table = tokenfiles.write_tokens(small(spark), folder, encoding.tokenizer_path("byte_bpe_50k.json"), file_rows=64)
    files = table.orderBy("part").collect()
    assert len(files) > 1
    stream = []
    for f in files:
        file = tokenfiles.TokenFile(f"{folder}/{f.file}")
        for i in range(len(file)):
            ids, mask = file.sequence(i)
            assert len(ids) == len(mask) == tokenfiles.LENGTH and not ids.flags.owndata
            stream += ids[np.array(mask.to_pylist())].tolist()
    assert stream == [x for _, t in docs for x in [*ids_of("byte_bpe_50k.json", t), 0]]


def slow_count(scores, pre):
    """Tokens of the best segmentation by a plain lattice over the characters."""
    best = [(0.0, 0)] + [None] * len(pre)
    for j in range(1, len(pre) + 1):
        for i in range(j):
            piece = pre[i:j]
            if piece in scores:
                got = best[i][0] + scores[piece], best[i][1] + 1
            elif j == i + 1:
                n = len(piece.encode())
                got = best[i][0] + tokencounts.BYTE * n, best[i][1] + n
            else:
                continue
            if best[j] is None or (-got[0], got[1]) < (-best[j][0], best[j][1]):
                best[j] = got
    return best[-1][1]


def test_token_counts_equal_a_plain_lattice(spark, docs):
    scores = tokencounts.pieces(encoding.tokenizer_path(tokencounts.VOCABULARY))
    counts = {w: slow_count(scores, "▁" + w) for w in {w for _, t in docs[:60] for w in t.split()} | {"日本語", "naïve", "x" * 40, "\U0001f600a"}}
    trie = tokencounts.Trie(scores)
    assert {w: trie.count("▁" + w) for w in counts} == counts
    got = {r.doc_id: r for r in queries.op8_token_counts(spark, SF).collect()}
    assert all(got[i].n_pretokens == len(t.split()) for i, t in docs)
    assert all(got[i].n_tokens == sum(counts[w] for w in t.split()) for i, t in docs[:60])


# Packing ----------------------------------------------------------------------------------------

def check_packing(rows, docs, capacity=4096):
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in docs:
        ids = [*ids_of("word_bpe_49k.json", t), 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    slack = 0
    for held in seqs.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
        slack += capacity - at
    return slack


def test_packing(spark, docs):
    assert check_packing(queries.op9_packing(spark, SF).collect(), docs) < 4096


def test_best_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(0, 60))
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        chosen = packing.best_fill(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in chosen.items())


# Passages, benchmark, order min-hash ----------------------------------------------------------

def duck(spark, sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.sql(sql)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    want = duck(spark, queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.fetchall()))


def slow_removal(rows):
    """rows: (doc_id, words)"""
    owner = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            win = tuple(w[k : k + 13])
            if i is not None:
                owner[win] = min(owner.get(win, i), i)
    out = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if i is not None and owner[tuple(w[k : k + 13])] < i}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_passages_on_awkward_rows(awkward):
    rows = [(r.doc_id, words(r.text)) for r in awkward.collect()]
    got = [(r.row.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.deduplicated(awkward).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(slow_removal(rows), key=key)


def test_owners_come_from_the_automaton():
    w = [f"p{i}".encode() for i in range(20)]
    assert substrings.located([b" ".join(w[:14]), b" ".join(w[1:14])], [5, 9]) == [[5, 5], [5]]
    assert substrings.located([b" ".join(w[:14]), b" ".join(w[2:16])], [5, 9]) == [[5, 5], [9, 9]]


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_dealt_by_window_find_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK", 4)
    rng = np.random.default_rng(4)
    common = "every page of this site says so".split()
    rows = []
    for i in range(60):
        body = [f"x{k}" for k in rng.integers(0, 30, 20)]
        rows.append((int(rng.integers(0, 50)), " ".join(body[:8] + common + body[8:] + common + (PASSAGE.split()[: i % 40] if i % 3 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.deduplicated(docs).collect())
    assert got == sorted(slow_removal([(i, words(t)) for i, t in rows])) and sum(r[2] for r in got) > 100


def test_containment_on_awkward_rows(awkward, items):
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontamination.contained(awkward, items).collect()}
    assert got == {(8, 1, 56, 56), (9, 1, 56, 56), (10, 1, 56, 56), (4, 2, 1, 1), (None, 2, 1, 1), (5, None, 1, 1)}


def test_containment_at_the_threshold(spark):
    item = [f"i{k}" for k in range(29)]  # 25 shingles, of which 20 must be there
    docs = spark.createDataFrame([(1, " ".join(["x"] * 5 + item[:24] + ["y"] * 900)), (2, " ".join(["x"] * 5 + item[:23] + ["y"] * 900))], "doc_id long, text string")
    got = decontamination.contained(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_shared) for r in got] == [(1, 7, 20)]


def test_order_min_hash(spark, docs):
    got = {r.doc_id: r for r in queries.op7_order_minhash(spark, SF).collect()}
    down = docs[::-1]
    for k, (i, t) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        changed = orderminhash.edited(t, after)
        a, b, c = (orderminhash.signature(x) for x in (t, changed, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (orderminhash.likeness(a, b), orderminhash.likeness(a, c)) and r.fingerprint == a.tobytes().hex()


def slow_signature(text):
    """Order MinHash from its definition, one k-mer and one function at a time."""
    k, far = orderminhash.K, (1 << 64) - 1
    seen, kmers = Counter(), []
    mix = lambda x: int(orderminhash.mixed(np.array([x], np.uint64))[0])
    for i in range(max(1, len(text) - k + 1) if text else 0):
        gram = text[i : i + k]
        h = min(k, len(text))
        for c in gram:
            h = (h ^ ord(c)) * 0x100000001B3 & far
            h ^= h >> 32
        kmers.append(mix(h + seen[gram] * 0x9E3779B97F4A7C15 & far))
        seen[gram] += 1
    out = []
    for j in range(orderminhash.SKETCHES):
        a = mix((j + 1) * 0x9E3779B97F4A7C15 & far) | 1
        least = sorted(sorted(range(len(kmers)), key=lambda i: (kmers[i] * a & far, i))[: orderminhash.PICKED])  # noqa: B023
        least = least * (orderminhash.PICKED if len(least) == 1 else 1)
        got = a
        for i in least:
            got = mix((got ^ kmers[i]) * 0x9E3779B97F4A7C15 & far)
        out.append(got >> 32 if kmers else 0)
    return out


def test_signatures_equal_the_definition(docs):
    for text in ["", "a", "abcde", "abcdef", "abcdefg", "aaaaaaaaaaaaaaaa", "日本語の長い文です", *[t[:400] for _, t in docs[:12]]]:
        assert orderminhash.signature(text).tolist() == slow_signature(text)


def test_order_min_hash_over_many_ranges(spark, docs):
    one = {tuple(r) for r in orderminhash.neighbours(small(spark)).collect()}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert one == {tuple(r) for r in orderminhash.neighbours(small(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_order_matters_to_order_min_hash():
    w = [f"word{i} and{i * 7}" for i in range(300)]
    a, b = " ".join(w), " ".join(w[150:] + w[:150])
    assert orderminhash.likeness(orderminhash.signature(a), orderminhash.signature(a)) == 1.0
    assert orderminhash.likeness(orderminhash.signature(a), orderminhash.signature(b)) < 0.9


# Classifiers ------------------------------------------------------------------------------------

def test_quality_and_toxicity_on_labels(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    marks = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, sf).collect() if r.doc_id in marks and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    bad = [r.predicted for r in rows if marks[r.doc_id].toxic]
    fine = [r.predicted for r in rows if not marks[r.doc_id].toxic]
    assert sum(bad) > 0.5 * len(bad) and sum(fine) < 0.05 * len(fine)
    rows = [r for r in queries.op4_quality(spark, sf).collect() if r.doc_id in marks]
    good = [r.keep for r in rows if marks[r.doc_id].quality]
    poor = [r.keep for r in rows if not marks[r.doc_id].quality]
    assert sum(good) > 0.93 * len(good) and sum(poor) < 0.5 * len(poor)


def test_scores_mean_the_same_beyond_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pool = [f"plain{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        words = rng.choice(pool, 40).tolist()
        if rng.random() < (0.6 if toxic else 0.15):  # telling, not certain
            words[5] = "vilestword"
        texts.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")

    def mean_score():
        return toxicity.toxicity(docs, docs, labels, learn=True).agg({"score": "avg"}).first()[0]

    whole = mean_score()
    monkeypatch.setattr(toxicity, "ORDINARY", 400)
    assert abs(whole - 0.1) < 0.03 and abs(mean_score() - whole) < 0.05


def test_toxic_text_is_learned_wherever_it_is():
    rng = np.random.default_rng(9)
    pool = [f"plain{i}" for i in range(300)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(pool, 3000))
        rows.append((i, text + " vilestword" * (i % 3 == 0), int(i % 3 == 0)))
    assert min(len(t) for _, t, _ in rows) > 20_000
    model = toxicity.fitted(rows)
    assert b"vilestwor" in model.toxic and model.weights[1] > 0.5


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC", 15)
    monkeypatch.setattr(toxicity, "ORDINARY", 25)
    docs = spark.createDataFrame([(7 if i % 2 else i, f"text {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (7, 8))) for i in range(40)], "doc_id long, toxic int")
    rows, stands = toxicity.sample(docs, labels, True)  # 301 rows are marked toxic, by two labels
    kinds = Counter(y for *_, y in rows)
    assert kinds[1] == 2 and 0 < kinds[0] <= 25 and stands == (38 / kinds[0], 1.0)


def test_the_driver_fits_nothing(spark, monkeypatch):
    args = small(spark), small(spark, "labels"), False
    want = toxicity.fitted(*toxicity.sample(*args))

    driver, fitted = os.getpid(), toxicity.fitted

    def elsewhere(*told):
        assert os.getpid() != driver
        return fitted(*told)

    monkeypatch.setattr(toxicity, "fitted", elsewhere)
    asked = []
    monkeypatch.setattr(toxicity, "scored", lambda docs, model: asked.append(model))
    toxicity.toxicity(args[0], *args)
    assert asked == [want]


def test_both_dictionaries_are_trained(docs):
    rng = np.random.default_rng(3)
    rows = [(toxicity.words_of(t) + [b"vilestword", b"meanestword"] * (i % 4 == 0) * int(rng.integers(1, 4)), int(i % 4 == 0)) for i, t in docs]
    plain, toxic = toxicity.dictionaries(rows)
    assert toxic.endswith(plain) and b"vilestwor" in toxic and b"vilestwor" not in plain and len(toxic) % 48 == len(plain) % 48
    pair = toxicity.compressors(plain, toxic)
    _, most, total, each = toxicity.evidence(rows[0][0], *pair)
    lengths = [(len(pair[0].compress(w)), len(pair[1].compress(w))) for w in toxicity.windows(rows[0][0])]
    saved = [a - b for a, b in lengths]
    assert np.allclose([most, total, each], [np.log1p(max(0, *saved, 0)), np.log1p(sum(x for x in saved if x > 0)), sum(x for x in saved if x > 0) / len(saved)]) and most > 0


def test_posteriors_equal_a_plain_estimate(spark, docs):
    """EM over every document, one at a time."""
    cast = [quality.vote(t.encode()) for _, t in docs]
    good = [1 / (1 + np.exp(-sum(v) - 0.5)) for v in cast]
    for _ in range(200):
        share = min(max(sum(good) / len(good), 1e-3), 1 - 1e-3)
        chance = {}
        for c in (0, 1):
            for j in range(9):
                mass = {k: 0.5 + sum(g if c else 1 - g for g, v in zip(good, cast, strict=True) if v[j] == k) for k in (-1, 0, 1)}
                chance[c, j] = {k: m / sum(mass.values()) for k, m in mass.items()}
        now = []
        for v in cast:
            odds = np.log(share / (1 - share)) + sum(np.log(chance[1, j][k] / chance[0, j][k]) for j, k in enumerate(v))
            now.append(1 / (1 + np.exp(-min(30, max(-30, odds)))))
        if max(abs(a - b) for a, b in zip(good, now, strict=True)) < 1e-7:
            break
        good = now
    got = {r.doc_id: r.posterior for r in queries.op4_quality(spark, SF).collect()}
    assert max(abs(got[i] - g) for (i, _), g in zip(docs, good, strict=True)) < 1e-4


def test_estimate_finds_the_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = [0.9, 0.7, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    share, chance = quality.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.8) < 0.05 and np.abs(chance[1, :, 2] - right).max() < 0.05


# Awkward rows and empty tables ------------------------------------------------------------------

RUNS = {
    "simhash": lambda d, **k: simhash.near_duplicates(d),
    "one_of_each": lambda d, **k: simhash.one_of_each(d),
    "sharding": lambda d, **k: sharding.shard_documents(d),
    "tokens": lambda d, **k: tokenfiles.read_documents(*[(tokenfiles.write_tokens(d, f, encoding.tokenizer_path("byte_bpe_50k.json")), f) for f in [common.new_folder(d.sparkSession, "tokens")]][0]),
    "quality": lambda d, **k: quality.classify(d),
    "toxicity": lambda d, labels, **k: toxicity.toxicity(d, d, labels),
    "passages": lambda d, **k: substrings.deduplicated(d),
    "order": lambda d, **k: orderminhash.neighbours(d),
    "counts": lambda d, **k: tokencounts.token_counts(d),
    "packing": lambda d, **k: packing.pack_documents(d),
    "benchmark": lambda d, items, **k: decontamination.contained(d, items),
    "without": lambda d, items, **k: decontamination.without_items(d, items),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_awkward_rows_and_empty_tables(awkward, empty, labels, items, name):
    rows = RUNS[name](awkward, labels=labels, items=items).collect()
    n = awkward.count()
    if name in ("simhash", "sharding", "tokens", "quality", "toxicity", "passages", "order", "counts"):
        assert len(rows) == n
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == n
    if name == "without":
        assert len(rows) == n - 8 and rows[0].asDict().keys() == set(awkward.columns)
    if name == "one_of_each":
        assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    assert RUNS[name](empty, labels=labels.limit(0), items=items).collect() == []


def test_a_hundred_thousand_equal_rows(spark):
    many = spark.range(100_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 7L END AS doc_id", "'the same short text, said once more' AS text")
    assert simhash.near_duplicates(many).groupBy("component_id").count().collect()[0]["count"] == 100_000
    assert simhash.one_of_each(many).collect() == [many.filter("doc_id = 7").first()]
    assert {r["count"] for r in sharding.shard_documents(many).groupBy("shard").count().collect()} == {6250}
    packed = packing.pack_documents(many).groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).toPandas()
    assert packed["sum(length)"].sum() % 100_000 == 0 and packed["sum(length)"].max() <= 4096
    assert substrings.deduplicated(many).filter("n_removed > 0").count() == 0


def stages_of(spark, docs, items, labels, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_on_awkward_rows_and_an_empty_table(spark, awkward, empty, labels, items, tmp_path):
    rows = stages_of(spark, awkward, items, labels.withColumn("toxic", labels.toxic * 0), tmp_path / "a").collect()
    # Of each text one row stays, but for those that hold an item (PASSAGE twice beside others, "one", "two words").
    assert sorted({r.doc_id if r.doc_id is not None else -1 for r in rows}) == [0, 6, 11, 13, 14]
    assert stages_of(spark, empty, items, labels, tmp_path / "e").collect() == []


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


# Pipeline ---------------------------------------------------------------------------------------

def test_pipeline_against_a_brute_force(spark, docs):
    docs_in = small(spark)
    toxic = {r.row.doc_id for r in toxicity.toxicity(docs_in, docs_in, small(spark, "labels")).filter("score >= 0.3").collect()}
    left = [(i, t) for i, t in docs if i not in toxic]
    sets = shingle_sets([t for _, t in left])
    root = components(len(left), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b) - 1e-9])
    left = [x for i, x in enumerate(left) if root[i] == i]
    cut = slow_removal([(i, words(t)) for i, t in left])
    left = [(i, kept.decode() if gone else t) for (i, t), (_, _, gone, kept) in zip(left, cut, strict=True)]

    def grams(t):
        w = [x.lower() for x in words(t)]
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    items = [grams(r.text) for r in small(spark, "benchmark").collect()]
    left = [(i, t) for i, t in left if not any(g and len(g & grams(t)) >= 0.8 * len(g) - 1e-9 for g in items)]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in left}
    check_packing(rows, left)
