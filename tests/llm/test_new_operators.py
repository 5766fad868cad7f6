"""Merkle manifest, resampling and exact top-k against plain versions, on rows with nulls, ties, repeats and clashes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlift.llm import merkle, resampling, topk
from pathlift.operators.ranking import numbered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed, n, sep=" "):
    rng = random.Random(seed)
    return sep.join("".join(rng.choice(["ka", "Lo", "mi", "ten", "é", "ſ7", "漢"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- numbering ---------------------------------------------------------------------------------------------------------


def test_numbering_has_no_gaps(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 7}", i % 11, i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = numbered(df, [F.desc("v"), F.asc("i")], by=["g"], into="at", size_into="n").collect()
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((-v, i))
    want = {i: (at, len(members)) for members in groups.values() for at, (_, i) in enumerate(sorted(members))}
    assert {r.i: (r["at"], r.n) for r in got} == want
    whole = numbered(df, [F.asc("i")]).collect()
    assert all(r.position == r.i for r in whole)
    assert numbered(df.where("false"), [F.asc("i")]).count() == 0


# --- merkle manifest -----------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and for every leaf the (left, right) siblings level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            first = at[k] - at[k] % 3
            path.append((level[first : at[k]], level[at[k] + 1 : first + 3]))
            at[k] //= 3
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_proofs(rows):
    """The whole contract for rows (doc_id, source, lang, n_chars, text)."""

    def leaf(values):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    trees = {g: plain_tree([m[2] for m in sorted(members, key=lambda m: m[:3])]) for g, members in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for (_, _, own, row), path in zip(sorted(groups[g], key=lambda m: m[:3]), trees[g][1]):
            path, folded = path + tops[place], own
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                folded = leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in path:
                folded = H(*left, folded, *right)
            proof = H(*[h for left, right in path for h in left + right])
            out.append((row[0], own, trees[g][0], root, proof, folded, folded == root))
    return sorted(map(str, out))


def manifest_rows():
    rng = random.Random(1)
    rows = []
    for i in range(700):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", "", None])
        rows.append((i, source, rng.choice(["en", None]), i % 5 or None, rng.choice([prose(i, 5, "\n"), prose(i, 4), "", None])))
    rows += [(i, f"s{i}", "en", 1, "x\ny") for i in range(1_000, 1_030)]  # sources with one row each
    rows += [(7, "hot", None, None, "again\n"), (7, "hot", None, None, "again\n"), (None, "hot", "en", 3, "no\nid"), (None, None, None, None, None)]
    rows += [(5_000, "long", "en", 1, prose(9, 30_000, "\n"))]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ("tree", "hash", "own", "pos", "n", "beneath", "leaf", "id", "group", "_at")


@pytest.mark.parametrize("stride", [1, 2, merkle.STRIDE])
def test_manifest_proofs(spark, stride, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES_A_COPY", 27)
    rows = manifest_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in CLASH})
    got = merkle.tamper_proofs(df, stride=stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = got.collect()
    assert sorted(str(tuple(r)) for r in found) == plain_proofs(rows)
    assert 0 < sum(not r.verified for r in found) < len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 81, 82])
def test_manifest_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"line\n{i}") for i in range(n)]
    got = merkle.tamper_proofs(spark.createDataFrame(rows, SCHEMA), stride=4).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_proofs(rows)


def test_manifest_of_nothing(spark):
    assert merkle.tamper_proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_nodes_are_linked(spark, monkeypatch):
    """Every node but the last leads to another one, and no key of the climb's join stands for too many leaves."""
    monkeypatch.setattr(merkle, "LEAVES_A_COPY", 27)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 9}", f"{i}") for i in range(900)], "id long, g string, t string")
    found = merkle.manifest(df.withColumn("leaf", F.sha2("t", 256)), "g", ["id"], stride=2)
    nodes = found.nodes.collect()
    keys = {(r.tree, r.hop, r.pos, r.copy) for r in nodes}
    assert len(keys) == len(nodes)
    ends = [r for r in nodes if r.up_tree is None]
    assert {r.hop for r in ends} == {merkle.LEAF_OF_TOP}  # four groups: one step leads through the upper tree
    for r in [*nodes, *found.blocks.collect()]:
        if r.up_tree is not None:
            assert all((r.up_tree, r.up_hop, r.up_pos, c) in keys for c in range(r.up_copies))
    assert max(Counter((r.tree, r.hop, r.pos) for r in nodes).values()) >= 600 // 27
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert merkle.climbed(found, "leaf").where("folded_root = root").count() == 900
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    assert found.subroots.count() == df.select("g").distinct().count()


# --- resampling ----------------------------------------------------------------------------------------------------------


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_resampled(docs, target):
    def buckets(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out, may = [], []
    for place, (i, text) in enumerate(docs):
        found = buckets(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(plain_words(text)) >= 20:
            may.append(place)
    may.sort(key=lambda p: (-out[p][3], out[p][0] is None, out[p][0] or 0))
    for rank, p in enumerate(may[: 5 * len(may) // 100], 1):
        out[p][4] = rank
    return sorted(map(str, out))


def test_resampling(spark):
    docs = [(i, prose(i % 150, 5 + i % 60, " " if i % 4 else "-~\t\n ")) for i in range(400)]
    docs += [(900, None), (901, ""), (902, " !\x7f\x00 `{"), (None, prose(3, 40)), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(903, prose(4, 20_000)), (904, "z" * 70_000 + " a " + "y" * 300), (905, "a" * 127 + " " + "b" * 128)]
    target = [prose(2, 60), None, "", prose(903, 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns(
        {c: F.lit(1) for c in ("ends", "crcs", "weight", "n_words", "rank", "score", "item", "bucket")})
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(df, goal).select("doc_id", "n_features", "weight", "score", "rank")
    assert dict(got.dtypes) == dict.fromkeys(got.columns, "bigint")
    found = got.collect()
    assert sorted(str(list(r)) for r in found) == plain_resampled(docs, target)
    assert sum(r["rank"] is not None for r in found) > 10
    assert resampling.resampled(df.where("false"), goal).count() == 0
    alone = resampling.resampled(df, goal.where("false")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(list(r)) for r in alone) == plain_resampled(docs, [])


def test_crc_of_any_substring_from_two_prefixes():
    rng = random.Random(4)
    data = rng.randbytes(40_000)
    spans = [(a, b) for a, b in ((rng.randrange(40_000), rng.randrange(40_000)) for _ in range(500)) if a <= b]
    spans += [(0, n) for n in (0, 1, 127, 128, 129, 16_383, 16_384, 40_000)]
    prefix = np.array([zlib.crc32(data[:a]) for a, _ in spans], np.uint32)
    whole = np.array([zlib.crc32(data[:b]) for _, b in spans], np.uint32)
    length = np.array([b - a for a, b in spans], np.int64)
    got = whole ^ resampling.shifted(prefix, length)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    assert resampling.after_separator(prefix).tolist() == [zlib.crc32(data[:a] + b" ") for a, _ in spans]


def test_scan_stores_one_entry_a_word():
    ends, crcs = resampling.scan("  Ab,c9\tÉé ")
    normal = "ab c9 Éé".encode()
    assert ends.tolist() == [2, 5, 10] and crcs.tolist() == [zlib.crc32(normal[:e]) for e in (2, 5, 10)]
    assert [len(x) for x in resampling.scan("")] == [0, 0]


# --- exact top-k -----------------------------------------------------------------------------------------------------------


def plain_top(rows, every, top=5):
    used = []
    for place, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((place, i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for p, i, q in used:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for o, j, x in used if o != p)[:top]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, lane", [(1 << 20, 1 << 20), (40, 7)])
def test_top_k(spark, shard, lane):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (300, 6)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(1_000 + i, base[5]) for i in range(120)]  # one very common vector, with ties by the hundred
    rows += [(50, base[7]), (50, base[7]), (None, base[1]), (2_000, None), (2_001, [0.1, None]), (2_002, [float("nan")] * 6)]
    rows += [(2_003, [float("inf")] + [0.0] * 5), (2_050, []), (2_100, [0.0] * 6), (2_150, [0.5, -0.5]), (2_200, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns(
        {c: F.lit(0) for c in ("row", "x", "asks", "shard", "lane", "cell", "score", "rank")})
    got = topk.top_k(df, 50, shard_rows=shard, lane_rows=lane)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 50)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.0]), (3, [-1.0, 1.0])], "vec_id int, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 50).collect())) == plain_top([tuple(r) for r in df.collect()], 50)
    assert topk.top_k(df.where("vec_id = 50"), 50).count() == 0 and topk.top_k(df.where("false"), 50).count() == 0


def test_the_threshold_ends_the_search_early():
    """Vectors that point one way in a few dimensions: the bound falls fast, and most are never scored."""
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.integers(-3, 4, (5_000, 4)), rng.integers(200, 260, (20, 4))])
    ids = np.arange(len(vectors))
    lists = topk.SortedLists(ids, ids, vectors)
    scored = []
    plain = lists.scores
    lists.scores = lambda at, query: scored.append(len(at)) or plain(at, query)
    got, scores, depth = lists.search(np.array([9, 8, 7, 6]), -1, 5)
    order = np.lexsort((ids, -(vectors @ [9, 8, 7, 6])))[:5]
    assert got.tolist() == order.tolist() and depth <= 64 and sum(scored) < 200
    huge = topk.SortedLists(ids, ids, vectors.astype(np.int64) << 26)  # beyond what floating point holds exactly
    assert huge.search(np.array([9, 8, 7, 6]) << 20, -1, 5)[0].tolist() == got.tolist()
