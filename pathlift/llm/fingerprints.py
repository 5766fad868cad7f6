"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are the words of a text and its pairs of neighbouring words; a term weighs by the length of its words. Each term
votes with its weight for the set bits of its hash and against the others. Votes are summed in packed lanes: a hash is
spread over a few longs whose 16-bit lanes each hold one bit, so a sum of longs counts four bits at once in generated
code. Chunks of a text keep the lanes from overflowing; a second sum over 32-bit lanes puts the chunks together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut_lineage, text_of

#: A fingerprint is so many hashes of 64 bits, of the same term under different seeds.
PARTS = 2
BITS = 64 * PARTS
#: Words in a chunk: each votes with at most HEAVIEST * 3, so a lane stays below 2 ** 15. The highest lane ends in the sign
#: of its long: one bit more, and texts that repeat a few long words would overflow the sum.
CHUNK_WORDS = 2_048
HEAVIEST = 4
LANES = 16
#: Characters after which a long text is cut, at the next white space; a piece has fewer than CHUNKS * CHUNK_WORDS words.
PIECE_CHARS, CHUNKS = 65_536, 64
SPACE = r"[\x20\x09-\x0D]"
_ONES_16, _LOW_32 = 0x0001000100010001, 0x0000FFFF0000FFFF


def _weight(word: Column) -> Column:
    return F.when(word.isNull(), 0).otherwise(F.least(F.ceil(F.length(word) / 4), F.lit(HEAVIEST))).cast("long")


def _pieces(text: str) -> Column:
    """A text as runs of whole words. A long one is cut after the word that passes PIECE_CHARS and the white space behind it,
    so every further piece begins with a word: all words of a long text at once would take a hundred times its size."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE_CHARS}}}{SPACE.replace('[', '[^')}*{SPACE}*"), F.lit(0))
    return F.when(F.octet_length(text) <= PIECE_CHARS, F.array(text)).otherwise(cut)


def _terms(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """A row for each word with the hashes and weights of its two terms; one empty row for a piece without words."""
    pieces = texts.select(*keys, F.lower(text_col).alias("lower")).select(*keys, _pieces("lower").alias("piece"))
    further = F.slice("piece", F.lit(2), F.greatest(F.size("piece") - 1, F.lit(0)))
    after = F.transform(further, lambda p: F.split(p, SPACE, 2)[0])
    pieces = pieces.select(*keys, F.posexplode_outer(F.arrays_zip("piece", after.alias("after"))).alias("number", "p"))
    words = F.filter(F.split("p.piece", f"{SPACE}+"), lambda w: w != "")
    listed = pieces.select(*keys, "number", "p.after", words.alias("a"))
    followers = F.slice(F.concat("a", F.array("after")), F.lit(2), F.size("a"))
    words = listed.select(*keys, "number", "a", followers.alias("b"))
    zipped = words.select(*keys, "number", F.arrays_zip("a", "b").alias("pair"))
    rows = zipped.select(*keys, "number", F.posexplode_outer("pair").alias("pos", "t"))
    word, follower = F.col("t")["a"], F.col("t")["b"]
    single = _weight(word)
    double = F.when(follower.isNull(), 0).otherwise(single + _weight(follower)).cast("long")
    out = rows.select(
        *keys, (F.col("number").cast("long") * CHUNKS + F.floor(F.col("pos") / CHUNK_WORDS)).alias("chunk"),
        single.alias("w1"), double.alias("w2"),
        *[F.xxhash64(word, F.lit(p)).alias(f"h1_{p}") for p in range(PARTS)],
        *[F.xxhash64(word, follower, F.lit(p)).alias(f"h2_{p}") for p in range(PARTS)],
    )
    return out


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, f0, f1): the fingerprint as longs; a bit is 1 if votes for it outweigh those against.

    ``keys`` must be unique and not null. Equal texts get equal fingerprints, a text without words gets zero.
    """
    terms = _terms(texts, keys, text_col)

    def votes(p: int, j: int) -> Column:
        lane = lambda h: F.shiftrightunsigned(F.col(h), j).bitwiseAND(F.lit(_ONES_16))
        return F.sum(lane(f"h1_{p}") * F.col("w1") + lane(f"h2_{p}") * F.col("w2")).alias(f"s{p}_{j}")

    sums = [(p, j) for p in range(PARTS) for j in range(LANES)]
    by_chunk = terms.groupBy(*keys, "chunk").agg(
        F.sum(F.col("w1") + F.col("w2")).alias("total"), *[votes(p, j) for p, j in sums])
    halves = [
        F.sum(F.shiftrightunsigned(F.col(f"s{p}_{j}"), 16 * odd).bitwiseAND(F.lit(_LOW_32))).alias(f"v{p}_{j}_{odd}")
        for p, j in sums for odd in (0, 1)
    ]
    whole = by_chunk.groupBy(*keys).agg(F.sum("total").alias("total"), *halves)

    def bit(p: int, b: int) -> Column:
        lane, j = divmod(b, LANES)
        votes_for = F.shiftrightunsigned(F.col(f"v{p}_{j}_{lane % 2}"), 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        value = (1 << b) if b < 63 else -(1 << 63)
        return F.when(votes_for * 2 > F.col("total"), F.lit(value)).otherwise(F.lit(0).cast("long"))

    return whole.select(
        *keys, *[reduce(lambda x, y: x.bitwiseOR(y), [bit(p, b) for b in range(64)]).alias(f"f{p}") for p in range(PARTS)])


def as_hex(*parts: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(p), 16, "0")) for p in parts])


def hamming(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    return 1 - hamming(a, b) / F.lit(float(BITS))


def within(queries: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Pairs (query, point, distance) of hex fingerprints at most ``radius`` bits apart.

    Both inputs have a column ``fingerprint``; equal ones count once. Permuted block tables: the fingerprint is cut
    into radius + 1 blocks, of which two fingerprints within the radius share at least one unchanged. Each block in
    turn moves to the front as the key of a table, and the keys are looked up by equality. A pair is reported by the
    first block that it shares, so by one table only.
    """
    digits = BITS // 4
    if not 0 <= radius < digits:
        raise ValueError("radius must be below the number of hex digits")
    n = radius + 1
    edges = [digits * i // n for i in range(n + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        blocks = F.array(*[F.substring("fingerprint", a + 1, b - a) for a, b in zip(edges, edges[1:])])
        distinct = df.select("fingerprint").where("fingerprint is not null").distinct()
        return distinct.select(F.col("fingerprint").alias(name), blocks.alias(f"{name}_blocks")).select(
            name, f"{name}_blocks", F.posexplode(f"{name}_blocks").alias("block", "key"))

    def longs(name: str) -> list[Column]:
        return [F.conv(F.substring(name, 16 * p + 1, 16), 16, -10).cast("long") for p in range(PARTS)]

    pairs = tables(queries, "query").join(tables(points, "point"), ["block", "key"])
    first = F.array_position(F.zip_with("query_blocks", "point_blocks", lambda a, b: a == b), True) - 1
    apart = hamming(longs("query"), longs("point"))
    return pairs.where((first == F.col("block")) & (apart <= radius)).select("query", "point", apart.alias("distance"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (k, id, h, n), distinct by k, in falling order of the id with their neighbours in a ring.

    Adds next_k, prev_k and prev_n. A range exchange orders the rows; neighbours come from windows within a range and,
    at its ends, from a table with one row for each range.
    """
    order = [F.col("id").desc_nulls_last(), F.col("h")]
    placed = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "n", F.monotonically_increasing_id().alias("pos"))
        .withColumn("range", F.shiftrightunsigned("pos", 33)))
    ends = placed.groupBy("range").agg(F.min_by("k", "pos").alias("first_k"), F.max_by(F.struct("k", "n"), "pos").alias("last"))
    ranges, all_ranges = W.orderBy("range"), W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("first_k").over(ranges), F.first("first_k").over(all_ranges)).alias("after"),
        F.coalesce(F.lag("last").over(ranges), F.last("last").over(all_ranges)).alias("before"),
    )
    inside = W.partitionBy("range").orderBy("pos")
    near = placed.select(
        "k", "range", F.lead("k").over(inside).alias("lead_k"), F.lag("k").over(inside).alias("lag_k"),
        F.lag("n").over(inside).alias("lag_n"))
    return near.join(ends, "range").select(
        "k", F.coalesce("lead_k", "after").alias("next_k"), F.coalesce("lag_k", F.col("before.k")).alias("prev_k"),
        F.coalesce("lag_n", F.col("before.n")).alias("prev_n"))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 3) code points replaced by as many first ones (or all) of the next document
    in falling order of the id; after the last comes the first. Null texts count as empty; null ids come last; rows
    with equal ids are ordered by a hash of the text, and rows equal in both share one answer. A single document is
    its own next. An empty table gives no rows; other columns are ignored.
    """
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.hex("h"))
    base = (
        df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .withColumn("h", F.xxhash64("text")).withColumn("k", key)
    )
    ring = cut_lineage(ordered(base.select("k", "id", "h", F.length("text").alias("n")).distinct()))
    texts = base.select("k", "text").dropDuplicates(["k"]).join(ring, "k")
    heads = texts.select(
        F.col("prev_k").alias("k"), F.substr("text", F.lit(1), F.floor(F.col("prev_n") / 3).cast("int")).alias("head"))
    n = F.length("text")
    both = texts.join(heads, "k").select(
        "k", "next_k", "text",
        F.concat(F.substr("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head")).alias("edited"))
    kinds = both.select("k", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")),
    )).alias("x")).select("k", "x.kind", "x.body")
    found = fingerprints(kinds, ["k", "kind"], "body")
    of = lambda kind, p: F.max(F.when(F.col("kind") == kind, F.col(f"f{p}"))).alias(f"{'fe'[kind]}{p}")
    prints = found.groupBy("k").agg(*[of(kind, p) for kind in (0, 1) for p in range(PARTS)])
    facts = both.select("k", "next_k", F.length("text").alias("n"), F.sha2("edited", 256).alias("sha"))
    done = cut_lineage(prints.join(facts, "k"))
    following = done.select(F.col("k").alias("next_k"), *[F.col(f"f{p}").alias(f"g{p}") for p in range(PARTS)])
    parts = lambda x: [F.col(f"{x}{p}") for p in range(PARTS)]
    answers = done.join(following, "next_k").select(
        "k", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        as_hex(*parts("f")).alias("fingerprint"), as_hex(*parts("e")).alias("edited_fingerprint"),
        likeness(parts("f"), parts("e")).alias("near_edited"), likeness(parts("f"), parts("g")).alias("near_next"))
    return base.select("k", F.col("id").alias(id_col)).join(answers, "k").drop("k")
