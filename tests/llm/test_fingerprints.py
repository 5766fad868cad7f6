"""Fingerprints of texts that repeat long words, and of texts cut into pieces."""

import random

from pyspark.sql import functions as F

from pathlift.llm import fingerprints


def test_repeated_long_words(spark):
    """Nearly all votes are for the same bits, the highest of each lane among them."""
    words = [f"lengthyword{i}" for i in range(40)]
    rows = [(i, f"{word} " * 6_000) for i, word in enumerate(words)] + [(100, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    assert len(got) == 41
    pair = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, w string")
    for r in pair.select("doc_id", fingerprints.as_hex(*[F.xxhash64("w", "w", F.lit(p)) for p in (0, 1)]).alias("f")).collect():
        assert got[r.doc_id].fingerprint == r.f


def test_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    space = [" ", "\n", "\t  ", "\x0b\x0c", "\r\n", " " * 40]
    word = ["ka", "LONGERWORD", "ΟΔΟΣ", "é", "日本語日本語日本語日本語", "😀", "İl", "a" * 50]
    texts = ["", " ", " " * 50, " " * 50 + "one", "one" + " " * 50, "b" * 90]
    for n in (1, 2, 5, 30, 200):
        texts += [rng.choice(["", " " * 20]) + "".join(rng.choice(word) + rng.choice(space) for _ in range(n)) for _ in range(6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    whole = fingerprints.fingerprints(rows, ["k"], "text").collect()
    for chars in (1, 7, 64):
        monkeypatch.setattr(fingerprints, "PIECE_CHARS", chars)
        assert sorted(fingerprints.fingerprints(rows, ["k"], "text").collect()) == sorted(whole)
        pieces = rows.select("k", "text", fingerprints._pieces("text").alias("p"))
        assert pieces.where("octet_length(text) > 0 and concat_ws('', p) <> text").count() == 0
        assert pieces.where(f"octet_length(text) > {chars} and exists(slice(p, 2, 9999), x -> x rlike '^[ \t\n\r]')").count() == 0
