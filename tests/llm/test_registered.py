"""The registered queries and the pipeline, executed and held against their contracts by plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pathlift.llm import langid, quality, queries, toxicity
from tests.llm.test_alike import plain_kept
from tests.llm.test_operators import plain_fingerprint

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def run(spark, sf_dir, name, **kinds):
    """Rows of a registered query, one per document, whose columns have the kinds that the contract names."""
    df = queries.QUERIES[name](spark, sf_dir)
    assert {c: k for c, k in df.dtypes if c in kinds} == kinds
    return df.collect()


def fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def plain_toxicity(model, text):
    """Softmax of the averaged vectors: the model holds the difference of both logits for each bucket."""
    class Known(dict):
        def __missing__(self, word):
            return toxicity.grams(word)

    ids, shares = toxicity.bag(text or "", Known())
    x = sum(float(model.buckets[i]) * s for i, s in zip(ids, shares)) + model.bias
    return 1 / (1 + math.exp(-x))


def plain_language(content, text):
    """Every language's size by fresh compressors; the smallest, its score and margin."""
    data = langid.plain(text).encode()
    blocks = [data[i : i + langid.BLOCK_BYTES] for i in range(0, len(data), langid.BLOCK_BYTES)] or [b""]

    def size(part):
        made = zstandard.ZstdCompressor(
            level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(part, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return sum(len(made.compress(b)) for b in blocks)

    return sorted((size(part), lang) for lang, part in content.items())


def test_op1_packing(spark, sf_dir, rows, tokenizer):
    pieces = run(spark, sf_dir, "op1_packing", doc_id="bigint", start="bigint", length="bigint", ids_crc32="bigint",
                 doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    ids = {i: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for i, r in rows.items()}
    cover, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        cover[p.doc_id].append((p.start, p.length))
        used[p.sequence_id].append((p.offset, p.length))
    for found, sizes in ((cover, {i: len(x) for i, x in ids.items()}), (used, None)):
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[key] if sizes else at <= 2048
    assert set(cover) == set(rows)
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in (sum(x for _, x in parts) for parts in used.values()))
    assert padded <= 1.01 * sum(map(len, ids.values()))


def test_op2_toxicity(spark, sf_dir, rows, labels):
    got = run(spark, sf_dir, "op2_toxicity", doc_id="bigint", held_out="boolean", score="double", predicted="int")
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, folds=5)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5)
        assert r.score == pytest.approx(plain_toxicity(model, rows[r.doc_id].text), abs=1e-6)


def test_op3_near_dedup(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op3_near_dedup", doc_id="bigint", fingerprint="string", component_id="bigint")
    points = {i: plain_fingerprint(r.text) for i, r in rows.items()}
    label = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if j < i and label[i] != label[j] and (points[i] ^ points[j]).bit_count() <= 4:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if x == old else x for k, x in label.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{points[i]:016x}", label[i]) for i in rows}


def test_op5_language_id(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op5_language_id", doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), folds=3, held_out=1)
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {*model.content, "und"}
    right = 0
    for r in got:
        text = rows[r.doc_id].text
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        if not text or not langid.LETTER.search(text):
            assert r.lang_pred == "und"
            continue
        ranked = plain_language(model.content, text)
        assert r.lang_pred == ranked[0][1]
        assert r.score == pytest.approx(1 / sum(2.0 ** -min(n - ranked[0][0], 60) for n, _ in ranked))
        assert r.margin == pytest.approx((ranked[1][0] - ranked[0][0]) / ranked[1][0])
        right += r.lang_pred == rows[r.doc_id].lang
    assert right > 0.97 * len(rows)


def test_op7_byte_bpe(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op7_byte_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, r in rows.items():
        ids = enc.encode_ordinary(r.text or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in got} == want


def test_op7_encodes_each_text_once(spark, sf_dir):
    plan = queries.op7_byte_bpe(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    calls = re.findall(r"ArrowEvalPython(?:Exec)? \[(.*?)\](?:, \[|, \d|\n)", plan)
    assert plan.count("ArrowEvalPython") == 1 and "run(run(" not in plan and calls and calls[0].count("run(") == 1


def test_op8_quality(spark, sf_dir, rows, labels):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op8_quality", held_out="boolean", score="double", kept="boolean")}
    assert set(got) == set(rows)
    marks = defaultdict(list)
    for r in labels.collect():
        if r.quality is not None and fold(r.doc_id, 5):
            marks[r.doc_id].append(r.quality)
    paths = defaultdict(lambda: [0.0, 0.0])
    for i, r in got.items():
        known = i in marks
        w = 1.0 if known else quality.SOFT_WEIGHT
        k = float(np.mean(marks[i]) >= 0.5) if known else 1 / (1 + math.exp(-r.evidence))
        site = paths[rows[i].source, rows[i].lang]
        site[0] += w
        site[1] += w * k
    overall = sum(k for _, k in paths.values()) / sum(n for n, _ in paths.values())

    def shrunk(sites, priors):
        told = [(k / n - priors[s], k / n, n) for s, (n, k) in sites.items() if n >= 2]
        strength = quality.LEAST_STRENGTH
        if told:
            m = np.mean([priors[s] for s, (n, _) in sites.items() if n >= 2])
            v = np.mean([d * d - p * (1 - p) / n for d, p, n in told])
            strength = m * (1 - m) / max(v, 1e-9) - 1
        strength = min(max(strength, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)
        return {s: (k + strength * priors[s]) / (n + strength) for s, (n, k) in sites.items()}

    hosts = defaultdict(lambda: [0.0, 0.0])
    for (host, _), (n, k) in paths.items():
        hosts[host][0] += n
        hosts[host][1] += k
    host_rate = shrunk(hosts, {h: overall for h in hosts})
    path_rate = shrunk(paths, {(h, p): host_rate[h] for h, p in paths})
    logit = lambda p: math.log(p / (1 - p))
    for i, r in got.items():
        site = rows[i].source, rows[i].lang
        assert r.host_rate == pytest.approx(host_rate[site[0]]) and r.path_rate == pytest.approx(path_rate[site])
        assert r.score == pytest.approx(1 / (1 + math.exp(-(r.evidence + logit(path_rate[site]) - logit(overall)))))
        assert r.held_out == (fold(i, 5) == 0) and r.kept == (r.score >= 0.5)


def test_op9_token_table(spark, sf_dir, rows, tokenizer):
    got = run(spark, sf_dir, "op9_token_table", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    at, want = 0, set()
    for i in sorted(rows):
        ids = np.array([*tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in got} == want


def test_op10_fingerprints(spark, sf_dir, rows):
    got = {r.doc_id: r for r in run(
        spark, sf_dir, "op10_fingerprints", doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string",
        edited_fingerprint="string", near_edited="double", near_next="double")}
    ring = sorted(rows, reverse=True)
    by_text = defaultdict(set)
    for place, i in enumerate(ring):
        text, following = rows[i].text or "", ring[(place + 1) % len(ring)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + (rows[following].text or "")[:cut]
        r = got[i]
        bits = 4 * len(r.fingerprint)
        share = lambda other: 1 - (int(r.fingerprint, 16) ^ int(other, 16)).bit_count() / bits
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(share(r.edited_fingerprint))
        assert r.near_next == pytest.approx(share(got[following].fingerprint))
        by_text[text].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1


def plain_pipeline(spark, docs, labels):
    """What the four filtering stages leave of rows, each stage by its plain version on what the one before left."""
    schema = docs.schema
    rows = docs.collect()

    def frame():
        return spark.createDataFrame(rows, schema)

    model = toxicity.train(frame(), labels, folds=5)
    rows = [r for r in rows if plain_toxicity(model, r.text) < 0.5]
    content = langid.train(frame(), folds=3, held_out=1).content
    stay = []
    for r in rows:
        if r.text and langid.LETTER.search(r.text):
            ranked = plain_language(content, r.text)
            if len(ranked) == 1 or (ranked[1][0] - ranked[0][0]) / ranked[1][0] >= langid.LEAST_MARGIN:
                stay.append(r)
    first = {}
    for place, r in enumerate(stay):
        body = re.sub("[\x20\x09-\x0D]+", " ", r.text)
        best = first.get(body)
        if best is None or (r.doc_id is None, r.doc_id or 0) < (best[1].doc_id is None, best[1].doc_id or 0):
            first[body] = (place, r)
    rows = [r for _, r in sorted(first.values(), key=lambda x: x[0])]
    keep = plain_kept([(r.doc_id, r.text) for r in rows])
    return [r for place, r in enumerate(rows) if place in keep]


def test_pipeline(spark, sf_dir, labels, tokenizer):
    left = plain_pipeline(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1), labels)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    cover = defaultdict(int)
    for p in pieces:
        cover[p.doc_id] += p.length
    assert cover == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in left}


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns; then no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long_text = " ".join(r.text for r in docs.where("lang = 'en'").limit(40).collect())
    some = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9_001, "", "en", "src0", 0), (9_002, " \n\t", None, None, 3), (9_003, "12 !!", "en", "src1", 5),
         (9_004, long_text, "en", "src0", len(long_text)), (9_004, long_text, "en", "src0", len(long_text))], docs.schema)
    clash = {c: F.lit(1) for c in ("row", "rid", "id", "signature", "judged", "score", "maybe", "root", "key", "n_ids", "tail_len", "part")}
    for number, rows in enumerate((some.union(odd).withColumns(clash), some.where("false"))):
        folder = str(tmp_path / str(number))
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert not kept & {None, 9_001, 9_002, 9_003}
        assert (9_004 in kept) == (number == 0) and (len(kept) > 40) == (number == 0)
