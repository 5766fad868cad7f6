"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language gets a zstandard raw-content dictionary of excerpts of its documents. A text is compressed with every
dictionary and the smallest output wins. Narrow margins are rejected.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold, text_of, unused
from .words import held

#: A dictionary holds one excerpt from each of so many hash classes of the documents of its language.
EXCERPTS, EXCERPT_CHARS = 256, 384
#: Texts are compressed in blocks, so that the dictionary matters for all of a long text and not for its start only.
BLOCK_BYTES = 8_192
LEVEL = 6
#: Output bytes by which the next language must be larger, as a share, for a text to be accepted.
LEAST_MARGIN = 0.002
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BETWEEN = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case words with a space between them: case, digits and marks say nothing about a language."""
    return BETWEEN.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """Language to dictionary content; about EXCERPTS * EXCERPT_CHARS characters a language."""

    content: dict[str, bytes]


def excerpts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int) -> DataFrame:
    """Rows (lang, excerpt) of the bounded sample, from documents outside the held-out fold that name a language.

    Of each hash class of a language the document with the smallest hash gives one excerpt, at a place that follows
    from the hash. Combined before the shuffle, so a frequent language costs no more than a rare one.
    """
    hashed = F.xxhash64(id_col, text_col)
    text = F.col(text_col)
    room = F.greatest(F.length(text) - EXCERPT_CHARS + 1, F.lit(1))
    excerpt = F.substr(text, (F.pmod(F.shiftright(hashed, 16), room) + 1).cast("int"), F.lit(EXCERPT_CHARS))
    return (
        docs.where(
            F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN) & F.col(text_col).rlike(r"\p{L}")
            & (F.coalesce(crc_fold(id_col, folds), F.lit(held_out)) != held_out)
        )
        .groupBy(F.col(lang_col).alias("lang"), F.pmod(hashed, F.lit(EXCERPTS)).alias("class"))
        .agg(F.min(F.struct(hashed.alias("h"), excerpt.alias("excerpt"))).alias("first"))
        .select("lang", "class", "first.excerpt")
    )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3,
          held_out: int = 1) -> LanguageModel:
    """Dictionaries from the bounded sample: EXCERPTS excerpts of EXCERPT_CHARS characters for each language.

    Documents without text, letters, language or id are not learnt from; without any there is no language. Repeated rows
    count once, as they have one hash.
    """
    content: dict[str, list[str]] = {}
    for row in sorted(excerpts(docs, id_col, text_col, lang_col, folds, held_out).collect()):
        content.setdefault(row.lang, []).append(plain(row.excerpt))
    return LanguageModel({lang: " ".join(parts).encode() for lang, parts in sorted(content.items())})


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


class Compressors:
    def __init__(self, model: LanguageModel):
        self.by_lang = {lang: _compressor(content) for lang, content in model.content.items()}

    def ranked(self, text: str) -> list[tuple[int, str]]:
        """(output bytes, language), smallest first."""
        data = plain(text).encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [b""]
        return sorted((sum(len(c.compress(block)) for block in blocks), lang) for lang, c in self.by_lang.items())

    def judge(self, text: str | None) -> dict:
        """Ties go to the language that comes first by name, with a margin of zero."""
        if text is None or not self.by_lang or not LETTER.search(text):
            return {"lang": UNKNOWN, "score": 0.0, "margin": 0.0, "accepted": False}
        ranked = self.ranked(text)
        best, lang = ranked[0]
        if len(ranked) == 1:
            return {"lang": lang, "score": 1.0, "margin": 1.0, "accepted": True}
        margin = (ranked[1][0] - best) / ranked[1][0]
        score = 1 / sum(2.0 ** -min(size - best, 60) for size, _ in ranked)
        return {"lang": lang, "score": score, "margin": margin, "accepted": margin >= LEAST_MARGIN}


def judged(model: LanguageModel, column: Column) -> Column:
    """Struct (lang, score, margin, accepted) of a whole text.

    ``und`` and not accepted if the text is null or has no letter, or no language was learnt. The score halves the
    odds of a language for each byte that it needs more; the margin is the distance to the next as a share.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())])
    name = hashlib.sha256(repr(model.content).encode()).hexdigest()

    @F.arrow_udf("lang string, score double, margin double, accepted boolean")
    def run(texts: pa.Array) -> pa.Array:
        compressors = held((Compressors, name), lambda: Compressors(model))
        return pa.array([compressors.judge(t) for t in texts.to_pylist()], kind)

    return run(column.cast("string"))


def identified(df: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """All columns and the struct; where ``into`` is taken, the new column has underscores in front."""
    return df.withColumn(unused(into, df.columns), judged(model, F.col(text_col)))


def kept(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Rows whose language is accepted, columns as they came."""
    name = unused("judged", df.columns)
    return df.withColumn(name, judged(model, F.col(text_col))).where(F.col(name)["accepted"]).drop(name)
