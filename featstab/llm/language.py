"""Language identification by compression.

Each language's raw-content zstandard dictionary is a bounded sample of pieces of its labelled texts, drawn from all of every text. A
text belongs to the language whose dictionary compresses it to the fewest bytes; a narrow margin over the second language rejects the
decision. Case is folded first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, fold, small_batches, table, utf8

#: Letters, and numbers that are no decimal digits.
WORDLIKE = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category, as \\p{L} has it."""
    return any(c.isalpha() for run in WORDLIKE.finditer(text) for c in run[0])


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned (``pieces`` of ``piece`` characters a language), ``level`` of compression, ``chunk`` bytes compressed
    at a time and ``least_margin``, relative to the best size, under which a text is rejected."""

    pieces: int = 112
    piece: int = 1000
    level: int = 9
    chunk: int = 2048
    least_margin: float = 0.005


def learn(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each non-null language of ``labelled``, the commonest language first; rows with null or letterless text teach nothing.

    Texts are cut into pieces, whole; those of the smallest hash of text and place are the sample, the same on every run and whatever
    the keys are. Equal texts of a language teach once. At most ``pieces`` pieces a language reach the driver; the number of languages
    is that of the labels. The share of pieces that is looked at follows from the language's size and grows where copies make it short."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.ceil(F.length(text) / settings.piece).alias("n"), F.xxhash64(F.col(text), F.lit(17)).alias("x"))
    totals = rows.groupBy("l").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    size, wide = {r["l"]: r["n"] for r in totals}, 1 << 40
    share = {k: min(1.0, 2 * settings.pieces / n) for k, n in size.items()}
    found: dict[str, list[str]] = {}
    while share:
        least = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(wide * v))))
        chosen = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.pmod(F.xxhash64(F.col("x"), i), F.lit(wide)) < least[F.col("l")])
        some = rows.where(F.col("l").isin(list(share))).select("l", "t", "x", F.explode(chosen).alias("i"))
        some = some.select("l", F.pmod(F.xxhash64("x", "i"), F.lit(wide)).alias("h"), F.substring(F.col("t"), (F.col("i") * settings.piece + 1).cast("int"), F.lit(settings.piece)).alias("p")).distinct()
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "p"))).where(F.col("r") <= settings.pieces)
        got: dict[str, list[str]] = {}
        for r in some.orderBy("l", "r").collect():
            got.setdefault(r["l"], []).append(r["p"])
        found |= {k: got.get(k, []) for k, v in share.items() if v == 1.0 or len(got.get(k, ())) >= settings.pieces}
        share = {k: min(1.0, 16 * v) for k, v in share.items() if k not in found}
    return {r["l"]: b"\n".join(p.lower().encode() for p in found[r["l"]]) for r in sorted(totals, key=lambda r: (-r["rows"], r["l"]))}


class Judge:
    """Compressors of one worker, one for each language."""

    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.settings, self.by = settings, {}
        for name, raw in dictionaries.items():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=settings.level)
            self.by[name] = zstandard.ZstdCompressor(level=settings.level, dict_data=own, write_content_size=False, write_dict_id=False)

    def sizes(self, raw: bytes) -> list[tuple[int, str]]:
        """(bytes, language), smallest first, ties to the commoner language."""
        step = self.settings.chunk
        parts = [raw[i : i + step] for i in range(0, len(raw), step)]
        return sorted(((sum(len(c.compress(p)) for p in parts), name) for name, c in self.by.items()), key=lambda x: x[0])

    def __call__(self, raw: bytes | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not raw or not self.by or not has_letter(shown := raw.decode("utf-8", "replace")):
            return "und", 0.0, True
        sizes = self.sizes(shown.lower().encode())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        best, second = sizes[0][0], sizes[1][0]
        return sizes[0][1], (second - best) / second, second - best < self.settings.least_margin * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings(), text: str = "text", key: str = "doc_id", held_out: str | None = None) -> DataFrame:
    """A row per document: key, ``lang_pred``, ``score`` (how much smaller the best size is than the second, 0 to 1), ``rejected``.

    Null, empty and letterless texts are ``und`` with score 0, rejected; so is every text where no language was learned. Equal sizes
    take the language with more labelled rows, with score 0. Whole texts are compressed, chunk by chunk. Repeated rows give repeated results,
    other columns are not read, an empty table gives an empty result. ``held_out`` names a boolean column to carry."""
    kept: dict = {}

    def function(batch: pa.RecordBatch) -> dict:
        if not kept:
            kept["judge"] = Judge(dictionaries, settings)
        found = [kept["judge"](raw) for raw in utf8(batch, text)]
        carried = {held_out: batch.column(held_out)} if held_out else {}
        return {key: batch.column(key)} | carried | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + (f"`{held_out}` boolean, " if held_out else "") + "lang_pred string, score double, rejected boolean"
    return arrow_map(docs.select(key, text, *([held_out] if held_out else [])), schema, function)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that identify() would not reject."""
    small_batches(docs.sparkSession)

    def run(batches):
        judge = Judge(dictionaries, settings)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([not judge(raw)[2] for raw in utf8(batch, text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the two folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    return identify(docs, learn(docs.where(~F.col("held_out"))), held_out="held_out")
