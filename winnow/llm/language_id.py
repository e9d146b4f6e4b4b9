"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: windows of its training texts. A text is compressed once with every dictionary, and the language whose dictionary leaves the fewest bytes is
predicted. Texts are reduced to lower-case words first (letters and marks, single blanks between), so that case, digits and markup decide nothing. A text is compressed in pieces of ``PIECE`` bytes,
each against the dictionary alone: so all of a long text counts, not just the part before it serves as its own dictionary, and memory stays bounded.

Where the margin between the two smallest sizes is narrow (second / first - 1 < ``narrow``), the text is compressed again at the highest level, which finds matches of three bytes; what is then still narrow is rejected.
score = margin / (margin + narrow), so 0.5 is the point of rejection; with a single language it is 1.

Dictionaries are fitted on a bounded sample: the ``languages`` languages with most training texts (ties by name), and of each ``windows`` windows of ``WINDOW`` characters. The texts of a language are dealt to ``windows``
places by a hash of their words; the one with the smallest hash gives the window of its place. Copies have the same hash, so a text that fills a third of the table gives one window at most, and the choice
needs one grouped minimum. The model depends on the texts and labels only, not on how they are stored.

Texts that are null or have no letter are ``und`` with score 0, as all are without any training text with a letter. Other texts are never ``und`` unless rejection is asked for. Of languages with equal sizes the one with more
training texts is predicted (score 0, rejected).
Null labels are never learned; rows with a null id are predicted but not trained on, and count as not held out. Repeated rows are predicted each. An empty table gives an empty result; columns of the results' names are
replaced, other extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import store

PIECE, WINDOW = 4096, 512
LEVEL, HIGHEST = 6, 19
NARROW = 0.02
UNKNOWN = "und"


def words(text: Column) -> Column:
    """Letters and marks in lower case, single blanks between words."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")))


def train(docs: DataFrame, trains: Column, *, text_col: str = "text", lang_col: str = "lang", languages: int = 128, windows: int = 128) -> list[tuple[str, str]]:
    """(language, dictionary), the language with most training texts first. At most languages * windows windows come to the driver."""
    known = docs.where(trains).where(F.col(lang_col).isNotNull() & F.rlike(text_col, F.lit(r"\p{L}")))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), words(F.col(text_col)).alias("words"))
    known = known.withColumn("hash", F.xxhash64("words"))
    first = F.pmod(F.shiftright("hash", 20), F.greatest(F.lit(1), F.length("words") - WINDOW)).cast("int") + 1
    placed = known.select("lang", F.pmod("hash", F.lit(windows)).alias("place"), "hash", F.substring("words", first, F.lit(WINDOW)).alias("window"))
    least = placed.groupBy("lang", "place").agg(F.min_by("window", "hash").alias("window"), F.count("*").alias("texts"))
    table = store.saved(least, "windows")
    most = table.groupBy("lang").agg(F.sum("texts").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    rows = table.join(F.broadcast(most), "lang").orderBy(F.desc("n"), "lang", "place").select("lang", "window").toArrow()
    store.forget(table)
    made: dict[str, list[str]] = {}
    for lang, window in zip(rows.column("lang").to_pylist(), rows.column("window").to_pylist(), strict=True):
        made.setdefault(lang, []).append(window)
    return [(lang, " ".join(own)) for lang, own in made.items()]


class Sizes:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, model: list[tuple[str, str]], level: int):
        import zstandard

        self.by_language = []
        for _, text in model:
            content = zstandard.ZstdCompressionDict(text.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.by_language.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: bytes) -> list[int]:
        pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
        return [sum([len(c.compress(piece)) for piece in pieces]) for c in self.by_language]


def best(sizes: list[int]) -> tuple[int, float]:
    """(the place of the smallest size, the margin to the next)."""
    if len(sizes) == 1:
        return 0, float("inf")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    return order[0], sizes[order[1]] / sizes[order[0]] - 1


def identify(docs: DataFrame, model: list[tuple[str, str]], *, text_col: str = "text", narrow: float = NARROW, reject: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected. With reject, lang_pred of rejected texts is ``und``."""
    base = docs.drop("lang_pred", "score", "rejected")
    own = base.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train()
    inside = base.select("*", F.when(F.rlike(text_col, F.lit(r"\p{L}")), words(F.col(text_col))).alias("lang_id_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick, thorough = Sizes(shared.value, LEVEL), None
        names = [lang for lang, _ in shared.value]
        for batch in batches:
            rows = []
            for text in batch.column("lang_id_words").cast(pa.large_binary()):
                text = text.as_py()
                if not names or text is None:
                    rows.append((UNKNOWN, 0.0, False))
                    continue
                at, margin = best(quick.of(text))
                if margin < narrow:
                    thorough = thorough or Sizes(shared.value, HIGHEST)
                    at, margin = best(thorough.of(text))
                rejected = margin < narrow
                score = 1.0 if np.isinf(margin) else margin / (margin + narrow) if margin > 0 else 0.0
                rows.append((UNKNOWN if rejected and reject else names[at], score, rejected))
            columns = [batch.column(i) for i in range(len(own))]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*own, "lang_pred", "score", "rejected"])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return inside.mapInArrow(run, schema)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, reject=False).select("doc_id", "held_out", "lang_pred", "score", "rejected")
