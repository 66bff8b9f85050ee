"""Language identification by compression: the language whose dictionary shortens a text most.

For each language a raw-content zstandard dictionary is made of training texts, lower-cased. A text,
lower-cased too, is cut into chunks, all of it, each chunk is compressed with every language's dictionary, and the language
of the smallest sum wins; ties go to the language first in order. The score is the winner's lead, as a
share of the runner-up's size; where it is under MARGIN the
answer is marked as rejected (it stays the best guess).

Training looks at labelled rows only through a bounded sample: SAMPLE buckets of a hash of the text for
each language, of each bucket the text with the smallest hash, and of each such text up to SNIPPET
characters, so a dictionary has at most DICTIONARY bytes. All languages have one: where they are so many that the model would be
over MODEL_BYTES, or its texts over TEXTS, each language has fewer texts and a smaller dictionary. Which rows are sampled depends on texts alone.

Defined results: null texts and texts without a letter are "und" with score 0, rejected; with no
labelled text at all every text is "und"; repeated rows get equal results; columns of the
input named lang_pred, score or rejected are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, by_size, without, write_shared

SAMPLE, SNIPPET, DICTIONARY = 128, 256, 32 << 10
#: Bytes of all dictionaries, about, and sampled texts of all languages.
MODEL_BYTES, TEXTS = 16 << 20, 64_000
CHUNK = 1024
LEVEL = 6
MARGIN = 0.02
UNKNOWN = "und"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", model_bytes: int = MODEL_BYTES, texts: int = TEXTS) -> dict[str, bytes]:
    """A dictionary for each language of labelled rows; null languages and texts without letters are left out."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", F.pmod("h", F.lit(SAMPLE)))
    # Numbers only, so that partial sums are small: one row for each language and bucket.
    least = write_shared(keyed.groupBy("lang", "bucket").agg(F.min("h").alias("h")), "languages")
    n_languages = least.select("lang").distinct().count()
    if not n_languages:
        return {}
    most = max(1, min(SAMPLE, texts // n_languages))
    size = max(1, min(DICTIONARY, model_bytes // n_languages))
    few = least.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("bucket"))).where(F.col("k") <= most)
    chosen = {(r["lang"], r["h"]) for r in few.collect()}
    wanted = labelled.sparkSession.createDataFrame(sorted(chosen), "lang string, h long")
    snippets = keyed.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, SNIPPET)).alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in snippets.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)).lower().encode("utf-8", "replace")[-size:] for k, v in sorted(found.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard

        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        chunks = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.names[k]))
        others = [s for k, s in enumerate(sizes) if k != best]
        lead = (min(others) - sizes[best]) / min(others) if others else 1.0
        return self.names[best], min(1.0, lead), lead < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (columns keep, all by default) with lang_pred, score and rejected."""
    docs = without(docs, ["lang_pred", "score", "rejected"])
    keep = docs.columns if keep is None else keep
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for b in by_size(batches, at):
            made = made or Classifier(dictionaries)
            rows = [made.predict(t.as_py()) for t in b.column(at)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *columns], [*keep, "lang_pred", "score", "rejected"])

    added = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")]
    return bounded(docs).mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in keep], *added).schema)
