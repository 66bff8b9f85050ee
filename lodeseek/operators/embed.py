"""Embedding: texts to vectors through any embedder; the built-in one hashes words."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import bounded

BATCH = 32
#: Tokens of a text that an embedder looks at.
MAX_TOKENS = 512
_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    model_id: str
    dimension: int
    engine: str
    batch: int | None
    query_prefix: str
    passage_prefix: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class FatalEmbedError(RuntimeError):
    """Ends a build; any other error leaves the file out."""


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed word hashes, normalized: no model, the same everywhere."""

    dimension: int = 384
    model_id: str = "hashing"
    engine: str = "Fastembed"
    batch: int | None = BATCH
    query_prefix: str = ""
    passage_prefix: str = ""
    max_tokens: int = MAX_TOKENS

    def tokens(self, text: str) -> list[str]:
        return _WORD.findall(text.lower())

    def embed(self, texts: list[str]) -> list[list[float]]:
        from xxhash import xxh64_intdigest

        out = []
        for text in texts:
            v = np.zeros(self.dimension, np.float64)
            for w in self.tokens(text)[: self.max_tokens]:
                h = xxh64_intdigest(w.encode(), 7)
                v[h % self.dimension] += 1 if h >> 63 else -1
            length = float(np.sqrt((v * v).sum()))
            out.append((v / length if length else v).astype(np.float32).tolist())
        return out


@dataclass(frozen=True)
class PieceEmbedder(HashingEmbedder):
    """As HashingEmbedder over three-character pieces of words, so that forms of a word are near each other."""

    model_id: str = "pieces"
    engine: str = "Candle"

    def tokens(self, text: str) -> list[str]:
        marked = (f"<{w}>" for w in _WORD.findall(text.lower()))
        return [w[k : k + 3] for w in marked for k in range(max(1, len(w) - 2))]


class Engines:
    """Makers of embedders by engine; load() picks one for a selection (engine, model, dimension).

    Engines whose models are not installed here have stand-ins that need none; register() puts a real one in their place.
    """

    def __init__(self) -> None:
        self.makers: dict[str, Callable[[str, int, str], Embedder]] = {}
        self.register("Fastembed", lambda model, dimension, device: HashingEmbedder(dimension, model))
        self.register("Candle", lambda model, dimension, device: PieceEmbedder(dimension, model))

    def register(self, engine: str, maker: Callable[[str, int, str], Embedder]) -> None:
        """maker(model, dimension, device) gives an embedder; the last one registered for an engine counts."""
        self.makers[engine] = maker

    def load(self, selected: dict, device: str = "Auto") -> Embedder:
        if selected["engine"] not in self.makers:
            raise LookupError(f"no maker of embedders for engine {selected['engine']}; there are {sorted(self.makers)}")
        made = self.makers[selected["engine"]](selected["model"], int(selected["dimension"]), device)
        if made.dimension != int(selected["dimension"]):
            raise ValueError(f"{selected['model']} has dimension {made.dimension}, not {selected['dimension']}")
        return made


def pooling(config_json: str | None) -> str:
    """cls, max or mean, as a model's pooling description asks for; mean where it is missing, broken or asks for nothing."""
    try:
        asked = json.loads(config_json or "{}")
    except ValueError:
        return "mean"
    asked = asked if isinstance(asked, dict) else {}
    return "cls" if asked.get("pooling_mode_cls_token") is True else "max" if asked.get("pooling_mode_max_tokens") is True else "mean"


def prefixes(config_json: str) -> dict[str, str]:
    """query_prefix and passage_prefix of a model's prompts; other prompts and broken files are skipped."""
    try:
        prompts = json.loads(config_json).get("prompts") or {}
    except (ValueError, AttributeError):
        return {}
    out = {}
    for key, value in prompts.items():
        low = key.lower()
        if "query" in low:
            out["query_prefix"] = value
        elif any(w in low for w in ("passage", "document", "doc")):
            out["passage_prefix"] = value
    return out


def embed_query(embedder: Embedder, pattern: str) -> list[float]:
    own = getattr(embedder, "embed_queries", None)
    found = own([pattern]) if own else embedder.embed([embedder.query_prefix + pattern])
    if not found:
        raise ValueError("the embedder returned no vector")
    return found[0]


def embed_passages(chunks: DataFrame, embedder: Embedder, text: str = "chunk_text") -> DataFrame:
    """chunks with embedding and error; batches of the embedder's size, one batch for models that need it.

    An embedder may have its own embed_passages (and embed_queries); else passages get its prefix.
    """
    at = chunks.columns.index(text)
    own = getattr(embedder, "embed_passages", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "") if own else embedder.passage_prefix + (t or "") for t in b.column(at).to_pylist()]
            size = embedder.batch or max(1, len(texts))
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for lo in range(0, len(texts), size):
                part = texts[lo : lo + size]
                try:
                    got = own(part) if own else embedder.embed(part)
                    if len(got) != len(part):
                        raise ValueError(f"expected {len(part)} vectors, got {len(got)}")
                    wrong = [None if len(v) == embedder.dimension else f"dimension {len(v)} is not {embedder.dimension}" for v in got]
                    vectors += [v if w is None else None for v, w in zip(got, wrong, strict=True)]
                    errors += wrong
                except FatalEmbedError:
                    raise
                except Exception as error:  # reported; the file is left out
                    vectors += [None] * len(part)
                    errors += [str(error)] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*b.schema.names, "embedding", "embed_error"])

    added = [F.expr("cast(null as array<float>)").alias("embedding"), F.lit(None).cast("string").alias("embed_error")]
    return bounded(chunks).mapInArrow(run, chunks.select("*", *added).schema)
