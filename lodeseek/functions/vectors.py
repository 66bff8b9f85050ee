"""Vectors as arrays; sums are taken in double precision and in array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine similarity with a literal vector; null where either has no direction (all zeros)."""
    b = F.array(*[F.lit(float(x)) for x in query])
    return F.try_divide(dot(a, b), norm(a) * F.lit(sum(float(x) * float(x) for x in query) ** 0.5))


def normalized(a: Column) -> Column:
    """a over its length, which is taken once; a vector of zeros stays as it is."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))), F.lit(0))


def _kept(tokens: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["t"])


def pool_cls(tokens: Column) -> Column:
    """The first token's vector."""
    return F.get(tokens, F.lit(0))


def pool_mean(tokens: Column, mask: Column) -> Column:
    """The mean of the vectors that the mask keeps."""

    def of(kept: Column) -> Column:
        zero = F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double") * 0.0)
        total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
        return F.transform(total, lambda x: x / F.size(kept))

    return F.get(F.transform(F.array(_kept(tokens, mask)), of), F.lit(0))


def pool_max(tokens: Column, mask: Column) -> Column:
    """The largest value of each dimension among vectors that the mask keeps."""
    first = F.transform(F.get(_kept(tokens, mask), F.lit(0)), lambda x: x.cast("double"))
    return F.aggregate(_kept(tokens, mask), first, lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y.cast("double"))))


def pooled(tokens: Column, mask: Column, how: str) -> Column:
    """Token vectors as one, in the way that embed.pooling reads from a model's description."""
    return {"cls": lambda: pool_cls(tokens), "max": lambda: pool_max(tokens, mask), "mean": lambda: pool_mean(tokens, mask)}[how]()
