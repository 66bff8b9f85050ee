"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Seven rules look at counts of a text and each votes good, bad or abstains. A document's
votes make a pattern; there are at most 3^7 patterns, however many documents there are, so
the pattern counts (a pre-aggregated groupBy) are all that fitting needs. Junk comes in
kinds, so there is a class of good documents and one of junk for each rule. Expectation-
maximisation over the counts estimates the shares of the classes and how often each rule
votes bad, abstains or votes good in each, and with that the rules' accuracies. The posterior
probability that a document is good, given its votes, replaces "must pass every filter".

The main path has built-in functions only. Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: a null text has no words and so fails the base; an empty text likewise; equal
rows get equal results; columns of the input with names of the result's are replaced; an empty
table gives an empty result (the fit then returns its priors).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, let, without, write_shared

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*COUNTS, "n_lines", "n_upper", "n_shouts")
RULES = ("length", "word_length", "symbols", "repetition", "lines", "capitals", "shouting")
BAD, ABSTAIN, GOOD = 0, 1, 2

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Windows found twice are looked up in a list up to this size, else all windows are sorted.
_LIST = 64


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Hashes tell whether and which windows may repeat; texts of those windows decide.
    """
    starts = lambda: F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(ordered: Column) -> Column:
        alike = lambda i, x: F.get(ordered, i)["s"].eqNullSafe(x["s"])
        twice = F.filter(F.transform(ordered, lambda x, i: F.when(alike(i - 1, x) | alike(i + 1, x), x["p"])), lambda p: p.isNotNull())
        gaps = lambda at: F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return let(F.sort_array(twice), lambda at: F.aggregate(gaps(at), F.lit(0), lambda a, x: a + x))

    def exact(hashes: Column, doubled: Column) -> Column:
        chosen = F.filter(
            F.transform(hashes, lambda h, i: F.when((F.size(doubled) > _LIST) | F.array_contains(doubled, h), i)), lambda i: i.isNotNull()
        )
        texts = F.transform(chosen, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("s"), i.alias("p")))
        return let(F.sort_array(texts), covered)

    def decide(hashes: Column) -> Column:
        doubled = lambda s: F.array_distinct(F.filter(s, lambda h, i: h.eqNullSafe(F.get(s, i - 1))))
        many = let(F.sort_array(hashes), lambda s: let(doubled(s), lambda d: exact(hashes, d)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(many)

    windows = F.transform(starts(), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, decide)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds FEATURES, all long, of every whole text."""
    kept = without(docs, list(FEATURES))
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    of_words = let(
        words,
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated")),
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counted = let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), body.alias("t")),
        lambda s: F.struct(
            s.w.n.cast("long").alias("n_words"), s.w.chars.cast("long").alias("word_chars"),
            F.regexp_count(s.t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            s.l.dup.cast("long").alias("n_dup_lines"), s.w.repeated.cast("long").alias("n_repeat_words"),
            s.l.n.cast("long").alias("n_lines"), F.regexp_count(s.t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(s.t, F.lit("[!?]")).cast("long").alias("n_shouts"),
        ),
    )
    # One expression, exploded: later steps then read its fields and never evaluate it again.
    return kept.select("*", F.inline(F.array(counted)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote from FEATURES. Between its two bounds a rule abstains."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    vote = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    mean = per("word_chars", "n_words")
    over = lambda x, bad, good: vote(x > bad, x <= good)
    return {
        "length": vote(F.col("n_words") < 20, F.col("n_words") >= 100),
        "word_length": vote((mean < 2.5) | (mean > 12), (mean >= 4) & (mean <= 7)),
        "symbols": over(per("n_symbols", "n_words"), 0.1, 0.0),
        "repetition": over(per("n_repeat_words", "n_words"), 0.4, 0.3),
        "lines": over(per("n_dup_lines", "n_lines"), 0.5, 0.35),
        "capitals": over(per("n_upper", "word_chars"), 0.3, 0.06),
        "shouting": over(per("n_shouts", "n_words"), 0.3, 0.02),
    }


@dataclass(frozen=True)
class Model:
    """share[class] and table[class][rule][vote]: probabilities. Class 0 is good; class 1 + j is the junk that rule j is made for."""

    share: tuple[float, ...]
    table: tuple[tuple[tuple[float, ...], ...], ...]

    def log_joint(self, c: int, pattern: tuple[int, ...]) -> float:
        return math.log(self.share[c]) + sum(math.log(self.table[c][j][v]) for j, v in enumerate(pattern))

    def posteriors(self, pattern: tuple[int, ...]) -> list[float]:
        logs = [self.log_joint(c, pattern) for c in range(len(self.share))]
        parts = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(parts) for x in parts]

    def accuracies(self) -> dict[str, float]:
        """Of each rule: the share of its votes (not abstentions) that are right."""
        out = {}
        for j, rule in enumerate(RULES):
            right = self.share[0] * self.table[0][j][GOOD] + sum(s * t[j][BAD] for s, t in zip(self.share[1:], self.table[1:], strict=True))
            out[rule] = right / sum(s * (t[j][BAD] + t[j][GOOD]) for s, t in zip(self.share, self.table, strict=True))
        return out

    def posterior(self) -> Column:
        """P(good | votes) from the columns vote_<rule>."""
        total = F.lit(1.0)
        for c in range(1, len(self.share)):
            odds = F.lit(math.log(self.share[c] / self.share[0]))
            for j, rule in enumerate(RULES):
                weight = [math.log(self.table[c][j][v] / self.table[0][j][v]) for v in (BAD, ABSTAIN, GOOD)]
                v = F.col(f"vote_{rule}")
                odds = odds + F.when(v == BAD, weight[BAD]).when(v == GOOD, weight[GOOD]).otherwise(weight[ABSTAIN])
            total = total + F.exp(odds)
        return 1 / total


#: Belief before any data, as (bad, abstain, good): a good document hardly fails a rule; junk of
#: a rule's own kind mostly fails that rule, and now and then others.
PRIOR_OF_GOOD, PRIOR_OF_OWN, PRIOR_OF_OTHER = (0.01, 0.14, 0.85), (0.90, 0.08, 0.02), (0.10, 0.20, 0.70)
PRIOR_SHARE = 0.85
#: The belief weighs as much as this share of the documents.
PRIOR_WEIGHT = 0.05
#: EM ends when no probability moves by more.
TOLERANCE = 1e-9


def fit(patterns: dict[tuple[int, ...], int], tolerance: float = TOLERANCE) -> Model:
    """EM over pattern counts, at most 3^len(RULES) of them, until no probability moves by more than tolerance. Sorted, so that sums are the same each time."""
    k, total = len(RULES), sum(patterns.values())
    first = np.array((PRIOR_SHARE, *[(1 - PRIOR_SHARE) / k] * k))
    prior = np.array([[PRIOR_OF_GOOD] * k] + [[PRIOR_OF_OWN if i == j else PRIOR_OF_OTHER for i in range(k)] for j in range(k)])
    share, table, strength = first, prior, max(1.0, PRIOR_WEIGHT * total)
    votes_, n = np.array(sorted(patterns), np.int64).reshape(-1, k), np.array([patterns[p] for p in sorted(patterns)], float)
    seen = (votes_[:, :, None] == np.arange(3)).astype(float)
    moved = np.inf if total else 0.0
    while moved > tolerance:
        logs = np.log(share) + np.einsum("pjv,cjv->pc", seen, np.log(table))
        each = np.exp(logs - logs.max(axis=1, keepdims=True))
        each *= (n / each.sum(axis=1))[:, None]
        weight = strength * first + each.sum(axis=0)
        counts = strength * first[:, None, None] * prior + np.einsum("pc,pjv->cjv", each, seen)
        before, share, table = (share, table), weight / weight.sum(), counts / counts.sum(axis=2, keepdims=True)
        moved = max(np.abs(share - before[0]).max(), np.abs(table - before[1]).max())
    return Model(tuple(share.tolist()), tuple(tuple(tuple(row) for row in rows) for rows in table.tolist()))


def with_votes(features: DataFrame) -> DataFrame:
    return without(features, [f"vote_{r}" for r in RULES]).withColumns({f"vote_{r}": v for r, v in votes().items()})


def score_quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with FEATURES, vote_<rule>, base_failed, quality (posterior) and kept.

    The counts are computed once and written, with the columns of docs (or those in keep), to the shared folder.
    """
    added = [*FEATURES, *(f"vote_{r}" for r in RULES), "base_failed", "quality", "kept"]
    docs = without(docs, added)
    counted = with_features(docs, text).select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], *FEATURES)
    voted = with_votes(write_shared(counted, "quality"))
    cols = [f"vote_{r}" for r in RULES]
    # Bounded by 3^7 rows, whatever the number of documents.
    patterns = {tuple(r[c] for c in cols): r["n"] for r in voted.groupBy(*cols).agg(F.count("*").alias("n")).collect()}
    model = fit(patterns, tolerance)
    scored = voted.withColumns({"base_failed": base_failed(), "quality": model.posterior()})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
