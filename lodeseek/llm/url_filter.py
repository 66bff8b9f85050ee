"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule names a host and a path. It fits a url whose host is the rule's or one of its
subdomains and whose path starts with the rule's path. Each distinct (host, path) is
expanded into expressions: suffixes of the host, each with prefixes of the path that end at a "/" or 1, 2, 4, 8, ...
characters behind one. Their number depends on the url alone, however many rules there are; suffixes and depths that no
rule has are left out. A rule stands under its host, its path up to the last "/" and the largest such number of characters that it
has behind that. Expressions are hashed, candidates come from an equi-join on the first 32 bits of the digest, the whole
SHA-256 confirms them, and the rest of the rule's path is compared. Of the
rules that fit, the one with the longest host + path wins; between equal ones a block wins.

Rules are a list or a DataFrame (host, path, verdict); a table of any size is joined like any other.

Defined results: a null url, or one without "://", has empty host and path and gets the
default verdict; repeated rows are each judged; columns of the input named host, path,
rule or verdict are replaced; an empty table gives an empty result; rules with an empty or null
host, an unknown verdict or a path that does not begin with "/" (an empty one is good) are refused. A-Z of hosts are lower-cased, of rules too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, let, without

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
DEFAULT_RULES = (
    ("com", "/en/", BLOCK),
    ("example.com", "/en/7", ALLOW),
    ("net", "/de/", ALLOW),
    ("example.net", "/de/8", BLOCK),
    ("org", "/es/", BLOCK),
)
#: Hex digits of the digest on which candidates are joined: 32 bits.
PREFIX_DIGITS = 8
#: Rules of so many bytes in all are broadcast; beyond, they are shuffled.
BROADCAST_BYTES = 4 << 20
_RULE_SCHEMA = "host string, path string, verdict string"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null or without "://"."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + F.lit(3), F.length(url)))
    pick = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    kept = without(pages, ["host", "path"])
    return kept.withColumns({"host": ascii_lower(pick(1)), "path": pick(2)})


def _level(n: Column) -> Column:
    """The largest of 0, 1, 2, 4, 8, ... up to n."""
    return F.when(n < 1, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n)))).cast("int")


def _expressions(max_labels: int, max_depth: int) -> Column:
    """Of host and path: all expressions under which a rule of so many labels and slashes at most can stand."""
    labels, parts = F.split("host", r"\."), F.split("path", "/")

    def of(cut: Column) -> Column:
        count = F.least(F.size(cut["labels"]), F.lit(max_labels))
        suffixes = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(cut["labels"], -k, k), "."))

        def behind(depth: Column) -> Column:
            """Prefixes with so many slashes."""
            head = F.when(depth > 0, F.concat(F.array_join(F.slice(cut["parts"], F.lit(1), depth), "/"), F.lit("/"))).otherwise(F.lit(""))
            part = F.get(cut["parts"], depth)
            more = F.when(F.length(part) > 0, F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.length(part))).cast("int")), lambda e: F.left(part, F.pow(F.lit(2.0), e).cast("int"))))
            return let(head, lambda h: F.transform(F.concat(F.array(F.lit("")), F.coalesce(more, F.expr("cast(array() as array<string>)"))), lambda x: F.concat(h, x)))

        depths = F.sequence(F.lit(0), F.least(F.size(cut["parts"]) - 1, F.lit(max_depth)))
        prefixes = F.flatten(F.transform(depths, behind))
        return let(prefixes, lambda p: F.flatten(F.transform(suffixes, lambda s: F.transform(p, lambda x: F.concat(s, x)))))

    return let(F.struct(labels.alias("labels"), parts.alias("parts")), of)


def _rules(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame) -> tuple[DataFrame, int, int]:
    """Rules under their expressions, and the most labels and slashes that they have."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), _RULE_SCHEMA)
    table = table.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    good = (F.coalesce("rule_host", F.lit("")) != "") & F.col("rule_verdict").isin(ALLOW, BLOCK) & ((F.col("rule_path") == "") | F.col("rule_path").startswith("/"))
    size = F.octet_length("rule_host") + F.octet_length("rule_path")
    seen = table.agg(
        F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"), F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("rule_path", "/")) - 1), F.lit(0)).alias("depth"), F.coalesce(F.sum(2 * size + 200), F.lit(0)).alias("bytes"),
    ).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} rules without host, with an unknown verdict or with a path that does not begin with /")
    ahead = F.regexp_extract("rule_path", r"^(?s)(.*/)?", 0)
    rest = F.substring(F.col("rule_path"), F.length(ahead) + 1, F.length("rule_path"))
    digest = F.sha2(F.concat("rule_host", F.left("rule_path", F.length(ahead) + _level(F.length(rest)))), 256)
    keyed = table.select(F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "rule_verdict", digest.alias("rule_digest"))
    keyed = keyed.withColumn("hash_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    return (F.broadcast(keyed) if seen["bytes"] <= BROADCAST_BYTES else keyed), seen["labels"], seen["depth"]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = DEFAULT_RULES, url: str = "url", default: str = ALLOW) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict of every row."""
    table, labels, depth = _rules(pages, rules)
    judged = with_host_and_path(without(pages, ["rule", "verdict"]), url)
    digests = (
        judged.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(_expressions(labels, depth) if labels else F.expr("cast(array() as array<string>)")).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .withColumn("hash_prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == BLOCK).alias("block"), "rule", "rule_verdict"))
    winners = (
        digests.join(table, "hash_prefix").where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
        .groupBy("host", "path").agg(best.alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    # The pages' side of this join may hold a hot url; as it is not aggregated, adaptive execution can split it.
    found = judged.join(winners, ["host", "path"], "left")
    order = [c for c in judged.columns if c not in ("host", "path")]
    return found.select(*[F.col(f"`{c}`") for c in order], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
