"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lang_id, licenses, neighbours, packing, quality, ranked, secret_scan, simhash, spelling, token_store, url_filter

from .shared import write_shared


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.withColumn("coverage", F.round("coverage", 6))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = write_shared(token_store.shards(docs, tokenizer("word_bpe_49k.json"), end_id=1), "tokens")
    read = token_store.read_documents(store).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = read.join(token_store.shard_starts(store), ["part", "shard"])
    return placed.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema))
    read = chat.read_formatted(chat.format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n_items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, keep=["doc_id"], model=secret_scan.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.array_remove(F.array_remove(kinds, a), b), "markov")).cast("long").alias(f"n_{k}") for k, a, b in (("assign", "access", "hex"), ("access", "assign", "hex"), ("hex", "assign", "access"))]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = lang_id.fit(docs.where(~F.col("held_out")))
    return lang_id.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), dropped=spelling.DROPPED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_OP1_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (SELECT row_number() OVER () AS rid, page_id,
                 CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT rid, page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM parts),
fits AS (SELECT s.*, rh || rp AS rule, rv,
                row_number() OVER (PARTITION BY rid ORDER BY strlen(rh || rp) DESC NULLS LAST) AS k
         FROM split s LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE k = 1
"""

_CONTROL = r"([<])(\\*)(<SYS>>|</SYS>>|s>|/s>|role>|/role>|/turn>)"
_OP6_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g'), '(\[)(\\*)(INST\]|/INST\])', '\1\2\\\3', 'g') AS escaped,
             CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + marks)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM e GROUP BY conv_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[k:k + 7], ' ') AS gram
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
          FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN sizes)),
found AS (SELECT rid, k, n, item_id FROM grams JOIN windows USING (n, gram)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

_OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT iid, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS iid, item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT rid, doc_id, size, t, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS size, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
v AS (SELECT rid, doc_id, t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * size * n) // l)))) AS x
      FROM p JOIN f USING (t) CROSS JOIN s),
r AS (SELECT iid, item_id, rid, doc_id, sum(c * x)::BIGINT AS score FROM i JOIN v USING (t) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""

# The checksum has no function there: its table of 256 is made by eight shifts each, then bytes are folded in.
_OP13_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS k
         FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda j: (instr('0123456789ABCDEF', x[j]) - 1) * 16 + instr('0123456789ABCDEF', x[j + 1]) - 1),
                                          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded CROSS JOIN tab),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gaps AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT g.word AS a, w.word AS b FROM gaps g JOIN words w ON g.gap = w.word),
pairs AS (SELECT a, b FROM shorter UNION SELECT b, a FROM shorter UNION SELECT g.word, o.word FROM gaps g JOIN gaps o ON g.gap = o.gap AND g.i = o.i AND g.word <> o.word),
best AS (SELECT a, n, count(*) OVER (PARTITION BY a) AS n_near, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs JOIN words ON b = word),
formed AS (SELECT w.word, CASE WHEN b.n >= 10 * w.n THEN b.b END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
           FROM words w LEFT JOIN best b ON w.word = b.a AND r = 1),
steps AS (SELECT word, word AS cur, 0 AS d FROM formed UNION ALL SELECT s.word, f.form, d + 1 FROM steps s JOIN formed f ON s.cur = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(cur, d) AS root FROM steps GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1_SQL, "op6_chat_format": _OP6_SQL, "op7_decontamination": _OP7_SQL, "op12_ranked_search": _OP12_SQL, "op13_spelling_variants": _OP13_SQL}
