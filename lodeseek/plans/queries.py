"""Named queries over the test tables, each with the SQL that must give the same rows.

Queries read whole tables. Where a query needs a value that no table has (a DOI, a date, a box), it is
made from an id by the same expression on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import IndexingConfig, SearchQuery
from ..functions import display, metadata, paths, source_map, text, vectors
from ..operators import cells, chunk, embed, grep, index, knn, preview, results, words
from ..sources import catalog, extract, files, walk, work
from ..operators.store import Folder
from ..sources.tables import EXTENSIONS, corpus, table
from ..streaming import watch
from . import search

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_CORPUS = f"""corpus AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/' || doc_id || '.' || ({list(EXTENSIONS)!r})[doc_id % 10 + 1] AS path,
    text, strlen(text) AS size_bytes FROM documents)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


# exact search


def _lines_sql(pattern: str, where: str = "ext_type = 'PlainText'", columns: str = "*") -> str:
    """Matches of an RE2 pattern, line by line."""
    return f"""
WITH {_CORPUS},
typed AS (SELECT *, CASE WHEN regexp_extract(path, '[^.]*$') = 'pdf' THEN 'Pdf' WHEN regexp_extract(path, '[^.]*$') <> 'rs' THEN 'PlainText' END AS ext_type FROM corpus),
lines AS (SELECT path, size_bytes, string_split(text, chr(10)) AS ls FROM typed WHERE {where}),
numbered AS (SELECT path, size_bytes, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS number, unnest(list_transform(range(1, len(ls) + 1), lambda k: strlen(array_to_string(ls[1:k - 1], chr(10))) + CASE WHEN k > 1 THEN 1 ELSE 0 END)) AS base FROM lines),
hit AS (SELECT *, regexp_extract_all(line, '{pattern}') AS hs, string_split_regex(line, '{pattern}') AS ps FROM numbered WHERE regexp_matches(line, '{pattern}')),
flat AS (SELECT path, number AS line, base, line AS body, unnest(hs) AS matched_text, hs, ps, unnest(range(1, len(hs) + 1)) AS k FROM hit),
found AS (SELECT path, line, strlen(array_to_string(ps[1:k], '') || array_to_string(hs[1:k - 1], '')) AS col, base, body, matched_text,
    length(array_to_string(ps[1:k], '') || array_to_string(hs[1:k - 1], '')) AS chars FROM flat),
matches AS (SELECT path, line::INT AS line, col::INT AS col, (base + col)::BIGINT AS start, (base + col + strlen(matched_text))::BIGINT AS "end", matched_text,
    left(body, chars) AS context_before, substr(body, chars + length(matched_text) + 1) AS context_after FROM found)
SELECT {columns} FROM matches"""


_MATCH = ["path", "line", "col", "start", "end", "matched_text", "context_before", "context_after"]


def _typed(spark: SparkSession, sf_dir: str, q: SearchQuery) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("file_type", paths.file_type(F.col("path"), q.supported_extensions)).where("file_type = 'PlainText'")


def _grep(spark: SparkSession, sf_dir: str, q: SearchQuery) -> DataFrame:
    return grep.grep_lines(_typed(spark, sf_dir, q), q, keep=["path"]).select(*_MATCH)


@query("grep_literal", _lines_sql("(?i)tion"))
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, SearchQuery("tion"))


@query("grep_literal_ws", _lines_sql(r"(?i)of\s+the"))
def grep_literal_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, SearchQuery("of the"))


@query("grep_regex", _lines_sql(r"(?i)[a-z]+@[a-z]+\.[a-z]+|[0-9]{3}"))
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, SearchQuery(r"[a-z]+@[a-z]+\.[a-z]+|[0-9]{3}", is_regex=True))


@query("grep_case_sensitive", _lines_sql("The"))
def grep_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, SearchQuery("The", case_sensitive=True))


@query("grep_unicode_ci", _lines_sql("(?i)É[a-z]"))
def grep_unicode_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grep(spark, sf_dir, SearchQuery("É[a-z]", is_regex=True))


@query(
    "grep_fulltext_context120",
    f"""WITH {_CORPUS}, d AS (SELECT path, text, regexp_extract_all(text, '(?i)which|that') AS hs, string_split_regex(text, '(?i)which|that') AS ps FROM corpus WHERE path LIKE '%.pdf'),
f AS (SELECT path, text, unnest(hs) AS matched_text, unnest(list_transform(range(1, len(hs) + 1), lambda k: left(text, length(array_to_string(ps[1:k], '') || array_to_string(hs[1:k - 1], ''))))) AS before FROM d),
g AS (SELECT path, matched_text, strlen(before)::BIGINT AS start, (strlen(before) + strlen(matched_text))::BIGINT AS "end", right(before, 120) AS b, substr(text, length(before) + length(matched_text) + 1, 120) AS a FROM f)
SELECT path, matched_text, start, "end", 1 AS page, translate(ltrim(b, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS context_before,
    translate(rtrim(a, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS context_after FROM g""",
)
def grep_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).where(F.col("path").endswith(".pdf"))
    found = grep.grep_whole(docs, SearchQuery("which|that", is_regex=True), keep=["path"])
    return found.select("path", "matched_text", "start", "end", "page", "context_before", "context_after")


_CAP = 200
_COUNTS = _lines_sql(r"(?i)[0-9]+", columns="path, count(*) AS n") + " GROUP BY path"


@query("grep_soft_cap", f"SELECT path, n FROM (SELECT path, n, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_COUNTS})) WHERE before < {_CAP}")
def grep_soft_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SearchQuery("[0-9]+", is_regex=True)
    return grep.cap_files(grep.count_lines(_typed(spark, sf_dir, q), q, keep=["path"]), _CAP).withColumnRenamed("n_matches", "n")


@query("grep_file_matches", _lines_sql("(?i)licen[sc]e", columns="path, count(*) AS n_matches, min(start) AS first_start, string_agg(matched_text, '|' ORDER BY start) AS texts") + " GROUP BY path")
def grep_file_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files_ = grep.by_file(_grep(spark, sf_dir, SearchQuery("licen[sc]e", is_regex=True)).withColumn("file_type", F.lit(paths.PLAIN_TEXT)))
    texts = F.array_join(F.transform("matches", lambda m: m["matched_text"]), "|")
    return files_.select("path", "n_matches", F.get("matches", F.lit(0))["start"].alias("first_start"), texts.alias("texts"))


@query("grep_stats", f"SELECT s.*, (SELECT count(*) FROM documents) AS files_considered FROM ({_lines_sql('(?i)the', columns='count(DISTINCT path) AS files_scanned, count(*) AS total_matches')}) s")
def grep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SearchQuery("the")
    return grep.stats(grep.count_lines(_typed(spark, sf_dir, q), q, keep=["path"]), corpus(spark, sf_dir))


@query("grep_max_file_size", _lines_sql("(?i)is", where="ext_type = 'PlainText' AND size_bytes <= 800", columns="path, line, start"))
def grep_max_file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).where(~F.col("path").endswith(".pdf"))
    return grep.grep(docs, SearchQuery("is", max_file_size=800)).select("path", "line", "start")


@query("grep_pages", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<p>')) FROM pages) GROUP BY page_id")
def grep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return grep.grep_lines(docs, SearchQuery("<p>"), keep=["page_id"]).groupBy("page_id").agg(F.count("*").alias("n"))


@query("grep_conversations", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(text, '(?i)than')) FROM conversations) GROUP BY conv_id")
def grep_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select("conv_id", "text")
    return grep.grep_lines(docs, SearchQuery("than"), keep=["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("grep_part_names", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)e')")
def grep_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("text"))
    return grep.grep_lines(docs, SearchQuery("e"), keep=["p_partkey", "p_name"]).select("p_partkey", "p_name").distinct()


@query("grep_empty_matches", f"""WITH {_CORPUS}, typed AS (SELECT path, string_split(text, chr(10)) AS ls FROM corpus),
lines AS (SELECT path, unnest(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS line FROM typed)
-- The run of pairs that ends a line matches, and the empty place behind it does not; where there is none the end itself does.
SELECT path, count(*) AS n FROM lines GROUP BY path""")
def grep_empty_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_lines(corpus(spark, sf_dir), SearchQuery(r"(?:[a-z]{2})*$", is_regex=True), keep=["path"]).groupBy("path").agg(F.count("*").alias("n"))


# files


@query("list_files", f"WITH {_CORPUS} SELECT path, size_bytes, CASE WHEN path LIKE '%.pdf' THEN 'Pdf' ELSE 'PlainText' END AS file_type, regexp_extract(path, '[^.]*$') AS extension FROM corpus WHERE path NOT LIKE '%.rs' AND size_bytes <= 3000")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = files.listing(corpus(spark, sf_dir), 3000).where("omit_reason is null").drop("omit_reason")
    return files.in_order(listed)


@query("list_omitted", f"WITH {_CORPUS} SELECT path, CASE WHEN path LIKE '%.pdf' THEN 'Pdf' ELSE 'PlainText' END AS file_type, CASE WHEN path LIKE '%.rs' THEN 'UnsupportedExtension' ELSE 'TooLarge' END AS omit_reason FROM corpus WHERE path LIKE '%.rs' OR size_bytes > 3000")
def list_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.listing(corpus(spark, sf_dir), 3000).where("omit_reason is not null").select("path", "file_type", "omit_reason")


_NAMES = ("a/Makefile", "b.TXT", "c.Pdf", ".txt", "d.tar.gz", "Dockerfile.bak", "x/y.z/plain", "e.rs")
_NAMES_SQL = "(VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(_NAMES)) + ") AS v(k, name)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % len(_NAMES)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/r/"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"))


_NAMED_SQL = f"named AS (SELECT doc_id, '/r/' || doc_id || '/' || name AS path, k FROM documents JOIN {_NAMES_SQL} ON k = doc_id % {len(_NAMES)})"


@query("file_type_detect", f"WITH {_NAMED_SQL} SELECT doc_id, (['PlainText', 'PlainText', 'Pdf', NULL, NULL, NULL, NULL, NULL])[k + 1] AS file_type FROM named")
def file_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", paths.file_type(F.col("path")).alias("file_type"))


@query("path_filter", f"WITH {_CORPUS} SELECT path FROM corpus WHERE contains(lower(path), 'src1')")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where(paths.contains_ignoring_case(F.col("path"), "SRC1")).select("path")


@query("dir_size", f"WITH {_CORPUS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, sum(size_bytes)::BIGINT AS size_bytes, count(*) AS n_files FROM corpus GROUP BY 1")
def dir_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy(paths.directory_of(F.col("path")).alias("dir")).agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n_files"))


@query("language_hint", f"WITH {_CORPUS} SELECT path, CASE regexp_extract(path, '[^.]*$') WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'html' THEN 'html' WHEN 'rs' THEN 'rust' END AS language FROM corpus")
def language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path", paths.language_hint(F.col("path")).alias("language"))


@query("mime_type", f"WITH {_NAMED_SQL} SELECT path, CASE WHEN path LIKE '%/.txt' THEN 'application/octet-stream' WHEN path LIKE '%.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM named")
def mime_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("path", paths.mime_type(F.col("path")).alias("mime"))


@query("sanitize_path", r"SELECT page_id, array_to_string(list_filter(string_split_regex('..' || chr(92) || './' || url || '/../x', '[/\\]'), lambda p: p NOT IN ('', '.', '..')), '/') AS clean FROM pages")
def sanitize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("..\\./"), "url", F.lit("/../x"))
    return table(spark, sf_dir, "pages").select("page_id", paths.sanitized(raw).alias("clean"))


@query("rel_abs_path", f"WITH {_CORPUS} SELECT doc_id, CASE WHEN starts_with(path, '/corpus/src1/') THEN substr(path, 14) ELSE path END AS relative, path AS absolute FROM corpus")
def rel_abs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("doc_id", paths.relative(F.col("path"), "/corpus/src1").alias("relative"))
    return rows.withColumn("absolute", paths.absolute(F.col("relative"), "/corpus/src1"))


@query("name_dir", f"WITH {_CORPUS} SELECT doc_id, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM corpus")
def name_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", paths.name_of(F.col("path")).alias("name"), paths.directory_of(F.col("path")).alias("dir"))


# semantic search

_DIMENSION, _K, _TIES = 64, 25, ["label", "vec_id"]


def _query_vector() -> list[float]:
    return [((k * 37 + 11) % 64 - 31.5) / 100 for k in range(_DIMENSION)]


_VECTOR_SQL = f"{_query_vector()}::DOUBLE[]"
_SCORED = f"scored AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {_VECTOR_SQL}) AS s FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query("knn_topk", f"WITH {_SCORED} SELECT vec_id, label, round(s, 6) AS score FROM scored ORDER BY s DESC, label, vec_id LIMIT {_K}")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = knn.top_k(_vectors(spark, sf_dir), _query_vector(), _K, _TIES)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("knn_cells", f"WITH {_SCORED} SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, label::VARCHAR, vec_id) - 1 AS rank FROM scored ORDER BY s DESC, label::VARCHAR, vec_id LIMIT {_K}")
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index with cells: those that the bounds rule out are not read."""
    path = work.new_path(spark, "query-index")
    named = {"file_path": F.col("label").cast("string"), "chunk_idx": F.col("vec_id").cast("int"), "embedding": F.col("embedding")}
    rows = _vectors(spark, sf_dir).select(*[named.get(c.split()[0], F.lit(None).cast(c.split(" ", 1)[1])).alias(c.split()[0]) for c in schema.INDEX.split(", ")])
    index.create(spark, path, rows, {"engine": "Fastembed", "model_id": "given", "dimension": _DIMENSION, "root_path": "/"})
    found, _ = cells.top_k(spark, path, cells.make(spark, path, cell_rows=64), _query_vector(), _K)
    ranked = [(r["chunk_idx"], round(r["score"], 6), k) for k, r in enumerate(found)]
    return spark.createDataFrame(ranked, "vec_id long, score double, rank long")


@query("knn_all", f"WITH {_SCORED} SELECT vec_id, round(s, 6) AS score FROM scored")
def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.scored(_vectors(spark, sf_dir), _query_vector()).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_postfilter", f"WITH {_SCORED}, top AS (SELECT * FROM scored ORDER BY s DESC, label, vec_id LIMIT {_K}) SELECT vec_id, label FROM top WHERE label % 3 <> 0")
def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is above the limit: fewer than k may stay."""
    hits = knn.top_k(_vectors(spark, sf_dir), _query_vector(), _K, _TIES)
    name = F.concat(F.col("label").cast("string"), F.when(F.col("label") % 3 == 0, ".exe").otherwise(".txt"))
    return knn.supported(hits.withColumns({"file_path": name, "origin_type": F.lit("TextFile")})).select("vec_id", "label")


@query("knn_group_by_file", f"WITH {_SCORED}, top AS (SELECT * FROM scored ORDER BY s DESC, label, vec_id LIMIT 100) SELECT row_number() OVER (ORDER BY max(s) DESC, label) - 1 AS rank, label, round(max(s), 6) AS best_score, count(*) AS n, string_agg(vec_id, ',' ORDER BY s DESC, vec_id) AS matches FROM top GROUP BY label")
def knn_group_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = knn.by_file(knn.top_k(_vectors(spark, sf_dir), _query_vector(), 100, _TIES), "label", ["label", "vec_id"])
    matches = F.array_join(F.transform("matches", lambda m: m["vec_id"].cast("string")), ",")
    return grouped.select(F.col("rank").cast("long").alias("rank"), "label", F.round("best_score", 6).alias("best_score"), "n", matches.alias("matches"))


@query("knn_many_queries", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM q, embeddings) SELECT query_id, vec_id, label, round(s, 6) AS score, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label, vec_id) AS k FROM s) WHERE k <= 5")
def knn_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    questions = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = knn.top_k_each(rows, questions, 5, _TIES)
    return hits.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_join_form", f"WITH {_SCORED}, top AS (SELECT vec_id, s FROM scored ORDER BY s DESC, label, vec_id LIMIT {_K}) SELECT t.vec_id, round(t.s, 6) AS score, e.label, e.embedding[1]::DOUBLE AS first FROM top t JOIN embeddings e USING (vec_id)")
def knn_join_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = _vectors(spark, sf_dir)
    joined = knn.with_columns_of(knn.top_k(table_, _query_vector(), _K, _TIES).drop("label"), table_, ["vec_id"])
    return joined.select("vec_id", F.round("score", 6).alias("score"), "label", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("l2_normalize", "SELECT vec_id, round(list_aggregate(list_transform(v, lambda x: (x / n) * (x / n)), 'sum'), 6) AS length2, round(v[3] / n, 6) AS third FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7 + 1)) AS v, sqrt(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: (x * (vec_id % 7 + 1)) ^ 2), 'sum')) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1))
    rows = _vectors(spark, sf_dir).select("vec_id", vectors.normalized(scaled).alias("v"))
    return rows.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("length2"), F.round(F.get("v", F.lit(2)), 6).alias("third"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 16 tokens of 4 numbers; the mask leaves out tokens by id."""
    token = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, F.lit(4)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when((k == 0) | ((F.col("vec_id") + k) % 3 != 0), 1).otherwise(0))
    return _vectors(spark, sf_dir).select("vec_id", token.alias("tokens"), mask.alias("mask"))


_POOL = "SELECT vec_id, {} FROM (SELECT vec_id, list_filter(range(0, 16), lambda k: k = 0 OR (vec_id + k) % 3 <> 0) AS ks, embedding::DOUBLE[] AS e FROM embeddings)"


def _parts(pooled: Column) -> list[Column]:
    return [F.round(F.get(pooled, F.lit(d)).cast("double"), 6).alias(f"x{d}") for d in range(4)]


@query("pool_mean", _POOL.format(", ".join(f"round(list_aggregate(list_transform(ks, lambda k: e[k * 4 + {d + 1}]), 'sum') / len(ks), 6) AS x{d}" for d in range(4))))
def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).select("vec_id", vectors.pool_mean(F.col("tokens"), F.col("mask")).alias("p"))
    return rows.select("vec_id", *_parts(F.col("p")))


@query("pool_max", _POOL.format(", ".join(f"round(list_max(list_transform(ks, lambda k: e[k * 4 + {d + 1}])), 6) AS x{d}" for d in range(4))))
def pool_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).select("vec_id", vectors.pool_max(F.col("tokens"), F.col("mask")).alias("p"))
    return rows.select("vec_id", *_parts(F.col("p")))


@query("pool_cls", _POOL.format(", ".join(f"round(e[{d + 1}], 6) AS x{d}" for d in range(4))))
def pool_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("vec_id", *_parts(vectors.pool_cls(F.col("tokens"))))


@query("prefix_concat", "SELECT item_id, 'query: ' || text AS query_text, 'passage: ' || text AS passage_text FROM benchmark")
def prefix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = embed.prefixes('{"prompts": {"query": "query: ", "Document": "passage: ", "other": "x"}}')
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(known["query_prefix"]), "text").alias("query_text"), F.concat(F.lit(known["passage_prefix"]), "text").alias("passage_text"))


# chunks and index

_CHUNKS = """chunks AS (SELECT doc_id, k AS chunk_idx, strlen(left(text, (k * 472)::INT))::BIGINT AS byte_start, (strlen(left(text, (k * 472)::INT)) + strlen(substr(text, k * 472 + 1, 600)))::BIGINT AS byte_end,
    trim(substr(text, k * 472 + 1, 600), ' ' || chr(9) || chr(10) || chr(13)) AS chunk_text, text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 128 - 1, 0) // 472 + 1)) AS k FROM documents WHERE text <> '') WHERE trim(substr(text, k * 472 + 1, 600), ' ' || chr(9) || chr(10) || chr(13)) <> '')"""


def _chunks(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return chunk.fixed_windows(table(spark, sf_dir, "documents").select(*keep, "text"), IndexingConfig(), keep=keep)


@query("chunk_fixed", f"WITH {_CHUNKS} SELECT doc_id, chunk_idx::INT AS chunk_idx, byte_start, byte_end, chunk_text FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, ["doc_id"]).drop("line")


@query("chunk_line_origin", f"WITH {_CHUNKS} SELECT doc_id, chunk_idx::INT AS chunk_idx, (len(string_split(left(text, (chunk_idx * 472)::INT), chr(10))))::INT AS line FROM chunks")
def chunk_line_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, ["doc_id"]).select("doc_id", "chunk_idx", "line")


def _index_rows(chunks: DataFrame) -> DataFrame:
    """Index rows of chunks (file_path, chunk_idx, chunk_text), with small vectors."""
    blank = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in schema.INDEX.split(", ")}
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.length("chunk_text") % (k + 3)).cast("float"))
    known = {"file_path": F.col("file_path"), "chunk_idx": F.col("chunk_idx"), "chunk_text": F.col("chunk_text"), "embedding": vector}
    return chunks.select(*[known.get(c, null).alias(c) for c, null in blank.items()])


def _new_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of an index of the documents' fixed windows, a file for each document, in several buckets."""
    path = work.new_path(spark, "query-index")
    rows = _index_rows(_chunks(spark, sf_dir, ["doc_id"]).withColumn("file_path", F.col("doc_id").cast("string")))
    index.create(spark, path, rows, {"engine": "Fastembed", "model_id": "small", "dimension": 4, "root_path": "/"}, bucket_rows=1000)
    return path


@query("index_status", f"WITH {_CHUNKS} SELECT count(DISTINCT doc_id) AS indexed_files, count(*) AS total_chunks, 4 AS dimension FROM chunks")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.status(spark, _new_index(spark, sf_dir))
    return spark.createDataFrame([(found["indexed_files"], found["total_chunks"], found["dimension"])], "indexed_files long, total_chunks long, dimension int")


@query("delete_semi", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return _vectors(spark, sf_dir).select("vec_id").join(bad, "vec_id", "left_semi")


@query("remove_anti", f"WITH {_CHUNKS} SELECT doc_id::VARCHAR AS file_path, chunk_idx::INT AS chunk_idx FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after files were removed."""
    path = _new_index(spark, sf_dir)
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("file_path"))
    index.apply_changes(spark, path, spark.createDataFrame([], schema.INDEX), gone, gone.limit(0))
    return index.open_index(spark, path).chunks.select("file_path", "chunk_idx")


@query("upsert_replace", f"WITH {_CHUNKS}, gone AS (SELECT doc_id FROM labels), fresh AS (SELECT doc_id, 0 AS chunk_idx, 'new' AS chunk_text FROM labels WHERE quality = 1) SELECT doc_id::VARCHAR AS file_path, chunk_idx::INT AS chunk_idx, chunk_text FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT doc_id::VARCHAR, chunk_idx, chunk_text FROM fresh")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after files with a label were replaced; those of bad quality have no chunks any more, so they go."""
    path = _new_index(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file_path"), "quality")
    new = _index_rows(labels.where("quality = 1").select("file_path", F.lit(0).alias("chunk_idx"), F.lit("new").alias("chunk_text")))
    index.apply_changes(spark, path, new, labels.select("file_path").limit(0), labels.select("file_path"))
    return index.open_index(spark, path).chunks.select("file_path", "chunk_idx", "chunk_text")


@query("chunk_semantic")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.semantic_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query("embed_hash")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embed_passages(table(spark, sf_dir, "benchmark"), embed.HashingEmbedder(), text="text").select("item_id", "embedding", "embed_error")


def _corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).withColumn("file_type", paths.file_type(F.col("path"))).where("file_type = 'PlainText'")
    docs = docs.withColumn("source_map", F.lit(None).cast("array<struct<start:bigint,end:bigint,origin:struct<origin_type:string,line:int,col:int,page:int,bbox:struct<x:float,y:float,width:float,height:float>>>>"))
    return docs.select("path", "file_type", "text", "source_map")


@query("index_build")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows an index of the corpus has, ready to be written."""
    return index.prepare(_corpus_documents(spark, sf_dir), embed.HashingEmbedder(64), IndexingConfig(), "/corpus").drop("embed_error")


@query("index_build_fixed", f"""WITH {_CORPUS}, plain AS (SELECT doc_id, replace(path, '/corpus/', '') AS file_path, text FROM corpus WHERE path NOT LIKE '%.pdf' AND path NOT LIKE '%.rs' AND text <> ''),
c AS (SELECT file_path, text, unnest(range(0, greatest(length(text) - 128 - 1, 0) // 472 + 1)) AS k FROM plain)
SELECT file_path, k::INT AS chunk_idx, strlen(left(text, (k * 472)::INT))::BIGINT AS byte_start, len(string_split(left(text, (k * 472)::INT), chr(10)))::INT AS line, trim(substr(text, k * 472 + 1, 600), ' ' || chr(9) || chr(10) || chr(13)) AS chunk_text, 64 AS dimension
FROM c WHERE trim(substr(text, k * 472 + 1, 600), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def index_build_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole build of the corpus in fixed windows, opened again."""
    path = work.new_path(spark, "query-index")
    index.build(spark, path, _corpus_documents(spark, sf_dir), embed.HashingEmbedder(64), "/corpus", semantic=False)
    chunks = index.open_index(spark, path, "hashing", 64).chunks
    return chunks.select("file_path", "chunk_idx", "byte_start", "line", "chunk_text", F.size("embedding").alias("dimension"))


# source maps: a conversation is a document, its turns are segments on pages of two turns


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, segments: turn k covers bytes of its text behind those before it, with a box made of its number."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.octet_length("text").alias("n")))).alias("ts"))
    ends = lambda ts, k: F.aggregate(F.slice(ts, F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    f = lambda c: c.cast("float")

    def segment(x: Column, k: Column) -> Column:
        box = F.struct(f(x["turn"]).alias("x"), f(x["turn"] * 2).alias("y"), f(x["turn"] + 1).alias("width"), f(F.lit(10)).alias("height"))
        none = F.lit(None).cast("int")
        origin = F.struct(F.lit("PdfPage").alias("origin_type"), none.alias("line"), none.alias("col"), (F.floor(k / 2) + 1).cast("int").alias("page"), box.alias("bbox"))
        return F.struct(ends(F.col("ts"), k).alias("start"), ends(F.col("ts"), k + 1).alias("end"), origin.alias("origin"))

    return turns.select("conv_id", F.transform("ts", segment).alias("segments"))


_SEGMENTS = """segs AS (SELECT conv_id, turn, row_number() OVER w - 1 AS k, sum(strlen(text)) OVER w - strlen(text) AS s, sum(strlen(text)) OVER w AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
probe AS (SELECT conv_id, 100 + conv_id % 400 AS a, 100 + conv_id % 400 + 300 AS b FROM (SELECT DISTINCT conv_id FROM conversations))"""


@query("sourcemap_resolve", f"WITH {_SEGMENTS}, one AS (SELECT p.conv_id, coalesce(min(k) FILTER (s <= a AND a < e), max(k)) AS k FROM probe p JOIN segs USING (conv_id) GROUP BY p.conv_id) SELECT conv_id, (k // 2 + 1)::INT AS page, turn::DOUBLE AS x FROM one JOIN segs USING (conv_id, k)")
def sourcemap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segmented(spark, sf_dir).select("conv_id", source_map.resolve(F.col("segments"), 100 + F.col("conv_id") % 400).alias("o"))
    return rows.select("conv_id", "o.page", F.col("o.bbox.x").cast("double").alias("x"))


@query(
    "sourcemap_resolve_range",
    f"""WITH {_SEGMENTS}, hit AS (SELECT p.conv_id, k, turn, k // 2 + 1 AS page FROM probe p JOIN segs s USING (conv_id) WHERE s.s < b AND s.e > a),
first AS (SELECT conv_id, min(page) AS page FROM hit GROUP BY conv_id),
boxes AS (SELECT h.conv_id, h.page, min(turn) AS x, min(turn * 2) AS y, max(turn + turn + 1) - min(turn) AS w, max(turn * 2 + 10) - min(turn * 2) AS h FROM hit h JOIN first USING (conv_id, page) GROUP BY ALL),
last AS (SELECT conv_id, k // 2 + 1 AS page, turn AS x, turn * 2 AS y, turn + 1 AS w, 10 AS h FROM segs s WHERE k = (SELECT max(k) FROM segs z WHERE z.conv_id = s.conv_id) AND conv_id NOT IN (SELECT conv_id FROM boxes))
SELECT conv_id, page::INT AS page, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, h::DOUBLE AS height FROM (SELECT * FROM boxes UNION ALL SELECT * FROM last)""",
)
def sourcemap_resolve_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (100 + F.col("conv_id") % 400).cast("long")
    rows = _segmented(spark, sf_dir).select("conv_id", source_map.resolve_range(F.col("segments"), at, at + 300).alias("o"))
    return rows.select("conv_id", "o.page", *[F.col(f"o.bbox.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])


@query("bbox_merge", "SELECT vec_id, least(a, c) AS x, least(b, d) AS y, greatest(a + 5, c + 3) - least(a, c) AS width, greatest(b + 2, d + 8) - least(b, d) AS height FROM (SELECT vec_id, (vec_id % 13)::DOUBLE AS a, (vec_id % 7)::DOUBLE AS b, (vec_id % 5)::DOUBLE AS c, (vec_id % 11)::DOUBLE AS d FROM embeddings)")
def bbox_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x, y, w, h: F.struct(*[v.cast("float").alias(n) for v, n in ((F.col("vec_id") % x, "x"), (F.col("vec_id") % y, "y"), (F.lit(w), "width"), (F.lit(h), "height"))])
    rows = _vectors(spark, sf_dir).select("vec_id", source_map.merge_boxes(box(13, 7, 5, 2), box(5, 11, 3, 8)).alias("m"))
    return rows.select("vec_id", *[F.col(f"m.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])


# metadata

_FORMS = ("see https://doi.org/10.{a}/x{b}.", "DOI: (10.{a}/Y.{b}),", "10.12/short and 10.{a}/z{b}>", "no identifier {a} {b}", "doi:10.{a}/(q){b}")


def _with_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("doc_id") % 9000 + 1000).cast("string"), F.col("doc_id").cast("string")
    form = F.get(F.array(*[F.lit(f) for f in _FORMS]), (F.col("doc_id") % len(_FORMS)).cast("int"))
    note = F.replace(F.replace(form, F.lit("{a}"), a), F.lit("{b}"), b)
    return table(spark, sf_dir, "documents").select("doc_id", note.alias("note"), "text", "source", "lang")


_DOI_SQL = "dois AS (SELECT doc_id, '10.' || (doc_id % 9000 + 1000) || (['/x' || doc_id, '/Y.' || doc_id, '/z' || doc_id, NULL, '/(q)' || doc_id])[doc_id % 5 + 1] AS doi, text, source, lang FROM documents)"


@query("doi_find", f"WITH {_DOI_SQL} SELECT doc_id, doi FROM dois")
def doi_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_doi(spark, sf_dir)
    return rows.select("doc_id", metadata.find_doi(F.concat(F.col("text"), F.lit("\n"), F.col("note"))).alias("doi"))


@query("doi_normalize", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 4) THEN '10.1000/' || doc_id END AS doi FROM documents")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrappers at the end go; an opening one in front stays, so such a value is none."""
    d = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit("  https://dx.doi.org/10.1000/"), d, F.lit(".)")), F.concat(F.lit("DoI: 10.1000/"), d, F.lit("\"]}>',;")), F.concat(F.lit("<10.1000/"), d, F.lit(">")), F.concat(F.lit("11.1000/"), d), F.concat(F.lit("10.1000/"), d, F.lit("' "))]
    return table(spark, sf_dir, "documents").select("doc_id", metadata.normalize_doi(F.get(F.array(*forms), (F.col("doc_id") % 5).cast("int"))).alias("doi"))


@query("pdf_date", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m') END AS month FROM events")
def pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("D:"), stamp, F.lit("-03'30'"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("D:"), stamp, F.lit("Z"))).otherwise(F.lit("D:20251301000000+00'00'"))
    return table(spark, sf_dir, "events").select("event_id", metadata.pdf_month(raw).alias("month"))


@query("metadata_dispatch", f"WITH {_DOI_SQL} SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN nullif(trim(source), '') END AS title, NULL::VARCHAR AS author, CASE WHEN doc_id % 10 = 8 THEN NULL ELSE doi END AS doi, CASE WHEN doc_id % 10 = 7 THEN '2024-02' END AS created_at FROM dois")
def metadata_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pages have a title and DOIs in fields; others are read for a DOI; unsupported ones have nothing."""
    rows = _with_doi(spark, sf_dir)
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    kind = paths.file_type(F.concat(F.lit("/x."), ext))
    found = metadata.of_document(kind, F.concat(F.lit(" "), "source", F.lit("\t")), F.lit(" "), [F.lit(" "), F.col("lang")], F.lit("D:20240229101112+01'00'"), F.col("note"))
    return rows.select("doc_id", found.alias("m")).select("doc_id", "m.*")


# preview and display


@query("line_range", "SELECT doc_id, CASE WHEN k <= len(ls) THEN strlen(array_to_string(ls[1:k - 1], chr(10))) + CASE WHEN k > 1 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS start, CASE WHEN k <= len(ls) THEN strlen(array_to_string(ls[1:k], chr(10))) ELSE 0 END::BIGINT AS \"end\" FROM (SELECT doc_id, doc_id % 5 + 1 AS k, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents)")
def line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.line_range(F.col("text"), (F.col("doc_id") % 5 + 1).cast("int")).alias("r"))
    return rows.select("doc_id", "r.start", "r.end")


@query(
    "preview_highlight_utf16",
    """WITH h AS (SELECT doc_id, left(text, (doc_id % 300)::INT) AS p, substr(text, doc_id % 300 + 1, 40) AS m FROM documents)
SELECT doc_id, len(string_split(p, chr(10)))::INT AS highlight_line, (length(p) + len(regexp_extract_all(p, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS start,
    (length(p || m) + len(regexp_extract_all(p || m, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS "end" FROM h""",
)
def preview_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.col("text"))
    p, m = F.left("text", (F.col("doc_id") % 300).cast("int")), F.substring(F.col("text"), (F.col("doc_id") % 300 + 1).cast("int"), F.lit(40))
    start = F.octet_length(p).cast("long")
    shown = preview.highlight(F.col("text"), start, start + F.octet_length(m), F.lit(0))
    return docs.select("doc_id", shown.alias("h")).select("doc_id", "h.*")


@query("size_format", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 102.4 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 104857.6 + 0.5) / 10) END AS label FROM (SELECT doc_id, n_chars * (doc_id % 3 * 700 + 1) AS n FROM documents)")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars") * (F.col("doc_id") % 3 * 700 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", display.size_label(size).alias("label"))


@query("origin_label", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'L' || user_id ELSE 'p.' || user_id END AS label FROM events")
def origin_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "TextFile").otherwise("PdfPage")
    return table(spark, sf_dir, "events").select("event_id", display.origin_label(kind, F.col("user_id"), F.col("user_id")).alias("label"))


@query("month_label", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%b %Y') END AS label FROM events")
def month_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.when(F.col("event_id") % 4 > 0, F.date_format("ts", "yyyy-MM")).otherwise("2024-1")
    return table(spark, sf_dir, "events").select("event_id", display.month_label(month).alias("label"))


@query("external_links", "SELECT doc_id, 'https://doi.org/10.1/a b(' || doc_id || ')' AS doi_url, 'https://scholar.google.com/scholar?q=10.1%2Fa%20b(' || doc_id || ')' AS scholar_url FROM documents")
def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.concat(F.lit(" HTTPS://dx.doi.org/10.1/a b("), F.col("doc_id").cast("string"), F.lit(") "))
    return table(spark, sf_dir, "documents").select("doc_id", display.doi_link(doi).alias("doi_url"), display.scholar_link(doi).alias("scholar_url"))


@query("header_title", f"WITH {_CORPUS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE regexp_extract(path, '[^/]*$') END AS title FROM corpus")
def header_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" T"), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(" ")
    return corpus(spark, sf_dir).select("doc_id", display.title_of(F.col("path"), title).alias("title"))


#: What the catalogue must hold, stated here on its own.
_CATALOG_SQL = """SELECT engine, model_id, regexp_extract(model_id, '[^/]*$') AS display_name, dimension, model_id = CASE engine WHEN 'SBERT' THEN 'intfloat/e5-small-v2' ELSE 'sentence-transformers/all-MiniLM-L6-v2' END AS is_default FROM (VALUES
('SBERT', 'intfloat/e5-small-v2', 384), ('SBERT', 'nomic-ai/nomic-embed-text-v1', 384), ('SBERT', 'nomic-ai/nomic-embed-text-v1.5', 768), ('SBERT', 'sentence-transformers/all-MiniLM-L12-v2', 384),
('SBERT', 'jinaai/jina-embeddings-v5-text-small', 1024), ('SBERT', 'jinaai/jina-embeddings-v5-text-nano', 768), ('SBERT', 'sentence-transformers/all-mpnet-base-v2', 768),
('SBERT', 'minishlab/potion-multilingual-128M', 256), ('SBERT', 'thenlper/gte-small', 384),
('Candle', 'sentence-transformers/all-MiniLM-L6-v2', 384), ('Candle', 'BAAI/bge-base-en-v1.5', 768), ('Candle', 'sentence-transformers/all-MiniLM-L12-v2', 384),
('Candle', 'intfloat/multilingual-e5-large-instruct', 1024), ('Candle', 'mixedbread-ai/mxbai-embed-large-v1', 1024), ('Candle', 'snowflake/snowflake-arctic-embed-xs', 384),
('Candle', 'snowflake/snowflake-arctic-embed-s', 384), ('Candle', 'Snowflake/snowflake-arctic-embed-m', 768), ('Candle', 'snowflake/snowflake-arctic-embed-l', 1024)) AS v(engine, model_id, dimension)"""


@query("model_catalog", f"""WITH models AS (SELECT *, row_number() OVER (ORDER BY engine, model_id) - 1 AS k FROM ({_CATALOG_SQL}))
SELECT engine, model_id, display_name, dimension, is_default, count(user_id) AS n_events, count(DISTINCT user_id) AS n_users FROM models LEFT JOIN events ON user_id % 18 = k GROUP BY ALL""")
def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that users have chosen (by their id), and what their events and they add up to."""
    both = catalog.models(spark, "SBERT").unionByName(catalog.models(spark, "Candle"))
    numbered = both.withColumn("k", F.row_number().over(Window.orderBy("engine", "model_id")) - 1)  # of a catalogue, some rows
    chosen = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 18).alias("k")).agg(F.count("user_id").alias("n_events"), F.countDistinct("user_id").alias("n_users"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return numbered.join(chosen, "k", "left").select("engine", "model_id", "display_name", "dimension", "is_default", zero("n_events"), zero("n_users"))


_COLLAPSE = _lines_sql("(?i)and", columns="path, start, row_number() OVER (PARTITION BY path ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY path) AS n")


@query("collapse_rows", f"""WITH m AS ({_COLLAPSE}) SELECT 'match' AS kind, path, i::INT AS match_index, start, NULL::BIGINT AS total FROM m WHERE i < 5
UNION ALL SELECT DISTINCT 'file', path, NULL, NULL, n FROM m UNION ALL SELECT DISTINCT 'expand', path, NULL, NULL, n FROM m WHERE n > 5""")
def collapse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.collapsed(_grep(spark, sf_dir, SearchQuery("and")))


@query("history_dedup", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k = 1 OR p IS DISTINCT FROM event_type")
def history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.without_repeats(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"]).select("event_id", "user_id", "event_type")


@query("find_in_page", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS number FROM conversations WHERE contains(lower(text), 'ation')")
def find_in_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("item"), "text")
    return results.find_in_page(rows, "ATION").select("conv_id", F.col("item").alias("turn"), F.col("number").cast("long").alias("number"))


# events


def _file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("user_id") % len(EXTENSIONS)).cast("int"))
    path = F.concat(F.lit("/w/"), F.col("user_id").cast("string"), F.lit("."), ext)
    exists = F.col("event_id") % 5 != 0
    return table(spark, sf_dir, "events").select(path.alias("path"), exists.alias("exists"), (exists & (F.col("event_id") % 7 != 0)).alias("is_file"), F.struct("ts", "event_id").alias("ts"))


_OPS = f"""lasts AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY user_id),
ops AS (SELECT '/w/' || user_id || '.' || ({list(EXTENSIONS)!r})[user_id % 10 + 1] AS path, user_id, CASE WHEN e % 5 = 0 THEN 'removed' WHEN e % 7 <> 0 AND user_id % 10 <> 8 THEN 'changed' END AS op FROM lasts)"""


@query("event_classify", f"WITH {_OPS} SELECT path, op FROM ops WHERE op IS NOT NULL")
def event_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.classify(_file_events(spark, sf_dir))


_AFTER = f"""WITH {_OPS}, o AS (SELECT regexp_extract(path, '[0-9]+')::BIGINT AS id, path, op FROM ops WHERE op IS NOT NULL)
SELECT '/w/' || doc_id || '.' || ({list(EXTENSIONS)!r})[doc_id % 10 + 1] AS path, 'old' AS state FROM documents WHERE doc_id NOT IN (SELECT id FROM o) UNION ALL SELECT path, 'new text' FROM o WHERE op = 'changed'"""


def _watched(spark: SparkSession, sf_dir: str) -> str:
    """An index with a file for each document, as events name them."""
    path = work.new_path(spark, "query-index")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("/w/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"), F.lit(0).alias("chunk_idx"), F.lit("old").alias("chunk_text"))
    index.create(spark, path, _index_rows(rows), {"engine": "Fastembed", "model_id": "hashing", "dimension": 4, "root_path": "/"}, bucket_rows=1000)
    return path


def _reread(changed: DataFrame) -> DataFrame:
    """Documents of changed paths, as a reader of files gives them."""
    return changed.select("path", paths.file_type(F.col("path")).alias("file_type"), F.lit("new text").alias("text"), F.lit(None).cast(f"array<{schema.SEGMENT}>").alias("source_map"), F.lit(None).cast("string").alias("error"))


def _states(spark: SparkSession, path: str) -> DataFrame:
    return index.open_index(spark, path).chunks.select(F.col("file_path").alias("path"), F.col("chunk_text").alias("state"))


@query("event_apply_batch", _AFTER)
def event_apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after one batch of events."""
    path = _watched(spark, sf_dir)
    watch.apply_batch(spark, path, _file_events(spark, sf_dir), _reread, embed.HashingEmbedder(4), "/none", batch=0)
    return _states(spark, path)


@query("stream_upsert", f"""WITH e AS (SELECT *, ts + to_microseconds(event_id) AS t FROM events), m AS (SELECT min(t) AS a, max(t) AS b FROM e),
lasts AS (SELECT user_id, t > a + (b - a) / 2 AS late, arg_max(event_id, t) AS e FROM e, m GROUP BY ALL),
ops AS (SELECT user_id AS id, late, CASE WHEN e % 5 = 0 THEN 'removed' WHEN e % 7 <> 0 AND user_id % 10 <> 8 THEN 'changed' END AS op FROM lasts),
o AS (SELECT id, arg_max(op, late) AS op FROM ops WHERE op IS NOT NULL GROUP BY id), p AS (SELECT id, op, '/w/' || id || '.' || ({list(EXTENSIONS)!r})[id % 10 + 1] AS path FROM o)
SELECT '/w/' || doc_id || '.' || ({list(EXTENSIONS)!r})[doc_id % 10 + 1] AS path, 'old' AS state FROM documents WHERE doc_id NOT IN (SELECT id FROM p) UNION ALL SELECT path, 'new text' FROM p WHERE op = 'changed'""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after a stream of event files, those of the first and of the second half of the time."""
    path, events = _watched(spark, sf_dir), work.new_path(spark, "query-events")
    ordered = _file_events(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts.ts").cast("timestamp")) + F.col("ts.event_id")))
    ends = ordered.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    late = F.unix_micros("ts") * 2 > ends[0] + ends[1]
    for part in (~late, late):
        ordered.where(part).write.mode("append").parquet(events)
        watch.watch(spark, events, path, _reread, embed.HashingEmbedder(4), "/none", events + "-checkpoint", once=True).awaitTermination()
    return _states(spark, path)


@query("extract_words", f"""WITH {_CORPUS}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM corpus WHERE path LIKE '%.pdf' AND text IS NOT NULL),
w AS (SELECT path, n, list_filter(regexp_split_to_array(line, '[ \\t\\r\\v\\f]+'), lambda x: x <> '') AS ws FROM l),
t AS (SELECT path, string_agg(array_to_string(ws, ' ') || chr(10), '' ORDER BY n) AS body FROM w GROUP BY path),
h AS (SELECT path, body, regexp_extract_all(body, '(?i)of\\s+the') AS hs, string_split_regex(body, '(?i)of\\s+the') AS ps FROM t),
f AS (SELECT path, unnest(hs) AS m, unnest(list_transform(range(1, len(hs) + 1), lambda k: strlen(array_to_string(ps[1:k], '') || array_to_string(hs[1:k - 1], '')))) AS start FROM h)
SELECT path, start::BIGINT AS start, (start + strlen(m))::BIGINT AS "end", 1 AS page FROM f""")
def extract_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of words through the extractor path: each document's lines as lines of words with boxes."""

    def run(content: bytes) -> extract.Extracted:
        lines = [[(w, float(k), float(n), float(len(w)), 1.0) for k, w in enumerate(line.split())] for n, line in enumerate(content.decode().split("\n"))]
        return extract.words_to_text([lines])

    registry = extract.Registry(extract.Extractor("words", ("pdf",), run))
    docs = corpus(spark, sf_dir).where(F.col("path").endswith(".pdf"))
    read = extract.documents(docs.select("path", F.lit(paths.PDF).alias("file_type"), F.col("text").cast("binary").alias("content")), registry)
    return grep.grep_whole(read, SearchQuery("of the"), keep=["path"]).select("path", "start", "end", "page")


@query("overlap_join", f"WITH {_SEGMENTS} SELECT p.conv_id, turn FROM probe p JOIN segs s USING (conv_id) WHERE s.s < b AND s.e > a")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges against segments as a join on the document with an overlap condition."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"))
    segs = turns.select("conv_id", "turn", (F.sum("n").over(w) - F.col("n")).alias("s"), F.sum("n").over(w).alias("e"))
    probe = turns.select("conv_id").distinct().withColumns({"a": 100 + F.col("conv_id") % 400, "b": 400 + F.col("conv_id") % 400})
    return segs.join(probe, "conv_id").where("s < b and e > a").select("conv_id", "turn")


# files as they are read

_BAD = "doc_id % 3 = 1"


@query("read_texts", f"""WITH d AS (SELECT doc_id, {_BAD} AS bad, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN NOT bad THEN length(t) END::INT AS strict_chars, (length(t) + CASE WHEN bad THEN 1 ELSE 0 END)::INT AS lossy_chars, (length(left(t, 3)) = 3 OR length(t) < 3) AS head_ok FROM d""")
def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of files, some with a byte that is no UTF-8: read strictly, with replacement, and from the head."""
    content = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.when(F.expr(_BAD), F.unhex(F.lit("FF"))).otherwise(F.lit(b"")))
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("c"), F.length("text").alias("n"))
    head = files.head_text(F.col("c"), 12)
    return rows.select("doc_id", F.length(files.strict_text(F.col("c"))).alias("strict_chars"), F.length(files.lossy_text(F.col("c"))).alias("lossy_chars"), ((F.length(head) >= 3) | (F.coalesce("n", F.lit(0)) < 3)).alias("head_ok"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each document, in a folder of its own, a thousand of these to a folder; some of them hidden and some ignored."""
    root = work.new_path(spark, "query-folder")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", F.when(F.col("doc_id") % 4 == 0, ".hidden").when(F.col("doc_id") % 4 == 1, "skipped").otherwise("shown").alias("kind"))
    if walk.reachable(root):
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
        relative = F.concat_ws("/", "kind", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.lit("doc_id="), "doc_id"), F.concat(F.lit("part-"), nth, F.lit(".txt")))
        walk.write_files(docs.select(relative.alias("relative"), F.concat("text", F.lit("\n")).cast("binary").alias("content")), root)
    else:  # only Spark's writers know the store
        for kind in (".hidden", "skipped", "shown"):
            docs.where(F.col("kind") == kind).drop("kind").repartition("doc_id").write.partitionBy("doc_id").option("compression", "none").text(f"{root}/{kind}")
    Folder(spark, root).write(".gitignore", "# made by a query\nskipped/\n_SUCCESS\n")
    return root


@query("folder_search", "SELECT doc_id, count(*) AS n, min(strlen(h)) AS shortest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[a-z]*tion')) AS h FROM documents WHERE doc_id % 4 <> 1) GROUP BY doc_id")
def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of a folder: hidden files count, ignored ones do not."""
    matches, _ = search.search_folder(spark, SearchQuery("[a-z]*tion", is_regex=True, root=_folder(spark, sf_dir)))
    return matches.groupBy(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.min(F.octet_length("matched_text")).cast("long").alias("shortest"))


@query("folder_listing", "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size_bytes FROM documents WHERE doc_id % 4 > 1")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of the same folder leaves hidden files out too."""
    found = files.listing(files.names(spark, _folder(spark, sf_dir), files.LISTING).where("relative like '%.txt'"))
    return found.where("omit_reason is null").select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), "size_bytes")


@query("extract_errors", f"WITH {_CORPUS} SELECT path, path || CASE WHEN doc_id % 20 = 7 THEN ': broken' ELSE ': no extractor registered' END AS error FROM corpus WHERE doc_id % 20 = 7 OR path LIKE '%.rs'")
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be extracted is told with its path; the rest goes on."""

    def run(content: bytes) -> extract.Extracted:
        if content == b"broken":
            raise ValueError("broken")
        return extract.Extracted(content.decode())

    docs = corpus(spark, sf_dir).where(F.col("path").endswith(".pdf") | F.col("path").endswith(".rs"))
    content = F.when(F.col("doc_id") % 20 == 7, F.lit("broken")).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    read = extract.documents(docs.select("path", F.lit(paths.PDF).alias("file_type"), content.alias("content")), extract.Registry(extract.Extractor("x", ("pdf",), run)))
    return read.where("error is not null").select("path", "error")


# embedding and semantic search with an embedder that SQL can follow


@dataclass(frozen=True)
class LetterEmbedder:
    """How often each of eight letters occurs."""

    dimension: int = 8
    model_id: str = "letters"
    engine: str = "Fastembed"
    batch: int | None = 32
    query_prefix: str = "ab: "
    passage_prefix: str = "c: "

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in "abcdefgh"] for t in texts]


_LETTERS = lambda text: "[" + ", ".join(f"(length({text}) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in "abcdefgh") + "]"


@query("embed_passages", f"SELECT item_id, {_LETTERS(chr(39) + 'c: ' + chr(39) + ' || coalesce(text, ' + chr(39) * 2 + ')')}::FLOAT[] AS embedding FROM benchmark")
def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed.embed_passages(table(spark, sf_dir, "benchmark"), LetterEmbedder(), text="text")
    return rows.where("embed_error is null").select("item_id", "embedding")


_ASKED = "Badge of a cage"
_TOP = f"""WITH {_CORPUS}, plain AS (SELECT path, text FROM corpus WHERE path NOT LIKE '%.pdf' AND path NOT LIKE '%.rs' AND text <> ''),
c AS (SELECT path, text, unnest(range(0, greatest(length(text) - 128 - 1, 0) // 472 + 1)) AS k FROM plain),
e AS (SELECT path, k::INT AS chunk_idx, strlen(left(text, (k * 472)::INT))::BIGINT AS start, len(string_split(left(text, (k * 472)::INT), chr(10)))::INT AS line, trim(substr(text, k * 472 + 1, 600), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM c),
s AS (SELECT *, list_cosine_similarity({_LETTERS("'c: ' || t")}, {_LETTERS(f"'ab: {_ASKED}'")}) AS s FROM e WHERE t <> ''),
top AS (SELECT * FROM s WHERE s IS NOT NULL ORDER BY s DESC, replace(path, '/corpus/', ''), chunk_idx LIMIT 40)"""


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work.new_path(spark, "query-index")
    index.build(spark, path, _corpus_documents(spark, sf_dir), LetterEmbedder(), "/corpus", semantic=False)
    return search.search_index(spark, SearchQuery(_ASKED, mode="Semantic", root="/corpus", max_results=40, supported_extensions=("txt", "md", "json", "log")), path, LetterEmbedder())


@query("semantic_search", _TOP + " SELECT path, chunk_idx, t AS matched_text, 'TextFile' AS origin_type, line, 0 AS col, start, round(s, 4) AS score FROM top WHERE regexp_matches(path, '[.](txt|md|json|log)$')")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a build to matches: the filter on types is behind the limit."""
    return _searched(spark, sf_dir).select("path", "chunk_idx", "matched_text", "origin_type", "line", "col", "start", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("semantic_by_file", _TOP + ", kept AS (SELECT *, row_number() OVER (ORDER BY s DESC, path, chunk_idx) AS r FROM top WHERE regexp_matches(path, '[.](txt|md|json|log)$')) SELECT row_number() OVER (ORDER BY min(r)) - 1 AS rank, path, count(*) AS n, string_agg(chunk_idx, ',' ORDER BY r) AS chunks FROM kept GROUP BY path")
def semantic_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = search.by_file(_searched(spark, sf_dir))
    return grouped.select(F.col("rank").cast("long").alias("rank"), "path", "n", F.array_join(F.transform("matches", lambda m: m["chunk_idx"].cast("string")), ",").alias("chunks"))


@query("index_drop", f"WITH {_CHUNKS} SELECT 'kept' AS name, doc_id::VARCHAR AS file_path, chunk_idx::INT AS chunk_idx FROM chunks")
def index_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two indexes one is dropped: the rows that can still be read."""
    made = {name: _new_index(spark, sf_dir) for name in ("kept", "dropped")}
    index.drop(spark, made["dropped"])
    left = [index.open_index(spark, path).chunks.select(F.lit(name).alias("name"), "file_path", "chunk_idx") for name, path in made.items() if Folder(spark, path).exists("CURRENT")]
    return reduce(DataFrame.unionByName, left)


@query("knn_unknown_origin", f"WITH {_SCORED}, top AS (SELECT * FROM scored ORDER BY s DESC, label, vec_id LIMIT {_K}) SELECT vec_id FROM top WHERE vec_id % 3 <> 1")
def knn_unknown_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = knn.top_k(_vectors(spark, sf_dir), _query_vector(), _K, _TIES)
    kind = F.when(F.col("vec_id") % 3 == 0, "TextFile").when(F.col("vec_id") % 3 == 2, "PdfPage").otherwise("Other")
    return knn.supported(hits.withColumns({"file_path": F.lit("a.txt"), "origin_type": kind})).select("vec_id")


@query("chunk_semantic_promises", "SELECT doc_id, TRUE AS within_size, TRUE AS in_order, TRUE AS without_gap, TRUE AS within_overlap, TRUE AS trimmed, strlen(text) AS covered FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def chunk_semantic_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunks by meaning promise: none is too long or blank, each begins behind the last one's begin, nothing but white space is left out
    before, between and behind them, and neighbours share 128 characters at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = chunk.semantic_chunks(docs, keep=["doc_id"])
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    rows = rows.withColumns({"before": F.lag("byte_start").over(w), "end_before": F.coalesce(F.lag("byte_end").over(w), F.lit(0))}).join(docs, "doc_id")
    between = text.byte_slice(F.col("text"), F.least("end_before", "byte_start"), F.greatest("end_before", "byte_start"))
    gap = F.when(F.col("byte_start") > F.col("end_before"), text.clean(between) != "").otherwise(False)
    shared = F.when(F.col("byte_start") < F.col("end_before"), F.length(between)).otherwise(0)
    behind = text.byte_slice(F.col("text"), F.col("byte_end"), F.octet_length("text"))
    last = F.max(F.struct("byte_end", F.octet_length("text").cast("long").alias("size"), (text.clean(behind) == "").alias("blank")))
    return rows.groupBy("doc_id").agg(
        (F.max(F.length("chunk_text")) <= 600).alias("within_size"), F.bool_and(F.coalesce(F.col("byte_start") > F.col("before"), F.lit(True))).alias("in_order"),
        (~F.bool_or(gap)).alias("without_gap"), (F.max(shared) <= 128).alias("within_overlap"), F.bool_and(text.clean(F.col("chunk_text")) == F.col("chunk_text")).alias("trimmed"), last.alias("last"),
    ).select("doc_id", "within_size", "in_order", "without_gap", "within_overlap", "trimmed", F.when(F.col("last.blank"), F.col("last.size")).alias("covered"))


@query("words_of_characters", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM conversations WHERE text <> ''),
c AS (SELECT conv_id, turn, n, k, substr(line, k + 1, 1) AS ch FROM (SELECT *, unnest(range(greatest(length(line), 1))) AS k FROM l)),
b AS (SELECT *, ch IN (' ', chr(9), chr(11), chr(12), chr(13), chr(160), chr(8195), chr(12288)) AS sp, strlen(ch) AS size FROM c),
p AS (SELECT *, sum(size) OVER w - size AS a, sum(sp::INT) OVER w AS g FROM b WINDOW w AS (PARTITION BY conv_id, turn, n ORDER BY k)),
base AS (SELECT conv_id, turn, n, sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn, n) - bytes AS base FROM (SELECT conv_id, turn, n, sum(size) + 1 AS bytes FROM b GROUP BY ALL)),
w AS (SELECT conv_id, turn, n, g, min(a) AS s, max(a + size) AS e, min(k) FILTER (ch <> 'i') AS x, max(k + 1) FILTER (ch <> 'i') AS r, string_agg(ch, '' ORDER BY k) AS word FROM p WHERE NOT sp AND ch <> '' GROUP BY ALL)
SELECT conv_id, turn::INT AS page, (base + s)::BIGINT AS start, (base + e)::BIGINT AS "end", x::FLOAT AS x, (r - x)::FLOAT AS width, word FROM w JOIN base USING (conv_id, turn, n)
""")
def words_of_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a page for each turn, given character by character (an "i" without width): their words, places and boxes."""
    lines = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", F.col("turn").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0))), lambda k: F.substring(F.col("body"), k + 1, F.lit(1)))
    chars = lines.select("conv_id", "page", "line", F.posexplode(each).alias("at", "char"))
    chars = chars.select("*", F.col("at").alias("x1"), (F.col("at") + F.when(F.col("char") == "i", 0).otherwise(1)).alias("x2"), F.col("line").alias("y1"), (F.col("line") + 1).alias("y2"))
    read = words.documents_of_characters(chars, ["conv_id"])
    rows = read.select("conv_id", "text", F.explode("source_map").alias("s"))
    return rows.select("conv_id", F.col("s.origin.page").alias("page"), "s.start", "s.end", F.col("s.origin.bbox.x").alias("x"), F.col("s.origin.bbox.width").alias("width"), text.byte_slice(F.col("text"), F.col("s.start"), F.col("s.end")).alias("word"))


# previews and names


@query("preview_line_highlight", "WITH d AS (SELECT doc_id, doc_id % 4 AS line, list_transform(CASE WHEN ends_with(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END, lambda x: regexp_replace(x, chr(13) || '$', '')) AS ls FROM documents) SELECT doc_id, line::INT AS highlight_line, CASE WHEN line BETWEEN 1 AND len(ls) THEN strlen(array_to_string(ls[1:line - 1], chr(10))) + CASE WHEN line > 1 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS start FROM d")
def preview_line_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a range the line is highlighted; line 0 is none."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("long")
    shown = preview.highlight(F.col("text"), none, none, (F.col("doc_id") % 4).cast("int"))
    return docs.select("doc_id", shown.alias("h")).select("doc_id", "h.highlight_line", "h.start")


@query("preview_opened", f"WITH {_CORPUS} SELECT path, CASE WHEN path LIKE '%.pdf' THEN 'Pdf' WHEN path NOT LIKE '%.rs' THEN 'Text' END AS kind, CASE WHEN path LIKE '%.pdf' THEN 1 END AS page, CASE WHEN path NOT LIKE '%.pdf' AND path NOT LIKE '%.rs' THEN text END AS content, CASE WHEN path LIKE '%.rs' THEN 'unsupported file type' END AS error FROM corpus")
def preview_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    shown = preview.opened(paths.file_type(F.col("path")), F.col("text"), paths.language_hint(F.col("path")))
    return docs.select("path", shown.alias("s")).select("path", "s.kind", "s.page", "s.content", "s.error")


@query("preview_pages", "SELECT event_id, 'Pdf' AS kind, (event_id % 9)::INT AS page, (event_id % 5)::DOUBLE AS x FROM events")
def preview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = preview.of_pages(F.col("event_id") % 9, F.struct((F.col("event_id") % 5).cast("double").alias("x")))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("s")).select("event_id", "s.kind", "s.page", F.col("s.bbox.x").alias("x"))


@query("engine_parse", "SELECT event_id, ['SBERT', 'SBERT', 'Fastembed', 'Candle', 'Candle'][event_id % 5 + 1] AS engine FROM events")
def engine_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("SBERT", "Python", "fastEmbed", "candle", "other"))), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", display.engine_name(name).alias("engine"))


@query("catch_up", "SELECT p AS path, CASE WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS op FROM (SELECT '/p/' || doc_id AS p, n_chars AS a FROM documents WHERE doc_id % 5 <> 0) FULL JOIN (SELECT '/p/' || doc_id AS p, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS b FROM documents WHERE doc_id % 5 <> 1) USING (p) WHERE a IS DISTINCT FROM b")
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two listings."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/p/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.col("n_chars").alias("size_bytes"), F.lit(1).alias("modified"))
    old = docs.where("doc_id % 5 <> 0").drop("doc_id")
    new = docs.where("doc_id % 5 <> 1").withColumn("size_bytes", F.expr("if(doc_id % 7 = 0, size_bytes + 1, size_bytes)")).drop("doc_id")
    return watch.catch_up(old, new)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
