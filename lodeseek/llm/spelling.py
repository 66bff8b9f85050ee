"""Spelling variants: words one edit apart, found through forward and backward minimal acyclic automata.

A word of length n has its halves at n // 2. If another word is one inserted, deleted or replaced character away, the edit lies in one half
and the other half stands in both words: as a prefix of both, or as a suffix of both. So the vocabulary is dealt twice: by
prefixes to look words up forward, by suffixes (on reversed words) to look them up backward. A word asks under its own half and is listed under the halves
that words one shorter, as long and one longer have, two at most. All that can meet is thus in one group, and groups share buckets of
about BUCKET listed words. A half with more than that is split into blocks: each block of those listed meets each block of those that ask, so a half of n words
makes n * n / BUCKET rows and no group is larger than two blocks.

A bucket's words, sorted, make a minimal acyclic automaton: states with equal futures are one, and each arc carries how many words lie
before it, so that the sums along a path number the words in order without gaps. A search walks the half exactly, then
goes on with one error still to make, and ends with the word's number, which finds its count. Every edit is made in one place only (at the end of a
run of equal characters), and what the forward search finds the backward one leaves out, so each near word counts once and no list of pairs is ever kept.

A word's form is its most frequent near word where that is RATIO times as frequent or more. Counts rise tenfold along forms, so
chains end after as many steps as counts have digits, and roots come from doubling those steps.

Defined results: null and empty texts have no words; words of any length count whole; repeated rows count as
often as they are there; a null doc_id counts as an empty one; ties go to the smaller word in code-point order; an empty table gives an empty result;
other columns, whatever their names, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, bounded, write_shared

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, OFTEN, RATIO, DROPPED = 7, 2, 10, 31
BUCKET = 40_000


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, often: int = OFTEN, dropped: int = DROPPED) -> DataFrame:
    """word, n: runs of letters in lower case (A-Z alone), of `shortest` characters or more and found `often` times or more.

    Where the checksum of a document's id and run is a multiple of `dropped` (0: never), the run lacks a character in that document.
    """
    runs = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run")
    if dropped:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % dropped == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    counted = rows.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= often)


class State:
    """final: a word ends here; count: words from here on; arcs: character -> (state, words before those of the arc)."""

    __slots__ = ("arcs", "count", "final")

    def __init__(self) -> None:
        self.final, self.count, self.arcs = False, 0, {}


def automaton(ordered: list[str]) -> State:
    """The minimal acyclic automaton of words in order, without repetition."""
    register: dict[tuple, State] = {}
    root = State()
    path, last = [root], ""

    def closed(down_to: int) -> None:
        """Numbers the arcs of the states behind down_to on the last path, and replaces those that are known."""
        while len(path) - 1 > down_to:
            state = path.pop()
            number = 1 if state.final else 0
            for c, (child, _) in state.arcs.items():
                state.arcs[c] = (child, number)
                number += child.count
            state.count = number
            key = (state.final, *[(c, id(child)) for c, (child, _) in state.arcs.items()])
            path[-1].arcs[last[len(path) - 1]] = (register.setdefault(key, state), 0)

    for word in ordered:
        same, most = 0, min(len(word), len(last))
        while same < most and word[same] == last[same]:
            same += 1
        closed(same)
        for c in word[same:]:
            child = State()
            path[-1].arcs[c] = (child, 0)
            path.append(child)
        path[-1].final = True
        last = word
    closed(0)
    number = 1 if root.final else 0
    for c, (child, _) in root.arcs.items():
        root.arcs[c] = (child, number)
        number += child.count
    root.count = number
    return root


def near(root: State, word: str, half: int) -> Iterator[int]:
    """Numbers of the words that begin with word[:half] and are one edit behind it away, each once."""
    state, number, size = root, 0, len(word)
    for c in word[:half]:
        arc = state.arcs.get(c)
        if arc is None:
            return
        state, number = arc[0], number + arc[1]

    def rest(state: State, number: int, at: int) -> int | None:
        """Number of the word that goes on as word[at:] does, if there is one."""
        while at < size:
            arc = state.arcs.get(word[at])
            if arc is None:
                return None
            state, number, at = arc[0], number + arc[1], at + 1
        return number if state.final else None

    for at in range(half, size):
        own = word[at]
        for c, (child, before) in state.arcs.items():
            if c != own:
                for found in (rest(child, number + before, at), rest(child, number + before, at + 1)):  # c inserted, c instead
                    if found is not None:
                        yield found
        if at + 1 == size or word[at + 1] != own:  # own deleted
            found = rest(state, number, at + 1)
            if found is not None:
                yield found
        arc = state.arcs.get(own)
        if arc is None:
            return
        state, number = arc[0], number + arc[1]
    for child, before in state.arcs.values():  # one more at the end
        if child.final:
            yield number + before


def _halves(word: Column, backward: bool) -> tuple[Column, Column]:
    """(the half a word asks under, the halves it is listed under), of words or reversed words."""
    size = F.length(word)
    # Backward, a reversed word begins with the second half, the longer one.
    half = lambda n: F.ceil(n / 2).cast("int") if backward else F.floor(n / 2).cast("int")
    cut = lambda n: F.substring(word, F.lit(1), half(n))
    return cut(size), F.array_distinct(F.array(cut(size), cut(size - 1), cut(size + 1)))


def _dealt(vocabulary: DataFrame, backward: bool, bucket: int) -> DataFrame:
    """backward, bucket (a group of their own for blocks of large halves), word (reversed if backward), n, asks."""
    word = F.reverse("word") if backward else F.col("word")
    own, listed = _halves(F.col("w"), backward)
    rows = vocabulary.select(word.alias("w"), "n").select("w", "n", own.alias("own"), F.explode(listed).alias("half"))
    rows = rows.select("w", "n", "half", (F.col("half") == F.col("own")).alias("asks"))
    sizes = rows.groupBy("half").agg(F.count("*").alias("listed")).where(F.col("listed") > bucket)
    large = write_shared(sizes.select("half", F.ceil(F.col("listed") / bucket).cast("int").alias("blocks")), "spelling-large")
    buckets = F.lit(max(1, -(-2 * vocabulary.count() // bucket)))
    small = F.struct(F.lit("").alias("half"), F.pmod(F.xxhash64("half"), buckets).cast("int").alias("part"))
    placed = rows.select("w", "n", "asks", F.lit(True).alias("listed"), small.alias("bucket"))
    if not large.isEmpty():
        blocks, mine = F.col("blocks"), F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int")
        # A cell (x, y) has the words listed in block x and those that ask in block y.
        each = lambda cell: F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.col("half"), cell(k).alias("part")))
        spread = rows.join(large, "half").withColumn("mine", mine)
        listed = spread.select("w", "n", F.lit(False).alias("asks"), F.lit(True).alias("listed"), F.explode(each(lambda y: F.col("mine") * blocks + y)).alias("bucket"))
        asking = spread.where("asks").select("w", "n", "asks", F.lit(False).alias("listed"), F.explode(each(lambda x: x * blocks + F.col("mine"))).alias("bucket"))
        placed = rows.join(large, "half", "left_anti").select("w", "n", "asks", F.lit(True).alias("listed"), small.alias("bucket")).unionByName(listed).unionByName(asking)
    return placed.select(F.lit(backward).alias("backward"), "bucket.half", "bucket.part", "w", "n", "asks", "listed")


_FOUND = "word string, n long, n_near long, best_n long, best string"


def _bucket(table: pa.Table) -> pa.Table:
    """Near words of those that ask in a bucket, among those listed there: how many, and the most frequent."""
    backward = table.column("backward")[0].as_py()
    asks, counts = {}, {}
    for w, n, ask, listed in zip(*(table.column(c).to_pylist() for c in ("w", "n", "asks", "listed")), strict=True):
        if ask:
            asks[w] = n
        if listed:
            counts[w] = n
    ordered = sorted(counts)
    root = automaton(ordered)
    out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}
    for w, n in asks.items():
        half = -(-len(w) // 2) if backward else len(w) // 2
        found = [ordered[k] for k in near(root, w, half)]
        if backward:  # the forward search has those that begin with the first half of the word
            found = [v[::-1] for v in found if not v.endswith(w[half:])]
        if found:
            best_n, best = min((-counts[v[::-1] if backward else v], v) for v in found)
            for name, value in zip(out, (w[::-1] if backward else w, n, len(found), -best_n, best), strict=True):
                out[name].append(value)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds, strict=True)})


def forms(vocabulary: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """word, n, n_near, form, form_n of each word of a written vocabulary (word, n)."""
    dealt = _dealt(vocabulary, False, bucket).unionByName(_dealt(vocabulary, True, bucket))
    found = bounded(dealt).groupBy("backward", "half", "part").applyInArrow(_bucket, _FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    every = vocabulary.selectExpr("word", "n", "0L as n_near", "cast(null as long) as best_n", "cast(null as string) as best").unionByName(found)
    rows = every.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    good = -F.col("best.less") >= ratio * F.col("n")
    return rows.select("word", "n", "n_near", F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))


def rooted(formed: DataFrame, ratio: int = RATIO) -> DataFrame:
    """formed, written, with root: the last of a word's forms, or the word itself. Steps double each round."""
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    longest, most = 0, formed.agg(F.max("n")).first()[0] or 0
    while most >= ratio:
        longest, most = longest + 1, most // ratio
    steps = 1
    while steps < longest:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = write_shared(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        steps *= 2
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO, bucket: int = BUCKET, dropped: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs."""
    vocabulary = write_shared(words(docs, text, doc_id, dropped=dropped), "spelling-words")
    return rooted(write_shared(forms(vocabulary, ratio, bucket), "spelling-forms"), ratio)
