"""Secret scans: plain patterns, and strings that a Markov model takes for random rather than written.

Base kinds, leftmost and not overlapping within a kind: assign (a keyword, ":" or "=", a value of 8
or more characters), access (AKIA and capitals or digits, 16 or more) and hex (32 or more lower-case
hex digits). The method adds kind markov: a run of 20 or more characters of keys and tokens, with a
letter, whose characters are likelier under a first-order Markov model of random strings than under one of
ordinary identifiers, by a log-likelihood ratio per character over a threshold. The threshold is learned too: the least at which hardly any
labelled ordinary string of words that training has not seen is taken for random.

Both models are learned from labelled strings. In the corpus itself, what base matches hold is labelled
random and all else ordinary; fit() counts pairs of characters over all documents, which are at
most 2 * 66 * 66 numbers however large the corpus. A prior sample of made strings (below) has half the weight,
so kinds of keys and of names that a corpus lacks are known too; without a corpus it has all.

Pairs of characters cannot tell all kinds of ordinary strings. UUIDs and the contents of data URIs are taken out of runs as base matches are, without being spans, and
a string that is mostly made of a few characters (DNA, bits, patterns) is not random.

What base matches leave of a run is scored piece by piece: a piece that is random as a whole is a span; of
others, the segments of highest score, widened to the next / - _ = on both sides, are judged like pieces, so a
key is found behind a path or a name. Stretches under 20 characters or without a letter are never spans of this kind.

Defined results: null is an empty text; repeated rows get equal results; a column spans of the
input is replaced, others stay; an empty table gives an empty result. Offsets are code points.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, by_size, trimmed, without

#: Kinds in their order.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORD = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters of runs that join a key to ordinary words.
_SEPARATORS = "/-_="
#: Characters of a span of kind markov at least; the FEW commonest of them make up MOSTLY of it at most.
LEAST, FEW, MOSTLY = 20, 5, 0.75
#: Share of labelled ordinary strings that may pass for random, and the least threshold (nats per character) in any case.
PASS, FLOOR = 0.001, 0.05
#: Ordinary strings that look random: UUIDs, and what follows the mark of a data URI.
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
_DATA = re.compile(r";base64,[A-Za-z0-9+/_=-]+")

#: Words of which ordinary identifiers, paths and names are made: the prior sample of ordinary strings.
ORDINARY_WORDS = (
    "access account action active address agent alert align apply array asset async author backup balance base batch "
    "block body border branch bucket buffer build button cache call center change channel check child class client close "
    "code column command commit common config connect content context control copy count create current customer data "
    "date debug default delete depth detail device direct display document domain driver edit element email enable end "
    "entry error event example execute export factory feature field file filter find first flag folder format frame "
    "function future general global group handler header height hidden history home host image import index info input "
    "instance interface internal item join key label language last layout length level library limit line link list load "
    "local lock login main manager map master match max memory menu message method metric min mode model module name "
    "network next node normal number object offset open option order output owner package page panel parent parse path "
    "pattern payment phone pixel point policy port position post prefix process product profile project property query "
    "queue random range rate raw read record reference region register release remote render report request reset resource response "
    "result return role root route row rule run sample scale schema scope screen script search section select server service session "
    "setting shape share size sort source stage start state status store stream string style subject submit switch system table tag "
    "target task template test text theme thread time title token tool total track transfer tree type unit update upload user util "
    "value variable vector version video view visible volume wait watch web week weight width window word work worker world wrap "
    "write year yield young zero zone zoom"
).split()


#: Words and parts of names of other languages (Welsh, German, Finnish, Dutch, Polish, Spanish, French, Japanese, North America's).
OTHER_WORDS = (
    "blodyn llanfair pwll gwyn gyll goger wern drob ysgol mynydd cymru eglwys afon nant bryn maes capel felin heol ffordd "
    "schule strasse bruecke rathaus bahnhof zeitung kirche schloss wasser garten hauptstadt gesellschaft verwaltung geschwindigkeit freundschaft "
    "kirjasto yliopisto kaupunki jarvi saari talvi syksy ystava kauppa asema hallitus ministeri yhteiskunta "
    "gemeente koninklijk ziekenhuis vliegveld straatweg universiteit maatschappij wydawnictwo uniwersytet szkola miasto rzeka krakow warszawa "
    "biblioteca ayuntamiento carretera desarrollo gobierno provincia municipio ciudad bibliotheque gouvernement entreprise quartier chateau montagne "
    "kotoba shinbun toshokan daigaku machi yama kawa sakura hashi densha mississippi massachusetts chattahoochee okeechobee"
).split()
#: Words of the labelled strings that the threshold is learned from; no model is trained on them.
HELD_OUT_WORDS = (
    "abbey anchor autumn bakery bishop bridge castle cattle charity cinema colony concert cottage county desert dragon eagle engine estate farmer "
    "ferry fishing forest fortress galaxy glacier gospel harvest highway hotel island jungle kingdom knight lantern lecture lizard magazine marble meadow "
    "mineral monastery mountain musical nature ocean orchard painter parish pilgrim planet prairie prison rainbow republic saddle sailor "
    "savings shadow shelter sheriff signal soccer spirit statue surgeon temple tennis tunnel valley violin walnut warrior whisper willow wizard "
    "caernarfon pontypridd heidelberg oberbayern rovaniemi jyvaskyla groningen scheveningen bydgoszcz zaragoza guadalajara montpellier yokohama nagasaki saskatchewan"
).split()


def _ordinary(rng: random.Random, held_out: bool = False) -> str:
    from_ = HELD_OUT_WORDS if held_out else OTHER_WORDS if rng.random() < 0.25 else ORDINARY_WORDS
    words = rng.sample(from_, rng.randint(2, 5))
    style = rng.randrange(6)
    text = ("_", "-", "/", "", "", "")[style].join(w.capitalize() if style == 3 or style == 4 and k else w for k, w in enumerate(words))
    if style == 5:
        text = "_".join(words).upper()
    return text + (str(rng.choice((1, 2, 10, 64, 2019, 2024, 100, 404))) if rng.random() < 0.3 else "")


def _random(rng: random.Random) -> str:
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabet = rng.choice((lower + digits, lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", "0123456789abcdef", lower.upper() + digits, lower, lower + lower.upper()))
    return "".join(rng.choices(alphabet, k=rng.randint(20, 64)))


def samples(n: int = 4000, seed: int = 20240) -> tuple[list[str], list[str]]:
    """Prior samples: random strings and ordinary identifiers, the same each time."""
    rng = random.Random(seed)
    return [_random(rng) for _ in range(n)], [_ordinary(rng) for _ in range(n)]


def held_out(n: int = 4000, seed: int = 7321) -> list[str]:
    """Labelled ordinary strings, long enough to be spans, of words that no model is trained on."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        made = _ordinary(rng, held_out=True)
        if len(made) >= LEAST:
            out.append(made)
    return out


#: Characters of runs.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET)
_CODES = np.full(256, _SIZE, np.int64)  # of bytes; _SIZE for all that are no characters of runs
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_SIZE)


def pair_counts(text: bytes) -> np.ndarray:
    """How often each character of ALPHABET follows each, as a matrix."""
    codes = _CODES[np.frombuffer(text, np.uint8)]
    counts = np.bincount(codes[:-1] * (_SIZE + 1) + codes[1:], minlength=(_SIZE + 1) ** 2)
    return counts.reshape(_SIZE + 1, _SIZE + 1)[:_SIZE, :_SIZE]


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Of each next character, with add-a-half smoothing."""
    smooth = counts + 0.5
    return smooth / smooth.sum(axis=1, keepdims=True)


def varied(text: str) -> bool:
    """Whether text is made of more than a few characters."""
    return sum(n for _, n in Counter(text).most_common(FEW)) <= MOSTLY * len(text)


class Model:
    """Log-likelihood ratios of character pairs, random over ordinary; learned: pair counts (random, ordinary) of a corpus."""

    def __init__(self, learned: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        both = [probabilities(pair_counts(" ".join(s).encode())) for s in samples()]
        if learned is not None:
            # A corpus without strings of a label says nothing about it.
            both = [(p + probabilities(n)) / 2 if n.any() else p for p, n in zip(both, learned, strict=True)]
        matrix = np.log(both[0] / both[1])
        self.table = {a + b: float(matrix[i, j]) for i, a in enumerate(ALPHABET) for j, b in enumerate(ALPHABET)}
        ratios = sorted(map(self.ratio, held_out()))
        self.threshold = max(FLOOR, ratios[int(len(ratios) * (1 - PASS))])

    def ratio(self, text: str) -> float:
        """Mean ratio per character pair; text: of the runs' alphabet."""
        return sum(self.table[text[k : k + 2]] for k in range(len(text) - 1)) / max(1, len(text) - 1)

    def is_random(self, text: str) -> bool:
        return len(text) >= LEAST and any(c.isalpha() for c in text) and varied(text) and self.ratio(text) > self.threshold

    def random_parts(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the random stretches of text: all of it, or segments widened to separators."""
        if len(text) < LEAST:
            return []
        if self.is_random(text):
            return [(0, len(text))]
        parts: list[tuple[int, int]] = []
        for a, b in _segments([self.table[text[k : k + 2]] - self.threshold for k in range(len(text) - 1)]):
            # Pair k is of characters k and k + 1; a separator at an end is left out.
            first, last = a + (text[a] in _SEPARATORS), b + (text[b] not in _SEPARATORS)
            start = max(text.rfind(c, 0, first) for c in _SEPARATORS) + 1
            end = min((at for c in _SEPARATORS if (at := text.find(c, last)) >= 0), default=len(text))
            if parts and start < parts[-1][1]:
                continue
            if self.is_random(text[start:end]):
                parts.append((start, end))
        return parts


@lru_cache(maxsize=1)
def prior() -> Model:
    """The model without a corpus."""
    return Model()


def ratio(text: str) -> float:
    return prior().ratio(text)


def _segments(scores: list[float]) -> list[tuple[int, int]]:
    """All segments of highest sum (start, end), disjoint, in linear time (Ruzzo and Tompa)."""
    done, open_, total = [], [], 0.0
    for k, x in enumerate(scores):
        if x > 0:
            left, right, start = total, total + x, k
            while open_:
                j = len(open_) - 1
                while j >= 0 and open_[j][0] >= left:
                    j -= 1
                if j < 0:  # the sum was never lower: nothing that follows joins what stands
                    done += open_
                    open_ = []
                elif open_[j][1] >= right:
                    break
                else:
                    left, start = open_[j][0], open_[j][2]
                    del open_[j:]
            open_.append((left, right, start, k + 1))
        total += x
    return [(start, end) for _, _, start, end in done + open_]


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the plain patterns' matches."""
    found = []
    if ":" in text or "=" in text:
        lower = text.lower()  # for this test only: it may have other offsets
        if any(k in lower for k in _KEYWORD):
            found += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end(), m[0]) for r in _RUN.finditer(text) for m in _HEX.finditer(text, r.start(), r.end())]


def scan(text: str | None, model: Model | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start, then kind."""
    if not text:
        return []
    model = model or prior()
    found = [(a, kind, b) for a, kind, b, _ in base_matches(text)]
    taken = [(a, b) for a, _, b in found]
    if "-" in text:
        taken += [m.span() for m in _UUID.finditer(text)]
    if ";base64," in text:
        taken += [m.span() for m in _DATA.finditer(text)]
    base, k = sorted(taken), 0
    for m in _RUN.finditer(text):
        at = m.start()
        while k < len(base) and base[k][1] <= at:
            k += 1
        for a, b in [*_touching(base, k, m.end()), (m.end(), m.end())]:
            found += [(at + x, 3, at + y) for x, y in model.random_parts(text[at : max(at, a)])]
            at = max(at, b)
    return sorted(found)


def _touching(base: list[tuple[int, int]], k: int, end: int) -> Iterator[tuple[int, int]]:
    """base from k on, as far as it begins before end."""
    while k < len(base) and base[k][0] < end:
        yield base[k]
        k += 1


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of a corpus, from pair counts over all its texts."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _SIZE, _SIZE), np.int64)
        for b in by_size(batches, 0):
            ordinary, secret = [], []
            for t in b.column(0).drop_null().to_pylist():
                for start, _, end, value in sorted(base_matches(t), reverse=True):
                    secret.append(value)
                    t = t[:start] + " " * (end - start) + t[end:]
                ordinary.append(t)
            counts[0] += pair_counts(" ".join(secret).encode())
            counts[1] += pair_counts(" ".join(ordinary).encode("utf-8", "surrogatepass"))
        flat = counts.reshape(-1)
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["pair", "n"])

    total = np.zeros(2 * _SIZE * _SIZE, np.int64)
    for r in bounded(docs.select(text)).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        total[r["pair"]] = r["n"]
    return Model(tuple(total.reshape(2, _SIZE, _SIZE)))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """docs (columns keep, all by default) with spans: array of (kind, start, end) by start, then kind. model: of fit(); else the prior."""
    docs = without(docs, ["spans"])
    keep = docs.columns if keep is None else keep
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, at):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py(), model)] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(spans, _SPANS)], [*keep, "spans"])

    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)").alias("spans")
    return bounded(docs).mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in keep], empty).schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each stretch that spans cover replaced by mark; spans are by start and may overlap."""
    state = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        fresh = F.when((s["start"] >= a["at"]) & ((s["start"] > a["at"]) | (a["at"] == 0)), F.concat(a["done"], between, F.lit(mark))).otherwise(a["done"])
        return F.struct(fresh.alias("done"), F.greatest(a["at"], s["end"]).alias("at"))

    rest = lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, rest)).otherwise(text)
