"""Sentences and characters by Unicode's rules, and words built from characters."""

import random

import pytest
import regex

from lodeseek import schema
from lodeseek.functions.text import SPACES
from lodeseek.operators import chunk, words

#: Texts cut at their sentence ends, after the rules' own examples.
SENTENCES = [
    ["3.4"], ["c.d"], ["C.d"], ["c.D"], ["C.D"], ["U.S.À. is"], ["etc.)’ ‘(the"], ["etc.)’ ", "‘(The"], ["(“Go.”) ", "(He did.)"], ["(“Go?”) ", "(He did.)"],
    ["U.S.À. ", "He"], ["Wait... what"], ["Is it? ", "No! ", "“Yes.” ", "Good"], ["one\n", "two\r\n", "three"], ["字.", "字"], ["etc.", "它"], ["etc.。"], ["字。", "它"],
    ["Mr. ", "Smith, e.g. a man."], ["He said 3.5. ", "Then 4."], ["a. 1b"], ["A. ", "1B"], ["x.́ ", "Y"], ["end.\n", "\n", "new"],
]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentence_ends(parts):
    text, ends, at = "".join(parts), [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
    found = [m.end() for m in chunk._SENTENCES.finditer(text)]
    assert [e for e in found if e < len(text)] == ends[:-1]


SIGNS = ["a", "b", "é", "ṇ̃", " ", " ́", "\n", "\r\n", ". ", "? ", "\U0001f468‍\U0001f469‍\U0001f467", "\U0001f1e9\U0001f1ea", "각", "क्षि", "字", "word", "ำ", "‍"]


def test_no_chunk_cuts_a_character():
    rng = random.Random(6)
    for _ in range(600):
        text = "".join(rng.choices(SIGNS, k=rng.randint(0, 60)))
        bounds = {0, *(m.end() for m in regex.finditer(r"\X", text))}
        for size, overlap in ((12, 0), (12, 5), (20, 8)):
            cuts = chunk.split_semantic(text, size, overlap)
            assert all(0 < b - a <= size for a, b in cuts)
            assert not cuts or (cuts[0][0] == 0 and cuts[-1][1] == len(text))
            assert all(p < c <= q and q - c <= overlap for (p, q), (c, _) in zip(cuts, cuts[1:], strict=False))
            longest = max((len(m[0]) for m in regex.finditer(r"\X", text)), default=0)
            if longest <= size:
                assert {x for cut in cuts for x in cut} <= bounds


def test_marks_longer_than_a_chunk():
    text = "a" + "́" * 100
    cuts = chunk.split_semantic(text, 12, 3)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= 12 for a, b in cuts)


def test_levels_are_found_when_asked_for():
    levels = chunk._Levels("one two. Three\n\nfour\nfive")
    assert [next(iter(levels))] == [[16]] and len(levels.later) == 4
    assert list(levels) == [[16], [16, 21], [9, 15, 16, 21], [4, 9, 16, 21], levels.known[4], list(range(1, 26))]


def plain_words(rows):
    """Character by character: text and (start, end, page, box) of each document."""
    out = {}
    for doc in sorted({r[0] for r in rows}):
        text, segments = "", []
        mine = [r for r in rows if r[0] == doc]
        for page, line in sorted({(r[1], r[2]) for r in mine}):
            word, boxes, start = "", [], 0

            def flush():
                nonlocal word, boxes
                if word:
                    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes) - min(b[0] for b in boxes), max(b[3] for b in boxes) - min(b[1] for b in boxes)) if boxes else None
                    segments.append((start, start + len(word.encode()), page, box))
                word, boxes = "", []

            for _, _, _, _, c, *box in sorted((r for r in mine if (r[1], r[2]) == (page, line)), key=lambda r: r[3]):
                if not c:
                    continue
                if c in SPACES:
                    flush()
                else:
                    if not word:
                        start = len(text.encode())
                    word += c
                    if box[2] > box[0] and box[3] > box[1]:
                        boxes.append(box)
                text += c
            flush()
            text += "\n"
        out[doc] = text, segments
    return out


def test_words_of_characters_as_by_definition(spark):
    rng = random.Random(2)
    rows = []
    for doc in ("a", "b", "c"):
        for page in (1, 2):
            for line in range(rng.randint(1, 4)):
                for at in range(rng.randint(1, 25)):
                    x, y = rng.randint(0, 9), rng.randint(0, 9)
                    rows.append((doc, page, line, at, rng.choice(["a", "é", "字", " ", "　", "\t", None, ".", "\U0001f600"]), float(x), float(y), float(x + rng.choice((0, 1, 3, -1))), float(y + rng.choice((0, 1, 2)))))
    rows.append(("empty", 1, 0, 0, None, 0.0, 0.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "path string, page int, line int, at int, char string, x1 double, y1 double, x2 double, y2 double").repartition(4)
    got = {r.path: r for r in words.documents_of_characters(df, ["path"]).collect()}
    want = plain_words(rows)
    assert set(got) == set(want)
    for doc, (text, segments) in want.items():
        r = got[doc]
        assert r.text == text and r.page_count == (2 if doc != "empty" else 1)
        assert [(s.start, s.end, s.origin.page, s.origin.bbox and (s.origin.bbox.x, s.origin.bbox.y, s.origin.bbox.width, s.origin.bbox.height)) for s in r.source_map] == segments
    assert words.documents_of_characters(df.limit(0), ["path"]).count() == 0
    assert df.limit(0).count() == 0 and schema.SEGMENT
