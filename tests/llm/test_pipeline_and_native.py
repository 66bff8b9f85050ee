"""The pipeline stage by stage, URL filters, chat formatting, and the contracts of all queries."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from plain import base_counts, plain_em, plain_secrets
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodeseek.llm import chat, queries, url_filter

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}


def brute_near_dedup(texts):
    """The smallest id of each group that Jaccard similarities of 0.8 or more over 5-word shingles connect."""
    sets, label = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}
    with_shingle = collections.defaultdict(set)
    for d, x in sets.items():
        for g in x:
            with_shingle[g].add(d)
    near = {(a, b) for a, x in sets.items() for g in x for b in with_shingle[g] if a < b}
    near = [(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {d for d, k in label.items() if d == k}


def brute_leaks(text, items):
    """item ids and removal spans, window by window."""
    words = [(m[0].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    found, hit = set(), set()
    for item, body in items:
        x = [m.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", body or "")]
        windows = {tuple(x[k : k + 8]) for k in range(max(1, len(x) - 7))} - {()}
        for k in range(len(words)):
            for n in {len(w) for w in windows}:
                if tuple(w[0] for w in words[k : k + n]) in windows:
                    found.add(item)
                    hit.update(range(k, k + n))
    spans = []
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1][1] = words[k][2]
        else:
            spans.append([words[k][1], words[k][2]])
    return found, spans


def written(n, seed):
    """Prose of n words that no rule minds."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 8))) for _ in range(3000)]
    return " ".join(rng.choice(words).capitalize() if k % 12 == 0 else rng.choice(words) + ("." if k % 12 == 11 else "") for k in range(n))


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version, on its own input: the documents and odd rows, with columns that clash."""
    from lodeseek.llm import quality, secret_scan

    sf = "/root/testdata/sf0.001"
    odd = [(9_000_001, None), (9_000_002, ""), (9_000_003, " \n "), (9_000_006, written(60_000, 1))]
    good = written(150, 2)
    odd += [(9_000_004, good), (9_000_004, good), (9_000_005, good + " Zk9xQw3rTy7uIo1pAs5dFg8h and password = hunter2hunter2")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(d, t, None, None, None) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long"))
    clash = ("spans", "row", "new", "kept", "vote_length", "__sid", "__keys", "sid", "id", "n", "item_ids", "ids")
    docs = docs.withColumns({c: F.lit(f"mine {c}") for c in clash})
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        texts = {r.doc_id: r.text for r in before.collect()}
        stage(spark, before, sf).write.parquet(str(tmp_path / f"stage-{k}"))
        after = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        rows = after.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= set(texts) and ids
        if k < 4:
            assert after.columns == columns and all(r[c] == f"mine {c}" for r in rows for c in clash)
        if k == 0:
            kept = plain_em({(n, d): t for n, (d, t) in enumerate((r.doc_id, r.text) for r in before.collect())})
            assert sorted(r.doc_id for r in rows) == sorted(d for (_, d), (_, keep) in kept.items() if keep)
            assert {9_000_004, 9_000_006} <= ids and not ids & {9_000_001, 9_000_002, 9_000_003} and after.where("doc_id = 9000004").count() == 2
            assert base_counts(good)[0] >= 50 and quality.RULES
        elif k == 1:
            assert ids == brute_near_dedup(texts) and len(rows) == len(ids)
        elif k == 2:
            found = {d: brute_leaks(t, items) for d, t in texts.items() if d != 9_000_006}
            assert ids - {9_000_006} == {d for d, (x, _) in found.items() if len(x) < 2}
            for r in rows:
                text, at, out = texts[r.doc_id], 0, ""
                for a, b in found.get(r.doc_id, ((), ()))[1]:
                    out, at = out + text[at:a], b
                assert r.text == out + text[at:] and (r.n_chars == len(r.text) or r.text == text)
        elif k == 3:
            assert ids == set(texts)
            model = secret_scan.fit(before)
            for r in rows:
                text, at, out = texts[r.doc_id], 0, ""
                covered = {x for a, _, b in plain_secrets(text, model) for x in range(a, b)}
                begins = {a for a, _, _ in plain_secrets(text, model)}
                for a in sorted(x for x in covered if x - 1 not in covered or x in begins and not any(s < x < e for s, _, e in plain_secrets(text, model))):
                    out, at = out + text[at:a] + "[SECRET]", next(x for x in range(a, len(text) + 2) if x not in covered or x > a and x in begins and not any(s < x < e for s, _, e in plain_secrets(text, model)))
                assert r.text == out + text[at:]
                assert [s for s in secret_scan.scan(r.text, model) if s[1] < 3] == []
            assert 9_000_005 not in ids or "hunter2" not in next(r.text for r in rows if r.doc_id == 9_000_005)
        else:
            assert ids == set(texts)
            whole = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
            pieces, room = {}, {}
            for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
                got = pieces.setdefault(r.doc_id, [])
                assert r.start == len(got) and r.length == len(r.ids) // 4
                got += np.frombuffer(r.ids, "<u4").tolist()
                room.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for d, text in texts.items():
                assert pieces[d] == [*whole.encode(text, add_special_tokens=False).ids, 0]
            for places in room.values():  # gapless from 0, 1024 at most
                ends = [0, *(a + n for a, n in sorted(places))]
                assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
        docs = after
        assert name


def test_stages_of_no_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"empty-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"empty-{k}"))
        assert docs.count() == 0


def test_stages_called_lazily(spark):
    """A stage whose input is not written yet still finds what the one before it has left."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() > 0


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7x?q#f", "a://b://com/en/", "x://é.Net/de/8", "x://example.net/de/8#", "x://badexample.com/en/7"]
    urls += ["x://com/en/", "x://.com/en/", "x://a..com/en/?", "x://example.com:80/en/1", "x://org?/es/", "x://ORG/es/\n1", "x://a.example.com/en/", "x://" + "a." * 5000 + "org/es/" + "y" * 5000]
    rows = [(k, u, "old") for k, u in enumerate(urls * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, Verdict string")
    got = url_filter.filter_urls(df)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = {r.page_id: tuple(r)[2:] for r in got.collect()}
    assert found == {k: brute(u) for k, u, _ in rows}
    assert url_filter.filter_urls(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}
    both = [("com", "/en/", "allow"), ("com", "/en/", "block")]
    assert {r.verdict for r in url_filter.filter_urls(df.where("url = 'x://com/en/'"), both).collect()} == {"block"}
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, [("", "/", "block")])


def test_many_rules_of_many_shapes(spark):
    """Rules as a table, of all depths and lengths, against every rule tried on every url; the plan does not grow with them."""
    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "org", "É.net", "net"]
    some = lambda n: "".join("/" + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(n))
    rules = [(rng.choice(hosts), rng.choice(["", some(1), some(2), some(3), some(1) + "/"]), rng.choice(["allow", "block"])) for _ in range(3000)]
    urls = [f"h://{rng.choice(['', 'www.', 'b.', 'A.'])}{rng.choice(hosts)}{rng.choice([some(1), some(2), some(4), '', '/'])}{rng.choice(['', '?q', '#x'])}" for _ in range(800)]
    lowered = {}
    for h, p, v in rules:
        h = "".join(c.lower() if c.isascii() else c for c in h)
        lowered[h + p] = (h, p, "block" if v == "block" or lowered.get(h + p, ("", "", ""))[2] == "block" else v)
    def judge(u):
        host, _, rest = "".join(c.lower() if c.isascii() else c for c in u.split("://")[1].split("/")[0].split("?")[0].split("#")[0]), "", u.split("://")[1]
        path = rest[len(host):].split("?")[0].split("#")[0]
        fits = [(len(k), v == "block", k, v) for k, (h, p, v) in lowered.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for given in (rules, table):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, given).collect()}
        assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert sum(r is not None for r, _ in got.values()) > 300
    size = lambda given: len(url_filter.filter_urls(pages, given)._jdf.queryExecution().optimizedPlan().toString())
    assert size(table) < 8000 > size(rules)  # 3000 rules of hundreds of shapes
    for bad in (("a.com", "no-slash", "block"), (None, "/", "block"), ("a", "/", "maybe")):
        with pytest.raises(ValueError):
            url_filter.filter_urls(pages, [bad])


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>\\<s>", "<<SYS>>x<</SYS>>", "<<s>SYS>>", "[INST", "$1 \\1", "", None, "\n<role>x</turn>\n", "é\U0001f600</s>", "<s><s></s></s>[[INST]]"]
    rows = [(c, k, role, t) for c, role in enumerate(("user", "assistant", "system", "tool</role>", None)) for k, t in enumerate(nasty)]
    rows += [(None, 0, "user", "hi"), (7, None, "user", "first"), (7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a")]
    rows += [(8, 0, "system", "s"), (8, 1, "user", "q"), (8, 2, "assistant", "a"), (9, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit("mine"))
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_formatted(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), role or "", text or "") for x, t, role, text in rows if x == c)
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert got[c].loss_text == "".join(x[2] for x in turns if x[1] == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
    assert {c for c, r in got.items() if r.valid} == {8}
    assert "<\\/s>[\\INST] ok [\\/INST]" in got[0].formatted
    assert chat.format_conversations(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chat.Template(other=("<s>x", "b>", "c>"))


def plain_machine(order, start, ends, roles):
    """States, and whether all moves are in order and the end is one."""
    states, good = [start], True
    for r in roles:
        if r in order.get(states[-1], {}):
            states.append(order[states[-1]][r])
        else:
            good = False
            states.append(next((row[r] for row in order.values() if r in row), states[-1]))
    return states, good and states[-1] in ends


def test_chat_machine(spark):
    """States and segments of turns in any order, against a plain machine; the states are part of the query's plan."""
    rng, t = random.Random(6), chat.Template()
    lines = {c: [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(rng.randint(1, 6))] for c in range(300)}
    rows = [(c, k, role, f"text {k}") for c, roles in lines.items() for k, role in enumerate(roles)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in made.collect():
        states, good = plain_machine(t.order, t.start, t.ends, lines[r.conv_id])
        assert (r.states, r.valid) == (states, good)
        parts = []
        for k, role in enumerate(lines[r.conv_id]):
            before, after, loss = t.roles.get(role, (f"<role>{role}</role>", "</turn>", False))
            parts += [(before, False), (f"text {k}", loss), (after, False)]
        assert [tuple(s) for s in r.segments] == parts
    assert {r.valid for r in made.collect()} == {True, False}
    plan = queries.op6_chat_format(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and all(code in plan for code in chat.transitions(t))


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.op6_chat_format(spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (rows[-1].n_turns, rows[-1].loss_chars) == (2, len(text))
