"""Plain versions of operators, by definition, that tests compare with."""

import collections
import re
import unicodedata

import numpy as np

from lodeseek.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_votes(text):
    """Votes of the seven rules: 0 bad, 1 abstain, 2 good."""
    n, chars, symbols, dup, repeated = base_counts(text)
    text = text or ""
    lines = len([x for x in text.split("\n") if WORD.search(x)])
    upper, shouts = sum(unicodedata.category(c) == "Lu" for c in text), len(re.findall("[!?]", text))
    over = lambda x, bad, good: 0 if x > bad else 2 if x <= good else 1
    mean = chars / max(n, 1)
    return (
        0 if n < 20 else 2 if n >= 100 else 1, 0 if mean < 2.5 or mean > 12 else 2 if 4 <= mean <= 7 else 1, over(symbols / max(n, 1), 0.1, 0.0),
        over(repeated / max(n, 1), 0.4, 0.3), over(dup / max(lines, 1), 0.5, 0.35), over(upper / max(chars, 1), 0.3, 0.06), over(shouts / max(n, 1), 0.3, 0.02),
    )


def plain_em(texts):
    """EM document by document, in probabilities: of each document, the posterior of good and whether it is kept."""
    seen = {d: plain_votes(t) for d, t in texts.items()}
    rules, k = range(7), 8
    prior = [[quality.PRIOR_OF_GOOD] * 7] + [[quality.PRIOR_OF_OWN if r == j else quality.PRIOR_OF_OTHER for r in rules] for j in rules]
    first = [quality.PRIOR_SHARE] + [(1 - quality.PRIOR_SHARE) / 7] * 7
    share, table, strength = first, prior, max(1.0, quality.PRIOR_WEIGHT * len(seen))

    def posteriors(v):
        joint = [share[c] * np.prod([table[c][r][v[r]] for r in rules]) for c in range(k)]
        return np.array(joint) / sum(joint)

    alike = {}  # documents of the same votes move together
    for v in seen.values():
        alike[v] = alike.get(v, 0) + 1
    for _ in range(3000):
        each = {v: n * posteriors(v) for v, n in alike.items()}
        weight = strength * np.array(first) + sum(each.values())
        counts = strength * np.array(first)[:, None, None] * np.array(prior)
        for v, p in each.items():
            for r in rules:
                counts[:, r, v[r]] += p
        before, share, table = share, weight / weight.sum(), counts / counts.sum(axis=2, keepdims=True)
        if np.abs(share - np.array(before)).max() < 1e-12:
            break
    out = {}
    for d, t in texts.items():
        n, _, _, _, repeated = base_counts(t)
        p = posteriors(seen[d])[0]
        out[d] = p, bool(p >= 0.5 and n >= 50 and 100 * repeated <= 50 * n)
    return out


def plain_assign(lengths, size=1024):
    """By definition: the longest rest (ties: the first) goes to the sequence of lowest cost with room, or fills the cheapest with any."""
    count = -(-sum(lengths) // size)
    used, cost, todo, out = [0] * count, [0.0] * count, [(n, k, 0) for k, n in enumerate(lengths)], []
    while todo:
        n, k, start = todo.pop(todo.index(min(todo, key=lambda x: (-x[0], x[1], x[2]))))
        open_ = [s for s in range(count) if size - used[s] >= n] or [s for s in range(count) if used[s] < size]
        s = min(open_, key=lambda s: (cost[s], s))
        take = min(n, size - used[s])
        out.append((k, start, take, s, used[s]))
        used[s] += take
        cost[s] += take + take * take / 1024
        if take < n:
            todo.append((n - take, k, start + take))
    return out, count


def plain_alignment(template, words):
    """Unbanded alignment of a whole template with any stretch of words: (score, matched, begin, end), the best by score, matches, later start."""
    row = [(0, 0, j) for j in range(len(words) + 1)]
    for symbol in template:
        new = [(row[0][0] - 1, row[0][1], row[0][2])]
        for j, w in enumerate(words, 1):
            s, m, b = row[j - 1]
            options = [(s + (2 if w == symbol else -1), m + (w == symbol), b), (row[j][0] - 1, *row[j][1:]), (new[-1][0] - 1, *new[-1][1:])]
            new.append(max(options))
        row = new
    end = max(range(len(row)), key=lambda j: (row[j], -j))
    return (*row[end], end)


def plain_licenses(text, templates, coverage=0.8, within=0.8):
    """(license, matched, start, end): best alignments one after another, each on what the ones before it left."""
    words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "", re.ASCII)]
    lower = lambda w: w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [(lower(text[a:b]), a, b) for _, a, b in words]
    found = []
    for name, body in templates.items():
        t = [lower(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", body)]
        if len(set(t) & {w for w, _, _ in words}) < coverage * len(set(t)) * 0.9:
            continue  # too few of its words are there at all
        left = [w for w, _, _ in words]
        while True:
            _, matched, begin, end = plain_alignment(t, left)
            if matched < coverage * len(t):
                break
            found.append((name, matched, begin, end))
            left[begin:end] = [None] * (end - begin)
    size = lambda p: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", templates[p[0]]))
    inner = lambda p, q: q[0] != p[0] and (q[1] > p[1] or q[1] == p[1] and size(q) < size(p)) and min(q[3], p[3]) - max(q[2], p[2]) >= within * (p[3] - p[2])
    kept = []
    for p in sorted(found, key=lambda p: (-p[1], size(p), p[2], p[0])):
        if not any(inner(p, q) for q in kept):
            kept.append(p)
    return {(n, m, words[a][1], words[b - 1][2]) for n, m, a, b in kept}


def plain_secrets(text, model):
    """Spans (start, kind, end): patterns one by one, and runs by the best segment, then the best on either side of it, and so on."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = {x for a, _, b in found for x in range(a, b)}
    for ordinary in (r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])", r";base64,[A-Za-z0-9+/_=-]+"):
        base |= {x for m in re.finditer(ordinary, text) for x in range(*m.span())}
    good = lambda s: len(s) >= 20 and any(c.isalpha() for c in s) and sum(sorted(s.count(c) for c in set(s))[-5:]) <= 0.75 * len(s) and sum(model.table[s[k : k + 2]] for k in range(len(s) - 1)) / (len(s) - 1) > model.threshold
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        pieces, at = [], m.start()
        for x in range(m.start(), m.end() + 1):
            if x == m.end() or x in base:
                pieces.append((at, x))
                at = x + 1
        for lo, hi in pieces:
            s = text[lo:hi]
            if good(s):
                found.append((lo, 3, hi))
                continue
            if len(s) < 20:
                continue
            scores = [model.table[s[k : k + 2]] - model.threshold for k in range(len(s) - 1)]
            segments = []

            def split(a, b):
                options = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]  # noqa: B023
                if options and max(options)[0] > 0:
                    _, _, _, i, j = max(options)
                    split(a, i)
                    segments.append((i, j))  # noqa: B023
                    split(j, b)

            split(0, len(scores))
            end = 0
            for i, j in segments:
                first, last = i + (s[i] in "/-_="), j + (s[j] not in "/-_=")
                start = max(s.rfind(c, 0, first) for c in "/-_=") + 1
                stop = min([s.find(c, last) for c in "/-_=" if s.find(c, last) >= 0] or [len(s)])
                if start < end:
                    continue
                if good(s[start:stop]):
                    found.append((lo + start, 3, lo + stop))
                    end = stop
    return sorted(found)
