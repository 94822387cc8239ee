"""Plain Python versions of the operators, one document at a time, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def lowest(ids, root):
    low = {}
    for i, r in zip(ids, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in root]


def ngram_components(rows):
    """[(id, text)] -> [(id, set size, component id)]."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of[x].append(i)
    near = {(i, j) for g in of.values() for i in g for j in g if i < j}
    links = [(i, j) for i, j in near if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    comp = lowest([r[0] for r in rows], roots(len(rows), links))
    return [(r[0], len(s), c if s else r[0]) for r, s, c in zip(rows, sets, comp)]


def mix(rows, weights=(1, 2, 3), times=3):
    """[(id, text, source)] -> [(id, size, source size, target, taken)]."""
    size = [len(words(t)) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(total.values()))
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > times * total[s]]
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = float(times * total[s])
            left -= target[s]
            open_.discard(s)
    key = [hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in rows]
    taken = [0] * len(rows)
    for s in order:
        rest = int(target[s] + 0.5)
        mine = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (key[i], size[i]))
        while rest > 0 and total[s]:
            for i in mine:
                k = min(rest, size[i])
                taken[i] += k
                rest -= k
    return [(r[0], n, total[r[2]], target[r[2]], t) for r, n, t in zip(rows, size, taken)]


def exact(rows):
    """[(id, text)] -> [(id, keep id, group size, text hash)]."""
    norm = [hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() for _, t in rows]
    groups = defaultdict(list)
    for (i, _), h in zip(rows, norm):
        groups[h].append(i)
    top = {h: max((i for i in g if i is not None), default=None) for h, g in groups.items()}
    return [(i, top[h], len(groups[h]), h) for (i, _), h in zip(rows, norm)]


def windows(rows, width=20):
    """[(id, text)], ids distinct -> [(id, words, removed, hash of what is kept)]."""
    at, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k:k + width])
            if x in at:
                gone[k:k + width] = [True] * width
            at.add(x)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def line_templates(rows, depth=3, min_texts=5, min_tokens=5):
    """[(id, text)] -> [(id, lines, dropped, kept text)]."""
    texts = {t for _, t in rows if t is not None}
    blank = re.compile(r"[\x20\x09-\x0D]+")
    lines = []
    for t in texts:
        for i, line in enumerate(t.split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", x) else x for x in blank.split(line) if x)
            if tokens:
                lines.append((t, i, tokens))
    seen = defaultdict(set)
    leaves = defaultdict(list)
    for t, i, tokens in lines:
        seen["line", tokens].add(t)
        if len(tokens) >= min_tokens:
            leaves[len(tokens), tokens[:depth]].append((t, i, tokens))
    general = {}
    for leaf, of in leaves.items():
        n_texts = len({t for t, _, _ in of})
        if n_texts < min_texts or len({x for _, _, x in of}) < 2:
            continue
        at = defaultdict(set)
        for t, _, tokens in of:
            for p, x in enumerate(tokens):
                at[p, x].add(t)
        for t, i, tokens in of:
            same = [2 * len(at[p, x]) > n_texts for p, x in enumerate(tokens)]
            if 2 * sum(same) >= len(tokens) and 2 * sum(same[depth:]) >= len(tokens) - depth:
                general[t, i] = ("leaf", leaf, tuple(x if s else "<*>" for x, s in zip(tokens, same)))
                seen[general[t, i]].add(t)
    gone = {(t, i) for t, i, tokens in lines if len(seen["line", tokens]) >= min_texts
            or (t, i) in general and len(seen[general[t, i]]) >= min_texts}
    out = []
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(parts) if (t, k) not in gone]
        out.append((i, len(parts), len(parts) - len(kept), None if t is None else "\n".join(kept)))
    return out


def ngrams(text):
    c = "".join(x if x.isalpha() else " " for x in (text or "").lower())
    grams = Counter()
    for w in c.split():
        w = f" {w} "
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                if (g := w[k:k + n]) != " ":
                    grams[g] += 1
    return grams


def _code(g):
    return sum(ord(x) << (21 * k) for k, x in enumerate(g))


def profile(grams, length=300):
    return sorted(grams, key=lambda g: (-grams[g], _code(g)))[:length]


def languages(train, texts, length=300):
    """[(text, lang)], [text] -> [(language, score)]."""
    per = defaultdict(Counter)
    for t, lang in train:
        if t is not None and lang is not None and ngrams(t):
            per[lang] += ngrams(t)
    ranks = {lang: {g: k for k, g in enumerate(profile(c, length))} for lang, c in sorted(per.items())}
    out = []
    for t in texts:
        mine = profile(ngrams(t), length)
        if not mine or not ranks:
            out.append(("und", 0.0))
            continue
        apart = {lang: sum(abs(k - r[g]) if g in r else length for k, g in enumerate(mine)) for lang, r in ranks.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out.append((best, 1 - apart[best] / (length * len(mine))))
    return out
