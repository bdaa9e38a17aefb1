"""Plain versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def letter_words(text):
    return LETTERS.findall((text or "").translate(LOWER))


def solid_words(text):
    return SOLID.findall(text or "")


def contamination(docs, items):
    """docs, items: (id, text) lists. Rows (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    of = defaultdict(set)
    for item, text in items:
        w = letter_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            of[tuple(w[i : i + 10])].add(item)
    lengths = sorted({len(k) for k in of})
    out = []
    for doc, text in docs:
        w, hit, found = letter_words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (key := tuple(w[i : i + k])) in of:
                    hit.update(range(i, i + k))
                    found |= of[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, span=13):
    first = {}
    for doc, text in docs:
        w = solid_words(text)
        for i in range(len(w) - span + 1 if doc is not None else 0):
            key = tuple(w[i : i + span])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in docs:
        w, gone = solid_words(text), set()
        for i in range(len(w) - span + 1 if doc is not None else 0):
            if first[tuple(w[i : i + span])] < doc:
                gone.update(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k):
    w = solid_words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def similar_components(docs, k, threshold):
    """Rows (doc_id, n_shingles, component_id), by all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for held in holders.values():
        for n, a in enumerate(held):
            for b in held[n + 1 :]:
                shared[a, b] += 1
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= round(100 * threshold) * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(docs)]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_places(text):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w, at, labels = letter_words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = solid_words(text)
    lines = [x for x in text.split("\n") if solid_words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed)


RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def url_parts(url):
    """(host, path, rule, the rule's verdict)."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fits:
        return host, path, None, None
    best = max(fits, key=lambda r: len(r[1] + r[2]))
    return host, path, best[1] + best[2], best[0]


def captures(pages):
    """pages: (page_id, html). Rows (page_id, bytes, digest, type, refers_to)."""
    import base64

    first = {}
    rows = []
    for page, html in pages:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        rows.append((page, len(raw), digest))
        if page is not None:
            first[digest] = min(page, first.get(digest, page))
    out = []
    for page, size, digest in rows:
        again = page is not None and first[digest] < page
        out.append((page, size, digest, "revisit" if again else "response", first[digest] if again else None))
    return out


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes: {source: words}. {source: target}, by sharing out again what is cut off."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        per = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += per * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target
