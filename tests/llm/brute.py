"""Plain versions of the operators, text by text, to compare with."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def gram_buckets(text, buckets):
    prime = 2**31 - 1
    hashed = [sum(ord(c) * pow(31, i % 64 + 1, prime) % prime for i, c in enumerate(w)) % prime for w in words(lower(text))]
    return [h % buckets for h in hashed] + [(a * 1000003 + b) % prime % buckets for a, b in zip(hashed, hashed[1:])]


def quality_scores(rows, good, buckets, smoothing):
    """doc texts and the set of good ids -> (n-grams, summed micro-nats) of each row."""
    raw, target = Counter(), Counter()
    for doc_id, text in rows:
        grams = gram_buckets(text, buckets)
        raw.update(grams)
        if doc_id in good:
            target.update(grams)
    all_raw, all_target = sum(raw.values()), sum(target.values())

    def weight(b):
        if not all_target:
            return 0
        return round(1e6 * math.log((target[b] + smoothing) / (all_target + smoothing * buckets) / ((raw[b] + smoothing) / (all_raw + smoothing * buckets))))

    return [(len(g), sum(map(weight, g))) for g in (gram_buckets(text, buckets) for _, text in rows)]


def crc(text):
    return zlib.crc32((text or "").encode())


def shingles(text, width=5):
    w = words(lower(text))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_components(rows):
    """[(doc_id, text)] -> {doc_id: (set size, component)}."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        near = Counter(j for x in s for j in holders.get(x, ()))
        for j, both in near.items():
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = find(sets[j][0]), find(sets[k][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(k)
    return {i: (len(s), find(i)) for i, s in sets}


BASE = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def base_secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))


def listed(spans, names=("assign", "access", "hex", "id", "secret", "endpoint")):
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def linked_secrets(text, reach=200):
    """Weak parts that are reported, by comparing all parts of the text."""
    from facetry.llm import secrets as S

    text = text or ""
    base = base_secrets(text)
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
    find = lambda p, k: [(m.start(), k, m.end()) for m in re.finditer(p, text)]
    ids = [s for s in find(S.WEAK_ID, 3) if not any(meets(s, b) for b in base)]
    urls = [s for s in find(S.ADDRESS, 5) if not any(meets(s, b) for b in base)]
    runs = [s for s in find(S.RUN, 4) if re.search("[0-9]", text[s[0]:s[2]]) and re.search("[A-Za-z]", text[s[0]:s[2]])]
    runs = [s for s in runs if not any(meets(s, b) for b in base + ids + urls)]
    breaks = [m.start() for m in re.finditer(S.BLANK_LINE, text)]
    scope = lambda s: sum(b < s[0] for b in breaks)
    near = lambda s, parts: any(scope(s) == scope(o) and o[0] <= s[2] + reach and s[0] <= o[2] + reach for o in parts)
    all_ids = [b for b in base if b[1] == 1] + ids
    all_secrets = [b for b in base if b[1] != 1] + runs
    return ([s for s in ids if near(s, all_secrets)] + [s for s in runs if near(s, all_ids)]
            + [s for s in urls if near(s, all_ids) and near(s, all_secrets)])


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(rows, items, window=10):
    """[(doc_id, text)], [(item_id, text)] -> (n_words, n_hit, items) of each row."""
    held = {}
    for item, text in items:
        w = ITEM_WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            held.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(k) for k in held}
    out = []
    for _, text in rows:
        w, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := held.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), sorted({str(x) for x in found if x is not None})))
    return out
