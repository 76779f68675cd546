"""Plain-Python versions of what the operators compute, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def shingles(text, width=5):
    w = WORDS.findall(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs, percent=85):
    """doc_id -> (n_shingles, component_id, kept)"""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((j, i))
    c = components(list(sets), links)
    return {i: (len(sets[i]), c[i], c[i] == i) for i in sets}


def contamination(docs, bench, width=10):
    """doc_id -> (n_words, n_hit, items)"""
    windows = defaultdict(set)
    for item, text in bench:
        w = BENCH_WORDS.findall(lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, text in docs:
        w, hit, items = BENCH_WORDS.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out[d] = (len(w), len(hit), sorted(items))
    return out


def repeated_bytes(docs, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept bytes)"""
    texts = {d: (t or "").encode() for d, t in docs}
    first = {}
    for d in sorted(texts):
        b = texts[d]
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))
    return out


BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]


def base_spans(text):
    """(start, number of the kind, kind, end), ordered"""
    found = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def spans_text(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
