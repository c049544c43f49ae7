"""Plain single-process versions of the corpus operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = {65 + i: 97 + i for i in range(26)}


def roots(nodes, links):
    """Smallest node reachable, for every node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeats(docs, span=50):
    """(doc_id, text) rows: what op1 returns."""
    least: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            if i < least.get(w, 1 << 63):
                least[w] = i
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if least[b[p : p + span]] < i:
                gone[p : p + span] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((edge > 0).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def encoded(docs, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def records(docs, path):
    at, out = 0, []
    for i, ids in sorted(encoded(docs, path), key=lambda x: x[0]):
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def pieces(docs, path, capacity=2048):
    out = []
    for i, ids in encoded(docs, path):
        n = -(-len(ids) // capacity)
        head = len(ids) - (n - 1) * capacity
        cuts = [0, *(head + k * capacity for k in range(n))]
        out += [(i, k, cuts[k], cuts[k + 1] - cuts[k], crc(ids[cuts[k] : cuts[k + 1]])) for k in range(n)]
    return sorted(out)


def best_fit_bins(lengths, capacity=2048):
    """Number of sequences by best fit, longest first."""
    rest: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(rest) if r >= n]
        if fit:
            rest[min(fit)[1]] -= n
        else:
            rest.append(capacity - n)
    return len(rest)


def contamination(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    keys: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        m = min(window, len(w))
        for p in range(len(w) - m + 1) if m else ():
            keys[tuple(w[p : p + m])].add(i)
    sizes = {len(k) for k in keys}
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if got := keys.get(tuple(w[p : p + m])):
                    hit |= set(range(p, p + m))
                    found |= got
        said = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(said.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def line_form(s):
    return s.strip(" ").lower()


def one_edit(a, b):
    """Whether two word lists are at most one word changed, inserted or left out apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def lines(docs, least=5, near=12):
    """(doc_id, n_lines, n_removed, text) for distinct doc_ids."""
    first: dict[str, tuple] = {}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for i, t in order:
        for k, x in enumerate(t.split("\n")) if t is not None else ():
            f = line_form(x)
            if len(re.split(" +", f)) >= least and f not in first:
                first[f] = (i, k)
    forms = sorted(first, key=lambda f: (first[f][0] is None, first[f]))
    gone, by = set(), defaultdict(list)
    for f in forms:
        w = re.split(" +", f)
        if len(w) < near:
            continue
        for key in ((0, *w[:6]), (1, *w[-6:])):
            if f not in gone and any(one_edit(w, v) for v in by[key]):
                gone.add(f)
        for key in ((0, *w[:6]), (1, *w[-6:])):
            by[key].append(w)
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        all_lines, stay = t.split("\n"), []
        for k, x in enumerate(all_lines):
            f = line_form(x)
            if len(re.split(" +", f)) < least or (first[f] == (i, k) and f not in gone):
                stay.append(x)
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return out


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(docs, k=4):
    sets = {i: shingle_set(t, k) for i, t in docs}
    same: dict[frozenset, list] = defaultdict(list)
    for i, s in sets.items():
        if s:
            same[s].append(i)
    classes = list(same)
    posts = defaultdict(list)
    for c, s in enumerate(classes):
        for x in s:
            posts[x].append(c)
    both = Counter()
    for c, s in enumerate(classes):
        mine = Counter(d for x in s for d in posts[x] if d < c)
        for d, n in mine.items():
            if 100 * n >= 80 * (len(s) + len(classes[d]) - n):
                both[c, d] = n
    links = [(same[classes[c]][0], same[classes[d]][0]) for c, d in both] + [(g[0], x) for g in same.values() for x in g]
    root = roots(sets, links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets.items())


def cosine_links(rows, least=0.9):
    """{vec_id: n_links}, links, for distinct vec_ids."""
    ok = [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None and all(x is not None for x in v)]
    ok = [(i, v) for i, v in ok if len(v) and np.isfinite(v).all() and v.any()]
    width = max((len(v) for _, v in ok), default=0)
    x = np.stack([np.pad(v, (0, width - len(v))) for _, v in ok]) if ok else np.zeros((0, 1))
    x = x / np.linalg.norm(x, axis=1)[:, None] if ok else x
    ids = [i for i, _ in ok]
    n, links = dict.fromkeys((i for i, _ in rows), 0), set()
    for a in range(0, len(ids), 2000):
        for i, j in zip(*np.nonzero(x[a : a + 2000] @ x.T >= least), strict=True):
            if i + a < j:
                n[ids[i + a]] += 1
                n[ids[j]] += 1
                links.add((ids[i + a], ids[j]))
    return n, links


def secrets(docs):
    pats = [
        ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    out = []
    for i, t in docs:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, fine) in enumerate(pats) for m in p.finditer(t or "") if fine(m))
        said = ",".join(f"{pats[k][0]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in spans)
        out.append((i, n[0], n[1], n[2], hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out)


def log_weights(docs, labels):
    """Log weight of every doc_id (of distinct ones), and the ratio of every bucket, by plain counting."""
    import xxhash

    from graphloom.llm import _text, quality

    whole = (1 << 64) - 1
    base, code = int(_text.BASE), [int(x) for x in _text.BYTE_CODE]

    def buckets(text):
        data = (text or "").encode()
        for p in range(len(data) - quality.GRAM + 1):
            h = sum(code[b] * pow(base, j, 1 << 64) for j, b in enumerate(data[p : p + quality.GRAM])) & whole
            h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & whole
            h = ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & whole
            yield ((h ^ (h >> 33)) >> 20) % quality.BUCKETS

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def part(i):
        first = xxhash.xxh64_intdigest((5).to_bytes(4, "little"), 42)
        return signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), first)) % 4

    target_ids = {i for i, q, t in labels if q == 1 and t == 0 and part(i) > 1}
    raw, target = Counter(), Counter()
    for i, t in docs:
        for b in buckets(t):
            raw[b] += 1
            target[b] += i in target_ids
    r, t = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for b, n in raw.items():
        r[b], t[b] = n, target[b]
    ratio = np.log((t + quality.PRIOR) / (r * (t.sum() / max(1.0, r.sum())) + quality.PRIOR))
    return {i: sum(ratio[b] for b in buckets(t)) for i, t in docs}, ratio


def gumbel(ids, seed=11):
    import xxhash

    first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    out = []
    for i in ids:
        h = first if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), first)
        out.append(-np.log(-np.log(((h & ((1 << 52) - 1)) + 0.5) / (1 << 52))))
    return out
