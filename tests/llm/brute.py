"""Plain versions of the contracts, on lists of (doc_id, text, ...)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def grouped(nodes, links):
    parent = {x: x for x in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in nodes}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def pii(text):
    t = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", t):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def peak_entropy(v, width=20):
    best = 0.0
    for i in range(len(v) - width + 1):
        best = max(best, -sum(c / width * np.log2(c / width) for c in Counter(v[i : i + width]).values()))
    return best


def random_looking(v):
    if not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)):
        return False
    if re.search(r"(?i)example|sample|placeholder|change_?me|your[_-]|0123456789|1234567890|abcdefghij|(.)\1{7}", v):
        return False
    runs = [x for x in re.findall("[0-9A-Fa-f]{20,}", v) if re.search("[0-9]", x) and re.search("[A-Za-z]", x)]
    return any(peak_entropy(x) >= 3.0 for x in runs) or peak_entropy(v) >= 3.75


def entropy_spans(text):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
        if random_looking(m[0]):
            out.append(m.span())
        else:
            out += [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer("[A-Za-z0-9+/_-]{20,}", m[0]) if "=" in m[0] and random_looking(x[0])]
    return out


def shingles(text, width):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near(docs, width, percent=80):
    sets = {d: shingles(t, width) for d, t in docs}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    common = Counter()
    for ids in index.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = grouped(sets, links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in sets}


def repeats(docs, width=20):
    first, out = {}, {}
    for d, t in sorted(docs):
        w = words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (d, i)) != (d, i):
                gone[i : i + width] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def vectors(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    counts, links = Counter(), []
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                counts[i] += 1
                counts[j] += 1
                links.append((i, j))
    comp = grouped([i for i, _ in rows], links)
    return {i: (counts[i], comp[i], comp[i] == i) for i, _ in rows}
