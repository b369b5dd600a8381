"""The contracts written out plainly, on one machine."""
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def fingerprint(text):
    w = WORD.findall(lower_ascii(text or ""))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows, max_bits=2):
    """rows: (id, fp); the smallest id reachable for each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= max_bits:
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)].append(k)
    return [min(low[find(i)], default=None) for i in range(len(rows))]


BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32))


def base_secrets(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(BASE) for m in rx.finditer(text or "") if ok(m))
    joined = ",".join(f"{BASE[k][0]}:{a}:{e}" for a, k, e in spans)
    return [sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


def licence_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))
    at = [(i, lab) for p, lab in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
          for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def rule_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
