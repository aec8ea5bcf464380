"""Plain Python versions of what the queries return."""

import numpy as np
import hashlib
import re
from collections import Counter

SEP = re.compile(r"[\x20\x09-\x0D]+")


def _digest(spans, kinds):
    spans = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    n = Counter(s[0] for s in spans)
    return n["assign"], n["access"], n["hex"], _digest(spans, ["assign", "access", "hex"])


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    text = text or ""
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    n = Counter(s[0] for s in spans)
    return n["email"], n["ip"], n["card"], n["phone"], _digest(spans, ["email", "ip", "card", "phone"])


def rules(text):
    text = text or ""
    words = [w for w in SEP.split(text) if w]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SEP.sub("", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def substring_cover(docs, length):
    """{doc_id: removed flags}: bytes under a string of length bytes that starts in a document of a smaller id."""
    least = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in docs:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                cover[i : i + length] = b"\1" * length
        out.append((d, bytes(cover)))
    return out


def similarity(a, b):
    """Multiset Jaccard of (sorted shingles, times)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0
