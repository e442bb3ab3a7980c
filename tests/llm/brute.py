"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib

from keepsift.llm.secrets import BASE, MORE

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return (text or "").translate(FOLD)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(folded(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[folded(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(folded(t))))
    return out


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def jaccard(rows, size=5):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [(i, len(s), None if i is None else find(i) if s else i) for i, s in sets]


def secret_spans(text):
    text = text or ""
    found = []
    for place, rule in enumerate([*BASE, *MORE]):
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), place, m.end(), rule.kind))
    return sorted(found)


def secrets(rows):
    out = []
    for i, t in rows:
        spans = secret_spans(t)
        listed = [f"{k}:{s}:{e}" for s, p, e, k in spans]
        base = [f"{k}:{s}:{e}" for s, p, e, k in spans if p < len(BASE)]
        counts = [sum(1 for x in spans if x[1] == p) for p in range(len(BASE))]
        out.append((i, *counts, sha(",".join(base)), ",".join(listed)))
    return out


def redacted(text, mask="[secret]"):
    out, at = [], 0
    for s, _, e, _ in secret_spans(text):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return text if not out else "".join(out) + text[at:]


def pieces(rows, tokenizer, length=1024, end=2):
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        first = len(ids) % length or length
        at, n = 0, 0
        while at < len(ids):
            size = first if n == 0 else length
            part = ids[at : at + size]
            out.append((i, n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
            at, n = at + size, n + 1
    return out
