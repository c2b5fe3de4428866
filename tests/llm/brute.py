"""Slow, plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def judge(url, rules, listed):
    """host, path, rule, verdict."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = ascii_lower(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    below = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in rules if below(r.text.split("/")[0]) and path.startswith(r.text[r.text.index("/") :])]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.verdict
    return host, path, None, "block" if any(below(x) for x in listed) else "allow"


def line_dedup(rows):
    """{doc_id: (n_lines, n_removed, text)} of rows with different ids; null ids come first."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not any(w):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = (len(lines), len(gone), None if text is None else text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[k : k + 3] for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, linked):
    """{key: least key of its group}, over all pairs."""
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(up)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in keys}


def near_groups(rows):
    """{(doc_id, text): (fingerprint, component_id)} for ids that aren't null."""
    prints = {r: fingerprint(r[1]) for r in rows}
    root = groups(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for (i, _), p in prints.items():
        least[root[p]].append(i)
    return {r: (f"{p:016x}", min(least[root[p]])) for r, p in prints.items()}


def weighted(words, n=5):
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else Counter([tuple(words)])


def contaminated(docs, items):
    """{(doc_id, item_id): best similarity}, by every window of every document."""
    found = {}
    for i, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for t, item in items:
            v = re.findall(r"\w+", (item or "").lower())
            if not v or not w:
                continue
            size, bag = min(len(v), len(w)), weighted(v)
            for at in range(len(w) - size + 1):
                win = weighted(w[at : at + size])
                both = sum((win & bag).values())
                s = both / (sum(win.values()) + sum(bag.values()) - both)
                if s >= 0.8:
                    found[i, t] = max(s, found.get((i, t), 0))
    return found


def repeated_bytes(texts, length=400):
    """For each text: (bytes, removed, spans, sha256 of the rest)."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


def passages(rows, length=51):
    """For each row (stretches, words) under length words that another row (by id and text) holds too."""
    split = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    where = defaultdict(set)
    for r, w in zip(rows, split, strict=True):
        for k in range(len(w) - length + 1):
            where[tuple(w[k : k + length])].add(r)
    out = []
    for w in split:
        on = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if len(where[tuple(w[k : k + length])]) > 1:
                on[k : k + length] = b"\x01" * length
        out.append((len(re.findall(b"\x01+", bytes(on))), sum(on)))
    return out


def mentions(text, kinds):
    """(start, end, kind, norm) of the mentions in a text, leftmost first; kinds: (name, pattern) in the order in which they are tried."""
    import regex

    every = regex.compile("|".join(f"(?P<k{n}>{p})" for n, (_, p) in enumerate(kinds)))
    out = []
    for m in every.finditer(text or ""):
        kind = kinds[int(m.lastgroup[1:])][0]
        digits = re.sub(r"\D", "", m[0])
        norm = {"phone": digits[-10:], "card": digits, "ssn": digits, "iban": m[0].replace(" ", ""), "email": m[0].lower()}.get(kind, m[0])
        out.append((*m.span(), kind, norm.lower() if kind == "secret" and re.fullmatch("[0-9A-F]+", norm) else norm))
    return out


def similar(rows, n=5):
    """The least doc_id of each group of texts at Jaccard similarity 0.8 of their sets of n words or more, over all pairs."""
    sets = {}
    for i, t in rows:
        w = ascii_lower(t or "").split()
        sets[i] = frozenset([tuple(w)] if len(w) < n else zip(*(w[k:] for k in range(n)), strict=False))
    root = groups(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return sorted(set(root.values()))


def indicators(text, bits):
    """The positions of quality's indicators, gram by gram."""
    b, out, small = (text or "").encode(), set(), 0xFFFFFFFF
    for k in range(len(b) - 2):
        out.add((int.from_bytes(b[k : k + 3], "big") * 2654435761 & small) >> 32 - bits)
    kind = lambda c: 5 if c > 127 else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if chr(c) in ".,;:" else 4
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", b) if w]
    shapes = [kind(w[0]) + 6 * kind(w[-1]) + 36 * min(len(w) // 4, 3) + 144 * (k > 0 and w == words[k - 1]) for k, w in enumerate(words)]
    for n in (1, 2, 3):
        for k in range(len(shapes) - n + 1):
            code = n
            for s in shapes[k : k + n]:
                code = (code * 289 + s) & small
            out.add((code * 2246822519 & small) >> 32 - bits)
    return sorted(out)
