"""Plain versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, width=5):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard_components(rows, percent=75):
    """{id: (set size, smallest id reachable)} of (id, text) rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_bytes(rows, length=200):
    """{id: (bytes, covered flags)} of (id, text) rows with distinct ids."""
    raw = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for b in raw.values():
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for i, b in raw.items():
        flags = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                flags[p:p + length] = b"\x01" * length
        out[i] = (b, flags)
    return out
