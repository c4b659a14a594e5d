"""Plain restatements of what the operators promise, for small inputs."""

from __future__ import annotations

from collections import Counter, defaultdict


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in lower(text).split(" ") if w]


def shingle_set(text: str | None) -> set:
    w = words(text or "")
    if not w:
        return set()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs: dict, percent: int = 85) -> dict:
    sets = {i: shingle_set(t) for i, t in docs.items()}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    met = Counter()
    for ids in having.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                met[a, b] += 1
    links = [(a, b) for (a, b), n in met.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = components(docs, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in docs}


def repeated_bytes(texts: dict, length: int = 200) -> dict:
    """id -> (bytes, removed, spans, what is kept)."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(r[k : k + length] for r in raw.values() for k in range(len(r) - length + 1))
    out = {}
    for i, r in raw.items():
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(r), sum(gone), spans, bytes(c for c, g in zip(r, gone) if not g))
    return out


def later_runs(texts: dict, min_lines: int, min_words: int) -> dict:
    """id -> text without the longest runs that stand earlier too, if they have the lines or the words."""
    said = {i: t.split("\n") for i, t in sorted(texts.items())}
    places = [(i, k) for i, s in said.items() for k in range(len(s))]
    gone = set()
    for n, (i, k) in enumerate(places):
        longest = 0
        for j, m in places[:n]:
            length = 0
            while max(k + length - len(said[i]), m + length - len(said[j])) < 0 and said[i][k + length] == said[j][m + length]:
                length += 1
            longest = max(longest, length)
        if longest >= min_lines or longest and sum(len(x.split()) for x in said[i][k : k + longest]) >= min_words:
            gone |= {(i, k + x) for x in range(longest)}
    return {i: "\n".join(x for k, x in enumerate(s) if (i, k) not in gone) for i, s in said.items()}
