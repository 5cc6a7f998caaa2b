"""Brute-force versions that several tests share."""


def plain_runs(words, least):
    """(start, length, period) of all runs: stretches that repeat at a distance, for every distance in turn; the smallest period of a stretch counts."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        same = [words[i] == words[i + p] for i in range(n - p)] + [False]
        i = 0
        while i < n - p:
            j = same.index(False, i)
            if j - i >= p and j - i + p >= least:
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in out.items())


def plain_later_bytes(rows, length=100):
    """(bytes, removed, spans, kept) of each (doc_id, text): bytes covered by a string of length bytes that starts earlier too, by a set of all of them."""
    seen, want = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(data[s : s + length])
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        want[i] = (len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return want
