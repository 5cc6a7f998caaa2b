"""Prefix codes of symbols, with an escape for what would need a long code, and runs."""

from __future__ import annotations

import heapq
import re
from itertools import count

#: Fixed value: most bits of a code.
MOST_BITS = 16
#: Stands for every symbol that has no code of its own.
ESCAPE = -1


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    tie = count()
    heap = [(n, next(tie), [s]) for s, n in sorted(counts.items())]
    heapq.heapify(heap)
    size = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            size[s] += 1
        heapq.heappush(heap, (n + m, next(tie), a + b))
    return size


def scheme(counts: dict[int, int]) -> dict[int, str]:
    """symbol: code, '0' and '1', of the symbols that occur. Symbols whose code would be longer than MOST_BITS share ESCAPE, and so do all others."""
    size = _lengths({s: n for s, n in counts.items() if n})
    long = [s for s, n in size.items() if n > MOST_BITS]
    if long:
        size = _lengths({s: n for s, n in counts.items() if n and s not in long} | {ESCAPE: sum(counts[s] for s in long)})
        while max(size.values()) > MOST_BITS:  # the escape's own branch may have grown
            worst = max((s for s in size if s != ESCAPE), key=lambda s: size[s])
            long.append(worst)
            size = _lengths({s: n for s, n in counts.items() if n and s not in long} | {ESCAPE: sum(counts[s] for s in long)})
    code, last, out = 0, 0, {}
    for s in sorted(size, key=lambda s: (size[s], s)):
        code <<= size[s] - last
        last = size[s]
        out[s] = format(code, f"0{last}b")
        code += 1
    return out


def encode(symbols: list[int], codes: dict[int, str], wide: int = 8) -> bytes:
    """The symbols' codes, bit after bit from the top; an escaped symbol follows its escape in `wide` bits."""
    try:
        bits = "".join(map(codes.__getitem__, symbols))
    except KeyError:
        bits = "".join([codes[s] if s in codes else codes[ESCAPE] + format(s, f"0{wide}b") for s in symbols])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def decode(data: bytes, n: int, codes: dict[int, str], wide: int = 8) -> list[int]:
    """The n symbols of encode()."""
    if not n:
        return []
    of, bits = {c: s for s, c in codes.items() if s != ESCAPE}, format(int.from_bytes(data, "big"), f"0{8 * len(data)}b")
    found = re.findall("|".join(c if s != ESCAPE else f"{c}[01]{{{wide}}}" for s, c in codes.items()), bits)[:n]  # no code begins another
    if len(found) < n:
        raise ValueError(f"{len(found)} symbols, not {n}")
    if ESCAPE not in codes:
        return list(map(of.__getitem__, found))
    return [of[c] if c in of else int(c[-wide:], 2) for c in found]


def runs(symbols: list[int], char: int, most: int = 255) -> list[tuple[int, int]]:
    """(length, symbol) pairs: a run of char and the symbol behind it, -1 at the end; runs over most are cut, with char as the symbol behind."""
    out, length = [], 0
    for s in symbols:
        if s == char and length < most:
            length += 1
        else:
            out.append((length, s))
            length = 0
    return [*out, (length, -1)]


def unrun(pairs: list[tuple[int, int]], char: int) -> list[int]:
    return [x for n, s in pairs for x in ([char] * n + ([s] if s >= 0 else []))]
