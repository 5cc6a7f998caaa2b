"""A quality entry's five lines packed by prefix codes, and the codes that a block of entries asks for."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from readloom.functions.huffman import decode, encode, runs, scheme, unrun

#: The lines of an entry, in order: deletion values and tags, insertion, merge and substitution values.
LINES = ("del", "tag", "ins", "mrg", "sub")
#: Symbols by their code, for each stream and for the lengths of runs.
Codes = dict[str, dict[int, str]]
_LETTERS = "acgt"
_BITS = {"a": "00", "c": "01", "g": "10", "t": "11"}


class Packed(NamedTuple):
    """The lines' length, the runs among deletion values (0: none were sought), and the streams."""

    n: int
    pairs: int
    runs: bytes
    dele: bytes
    tag: bytes
    ins: bytes
    mrg: bytes
    sub: bytes


def run_symbol(entries: Sequence[Sequence[str]]) -> int | None:
    """The deletion value that stands wherever a tag says none, and nowhere else; None if there is no such value, or a tag is none of a, c, g, t, n."""
    none, told, letters = set(), set(), set()
    for dele, tag, *_ in entries:
        for d, t in zip(dele, tag, strict=True):
            (none if t == "n" else told).add(d)
        letters.update(tag)
    return ord(min(none)) if len(none) == 1 and not none & told and letters <= {*_LETTERS, "n"} else None


def block_codes(entries: Sequence[Sequence[str]]) -> tuple[Codes, int | None]:
    """Codes made from these entries (five lines each) alone, and their run symbol."""
    char = run_symbol(entries)
    counts: dict[str, Counter] = {c: Counter() for c in ("del", "ins", "mrg", "sub", "runs")}
    for dele, _, *others in entries:
        for name, line in zip(("ins", "mrg", "sub"), others, strict=True):
            counts[name].update(line.encode())
        pairs = [(0, s) for s in [*dele.encode(), -1]] if char is None else runs(list(dele.encode()), char)
        counts["del"].update(s for _, s in pairs[:-1])
        counts["runs"].update(n for n, _ in pairs)
    return {c: scheme(n) for c, n in counts.items()}, char


def pack_entry(lines: Sequence[Sequence[int]], tag: str, codes: Codes, char: int | None) -> Packed:
    """lines: the values of deletions, insertions, merges and substitutions. With a run symbol, tags go in two bits and only where the deletion value is
    another; without one they stay as they are."""
    dele, *others = lines
    rest = [encode(list(v), codes[c]) for c, v in zip(("ins", "mrg", "sub"), others, strict=True)]
    if char is None:
        return Packed(len(dele), 0, b"", encode(list(dele), codes["del"]), tag.encode(), *rest)
    pairs = runs(list(dele), char)
    bits = "".join([_BITS[t] for t, d in zip(tag, dele, strict=True) if d != char])
    tags = int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")
    return Packed(len(dele), len(pairs), encode([n for n, _ in pairs], codes["runs"], 16), encode([s for _, s in pairs[:-1]], codes["del"]), tags, *rest)


def unpack_entry(p: Packed, codes: Codes, char: int | None) -> list[str]:
    """The five lines of pack_entry(); with a run symbol, tags are n where there is none."""
    rest = [bytes(decode(data, p.n, codes[c])).decode() for c, data in (("ins", p.ins), ("mrg", p.mrg), ("sub", p.sub))]
    if char is None:
        return [bytes(decode(p.dele, p.n, codes["del"])).decode(), p.tag.decode(), *rest]
    symbols = [*decode(p.dele, p.pairs - 1, codes["del"]), -1]
    values = unrun(list(zip(decode(p.runs, p.pairs, codes["runs"], 16), symbols, strict=True)), char)
    bits = format(int.from_bytes(p.tag, "big"), "b")[1:]
    tags = iter(_LETTERS[int(bits[i : i + 2], 2)] for i in range(0, len(bits), 2))
    return [bytes(values).decode(), "".join("n" if v == char else next(tags) for v in values), *rest]
