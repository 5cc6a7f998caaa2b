"""Column functions on base strings, pulse widths, quality symbols and names."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which base stands for each letter a to z, by the letter's number modulo four.
LETTERS = "ACGTACGTACGTACGTACGTACGTAC"


def to_bases(text: Column) -> Column:
    """A text as bases: letters by their number modulo four, everything else dropped. A null is empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ascii_lowercase, LETTERS), "[^ACGT]", "")


def number_read(text: Column) -> Column:
    """Bases of either case as digits 0 to 3; any other character is 0."""
    return F.translate(F.regexp_replace(text, "[^ACGTacgt]", "A"), "ACGTacgt", "01230123")


def lower_read(digits: Column) -> Column:
    return F.translate(digits, "0123", "acgt")


def upper_read(digits: Column) -> Column:
    return F.translate(digits, "0123", "ACGT")


def change_case(bases: Column) -> Column:
    return F.translate(bases, "acgtACGT", "ACGTacgt")


def letter_arrow(digits: Column) -> Column:
    """Pulse widths 0 to 3 as '1' to '4'."""
    return F.translate(digits, "0123", "1234")


def number_arrow(letters: Column) -> Column:
    """Pulse letters '1' to '4' as 0 to 3; anything else is 3."""
    return F.translate(F.regexp_replace(letters, "[^1234]", "4"), "1234", "0123")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTacgt", "TGCAtgca"))


def kmer_code(kmer: Column) -> Column:
    """The 2-bit integer of a k-mer of at most 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def pack_bases(bases: Column) -> Column:
    """2-bit packing, four bases a byte, high bits first, the last byte padded with A."""
    padded = F.concat(F.translate(bases, "ACGT", "0123"), F.repeat(F.lit("0"), F.pmod(-F.length(bases), F.lit(4)).cast("int")))
    nibbles = F.transform(F.sequence(F.lit(1), F.length(padded), F.lit(2)), lambda i: F.conv(F.substring(padded, i, F.lit(2)), 4, 16))
    return F.when(F.length(bases) == 0, F.lit("")).otherwise(F.array_join(nibbles, ""))


def unpack_bases(packed: Column, n: Column) -> Column:
    """The first n bases of pack_bases()."""
    four = F.transform(F.sequence(F.lit(1), F.greatest(F.length(packed), F.lit(1)), F.lit(2)), lambda i: F.lpad(F.conv(F.substring(packed, i, F.lit(2)), 16, 4), 4, "0"))
    return F.when(n == 0, F.lit("")).otherwise(F.translate(F.substring(F.array_join(four, ""), F.lit(1), n.cast("int")), "0123", "ACGT"))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings, up to the end of the shorter."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x.isNotNull() & y.isNotNull() & (x != y)).cast("int")), F.lit(0), lambda s, x: s + x)


def snake(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    unlike = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~F.coalesce(x == y, F.lit(False)))
    at = F.array_position(unlike, True)
    return F.when(at > 0, at - 1).otherwise(F.least(F.length(a), F.length(b))).cast("long")


def rsnake(a: Column, b: Column) -> Column:
    """Length of the common suffix."""
    return snake(F.reverse(a), F.reverse(b))


def special_log(cover: Column) -> Column:
    """Coverage on the profile's scale: itself to 1, 40 from 10000 on, else ten times the decimal logarithm, rounded down."""
    return F.when(cover <= 1, cover).when(cover >= 10000, 40).otherwise(F.floor(F.log10(cover.cast("double")) * 10 + 1e-9)).cast("int")


def path_to(name: Column) -> Column:
    return F.when(F.instr(name, "/") > 0, F.regexp_extract(name, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def root(name: Column) -> Column:
    """What follows the last slash, up to its first dot."""
    return F.split_part(F.element_at(F.split(name, "/"), -1), F.lit("."), F.lit(1))


def root_without(name: Column, suffix: str) -> Column:
    """What follows the last slash, without suffix in either case if more stands before it."""
    last = F.element_at(F.split(name, "/"), -1)
    ends = (F.length(last) > len(suffix)) & F.endswith(F.lower(last), F.lit(suffix.lower()))
    return F.when(ends, F.left(last, F.length(last) - len(suffix))).otherwise(last)


def number_digits(x: Column) -> Column:
    """Decimal digits of a number; none for zero."""
    return F.when(x == 0, 0).otherwise(F.length(F.abs(x).cast("string"))).cast("int")
