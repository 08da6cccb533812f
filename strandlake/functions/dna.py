"""Column helpers on DNA strings. Everything here stays inside the JVM.

Coordinates are zero-based and half-open; Spark's ``substring`` is one-based,
hence the ``+ 1`` in the helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC DNA alphabet, its complement and the bases of each code.
IUPAC = "ACGTRYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBN"
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_dna(s: ColumnOrName) -> Column:
    """Upper-case IUPAC DNA, or null when empty or holding another symbol."""
    upper = F.upper(_col(s))
    return F.when(upper.rlike(f"^[{IUPAC}]+$"), upper)


def complement_3to5(s: ColumnOrName) -> Column:
    """Base-by-base IUPAC complement, not reversed."""
    return F.translate(_col(s), IUPAC, IUPAC_COMPLEMENT)


def revcomp_iupac(s: ColumnOrName) -> Column:
    return F.reverse(complement_3to5(s))


def revcomp(s: ColumnOrName) -> Column:
    """Reverse complement of an ACGT string; null when another symbol occurs."""
    s = _col(s)
    return F.when(s.rlike("^[ACGT]*$"), F.reverse(F.translate(s, "ACGT", "TGCA")))


def canonical_dna(s: ColumnOrName) -> Column:
    """Strand-independent key: the smaller of a sequence and its reverse complement."""
    s = _col(s)
    other = revcomp(s)
    return F.when(other < s, other).otherwise(F.when(other.isNotNull(), s))


def iupac_regex(motif: str) -> str:
    """Regular expression matching the concrete sequences of an IUPAC motif."""
    return "".join(
        b if len(IUPAC_BASES[b]) == 1 else f"[{IUPAC_BASES[b]}]" for b in motif
    )


def revcomp_text(motif: str) -> str:
    """Reverse complement of a short driver-side literal (a motif, not data)."""
    return motif.translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT))[::-1]


def first_non_acgt(s: ColumnOrName) -> Column:
    """Zero-based position of the first symbol outside ACGT, null when none."""
    at = F.regexp_instr(_col(s), F.lit("[^ACGT]"))
    return F.when(at > 0, at - 1)


def circular_slice(s, start, length, topology) -> Column:
    """Bases of ``[start, start + length)``, wrapping on circles; null out of bounds.

    For single short records; sets of spans go through ``operators.spans``.
    """
    s, start, length, topology = map(_col, (s, start, length, topology))
    n = F.length(s)
    inside = (start >= 0) & (start < n) & (length > 0) & (length <= n)
    wrapped = F.substring(F.concat(s, s), start + 1, length)
    plain = F.substring(s, start + 1, length)
    return F.when(inside & (start + length <= n), plain).when(
        inside & (topology == "circular"), wrapped
    )


def gc_bases(s: ColumnOrName) -> Column:
    return F.length(F.regexp_replace(_col(s), "[^GC]", ""))


def gc_fraction(s: ColumnOrName) -> Column:
    s = _col(s)
    return gc_bases(s) / F.length(s)


def kmers(s: ColumnOrName, k: int) -> Column:
    """All windows of length ``k`` in order, found in one pass over the string."""
    return F.regexp_extract_all(_col(s), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def kmer_share(short, long, k: int, both_strands: bool = True) -> Column:
    """Share of ``short``'s windows that occur among ``long``'s windows."""
    short, long = _col(short), _col(long)
    pool = kmers(long, k)
    if both_strands:
        pool = F.concat(pool, kmers(F.reverse(F.translate(long, "ACGT", "TGCA")), k))
    windows = kmers(short, k)
    # Sorted together, a window stands behind the equal one of the pool: one pass counts them, repeated ones each.
    marked = lambda texts, f: F.transform(texts, lambda w: F.struct(w.alias("w"), F.lit(f).alias("f")))
    seen = F.aggregate(
        F.array_sort(F.concat(marked(pool, 0), marked(windows, 1))),
        F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.when(x["f"] == 0, F.struct(x["w"].alias("last"), a["n"].alias("n"))).otherwise(
            F.struct(a["last"].alias("last"), (a["n"] + (x["w"] == a["last"]).cast("int")).alias("n"))),
        lambda a: a["n"],
    )
    return F.when(F.size(windows) > 0, seen / F.size(windows)).otherwise(F.lit(0.0))


def fold_name(s: ColumnOrName) -> Column:
    """Lower-case letters and digits of a name."""
    return F.lower(F.regexp_replace(_col(s), r"[^\p{L}\p{N}]", ""))


def span_within(inner_start, inner_length, outer_start, outer_length, n) -> Column:
    """Whether one span lies inside another on a molecule of ``n`` bases."""
    a, b, c, d, n = map(_col, (inner_start, inner_length, outer_start, outer_length, n))
    return F.pmod(a - c, n) + b <= d


def sequence_sha256(s: ColumnOrName) -> Column:
    return F.sha2(_col(s), 256)
