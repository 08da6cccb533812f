"""Restriction enzyme catalogue: a small, bounded dimension held as plain values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Name, recognition site, top-strand and bottom-strand cut offsets.
BUILTIN_TEXT = """
AatII GACGTC 5 1
Acc65I GGTACC 1 5
AccI GTMKAC 2 4
AflII CTTAAG 1 5
AgeI ACCGGT 1 5
AluI AGCT 2 2
AlwNI CAGNNNCTG 6 3
ApaI GGGCCC 5 1
ApaLI GTGCAC 1 5
AscI GGCGCGCC 2 6
AseI ATTAAT 2 4
AsiSI GCGATCGC 5 3
AvaI CYCGRG 1 5
AvrII CCTAGG 1 5
BamHI GGATCC 1 5
BbsI GAAGAC 8 12
BclI TGATCA 1 5
BfaI CTAG 1 3
BglI GCCNNNNNGGC 7 4
BglII AGATCT 1 5
BmtI GCTAGC 5 1
BsaAI YACGTR 3 3
BsaI GGTCTC 7 11
BsaWI WCCGGW 1 5
BseRI GAGGAG 16 14
BsiWI CGTACG 1 5
BsmBI CGTCTC 7 11
BsmI GAATGC 7 5
BspEI TCCGGA 1 5
BspHI TCATGA 1 5
BsrGI TGTACA 1 5
BssHII GCGCGC 1 5
BstBI TTCGAA 2 4
BstEII GGTNACC 1 6
BstXI CCANNNNNNTGG 8 4
BtgZI GCGATG 16 20
ClaI ATCGAT 2 4
DdeI CTNAG 1 4
DraI TTTAAA 3 3
DraIII CACNNNGTG 6 3
EagI CGGCCG 1 5
EcoNI CCTNNNNNAGG 5 6
EcoRI GAATTC 1 5
EcoRV GATATC 3 3
Esp3I CGTCTC 7 11
FseI GGCCGGCC 6 2
FspI TGCGCA 3 3
HaeIII GGCC 2 2
HhaI GCGC 3 1
HincII GTYRAC 3 3
HindIII AAGCTT 1 5
HinfI GANTC 1 4
HpaI GTTAAC 3 3
KasI GGCGCC 1 5
KpnI GGTACC 5 1
MfeI CAATTG 1 5
MluI ACGCGT 1 5
MseI TTAA 1 3
MspI CCGG 1 3
NarI GGCGCC 2 4
NcoI CCATGG 1 5
NdeI CATATG 2 4
NheI GCTAGC 1 5
NlaIII CATG 4 0
NotI GCGGCCGC 2 6
NruI TCGCGA 3 3
NsiI ATGCAT 5 1
PacI TTAATTAA 5 3
PaqCI CACCTGC 11 15
PciI ACATGT 1 5
PmeI GTTTAAAC 4 4
PmlI CACGTG 3 3
PsiI TTATAA 3 3
PspOMI GGGCCC 1 5
PstI CTGCAG 5 1
PvuI CGATCG 4 2
PvuII CAGCTG 3 3
RsaI GTAC 2 2
SacI GAGCTC 5 1
SacII CCGCGG 4 2
SalI GTCGAC 1 5
SapI GCTCTTC 8 11
Sau3AI GATC 0 4
SbfI CCTGCAGG 6 2
ScaI AGTACT 3 3
SfiI GGCCNNNNNGGCC 8 5
SgrAI CRCCGGYG 2 6
SmaI CCCGGG 3 3
SnaBI TACGTA 3 3
SpeI ACTAGT 1 5
SphI GCATGC 5 1
SspI AATATT 3 3
StuI AGGCCT 3 3
SwaI ATTTAAAT 4 4
TaqI TCGA 1 3
XbaI TCTAGA 1 5
XhoI CTCGAG 1 5
XmaI CCCGGG 1 5
ZraI GACGTC 3 3
"""


class Enzyme(NamedTuple):
    name: str
    recognition_sequence: str
    top_cut_offset: int
    bottom_cut_offset: int

    @property
    def span(self) -> int:
        """Recognition plus any cut outside it: the shortest circle it can cut."""
        offsets = (self.top_cut_offset, self.bottom_cut_offset)
        return max(*offsets, len(self.recognition_sequence)) - min(*offsets, 0)

    @property
    def polarity(self) -> str:
        stagger = self.bottom_cut_offset - self.top_cut_offset
        return "blunt" if stagger == 0 else "five_prime" if stagger > 0 else "three_prime"


def builtin() -> list[Enzyme]:
    rows = (line.split() for line in BUILTIN_TEXT.strip().splitlines())
    return [Enzyme(name, site, int(top), int(bottom)) for name, site, top, bottom in rows]


def catalogue_from_table(df: DataFrame) -> list[Enzyme]:
    """Read an enzyme table (see ``sources.rebase``): a dimension of known enzymes, which doesn't grow with the records."""
    return sorted(Enzyme(*row) for row in df.select(*Enzyme._fields).collect())


def select_enzymes(names: list[str], catalogue: list[Enzyme] | None = None) -> list[Enzyme]:
    """Case-insensitive selection without repeats, in catalogue order."""
    catalogue = builtin() if catalogue is None else catalogue
    if not names:
        raise ValueError("select at least one restriction enzyme")
    wanted = {name.lower() for name in names}
    unknown = sorted(wanted - {e.name.lower() for e in catalogue})
    if unknown:
        raise ValueError(f"unsupported restriction enzyme: {', '.join(unknown)}")
    return [e for e in catalogue if e.name.lower() in wanted]


def enzymes_table(spark: SparkSession, catalogue: list[Enzyme] | None = None) -> DataFrame:
    """The catalogue with its overhang polarity, overhang length and specificity."""
    rows = [
        (*e, e.polarity, abs(e.bottom_cut_offset - e.top_cut_offset),
         len(e.recognition_sequence.replace("N", "")))
        for e in (builtin() if catalogue is None else catalogue)
    ]
    return spark.createDataFrame(
        rows,
        "name string, recognition_sequence string, top_cut_offset int, "
        "bottom_cut_offset int, overhang_polarity string, overhang_length int, specificity int",
    )
