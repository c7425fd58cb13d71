"""Character codes of aligned data as Column expressions.

A code is a bit mask of the states a character may be, so ambiguity is a union and an
undetermined character is the full mask, never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published one-letter alphabets.
DNA_STATES = "ACGT"
AA_STATES = "ARNDCQEGHILKMFPSTWYV"
BINARY_STATES = "01"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT",
    "N": "ACGT", "O": "ACGT", "X": "ACGT", "-": "ACGT", "?": "ACGT",
}
AA_AMBIGUOUS = {"B": "ND", "Z": "QE", "X": AA_STATES, "?": AA_STATES, "*": AA_STATES, "-": AA_STATES}


@dataclass(frozen=True)
class DataType:
    """A kind of data: its states and what each character may be."""

    name: str
    states: str
    characters: dict[str, str]
    smooth_frequencies: bool = False

    @property
    def undetermined(self) -> int:
        return (1 << len(self.states)) - 1

    def mask(self, character: str) -> int:
        return sum(1 << self.states.index(s) for s in self.characters[character])


DNA = DataType("DNA", DNA_STATES, IUPAC)
AA = DataType("AA", AA_STATES, {c: c for c in AA_STATES} | AA_AMBIGUOUS, smooth_frequencies=True)
BINARY = DataType("BIN", BINARY_STATES, {"0": "0", "1": "1", "-": "01", "?": "01"})
TYPES = {t.name: t for t in (DNA, AA, BINARY)}


def encode(character: Column, kind: DataType) -> Column:
    """The code of an upper- or lower-case character; null if the alphabet lacks it."""
    pairs = [F.lit(x) for c in kind.characters for x in (c, kind.mask(c))]
    return F.element_at(F.create_map(*pairs), F.upper(character))


def decode(code: Column, kind: DataType) -> Column:
    """The character of a code: the one with just these states, `-` for undetermined."""
    by_mask = {kind.mask(c): c for c in reversed(kind.characters)} | {kind.undetermined: "-"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in by_mask.items() for x in kv]), code)


def n_states(code: Column) -> Column:
    """How many states a code allows."""
    return F.bit_count(code)
