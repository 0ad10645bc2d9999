"""Fixed values of the domain: masses, the residue alphabet, enzyme rules."""

from __future__ import annotations

# Monoisotopic residue masses in daltons, five decimals.
RESIDUE_MASS = {
    "A": 71.03711,
    "C": 103.00919,
    "D": 115.02694,
    "E": 129.04259,
    "F": 147.06841,
    "G": 57.02146,
    "H": 137.05891,
    "I": 113.08406,
    "K": 128.09496,
    "L": 113.08406,
    "M": 131.04049,
    "N": 114.04293,
    "P": 97.05276,
    "Q": 128.05858,
    "R": 156.10111,
    "S": 87.03203,
    "T": 101.04768,
    "V": 99.06841,
    "W": 186.07931,
    "Y": 163.06333,
}
# Other masses in daltons.
WATER = 18.0105646837
HYDROGEN = 1.00782503207
PROTON = 1.00727646677
CARBAMIDOMETHYL = 57.021464
OXIDATION = 15.994915

# The padding letter, the standard residues, then rare ones; ids are places.
PAD = "_"
ALPHABET = "_QWERTYIPASDFGHKLCVNMBZXJU"
#: Residues that no kept peptide may have.
ODD_RESIDUES = "XUJZBO"

# Where enzymes cut, as patterns between two residues.
ENZYMES = {
    "trypsin": r"(?<=[KR])(?=[^P])|(?<=WK)(?=P)|(?<=MR)(?=P)",
    "lysc": r"(?<=K)(?=.)",
    "argc": r"(?<=R)(?=.)",
    "aspn": r"(?<=.)(?=D)",
    "chymotrypsin": r"(?<=[FYW])(?=[^P])",
    "gluc": r"(?<=E)(?=.)",
    "nonspecific": r"(?<=.)(?=.)",
}


def enzyme_rule(name: str) -> str:
    """A cut pattern from a rule's name or from a pattern, also if wrapped as r'...'."""
    if name.startswith("r'") and name.endswith("'"):
        name = name[2:-1]
    return ENZYMES.get(name, name)


def scaled(mass: float) -> int:
    """A residue mass in units of 1e-5, so that sums are exact."""
    return round(mass * 1e5)
