"""Fixed values of the measurement domain: vocabularies, formats and reference shifts.

Everything in this file is a fixed value: its order is its code where one is used. The per-residue table of mean
shifts and deviations is larger and is always a parameter (a table ``residue, atom, center, scale``).
"""

from __future__ import annotations

RESIDUES = "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split()
ONE_LETTER = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "A R N D C Q E G H I L K M F P S T W Y V".split(), strict=True))
NUCLEOTIDES = "DA DC DG DT DU A C G U T ADE CYT GUA THY URA".split()
STRUCTURE_CLASSES = ["H", "E", "C", "G", "I", "T", "S", "B", " "]
MAPPING_CLASSES = "match gap_in_cs gap_in_structure mismatch protein_edge".split()
BACKBONE = "C CA CB N H HA".split()
ATOMS = (
    "C CA CB CD CD1 CD2 CE CE1 CE2 CE3 CG CG1 CG2 CH2 CZ CZ2 CZ3 DD1 "
    "H H1 H2 H3 HA HA2 HA3 HB HB1 HB2 HB3 HC HD1 HD11 HD12 HD13 HD2 HD21 HD22 HD23 HD3 "
    "HE HE1 HE2 HE21 HE22 HE3 HG HG1 HG11 HG12 HG13 HG2 HG21 HG22 HG23 HG3 HH HH11 HH12 HH2 HH21 HH22 "
    "HN1 HN2 HXT HZ HZ1 HZ2 HZ3 N ND1 ND2 NE NE1 NE2 NH1 NH2 NZ O OD1 OD2 OE1 OE2 OG OG1 OH OXT SD SG"
).split()
TARGET_ATOMS = (
    "C CA CB CD1 CD2 CD CE1 CE2 CE CG1 CG2 CG CZ H HA2 HA3 HA HB1 HB2 HB3 HB HD11 HD12 HD13 HD1 HD21 HD22 HD23 HD2 HD3 "
    "HE1 HE21 HE22 HE2 HE3 HE HG11 HG12 HG13 HG21 HG22 HG23 HG2 HG3 HG HZ N ND2 NE2"
).split()
PROTEIN_DATABASES = "UNIPROT UNP SP SWISSPROT SWISS-PROT TREMBL".split()
BOND_COLUMNS = "bond_ca_prev bond_ca_next bond_peptide_fwd bond_peptide_bkwd".split()
ACCESSIBLE_AREA = {
    "A": 129, "R": 274, "N": 195, "D": 193, "C": 167, "E": 223, "Q": 225, "G": 104, "H": 224, "I": 197,
    "L": 201, "K": 236, "M": 224, "F": 240, "P": 159, "S": 155, "T": 172, "V": 174, "W": 285, "Y": 263,
}
#: Random-coil shifts in ppm: CA, CB, C, N, H, HA.
RANDOM_COIL = {
    "A": (52.5, 19.1, 177.8, 123.8, 8.24, 4.35), "R": (56.0, 30.7, 176.3, 120.5, 8.27, 4.38), "N": (53.1, 38.7, 175.2, 118.7, 8.40, 4.75),
    "D": (54.2, 41.1, 176.3, 120.4, 8.41, 4.64), "C": (58.2, 28.0, 174.6, 118.8, 8.32, 4.56), "Q": (55.7, 29.4, 176.0, 119.8, 8.32, 4.37),
    "E": (56.6, 30.3, 176.6, 120.2, 8.36, 4.29), "G": (45.1, None, 174.9, 108.8, 8.33, 3.97), "H": (55.0, 29.0, 174.1, 118.2, 8.42, 4.63),
    "I": (61.1, 38.8, 176.4, 119.9, 8.00, 4.17), "L": (55.1, 42.4, 177.6, 121.8, 8.16, 4.38), "K": (56.5, 33.1, 176.6, 120.4, 8.29, 4.36),
    "M": (55.4, 32.9, 176.3, 119.6, 8.28, 4.52), "F": (57.7, 39.6, 175.8, 120.3, 8.30, 4.66), "P": (63.3, 32.1, 177.3, 137.4, None, 4.44),
    "S": (58.3, 63.8, 174.6, 115.7, 8.31, 4.50), "T": (61.8, 69.8, 174.7, 113.6, 8.15, 4.35), "W": (57.5, 29.6, 176.1, 121.3, 8.25, 4.70),
    "Y": (57.9, 38.8, 175.9, 120.3, 8.12, 4.60), "V": (62.2, 32.9, 176.3, 119.2, 8.03, 4.18),
}
RANDOM_COIL_ATOMS = "CA CB C N H HA".split()
#: Methyl protons and the pooled names under which a table may list them, in order.
METHYL_ALIASES = {
    "HB1": ["MB"], "HB2": ["MB"], "HB3": ["MB"], "HD11": ["MD1", "MD"], "HD12": ["MD1", "MD"], "HD13": ["MD1", "MD"],
    "HD21": ["MD2", "MD"], "HD22": ["MD2", "MD"], "HD23": ["MD2", "MD"], "HG11": ["MG1", "MG"], "HG12": ["MG1", "MG"], "HG13": ["MG1", "MG"],
    "HG21": ["MG2", "MG"], "HG22": ["MG2", "MG"], "HG23": ["MG2", "MG"], "HE1": ["ME"], "HE2": ["ME"], "HE3": ["ME"],
}
#: Atoms of a residue that exchange fast and count as one measurement.
EQUIVALENT = {
    "ALA": ["HB1 HB2 HB3"], "VAL": ["HG11 HG12 HG13", "HG21 HG22 HG23"], "LEU": ["HD11 HD12 HD13", "HD21 HD22 HD23"],
    "ILE": ["HG21 HG22 HG23", "HD11 HD12 HD13"], "THR": ["HG21 HG22 HG23"], "MET": ["HE1 HE2 HE3"],
    "PHE": ["HD1 HD2", "HE1 HE2", "CD1 CD2", "CE1 CE2"], "TYR": ["HD1 HD2", "HE1 HE2", "CD1 CD2", "CE1 CE2"],
}
#: Pairs whose labels may be swapped.
SWAPPABLE = {
    "GLY": ["HA2 HA3"], "SER": ["HB2 HB3"], "CYS": ["HB2 HB3"], "ASP": ["HB2 HB3"], "ASN": ["HB2 HB3", "HD21 HD22"], "PHE": ["HB2 HB3"],
    "TYR": ["HB2 HB3"], "HIS": ["HB2 HB3"], "TRP": ["HB2 HB3"], "LEU": ["HB2 HB3", "CD1 CD2"], "VAL": ["CG1 CG2"], "ILE": ["HG12 HG13"],
    "ARG": ["HB2 HB3", "HG2 HG3", "HD2 HD3"], "LYS": ["HB2 HB3", "HG2 HG3", "HD2 HD3", "HE2 HE3"], "PRO": ["HB2 HB3", "HG2 HG3", "HD2 HD3"],
    "GLN": ["HB2 HB3", "HG2 HG3", "HE21 HE22"], "GLU": ["HB2 HB3", "HG2 HG3"], "MET": ["HB2 HB3", "HG2 HG3"],
}
