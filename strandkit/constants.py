"""Fixed values of the protein domain.

Everything in this file is a fixed value: alphabets, lookup tables, vocabularies
and defaults that results depend on.  Operators take them as default arguments,
so other alphabets and vocabularies can be passed instead.
"""

# -- fixed values: symbols ---------------------------------------------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

SYMBOL_CLASSES = {
    "hydrophobic": "AVLIM",
    "aromatic": "FWY",
    "polar": "STNQ",
    "negative": "DE",
    "positive": "KRH",
    "special": "CGP",
}

THREE_LETTER_CODES = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C",
    "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P",
    "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}

EC_CLASSES = {
    "1": "Oxidoreductase",
    "2": "Transferase",
    "3": "Hydrolase",
    "4": "Lyase",
    "5": "Isomerase",
    "6": "Ligase",
    "7": "Translocase",
}

# -- fixed values: cellular location labels, tried in this order -------------
LOCATION_PATTERNS = [
    ("Secreted", r"\bsecreted\b"),
    ("Nucleus", r"\bnucleus|nucleolus|nucleoplasm\b"),
    ("Mitochondrion", r"\bmitochondri"),
    ("Chloroplast", r"\bchloroplast|plastid"),
    ("Endoplasmic reticulum", r"\bendoplasmic reticulum\b"),
    ("Golgi", r"\bgolgi\b"),
    ("Lysosome/Vacuole", r"\blysosome|vacuole\b"),
    ("Peroxisome", r"\bperoxisome\b"),
    ("Cell membrane", r"\bcell membrane|plasma membrane\b"),
    ("Membrane", r"\bmembrane\b"),
    ("Periplasm", r"\bperiplasm"),
    ("Cell wall", r"\bcell wall\b"),
    ("Cytoplasm", r"\bcytoplasm|cytosol\b"),
]

# -- fixed values: text formats ----------------------------------------------
UNCHARACTERIZED_PATTERN = r"(?i)^(putative\s+)?uncharacterized"
ACCESSION_PATTERN = r"^[A-Z][A-Z0-9]{5,9}$"
SUBSTITUTION_PATTERN = r"^([A-Z])(\d+)([A-Z])$"
HGVS_PATTERN = r"^p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})$"
DOMAIN_FEATURE_PATTERN = r'DOMAIN\s+(\d+)\.\.(\d+);(?:\s*/note="([^"]*)")?'
STRUCTURE_PREFIX = "<AA2fold>"
RARE_SYMBOLS = "UZOB"

# -- fixed values: columns of a raw annotated entry and their corpus names ----
ENTRY_COLUMNS = {
    "Entry": "accession",
    "Entry Name": "entry_name",
    "Protein names": "protein_name",
    "Gene Names (primary)": "gene",
    "Organism": "organism",
    "Organism (ID)": "taxon_id",
    "Length": "length",
    "Sequence": "sequence",
    "Pfam": "pfam",
    "EC number": "ec",
    "Keywords": "keywords",
    "Subcellular location [CC]": "subcellular_location",
    "Protein families": "protein_families",
}

CORPUS_COLUMNS = [
    "accession", "entry_name", "protein_name", "protein_name_full", "gene",
    "organism", "organism_short", "taxon_id", "length", "sequence", "family",
    "pfam_all", "pfam_primary", "ec", "ec_class", "is_enzyme",
    "keywords", "localization", "subcellular_location",
]

# -- fixed values: accessions a corpus build always retains -------------------
SHOWCASE_ACCESSIONS = [
    "P69905", "P68871", "P02144", "P01308", "P61626",
    "P0DP23", "P04637", "P01112", "P00441", "P68431",
]

# -- fixed values: defaults ---------------------------------------------------
ADHOC_LENGTHS = (10, 2048)
CORPUS_LENGTHS = (50, 512)
EPSILON = 1e-12
EMBEDDING_VERSION = "1"
POOLINGS = ("mean", "max", "bos", "attention")
APPROXIMATE_FROM = 50_000
# numbers of subspaces of a quantizer; the first that divides the dimension is taken
SUBSPACES = (64, 48, 32, 24, 16, 8, 4, 2, 1)
LINK_THRESHOLD = 0.5
LINK_K = 5
SPLIT_NAMES = ("train", "val", "test")
SPLIT_RATIOS = (0.70, 0.15, 0.15)
MAX_CHAIN_STEPS = 10
SITE_WINDOW = 8
MIN_REGION_SPAN = 5

# presets of a 2-D map: name -> (neighbours, minimum distance)
MAP_PRESETS = {"default": (15, 0.1), "local": (5, 0.05), "global": (50, 0.3)}

# probe task -> smallest class size in the training split
PROBE_TASKS = {
    "enzyme_vs_nonenzyme": 100, "ec_class": 40, "subcellular_localization": 80,
}
SUBSET_PROBE_TASKS = {
    "enzyme_vs_nonenzyme": 30, "ec_class": 12, "subcellular_localization": 25,
}

# -- fixed values: encoder registry ------------------------------------------
# id, slug, family, parameters (M), dimension, layers, weights GB, RAM GB, token budget
ENCODER_REGISTRY = [
    ("facebook/esm2_t6_8M_UR50D", "esm2_t6_8M", "esm2", 8, 320, 6, 0.03, 2, 16384),
    ("facebook/esm2_t12_35M_UR50D", "esm2_t12_35M", "esm2", 35, 480, 12, 0.14, 4, 16384),
    ("facebook/esm2_t30_150M_UR50D", "esm2_t30_150M", "esm2", 150, 640, 30, 0.60, 8, 8192),
    ("facebook/esm2_t33_650M_UR50D", "esm2_t33_650M", "esm2", 650, 1280, 33, 2.60, 16, 4096),
    ("Rostlab/ProstT5", "prostt5", "prostt5", 1208, 1024, 24, 4.80, 16, 4096),
]

# -- fixed values: BLOSUM62 substitution scores, lower triangle ---------------
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
