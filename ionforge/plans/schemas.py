"""The result tables' schemas, as DDL."""

CANDIDATES = "array<struct<pos:int,peptide:string,distance:double,is_decoy:boolean>>"
PEAKS = "array<struct<mz:double,intensity:double>>"
SPECTRA = f"raw_file string, index int, scan int, precursorMZ double, charge int, peaks {PEAKS}"
SEARCH_RESULTS = f"raw_file string, scan int, index int, precursorMZ double, pepmass double, charge int, candidates {CANDIDATES}, peaks {PEAKS}"
SCORED = f"{SEARCH_RESULTS}, best_is_decoy boolean, best_distance double, best_score double, best_peptide string, peptide_mass double, delta_mass double"
FILTERED = f"{SCORED}, q double, accession array<string>"
