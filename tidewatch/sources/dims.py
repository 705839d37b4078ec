"""Reference dimensions: pathogens, tripwires, resistance, species context, keywords, scoring constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Genera and their risk weights, as results must equal.
PATHOGENS = {
    "bacteria": {
        "Yersinia": 0.95, "Francisella": 0.95, "Bacillus": 0.90, "Brucella": 0.90, "Burkholderia": 0.90, "Coxiella": 0.85, "Rickettsia": 0.85, "Clostridioides": 0.80, "Clostridium": 0.80, "Vibrio": 0.80,
        "Salmonella": 0.75, "Shigella": 0.75, "Campylobacter": 0.70, "Listeria": 0.70, "Escherichia": 0.65, "Staphylococcus": 0.60, "Streptococcus": 0.60, "Klebsiella": 0.65, "Acinetobacter": 0.65, "Pseudomonas": 0.60,
        "Enterococcus": 0.60, "Neisseria": 0.65, "Haemophilus": 0.55, "Legionella": 0.70, "Mycobacterium": 0.75, "Treponema": 0.65, "Leptospira": 0.65, "Helicobacter": 0.55, "Enterobacter": 0.50, "Proteus": 0.45,
        "Serratia": 0.50, "Stenotrophomonas": 0.50, "Fusobacterium": 0.45, "Bacteroides": 0.35,
    },
    "virus": {
        "Betacoronavirus": 0.90, "Alphacoronavirus": 0.60, "Alphainfluenzavirus": 0.88, "Betainfluenzavirus": 0.80, "Gammainfluenzavirus": 0.65, "Orthomyxovirus": 0.85, "Orthopneumovirus": 0.75, "Metapneumovirus": 0.65, "Respirovirus": 0.60, "Rubulavirus": 0.65,
        "Morbillivirus": 0.80, "Mastadenovirus": 0.60, "Adenovirus": 0.60, "Rhinovirus": 0.45, "Norovirus": 0.75, "Rotavirus": 0.70, "Hepatovirus": 0.70, "Orthohepevirus": 0.65, "Sapovirus": 0.55, "Astrovirus": 0.50,
        "Enterovirus": 0.70, "Lyssavirus": 0.95, "Alphaherpesviridae": 0.55, "Simplexvirus": 0.55, "Varicellovirus": 0.60, "Ebolavirus": 0.98, "Marburgvirus": 0.98, "Mammarenavirus": 0.90, "Orthonairovirus": 0.90, "Phlebovirus": 0.85,
        "Orthohantavirus": 0.85, "Bandavirus": 0.80, "Flavivirus": 0.80, "Alphavirus": 0.78, "Orthobunyavirus": 0.70, "Orthopoxvirus": 0.88, "Lentivirus": 0.80, "Orthohepadnavirus": 0.75, "Hepacivirus": 0.75, "Deltaretrovirus": 0.65,
        "Bocaparvovirus": 0.50, "Polyomavirus": 0.55,
    },
    "fungi": {"Candida": 0.65, "Aspergillus": 0.60},
    "parasite": {"Cryptosporidium": 0.70, "Giardia": 0.60},
}

# Least relative abundance at which a genus alone raises an alert.
TRIPWIRES = {
    "Yersinia": 0.01, "Francisella": 0.01, "Bacillus": 0.02, "Brucella": 0.01, "Burkholderia": 0.02, "Ebolavirus": 0.001, "Marburgvirus": 0.001, "Mammarenavirus": 0.005, "Orthonairovirus": 0.005, "Orthopoxvirus": 0.002,
    "Lyssavirus": 0.002, "Phlebovirus": 0.005, "Orthohantavirus": 0.005,
}

# Genus, priority, threat, among the six hospital pathogens, number of resistances, of last-resort drugs.
RESISTANCE = [
    ("Staphylococcus", "critical", "serious", True, 4, 4), ("Enterococcus", "critical", "urgent", True, 3, 3), ("Klebsiella", "critical", "urgent", True, 4, 3), ("Acinetobacter", "critical", "urgent", True, 4, 3),
    ("Pseudomonas", "critical", "serious", True, 4, 3), ("Enterobacter", "critical", "serious", True, 3, 2), ("Escherichia", "critical", "serious", False, 4, 3), ("Salmonella", "high", "serious", False, 3, 3),
    ("Clostridioides", "high", "urgent", False, 2, 3), ("Mycobacterium", "critical", "serious", False, 4, 3), ("Neisseria", "high", "urgent", False, 3, 2), ("Haemophilus", "medium", "concerning", False, 2, 2),
    ("Campylobacter", "high", "serious", False, 3, 2), ("Helicobacter", "high", "concerning", False, 3, 2), ("Burkholderia", "high", "serious", False, 3, 3), ("Stenotrophomonas", "medium", "concerning", False, 3, 3),
    ("Vibrio", "high", "serious", False, 3, 3), ("Shigella", "high", "serious", False, 3, 2), ("Yersinia", "critical", "urgent", False, 2, 4),
]

# Species, genus, risk elevation, number of known variants, classification.
LINEAGES = [
    ("Severe acute respiratory syndrome coronavirus 2", "Betacoronavirus", 0.15, 3, "pandemic"), ("Salmonella enterica", "Salmonella", 0.1, 4, "high priority"), ("Escherichia coli", "Escherichia", 0.05, 4, "high priority"),
    ("Vibrio cholerae", "Vibrio", 0.25, 2, "pandemic pathogen"), ("Vibrio parahaemolyticus", "Vibrio", 0.05, 1, "medium"), ("Yersinia pestis", "Yersinia", 0.5, 2, "select agent / BSL-3"),
    ("Yersinia enterocolitica", "Yersinia", 0.05, 2, "medium"), ("Klebsiella pneumoniae", "Klebsiella", 0.12, 3, "critical priority"), ("Clostridioides difficile", "Clostridioides", 0.1, 2, "urgent"),
    ("Mycobacterium tuberculosis", "Mycobacterium", 0.2, 3, "critical priority"), ("Neisseria gonorrhoeae", "Neisseria", 0.08, 2, "urgent"), ("Shigella sonnei", "Shigella", 0.08, 1, "high priority"),
    ("Shigella flexneri", "Shigella", 0.08, 1, "high priority"), ("Acinetobacter baumannii", "Acinetobacter", 0.1, 2, "critical priority"),
]


def pathogens(spark: SparkSession) -> DataFrame:
    """(genus, risk_weight, category); 80 rows."""
    return spark.createDataFrame([(g, w, c) for c, own in PATHOGENS.items() for g, w in own.items()], "genus string, risk_weight double, category string")


def tripwires(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRIPWIRES.items()), "genus string, min_rel double")


def resistance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESISTANCE, "genus string, priority string, threat string, eskape boolean, n_resistances int, n_last_resort int")


def lineages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINEAGES, "species string, genus string, risk_elevation double, n_variants int, who_label string")
