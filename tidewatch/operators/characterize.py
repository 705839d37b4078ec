"""Novel sequences and sample metadata: keyword flags, structure confidence, risk tiers, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import keyword_hits, lat_lon
from tidewatch.operators.words import longest_word

# Words that mark a protein title.
VIRULENCE_KEYWORDS = [
    "toxin", "hemolysin", "invasin", "adhesin", "protease", "siderophore", "capsule", "fimbria", "pilus", "effector", "secretion system", "autotransporter", "superantigen", "phospholipase", "hyaluronidase", "coagulase", "fibronectin",
]


def structure_confidence(atoms: DataFrame) -> DataFrame:
    """(name, confidence): mean B-factor of a structure's ATOM lines (name, line); shares of 1 are read as percent."""
    value = F.trim(F.substring("line", 61, 6)).try_cast("double")
    mean = atoms.where(F.startswith("line", F.lit("ATOM"))).groupBy("name").agg(F.avg(value).alias("m"))
    return mean.select("name", F.when(F.col("m") <= 1, F.col("m") * 100).otherwise(F.col("m")).alias("confidence"))


def risk_tiers(proteins: DataFrame, keywords: list[str] = VIRULENCE_KEYWORDS) -> DataFrame:
    """proteins (title, confidence) with flags and tier: flagged and confident HIGH, flagged MODERATE, confident MONITOR, else LOW."""
    flagged = proteins.withColumn("flags", keyword_hits(F.col("title"), keywords))
    sure = F.coalesce(F.col("confidence") > 70, F.lit(False))
    tier = F.when((F.size("flags") > 0) & sure, "HIGH").when(F.size("flags") > 0, "MODERATE").when(sure, "MONITOR").otherwise("LOW")
    return flagged.withColumn("tier", tier)


def located(samples: DataFrame, places: DataFrame) -> DataFrame:
    """samples (sample, lat_lon, place) with lat and lon: those that are written, else those of the longest name of places
    (name, lat, lon; names in lower case) that the place contains. Different places are searched once, for all names in one pass."""
    own = samples.withColumn("own", lat_lon(F.col("lat_lon")))
    search = own.where("own is null").select(F.col("place").alias("text"))
    hit = longest_word(search, places.select(F.col("name").alias("word"))).withColumnRenamed("text", "place")
    there = hit.join(places.select(F.lower("name").alias("word"), F.struct("lat", "lon").alias("there")), "word").select("place", "there")
    out = own.join(there, "place", "left").withColumn("at", F.coalesce("own", "there"))
    return out.select("sample", "place", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


def with_metadata(samples: DataFrame, accessions: DataFrame, metadata: DataFrame) -> DataFrame:
    """samples (sample) with what is known of their accession (sample, accession) and its record (accession, ...)."""
    return samples.join(accessions, "sample", "left").join(metadata, "accession", "left")
