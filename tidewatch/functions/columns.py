"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("LOW", "MODERATE", "HIGH", "CRITICAL")


def genus(taxon: str | Column) -> Column:
    """First word of a name."""
    return F.split(F.trim(taxon), r"\s+")[0]


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def share(x: Column, whole: Column) -> Column:
    """x / whole, and 0 where that is undefined."""
    return F.coalesce(F.try_divide(x, whole), F.lit(0.0))


def squash(z: Column, k: float = 3.0) -> Column:
    up = F.greatest(z, F.lit(0.0))
    return up / (up + F.lit(float(k)))


def exceedance(value: Column, median: Column, scale: Column, cap: float = 12.0) -> Column:
    """How many scales a value lies above the median, at least 0 and at most cap."""
    return clip((value - median) / scale, 0, cap)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.3, "MODERATE").otherwise("LOW")


def level_rank(level: Column) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def direct_detection(weight: Column, abundance: Column, n_detected: Column, load: Column) -> Column:
    """Score of the strongest detected taxon by itself, or of several together."""
    one = F.when((weight >= 0.85) & (abundance >= 0.05), 0.85).when((weight >= 0.7) & (abundance >= 0.15), 0.65).when((weight >= 0.7) & (abundance >= 0.05), 0.40).when((weight >= 0.5) & (abundance >= 0.20), 0.35).otherwise(0.0)
    many = F.when(n_detected < 2, 0.0).when(load >= 0.10, 0.62).when(load >= 0.04, 0.38).otherwise(0.0)
    return F.greatest(one, many)


def resistance_score(priority: Column, n_resistances: Column, abundance: Column) -> Column:
    tier = F.when(priority == "critical", 1.0).when(priority == "high", 0.7).when(priority == "medium", 0.4).otherwise(0.3)
    return F.round(0.6 * tier + 0.2 * F.least(n_resistances / 5, F.lit(1.0)) + 0.2 * abundance, 4)


def poisson_power(rate: Column, min_reads: int) -> Column:
    """P(at least min_reads) of a Poisson variable, as a finite sum."""
    term, total = F.lit(1.0), F.lit(0.0)
    for i in range(min_reads):
        total = total + term
        term = term * rate / (i + 1)
    return 1 - F.exp(-rate) * total


def kmers(seq: Column, k: int, alphabet: str = "ACGT", rna: bool = False, fold: bool = True) -> Column:
    """All substrings of k letters of the alphabet, in order; rna reads U as T; fold reads lower case as upper. One pass, however long the sequence."""
    s = F.upper(seq) if fold else seq
    s = F.translate(s, "U", "T") if rna else s
    return F.regexp_extract_all(s, F.lit(f"(?=([{alphabet}]{{{k}}}))"), F.lit(1))


def read_windows(seq: Column, length: int = 150, stride: int = 75) -> Column:
    """Windows of a sequence; a short one is its only window."""
    every = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{length}}})).{{{stride}}}"), F.lit(1))
    return F.when(F.length(seq) <= length, F.array(seq)).otherwise(every)


def sample_date(code: Column) -> Column:
    """Date of a code that ends in -YYMMDD."""
    return F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(code, r"-(\d{6})$", 1)), F.lit("yyyyMMdd")).cast("date")


def lat_lon(text: Column) -> Column:
    """Signed (lat, lon), five places, of '43.07 N 89.40 W'; null where it is not so written."""
    part = lambda i: F.regexp_extract(text, r"([\d.]+)\s*([NS])\s+([\d.]+)\s*([EW])", i)
    signed = lambda v, s, minus: F.round(F.when(part(s) == minus, -part(v).try_cast("double")).otherwise(part(v).try_cast("double")), 5)
    return F.when(part(1) != "", F.struct(signed(1, 2, "S").alias("lat"), signed(3, 4, "W").alias("lon")))


def accession(name: Column) -> Column:
    """The run accession (SRR, ERR or DRR and digits) in a file's name, or null."""
    found = F.regexp_extract(name, r"([SED]RR\d+)", 1)
    return F.when(found != "", found)


def place_label(geo: Column, date: Column, otherwise: Column) -> Column:
    """'Wisconsin, (2026-01-05)' of 'USA: Wisconsin' and a date; what is missing is left out, and with nothing left `otherwise`."""
    place = F.regexp_replace(F.coalesce(geo, F.lit("")), r"^[A-Z]+:\s*", "")
    parts = F.array_compact(F.array(F.when(place != "", place), F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("("), date, F.lit(")")))))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(otherwise)


def mate(name: Column) -> Column:
    """(base, mate) of a paired file's stem: base_1, base.R2; mate is null for an unpaired one."""
    base = F.regexp_extract(name, r"^(.+?)[._](R?)([12])$", 1)
    return F.when(base != "", F.struct(base.alias("base"), F.regexp_extract(name, r"^(.+?)[._](R?)([12])$", 3).alias("mate"))).otherwise(F.struct(name.alias("base"), F.lit(None).cast("string").alias("mate")))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Words that a text contains, in the words' order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))
