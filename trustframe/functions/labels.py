"""Label clean-up, attack families and the binary target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Attack names of the public KDD'99 family of datasets, by family.
FAMILY_MEMBERS: dict[str, list[str]] = {
    "normal": ["normal"],
    "dos": [
        "back", "land", "neptune", "pod", "smurf", "teardrop", "mailbomb", "apache2", "processtable", "udpstorm",
    ],
    "probe": ["ipsweep", "nmap", "portsweep", "satan", "mscan", "saint"],
    "r2l": [
        "ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster", "sendmail",
        "named", "snmpgetattack", "snmpguess", "xlock", "xsnoop", "worm",
    ],
    "u2r": ["buffer_overflow", "loadmodule", "perl", "rootkit", "httptunnel", "ps", "sqlattack", "xterm"],
}

UNKNOWN_FAMILY = "unknown"
NULL_LABEL = "nan"
WHITE_SPACE = " \t\n\r\f\u000b"


def normalize_label(label: Column) -> Column:
    """Text of the label without outer white space and trailing dots; a null label reads ``nan``."""
    text = F.coalesce(label.cast("string"), F.lit(NULL_LABEL))
    return F.rtrim(F.trim(text, F.lit(WHITE_SPACE)), F.lit("."))


def binary_label(label: Column) -> Column:
    """0 for normal traffic, 1 for everything else."""
    return F.when(normalize_label(label) == "normal", F.lit(0)).otherwise(F.lit(1))


def with_family(
    df: DataFrame,
    label_col: str = "label",
    out: str = "family",
    members: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add the attack family of each row.

    The mapping has a few dozen fixed entries, so it is a CASE expression inside the scan stage: no join at all.
    """
    if label_col not in df.columns:
        raise ValueError(f"families come from labels, but there is no column {label_col}")
    members = FAMILY_MEMBERS if members is None else members
    label = normalize_label(F.col(label_col))
    family = F.lit(UNKNOWN_FAMILY)
    for name, labels in members.items():
        family = F.when(label.isin(*labels), F.lit(name)).otherwise(family)
    return df.withColumn(out, family)
