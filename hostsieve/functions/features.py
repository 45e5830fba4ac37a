"""Lexical features of a domain name: 44 numbers, all by built-in functions, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("thirdleveldomain", "secondleveldomain", "fqdn")


def with_levels(df: DataFrame, name: str = "domain_name") -> DataFrame:
    """Adds fqdn, labels, secondleveldomain and thirdleveldomain; each is made once from the one before."""
    df = df.withColumn("fqdn", F.btrim(F.col(name), F.lit("."))).withColumn("labels", F.split("fqdn", r"\."))
    many = F.size("labels") > 1
    second = F.when(many, F.element_at("labels", -2)).otherwise("")
    third = F.when(many, F.array_join(F.slice("labels", 1, F.greatest(F.size("labels") - 2, F.lit(0))), ".")).otherwise("")
    return df.withColumns({"secondleveldomain": second, "thirdleveldomain": third})


def basic() -> dict[str, Column]:
    """label_average is the length of the whole name, and label_max that of the label which is greatest as text."""
    return {
        "label_length": F.size("labels"),
        "label_max": F.length(F.array_max("labels")),
        "label_average": F.length("fqdn"),
    }


def _share(text: Column, count: Column) -> Column:
    return F.when(F.length(text) > 0, count / F.length(text)).otherwise(0.0)


def letters() -> dict[str, Column]:
    low = F.lower("fqdn")
    return {f"freq_{c}": _share(low, F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) for c in LETTERS}


def ratios() -> dict[str, Column]:
    out, capital, digits, blank = {}, LETTERS.upper(), "0123456789", " \t\n\x0b\f\r"
    for level in LEVELS:
        text = F.col(level)
        without = lambda chars, text=text: F.length(F.translate(text, chars, ""))
        out[f"{level}_full"] = F.when(F.length(text) > 0, 1.0).otherwise(0.0)
        out[f"{level}_alpha"] = _share(text, F.length(text) - without(LETTERS + capital))
        out[f"{level}_numeric"] = _share(text, F.length(text) - without(digits))
        out[f"{level}_special"] = _share(text, without(LETTERS + capital + digits + blank))
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text. Equal characters stand together once sorted."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    shares = F.transform(runs, lambda run: F.length(run) / F.length(text))
    return F.when(F.length(text) > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def entropies() -> dict[str, Column]:
    return {f"{level}_entropy": entropy(F.col(level)) for level in reversed(LEVELS)}


def all_features() -> dict[str, Column]:
    """The 44 features in the order of the vector."""
    return basic() | letters() | ratios() | entropies()


def with_letters(df: DataFrame) -> DataFrame:
    """Adds letters() to names with their levels, from one sort of a name's characters.

    One of each letter and the sign after z are sorted in, so a letter's number is the distance of two places, less one.
    """
    df = df.withColumn("__low", F.lower("fqdn"))
    every = F.concat("__low", F.lit(LETTERS + "{"))
    df = df.withColumn("__sorted", F.array_join(F.sort_array(F.split(every, "")), ""))
    number = lambda c: F.locate(chr(ord(c) + 1), F.col("__sorted")) - F.locate(c, F.col("__sorted")) - 1
    return df.withColumns({f"freq_{c}": _share(F.col("__low"), number(c)) for c in LETTERS}).drop("__low", "__sorted")


def with_features(df: DataFrame, name: str = "domain_name") -> DataFrame:
    """Adds a name's levels and its 44 features as columns."""
    return with_letters(with_levels(df, name)).withColumns(basic() | ratios() | entropies())


def feature_vector(df: DataFrame, out: str = "features") -> DataFrame:
    """Adds the features of domain_name as one vector."""
    from pyspark.ml.feature import VectorAssembler

    df = with_features(df)
    return VectorAssembler(inputCols=list(all_features()), outputCol=out, handleInvalid="keep").transform(df)


def feature_columns(df: DataFrame, vector: str = "features") -> DataFrame:
    """Adds the 44 features as columns from their vector."""
    from pyspark.ml.functions import vector_to_array

    out = df.withColumn("__a", vector_to_array(vector))
    return out.withColumns({c: F.get("__a", F.lit(i)) for i, c in enumerate(all_features())}).drop("__a")


def preprocess(df: DataFrame, query: str = "query") -> DataFrame:
    """Non-empty, distinct names of two or more labels with their levels; of a name's classes, the smallest."""
    df = df.where((F.col(query) != "") & F.col(query).isNotNull()).groupBy(query).agg(F.min("class").alias("class"))
    df = with_levels(df, query).where(F.size("labels") > 1)
    return df.withColumn("tld", F.element_at("labels", -1))
