"""Text-to-vector encoders by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.vector import hash48

#: Character classes counted by the byte encoder, in the order of its dimensions.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[ \\t]", "\\n", "[.!?]", "[,;:]", "[(){}\\[\\]]", "[\"']", "[#*$%&|<>]", "[^\\x00-\\x7F]")


def byte_features(text: Column) -> Column:
    """Share of each character class, then log1p of the length."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.array(*[F.regexp_count(text, F.lit(c)) / n for c in CLASSES], F.log1p(F.length(text).cast("double")))


def one_hot(value: Column, dimensions: int) -> Column:
    """1 at the value's hash bucket."""
    at = F.pmod(hash48(value), F.lit(dimensions))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def hashed_terms(docs: DataFrame, key: str, terms: Column, dimensions: int) -> DataFrame:
    """(key, idx, val): sparse counts of hashed terms."""
    return docs.select(key, F.explode(terms).alias("_t")).groupBy(key, F.pmod(hash48(F.col("_t")), F.lit(dimensions)).alias("idx")).agg(F.count("*").cast("double").alias("val"))


def stylometry(text: Column) -> Column:
    """Words, mean word length, share of distinct words, words a sentence, share of capitals and of digits."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    chars = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1))
    letters = F.greatest(F.length(text), F.lit(1))
    return F.struct(
        n.alias("words"), F.when(n > 0, chars / n).otherwise(0.0).alias("word_length"), F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(0.0).alias("distinct"),
        (n / sentences).alias("sentence_words"), (F.regexp_count(text, F.lit("[A-Z]")) / letters).alias("capitals"), (F.regexp_count(text, F.lit("[0-9]")) / letters).alias("digits"),
    )


def event_codes(text: Column) -> Column:
    """Sixteen numbers of an event's line: code known, code, root, class, Goldstein scale and tone over their ranges, one-hot class
    1..4, cooperative root, hostile root, both actors and the place named, and a hash share (SHA-256) of the line."""
    number = lambda label: F.try_to_number(F.regexp_extract(text, rf"(?:^|[^A-Za-z0-9]){label}\s+([-+]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("S999999D999999")).cast("double")
    code, root, kind, scale, tone = (number(label) for label in ("EventCode", "root", "quad", "Goldstein", "tone"))
    part = lambda v, top: F.least(F.coalesce(v, F.lit(0.0)), F.lit(float(top))) / top
    signed = lambda v, top: F.greatest(F.least(F.coalesce(v, F.lit(0.0)) / top, F.lit(1.0)), F.lit(-1.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    named = [flag(F.contains(text, F.lit(w))) for w in ("Actor1 ", "Actor2 ", "ActionGeo ")]
    share = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    classes = [flag(kind.cast("int") == k) for k in (1, 2, 3, 4)]
    return F.array(flag(code.isNotNull()), part(code, 999), part(root, 20), part(kind, 4), signed(scale, 10), signed(tone, 100), *classes, flag((root > 0) & (root < 10)), flag(root >= 13), *named, F.coalesce(share, F.lit(0.0)))
