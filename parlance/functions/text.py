"""Text functions: normal forms, tokens, error rates, quality flags of transcript segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType

from ..settings import DEFAULT, Settings

# fixed values: patterns, flags and weights that must be these for right results
TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06ff}]+"
DIACRITICS = "[\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06dc\\u06df-\\u06e8\\u06ea-\\u06ed]"
ALEFS, ALEF = "آأإٱ", "ا"
MAQSURA, YEH = "ى", "ي"
HIGH_RISK = ["abnormally_high_word_rate", "decode_disagreement", "low_average_log_probability", "overlapping_speech", "repeated_ngram", "suspicious_character_sequence"]
RETRY_WEIGHTS = {"repeated_ngram": 6, "suspicious_character_sequence": 6, "abnormally_high_word_rate": 4, "abnormally_low_word_rate": 3, "low_average_log_probability": 2}
REVIEW_WEIGHTS = {
    "suspicious_character_sequence": 100, "repeated_ngram": 90, "overlapping_speech": 70, "decode_disagreement": 55,
    "low_average_log_probability": 45, "abnormally_high_word_rate": 40, "unaligned_words": 35, "low_confidence_alignment": 25,
}


# Python's own table of full case folding, which is Unicode's: letters with one folded letter, and those with several
_FOLDED = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_MANY = {c: f for c, f in _FOLDED.items() if len(f) > 1}
_HAS_MANY = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _MANY) + "]"


def casefold(text: Column) -> Column:
    """Full case folding; only texts with a letter that folds to several go through their list."""
    one = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    many = one
    for c, f in _MANY.items():
        many = F.replace(many, F.lit(c), F.lit(f))
    return F.when(text.rlike(_HAS_MANY), many).otherwise(one)


def normalized_tokens(text: Column) -> Column:
    """The tokens of a text, each case-folded; a letter that folds to several does not split its token."""
    text = F.coalesce(text, F.lit(""))
    find = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    return F.when(text.rlike(_HAS_MANY), F.transform(find(text), casefold)).otherwise(find(F.translate(text, "".join(_ONE), "".join(_ONE.values()))))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def normalize_word(word: Column, diacritics: bool = True, alefs: bool = True, maqsura: bool = False, drop_punctuation: bool = False) -> Column:
    out = nfkc(word)
    if diacritics:
        out = F.regexp_replace(out, DIACRITICS, "")
    if alefs:
        out = F.translate(out, ALEFS, ALEF * len(ALEFS))
    if maqsura:
        out = F.translate(out, MAQSURA, YEH)
    if drop_punctuation:
        out = F.regexp_replace(out, r"[\p{P}\p{S}]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_text(text: Column, **options) -> Column:
    """Token by token; tokens that become empty are dropped."""
    return F.array_join(F.filter(F.split(normalize_word(text, **options), r"\s+"), lambda x: x != ""), " ")


def latin(word: Column) -> Column:
    return word.rlike("[A-Za-z]")


def _most_frequent(tokens, n: int) -> int:
    """Occurrences of the most frequent n-gram of one list, 0 with fewer tokens."""
    if tokens is None or len(tokens) < n:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    grams = ids[: len(ids) - n + 1]
    for k in range(1, n):  # pairs of numbers are numbered again, so keys stay under 2^62
        grams = np.unique(grams, return_inverse=True)[1] * len(numbers) + ids[k : len(ids) - n + 1 + k]
    return int(np.unique(grams, return_counts=True)[1].max())


def max_ngrams(tokens: Column, n: int = 3) -> Column:
    """Occurrences of the most frequent n-gram of each token list."""

    @F.pandas_udf(IntegerType())
    def count(lists: pd.Series) -> pd.Series:
        return pd.Series([_most_frequent(x, n) for x in lists], dtype="int32")

    return count(tokens)


def _has_run(tokens, longest: int = 3, run: int = 8) -> bool:
    """Eight tokens in a row of up to three letters with one first letter; a longer token starts anew."""
    if tokens is None or len(tokens) < run:
        return False
    heads = np.array([ord(t[0]) if len(t) <= longest else -1 for t in tokens])
    changes = np.flatnonzero(np.diff(heads)) + 1
    edges = np.concatenate([[0], changes, [len(heads)]])
    return bool(((np.diff(edges) >= run) & (heads[edges[:-1]] >= 0)).any())


@F.pandas_udf(BooleanType())
def _runs(lists: pd.Series) -> pd.Series:
    return pd.Series([_has_run(x) for x in lists], dtype=bool)


def suspicious(text: Column, tokens: Column) -> Column:
    """Format or surrogate characters, or eight short tokens in a row with one first letter."""
    return F.coalesce(text.rlike(r"[\p{Cf}\p{Cs}]"), F.lit(False)) | _runs(tokens)


def segment_flags(segments: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``quality_flags`` and ``n_tokens`` to segments (start_s, end_s, text, avg_logprob); flags in rule order."""
    df = segments.withColumn("__tok", normalized_tokens(F.col("text")))
    df = df.withColumn("n_tokens", F.size("__tok")).withColumn("__grams", max_ngrams(F.col("__tok"))).withColumn("__odd", suspicious(F.col("text"), F.col("__tok")))
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    slow = (F.col("n_tokens") > 0) & (length > 0) & (F.try_divide(F.col("n_tokens"), length) < s.min_word_rate)
    fast = (length == 0) | (F.try_divide(F.col("n_tokens"), length) > s.max_word_rate)
    rules = [
        ("repeated_ngram", F.col("__grams") > s.max_ngrams),
        ("suspicious_character_sequence", F.col("__odd")),
        ("low_average_log_probability", F.col("avg_logprob") < s.suspect_logprob),
        ("abnormally_low_word_rate", slow),
        ("abnormally_high_word_rate", fast),
    ]
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return df.withColumn("quality_flags", flags).drop("__tok", "__grams", "__odd")


def _weight(flag: Column, weights: dict[str, int], other: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, flag), F.lit(other))


def quality_rank(flags: Column, logprob: Column) -> Column:
    """(weights, flags, penalty); smaller is better, a missing probability is worst."""
    distinct = F.array_distinct(flags)
    total = F.aggregate(distinct, F.lit(0), lambda a, f: a + _weight(f, RETRY_WEIGHTS, 1))
    penalty = F.when(logprob.isNull() | F.isnan(logprob) | (F.abs(logprob) == float("inf")), F.lit(float("inf"))).otherwise(-logprob)
    return F.struct(total.alias("weight"), F.size(distinct).alias("flags"), penalty.alias("penalty"))


def review_priority(flags: Column, speaker: Column, assistant: Column, status: Column, verified: Column) -> Column:
    """Null speaker equals null assistant."""
    base = F.aggregate(F.array_distinct(flags), F.lit(0), lambda a, f: a + _weight(f, REVIEW_WEIGHTS, 10))
    return base + F.when(speaker.eqNullSafe(assistant), 20).otherwise(0) + F.when(status != "aligned", 30).otherwise(0) - F.when(verified, 1000).otherwise(0)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    a, b = (F.trim(F.regexp_replace(casefold(x), r"\s+", " ")) for x in (reference, hypothesis))
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of token lists.

    The distinct tokens of the pair are numbered and written as characters of the supplementary planes
    (surrogates are left out), so that the built-in edit distance of strings counts tokens; a pair has room for a
    million distinct tokens, and more are an error.
    """
    known = F.array_distinct(F.concat(a, b))
    code = lambda t: F.array_position(known, t) + 0xFFFF
    chars = lambda xs: F.array_join(F.transform(xs, lambda t: F.decode(F.unhex(F.lpad(F.hex(code(t)), 8, "0")), "UTF-32")), "")
    room = F.when(F.size(known) > 1_000_000, F.raise_error(F.lit("over a million distinct tokens in a pair")).cast("int"))
    return F.coalesce(room, F.levenshtein(chars(a), chars(b)))


def error_rates(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """(word error rate, character error rate without blanks) over normalised tokens."""
    p, g = normalized_tokens(predicted), normalized_tokens(gold)
    pc, gc = F.array_join(p, ""), F.array_join(g, "")
    return token_distance(p, g) / F.greatest(F.lit(1), F.size(g)), F.levenshtein(pc, gc) / F.greatest(F.lit(1), F.length(gc))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([0.0 if not x and not y else 1.0 - SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def disagreement(a: Column, b: Column) -> Column:
    """1 - the sequence matcher's ratio of the normalised texts; 0 if both are empty."""
    return _ratio(F.array_join(normalized_tokens(a), " "), F.array_join(normalized_tokens(b), " "))


def weighted_logprob(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log probability by duration, each segment at least a millisecond; null ones are skipped."""
    p = F.expr("try_cast(avg_logprob AS double)")
    w = F.greatest(F.lit(0.001), F.col("end_s") - F.col("start_s"))
    known = segments.withColumn("__p", p).withColumn("__w", w).where("__p is not null")
    return known.groupBy(*keys).agg((F.sum(F.col("__p") * F.col("__w")) / F.sum("__w")).alias("avg_logprob"))


def media_key(path: Column) -> Column:
    """The stem of a path with runs of other characters as one underscore; a digest of the path if nothing is left."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    clean = F.btrim(F.regexp_replace(stem, r"[^A-Za-z0-9_.\-\x{0600}-\x{06ff}]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.substring(F.sha2(path, 256), 1, 12))


def _safe(name: Column, longest: int, other: str) -> Column:
    clean = F.btrim(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._\-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(F.substring(clean, 1, longest), F.lit("")), F.lit(other))


def safe_filename(name: Column) -> Column:
    return _safe(F.regexp_extract(name, r"([^/]*)/*$", 1), 180, "media.bin")


def slug(name: Column) -> Column:
    return _safe(name, 80, "dataset")


def stable_id(parts: list[Column], length: int) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def seconds(samples: Column) -> Column:
    return samples / 24000.0


def samples(seconds_: Column) -> Column:
    """Half-even rounding, never negative."""
    return F.greatest(F.lit(0), F.rint(seconds_ * 24000)).cast("long")


def bounded(value: Column, duration: Column) -> Column:
    """A number cut to [0, duration]; null for what is no finite number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.greatest(F.lit(0.0), F.least(duration.cast("double"), number)))


def cosine(a: Column, b: Column) -> Column:
    """-1 if a norm is zero."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(norms == 0, F.lit(-1.0)).otherwise(total(a, b) / norms)
