"""Benchmark decontamination by templates: DataFrame functions only.

A text is first put in plain form (digit groups joined, a number set apart from the unit that
follows it), then every number, unit after a number and capitalised word is replaced by a typed
placeholder, one token for one token, in two forms: with the capitalised words inside a
sentence, and with those at its start as well.  A pair found in either form is found.
Windows of ``WINDOW`` template tokens of the benchmark are hash-joined with all windows of
the documents.  Documents with a hit are looked at again: their windows are joined with
the windows of the items, and what stands in the slots of the two sides is compared.  Places at
one distance to the item are an occurrence; it is consistent if at least ``AGREE`` of the item's slot
values always meet one and the same value there.  An item is found in a document if ``COVER`` of its windows
match in one consistent occurrence, or in several together (words put in or left out): then each
window lies in the largest occurrence that has it, and all slots together are consistent.

Items shorter than a window are one window of their own length.  Their words are compared too,
and their templates only where ``COVER`` of the tokens are words or the document is that long.

Defined results: null and empty texts have no windows and are clean; null ids of documents
are clean; items with null id or text are ignored; repeated rows count once; an empty
benchmark leaves all documents clean.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

WINDOW = 8
COVER, AGREE = 0.5, 0.8
#: A hash table of benchmark windows is broadcast up to so many rows (16 bytes each).
BROADCAST_ROWS = 500_000
# fixed values: units that may follow a number
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l ms s sec min h hr hrs day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles meter meters metre metres gram grams pound pounds liter liters litre litres "
    "second seconds minute minutes hour hours dollar dollars euro euros cent cents percent kb mb gb tb hz khz mhz ghz w kw v kv"
)


def plain(text: Column) -> Column:
    """Digit groups joined, numbers set apart from letters."""
    joined = F.regexp_replace(text, r"[.,](?<=\d[.,])(?=\d)", "")
    apart = F.regexp_replace(F.regexp_replace(joined, r"(\d)(?=\p{L})", "$1 "), r"(\p{L})(?=\d)", "$1 ")
    return F.when(text.rlike(r"\d"), apart).otherwise(text)


def all_names(text: Column) -> Column:
    """The template with the other capitalised words as names."""
    return F.regexp_replace(text, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])", "_name")


def template(text: Column) -> Column:
    """The plain text with typed placeholders, names inside a sentence only.  Each pattern starts with what it consumes, so most places fail at once."""
    names = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+(?![\p{L}\p{N}])", "_name")
    numbers = F.regexp_replace(names, r"\d(?<![\p{L}\d]\d)\d*(?![\p{L}\d])", "_num")
    units = F.regexp_replace(numbers, r"_num (?i:" + "|".join(UNITS.split()) + r")(?![\p{L}\p{N}])", "_num _unit")
    return F.when(text.rlike(r"\d"), units).otherwise(names)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def with_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, words, inner, every): plain tokens and template tokens of both forms, place by place."""
    base = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.translate(F.col(text).cast("string"), "_", " ").alias("t"))
    base = base.select(key, plain(F.col("t")).alias("p"))
    base = base.select(key, "p", template(F.col("p")).alias("k"))
    return base.select(key, tokens(F.col("p")).alias("words"), tokens(F.col("k")).alias("inner"), tokens(all_names(F.col("k"))).alias("every"))


def forms(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, form, words, kinds): a row for each form."""
    each = F.array(*[F.struct(F.lit(n).alias("form"), F.col(n).alias("kinds")) for n in names])
    return df.select(key, "words", F.explode(each).alias("f")).select(key, "f.form", "words", "f.kinds")


def hashes(kinds: Column, width: int) -> Column:
    """The hash of each window of the tokens' hashes, in order; none for fewer tokens."""
    last = F.size(kinds) - width
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(1))), lambda i: F.xxhash64(*[F.get(kinds, i + k) for k in range(width)]))


def coded(name: str) -> Column:
    return F.transform(name, lambda t: F.xxhash64(t)).alias(name)


def windows(df: DataFrame, key: str, width: int, at: str) -> DataFrame:
    """(key, form, width, at, h) for every window of the templates; shorter templates have none."""
    each = F.transform(hashes(F.col("kinds"), width), lambda h, i: F.struct(i.alias("at"), h.alias("h")))
    # explode_outer, as for explode Spark also filters by the array's size and so computes it twice
    rows = df.select(key, "form", coded("kinds")).select(key, "form", F.explode_outer(each).alias("w"))
    return rows.select(key, "form", F.lit(width).alias("width"), F.col("w.at").alias(at), "w.h").where(F.col(at).isNotNull())


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, cover: float = COVER, agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hit, n_slots, n_consistent) of items found in documents."""
    items = checkpoint(with_tokens(benchmark, "item_id").dropDuplicates())
    size = F.size("kinds")
    short = sorted(r[0] for r in items.select(F.size("words")).where(F.size("words").between(1, width - 1)).distinct().collect())
    names = ["inner", "every", "words"] if short else ["inner", "every"]
    items = forms(items, "item_id", names)
    spread = items.where((size >= width) & (F.col("form") != "words"))
    item_windows = windows(spread, "item_id", width, "item_at")
    for n in short:
        item_windows = item_windows.unionAll(windows(items.where(size == n), "item_id", n, "item_at"))
    item_windows = checkpoint(item_windows)
    small = F.broadcast if item_windows.count() <= BROADCAST_ROWS else (lambda df: df)

    ready = with_tokens(docs, "doc_id").select("doc_id", *[coded(n) for n in names])
    seen = [hashes(F.col(n), width) for n in names if n != "words"] + [hashes(F.col(n), k) for n in names for k in short]
    seen = F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<bigint>")) for x in seen]))
    seen = ready.select("doc_id", F.explode_outer(seen).alias("h"))
    suspects = checkpoint(seen.join(small(item_windows.select("h").distinct()), "h", "left_semi").select("doc_id").distinct())

    # the suspects once more, with the places of the windows and what stands in the slots
    again = with_tokens(docs.join(suspects, "doc_id", "left_semi"), "doc_id").dropDuplicates()
    again = checkpoint(forms(again, "doc_id", names))
    doc_windows = windows(again.where("form <> 'words'"), "doc_id", width, "doc_at")
    for n in short:
        doc_windows = doc_windows.unionAll(windows(again, "doc_id", n, "doc_at"))
    found = doc_windows.join(small(item_windows), ["h", "form", "width"])
    pair = ["doc_id", "item_id", "form", "width"]
    if short:
        telling = items.select("item_id", "form", size.alias("width"), F.when(F.col("form") == "words", size).otherwise(F.size(F.filter("kinds", lambda k: ~k.startswith("_")))).alias("plain"))
        telling = telling.where((F.col("width") < width) & (F.col("plain") >= cover * F.col("width"))).select("item_id", "form", "width").distinct()
        whole = again.select("doc_id", "form", size.alias("width")).where(F.col("width") < width).distinct()
        brief = found.where(F.col("width") < width)
        brief = brief.join(small(telling), ["item_id", "form", "width"], "left_semi").unionByName(brief.join(whole, ["doc_id", "form", "width"], "left_semi")).distinct()
        found = found.where(F.col("width") == width).unionByName(brief)
    counts = item_windows.groupBy("item_id", "form", "width").agg((F.max("item_at") + 1).cast("long").alias("n_windows"))
    most = found.groupBy(*pair).agg(F.count_distinct("item_at").alias("n")).join(small(counts), ["item_id", "form", "width"])
    most = most.where(F.col("n") >= cover * F.col("n_windows")).select(*pair, "n_windows")
    found = checkpoint(found.select(*pair, "item_at", "doc_at").join(most, pair).withColumn("off", F.col("doc_at") - F.col("item_at")))

    # slots: pairs (value in the item, value in the document) of the matched windows
    cut = lambda at: F.transform(
        F.filter(F.arrays_zip(F.slice("words", F.col(at) + 1, F.col("width")).alias("w"), F.slice("kinds", F.col(at) + 1, F.col("width")).alias("k")), lambda x: (F.col("form") != "words") & x["k"].startswith("_")), lambda x: x["w"]
    )
    pairs = found.join(small(items.select("item_id", "form", "words", "kinds")), ["item_id", "form"]).select(*pair, "off", "item_at", "doc_at", cut("item_at").alias("ours"))
    pairs = pairs.where(F.size("ours") > 0).join(again, ["doc_id", "form"]).select(*pair, "off", "item_at", "ours", cut("doc_at").alias("theirs"))
    slots = checkpoint(pairs.select(*pair, "off", "item_at", F.explode(F.arrays_zip("ours", "theirs")).alias("s")).select(*pair, "off", "item_at", "s.ours", "s.theirs"))

    def agreed(places: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
        """Places counted by ``by``, with how many slot values of the item meet one and the same value in each of them."""
        each = values.groupBy(*by, "ours").agg((F.min("theirs") == F.max("theirs")).alias("same"))
        each = each.groupBy(*by).agg(F.count("*").alias("n_slots"), F.sum(F.col("same").cast("long")).alias("n_consistent"))
        out = places.groupBy(*by, "n_windows").agg(F.count("*").alias("n_hit"), F.min("doc_at").alias("first")).join(each, by, "left").na.fill(0, ["n_slots", "n_consistent"])
        return out.where(F.col("n_consistent") >= agree * F.col("n_slots"))

    # an occurrence is what lies in the document as in the item; decoys, whose slots disagree, go before places are chosen
    occurrences = checkpoint(agreed(found, slots, [*pair, "off"]))
    rank = F.row_number().over(Window.partitionBy(*pair, "item_at").orderBy(F.desc("hits"), "first", "off"))
    chosen = found.join(occurrences.select(*pair, "off", F.col("n_hit").alias("hits"), "first"), [*pair, "off"])
    chosen = checkpoint(chosen.withColumn("rank", rank).where("rank = 1").select(*pair, "n_windows", "off", "item_at", "doc_at"))
    merged = agreed(chosen, slots.join(chosen.select(*pair, "off", "item_at"), [*pair, "off", "item_at"], "left_semi"), pair)
    figures = ["n_windows", "n_hit", "n_slots", "n_consistent"]
    out = occurrences.select(*pair, *figures).unionByName(merged.select(*pair, *figures)).where(F.col("n_hit") >= cover * F.col("n_windows"))
    best = F.max(F.struct((F.col("n_hit") / F.col("n_windows")).alias("part"), *figures)).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[f"best.{x}" for x in figures])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document: doc_id, contaminated, n_items, item_ids (sorted), best_cover."""
    found = matches(docs, benchmark, **options)
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("n_hit") / F.col("n_windows")).alias("best_cover"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(each, "doc_id", "left")
    return out.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("best_cover", F.lit(0.0)).alias("best_cover"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark item.

    Null and empty texts and rows with a null id stay; of rows of one id all go if one of their texts holds
    an item; repeated rows stay or go together; extra columns pass through, whatever their names.
    """
    found = matches(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, docs.doc_id.cast("long") == found.doc_id, "left_anti")


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
