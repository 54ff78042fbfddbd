"""Benchmark decontamination by template windows, with DataFrame operations only.

Texts become templates: words are runs of letters and numbers, lower-cased, and numbers, names (capitalised
words, at the start of a sentence too: the slot check tells) and units after a number turn into typed
placeholders. Windows of
`window` words are hash-joined between benchmark and documents: every window on its template, and, as
slots may differ in case or be too many to tell, on its plain words. A document holds an item
when it holds at least `coverage` of the item's windows, more than that share of its words inside matched
windows, or `run_words` of its words in a row, and when the values in the slots are
consistent: on one alignment, equal item values stand for equal document values and the reverse. So a
question with other numbers or names is caught, and a passage that merely has the same shape isn't.

Items shorter than a window are matched whole; those of 11 words or more in which one changed word can
break every window have windows of `short_window` words. Items of fewer than `least_words` words are skipped,
as they can't be told from chance. Windows with fewer than half plain words match on their plain words
only; coverage is over all windows, or over those that templates can match, whichever is more. What the
plain words alone cover needs no slot check. Results go by the text: equal texts get equal results. Null and empty texts hold nothing.

Scale: documents are scanned in place, once for all windows; their windows aren't shuffled as long as
the benchmark's windows number at most `broadcast_rows` rows of about 70 bytes (the bound of the
broadcast), else both sides are shuffled on the window's hash. Slots are looked up only for texts with
a hit on a window that has slots.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import free_name, let, written

#: A number with its separators, or a run of letters.
WORDS = r"\p{N}+(?:[.,:/-]\p{N}+)*|[\p{L}\p{M}]+"
#: Unit words that become a placeholder after a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l gal s sec min h hr hours minutes seconds days weeks months years meters metres kilometers kilometres miles grams kilograms liters litres percent dollars euros cents degrees mph kph".split()
NUM, NAMED, UNIT = "⟦num⟧", "⟦name⟧", "⟦unit⟧"
SLOTS = (NUM, NAMED, UNIT)


@dataclass(frozen=True)
class TemplateSettings:
    window: int = 8
    coverage: float = 0.5
    run_words: int = 13
    short_window: int = 5
    least_words: int = 5
    broadcast_rows: int = 2_000_000


def raw_words(text: str) -> Column:
    """The words as they stand."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))


def plain_words(raw: Column) -> Column:
    return F.transform(raw, lambda w: F.lower(w))


def template_words(raw: Column, plain: Column) -> Column:
    """The template, word by word, of raw_words and plain_words."""

    def number(w: Column) -> Column:
        return F.ascii(w).between(48, 57) | ((F.ascii(w) > 127) & w.rlike(r"^\p{N}"))

    def slot(low: Column, i: Column) -> Column:
        after = F.substring(F.get(raw, i), 2, 1)
        measured = low.isin(UNITS) & F.coalesce(number(F.get(plain, i - 1)), F.lit(False))
        named = (low != F.get(raw, i)) & (after != F.upper(after))
        return F.when(measured, UNIT).when(named, NAMED).when(number(low), NUM).otherwise(low)

    return F.transform(plain, slot)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hash(hashes: Column, at: Column, size: int, exact: bool) -> Column:
    """The hash of the window of that size at index `at`."""
    return F.xxhash64(F.lit(size), F.lit(exact), *[F.get(hashes, at + k) for k in range(size)])


def item_window(n: Column, settings: TemplateSettings) -> Column:
    """The window of an item of n words: with one word changed, a shorter one still lies beside it."""
    short = (n > 2 * settings.short_window) & (n <= 2 * settings.window)
    return F.when(short, F.least(F.lit(settings.short_window), F.lit(settings.window))).otherwise(F.least(n, F.lit(settings.window)))


def benchmark_windows(items: DataFrame, key: str, text: str, settings: TemplateSettings) -> DataFrame:
    """(item_id, size, ipos, hash, slots, exact, n_windows, n_light) of every window of every item: on its plain
    words (exact), and on its template if slots aren't more than plain words (light)."""
    words = items.select(F.col(key).alias("item_id"), raw_words(text).alias("raw")).where(F.size("raw") >= settings.least_words)
    words = words.withColumn("low", plain_words(F.col("raw"))).withColumn("words", template_words(F.col("raw"), F.col("low"))).withColumn("size", item_window(F.size("raw"), settings)).withColumn("n_windows", F.size("raw") - F.col("size") + 1)
    in_window = lambda held, i: F.size(F.filter(F.slice(held, i, F.col("size")), lambda w: w.isin(*SLOTS))).cast("int")
    slots = let(F.col("words"), lambda held: F.transform(F.sequence(F.lit(1), F.col("n_windows")), lambda i: in_window(held, i)))
    words = words.withColumn("slots", slots).withColumn("n_light", F.size(F.filter("slots", lambda n: 2 * n <= F.col("size"))))
    words = words.withColumn("plain", word_hashes(F.col("low"))).withColumn("template", word_hashes(F.col("words")))
    at = words.select("item_id", "size", "n_windows", "n_light", "plain", "template", F.posexplode("slots").alias("p", "slots"))
    of_size = lambda c, exact: reduce(lambda rest, n: F.when(F.col("size") == n, window_hash(F.col(c), F.col("p"), n, exact)).otherwise(rest), range(settings.least_words, settings.window + 1), F.lit(None))
    exact = at.withColumn("hash", of_size("plain", True)).withColumn("exact", F.lit(True))
    light = at.where(2 * F.col("slots") <= F.col("size")).withColumn("hash", of_size("template", False)).withColumn("exact", F.lit(False))
    return exact.unionByName(light).select("item_id", "size", (F.col("p") + 1).alias("ipos"), "hash", "slots", "exact", "n_windows", "n_light")


def find_items(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", settings: TemplateSettings | None = None) -> DataFrame:
    """(text_hash, item_id, n_windows, item_windows, coverage, n_slots, changed_slots): the items that
    each text holds, by xxhash64 of the text."""
    settings = settings or TemplateSettings()
    bench = written(benchmark_windows(items, item_key, item_text, settings), "benchmark-windows")
    n, sizes = bench.count(), sorted(r[0] for r in bench.select("size").distinct().collect())  # at most `window` sizes
    docs = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    if not sizes:
        empty = "text_hash long, item_id long, n_windows long, item_windows long, coverage double, n_slots long, changed_slots long"
        return df.sparkSession.createDataFrame([], empty)
    low = docs.select("text_hash", raw_words("text").alias("raw")).select("text_hash", "raw", plain_words(F.col("raw")).alias("low"))
    hashed = low.select("text_hash", word_hashes(F.col("low")).alias("plain"), word_hashes(template_words(F.col("raw"), F.col("low"))).alias("template"))
    # windows are hashed after the words stand in rows of their own, in compiled code
    at = hashed.select("text_hash", "plain", "template", F.size("plain").alias("n"), F.posexplode("plain").alias("p", "word"))
    kinds = [(c, n, c == "plain") for n in sizes for c in ("plain", "template")]
    every = F.array(*[F.when(F.col("p") + n <= F.col("n"), window_hash(F.col(c), F.col("p"), n, exact)) for c, n, exact in kinds])
    rows = at.select("text_hash", (F.col("p") + 1).alias("dpos"), F.explode(every).alias("hash")).where("hash is not null")
    hits = rows.join(F.broadcast(bench) if n <= settings.broadcast_rows else bench, "hash").select("text_hash", "item_id", "dpos", "ipos", "size", "slots", "exact", F.col("n_windows").alias("item_windows"), "n_light")
    hits = written(hits.distinct(), "template-hits")
    cover = covered(hits, settings)
    slotted = hits.where("slots > 0").join(cover.select("text_hash", "item_id"), ["text_hash", "item_id"], "left_semi")
    if slotted.isEmpty():
        return cover.withColumn("n_slots", F.lit(0).cast("long")).withColumn("changed_slots", F.lit(0).cast("long"))
    checked = slot_check(docs, items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")), slotted, settings)
    best = cover.join(checked, ["text_hash", "item_id"], "left")
    plain = covered(hits.where("exact"), settings).select("text_hash", "item_id", F.lit(True).alias("plain"))
    best = best.join(plain, ["text_hash", "item_id"], "left").where("consistent is null or consistent or plain")
    return best.drop("consistent", "plain").fillna(0, ["n_slots", "changed_slots"])


def covered(hits: DataFrame, settings: TemplateSettings) -> DataFrame:
    """(text_hash, item_id, n_windows, item_windows, coverage) of the items that hits cover enough of."""
    light = F.countDistinct(F.when(2 * F.col("slots") <= F.col("size"), F.col("ipos")))
    cover = hits.groupBy("text_hash", "item_id").agg(F.countDistinct("ipos").alias("n_windows"), F.max("item_windows").cast("long").alias("item_windows"), light.alias("light"), F.max("n_light").alias("n_light"), F.max("size").alias("size"))
    # words: each window adds those that the one before it doesn't hold; runs: windows next to each other on one alignment
    shift = F.col("dpos") - F.col("ipos")
    own = ("text_hash", "item_id")
    places = hits.select(*own, "ipos", "size").distinct()
    before = F.lag("ipos").over(Window.partitionBy(*own).orderBy("ipos"))
    words = places.withColumn("new", F.coalesce(F.least("size", F.col("ipos") - before), "size")).groupBy(*own).agg(F.sum("new").alias("words"))
    lined = hits.select(*own, "ipos", "size", shift.alias("shift")).distinct()
    lined = lined.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*own, "shift").orderBy("ipos")))
    longest = lined.groupBy(*own, "shift", "run").agg((F.count("*") + F.max("size") - 1).alias("run_words")).groupBy(*own).agg(F.max("run_words").alias("run_words"))
    cover = cover.join(words.join(longest, [*own]), [*own])
    share = F.greatest(F.col("n_windows") / F.col("item_windows"), F.when(F.col("n_light") > 0, F.col("light") / F.col("n_light")))
    held = F.col("words") / (F.col("item_windows") + F.col("size") - 1)
    enough = (share >= settings.coverage) | (held > settings.coverage) | (F.col("run_words") >= settings.run_words)
    return cover.where(enough).withColumn("coverage", F.greatest(share, held)).select(*own, "n_windows", "item_windows", "coverage")


def slot_check(docs: DataFrame, items: DataFrame, slotted: DataFrame, settings: TemplateSettings) -> DataFrame:
    """(text_hash, item_id, n_slots, changed_slots, consistent) over the slots inside matched windows;
    an item is consistent if it is on any alignment."""
    words = lambda df, key: df.select(key, raw_words("text").alias("raw")).withColumn("low", plain_words(F.col("raw")))
    zipped = F.arrays_zip(template_words(F.col("raw"), F.col("low")).alias("kind"), F.col("low").alias("value"))
    values = lambda df, key: words(df, key).select(key, F.posexplode(zipped).alias("p", "w")).where(F.col("w.kind").isin(*SLOTS)).select(key, (F.col("p") + 1).alias("pos"), "w.kind", "w.value")
    own = values(items, "item_id").withColumnsRenamed({"pos": "at", "value": "item_value"})
    touched = slotted.select("text_hash").distinct()
    few = touched.count() <= settings.broadcast_rows
    there = values(docs.join(F.broadcast(touched) if few else touched, "text_hash", "left_semi").dropDuplicates(["text_hash"]), "text_hash")
    lined = slotted.select("text_hash", "item_id", (F.col("dpos") - F.col("ipos")).alias("shift"), F.explode(F.expr("sequence(ipos, ipos + size - 1)")).alias("at")).distinct()
    pairs = lined.join(own, ["item_id", "at"]).withColumn("pos", F.col("at") + F.col("shift")).join(there.withColumnRenamed("kind", "doc_kind"), ["text_hash", "pos"]).where("kind = doc_kind")
    per = pairs.groupBy("text_hash", "item_id", "shift").agg(
        F.count("*").alias("n_slots"), F.sum((F.col("item_value") != F.col("value")).cast("long")).alias("changed_slots"),
        F.countDistinct("kind", "item_value", "value").alias("n_pairs"), F.countDistinct("kind", "item_value").alias("n_item"), F.countDistinct("kind", "value").alias("n_doc"),
    )
    per = per.withColumn("consistent", (F.col("n_pairs") == F.col("n_item")) & (F.col("n_pairs") == F.col("n_doc")))
    best = F.max_by(F.struct("n_slots", "changed_slots", "consistent"), F.struct("consistent", "n_slots", -F.col("changed_slots"), "shift")).alias("best")
    return per.groupBy("text_hash", "item_id").agg(best).select("text_hash", "item_id", "best.*")


def contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", settings: TemplateSettings | None = None, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = find_items(df, items, text, item_key, item_text, settings)
    return df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash")).join(found, "text_hash").drop("text_hash")


def without_benchmark(df: DataFrame, items: DataFrame, text: str = "text", settings: TemplateSettings | None = None) -> DataFrame:
    """The rows of df whose text holds no item."""
    hashed = free_name(df, "text_hash")
    bad = find_items(df, items, text, settings=settings).select(F.col("text_hash").alias(hashed)).distinct()
    return df.join(bad, F.xxhash64(text) == F.col(hashed), "left_anti")
