"""Collocations: the phrases of each language that occur more often than their parts lead one to expect.

Frequent phrases are mined by partitioning (SON). A task cuts its rows into shards of bounded size and
mines each shard completely at a local support lowered in proportion to the shard's share of its
language's words. A phrase below the local support in every shard can't reach the support, so the union
of what the shards report misses nothing; a second scan counts the whole union exactly in all shards.
Where every share is so small that the local support is one, the shards report all they hold, their
counts already add up to the exact ones and the second scan is left out.

At a support of one, partitioning alone prunes nothing. Mining therefore goes by length: a phrase is looked
at only where both of its shorter parts are frequent in the whole corpus. The frequent parts reach the
tasks as a bit table of fixed size (`filter_bits`); if it fills up with a larger corpus, phrases pass
that needn't, their counts are exact all the same, and those below the support are left out by Spark.

Words are kept apart inside a shard by 64-bit hashes, and everywhere else as text. Null texts have no
words, a null language is `und`, repeated rows count again, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import discard, written
from .wordhash import LOWERED, U, mix, row_ranges, runs, span_hashes, utf8

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


@dataclass(frozen=True)
class PhraseRules:
    max_words: int = 4
    support: int = 30
    keep: int = 2000  # phrases returned for each language
    cover_percent: int = 80  # a phrase goes where a longer one that holds it has this share of its count
    shard_bytes: int = 4 << 20  # text that is mined at once
    filter_bits: int = 1 << 26


def _lang_seeds(langs: pa.Array) -> np.ndarray:
    data, offsets = utf8(langs)
    h = np.zeros(len(langs), np.uint64)
    held = np.diff(offsets) > 0
    h[held] = span_hashes(data, offsets[:-1][held], offsets[1:][held], np.arange(256, dtype=np.uint8))
    return mix(h + U(0x632BE59BD9B4E019))


class Shard:
    """The words of some rows: hash with the language, piece, span and row of each."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        self.data, offsets = utf8(texts)
        self.starts, self.ends = runs(_INSIDE[self.data], offsets)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.words = mix(span_hashes(self.data, self.starts, self.ends, LOWERED) ^ _lang_seeds(langs)[self.row])
        breaks = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_BREAK[self.data], out=breaks[1:])
        new = np.ones(len(self.words), bool)
        new[1:] = (breaks[self.starts[1:]] != breaks[self.ends[:-1]]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(new)
        self.langs = langs

    def hashes(self, size: int, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = h * U(0xD1342543DE82EF95) + self.words[at + k]
        return mix(h + U(size))

    def starts_of(self, size: int) -> np.ndarray:
        """Where phrases of that many words start: all their words lie in one piece."""
        last = np.arange(len(self.words) - size + 1)
        return last[self.piece[last] == self.piece[last + size - 1]] if len(last) else last

    def local_supports(self, lowered: dict[str, tuple[int, int]], support: int) -> np.ndarray:
        """The local support for each row: the support times this shard's share of the words of the row's language,
        at most the language's largest (`lowered` holds that and all its words), one for other languages."""
        names = self.langs.dictionary_encode()
        code = names.indices.to_numpy()
        here = np.bincount(code[self.row], minlength=len(names.dictionary)).tolist()
        need = [min(most, -(-support * n // total)) if (held := lowered.get(x)) and (most := held[0]) and (total := held[1]) else 1 for x, n in zip(names.dictionary.to_pylist(), here, strict=True)]
        return np.array(need, np.int64)[code]

    def phrases(self, size: int, at: np.ndarray, need: np.ndarray | None) -> pa.RecordBatch:
        """(lang, phrase, n) of the distinct phrases of that many words that start at `at`, from their row's local support on."""
        _, first_word, ids = np.unique(self.words, return_index=True, return_inverse=True)
        code = ids[at]
        for k in range(1, size):
            if k > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code * max(len(first_word), 1) + ids[at + k]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        begin = at[first]
        langs = self.langs.take(pa.array(self.row[begin]))
        if need is not None:
            kept = n >= need[self.row[begin]]
            begin, n, langs = begin[kept], n[kept], langs.filter(pa.array(kept))
        used = np.unique(ids[(begin[:, None] + np.arange(size)).ravel()]) if len(begin) else np.zeros(0, np.int64)
        low = LOWERED[self.data].tobytes()
        spans = zip(self.starts[first_word[used]].tolist(), self.ends[first_word[used]].tolist(), strict=True)
        words = pa.array([low[a:b] for a, b in spans], pa.binary()).cast(pa.string())
        parts = [words.take(pa.array(np.searchsorted(used, ids[begin + k]))) for k in range(size)]
        phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
        return pa.RecordBatch.from_arrays([langs, phrase, pa.array(n)], names=["lang", "phrase", "n"])


def _shards(batches, limit: int):
    """Shards of about `limit` bytes of text, across the batches of a task; a longer row is a shard of its own."""
    waiting, size = [], 0
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for lo, hi in row_ranges(offsets, limit):
            n = int(offsets[hi] - offsets[lo])
            if waiting and size + n > limit:
                yield Shard(*(pa.concat_arrays([b.column(i) for b in waiting]) for i in (0, 1)))
                waiting, size = [], 0
            waiting.append(batch.slice(lo, hi - lo))
            size += n
    if waiting:
        yield Shard(*(pa.concat_arrays([b.column(i) for b in waiting]) for i in (0, 1)))


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot, bit = _bit_of(h, 64 * len(table))
    return (table[slot] >> bit) & U(1) > 0


def _bit_of(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = h & U(n_bits - 1)
    return (at >> U(6)).astype(np.int64), at & U(63)


def _mined(docs: DataFrame, size: int, rules: PhraseRules, lowered: dict[str, tuple[int, int]], table=None, part: int = 0) -> DataFrame:
    """(lang, phrase, n, most): sums over shards of the phrases of `size` words and the largest count in a shard. With a
    bit table, only phrases all of whose parts of `part` words pass. Phrases of one word come with a row
    of each language without a phrase: its words."""
    limit = rules.shard_bytes

    def mined(batches):
        for shard in _shards(batches, limit):
            at = shard.starts_of(size)
            for k in range(size - part + 1 if table is not None else 0):
                at = at[_passes(table.value, shard.hashes(part, at + k))]
            found = shard.phrases(size, at, shard.local_supports(lowered, rules.support) if lowered else None)
            for lo in range(0, found.num_rows, 50_000):
                yield found.slice(lo, 50_000)
            if size == 1 and found.num_rows:
                sums = pa.table(found).group_by("lang").aggregate([("n", "sum")])
                yield pa.RecordBatch.from_arrays([sums["lang"].combine_chunks(), pa.nulls(len(sums), pa.string()), sums["n_sum"].combine_chunks()], names=["lang", "phrase", "n"])

    return docs.mapInArrow(mined, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


def _bit_table(phrases: DataFrame, size: int, rules: PhraseRules) -> np.ndarray:
    """The bits of all phrases: at most filter_bits / 64 rows of 64 bits come to the driver, whatever the corpus."""

    def marked(batches):
        for b in batches:
            shard = Shard(b.column(0), b.column(1))
            h = shard.hashes(size, np.flatnonzero(np.diff(shard.row, prepend=-1)))
            slot, bit = _bit_of(h, rules.filter_bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((U(1) << bit).view(np.int64))], names=["slot", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(marked, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(rules.filter_bits // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(df: DataFrame, rules: PhraseRules | None = None, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counts, totals): lang, phrase, size and n of every phrase of up to max_words words with n >= support, and
    lang and n of all words."""
    rules = rules or PhraseRules()
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    words = written(_mined(docs, 1, rules, {}).where(F.col("phrase").isNull() | (F.col("n") >= rules.support)), "words")
    totals = words.where(F.col("phrase").isNull())
    # the largest local support that any shard of a language has; languages beyond the thousand largest are mined at one
    shares = totals.orderBy(F.desc("n"), "lang").limit(1000).collect()
    lowered = {r["lang"]: (s, r["n"]) for r in shares if (s := -(-rules.support * r["most"] // r["n"])) > 1}
    frequent = words.where(F.col("phrase").isNotNull()).select("lang", "phrase", "n")
    levels = [frequent.withColumn("size", F.lit(1))]
    for size in range(2, rules.max_words + 1):
        bits = _bit_table(frequent, size - 1, rules)
        if not bits.any():
            break
        table = spark.sparkContext.broadcast(bits)
        enough = F.col("n") >= rules.support
        if lowered:
            union = written(_mined(docs, size, rules, lowered, table, size - 1).where(F.col("lang").isin(list(lowered)) | enough), "union")
            own = spark.sparkContext.broadcast(_bit_table(union, size, rules))
            found = written(_mined(docs, size, rules, {}, own, size).where(enough).select("lang", "phrase", "n"), "phrases")
            discard(union)
        else:
            found = written(_mined(docs, size, rules, {}, table, size - 1).where(enough).select("lang", "phrase", "n"), "phrases")
        levels.append(found.withColumn("size", F.lit(size)))
        frequent = found
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    return counts, totals.select("lang", "n")


def _below(phrase: str, size: str, least: int) -> Column:
    """All parts of a phrase of `least` words or more that are shorter than it."""
    words, n = F.split(phrase, " "), F.col(size)
    by_length = F.transform(F.sequence(F.lit(least), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.when(n > least, F.array_distinct(F.flatten(by_length)))


def collocations(df: DataFrame, rules: PhraseRules | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language. a counts the phrase, l and r the
    parts of its weakest cut, n the language's words; score = floor(2000000 a / (l + r))."""
    rules = rules or PhraseRules()
    counts, totals = frequent_phrases(df, rules, lang, text)
    phrases = counts.where("size > 1")
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "size", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    # the parts of a frequent phrase are frequent themselves, so every part has its count
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    longer = phrases.where("size > 2").select("lang", "n", F.explode(_below("phrase", "size", 2)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    left = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * big("longer") < rules.cover_percent * big("a")))
    # the best of each of a few parts of a language, then the best of those: no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(16))
    best = left.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= rules.keep)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= rules.keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
