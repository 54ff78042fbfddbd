"""Mixing sources to target weights, with DataFrame operations only.

The words of a source, in a pseudorandom document order, are packed into blocks of a fixed number of
words. The mix is a row of slots, `shard_slots` to an output shard. Every slot draws its source, so
the source counts of a shard are multinomial; draws of a source beyond its share of slots go to the
sources that are short, so each source fills exactly the slots that its target calls for. The k-th
slot of a source takes block p(k mod n) of its n blocks, where p is a pseudorandom permutation of
0..n-1, a new one for each pass over the source; blocks are then joined by index.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share the total size;
a target stops at `most_passes` times its source's size, and the excess is shared anew by weight
among the others.

Scale: a document is one short row until its pieces are cut. Offsets within a source are running
sums in hash buckets of a bounded number of rows plus running sums of the bucket totals, by stretches of
buckets, so a hot source is spread over many tasks. The text is shuffled once, to the list of pieces that
the mix takes of it, and cut there; a text that very many rows hold is copied to several tasks. Nothing
that grows with the documents is collected or broadcast.

Nulls and empties: a null text has size 0, is never taken and stays in the counts; a null source is
a source; a repeated row is taken as often as it occurs. Rows that agree in id, source and text share
their other columns in the mix; a column named shard or slot gives way to that of the mix. Everything is a function of the rows and
the seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD, let, written


@dataclass(frozen=True)
class MixSettings:
    block_words: int = 1024
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most_passes: int = 3
    shard_slots: int = 4096
    bucket_rows: int = 1024
    stretch: int = 4096
    copies_a_task: int = 10_000
    rounds: int = 24
    seed: int = 20240607


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, settings: MixSettings) -> DataFrame:
    """sizes has one row per source (source, source_size); adds sid, weight, target, n_blocks, n_slots
    and the first slot number of the source."""
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    # one row per source, so these orderings over all rows are short
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("source_size") * float(settings.most_passes)
    rows = sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("int"))
    rows = rows.withColumn("weight", F.get(weights, F.col("sid") % len(settings.weights))).withColumn("ratio", most / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    # the first source, by ratio, whose share fits under its bound sets the level for all after it
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"]
    rows = rows.withColumn("target", F.least(most, F.coalesce(settled, F.lit(0.0)) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / settings.block_words).cast("long")
    rows = rows.withColumn("n_blocks", blocks)
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("n_slots", slots)
    first = F.coalesce(F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("first_slot", first).select("source", "source_size", "sid", "target", "n_blocks", "n_slots", "first_slot")


def running_sum(rows: DataFrame, place: str, value: str, out: str, settings: MixSettings) -> DataFrame:
    """rows (sid, place, value and more, one for each sid and place) with the sum of value over lower places of the sid.
    Places are summed by stretches first, so no task orders all of a source's."""
    rows = rows.withColumn("stretch", F.floor(F.col(place) / settings.stretch))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "stretch").agg(F.sum(value).alias("total"))
    sums = sums.select("sid", "stretch", F.coalesce(F.sum("total").over(before("sid", "stretch")), F.lit(0)).alias("lower"))
    inside = rows.withColumn("within", F.coalesce(F.sum(value).over(before("sid", "stretch", place)), F.lit(0)))
    return inside.join(sums, ["sid", "stretch"]).withColumn(out, F.col("lower") + F.col("within")).drop("stretch", "lower", "within")


def _owner(rows: DataFrame, value: str, parts: DataFrame, total: int, cells: int = 1024) -> DataFrame:
    """rows joined with the row of parts (from, to) whose range of 0..total-1 holds the value: by the
    cell of the value, so that the join is on equality."""
    width = max(1, -(-total // cells))
    cut = parts.where("to > from").withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))))
    return rows.withColumn("cell", F.floor(F.col(value) / width)).join(cut, "cell").where((F.col(value) >= F.col("from")) & (F.col(value) < F.col("to"))).drop("cell", "from", "to")


def permuted(index: Column, n: Column, keys: list[Column], settings: MixSettings) -> Column:
    """Where a pseudorandom permutation of 0..n-1 takes index: swap-or-not rounds, exact for every n."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(settings.seed), *keys, r), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit(settings.seed + 1), *keys, r, F.greatest(x, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(settings.rounds)), index, step)


def slot_plan(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """(shard, slot, sid, pass, block): which block of which source each slot of the mix takes."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    own = sources.select("sid", F.col("first_slot").alias("from"), (F.col("first_slot") + F.col("n_slots")).alias("to"))
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("shard", F.floor(F.col("slot") / settings.shard_slots))
    slots = slots.withColumn("draw", F.pmod(F.xxhash64(F.lit(settings.seed + 2), "slot"), F.lit(max(1, total))))
    drawn = _owner(slots, "draw", own, total).select("shard", "slot", "sid")
    counts = written(drawn.groupBy("shard", "sid").agg(F.count("*").alias("c")), "mix-counts")
    base = running_sum(counts, "shard", "c", "base", settings)
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1)
    numbered = ranked.join(base.select("shard", "sid", "base"), ["shard", "sid"]).withColumn("k", F.col("base") + F.col("rank"))
    # draws beyond a source's slots, numbered across sources, and the sources that are short of slots
    sums = counts.groupBy("sid").agg(F.sum("c").alias("drawn"))
    state = sources.select("sid", "n_slots", "n_blocks").join(sums, "sid", "left").fillna(0, ["drawn"])
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, short = F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))
    state = written(
        state.withColumn("over_from", F.coalesce(F.sum(over).over(before), F.lit(0)).cast("long")).withColumn("from", F.coalesce(F.sum(short).over(before), F.lit(0)).cast("long")).withColumn("to", F.col("from") + short),
        "mix-state",
    )
    moved_total = state.agg(F.max("to")).first()[0] or 0
    known = numbered.join(state.select("sid", "n_slots", "over_from"), "sid")
    stays = known.where("k < n_slots").select("shard", "slot", "sid", "k")
    excess = known.where("k >= n_slots").select("shard", "slot", (F.col("over_from") + F.col("k") - F.col("n_slots")).alias("rank"))
    takers = state.select("sid", "drawn", "from", "to", F.col("from").alias("begin"))
    moved = _owner(excess, "rank", takers, moved_total).select("shard", "slot", "sid", (F.col("drawn") + F.col("rank") - F.col("begin")).alias("k"))
    plan = stays.unionByName(moved).join(state.select("sid", "n_blocks"), "sid")
    turn = F.floor(F.col("k") / F.col("n_blocks"))
    plan = plan.withColumn("pass", turn).withColumn("block", permuted(F.pmod("k", "n_blocks"), F.col("n_blocks"), [F.col("sid"), turn], settings))
    return plan.select("shard", "slot", "sid", "pass", "block")


def placed_documents(df: DataFrame, key: str, source: str, size: Column, settings: MixSettings, extra: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): documents has doc_id, sid, size, source_size, target and start, the number
    of words of the source before it."""
    sized = written(df.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), *(extra or [])), "mix-sizes")
    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), settings), "mix-sources")
    n = sized.count()
    bits = max(0, (n // settings.bucket_rows).bit_length())
    known = sized.join(sources.select("source", "sid", "source_size", "target"), sized["source"].eqNullSafe(sources["source"])).drop("source")
    known = known.withColumn("h", F.xxhash64(F.lit(settings.seed + 3), "doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = running_sum(sums, "bucket", "words", "base", settings).drop("words")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", *[c for c in known.columns if c == "ref"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
    return placed.withColumn("start", F.col("base") + F.col("local")).drop("h", "bucket", "base", "local"), sources


def pieces(placed: DataFrame, settings: MixSettings) -> DataFrame:
    """placed, once for each block that the document reaches: block, and the words from..to of the document."""
    width = settings.block_words
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))))
    begin = F.greatest(F.col("block") * width - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * width - F.col("start"), F.col("size"))
    return cut.withColumn("from", begin.cast("long")).withColumn("to", end.cast("long"))


def mix_counts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: MixSettings | None = None) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken: the words of the document in the mix."""
    settings = settings or MixSettings()
    placed, sources = placed_documents(df, key, source, n_words(text), settings)
    placed = written(placed, "mix-placed")
    times = slot_plan(sources, settings).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = pieces(placed, settings).join(times, ["sid", "block"], "left").groupBy("sid", "start", "doc_id", "size", "source_size", "target")
    taken = taken.agg(F.sum(F.coalesce("times", F.lit(0)) * (F.col("to") - F.col("from"))).alias("taken"))
    names = ("doc_id", "size", "source_size", "target", "taken")
    return taken.select(*names).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*names))


def mix_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: MixSettings | None = None) -> DataFrame:
    """The mix itself: df's columns, one row for each piece of a document in each slot that takes it,
    with the piece as its text (a word keeps the white space after it), and shard and slot."""
    settings = settings or MixSettings()
    ref = F.xxhash64(*[F.col(c) for c in (key, source, text)])
    placed, sources = placed_documents(df, key, source, n_words(text), settings, [ref.alias("ref")])
    plan = slot_plan(sources, settings).select("sid", "block", "shard", "slot")
    # of each row, what the mix takes: as much as its length and the passes allow
    taken = pieces(placed.select("ref", "sid", "start", "size"), settings).join(plan, ["sid", "block"])
    taken = taken.groupBy("ref", "sid", "start").agg(F.collect_list(F.struct("from", "to", "shard", "slot")).alias("takes")).select("ref", "takes")
    taken = written(taken, "mix-takes")
    # equal rows share their text: it is joined from one of them, or from copies of it if very many take it
    texts = df.select(ref.alias("ref"), F.struct(*df.columns).alias("row")).dropDuplicates(["ref"])
    many = written(taken.groupBy("ref").agg(F.ceil(F.count("*") / settings.copies_a_task).cast("int").alias("copies")).where("copies > 1"), "mix-common")
    if many.isEmpty():
        cut = taken.join(texts, "ref")
    else:
        copied = texts.join(many, "ref").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        dealt = taken.join(many, "ref").withColumn("copy", F.pmod(F.xxhash64("takes"), "copies").cast("int")).drop("copies")
        cut = taken.join(many, "ref", "left_anti").join(texts, "ref").select("takes", "row").unionByName(dealt.join(copied, ["ref", "copy"]).select("takes", "row"))
    listed = F.regexp_extract_all(F.col("row")[text], F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def piece(words: Column, take: Column) -> Column:
        held = F.array_join(F.slice(words, take["from"].cast("int") + 1, (take["to"] - take["from"]).cast("int")), "")
        return F.struct(held.alias("text"), take["shard"].alias("shard"), take["slot"].alias("slot"))

    cut = cut.select("row", F.explode(let(listed, lambda words: F.transform("takes", lambda take: piece(words, take)))).alias("piece"))
    kept = [F.col("piece.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns if c.lower() not in ("shard", "slot")]
    return cut.select(*kept, "piece.shard", "piece.slot")
