"""Operator 7: mix sources to target weights, with DataFrame functions only.

The words of a source, its documents in pseudorandom order, are one stream cut into blocks of
fixed length.  A target becomes a number of slots; every slot falls into an output shard by
its hash, so the counts of a shard are a multinomial draw, conditioned on each source reaching
its target.  Slot ``j`` of a source with ``n`` blocks takes block ``p(j mod n)``, ``p`` a permutation of its
own for each turn ``j div n``, so no block is taken twice before all are taken once; slots and blocks
then meet by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.text import id_of, null_id
from emberlog.session import scratch

BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
#: Parts a source's documents are ordered in; none holds more than its share of a hot source.
ORDER_PARTS = 1024
#: Rounds of the swap-or-not shuffle that makes the permutations.
ROUNDS = 16
_BLANKS = " \t\n\x0b\x0c\r"
_WORD_RUN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: each becomes one letter, what is left at the end is white space."""
    letters = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _WORD_RUN, "x")
    return F.length(F.rtrim(letters, F.lit(_BLANKS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` times all
    words; a target stops at ``most`` times its source and the excess goes to the others by
    weight.  Sources by (most words per weight) ascending: those that stop come first, so one
    running sum finds where the level lies.  One row per source is all that meets here.
    """
    named = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rank = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.col("source_size") * F.lit(float(most))
    )
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.encode("source", "UTF-8"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(
        F.sum("limit").over(before), F.lit(0.0)
    )
    level = left / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") < F.col("limit")
    )
    # The first source that does not stop fixes the level of all behind it.
    at = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.coalesce(F.least(F.col("limit"), at * F.col("weight")), F.col("limit"))
    return leveled.select("source", "source_size", target.alias("target"))


def placed(sized: DataFrame, seed: int) -> DataFrame:
    """(doc, source, size, start) from (doc, source, size): where each document's words begin in its source's stream."""
    sized = sized.withColumn("mark", F.xxhash64(F.lit(seed), "doc"))
    sized = sized.withColumn("part", F.pmod("mark", F.lit(ORDER_PARTS)))
    totals = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "source", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("source", "part").orderBy("mark", "doc", "size")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = sized.withColumn("inside", inside - F.col("size")).alias("d")
    o = offsets.alias("o")
    same = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.part") == F.col("o.part"))
    return own.join(o, same).select(
        "d.doc", "d.source", "d.size", (F.col("d.inside") + F.col("o.offset")).alias("start")
    )


def permuted(index: Column, count: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 … count - 1, one for each ``key``: every round pairs each number
    with its mirror image and a hash of the pair decides whether they change places."""

    def swap(x: Column, turn: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("mirror"), turn, *key), count) - x, count)
        coin = F.xxhash64(F.lit("coin"), turn, F.greatest(x, mirror), *key)
        return F.when(coin % 2 == 0, x).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def slots(wanted: DataFrame, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """(shard, source, slot, block) for every slot of the mix, from (source, source_size, target)."""
    blocks = F.ceil(F.col("source_size") / block_words)
    # In proportion to the blocks, as the last one of a source may be short.
    count = F.round(F.col("target") / F.col("source_size") * blocks).cast("long")
    shards = F.greatest(
        F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / shard_words)
    ).cast("long")
    plan = wanted.where("source_size > 0").select(
        "source", blocks.cast("long").alias("blocks"), count.alias("slots"), shards.alias("shards")
    ).where("slots > 0")
    # Numbers are made in two steps, so that no row holds a list of all slots of a source.
    step = F.greatest(F.lit(1024), F.ceil(F.sqrt("slots"))).cast("long")
    plan = plan.withColumn("step", step)
    runs = plan.withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.col("step")))
    )
    # A few rows that become many: so many tasks are asked for, as their size would not say so.
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(tasks, "source", "first")
    last = F.least(F.col("first") + F.col("step"), F.col("slots")) - 1
    numbered = runs.withColumn("slot", F.explode(F.sequence("first", last)))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    block = permuted(
        F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source"), turn
    )
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source", "slot"), F.col("shards"))
    return numbered.select(shard.alias("shard"), "source", "slot", block.alias("block"))


def pieces(where: DataFrame, block_words: int) -> DataFrame:
    """(source, block, doc, start, size, at, words): the parts of documents that make up each
    block; ``at`` is the first word of the part inside its document."""
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = where.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return parts.select(
        "source", "block", "doc", "start", "size",
        (begin - F.col("start")).alias("at"), (end - begin).alias("words"),
    )


def _merged(left: DataFrame, right: DataFrame, same: Column, how: str = "inner") -> DataFrame:
    """A join that never broadcasts: slots are numbered from a few rows, and the planner would
    take them for as few."""
    return left.hint("merge").join(right.hint("merge"), same, how)


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 7,
) -> DataFrame:
    """The mix as parts of documents: (shard, source, slot, part, id_col, at, words) says that words
    ``at`` to ``at + words`` of the document are part ``part`` of a slot; see ``mixed_texts`` for the words.

    A null text has no words and a null source is a source of its own, the last one.  A null id
    counts as the largest id.  Repeated rows are documents of their own.  Other columns of ``docs``
    are not read, whatever their names; an empty table gives an empty mix.  The same rows and
    seed give the same mix, however they are partitioned.
    """
    where, wanted = _plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    mixed = _mixed(where, wanted, block_words, shard_words, seed)
    part = (F.col("start") + F.col("at")) % block_words
    return mixed.select(
        "shard", "source", "slot", part.alias("part"), null_id("doc").alias(id_col), "at", "words"
    )


def _mixed(
    where: DataFrame, wanted: DataFrame, block_words: int, shard_words: int, seed: int
) -> DataFrame:
    """(shard, source, slot, doc, start, at, words): slots joined to the parts of their blocks."""
    taken = slots(wanted, block_words, shard_words, seed).alias("s")
    parts = pieces(where, block_words).alias("p")
    same = _same_source("s", "p") & (F.col("s.block") == F.col("p.block"))
    return _merged(taken, parts, same).select(
        "s.shard", "s.source", "s.slot", "p.doc", "p.start", "p.at", "p.words"
    )


def mixed_texts(
    mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(shard, source, slot, text): the words of every slot, parts in order.  Ids must be unique."""
    m = mixed.alias("m")
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("whole")).alias("d")
    words = F.regexp_extract_all("whole", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, (F.col("at") + 1).cast("int"), F.col("words").cast("int")), " ")
    joined = m.join(d, F.col(f"m.{id_col}").eqNullSafe(F.col("d.doc")))
    texts = joined.select("shard", "source", "slot", "part", cut.alias("piece"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "piece")))  # at most a block's words
    return texts.groupBy("shard", "source", "slot").agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text")
    )


def _plan(docs, id_col, text_col, source_col, weights, share, most, seed):
    spark = docs.sparkSession
    path = scratch(spark, "sizes")  # texts are read once; three numbers a row are kept
    docs.select(
        id_of(id_col).alias("doc"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    ).write.parquet(path)
    sized = spark.read.schema("doc long, source string, size long").parquet(path)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return placed(sized, seed), targets(sizes, weights, share, most)


def taken_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 7,
) -> DataFrame:
    """Per document what ``mix`` takes of it: (id_col, size, source, source_size, target, taken,
    first_shard), summed over the parts of the mix; ``first_shard`` is the smallest shard that holds some of it, null
    if none does.  The same treatment of nulls, repeated rows, other columns and empty tables."""
    where, wanted = _plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    mixed = _mixed(where, wanted, block_words, shard_words, seed)
    # A document is known by its place in its source's stream.
    drawn = mixed.groupBy("source", "start", "doc").agg(
        F.sum("words").alias("taken"), F.min("shard").alias("first_shard")
    ).alias("g")
    d, w = where.alias("d"), wanted.alias("w")
    same = (
        _same_source("d", "g") & (F.col("d.start") == F.col("g.start"))
        & (F.col("d.doc") == F.col("g.doc")) & (F.col("d.size") > 0)
    )
    return _merged(d, drawn, same, "left").join(w, _same_source("d", "w")).select(
        null_id(F.col("d.doc")).alias(id_col), "d.size", "d.source", "w.source_size", "w.target",
        F.coalesce(F.col("g.taken"), F.lit(0)).cast("long").alias("taken"), "g.first_shard",
    )
