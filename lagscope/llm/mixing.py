"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target number of words. The mix is a row of equal slots;
slot ``i`` has the van der Corput point of ``i`` (its bits reversed), which
the cumulative target shares map to a source, so every stretch of the mix
holds the sources near their shares. A source with fewer than ``LEAST_SLOTS``
points takes part blocks instead: ``LEAST_SLOTS`` slots between the others,
evenly spaced from a golden-ratio point on. There are thus at most one slot
for every ``BLOCK_WORDS`` words and ``LEAST_SLOTS`` for every source, however
small one is. The slots of a source are ranked; the
``k``-th takes the ``k``-th block of the source's stream, its documents in
shuffled order, again from the start when it is used up. A source's blocks
are of equal size, its target over its number of slots.

DataFrame functions only. A source is never one group: its slots and its
documents are ranked through per-bucket sums (``common.prefix_sum``), and
blocks are joined by (source, rank).

Defined results: null and empty texts, and those of white space, have size 0
and take 0 words. A null source is a source, the last one. Repeated rows are
rows of their own; equal rows may share what a cut block takes in any order.
A table without words has targets 0. An empty table gives an empty result.
Sources are assumed to be few against documents (their table has one row for
each); shares that differ by any factor get 16 slots or more each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lagscope.llm.common import WORD, fresh, prefix_sum, settle

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often.
MOST_TIMES = 3
#: Words of a block: so many or more, less than twice as many.
BLOCK_WORDS = 1024
#: Blocks of a source, at least; smaller ones if its words ask for it.
LEAST_SLOTS = 16
GOLDEN = (5 ** 0.5 - 1) / 2
#: The table of sources is broadcast up to this many, else joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Buckets that a source's documents and slots are ranked through.
BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Every word becomes one character, and all
    white space goes."""
    one = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(one, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """The source as a key that is never null and sorts like it, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _source(key: Column) -> Column:
    return F.when(key != "1", F.substring(key, 2, 1 << 30))


def targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """``(source, source_size, weight, target, cum)``: the sum of all sizes
    shared by weight, no source above ``MOST_TIMES`` its size, what is above
    shared again by weight; ``cum`` sums the targets before it.

    Closed form: sources by cap over weight; those up to the last one whose
    cap is below its share of what the earlier caps leave are at their caps.
    One row per source, summed before the shuffle."""
    total = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * MOST_TIMES
    everything = Window.partitionBy()
    ratio = F.col("cap") / F.col("weight")
    up = Window.orderBy(ratio, F.col(source).asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    from_here = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(from_here))
    rows = (total.withColumn("weight", weight).withColumn("cap", cap.cast("double"))
            .withColumn("level", level).withColumn("free", ratio >= F.col("level")))
    share = F.min(F.when(F.col("free"), F.struct(ratio, F.col(source), F.col("level")))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(share["level"], F.lit(float("inf"))) * F.col("weight"))
    return (rows.withColumn("target", target)
            .select(source, "source_size", "weight", "target",
                    F.coalesce(F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, -1)),
                               F.lit(0.0)).alias("cum")))


def _stretches(shares: DataFrame, bits: int, source: str = "source") -> DataFrame:
    """``shares`` with ``lo`` and ``hi``, the source's stretch of the points,
    ``n``, its number of slots, and ``minor``, its number among the sources
    with part blocks (null: not one of them)."""
    m = 1 << bits
    all_targets = F.sum("target").over(Window.partitionBy())
    point = [F.coalesce(F.ceil(F.round(x / all_targets * m, 6)), F.lit(0).cast("bigint"))
             for x in (F.col("cum"), F.col("cum") + F.col("target"))]
    few = (F.col("target") > 0) & (F.col("hi") - F.col("lo") < LEAST_SLOTS)
    before = Window.orderBy(F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (shares.withColumn("lo", F.when(F.col("target") > 0, point[0]).otherwise(0).cast("bigint"))
            .withColumn("hi", F.when(F.col("target") > 0, point[1]).otherwise(0).cast("bigint"))
            .withColumn("few", few)
            .withColumn("minor", F.when(F.col("few"), F.coalesce(F.sum(F.col("few").cast("bigint")).over(before), F.lit(0))))
            .withColumn("n", F.when(F.col("few"), LEAST_SLOTS).otherwise(F.col("hi") - F.col("lo")).cast("bigint"))
            .drop("few"))


def schedule(shares: DataFrame, bits: int, source: str = "source") -> DataFrame:
    """``(source, slot, rank)``: the source of each slot of the mix and the
    slot's rank within its source; slots come in the order of their numbers,
    which may have gaps.

    Reversing the bits maps the ``2 ** bits`` slots one to one on the points
    ``j``, so the slots of a source are read off its stretch of the cumulative
    shares. The part blocks of ``minor`` sources stand after the slot at their
    place; each has a number of its own there."""
    m = 1 << bits
    plan = _stretches(shares, bits, source)
    room = F.coalesce(F.max("minor").over(Window.partitionBy()) + 1, F.lit(0)) * LEAST_SLOTS + 1
    plan = plan.withColumn("room", room)
    step = 1 << 14  # no array gets longer, however many slots a source has
    pieces = (plan.where(F.col("minor").isNull() & (F.col("hi") > F.col("lo")))
              .select(source, "hi", "room", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(step))).alias("at"))
              .select(source, "room", F.explode(F.sequence("at", F.least(F.col("at") + step, "hi") - 1)).alias("j")))
    turned = F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("bigint") if bits else F.lit(0).cast("bigint")
    slots = pieces.select(_key(F.col(source)).alias(source), "room", turned.alias("slot"))
    slots = slots.withColumn("stretch", F.shiftright("slot", max(0, bits - 10))).withColumn("one", F.lit(1))
    large = (prefix_sum(slots, [source], "stretch", ["slot"], "one", "rank")
             .select(_source(F.col(source)).alias(source), (F.col("slot") * F.col("room")).alias("slot"),
                     F.col("rank").cast("bigint").alias("rank")))
    start = F.col("minor") * GOLDEN
    place = F.floor((F.col("rank") + start - F.floor(start)) * m / LEAST_SLOTS)
    small = (plan.where(F.col("minor").isNotNull())
             .select(source, "room", "minor", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                   F.lit(LEAST_SLOTS - 1).cast("bigint"))).alias("rank"))
             .select(source, (place * F.col("room") + 1 + F.col("minor") * LEAST_SLOTS + F.col("rank")).alias("slot"), "rank"))
    return large.union(small)


def _place(df: DataFrame, size: Column, id_col: str, source: str, block_words: int,
           seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` at their places in their source's stream, and the
    schedule's slots."""
    # a row travels as one struct, so its column names meet no others
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), _key(F.col(source)).alias("source"),
                     F.col(id_col).alias("id"), size.cast("bigint").alias("size"))
    shares = settle(targets(rows.select("source", "size")))
    whole = shares.agg(F.sum("target"), F.count("*")).first()
    bits = max(1, int(float(whole[0] or 0.0) / block_words)).bit_length() - 1
    slots = settle(schedule(shares, bits).select(F.col("source").alias("slot_source"), F.col("rank").alias("slot_rank"), "slot"))
    plan = _stretches(shares, bits).select(F.col("source").alias("plan_source"), "source_size", "target", "n")
    plan = F.broadcast(plan) if whole[1] <= BROADCAST_SOURCES else plan

    order = F.xxhash64(F.col("id").cast("string"), F.lit(seed))
    shuffled = rows.withColumn("order", order).withColumn("bucket", F.pmod(F.col("order"), F.lit(BUCKETS)))
    placed = (prefix_sum(shuffled, ["source"], "bucket", ["order", "id", "size"], "size", "start")
              .join(plan, F.col("source") == F.col("plan_source"))
              .select("row", "id", "source", "size", "start", "source_size", "target", "n"))
    return placed, slots


def _scheduled(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """``(slot, source, id, start, at, first, words)``: what each slot's block
    takes of each row; ``at`` is the place in the source's repeated stream."""
    # words [a, b) of the repeated stream that a row covers, by repetition,
    # then by block
    per_slot = F.col("target") / F.col("n")
    again = F.explode(F.array(*[F.lit(e) for e in range(MOST_TIMES)]))
    covers = (placed.where((F.col("size") > 0) & (F.col("n") > 0))
              .select("source", "id", "start", "size", "source_size", "target", "n", again.alias("e"))
              .withColumn("a", F.col("start") + F.col("e") * F.col("source_size"))
              .withColumn("b", F.least(F.col("a") + F.col("size"), F.floor("target")))
              .where("a < b")
              .select("source", "id", "start", "a", "b", "target", "n", F.explode(F.sequence(
                  F.greatest(F.floor(F.col("a") / per_slot) - 1, F.lit(0)),
                  F.least(F.floor(F.col("b") / per_slot), F.col("n") - 1))).alias("rank"))
              .withColumn("from", F.greatest("a", F.floor(F.col("rank") * per_slot)))
              .withColumn("to", F.least("b", F.when(F.col("rank") == F.col("n") - 1, F.floor("target"))
                                        .otherwise(F.floor((F.col("rank") + 1) * per_slot))))
              .where("from < to")
              .select("source", "id", "start", "rank", F.col("from").alias("at"),
                      (F.col("from") - F.col("a")).alias("first"), (F.col("to") - F.col("from")).alias("words")))
    # the slots grow with the words: never broadcast, whatever they are taken for
    return (covers.join(slots.hint("merge"), (F.col("source") == F.col("slot_source"))
                        & (F.col("rank") == F.col("slot_rank")))
            .select("slot", "source", "id", "start", "at", "first", "words"))


def mixture(df: DataFrame, size: Column, id_col: str = "doc_id", source: str = "source",
            block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The mix itself, ``(slot, at, source, id, first, words)``: by ``slot``, then
    ``at``, the next ``words`` words of document ``id``, from its word
    ``first`` (0 is the first one) on."""
    pieces = _scheduled(*_place(df, size, id_col, source, block_words, seed))
    return pieces.select("slot", "at", _source(F.col("source")).alias("source"), "id", "first", "words")


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source: str = "source",
        block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The columns of ``df`` and ``size``, ``source_size``, ``target`` and
    ``taken`` (words of the row that the scheduled blocks take: the sum of its
    words in ``mixture``), under names of their own where ``df`` has such
    columns."""
    outs = fresh(df, "size", "source_size", "target", "taken")
    placed, slots = _place(df, size, id_col, source, block_words, seed)
    took = (_scheduled(placed, slots).groupBy("source", "start").agg(F.sum("words").alias("words"))
            .select(F.col("source").alias("took_source"), F.col("start").alias("took_start"), "words"))
    taken = F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("bigint")
    return (placed.join(took, (F.col("source") == F.col("took_source"))
                        & (F.col("start") == F.col("took_start")), "left")
            .select(*[F.col("row")[c].alias(c) for c in df.columns],
                    *[c.alias(out) for c, out in zip(
                        (F.col("size"), F.col("source_size"), F.col("target"), taken), outs)]))


def op7(documents: DataFrame) -> DataFrame:
    thin = settle(documents.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    return mix(thin, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def stage(documents: DataFrame) -> DataFrame:
    """Every document with its ``size``, ``source_size``, ``target`` and the
    words that the mix takes of it (``taken``; 0: left out, more than
    ``size``: repeated).

    The words are counted once, into a table without texts that the mix works
    on; whole rows are shuffled once, to meet what was taken of them. Equal
    rows meet as one and come out as many as they are."""
    key, row = fresh(documents, "key", "row")
    cols = [F.col(c) for c in documents.columns]
    keyed = documents.withColumn(key, F.concat(F.hex(F.xxhash64(F.lit(1), *cols)), F.hex(F.xxhash64(F.lit(2), *cols))))
    thin = settle(keyed.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), F.col("source").alias("source"),
                               word_count(F.col("text")).alias("words")))
    outs = fresh(documents, "size", "source_size", "target", "taken")
    took = mix(thin, F.col("words"), "id").select(
        F.col("key").alias("took_key"), *[F.col(c).alias(f"took_{i}") for i, c in enumerate(
            ("size", "source_size", "target", "taken"))])
    whole = keyed.groupBy(key).agg(F.first(F.struct(*cols)).alias(row))
    return (took.join(whole, F.col("took_key") == F.col(key))
            .select(*[F.col(row)[c].alias(c) for c in documents.columns],
                    *[F.col(f"took_{i}").alias(out) for i, out in enumerate(outs)]))
