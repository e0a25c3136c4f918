"""Mixing sources to target weights with DataFrame functions only.

The words of a source's documents, in a pseudorandom order, form a stream that is packed into blocks of fixed length.
A source's target is a number of words; it becomes whole passes over all its blocks and a last pass over some: its slots. The counts of the sources
in each output shard are multinomial draws by target weight, then brought to the sources' slot totals. The running sums of a source's counts
over the shards give each shard a range of its slots. Slots map to blocks through a swap-or-not permutation of the block indices, keyed
by source and pass: a bijection of any range that needs neither a sort nor a table. Slots and blocks join by (source, block index).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import materialize, prefix_sum, table

WS = " \t\n\x0b\x0c\r"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 512
#: Slots that are drawn for each output shard.
SHARD_SLOTS = 4096
ROUNDS = 24
#: Slots that one task lays out.
TASK_SLOTS = 32_768


def words_of(text):
    """The words of a text as an array; null and blank texts have none."""
    t = F.btrim(text, F.lit(WS))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def permuted(i, n, *key):
    """Where index ``i`` of 0..n-1 goes: each round pairs x with (k - x) mod n and swaps the pair if a hash bit of
    its larger member says so."""

    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other), F.lit("bit")).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, swap)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its index ``s`` (by code point, null last), target and slots.

    All targets add up to all words. A target above ``max_repeat`` times its source's words stops there and the rest is shared
    by weight among the others: in the order of cap / weight, the level of the first source that stays under its cap is the
    level of all after it."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.lit(list(weights)), (F.pmod(F.col("s"), F.lit(len(weights))) + 1).cast("int"))
    ranked = by.withColumn("s", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("w", w)
    ranked = ranked.withColumn("cap", max_repeat * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), "s")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    t = filled.withColumn("target", F.coalesce(first * F.col("w"), F.col("cap").cast("double")))
    goal = F.least(F.round("target").cast("long"), F.col("cap"))
    t = t.withColumn("goal", goal)
    t = t.withColumn("passes", F.expr("goal div greatest(source_size, 1)")).withColumn("rest", F.expr("goal % greatest(source_size, 1)"))
    t = t.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("whole", F.expr(f"source_size div {block}"))
    t = t.withColumn("slots", F.expr(f"passes * blocks + (rest + {block - 1}) div {block}"))
    return t.select("source", "s", "source_size", "target", "passes", "rest", "blocks", "whole", "slots")


def draw_counts(targets: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """Rows ``s, shard, n``: how many of the slots of an output shard fall to each source, by multinomial draws with the sources' slots as weights.

    Each of a shard's slots draws its source by itself. There is one row for a source and shard that met; an empty mix has none."""
    spark = targets.sparkSession
    total = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]  # one number
    shards = max(1, -(-total // shard_slots))
    edges = targets.where("slots > 0").select("s", F.sum("slots").over(W.orderBy("s")).alias("edge"))  # one row per source
    edges = edges.agg(F.array_sort(F.collect_list(F.struct("edge", "s"))).alias("e")).scalar()  # one value
    slots = spark.range(0, total, 1, max(1, -(-total // TASK_SLOTS)))
    slots = slots.select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("u"), edges.alias("e"))
    # binary search: how many sources lie wholly at or below the draw
    steps = F.sequence(F.ceil(F.log2(F.size("e") + 1)).cast("int") - 1, F.lit(0), F.lit(-1))

    def step(at, k):
        to = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((to <= F.size("e")) & (F.element_at("e", F.least(to, F.size("e")))["edge"] <= F.col("u")), to).otherwise(at)

    found = F.element_at("e", F.least(F.aggregate(steps, F.lit(0), step) + 1, F.size("e")))["s"]
    return slots.select(found.alias("s"), F.least("shard", F.lit(shards - 1)).alias("shard")).groupBy("s", "shard").agg(F.count("*").alias("n"))


def slot_ranges(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows ``s, shard, lo, hi``: the slots of a source that each output shard shows, from the running sums of its counts.

    The sums are scaled so that the shards of a source share all its slots; a source that no shard drew goes to shard 0 in whole."""
    rows = prefix_sum(counts.withColumn("spread", F.xxhash64(F.lit("shard"), "shard")), ["s"], ["shard"], "n", "before", "spread", 64)
    drawn = counts.groupBy(F.col("s").alias("ds")).agg(F.sum("n").alias("drawn"))
    goal = targets.where("slots > 0").join(drawn, F.col("s") == F.col("ds"), "left").select(F.col("s").alias("ts"), "slots", "drawn")
    place = lambda c: F.floor(c / F.col("drawn") * F.col("slots")).cast("long")
    cut = rows.join(goal, F.col("s") == F.col("ts")).select("s", "shard", place(F.col("before")).alias("lo"), place(F.col("before") + F.col("n")).alias("hi"))
    missed = goal.where("drawn is null").select(F.col("ts").alias("s"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("lo"), F.col("slots").alias("hi"))
    return cut.where("hi > lo").unionByName(missed)


def draw_slots(targets: DataFrame, block: int = BLOCK_WORDS, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Rows ``s, shard, k, pass, block, take``: an output shard shows, as slot k of source s, the first ``take`` words of a block."""
    total = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]  # one number
    ranges = slot_ranges(materialize(draw_counts(targets, shard_slots, seed), "counts"), targets).withColumnRenamed("s", "rs")
    t = targets.select("s", "source_size", "passes", "rest", "blocks", "whole")
    # a numbered repartition is not undone when the few bytes of the ranges are coalesced
    laid = ranges.join(t, F.col("rs") == F.col("s")).repartition(max(1, -(-total // TASK_SLOTS)), "s", "shard")
    k = laid.withColumn("k", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    k = k.withColumn("pass", F.expr("k div blocks")).withColumn("i", F.expr("k % blocks"))
    to = F.when(F.col("i") < F.col("whole"), permuted(F.col("i"), F.col("whole"), F.lit(seed), F.col("s"), F.col("pass"))).otherwise(F.col("i"))
    length = F.when(F.col("i") < F.col("whole"), F.lit(block)).otherwise(F.col("source_size") - F.col("whole") * block)
    left = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("i") * block))
    return k.select("s", "shard", "k", "pass", to.alias("block"), left.cast("long").alias("take"))


def pack_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (s, row, id, size, spread) with their place in the stream of their source: ``start`` in words."""
    n = rows.count()
    return prefix_sum(rows, ["s"], ["id", "size", "row"], "size", "start", "spread", max(256, n // 20_000))


def pieces(packed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``s, block, row, at, n, skip``: n words of a row from its word ``skip`` on are at word ``at`` of a block."""
    p = packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return p.select("s", "block", "row", (lo - F.col("block") * block).alias("at"), (hi - lo).alias("n"), (lo - F.col("start")).alias("skip"))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def _sized(docs: DataFrame, row, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(text)).cast("long").alias("size"),
                       F.xxhash64(F.lit("order"), F.col(id_col).cast("long"), text).alias("spread"))


def _mixed(rows: DataFrame, weights, block: int, seed: int, shard_slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets by source, the numbered ``rows`` (s, row, id, size), and what the slots show of them: ``row, s, pass, shard, k, at, skip, m``."""
    targets = materialize(source_targets(rows, weights, block=block), "targets")
    known = targets.select(F.col("source").alias("src"), "s")
    numbered = rows.join(known, F.col("source").eqNullSafe(F.col("src"))).select("s", "row", "id", "size", "spread")
    slots = draw_slots(targets, block, seed, shard_slots).select(F.col("s").alias("s2"), F.col("block").alias("b2"), "shard", "k", "pass", "take")
    met = pieces(pack_blocks(numbered), block).join(slots.hint("merge"), (F.col("s") == F.col("s2")) & (F.col("block") == F.col("b2")))
    shown = met.withColumn("m", F.least("n", F.col("take") - F.col("at"))).where("m > 0").select("row", "s", "pass", "shard", "k", "at", "skip", "m")
    return targets, numbered, shown


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
               block: int = BLOCK_WORDS, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``id, size, source_size, target, taken, shards`` per row of ``docs``: how many of its words the mix shows, repeats counted, and the output shards that show any.

    Null texts and blank texts have size 0 and are taken 0 times; a null source is a source, the last in order. Repeated rows and null ids are
    rows of their own. Very long texts lie over many blocks. Ties in the pseudorandom order are rows of one id and text, which stand for each other. An empty table gives no row. Other columns play no part."""
    rows = materialize(_sized(docs, F.monotonically_increasing_id(), id_col, text_col, source_col), "sizes")
    targets, numbered, shown = _mixed(rows, weights, block, seed, shard_slots)
    taken = shown.groupBy(F.col("row").alias("r")).agg(F.sum("m").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    known = targets.select(F.col("s").alias("ts"), "source_size", "target")
    every = numbered.join(taken, F.col("row") == F.col("r"), "left").join(known, F.col("s") == F.col("ts"))
    return every.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a stored table with a number for each row, so that equal rows stay apart however often it is read."""
    row = _free(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
                  block: int = BLOCK_WORDS, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents: rows of ``docs``, one for each pass that shows a row, with the words that its slots show as text.

    A row shown in whole keeps its text as it is; one shown in part has the shown words joined by single spaces. All other columns are kept, whatever their names.
    Repeated rows and null ids are rows of their own. Rows without words (null, empty or blank texts) are not shown. An empty table gives an empty mix."""
    stored_docs, row = _numbered(docs)
    rows = materialize(_sized(stored_docs, F.col(row), id_col, text_col, source_col), "sizes")
    _, numbered, shown = _mixed(rows, weights, block, seed, shard_slots)
    plan = shown.groupBy(F.col("row").alias("_r"), "pass").agg(F.sum("m").alias("_total"), F.array_sort(F.collect_list(F.struct("skip", "m"))).alias("_shown"))
    plan = plan.join(numbered.select(F.col("row").alias("_r2"), F.col("size").alias("_size")), F.col("_r") == F.col("_r2"))
    plan = plan.groupBy("_r").agg(F.collect_list(F.when(F.col("_total") < F.col("_size"), F.col("_shown")).otherwise(F.array().cast("array<struct<skip:bigint,m:bigint>>"))).alias("_passes"))  # max_repeat at most
    own = [F.col(c) for c in docs.columns]
    both = stored_docs.select(F.col(row).alias("_key"), F.struct(*own).alias("_doc"), F.col(text_col).alias("_text")).join(plan, F.col("_key") == F.col("_r"))
    part = F.exists("_passes", lambda p: F.size(p) > 0)
    both = both.withColumn("_w", F.when(part, words_of(F.col("_text"))))
    cut = lambda p: F.array_join(F.flatten(F.transform(p, lambda x: F.slice(F.col("_w"), (x["skip"] + 1).cast("int"), x["m"].cast("int")))), " ")
    each = both.withColumn("_t", F.explode(F.transform("_passes", lambda p: F.when(F.size(p) == 0, F.col("_text")).otherwise(cut(p)))))
    return each.select(*[F.col("_t").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
               block: int = BLOCK_WORDS, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as training blocks: ``shard, slot, source, ids, text``. A slot holds at most ``block`` words, joined by single spaces, of the rows ``ids`` in order; ``slot``
    numbers the blocks of a shard in a pseudorandom order of all sources. Odd rows as in :func:`mix_documents`."""
    stored_docs, row = _numbered(docs)
    rows = materialize(_sized(stored_docs, F.col(row), id_col, text_col, source_col), "sizes")
    targets, numbered, shown = _mixed(rows, weights, block, seed, shard_slots)
    text = stored_docs.select(F.col(row).alias("_key"), F.col(id_col).cast("long").alias("_id"), words_of(F.col(text_col)).alias("_w"))
    part = shown.join(text, F.col("row") == F.col("_key")).select("s", "shard", "k", "at", "_id", F.array_join(F.slice("_w", (F.col("skip") + 1).cast("int"), F.col("m").cast("int")), " ").alias("t"))
    blocks = part.groupBy("s", "shard", "k").agg(F.array_sort(F.collect_list(F.struct("at", "t", "_id"))).alias("p"))  # ``block`` words at most
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "s", "k"), "s", "k")  # about ``shard_slots`` rows
    named = blocks.join(targets.select(F.col("s").alias("ts"), "source"), F.col("s") == F.col("ts"))
    return named.select("shard", (F.row_number().over(order) - 1).alias("slot"), "source", F.col("p._id").alias("ids"), F.array_join("p.t", " ").alias("text"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
