"""Mixing sources to target weights, with DataFrame operations only.

Documents of a source are laid one after the other and cut into blocks of a fixed
number of words.  The mix is a sequence of slots, cut into output shards.  A
pseudorandom permutation of all slots deals each shard a draw of source counts: a
multinomial draw given that each source's counts add up to its quota, so quotas are
met exactly and no source runs over its limit.  A slot's place among its source's
slots goes through that source's own permutation of block numbers, one per pass,
and slots meet blocks by number.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import WORD
from .shared import carried, cut

BUCKET_ROWS = 1000
FEW_SOURCES = 10_000
ROUNDS = 24
#: Slots that one task permutes.
SLOTS_OF_A_TASK = 1 << 16


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def permuted(place: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 for each key (swap-or-not).

    Each round pairs x with (k - x) mod size and swaps the two if a hash of the pair
    says so, which is its own inverse for any size.
    """

    def step(x: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(key, r), size)
        partner = F.pmod(k - x, size)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """What the mix should take of each source.

    sizes: (source, source_size), one row a source.  Sources by code point, null last,
    get the weights in turn and share ``share`` times all sizes; a target stops at
    ``most`` times its source's size and the excess is shared again by weight.  Adds
    weight and target.  The table has a row for each source and is handled as one
    group.  Sources of size 0 have target 0.
    """
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    array = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(array, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(whole) * F.lit(float(share)))
    # by cap / weight, the sources that stop are a prefix; what is left is shared by the others
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("all") - F.col("taken")) / F.col("rest"))
    stops = F.col("level") * F.col("weight") >= F.col("cap")
    level = F.min(F.when(~stops, F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return rows.select("source", "source_size", "weight", F.when(stops, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def packed(docs: DataFrame, seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Lay out documents by source; returns each row's place there.

    docs: doc_id, source and size, with any other columns.  Adds bucket and turn
    (together with source they name the row), start (of its first word among the
    source's) and source_size.  A source's rows are ordered by hash inside buckets of
    about ``bucket_rows`` rows; bucket sums give the buckets' starts, so that no
    source is ordered in one task.
    """
    h = F.xxhash64(F.lit(seed), "doc_id")
    counts = docs.groupBy("source").agg(F.count("*").alias("rows"))
    counts = counts.select(F.col("source").alias("its_source"), F.ceil(F.col("rows") / bucket_rows).alias("buckets"))
    # (key: a null source as a value, for equal-key joins)
    counts = _keyed(counts, "its_source").drop("its_source")
    # few sources go to every task, so that rows aren't dealt out by source before they are by bucket
    if counts.count() <= FEW_SOURCES:
        counts = F.broadcast(counts)
    rows = _keyed(docs).join(counts, "key")
    rows = rows.withColumn("h", h).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("buckets"))).drop("buckets")
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("key").orderBy("bucket")
    sums = sums.select(
        "key",
        "bucket",
        (F.sum("words").over(up) - F.col("words")).alias("bucket_start"),
        F.sum("words").over(Window.partitionBy("key")).alias("source_size"),
    )
    inside = Window.partitionBy("key", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("turn", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(sums, ["key", "bucket"])
    return rows.withColumn("start", F.col("bucket_start") + F.coalesce("within", F.lit(0))).drop("within", "bucket_start", "h")


def _keyed(df: DataFrame, source: str = "source") -> DataFrame:
    return df.withColumn("key", F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(source, F.lit(""))))


def drawn_blocks(wanted: DataFrame, block: int = 64, shard: int = 4096, seed: int = 1) -> DataFrame:
    """The mix as blocks: slot, shard, key and block.

    wanted: (source, source_size, target).  ``block`` words make a block, ``shard`` slots an
    output shard.  The last block of a source may be shorter.  A source's slots beyond
    its number of blocks begin another pass over its blocks in another order.
    """
    quota = _keyed(wanted).where("source_size > 0").select(
        "key",
        F.ceil(F.col("source_size") / block).alias("blocks"),
        F.round(F.ceil(F.col("source_size") / block) * F.col("target") / F.col("source_size")).cast("long").alias("slots"),
    )
    quota = quota.withColumn("first", F.sum("slots").over(Window.orderBy("key")) - F.col("slots")).where("slots > 0")
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    spark = wanted.sparkSession
    # the dealt place of each slot says its source: the one whose range of places holds it
    tasks = max(1, -(-total // SLOTS_OF_A_TASK))
    dealt = spark.range(0, total, 1, tasks).select(
        F.col("id").alias("slot"), (F.col("id") / shard).cast("long").alias("shard"), permuted(F.col("id"), F.lit(max(total, 1)), F.lit(seed)).alias("dealt")
    )
    span = max(1, -(-total // 4096))
    ranges = quota.withColumn("cell", F.explode(F.sequence((F.col("first") / span).cast("long"), ((F.col("first") + F.col("slots") - 1) / span).cast("long"))))
    drawn = dealt.withColumn("cell", (F.col("dealt") / span).cast("long")).join(ranges, "cell").where("dealt >= first and dealt < first + slots")
    index = F.col("dealt") - F.col("first")
    drawn = drawn.withColumn("pass", (index / F.col("blocks")).cast("long"))
    drawn = drawn.withColumn("block", permuted(index - F.col("pass") * F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "key", "pass")))
    return drawn.select("slot", "shard", "key", "block")


def mix(laid: DataFrame, wanted: DataFrame, block: int = 64, shard: int = 4096, seed: int = 1) -> DataFrame:
    """The mix as pieces of documents: shard, slot, key, block, and per piece bucket, turn, doc_id, first_word and words.

    laid: from packed(); wanted, block and shard as for ``drawn_blocks``.
    """
    end = F.col("start") + F.col("size")
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence((F.col("start") / block).cast("long"), ((end - 1) / block).cast("long"))))
    low, high = F.greatest("start", F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    pieces = pieces.select("key", "block", "bucket", "turn", "doc_id", (low - F.col("start")).alias("first_word"), (high - low).alias("words"))
    return drawn_blocks(wanted, block, shard, seed).join(pieces, ["key", "block"])


def _cut_texts(block: int) -> Column:
    """A laid document's pieces: an array of (block, first_word, text), its text cut into words once."""
    word = "[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"
    spaced = F.regexp_extract_all("text", F.lit(f"^[\\x20\\x09-\\x0D]*{word}|{word}"), F.lit(0))
    end = F.col("start") + F.col("size")
    blocks = F.sequence((F.col("start") / block).cast("long"), ((end - 1) / block).cast("long"))

    def piece(words: Column, b: Column) -> Column:
        low, high = F.greatest(F.col("start"), b * block), F.least(end, (b + 1) * block)
        first = low - F.col("start")
        text = F.array_join(F.slice(words, (first + 1).cast("int"), (high - low).cast("int")), "")
        return F.struct(b.alias("block"), first.alias("first_word"), F.when(high - low == F.col("size"), F.col("text")).otherwise(text).alias("piece"))

    # (the array of one binds the words, so that they are made once for a text)
    return F.flatten(F.transform(F.array(spaced), lambda words: F.transform(blocks, lambda b: piece(words, b))))


def mix_sizes(docs: DataFrame, block: int = 64, seed: int = 1, **weighing) -> DataFrame:
    """For each row of docs what the mix takes of it.

    docs needs doc_id, text and source; other columns are ignored.  Returns doc_id,
    size (words), source_size, target (of its source, in words) and taken (words that
    the mix takes, repeats counted).  Null and empty texts and texts without words have
    size 0 and are never taken.  A null source is a source of its own.  Repeated rows
    and null doc_ids are rows like others.
    """
    sized = cut(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = cut(targets(sizes, **weighing), "targets")
    laid = cut(packed(sized, seed).select("key", "bucket", "turn", "doc_id", "size", "start"), "laid")
    mixed = mix(laid, wanted, block, seed=seed)
    # the rows themselves and the pieces taken of them, added up together
    rows = laid.select("key", "bucket", "turn", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    taken = mixed.select("key", "bucket", "turn", "doc_id", F.lit(0).cast("long").alias("size"), F.col("words").alias("taken"))
    added = rows.unionByName(taken).groupBy("key", "bucket", "turn", "doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    return added.join(_keyed(wanted).select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", "taken")


def mix_texts(docs: DataFrame, block: int = 512, seed: int = 1, **weighing) -> DataFrame:
    """The mixed corpus: one row for each piece of a document in a block.

    docs needs doc_id, text and source.  Returns all columns of docs, text being the
    piece with the white space after its words (a document's leading white space goes
    with its first word), and shard, slot and first_word, which replace columns of docs of
    those names; other columns are carried along, whatever their names.  Null and empty
    texts and texts without words give no piece; a null source is a source of its own;
    repeated rows and null doc_ids are rows like others; an empty table gives an empty
    result.  Each text is cut once, where it is read.
    """
    docs, named = carried(docs.drop("shard", "slot", "first_word"), ("doc_id", "text", "source"))
    held = docs.withColumn("size", word_count())
    sizes = held.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = cut(targets(sizes, **weighing), "targets")
    laid = packed(held, seed).where("size > 0")
    rest = [c for c in docs.columns if c != "text"]
    pieces = laid.select("key", *rest, F.explode(_cut_texts(block)).alias("p")).select("key", *rest, "p.block", "p.first_word", F.col("p.piece").alias("text"))
    mixed = drawn_blocks(wanted, block, seed=seed).join(pieces, ["key", "block"])
    return named(mixed.select(*docs.columns, "shard", "slot", "first_word"))
