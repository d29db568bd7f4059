"""Mixing sources to target weights with hash thresholds.

Sizes are summed by source and leading hash bits. The running sums of these buckets show in
which bucket a source's budget runs out; only that bucket is summed again by the next bits.
A document is taken if its hash lies under its source's threshold, so nothing is sorted,
and a larger budget keeps all that a smaller one took.

Defined results: a null text has size 0; a null source is a source of its own, the last; a
null id is hashed as such, together with the text, so rows without ids spread; equal rows
share their fate, so a source of which one repeated row is a large part can miss its target
by up to half of that part; an empty table gives no rows; a source of size 0 has target 0; a
document of any length counts whole, and one larger than what its source still lacks is
taken if that ends nearer to the target; other columns are kept by ``mixed``, whatever their
names, and ignored by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.llm.common import cut, fresh, named

WEIGHTS = (5, 2, 1)
#: Hash bits of each level; two levels leave one document in 16 million of a source undecided.
LEVEL_BITS = 12
#: Sources whose plan (about 100 bytes each) is broadcast; with more it is shuffled.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of MD5 over the id and the text's MD5."""
    own = F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), own)), 1, 12), 16, 10).cast("long")


def source_targets(by_source: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target: the budget dealt by weight, each target at most ``most`` times
    its source's size, what exceeds that dealt anew. by_source: source, source_size (one row each).

    Sorted by size over weight, the capped sources come first; the level of the rest follows
    from sums over both parts. One task orders the sources, of which it gets a row each.
    """
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = by_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (share * F.sum("source_size").over(whole) - before) / rest)
    # from the first source that stays below its cap on, the level only falls
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return df.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def source_thresholds(sized: DataFrame, share: float, most: float, weights: tuple[int, ...], name: str = "mixing") -> DataFrame:
    """source, source_size, target, times (how often every document is taken), below (documents
    with a smaller hash prefix of two levels are taken once more). sized: source, size, hash.
    """
    bits = LEVEL_BITS
    first = cut(sized.groupBy("source", F.shiftright("hash", 48 - bits).alias("bucket")).agg(F.sum("size").alias("size")), f"{name}-buckets")
    targets = source_targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))

    def running(df: DataFrame, column: str) -> DataFrame:
        upto = F.sum("size").over(Window.partitionBy("source").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("upto", upto)

    t, b = targets.alias("t"), running(first, "bucket").alias("b")
    crossing = b.join(t, F.col("t.source").eqNullSafe(F.col("b.source"))).where("upto > rest").groupBy("t.source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("b.size")).alias("before"))).alias("at"))
    edge = targets.alias("t").join(crossing.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", "at.bucket", "at.before")
    edge = cut(edge, f"{name}-sources")
    small = edge.count() <= BROADCAST_SOURCES
    hinted = F.broadcast(edge) if small else edge
    inner = sized.alias("s").join(hinted.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.shiftright("s.hash", 48 - bits) == F.col("e.bucket")))
    second = inner.groupBy("e.source", F.shiftright("s.hash", 48 - 2 * bits).alias("prefix")).agg(F.sum("s.size").alias("size"), F.first("e.rest").alias("rest"), F.first("e.before").alias("before"))
    second = running(second, "prefix").withColumn("gap", F.col("before") + F.col("upto") - F.col("rest"))
    # the sub-bucket in which the budget runs out is taken if that ends nearer to it
    second = second.where("gap > 0").groupBy("source").agg(F.min(F.struct("prefix", "gap", "size")).alias("at"))
    cut_at = F.col("at.prefix") + F.when(F.col("at.gap") <= F.col("at.size") - F.col("at.gap"), 1).otherwise(0)
    found = edge.alias("e").join(second.alias("p"), F.col("e.source").eqNullSafe(F.col("p.source")), "left")
    # no crossing: the budget covers the whole source, or it has none
    below = F.coalesce(cut_at, F.when(F.col("e.rest") > 0, F.lit(1 << 2 * bits)).otherwise(0))
    found = cut(found.select("e.source", "e.source_size", "e.target", "e.times", below.cast("long").alias("below")), f"{name}-thresholds")
    return F.broadcast(found) if small else found


def mix_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document.

    share: budget over the size of everything; most: largest target over its source's size;
    weights: of the sources in order of their code points, null last, repeating.
    """
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), mix_hash(F.col(id_col), text).alias("hash"))
    sized = cut(sized, "mixing-sizes")
    plan = source_thresholds(sized, share, most, weights)
    copies = F.col("p.times") + F.when(F.shiftright("s.hash", 48 - 2 * LEVEL_BITS) < F.col("p.below"), 1).otherwise(0)
    found = sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    return found.select("s.doc_id", "s.source", "s.size", "p.source_size", "p.target", copies.alias("copies"), (F.col("s.size") * copies).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs``, each row as often as it is taken. The texts are not shuffled."""
    text = F.col(text_col).cast("string")
    key = mix_hash(F.col(id_col), text)
    sized = cut(docs.select(F.col(source_col).alias("source"), n_words(text).alias("size"), key.alias("hash")), "mixing-sizes")
    options = {"share": 1.5, "most": 2.0, "weights": WEIGHTS} | options
    source, times, below, copy = fresh(docs, "mix_source", "mix_times", "mix_below", "mix_copy")
    plan = source_thresholds(sized, **options).select(F.col("source").alias(source), F.col("times").alias(times), F.col("below").alias(below))
    copies = F.col(times) + F.when(F.shiftright(key, 48 - 2 * LEVEL_BITS) < F.col(below), 1).otherwise(0)
    found = docs.join(plan, F.col(source_col).eqNullSafe(F.col(source))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(int(options["most"]) + 1))))
    return found.where(F.col(copy) <= copies).select(*map(named, docs.columns))
