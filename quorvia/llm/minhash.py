"""Near-duplicate groups by DartMinHash signatures and a banded join.

A text's elements are its word shingles. Hashed darts fall on each element's region, weight
by rank: as a Poisson process along the rank, the same for an element wherever it occurs,
and only darts under the text's weight of the element and under a rank that gives the text
enough of them are made. Each dart has a coordinate; the earliest of each coordinate is
kept, so two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. Rows of signatures are joined by bands, and what meets there is compared
exactly.

Texts of equal shingle sets are one candidate. In a bucket, each candidate is compared with
the bucket's smallest key; that links large groups with as many comparisons as members. In
buckets whose members still differ in class, those outside the largest class are then
compared with all others, in blocks, with links only between different classes. Where very
many are outside it, as where texts share a template, members meet by their rare shingles
instead: of two similar texts the rarest shingle that they share is among the rarest of
each that hold a fifth of its weight, so only texts that share such a one are compared.
Links make classes; a class's id is its smallest document id.

Defined results: a text of fewer words than a shingle is one shingle of what it has; texts
without words (null ones too) are copies if they are equal; in ``groups`` a null id gets a
null class and is never linked; rows that repeat an id with the same text are one document,
and with another text each such row follows the classes of its own copies; an empty table
gives no rows; a text of any length is taken whole and must fit into a task; other columns,
whatever their names, are ignored by ``groups`` and kept by ``keep_one``. ``keep_one`` counts rows: of each class, rows with
null ids among them, one stays. Contents are told apart by 16 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import WORD, cut, fresh, mix, named, record_batches, word_hashes
from quorvia.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: At 0.8, 20 bands of 4 rows miss a pair with a chance of 3 in 100,000.
BANDS, ROWS = 20, 4
#: Rows that are broadcast (an id and 16 bytes of digest each); beyond, they are shuffled.
BROADCAST_IDS = 1_000_000
BLOCK = 512
#: A key is hot if more rows hold it than this and than all rows over HOT_SHARE; so a row is in
#: hot keys of at most HOT_SHARE a column, which are few enough to be broadcast.
HOT_ROWS, HOT_SHARE = 1000, 4096
#: Members outside a bucket's largest class from which on they meet by rare shingles, and members
#: of one rare shingle up to which all their pairs of different classes are listed.
MANY, LISTED = 64, 64
#: Rows that one copy of a bucket's first member is compared with.
SPLIT = 1000

_hashes = word_hashes
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order."""
    words = _hashes.of(WORD.findall((text or "").lower()))
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(out)


def uniform(x: np.ndarray) -> np.ndarray:
    """Above 0, up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, upto: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(owner, coordinate, rank, dart) of the darts in the regions weight by ``upto[owner]``.

    The weight axis is cut into strips [0, 1), [1, 2), [2, 4), ...; darts of a strip come
    along the rank with the strip's width as their rate.
    """
    parts = []
    strip = 0
    while len(element):
        low = float(1 << strip >> 1)
        width = max(1.0, low)
        seed = mix(element + np.uint64(strip) * _GOLD)
        own, top, rank, number = owner, weight, np.zeros(len(element)), 0
        while len(seed):
            dart = mix(seed + np.uint64(number + 1) * np.uint64(0xA0761D6478BD642F))
            rank = rank - np.log(uniform(mix(dart + np.uint64(1)))) / width
            inside = rank < upto[own]
            seed, own, top, rank, dart = seed[inside], own[inside], top[inside], rank[inside], dart[inside]
            hit = low + width * uniform(mix(dart + np.uint64(2))) <= top
            parts.append((own[hit], (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)[hit], rank[hit], dart[hit]))
            number += 1
        strip += 1
        more = weight > float(1 << strip >> 1)
        element, weight, owner = element[more], weight[more], owner[more]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of k earliest darts for each weighted set (elements, weights); empty sets give zeros."""
    out = np.zeros((len(sets), k), np.uint64)
    total = np.array([w.sum() for _, w in sets])
    todo, aim = np.flatnonzero(total > 0), k * (np.log(k) + 3)
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        found = darts(np.concatenate([sets[i][0] for i in todo]), np.concatenate([sets[i][1] for i in todo]).astype(np.float64), owner, aim / total[todo], k)
        own, coordinate, rank, dart = found
        order = np.argsort(-rank, kind="stable")  # the last one written is the earliest
        flat = (own * k + coordinate)[order]
        mine, hit = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        mine[flat], hit[flat] = dart[order], True
        full = hit.reshape(-1, k).all(1)
        out[todo[full]] = mine.reshape(-1, k)[full]
        todo, aim = todo[~full], aim * 2  # a coordinate without dart: throw more
    return out


def bands(signature: np.ndarray, n: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature[:, : n * rows].reshape(len(signature), n, rows)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key.view(np.int64)


def weighted(found: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements with weights: 1, or how often each occurs."""
    elements, n = np.unique(found, return_counts=True)
    return elements, n.astype(np.float64) if counted else np.ones(len(elements))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, raw (digest of the text itself; empty for a null)."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), raw_digest(text).alias("raw"))


def raw_digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def digest(found: tuple[np.ndarray, np.ndarray], raw: bytes) -> bytes:
    """Of the weighted set, or of the text itself where there are no words."""
    e, w = found
    return hashlib.blake2b(e.tobytes() + w.tobytes() if len(e) else b"raw" + raw, digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, counted: bool) -> DataFrame:
    """id, raw, rep (16 bytes of digest of the content), n (the set's weight), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in record_batches(batches):
            sets = [weighted(shingles(t, size), counted) for t in b.column("text").to_pylist()]
            keys = bands(signatures(sets, BANDS * ROWS), BANDS, ROWS)
            content = [digest(x, raw) for x, raw in zip(sets, b.column("raw").to_pylist(), strict=True)]
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            columns = [b.column("id"), b.column("raw"), pa.array(content, pa.binary()), pa.array([float(w.sum()) for _, w in sets]), held]
            yield pa.RecordBatch.from_arrays(columns, ["id", "raw", "rep", "n", "bands"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, raw binary, rep binary, n double, bands array<long>")


def elements(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, size: int, counted: bool) -> DataFrame:
    """rep, e (sorted elements), w (their weights; null if all are 1), n (their sum) of the documents in ``rows`` (at_id, at_raw)."""
    source = texts(docs, id_col, text_col)
    source = source.join(rows, source["id"].eqNullSafe(rows["at_id"]) & (source["raw"] == rows["at_raw"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in record_batches(batches):
            sets = [weighted(shingles(t, size), counted) for t in b.column("text").to_pylist()]
            weights = [None if (w == 1).all() else w.tobytes() for _, w in sets]
            own = [digest(x, raw) for x, raw in zip(sets, b.column("raw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array(weights, pa.binary()), pa.array([float(w.sum()) for _, w in sets])], ["rep", "e", "w", "n"])

    return source.mapInArrow(run, "rep binary, e binary, w binary, n double")


def as_set(e: bytes, w: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(e, np.uint64)
    return found, np.frombuffer(w, np.float64) if w is not None else np.ones(len(found))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the smaller over sum of the larger weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def links(sets: list[tuple[np.ndarray, np.ndarray]], ids: list[bytes], classes: list[bytes], least: float, n_first: int, among: bool) -> Iterator[tuple[bytes, bytes]]:
    """Pairs that join different classes, as many as are needed to join all that are linked.

    The first ``n_first`` are compared with the others, or, if ``among``, with each other.
    """
    root: dict[bytes, bytes] = {}

    def find(c: bytes) -> bytes:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sizes = np.array([w.sum() for _, w in sets])
    start = np.cumsum([0, *(len(e) for e, _ in sets)])
    codes = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)[1]
    weight = np.concatenate([w for _, w in sets])
    mine = np.zeros(codes.max() + 1)
    for i in range(n_first):
        at = i + 1 if among else n_first
        if at == len(sets):
            break
        own = slice(start[i], start[i + 1])
        mine[codes[own]] = weight[own]
        rest = slice(start[at], None)
        shared = np.add.reduceat(np.minimum(mine[codes[rest]], weight[rest]), start[at:-1] - start[at])
        mine[codes[own]] = 0
        for j in (np.flatnonzero(shared >= least * (sizes[i] + sizes[at:] - shared)) + at).tolist():
            if (a := find(classes[i])) != (b := find(classes[j])):
                root[a] = b
                yield ids[i], ids[j]


def with_hot(rows: DataFrame, keys: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``keys`` (one row for each ``key``, with ``held``, how many rows have it).

    Hot keys' rows stay where they are: those keys are broadcast, so that no task gets all
    rows of one. The rest is shuffled.
    """
    hot = F.col("held") > max(HOT_ROWS, n_rows // HOT_SHARE)
    few = F.broadcast(keys.where(hot))
    return rows.join(few, key).union(rows.join(F.broadcast(keys.where(hot).select(key)), key, "left_anti").join(keys.where(~hot), key))


def members_hash(*columns: str) -> list[Column]:
    """Two 64-bit checksums over members, whatever their order; of members, or of such checksums."""
    own = [F.xxhash64(F.lit(i), "rep") for i in (0, 1)] if not columns else [F.col(c) for c in columns]
    return [F.bit_xor(c).alias(f"members{i}") for i, c in enumerate(own)]


def open_buckets(labelled: DataFrame) -> DataFrame:
    """band, top (its largest class), held and n_top (members in all and in that), of buckets with
    several classes; one for each set of members, however many bands have it."""
    by_class = labelled.groupBy("band", "class").agg(F.count("*").alias("n"), *members_hash())
    found = by_class.groupBy("band").agg(F.max_by("class", F.struct("n", "class")).alias("top"), F.sum("n").alias("held"), F.max("n").alias("n_top"), F.count("*").alias("classes"), *members_hash("members0", "members1"))
    return found.where("classes > 1").groupBy("held", "members0", "members1").agg(F.min_by(F.struct("band", "top", "n_top"), "band").alias("b")).select("b.*", "held")


def rare_shingles(held: DataFrame, some: DataFrame, similarity: float) -> DataFrame:
    """band (a shingle), rep, class, n: each of ``some`` (rep, class) at those of its rarest shingles that a similar one must share.

    Shingles are ordered by how many of ``some`` hold them. What comes after the rarest that
    hold more than 1 - similarity of a set's weight weighs too little for any similar set to
    share that alone.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in record_batches(batches, text="e"):
            sets = [as_set(e, w) for e, w in zip(b.column("e").to_pylist(), b.column("w").to_pylist(), strict=True)]
            at = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
            rows = [pa.array(np.concatenate([e for e, _ in sets]).view(np.int64)), pa.array(np.concatenate([w for _, w in sets]))]
            yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(at)), *rows], ["rep", "e", "weight"])

    own = held.join(some.select("rep"), "rep", "left_semi")
    rows = cut(own.select("rep", "e", "w").mapInArrow(apart, "rep binary, e long, weight double"), "minhash-apart")
    often = cut(rows.groupBy("e").agg(F.count("*").alias("held")), "minhash-often")
    every = with_hot(rows, often, "e", rows.count()).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("held", "e", "weight"))).alias("s"), F.sum("weight").alias("n"))
    # a shingle is of the rarest if what comes before it holds no more than the part that may differ; rounding errs to one more
    start = F.struct(F.lit(0.0).alias("before"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, x: F.struct((a["before"] + x["weight"]).alias("before"), F.when((a["before"] <= (1 - similarity) * F.col("n") + 1e-9) & (x["held"] > 1), F.concat(a["kept"], F.array(x["e"]))).otherwise(a["kept"]).alias("kept"))
    rare = every.select("rep", "n", F.explode(F.aggregate("s", start, step)["kept"]).alias("band"))
    return rare.join(some, "rep").select("band", "rep", "class", "n")


def groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, counted: bool = True, report: dict | None = None
) -> DataFrame:
    """id, group_id (the smallest id of its class) for every row.

    counted: weigh a shingle by its occurrences, so the similarity is that of weighted sets;
    else each weighs 1.
    report: gets the numbers of comparisons and links.
    """
    led = lead_rows(docs, id_col, text_col, shingle, similarity, counted, report, nulls=False)
    group = F.when(F.col("id").isNotNull(), F.coalesce("lead.id", "id"))
    return led.select(F.col("id").alias(id_col), group.alias("group_id"))


def lead_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, counted: bool, report: dict | None, nulls: bool) -> DataFrame:
    """id, raw, lead (no_id, id, raw: the first row of the class) of every row.

    nulls: rows without ids take part, after the others; else their lead is null.
    """
    sketched = cut(sketch(docs, id_col, text_col, shingle, counted), "minhash-sketches")
    own = sketched if nulls else sketched.where("id IS NOT NULL")
    at = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw"))
    distinct = cut(own.groupBy("rep").agg(at.alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("held")), "minhash-contents")
    filed = distinct.where("n > 0").select("rep", F.explode("bands").alias("band"))
    buckets = cut(filed.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("held")).where("held > 1"), "minhash-buckets")
    n_rows = distinct.count()
    members = cut(with_hot(filed, buckets, "band", n_rows).select("band", "rep", "first", "held"), "minhash-members")
    pairs = cut(members.where("rep <> first").select("rep", "first").distinct(), "minhash-pairs")
    reps = pairs.select(F.explode(F.array("rep", "first")).alias("rep")).distinct()
    rows = cut(distinct.join(reps, "rep", "left_semi").select(F.col("at.id").alias("at_id"), F.col("at.raw").alias("at_raw")), "minhash-candidates")
    n_candidates = rows.count()
    held = cut(elements(docs, F.broadcast(rows) if n_candidates <= BROADCAST_IDS else rows, id_col, text_col, shingle, counted), "minhash-elements")
    if held.count() > n_candidates:  # rows that repeat id and text
        held = cut(held.groupBy("rep").agg(F.min(F.struct("e", "w", "n")).alias("s")).select("rep", "s.*"), "minhash-elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [b.column(c).to_pylist() for c in ("ae", "aw", "be", "bw")]
            near = [jaccard(as_set(ae, aw), as_set(be, bw)) >= similarity for ae, aw, be, bw in zip(*rows, strict=True)]
            kept = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(kept), b.column("b").filter(kept)], ["a", "b"])

    # a first member with very many partners is there in several copies, so that they are dealt to several tasks
    firsts = cut(pairs.groupBy("first").agg(F.count("*").alias("held")), "minhash-firsts")
    copies = F.ceil(F.col("held") / SPLIT).cast("int")
    dealt = with_hot(pairs, firsts, "first", n_rows).select("rep", "first", F.pmod(F.xxhash64("rep"), copies).cast("int").alias("copy"))
    second = held.toDF("first", "be", "bw", "bn").join(firsts.select("first", copies.alias("copies")), "first").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    sides = dealt.join(held.toDF("rep", "ae", "aw", "an"), "rep").join(second, ["first", "copy"])
    # the smaller over the larger weight bounds the similarity
    sides = sides.where(F.least("an", "bn") >= similarity * F.greatest("an", "bn"))
    star = cut(sides.select(F.col("rep").alias("a"), F.col("first").alias("b"), "ae", "aw", "be", "bw").mapInArrow(compare, "a binary, b binary"), "minhash-links")
    classes = components(star, "minhash-stars")

    # what is left: buckets of three and more in which classes still differ
    labelled = cut(members.where("held > 2").select("band", "rep").join(classes.toDF("rep", "class"), "rep", "left").withColumn("class", F.coalesce("class", "rep")), "minhash-labelled")
    buckets = cut(open_buckets(labelled), "minhash-open")
    heavy = F.col("held") - F.col("n_top") > MANY
    few = None
    if not buckets.where(heavy).isEmpty():
        many = with_hot(labelled, buckets.where(heavy).select("band", "held"), "band", n_rows).select("rep", "class").distinct()
        met = cut(rare_shingles(held, cut(many, "minhash-many"), similarity), "minhash-rare")
        # shingles that the same members share, as those of one passage, are one bucket
        sizes = met.groupBy("band").agg(F.count("*").alias("held"), F.count_distinct("class").alias("classes"), *members_hash()).where("classes > 1")
        sizes = cut(sizes.groupBy("held", "members0", "members1").agg(F.min("band").alias("band")).select("band", "held"), "minhash-rare-held")
        close = with_hot(met, sizes, "band", n_rows)
        one = close.where(F.col("held") <= LISTED).select("band", "rep", "class", "n")
        pairs_of = one.toDF("band", "a", "ca", "an").join(one.toDF("band", "b", "cb", "bn"), "band").where("a < b AND ca <> cb").where(F.least("an", "bn") >= similarity * F.greatest("an", "bn"))
        listed = cut(pairs_of.select("a", "b").distinct(), "minhash-listed")
        few = listed.join(held.select(F.col("rep").alias("a"), F.col("e").alias("ae"), F.col("w").alias("aw")), "a").join(held.select(F.col("rep").alias("b"), F.col("e").alias("be"), F.col("w").alias("bw")), "b")
        if report is not None:
            report["listed"] = listed.count()
        # what is shared by more is compared in blocks, as buckets are
        labelled = cut(with_hot(labelled, buckets.where(~heavy).select("band", "held"), "band", n_rows).select("band", "rep", "class").union(close.where(F.col("held") > LISTED).select("band", "rep", "class")), "minhash-labelled")
        buckets = cut(open_buckets(labelled), "minhash-open")
    if report is not None:
        asked = buckets.agg(F.sum((F.col("held") - F.col("n_top")) * F.col("held"))).first()[0] or 0
        report["in_blocks"] = int(asked)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counted_blocks = buckets.select("band", "held", "top", blocks(F.col("n_top")).alias("tops"), blocks(F.col("held") - F.col("n_top")).alias("others"))
    rest = with_hot(labelled, counted_blocks, "band", n_rows).withColumn("asks", F.col("class") != F.col("top"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("others")).otherwise(F.col("tops"))).cast("int")
    each = lambda n, task: F.transform(F.sequence(F.lit(0), F.col(n) - 1), task)
    task = lambda among, i, j: F.struct(F.lit(among).alias("among"), i.alias("i"), j.alias("j"))
    mine = F.col("block")
    # members of the largest class meet each block of the others once; the others meet all, and where one block holds either, in one task
    small = (F.col("tops") == 1) & (F.col("others") == 1)
    met = F.when(small, F.array(task(True, F.lit(0), F.lit(0)))).when(F.col("asks"), F.concat(each("tops", lambda t: task(False, t, mine)), each("others", lambda o: task(True, F.least(mine, o), F.greatest(mine, o))))).otherwise(each("others", lambda o: task(False, mine, o)))
    rest = rest.withColumn("block", block).select("band", "rep", "class", "asks", F.explode(met).alias("t")).select("band", "t.*", "rep", "class", "asks")
    rest = rest.join(held.select("rep", "e", "w"), "rep")

    def compare_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asks", ascending=False, kind="stable")
        sets = [as_set(e, w) for e, w in zip(pdf["e"], pdf["w"], strict=True)]
        found = list(links(sets, pdf["rep"].to_list(), pdf["class"].to_list(), similarity, int(pdf["asks"].sum()), bool(pdf["among"].iloc[0])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="object")

    more = rest.groupBy("band", "among", "i", "j").applyInPandas(compare_all, "a binary, b binary")
    if few is not None:
        more = more.union(few.mapInArrow(compare, "a binary, b binary"))
    more = cut(more, "minhash-more-links")
    if report is not None:
        report |= {"comparisons": pairs.count(), "links": star.count(), "more_links": more.count()}
    if not more.isEmpty():
        # links between classes: only their ids are joined up again
        a, b = classes.toDF("a", "ca"), classes.toDF("b", "cb")
        between = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(between, "minhash-classes").toDF("root", "to")
        alone = joined.join(classes.select(F.col("id").alias("root")), "root", "left_anti")
        classes = classes.join(joined, "root", "left").select("id", F.coalesce("to", "root").alias("root")).union(alone)
    linked = distinct.join(classes.toDF("rep", "class"), "rep").select("rep", "class", "at")
    first = linked.groupBy("class").agg(F.min("at").alias("first_at"))
    linked = linked.join(first, "class").select("rep", "first_at")
    leads = cut(distinct.join(linked, "rep", "left").select("rep", "held", F.coalesce("first_at", "at").alias("lead")), "minhash-leads")
    led = with_hot(own, leads, "rep", n_rows).select("id", "raw", "lead")
    if nulls:
        return led
    return led.union(sketched.where("id IS NULL").select("id", "raw", F.lit(None).cast(led.schema["lead"].dataType)))


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, counted: bool = True, report: dict | None = None
) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, or without ids the smallest digest of its text; of rows that repeat both, that with the smallest hash."""
    led = lead_rows(docs, id_col, text_col, shingle, similarity, counted, report, nulls=True)
    at_id, at_raw, whole = fresh(docs, "at_id", "at_raw", "whole_row")
    stays = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("raw") == F.col("lead.raw"))
    judged = led.groupBy(F.col("id").alias(at_id), F.col("raw").alias(at_raw)).agg(F.first(stays).alias("stays"), F.count("*").alias("held"))
    judged = cut(judged.where("NOT stays OR held > 1"), "minhash-gone")
    gone, repeated = judged.where("NOT stays").select(at_id, at_raw), judged.where("stays").select(at_id, at_raw)
    own_id, own_raw = F.col(id_col).cast("long"), raw_digest(F.col(text_col).cast("string"))

    def match(some: DataFrame, n: int, how: str, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if n <= BROADCAST_IDS else some, own_id.eqNullSafe(F.col(at_id)) & (own_raw == F.col(at_raw)), how)

    kept = match(gone, gone.count(), "left_anti", docs)
    n = repeated.count()
    if not n:
        return kept
    row = F.struct(*map(named, docs.columns))
    order = F.xxhash64(*[named(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = match(repeated, n, "left_semi", kept).groupBy(own_id.alias(at_id), own_raw.alias(at_raw)).agg(F.min_by(row, order).alias(whole)).select(f"{whole}.*")
    return match(repeated, n, "left_anti", kept).union(one)
