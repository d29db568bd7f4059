"""Alignment of two tokenizations of the same bytes by a dangling-suffix transducer.

A state is the side that leads and those of its bytes that the other side has not matched
yet; the side behind reads its next token. Transitions are remembered by residual and token,
so each is worked out once in a worker. An empty residual closes a group. Every read but a
group's first links the token read with the other side's last one, so the links are all
pairs of tokens whose bytes overlap.

Corpus-wide counts of linked id pairs are summed from the distinct pairs of each document.
Counts come back to the documents in two ways: the most frequent pairs, at most ``head`` of
them, are broadcast; occurrences of the others, which are rare each, are joined by a shuffle.

Defined results: a null or empty text, and one whose tokens do not give back its bytes on
either side, has no tokens; null ids are kept; repeated rows are aligned and counted each; an
empty table gives no rows; columns besides the id and the text are ignored, whatever their
names; a very long text is aligned as a whole and must fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quorvia.llm.common import cut, named, record_batches
from quorvia.llm.packing import PLAIN, Encoder

#: Bound of the pairs whose counts are broadcast (16 bytes each).
HEAD = 1_000_000
#: Transitions that a worker remembers; then they are forgotten as a whole.
MOST_MOVES = 3_000_000
#: Who leads.
NOBODY, A, B = 0, 1, 2


class State(dict):
    """Next states by token, worked out when first asked for."""

    __slots__ = ("lead", "rest", "net")

    def __init__(self, lead: int, rest: bytes, net: Transducer):
        self.lead, self.rest, self.net = lead, rest, net

    def __missing__(self, token: int) -> State:
        found = self[token] = self.net.move(self, token)
        return found


class Mismatch(Exception):
    """The two sides do not spell the same bytes."""


class Transducer:
    """Walks two token sequences side by side; ``bytes_a`` and ``bytes_b`` are the tokens' bytes by id."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes = {A: bytes_a, B: bytes_b}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        self.moves = 0
        self.start = self.state(NOBODY, b"")

    def state(self, lead: int, rest: bytes) -> State:
        key = (lead, rest)
        if key not in self.states:
            self.states[key] = State(lead, rest, self)
        return self.states[key]

    def move(self, here: State, token: int) -> State:
        """The state after the side behind reads ``token``; A reads where nobody leads."""
        self.moves += 1
        behind = B if here.lead == A else A
        new = self.bytes[behind][token]
        if here.rest.startswith(new):
            rest, lead = here.rest[len(new) :], here.lead
        elif new.startswith(here.rest):
            rest, lead = new[len(here.rest) :], behind
        else:
            raise Mismatch
        return self.state(lead if rest else NOBODY, rest)

    def walk(self, a: list[int], b: list[int]) -> np.ndarray:
        """Who leads after each read. Raises ``Mismatch`` if the sides differ."""
        if self.moves > MOST_MOVES:
            self.forget()
        next_a, next_b = iter(a).__next__, iter(b).__next__
        here, trace = self.start, bytearray()
        put = trace.append
        try:
            while True:
                here = here[next_b() if here.lead == A else next_a()]
                put(here.lead)
        except StopIteration:
            pass
        if here.lead != NOBODY or len(trace) != len(a) + len(b):
            raise Mismatch
        return np.frombuffer(bytes(trace), np.uint8)


#: An alignment: tokens of A and of B, groups, their text, linked pairs (binary, unsigned 32-bit) in order of reading.
Aligned = tuple[int, int, int, str, bytes]


#: A space at which both tokenizers start a token, whatever stands around it.
START = re.compile(r"(?<! )(?= \S)")
#: What makes a text's spaces differ from those that single ``split`` cuts.
UNEVEN = re.compile(r"^\s| (?:\s|$)")
#: A word that can stand between others, and the mark that stands for a space in B's pieces.
EVEN, MARK = re.compile(r" \S(?s:.*)(?<! )"), "▁"


class Aligner:
    """Two tokenizers, their tokens' bytes and the transducer between them.

    No token of either side goes on beyond a single space before a word, so the residual is
    empty there, and a text's alignment is made of those of its words. New words are walked one
    after the other, as one text; ``most`` of them are remembered, if not longer than ``longest``.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 600_000, longest: int = 100, at_once: int = 4000):
        import sentencepiece

        self.known: dict[str, Aligned | None] = {}
        self.most, self.longest, self.at_once = most, longest, at_once
        # an encoder of its own: special tokens' strings in a text are plain text here
        self.encode_a = Encoder(path_a)
        self.encode_a.slow.encode_special_tokens = True
        m = self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        file_a = self.encode_a.slow
        pieces_a = [file_a.id_to_token(i) for i in range(file_a.get_vocab_size())]
        bytes_a = [bytes(byte[c] for c in p) for p in pieces_a]
        pieces_b = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces_b)]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces_b)
        self.n_a, self.n_b = len(bytes_a), len(bytes_b)
        self.bytes_b = bytes_b
        self.lengths = np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b])
        self.net = Transducer(bytes_a, bytes_b)
        # an id with the mark before it: of a group, of its second side, or between ids
        self.marked = [f"{mark}{i}" for n, marks in ((self.n_a, ";,"), (self.n_b, "|,")) for mark in marks for i in range(n)]

    def walked(self, spelled: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A, ids of B and the trace of a text that starts with the space which B adds itself; none if the bytes differ."""
        b = self.model_b.encode(spelled[1:])
        if b"".join(map(self.bytes_b.__getitem__, b)) != spelled.encode("utf-8", "surrogatepass"):
            return None
        a = self.encode_a(spelled)
        try:
            trace = self.net.walk(a.tolist(), b)
        except Mismatch:
            return None
        return a.astype(np.int64), np.array(b, np.int64), trace

    def align(self, words: list[str]) -> list[Aligned | None]:
        """The alignments of words that stand one after the other; several are all even ones."""
        found = self.walked("".join(words))
        if found is None:
            return [None] if len(words) == 1 else [x for w in words for x in self.align([w])]
        a, b, trace = found
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in words])
        upto_a = np.concatenate([[0], np.searchsorted(np.cumsum(self.lengths[0][a]), ends, "right")])
        upto_b = np.concatenate([[0], np.searchsorted(np.cumsum(self.lengths[1][b]), ends, "right")])
        steps = upto_a + upto_b
        before = np.concatenate([[NOBODY], trace[:-1]])
        groups = np.concatenate([[0], np.cumsum(before == NOBODY)])[steps]
        texts, links = self.groups(a, b, trace), self.links(a, b, trace).astype("<u4").tobytes()
        out: list[Aligned | None] = []
        places = zip(upto_a.tolist(), upto_b.tolist(), groups.tolist(), steps.tolist(), strict=True)
        s_a, s_b, s_g, s = next(places)
        for e_a, e_b, e_g, e in places:
            # a read that opens a group makes no link
            out.append((e_a - s_a, e_b - s_b, e_g - s_g, "".join(texts[s:e])[1:], links[4 * (s - s_g) : 4 * (e - e_g)]))
            s_a, s_b, s_g, s = e_a, e_b, e_g, e
        return out

    def words(self, text: str) -> list[str]:
        """A text in pieces that start at such spaces, the one that B adds before it included."""
        if not text:
            return []
        if not self.by_word:
            return [" " + text]
        if UNEVEN.search(text):
            return [w for w in START.split(" " + text) if w]
        return [" " + w for w in text.split(" ")]

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray] | None]:
        """For each text its tokens of A and B, groups, their text, distinct linked pairs and how
        often each; none if it has no tokens."""
        every = [self.words(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = {w for words in every for w in words if w not in known}
        even, long = [], []
        for w in new:
            if len(w) > self.longest or MARK in w or not EVEN.fullmatch(w):
                long.append(w)
            else:
                even.append(w)
        # the slower encoder takes only those that need it
        even.sort(key=lambda w: PLAIN.search(w) is not None)
        cut = sum(PLAIN.search(w) is None for w in even)
        for part in (even[:cut], even[cut:]):
            for i in range(0, len(part), self.at_once):
                some = part[i : i + self.at_once]
                known.update(zip(some, self.align(some), strict=True))
        for w in long:
            known[w] = self.align([w])[0]
        for words in every:
            found = [known[w] for w in words]
            if not found or None in found:
                yield None
                continue
            pairs, times = np.unique(np.frombuffer(b"".join([x[4] for x in found]), "<u4"), return_counts=True)
            yield sum([x[0] for x in found]), sum([x[1] for x in found]), sum([x[2] for x in found]), ";".join([x[3] for x in found]), pairs, times
        for w in long:
            if len(w) > self.longest:
                del known[w]

    def groups(self, a: np.ndarray, b: np.ndarray, trace: np.ndarray) -> list[str]:
        """``;a1`` ``,a2`` ``|b1``: the ids of both sides with their marks, group by group."""
        before = np.concatenate([[NOBODY], trace[:-1]])
        group = np.cumsum(before == NOBODY) - 1
        of_b = before == A
        group_a, group_b = group[~of_b], group[of_b]
        every = np.arange(group[-1] + 1)
        codes = np.empty(len(trace), np.int64)
        first_a = np.concatenate([[True], group_a[1:] != group_a[:-1]])
        first_b = np.concatenate([[True], group_b[1:] != group_b[:-1]])
        codes[np.arange(len(a)) + np.searchsorted(group_b, every)[group_a]] = a + np.where(first_a, 0, self.n_a)
        codes[np.arange(len(b)) + np.searchsorted(group_a, every, "right")[group_b]] = b + 2 * self.n_a + np.where(first_b, 0, self.n_b)
        return list(map(self.marked.__getitem__, codes.tolist()))

    def links(self, a: np.ndarray, b: np.ndarray, trace: np.ndarray) -> np.ndarray:
        """The linked pairs as id of A times ids of B plus id of B, in order of reading."""
        before = np.concatenate([[NOBODY], trace[:-1]])
        of_b = before == A
        linked = before != NOBODY
        return (a[np.cumsum(~of_b) - 1] * self.n_b + b[np.maximum(np.cumsum(of_b) - 1, 0)])[linked]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, read once in each worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number of its own), n_a, n_b, n_groups, n_links, groups (the ids, group
    by group), pairs and times (distinct linked pairs, ascending, and how often each: binary,
    little-endian unsigned 32-bit).

    path_a: a byte-level BPE file of tokenizers; path_b: a model of sentencepiece that writes
    a space before the text.
    """
    source = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *StructType.fromDDL("row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for batch in record_batches(batches):
            out: list[list] = [[] for _ in range(8)]
            for found in align([t or "" for t in batch.column("text").to_pylist()]):
                values: tuple = (0, 0, 0, 0, "", b"", b"")
                if found:
                    n_a, n_b, n_groups, groups, pairs, times = found
                    # a group of so many tokens has one link fewer
                    values = (n_a, n_b, n_groups, n_a + n_b - n_groups, groups, pairs.tobytes(), times.astype("<u4").tobytes())
                for column, value in zip(out, (row, *values), strict=True):
                    column.append(value)
                row += 1
            types = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], schema.names)

    return source.mapInArrow(run, schema)


def piece_count(path: str) -> int:
    """Ids of a sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def u4(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, total (links in all documents) and best (no pair of its id of B has more)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = merged = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(back, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in merge()], ["pair", "times"])

        for batch in batches:
            for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                if pairs:
                    held.append((u4(pairs), u4(times)))
                    size += len(held[-1][0])
            if size > max(2_000_000, 2 * merged):
                if merged > 1_000_000:  # a task holds a few million pairs; the shuffle sums what it gives in turns
                    yield give()
                    held, size, merged = [], 0, 0
                else:
                    held = [merge()]
                    size = merged = len(held[0][0])
        if held:
            yield give()

    sums = aligned.select("pairs", "times").mapInArrow(partial, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("total"))
    sums = cut(sums, "pair-counts")
    # one row for each id of B, whatever the input
    most = sums.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("total").alias("most"))
    return sums.join(F.broadcast(most), (F.col("pair") % n_b) == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, n_b: int, *, head: int = HEAD) -> DataFrame:
    """row, n_best (links whose count is the highest of their id of B) and count_sum (over links).

    ``aligned`` is a written table of ``align_documents``, so that its rows keep their numbers.
    """
    counts = pair_counts(aligned, n_b)
    # the smallest power of two that at most ``head`` pairs reach
    levels = counts.groupBy(F.floor(F.log2("total")).cast("int").alias("level")).count().collect()
    least, room = 62, head
    for level, n in sorted(((r.level, r["count"]) for r in levels), reverse=True):
        if n > room:
            break
        least, room = level, room - n
    frequent = counts.where(F.col("total") >= F.lit(1 << least))
    rows = (frequent if least < 62 else frequent.limit(0)).toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "total", "best")))
    all_held = sum(r["count"] for r in levels) == rows.num_rows

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals, best = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                p, t = u4(pairs), u4(times).astype(np.int64)
                at = np.minimum(np.searchsorted(known, p), max(len(known) - 1, 0))
                hit = known[at] == p if len(known) else np.zeros(len(p), bool)
                at = at[hit]
                for column, value in zip(out, (int(t[hit][best[at]].sum()), int((t[hit] * totals[at]).sum()), p[~hit].tolist(), t[~hit].tolist()), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, k) for x, k in zip(out, types, strict=True))], ["row", "n_best", "count_sum", "pairs", "times"])

    found = aligned.select("row", "pairs", "times").mapInArrow(look_up, "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    if all_held:
        return found.select("row", "n_best", "count_sum")
    # each of these pairs is rarer than those broadcast, so no key of the join is hot
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    joined = rare.join(counts.where(F.col("total") < F.lit(1 << least)), "pair")
    parts = joined.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("total")).alias("count_sum"))
    return found.select("row", "n_best", "count_sum").unionAll(parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
