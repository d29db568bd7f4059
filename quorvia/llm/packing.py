"""Sum-of-squares online packing of documents into token windows.

Each document goes to the fill level that keeps the sum of squared counts of partially
filled windows smallest; the counts are kept in a level array. A document may also be cut to
fill a window, at a price in squares: levels that many windows have come to share are worn
off by cuts, so what a task holds open is bounded by levels and price, not by its input.
Packing needs no shuffle: every scan task packs what it reads, so sequence ids hold the
task's number in their upper bits, and a task that runs again gives the same sequences.

Defined results: a null or empty text is the closing id alone; a null id is kept as null;
repeated rows are packed each; an empty table gives no rows; columns besides the id and the
text are ignored, whatever their names. A document longer than a window fills whole windows
first and only its rest is placed. At the end of a task, windows that are still open are
placed into each other by the same choice with free cuts, and the last is cut at powers of
two; so no sequence is padded.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import record_batches

#: Characters on whose classes both tokenizer libraries agree by test; others take the slow one.
PLAIN = re.compile("[^\x00-ɏ -⁯₠-₿]")
END_TEXT = "<|endoftext|>"
#: Squares that a cut must save to be made.
CUT_PRICE = 4.0


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    Most texts are encoded from the same vocabulary by tiktoken, which is about four times
    as fast; texts with characters outside ``PLAIN`` or with the special token's string go
    through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # byte-level files write each byte as one printable character
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token != END_TEXT}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or END_TEXT in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, read once in each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SquareSums:
    """Partially filled windows by level, and where the next item goes.

    cut_price: what a cut adds to the sum of squares when places are compared.
    """

    def __init__(self, window: int, cut_price: float = CUT_PRICE):
        self.window, self.cut_price = window, cut_price
        self.count = np.zeros(window + 1)
        # opening and closing change one square only, the others two: worth half a window each
        self.count[0], self.count[window] = 0.5, -0.5
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level whose choice makes the sum of squares smallest; ties to the fullest.

        In a window that is too full the item is cut where the window ends, and what is left
        of it is reckoned as a window of its own.
        """
        below = self.count[: self.window]
        to = np.concatenate([self.count[size:], self.count[1:size] + self.cut_price / 2])
        change = np.where(below == 0, np.inf, to - below)
        return self.window - 1 - int(np.argmin(change[::-1]))

    def place(self, pieces: list[tuple], size: int) -> list[list[tuple]]:
        """Put pieces of ``size`` ids into a window, or cut them; gives the windows that they fill."""
        full = []
        while size:
            level = self.level_for(size) if self.n_open else 0
            window: list[tuple] = []
            if level:
                window = self.open[level].pop()
                self.count[level] -= 1
                self.n_open -= 1
            own, pieces = split(pieces, self.window - level)
            window += own
            filled = min(self.window, level + size)
            size -= filled - level
            if filled == self.window:
                full.append(window)
            else:
                self.open[filled].append(window)
                self.count[filled] += 1
                self.n_open += 1
        return full

    def finish(self) -> Iterator[list[tuple]]:
        """Close the open windows by the same choice, with cuts free and no new window.

        The emptiest is taken out and its pieces are placed into the others, until one is
        left; that is cut at powers of two, which need no padding.
        """
        self.cut_price, self.count[0] = 0.0, 0.0
        while self.n_open > 1:
            level = min(k for k, windows in self.open.items() if windows)
            self.count[level] -= 1
            self.n_open -= 1
            yield from self.place(self.open[level].pop(), level)
        for held, windows in self.open.items():
            for flow in windows:
                while held:
                    size = 1 << (held.bit_length() - 1)
                    part, flow = split(flow, size)
                    held -= size
                    yield part


def split(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` ids of pieces (id, start, ids, document's ids), and the others."""
    head: list[tuple] = []
    for i, (key, start, ids, total) in enumerate(pieces):
        if size >= len(ids):
            head.append((key, start, ids, total))
            size -= len(ids)
            continue
        if not size:
            return head, pieces[i:]
        head.append((key, start, ids[:size], total))
        return head, [(key, start + size, ids[size:], total), *pieces[i + 1 :]]
    return head, []


def pack(rows: Iterator[tuple[object, np.ndarray]], window: int) -> Iterator[list[tuple]]:
    """Closed windows for (document id, ids) rows."""
    sums = SquareSums(window)
    for key, ids in rows:
        start, total = 0, len(ids)
        while total - start >= window:
            yield [(key, start, ids[start : start + window], total)]
            start += window
        yield from sums.place([(key, start, ids[start:], total)], total - start)
    yield from sums.finish()


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, padding (of its sequence, on the sequence's first piece)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padding long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        kind: list[pa.DataType] = []

        def rows() -> Iterator[tuple[object, np.ndarray]]:
            for batch in record_batches(batches):
                if not kind:
                    kind.append(batch.schema.field("doc_id").type)
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    yield key, np.concatenate([encode(text or ""), end])

        out: list[list] = [[] for _ in range(8)]

        def flush() -> pa.RecordBatch:
            types = [kind[0], pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padding"]
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
            for x in out:
                x.clear()
            return made

        base = TaskContext.get().partitionId() << 32
        for number, pieces in enumerate(pack(rows(), window)):
            filled = sum(len(x[2]) for x in pieces)
            padding = 0 if filled & (filled - 1) == 0 else window - filled
            offset = 0
            for key, start, ids, total in pieces:
                for column, value in zip(out, (key, start, len(ids), ids.astype("<u4").tobytes(), total, base + number, offset, 0 if offset else padding), strict=True):
                    column.append(value)
                offset += len(ids)
            if len(out[0]) >= 1000:
                yield flush()
        if out[0]:
            yield flush()

    return source.mapInArrow(run, schema)
