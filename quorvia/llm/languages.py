"""Languages of spans: script ranges, scores of words, and Viterbi with a switching penalty.

A word is a run of letters. Its script narrows the candidates to the languages that were seen
to use it; its score for each candidate adds up the log-odds of its character n-grams (with
its edges), which are counted on a bounded sample of labelled documents. Viterbi over a
document's words labels each with a language, where every change of language costs a
penalty; equal neighbours make spans. A document's language is that of most of its letters.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and has no
spans; so is every text if no language was learned. A word in a script that no learned
language uses is scored for all of them, and a word that tells nothing takes the language of
its neighbours, or the commonest. A null id is predicted, never learned from and not held
out; of rows that repeat an id one is learned from; repeated rows are predicted each; an
empty table gives no rows; the caller's columns, whatever their names, are not looked at
except the id, the text and the language; a very long text is labelled as a whole and must
fit into a task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quorvia.llm.common import named, record_batches

#: Bound of the labelled documents that are learned from: those with the smallest id hashes.
MAX_ROWS = 20_000
#: Sizes of character n-grams, from 2 on, and the bits of their hashed places; the place after the last is for none.
SIZES, BITS = (2, 3, 4), 17
#: Bytes of text that are scored at once.
BATCH_BYTES = 2 << 20
#: Rows that stand for not having seen an n-gram.
PSEUDO = 2.0
#: What a change of language costs, in units of a word's score, and what an n-gram is worth of its log-odds.
PENALTY, WORTH = 6.0, 0.35
#: A language uses a script if it writes this share of its letters in it.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"

# fixed values: first and last code points of scripts (Unicode blocks); 0 is any other
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("latin", 0xFF21, 0xFF5A),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, whether a letter, whether part of a word (letters and marks), script."""
    every = [chr(i) for i in range(0x110000)]
    lower = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(map(str.lower, every))], np.uint32)
    letter = np.fromiter(map(str.isalpha, every), bool, len(every))
    part = letter | np.fromiter((unicodedata.category(x)[0] == "M" for x in every), bool, len(every))
    script = np.zeros(len(every), np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, letter, part, script


class Words(NamedTuple):
    """The words of some texts. text: which text; start, end: places in it; letters: their number;
    first: where a word's n-grams begin; places: hashed n-grams by size and place of their first character."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    places: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters and marks that hold a letter, with the hashed n-grams of each."""
    lower, letter, part, script = characters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = np.concatenate([[False], part[codes], [False]])
    start = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(~inside[1:] & inside[:-1])
    upto = np.concatenate([[0], np.cumsum(letter[codes], dtype=np.int32)])
    letters = upto[end] - upto[start]
    kept = letters > 0
    start, end, letters = start[kept], end[kept], letters[kept]
    text = np.searchsorted(begins, start, "right") - 1
    # the words one after the other, each with a space before it, and spaces at the end
    sizes = (end - start).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    place = np.arange(first[-1], dtype=np.int32)
    spot = place - np.repeat(first[:-1].astype(np.int32), sizes + 1)  # 0 is the space
    room = np.repeat(sizes + 2, sizes + 1) - spot  # characters from here to the space after the word
    line = np.full(first[-1] + SIZES[-1], 32, np.uint32)
    line[: first[-1]][spot > 0] = lower[codes[(np.repeat(start.astype(np.int32) - 1, sizes + 1) + spot)[spot > 0]]]
    hashed, places = line[: first[-1]].copy(), np.empty((len(SIZES), first[-1]), np.int32)
    for n in range(2, SIZES[-1] + 1):
        hashed = hashed * np.uint32(0x01000193) + line[n - 1 : n - 1 + len(hashed)]
        if n in SIZES:
            spread = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1)
            places[SIZES.index(n)] = np.where(room >= n, spread >> np.uint32(32 - BITS), 1 << BITS)
    return Words(text, start - begins[text], end - begins[text], letters, script[codes[start]], first[:-1], places)


class Model(NamedTuple):
    """Languages in order of name, log-odds by place and language, who uses which script, and shares."""

    languages: list[str]
    odds: np.ndarray
    uses: np.ndarray
    share: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """A row for each word, a column for each language; no candidate is minus infinity."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)))
        found = self.odds[words.places[0]]
        for places in words.places[1:]:
            found += self.odds[places]
        return np.where(self.uses[words.script], WORTH * np.add.reduceat(found, words.first), -np.inf)


def model_of(counts: dict[tuple[str, int], int], scripts: dict[tuple[str, int], int], rows: dict[str, int]) -> Model:
    """From n-gram counts by (language, place), letters by (language, script) and documents by language."""
    languages = sorted(rows)
    number = {x: i for i, x in enumerate(languages)}
    seen = np.zeros(((1 << BITS) + 1, len(languages)))
    for (language, place), n in counts.items():
        seen[place, number[language]] = n
    total = seen.sum(axis=0)
    common = (seen / np.maximum(total, 1)).sum(axis=1) / max(len(languages), 1)
    odds = np.log((seen + PSEUDO) / (common[:, None] * total + PSEUDO)).astype(np.float32)
    letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for (language, script), n in scripts.items():
        letters[script, number[language]] = n
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    uses[~uses.any(axis=1)] = True
    share = np.array([rows[x] for x in languages], float)
    return Model(languages, odds, uses, share / max(share.sum(), 1))


def viterbi(scores: np.ndarray, begins: np.ndarray, ends: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; rows from ``begins`` to ``ends`` are one text's words.

    All texts take a step at once, the longest first, so that those that still go on are the first.
    """
    n, k = scores.shape
    best = np.zeros(n, np.int64)
    order = np.argsort(begins - ends, kind="stable")
    begins, lengths = begins[order], (ends - begins)[order]
    going = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")  # texts longer than t
    back = np.empty((n, k), np.uint8 if k < 256 else np.uint32)
    own = np.arange(k)
    held = np.tile(prior, (len(begins), 1))
    for t, m in enumerate(going):
        now = held[:m]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(m), top][:, None] - penalty
            stays = now >= switched
            back[begins[:m] + t] = np.where(stays, own, top[:, None])
            now = np.where(stays, now, switched)
        held[:m] = now + scores[begins[:m] + t]
    last = held.argmax(axis=1)
    for t in range(len(going) - 1, -1, -1):
        m = going[t]
        at = begins[:m] + t
        best[at] = last[:m]
        if t:
            last[:m] = back[at, last[:m]]
    return best


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of the id, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Count n-grams by language on at most ``max_rows`` labelled documents."""
    usable = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang"))
    usable = usable.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    # a first cut by hash leaves some times the bound, however long the table is
    n = max(usable.select("id").count(), 1)
    order = F.xxhash64("id")
    near = order <= F.lit(min(2**63 - 1, int(2**64 * (4 * max_rows / n)) - 2**63))
    sample = usable.where(near).select("id", order.alias("order")).distinct().orderBy("order", "id").limit(max_rows)
    rows = usable.where(near).join(F.broadcast(sample.select("id")), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("one")).select("one.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in record_batches(batches):
            by_language: dict[str, list[str]] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_language.setdefault(language, []).append(text or "")
            for language, some in by_language.items():
                words = words_of(some)
                seen[language] = seen.get(language, 0) + np.bincount(words.places.ravel(), minlength=(1 << BITS) + 1)[:-1]
                letters[language] = letters.get(language, 0) + np.bincount(words.script, words.letters, len(SCRIPT_NAMES)).astype(np.int64)
                texts[language] = texts.get(language, 0) + len(some)
        for language in texts:
            for kind, found in ((0, seen[language]), (1, letters[language]), (2, np.array([texts[language]]))):
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "kind", "place", "n"]
                )

    # a row for each language and place at most
    sums = rows.mapInArrow(count, "lang string, kind int, place int, n long").groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).toArrow()
    kinds: tuple[dict, dict, dict] = ({}, {}, {})
    for language, kind, place, n in zip(*(sums.column(c).to_pylist() for c in ("lang", "kind", "place", "n")), strict=True):
        kinds[kind][language, place] = n
    return model_of(kinds[0], kinds[1], {language: n for (language, _), n in kinds[2].items()})


def label_spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in that language) and spans (lang, start,
    end: places in the text; n_words)."""
    source = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *StructType.fromDDL("lang_pred string, score double, spans array<struct<lang:string,start:long,end:long,n_words:long>>").fields])
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names, k = model.languages, len(model.languages)
        for batch in record_batches(batches, BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            spans: list[list[dict]] = [[] for _ in texts]
            words = words_of(texts)
            if k and len(words.start):
                new = np.concatenate([[True], words.text[1:] != words.text[:-1]])
                begins = np.flatnonzero(new)
                best = viterbi(model.scores(words), begins, np.append(begins[1:], len(new)), 0.001 * np.log(np.maximum(model.share, 1e-9)), penalty)
                letters = np.bincount(words.text * k + best, words.letters, len(texts) * k).reshape(-1, k)
                for i in words.text[begins].tolist():
                    at = int(letters[i].argmax())
                    languages[i], scores[i] = names[at], float(letters[i, at] / letters[i].sum())
                heads = np.flatnonzero(new | np.concatenate([[True], best[1:] != best[:-1]]))
                tails = np.append(heads[1:], len(new))
                for i, b, s, e, n in zip(words.text[heads].tolist(), best[heads].tolist(), words.start[heads].tolist(), words.end[tails - 1].tolist(), (tails - heads).tolist(), strict=True):
                    spans[i].append({"lang": names[b], "start": s, "end": e, "n_words": n})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span_type)], schema.names)

    return source.mapInArrow(run, schema)


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document."""
    labelled = label_spans(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), id_col=id_col, text_col=text_col)
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
