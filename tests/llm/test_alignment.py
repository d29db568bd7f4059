import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quorvia.llm import alignment
from quorvia.llm.alignment import Aligner, Mismatch, Transducer, align_documents, link_sums, piece_count
from quorvia.llm.common import cut
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Tokens with byte places, from the libraries alone; groups and links by comparing places."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(c): c for c in chars}
        self.byte |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}

    def tokens(self, text):
        spelled = (" " + text).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or b"".join(t for _, t in a) != spelled or b"".join(t for _, t in b) != spelled:
            return [], []
        return a, b

    def of(self, text):
        sides = []
        for tokens in self.tokens(text):
            at, placed = 0, []
            for i, t in tokens:
                placed.append((at, at + len(t), i))
                at += len(t)
            sides.append(placed)
        a, b = sides
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, links, start = [], [], 0
        for end in ends:
            in_a, in_b = ([x for x in side if start <= x[0] < end] for side in sides)
            groups.append(",".join(str(x[2]) for x in in_a) + "|" + ",".join(str(x[2]) for x in in_b))
            links += [(x[2], y[2]) for x in in_a for y in in_b if x[0] < y[1] and y[0] < x[1]]
            start = end
        return len(a), len(b), groups, links


def expected(texts):
    plain = Plain()
    found = [plain.of(t or "") for t in texts]
    counts = Counter(x for f in found for x in f[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def test_query_against_plain_places(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((d.doc_id for d in docs), expected([d.text for d in docs]), strict=True))
    rows = QUERIES["op12_alignment"](spark, SF).collect()
    assert len(rows) == len(docs) > 100
    for r in rows:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id]


ODD = [None, "", " ", "a", "<|endoftext|> and <s> </s> <unk>", "two  spaces", " led", "tail ", "tabs\tand\nlines\r\n", "naïve café 日本語 🙂🙃 é", "▁ a mark", "x▁y", "don't we'll I'D", "\x00\x01", "ﬁ ligature ½", "word " * 5000, "a b 　c", "لغة عربية שלום"]


@pytest.mark.parametrize("head", [0, 5, 10**6])
def test_odd_rows_and_any_head(spark, head):
    rows = [*enumerate(ODD), *enumerate(ODD[:5]), (None, "a null id"), (None, "a null id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, `n.a` string").repartition(3)
    aligned = cut(align_documents(docs, A, B), "test-aligned")
    sums = {r.row: r for r in link_sums(aligned, piece_count(B), head=head).collect()}
    got = []
    for r in aligned.collect():
        digest = hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
        got.append((r.n_a, r.n_b, r.n_groups, r.n_links, sums[r.row].n_best, sums[r.row].count_sum, digest))
    assert sorted(got) == sorted(expected([t for _, t in rows]))
    empty = cut(align_documents(docs.limit(0), A, B), "test-none")
    assert link_sums(empty, piece_count(B), head=head).count() == 0


def test_words_are_aligned_as_in_their_text(spark):
    """Texts cut at single spaces against the alignment of the whole text."""
    align = Aligner(A, B, most=50, longest=30, at_once=7)
    spaces = [" ", "  ", "\n", " \n", "\n ", "\n \n", "\t", "\u00a0", " \u3000", "\x1c", "\u0085 ", " \u2028"]
    rng = random.Random(4)
    made = ["".join(rng.choice(["a", "Bc", "é", "12", "'s", "...", "日", "<s>", "▁"]) + rng.choice(spaces) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    texts = [t for t in ODD if t] + made + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    assert align.by_word
    for i in range(0, len(texts), 40):
        for t, got in zip(texts[i : i + 40], align(texts[i : i + 40]), strict=True):
            whole = align.align([" " + t])[0]
            assert (got is None) == (whole is None), t
            if whole:
                pairs = Counter(np.frombuffer(whole[4], "<u4").tolist())
                assert got[:4] == whole[:4] and dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == pairs, t


def test_transducer_tracks_the_longer_side(monkeypatch):
    net = Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"bcd", b"x"])
    assert net.walk([0, 1], [0, 1]).tolist() == [1, 1, 2, 0]  # ab leads by b, bc by c
    assert net.walk([2, 3], [0, 2]).tolist() == [1, 1, 2, 0]
    assert net.walk([], []).tolist() == []
    for a, b in (([0], [0]), ([0], [3]), ([0, 1], [0, 1, 0]), ([1], [])):
        with pytest.raises(Mismatch):
            net.walk(a, b)
    moves = net.moves
    net.walk([0, 1], [0, 1])
    assert net.moves == moves
    monkeypatch.setattr(alignment, "MOST_MOVES", 0)
    assert net.walk([0, 1], [0, 1]).tolist() == [1, 1, 2, 0] and net.moves < moves


def test_groups_and_links_of_a_text():
    align = Aligner(A, B)
    found = align.align([" hello wörld"])[0]
    assert ";".join(Plain().of("hello wörld")[2]) == found[3]
    assert [(x // align.n_b, x % align.n_b) for x in np.frombuffer(found[4], "<u4").tolist()] == Plain().of("hello wörld")[3]
