"""Tokenizer alignment against a plain walk over the libraries' own tokens."""

import hashlib
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridjobs.llm import alignment
from gridjobs.llm.tokens import byte_alphabet, path_of
from tests.llm.test_operators import DOCS, HARD

DATA = "/root/testdata/sf0.001"


class Libraries:
    def __init__(self):
        self.a = Tokenizer.from_file(path_of("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))
        self.stand_ins = byte_alphabet()

    def groups(self, text):
        """[(a ids, b ids)] of the text, none if it has no tokens."""
        if not text:
            return []
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.stand_ins[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        pieces = [(i, self.b.id_to_piece(i)) for i in self.b.encode(text)]
        b = [(i, bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in pieces]
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return []
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        out, cuts = [], sorted(ends[0] & ends[1])
        for side in (a, b):
            at, k, rows = 0, 0, [[] for _ in cuts]
            for i, x in side:
                at += len(x)
                while cuts[k] < at:
                    k += 1
                rows[k].append(i)
            out.append(rows)
        return list(zip(*out))


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def brute(libraries, rows):
    groups = [libraries.groups(t) for _, t in rows]
    links = [[(a, b) for x, y in g for a in x for b in y] for g in groups]
    count, most = {}, {}
    for own in links:
        for p in set(own):
            count[p] = count.get(p, 0) + 1
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (k, _), g, own in zip(rows, groups, links):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((str(k), sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return sorted(out)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def told(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in df.collect())


def test_whole_table(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert told(alignment.op13_alignment(spark, DATA)) == brute(libraries, rows)


@pytest.mark.parametrize("links, keep", [(alignment.LINKS, alignment.KEEP), (1, 3), (200, alignment.KEEP)])
def test_hard_cases(spark, libraries, monkeypatch, links, keep):
    """Nulls, empties, repeats, special strings, odd white space; many small blocks, a forgetful worker."""
    monkeypatch.setattr(alignment, "KEEP", keep)
    monkeypatch.setattr(alignment, "CHARS", 40)
    more = [(20, "a▁b"), (21, "a   b　 c"), (22, " \n x \t y  "), (23, "x<s> <unk></s><0x0A> z"), (24, "\x00 \x1c a\x1f b"), (25, "é \U0001f600‍ ﬁ"), (26, " "), (None, None), (27, "it's  'll don’t--x")]
    rows = [(r[0], r[1]) for r in HARD] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumns({c: F.lit(1) for c in ("block", "kind", "pair", "at", "n", "count", "best", "ids", "docs", "no_id")})
    assert told(alignment.align_documents(docs, links=links)) == brute(libraries, rows)
    assert told(alignment.align_documents(spark.createDataFrame([], DOCS))) == []


def test_very_long_texts_through_spark(spark, libraries):
    rows = [(1, "some words, and more of them. " * 20_000), (2, "nospace" * 3000), (3, "日本" * 4000), (4, "x")]
    assert told(alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(libraries, rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t 　▁ab'.,<>s1é日\U0001f600\x00\x85"), max_size=40), min_size=1, max_size=6))
def test_odd_texts(libraries, texts):
    if not hasattr(test_odd_texts, "at"):
        test_odd_texts.at = alignment.Aligner(path_of("byte_bpe_50k.json"), path_of("piece_bpe_32k.model"))
    at = test_odd_texts.at
    for t, got in zip(texts, at.aligned(texts)):
        want = libraries.groups(t)
        if not want:
            assert got is None
            continue
        string = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
        assert got[:4] == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want), len(want), sum(len(x) * len(y) for x, y in want))
        assert got[4] == hashlib.sha256(string.encode()).hexdigest()
        assert len(got[5]) == got[3]


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_pointer_jumping_finds_common_ends(a, b):
    a, b = (np.array(sorted(x | {61})) for x in (a, b))
    in_a, in_b = alignment.jumped(a, b)
    cuts = np.intersect1d(a, b)
    assert (np.unique(in_a, return_inverse=True)[1] == np.searchsorted(cuts, a)).all()
    assert (np.unique(in_b, return_inverse=True)[1] == np.searchsorted(cuts, b)).all()
    assert set(in_a) == set(in_b)
