"""Alignment of two tokenizers by pointer jumping, and how often ids meet across the corpus.

Both tokenizers start anew where a blank follows a character that is no white space, so a text falls into
units there, and each worker aligns a unit once. The tokens of a batch of new units lie end to end on one
byte axis. Every token points to the token that ends farthest right among those it overlaps; doubling the
successors leads each to the last token of its component, whose name is the group's.

Documents are worked on in blocks. A block keeps its links as numbers in its own dictionary of id pairs;
only dictionaries meet the corpus-wide counts, and come back to their blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.chunks import BREAK_BYTE, Clash, Growing, Numbers, packed
from gridjobs.llm.common import given_back, ids_and_texts, text_batches, written
from gridjobs.llm.tokens import WIDE_SPACE, byte_alphabet, groups_of, path_of, utf8

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of a block, units that a worker remembers, characters that are cut at once.
LINKS = 1 << 21
KEEP = 400_000
CHARS = 1 << 19
#: White space beyond ASCII before a blank: such a text is one unit.
_wide_before_blank = re.compile(f"[{WIDE_SPACE}] ").search
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), 32, BREAK_BYTE]] = True


def jumped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each token of two sequences that cover the same bytes, as the place where it ends.

    ends: ascending byte offsets. Tokens are numbered by end, those of b after those of a. The token that
    ends farthest right among a token's overlapping ones is the other sequence's token over its last byte,
    or itself.
    """
    na, nb = len(ends_a), len(ends_b)
    # number of a token: tokens of both sequences that end before it
    name_a = np.arange(na) + np.searchsorted(ends_b, ends_a)
    name_b = np.arange(nb) + np.searchsorted(ends_a, ends_b, side="right")
    to = np.empty(na + nb, np.int64)
    to[name_a] = name_b[np.searchsorted(ends_b, ends_a)]
    over = name_a[np.searchsorted(ends_a, ends_b)]
    to[name_b] = np.maximum(over, name_b)
    while True:
        after = to[to]
        if (after == to).all():
            return to[name_a], to[name_b]
        to = after


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces of flat that start there and are so long, end to end."""
    return flat[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]


def lengths(parts: list) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


#: Units that a library gets as one text.
JOINED = 200
#: Decimal digits of ids below 100,000, and how many there are.
DIGITS = np.frombuffer(b"".join(b"%-6d" % i for i in range(100_000)), np.uint8).reshape(-1, 6)
DIGIT_COUNT = lengths([b"%d" % i for i in range(100_000)])


class Vocabulary:
    """Bytes of each id's token."""

    def __init__(self, tokens: list[bytes]):
        self.lens, self.flat = lengths(tokens), np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.starts[ids], self.lens[ids])


class Aligner:
    """Aligned units of this worker, and their numbers of tokens, groups, links, and pairs of ids."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.bytes_library = Tokenizer.from_file(byte_file)
        self.bytes_library.no_truncation()
        self.bytes_library.no_padding()
        self.bytes_library.encode_special_tokens = True
        self.pieces_library = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        stand_ins = byte_alphabet()
        known = self.bytes_library.get_vocab()
        tokens = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            tokens[i] = bytes(stand_ins[c] for c in token) if all(c in stand_ins for c in token) else utf8(token)
        names = [self.pieces_library.id_to_piece(i) for i in range(self.pieces_library.vocab_size())]
        self.a = Vocabulary(tokens)
        self.b = Vocabulary([bytes((int(p[3:5], 16),)) if re.fullmatch("<0x[0-9A-F]{2}>", p) else utf8(p.replace("▁", " ")) for p in names])
        self.blank = self.pieces_library.piece_to_id("▁")
        #: whether no piece goes over the start of a unit
        self.parts = not any(re.search("[^▁]▁", p) for p in names) and names[self.blank] == "▁"
        self.forget()

    def forget(self, turn: int = 0) -> None:
        self.seen = Numbers(turn)
        #: per unit: tokens of both kinds, groups, links, whether its tokens give it back; its groups in
        #: digits, each followed by a semicolon; pairs of all links by number
        self.table, self.new_rows = np.zeros((0, 5), np.int64), []
        self.texts, self.links = Growing(np.uint8), Growing(np.int32)
        self.pair_numbers: dict[int, int] = {}

    def byte_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bytes_library.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with the blank that the library adds."""
        return [self.pieces_library.encode(t[1:]) if len(t) > 1 else [self.blank] for t in texts]

    def encoded(self, units: list[str], sizes: np.ndarray, library, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and how many each has. Units that end in no white space are given
        to the library together, and their ids parted by the bytes of the tokens."""
        alone = np.array([t[-1].isspace() or not (t.isascii() or "▁" not in t) for t in units], bool) if self.parts else np.ones(len(units), bool)
        some, rest = np.flatnonzero(~alone), np.flatnonzero(alone)
        found = library(["".join([units[k] for k in some[i : i + JOINED]]) for i in range(0, len(some), JOINED)])
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        upto, ends = np.cumsum(vocabulary.lens[flat]), np.cumsum(sizes[some])
        last = np.searchsorted(upto, ends)
        if len(some) and (last[-1] >= len(upto) or (upto[last] != ends).any() or last[-1] + 1 != len(upto)):
            rest, some, flat, last = np.arange(len(units)), some[:0], flat[:0], last[:0]
        single = library([units[k] for k in rest])
        counts, starts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        counts[some] = np.diff(np.append(-1, last))
        counts[rest] = lengths(single)
        order = np.concatenate([some, rest])
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(np.concatenate([flat, np.fromiter(chain.from_iterable(single), np.int64)]), starts, counts), counts

    def learn(self, units: list[bytes]) -> None:
        """Align new units, laid end to end."""
        texts, sizes, n = [u.decode("utf-8", "surrogatepass") for u in units], lengths(units), len(units)
        flat_a, count_a = self.encoded(texts, sizes, self.byte_ids, self.a)
        flat_b, count_b = self.encoded(texts, sizes, self.piece_ids, self.b)
        unit_a, unit_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        # units that both kinds of tokens give back
        whole = np.bincount(unit_a, self.a.lens[flat_a], n) == sizes
        whole &= np.bincount(unit_b, self.b.lens[flat_b], n) == sizes
        raw = np.frombuffer(b"".join(units), np.uint8)[np.repeat(whole, sizes)]
        of_byte = np.repeat(np.flatnonzero(whole), sizes[whole])
        told = [v.bytes_of(f[whole[u]]) for v, f, u in ((self.a, flat_a, unit_a), (self.b, flat_b, unit_b))]
        for x in told:
            whole[of_byte[x != raw]] = False
        flat_a, unit_a, flat_b, unit_b = flat_a[whole[unit_a]], unit_a[whole[unit_a]], flat_b[whole[unit_b]], unit_b[whole[unit_b]]
        in_a, in_b = jumped(np.cumsum(self.a.lens[flat_a]), np.cumsum(self.b.lens[flat_b]))
        # groups in turn: both sides have the same ones
        first_a, first_b = (np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)]) for x in (in_a, in_b))
        size_a, size_b = np.diff(np.append(first_a, len(in_a))), np.diff(np.append(first_b, len(in_b)))
        unit_g, product = unit_a[first_a], size_a * size_b
        table = np.stack([np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(unit_g, minlength=n), np.bincount(unit_g, product, n).astype(np.int64), whole.astype(np.int64)], 1)
        # link k of a group: its a token k // size_b, its b token k % size_b
        g = np.repeat(np.arange(len(product)), product)
        k = np.arange(len(g)) - np.repeat(np.cumsum(product) - product, product)
        pairs = (flat_a[first_a[g] + k // size_b[g]] << 32) | flat_b[first_b[g] + k % size_b[g]]
        distinct, back = np.unique(pairs, return_inverse=True)
        own = self.pair_numbers
        numbers = np.array([own.setdefault(p, len(own)) for p in distinct.tolist()], np.int32)
        self.links.append(numbers[back], table[:, 3])
        # digits: a group's a tokens and then its b tokens, each with what follows it
        groups_a, groups_b = np.repeat(np.arange(len(product)), size_a), np.repeat(np.arange(len(product)), size_b)
        at_a, at_b = np.arange(len(flat_a)) + first_b[groups_a], np.arange(len(flat_b)) + np.append(first_a[1:], len(flat_a))[groups_b]
        ids, after, unit = (np.zeros(len(flat_a) + len(flat_b), np.int64) for _ in range(3))
        ids[at_a], ids[at_b], unit[at_a], unit[at_b], after[:] = flat_a, flat_b, unit_a, unit_b, ord(",")
        after[at_a[first_a + size_a - 1]], after[at_b[first_b + size_b - 1]] = ord("|"), ord(";")
        chars, width = DIGITS[ids], DIGIT_COUNT[ids]
        chars[np.arange(len(ids)), width] = after
        self.texts.append(chars[np.arange(6) <= width[:, None]], np.bincount(unit, width + 1, n).astype(np.int64))
        self.new_rows.append(table)

    def aligned(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pair numbers of all links) of each text; None for
        a text without tokens, or whose tokens don't give it back."""
        raw = [b" " + utf8(t) for t in texts]
        buf, at = packed(raw)
        # a blank after what is no white space starts a unit; so does a text
        starts = np.flatnonzero((buf[1:] == 32) & ~_WHITE[buf[:-1]]) + 1
        if not self.parts or (odd := [i for i, t in enumerate(texts) if not t.isascii() and _wide_before_blank(t)]):
            inside = np.searchsorted(at, starts, side="right") - 1
            starts = starts[~np.isin(inside, odd)] if self.parts else starts[:0]
        starts = np.union1d(starts, at)
        ends = np.append(starts[1:], len(buf) - 8)
        lasts = np.searchsorted(starts, at)
        ends[np.append(lasts[1:] - 1, len(starts) - 1)] = at + lengths(raw)
        idx, new = self.seen.numbers(buf, starts, ends - starts)
        if len(new):
            self.learn([buf[a:b].tobytes() for a, b in zip(starts[new], ends[new])])
        if self.new_rows:
            self.table, self.new_rows = np.concatenate([self.table, *self.new_rows]), []
        out: list[tuple | None] = []
        for text, a, b in zip(texts, lasts, np.append(lasts[1:], len(starts))):
            own = idx[a:b]
            rows = self.table[own]
            if not text or not rows[:, 4].all():
                out.append(None)
            else:
                out.append((*rows[:, :4].sum(0).tolist(), hashlib.sha256(self.texts.gather(own)[:-1]).hexdigest(), self.links.gather(own)))
        return out


#: kind 0: a document (block, doc columns, pairs: places in the block's dictionary, times: how often each);
#: kind 1: a block's dictionary (block, ids: a << 32 | b, docs: documents of the block that hold the pair).
ROWS = "block long, kind int, doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, ids array<long>, docs array<int>"


def aligned_rows(docs: DataFrame, byte_file: str, piece_file: str, links: int = LINKS) -> DataFrame:
    """ROWS of all documents; a block ends with the document that brings it to so many links."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        names = [c.split()[0] for c in ROWS.split(", ")]
        at, block, held, count = Aligner(byte_file, piece_file), TaskContext.get().partitionId() << 32, [], 0

        def frame(rows):
            return pd.DataFrame(rows, columns=names)

        def block_rows():
            """A block's documents and its dictionary."""
            nonlocal block
            numbers = np.fromiter(at.pair_numbers, np.int64, len(at.pair_numbers))
            docs_of = np.zeros(len(numbers), np.int32)
            for r in held:
                docs_of[r[-2]] += 1
            used = np.flatnonzero(docs_of)
            place = np.zeros(len(numbers), np.uint32)
            place[used] = np.arange(len(used))
            rows = [(block, 0, *r[:-2], place[r[-2]].tobytes(), r[-1].astype(np.uint32).tobytes(), None, None) for r in held]
            if len(used):
                rows.append((block, 1, 0, True, 0, 0, 0, 0, "", None, None, numbers[used], docs_of[used]))
            block += 1
            held.clear()
            return frame(rows)

        for batch in batches:
            for a, b in groups_of(batch["text"], CHARS):
                some = batch.iloc[a:b]
                if len(at.seen) > KEEP:
                    if held:
                        yield block_rows()
                        count = 0
                    at.forget()
                texts, found = [t if isinstance(t, str) else "" for t in some["text"]], None
                while found is None:
                    try:
                        found = at.aligned(texts)
                    except Clash:  # units of one hash: another hash tells them apart
                        if held:
                            yield block_rows()
                            count = 0
                        at.forget(at.seen.turn + 2)
                for doc_id, no_id, got in zip(some["doc_id"], some["no_id"], found):
                    if got is None:
                        held.append((doc_id, no_id, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        continue
                    pairs, times = np.unique(got[-1], return_counts=True)
                    held.append((doc_id, no_id, *got[:-1], pairs, times))
                    count += len(pairs)
                if count >= links:
                    yield block_rows()
                    count = 0
        if held:
            yield block_rows()
        del at
        given_back()

    return ids_and_texts(docs).mapInPandas(run, ROWS)


def pair_counts(dictionaries: DataFrame) -> DataFrame:
    """(pair, count, best) of each linked id pair (a << 32 | b): documents corpus-wide that hold it linked,
    and whether no pair of its a has more. dictionaries: (pair, n)."""
    counts = written(dictionaries.groupBy("pair").agg(F.sum("n").cast("long").alias("count")), "alignment-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None, links: int = LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row (doc_id, text).

    Null and empty texts, and texts that the tokens of either file don't give back, have no tokens: zeros
    and ''. Repeated rows and null ids are documents like others; an empty table gives none. Columns of
    other names are not read. A task holds one Arrow batch of texts, the tokens of half a million
    characters or of one longer text, and the links of one block.
    """
    text_batches(docs.sparkSession)
    rows = written(aligned_rows(docs, byte_file or path_of(BYTE_FILE), piece_file or path_of(PIECE_FILE), links), "alignment-rows")
    entries = rows.filter("kind = 1").select("block", F.posexplode(F.arrays_zip("ids", "docs")).alias("at", "x")).select("block", "at", F.col("x.ids").alias("pair"), F.col("x.docs").alias("n"))
    known = pair_counts(entries.select("pair", "n"))
    told = entries.select(F.col("block").alias("b"), "at", "pair").join(known, "pair").select("b", "at", "count", "best")
    documents = rows.filter("kind = 0").select("block", "doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")

    def summed(own, told):
        import pandas as pd

        count, best = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
        count[told["at"].to_numpy()], best[told["at"].to_numpy()] = told["count"].to_numpy(), told["best"].to_numpy()
        sums = []
        for pairs, times in zip(own["pairs"], own["times"]):
            k, n = np.frombuffer(pairs, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
            sums.append((int((best[k] * n).sum()), int((count[k] * n).sum())))
        out = own[["doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
        out["n_best"], out["count_sum"] = ([s[k] for s in sums] for k in (0, 1))
        return out.astype({"n_best": "int64", "count_sum": "int64"}) if len(out) else pd.DataFrame(columns=out.columns)

    schema = "doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    joined = documents.groupBy("block").cogroup(told.groupBy("b")).applyInPandas(summed, schema)
    return joined.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
