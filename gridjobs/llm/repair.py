"""Token ids in grammar-compressed shards with random access (Re-Pair).

A block holds the ids of neighbouring documents. Frequent pairs of neighbouring symbols are
replaced by new symbols, again and again; a block keeps its rules, the expansion length of every
rule, the remaining symbols and, per document, where its symbols and its ids begin.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.llm.common import id_list, ids_and_texts, written
from gridjobs.llm.tokens import WORDS, encoder, groups_of, path_of

BLOCK_IDS = 1 << 20
#: A rule takes the room of three symbols (two and its length), so fewer replacements than this save none.
LEAST = 4
SLOTS = 20
_LEFT, _RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def compress(ids: np.ndarray, starts: np.ndarray, base: int, least: int = LEAST):
    """Rules (left, right) for symbols base, base + 1, ..., the symbols, and each document's first symbol.

    starts: where each document's ids begin. Pairs across two documents are never replaced, so a
    document is a slice of symbols. Each round replaces all pairs that occur as often as a threshold,
    which falls by half from round to round, down to `least`; it ends when no pair occurs so often.
    Where occurrences of wanted pairs overlap, they are taken from the left.
    """
    import pandas as pd

    symbols = ids.astype(np.uint32)
    first = np.zeros(len(symbols) + 1, bool)
    first[starts] = True
    first = first[:-1]
    rules, known, threshold = [], base, None
    while len(symbols) > 1:
        # counts by a hash of the pair leave few pairs to count exactly
        slot = ((symbols[:-1] * _LEFT + symbols[1:] * _RIGHT) >> np.uint32(32 - SLOTS)).astype(np.int32)
        slot[first[1:]] = 1 << SLOTS
        counts = np.bincount(slot, minlength=(1 << SLOTS) + 1)
        counts[-1] = 0
        threshold = max(least, int(counts.max()) // 2 if threshold is None else threshold // 2)
        at = np.flatnonzero((counts >= threshold)[slot])
        which, pairs = pd.factorize(symbols[at].astype(np.int64) << 32 | symbols[at + 1])
        wanted = np.bincount(which, minlength=len(pairs)) >= threshold
        if not wanted.any():
            if threshold == least:
                break
            continue
        at, which = at[wanted[which]], which[wanted[which]]
        run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, which = at[take], which[take]
        # a pair that lost all its occurrences to others needs no rule
        used = np.bincount(which, minlength=len(pairs)) > 0
        symbols[at] = known + (np.cumsum(used) - 1)[which]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, first = symbols[keep], first[keep]
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1))
        known += int(used.sum())
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return rules, symbols.astype(np.int64), np.flatnonzero(first)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; a rule refers to earlier rules only, a round at a time."""
    lens = np.ones(base + len(rules), np.int64)
    done = base
    while done < len(lens):
        inner = rules[done - base :]
        ready = len(inner) if inner.max() < done else int(np.argmax((inner >= done).any(1)))
        lens[done : done + ready] = lens[inner[:ready, 0]] + lens[inner[:ready, 1]]
        done += ready
    return lens[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    while len(at := np.flatnonzero(symbols >= base)):
        wide = np.ones(len(symbols), np.int64)
        wide[at] = 2
        to = np.cumsum(wide) - wide
        out = np.empty(len(symbols) + len(at), np.int64)
        out[to] = symbols
        pair = rules[symbols[at] - base]
        out[to[at]], out[to[at] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def expand_by_table(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of many symbols: each rule is expanded once, and symbols copy what it gives."""
    flat = np.concatenate([np.arange(base), expand(np.arange(base, base + len(rules)), rules, base)]).astype(np.int32)
    size = np.concatenate([np.ones(base, np.int64), lengths])
    start = np.cumsum(size) - size
    lens = size[symbols]
    return flat[np.repeat(start[symbols] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]


def stored(x: np.ndarray, width: int) -> bytes:
    """Numbers as little-endian integers of so many bytes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def loaded(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u4")[:, 0].astype(np.int64)


class Block:
    """One stored block, for reading."""

    def __init__(self, row):
        width = row["symbol_bytes"]
        self.base, self.n = row["base"], row["n_ids"]
        self.rules = loaded(row["rules"], width).reshape(-1, 2)
        self.lengths = np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)
        self.symbols = loaded(row["symbols"], width)
        self.doc_symbols = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
        self.doc_starts = np.frombuffer(row["doc_starts"], "<u4").astype(np.int64)
        self.doc_ids = [int(x) for x in np.frombuffer(row["doc_ids"], "<i8")]
        for k in np.frombuffer(row["null_ids"], "<u4"):
            self.doc_ids[k] = None

    def all_ids(self) -> np.ndarray:
        return expand_by_table(self.symbols, self.rules, self.lengths, self.base)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone."""
        ends = np.append(self.doc_symbols, len(self.symbols))
        return expand(self.symbols[ends[k] : ends[k + 1]], self.rules, self.base)

    def id_at(self, k: int, offset: int) -> int:
        """One id of the k-th document: expansion lengths lead to its symbol and down the rules."""
        ends = np.append(self.doc_symbols, len(self.symbols))
        own = self.symbols[ends[k] : ends[k + 1]].astype(np.int64)
        size = lambda s: np.where(s >= self.base, self.lengths[np.maximum(s - self.base, 0)] if len(self.lengths) else 1, 1)
        upto = np.cumsum(size(own))
        at = int(np.searchsorted(upto, offset, side="right"))
        symbol, offset = int(own[at]), offset - int(upto[at - 1] if at else 0)
        while symbol >= self.base:
            left, right = map(int, self.rules[symbol - self.base])
            n = int(self.lengths[left - self.base]) if left >= self.base else 1
            symbol, offset = (left, offset) if offset < n else (right, offset - n)
        return symbol


BLOCKS = "part int, block int, n_docs int, n_ids long, base int, symbol_bytes int, rules binary, rule_lengths binary, symbols binary, doc_symbols binary, doc_starts binary, doc_ids binary, null_ids binary"


def write_blocks(docs: DataFrame, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode all texts and write blocks in ascending doc_id order to the shared folder; return the table.

    Documents are dealt to ranges of (doc_id, hash of the text), null ids first, so repeated ids
    spread too; (part, block) orders the blocks. Null text counts as empty: the end id alone. An
    empty table gives no blocks. A document is never cut, so a block holds block_ids ids and at most
    one group of texts (a million characters, or one longer text) more; other columns are not read.
    """

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        enc, part, block = encoder(path, WORDS), TaskContext.get().partitionId(), 0
        base = enc.library.get_vocab_size(with_added_tokens=True)

        def flush(keys, ids_of):
            lens = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
            starts = np.cumsum(lens) - lens
            rules, symbols, doc_symbols = compress(np.concatenate(ids_of), starts, base)
            width = 2 if base + len(rules) <= 1 << 16 else 3 if base + len(rules) <= 1 << 24 else 4
            lengths = expansion_lengths(rules, base)
            nulls = np.array([i for i, k in enumerate(keys) if k is None], np.int64)
            row = (part, block, len(keys), int(lens.sum()), base, width, stored(rules.ravel(), width), stored(lengths, 4), stored(symbols, width), stored(doc_symbols, 4), stored(starts, 4), np.array([k or 0 for k in keys], "<i8").tobytes(), stored(nulls, 4))
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        keys, ids_of, held = [], [], 0
        for batch in batches:
            for a, b in groups_of(batch["text"], 1 << 20):
                texts = [x if isinstance(x, str) else "" for x in batch["text"][a:b]]
                for doc_id, ids in zip(id_list(batch, a, b), enc.encode(texts)):
                    keys.append(doc_id)
                    ids_of.append(np.append(ids, end_id))
                    held += len(ids) + 1
                if held >= block_ids:
                    yield flush(keys, ids_of)
                    keys, ids_of, held, block = [], [], 0, block + 1
        if keys:
            yield flush(keys, ids_of)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc("no_id"), F.col("doc_id"), F.xxhash64("text")
    ordered = ids_and_texts(docs).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(ordered.mapInPandas(run, BLOCKS), "repair-blocks")


DOCUMENTS = "part int, block int, doc_id long, block_start long, n_tokens long, ids_crc32 long"


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode every block and list its documents with their place among all ids."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row)
                ids = block.all_ids().astype("<u4")
                ends = np.append(block.doc_starts, len(ids))
                out = pd.DataFrame({
                    "part": row["part"], "block": row["block"], "doc_id": pd.array(block.doc_ids, "Int64"),
                    "block_start": block.doc_starts, "n_tokens": np.diff(ends),
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])],
                })
                yield out

    own = Window.partitionBy("part").orderBy("block")
    index = blocks.select("part", "block", "n_ids").withColumn("in_part", F.sum("n_ids").over(own) - F.col("n_ids"))
    # one number per part of the range partitioning, not per block or document
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), F.col("part") + 1)
    at = index.select("part", "block", (offset + F.col("in_part")).alias("before"))
    found = blocks.mapInPandas(run, DOCUMENTS)
    return found.join(at, ["part", "block"]).withColumn("start", F.col("before") + F.col("block_start"))


def op4_repair(spark, sf_dir: str) -> DataFrame:
    blocks = write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_of("word_bpe_49k.json"))
    return read_blocks(blocks).select("doc_id", "start", "n_tokens", "ids_crc32")
