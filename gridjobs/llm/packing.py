"""Hierarchical packing of documents into sequences of several lengths.

Documents are routed to context tiers by what is left after their full windows; each tier is
packed from its longest piece on, gaps of long windows are filled from shorter tiers, and the
sequences of a pool are dealt to step groups of equal size and mix.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame

from gridjobs.llm.common import frame, id_list, ids_and_texts
from gridjobs.llm.tokens import BYTES, encoder, groups_of, path_of

TIERS = (1024, 512, 256, 128)
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16

Piece = tuple[int, int, int]  # document, start, length


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Split an unfilled window into sequences whose lengths are powers of two."""
    out, total = [], sum(p[2] for p in pieces)
    todo = pieces[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            d, s, n = todo.pop()
            take = min(n, room)
            own.append((d, s, take))
            if take < n:
                todo.append((d, s + take, n - take))
            room -= take
        out.append(own)
    return out


def pack_pool(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences for documents of these lengths; all but powers of two below the last tier are full."""
    window, out, left = tiers[0], [], []
    for d, n in enumerate(lengths):
        full = n // window
        out += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            left.append((n % window, d, full * window))
    left.sort()
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while left and left[-1][0] > below:
            n, d, s = left.pop()
            own, gap = [(d, s, n)], tier - n
            while gap and left:
                k = bisect_right(left, (gap, 1 << 62, 0)) - 1
                n, d, s = left.pop(max(k, 0))
                take = min(n, gap)
                own.append((d, s, take))
                gap -= take
                if take < n:
                    insort(left, (n - take, d, s + take))
            out += [own] if not gap else powers_of_two(own)
    return out


def step_groups(sequences: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: longest first, dealt there and back, so groups weigh the same."""
    sizes = [sum(p[2] for p in s) for s in sequences]
    groups = max(1, round(sum(sizes) / step_tokens))
    out = [0] * len(sizes)
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: (-sizes[i], len(sequences[i]), i))):
        turn, at = divmod(rank, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length int, tier int, step_group long"


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    Each input partition packs pools of about POOL_TOKENS tokens as it reads, so nothing is
    shuffled and memory is bounded by a pool and one document. Sequences are full tiers, or powers
    of two at a pool's end (tier 0 if shorter than all tiers), so none needs padding. Null text
    counts as empty and gives the end id alone; a null doc_id stays null; repeated rows are packed
    each; an empty table gives no rows.
    Columns of other names, whatever they are, are not read.
    """

    def run(batches):
        from pyspark import TaskContext

        made = groups = TaskContext.get().partitionId() << 32
        enc = encoder(path, BYTES)

        def flush(ids_of, keys):
            nonlocal made, groups
            sequences = pack_pool([len(x) for x in ids_of], tiers)
            rows = []
            for own, group in zip(sequences, step_groups(sequences)):
                size, at = sum(p[2] for p in own), 0
                tier = size if size in tiers else 0
                for d, s, n in own:
                    rows.append((keys[d], s, n, zlib.crc32(ids_of[d][s : s + n]), len(ids_of[d]), made, at, size, tier, groups + group))
                    at += n
                made += 1
            groups += max((r[-1] for r in rows), default=groups) - groups + 1
            return frame(rows, SCHEMA)

        ids_of, keys, held = [], [], 0
        for batch in batches:
            for a, b in groups_of(batch["text"], 1 << 20):
                texts = [x if isinstance(x, str) else "" for x in batch["text"][a:b]]
                for doc_id, ids in zip(id_list(batch, a, b), enc.encode(texts)):
                    ids_of.append(np.append(ids, end_id).astype("<u4"))
                    keys.append(doc_id)
                    held += len(ids) + 1
                if held >= POOL_TOKENS:
                    yield flush(ids_of, keys)
                    ids_of, keys, held = [], [], 0
        if keys:
            yield flush(ids_of, keys)

    return ids_and_texts(docs).mapInPandas(run, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_of("byte_bpe_50k.json"))
