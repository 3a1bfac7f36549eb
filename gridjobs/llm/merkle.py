"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs (lines) are cut into leaves where the characters say so, by one rule for texts of every
length, so an edit moves the cuts near it alone. Leaves start fine and grow with their distance from the
start of the text, so a short text has several too: of any text whose last quarter changes, leaves of
half of it or more stay. A paragraph hashes its leaves, a section the
neighbouring paragraphs up to one whose own hash ends it, the root the sections. Equal roots mean
equal texts, and only branches that differ are compared further.
"""

from __future__ import annotations

import hashlib
import re
from binascii import b2a_base64
from collections import Counter
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.common import ids_and_texts
from gridjobs.llm.tokens import groups_of, utf8

#: Code points of a leaf, least and most, and of the window whose hash cuts one time in CUT.
LEAST, MOST, WINDOW, CUT = 8, 32, 4, 16
#: A leaf that starts p code points into the text has 1 + p // 8 at least and 2 + p // 4 at most, within these.
LEASTS, MOSTS = [min(LEAST, 1 + p // 8) for p in range(4 * MOST)], [min(MOST, 2 + p // 4) for p in range(4 * MOST)]
#: A leaf in a fingerprint: eight bytes of hash as 11 characters, and one for its code points.
LEAF = 12
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIZES = {c: n for n, c in enumerate(_DIGITS)}
#: Leaves that a worker keeps.
KEEP = 100_000


def digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


class Leaves(dict):
    """Leaf strings of pieces met by this worker."""

    def __missing__(self, piece: str) -> str:
        if len(self) > KEEP:
            self.clear()
        self[piece] = leaf = b2a_base64(digest(utf8(piece)), newline=False)[:11].decode() + _DIGITS[len(piece)]
        return leaf


_leaves = Leaves()


def cuts_of(text: str) -> list[int]:
    """Places after which a leaf may end: where the last WINDOW code points hash to one value in CUT."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < WINDOW:
        return []
    n = len(c) - WINDOW + 1
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h = (h ^ c[k : n + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (np.flatnonzero((h * np.uint32(0x85EBCA77)) >> np.uint32(28) == 0) + WINDOW).tolist()


class Tree:
    """A fingerprint taken apart: root, and (hash, paragraphs as leaf strings) of each section."""

    def __init__(self, root: str, sections: list[tuple[str, list[str]]]):
        self.root, self.sections = root, sections

    @cached_property
    def counts(self) -> Counter:
        return leaf_counts(p for _, own in self.sections for p in own)

    @cached_property
    def size(self) -> int:
        """Code points of all leaves."""
        return code_points(self.counts)


def tree_of(text: str) -> Tree:
    """Leaves never reach over a line's end; a line's cuts are those whose window lies in it."""
    grown = len(LEASTS)
    sections: list[tuple[str, list[str]]] = []
    own, hashes, cuts, k, start = [], [], cuts_of(text), 0, 0
    for paragraph in text.split("\n"):
        leaves, last, end = [], start, start + len(paragraph)
        while k < len(cuts) and cuts[k] < end:
            cut, k = cuts[k], k + 1
            if cut < start + WINDOW or cut - last < (LEAST if last >= grown else LEASTS[last]):
                continue
            while cut - last > (most := MOST if last >= grown else MOSTS[last]):
                leaves.append(_leaves[text[last : last + most]])
                last += most
            if cut - last >= (LEAST if last >= grown else LEASTS[last]):
                leaves.append(_leaves[text[last:cut]])
                last = cut
        while last < end:
            after = min(last + (MOST if last >= grown else MOSTS[last]), end)
            leaves.append(_leaves[text[last:after]])
            last = after
        start = end + 1
        own.append("".join(leaves))
        hashes.append(digest(own[-1].encode()))
        if hashes[-1][-1] < 32:
            sections.append((digest(b"".join(hashes)).hex(), own))
            own, hashes = [], []
    if own:
        sections.append((digest(b"".join(hashes)).hex(), own))
    return Tree(digest("".join(h for h, _ in sections).encode(), 16).hex(), sections)


def told(tree: Tree) -> str:
    return f"{tree.root}({''.join(f'{h}({chr(59).join(own)})' for h, own in tree.sections)})"


def fingerprint(text: str) -> str:
    """root(section(leaves;leaves)...): the tree as text, one run of leaves to a paragraph.

    The root is a 16-byte hash of the section hashes, those of the paragraph hashes, those of the
    leaves, so equal roots mean equal texts.
    """
    return told(tree_of(text))


_section = re.compile(r"([0-9a-f]{16})\(([^)]*)\)").findall


def parsed(fp: str) -> Tree:
    return Tree(fp[:32], [(h, body.split(";")) for h, body in _section(fp[33:-1])])


def leaf_counts(paragraphs) -> Counter:
    return Counter(p[k : k + LEAF] for p in paragraphs for k in range(0, len(p), LEAF))


def code_points(counts) -> int:
    return sum(_SIZES[leaf[-1]] * n for leaf, n in counts.items())


def tree_likeness(a: Tree, b: Tree) -> float:
    """Shared leaves by code points, over the larger of both texts; 1 for equal roots.

    Sections equal in both are counted whole; only the others' leaves are looked at.
    """
    if a.root == b.root:
        return 1.0
    same = Counter(h for h, _ in a.sections) & Counter(h for h, _ in b.sections)

    def rest(tree: Tree) -> Counter:
        """Leaves outside equal sections."""
        if not same:
            return tree.counts
        left, out = Counter(same), []
        for h, own in tree.sections:
            if left[h]:
                left[h] -= 1
            else:
                out += own
        return leaf_counts(out)

    ca, cb = rest(a), rest(b)
    shared = (a.size - code_points(ca) if same else 0) + sum(_SIZES[leaf[-1]] * min(ca[leaf], cb[leaf]) for leaf in ca.keys() & cb.keys())
    return shared / max(a.size, b.size, 1)


def likeness(a: str, b: str) -> float:
    """tree_likeness of two fingerprints."""
    return tree_likeness(parsed(a), parsed(b))


def changed_paragraphs(a: str, b: str) -> tuple[list[int], list[int]]:
    """Numbers of the paragraphs of a and of b that lie in differing branches."""

    def listed(sections, other):
        known, at, out = Counter(h for h, _ in other), 0, []
        leaves = Counter(p for _, own in other for p in own)
        for h, own in sections:
            if known[h]:
                known[h] -= 1
            else:
                for k, p in enumerate(own):
                    if leaves[p]:
                        leaves[p] -= 1
                    else:
                        out.append(at + k)
            at += len(own)
        return out

    sa, sb = parsed(a).sections, parsed(b).sections
    return listed(sa, sb), listed(sb, sa)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many code points of the following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: Sampled rows to a bucket, by which the bounds of buckets are chosen.
SAMPLED = 20
_NULL = -(1 << 63)


def bucket_of(ids: np.ndarray, hashes: np.ndarray, cut_ids: np.ndarray, cut_hashes: np.ndarray) -> np.ndarray:
    """How many bounds (id, hash) lie below each row's."""
    low, high = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    out = low.astype(np.int32)
    for x in np.unique(ids[low < high]):  # ids so frequent that bounds part their rows by hash
        own = np.flatnonzero(ids == x)
        a, b = low[own[0]], high[own[0]]
        out[own] = a + np.searchsorted(cut_hashes[a:b], hashes[own], "left")
    return out


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, doc_id, text, guest) sorted by doc_id within buckets of neighbouring ids.

    The first row of a bucket is sent to the bucket before as well (the first of all to the last),
    as a guest, so every row finds the text that follows it in its own bucket. Rows are ordered by
    doc_id (nulls first) and a hash of the text; bounds are rows of a sample, so the rows of a
    frequent id, or those without one, are parted too.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("_i"), F.xxhash64(text).alias("_h"))
    share = 4 * parts  # a few buckets to a partition, so hashing them evens out
    rows = docs.count()
    some = told.select("_i", "_h").sample(min(1.0, SAMPLED * share / max(rows, 1)), 11).toPandas().sort_values(["_i", "_h"])
    at = np.unique(np.linspace(0, len(some), share + 1).astype(int)[1:-1])
    cuts = some.iloc[at[at < len(some)]].drop_duplicates()
    shared = spark.sparkContext.broadcast((cuts["_i"].to_numpy(np.int64), cuts["_h"].to_numpy(np.int64)))

    @F.pandas_udf("int")
    def bucket(i, h):
        import pandas as pd

        return pd.Series(bucket_of(i.to_numpy(np.int64), h.to_numpy(np.int64), *shared.value))

    placed = told.withColumn("bucket", bucket("_i", "_h"))
    # one row of numbers to a bucket
    firsts = sorted(tuple(r["m"]) for r in placed.groupBy("bucket").agg(F.min(F.struct("bucket", "_i", "_h")).alias("m")).collect())
    hosts = [b for b, _, _ in firsts]
    guests = spark.createDataFrame([(i, h, host) for (_, i, h), host in zip(firsts, [*hosts[-1:], *hosts[:-1]])], "_i long, _h long, host int")
    # as many guests as buckets; equal rows give one
    hosted = told.join(F.broadcast(guests), ["_i", "_h"]).groupBy("host").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    hosted = hosted.select("r.doc_id", "r.text", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    own = placed.select("doc_id", "text", "bucket", F.lit(0).alias("guest"))
    moved = own.unionByName(hosted).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return ids_and_texts(moved, "bucket", "guest")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    Texts are moved once, to buckets of neighbouring ids, and streamed there: a task holds one batch
    and one text more, with their trees. Order: doc_id, nulls first, repeated ids by a hash of the
    text. Null text counts as empty; a single row is followed by itself; an empty table gives none.
    Columns of other names, whatever they are, are not read.
    """

    def run(batches):
        import pandas as pd

        def made(doc_id, text, tree, following, next_tree):
            new = edited(text, following)
            new_tree = tree_of(new) if new != text else tree
            return (doc_id, len(text), hashlib.sha256(utf8(new)).hexdigest(), told(tree), told(new_tree), tree_likeness(tree, new_tree), tree_likeness(tree, next_tree))

        held = None
        for batch in batches:
            rows = []
            for a, b in groups_of(batch["text"], 1 << 22):
                for bucket, doc_id, no_id, text, guest in zip(batch["bucket"][a:b], batch["doc_id"][a:b], batch["no_id"][a:b], batch["text"][a:b], batch["guest"][a:b]):
                    if guest:
                        # guests come after a bucket's rows; the least in their order is the one that follows
                        if held is not None and held[0] == bucket:
                            rows.append(made(*held[1:], text, tree_of(text)))
                            held = None
                        continue
                    tree = tree_of(text)
                    if held is not None:
                        rows.append(made(*held[1:], text, tree))
                    held = (bucket, None if no_id else int(doc_id), text, tree)
                if rows:
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                    yield out.assign(doc_id=out["doc_id"].astype("Int64"))
                    rows = []

    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, parts).mapInPandas(run, SCHEMA)


def op5_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
