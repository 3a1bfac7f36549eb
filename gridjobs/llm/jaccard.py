"""Near duplicates by a grouped prefix join on word shingles, as connected components.

Texts with equal shingle sets are one class. Shingles are ordered from rare to common (by a count
sketch over all documents, then hash); two sets that reach the similarity share a shingle within
their prefixes of that order. Classes with the same prefix and size form a group, and only groups
meet in the join. First every list of groups that share a prefix shingle is tied to its most
central group, which settles the components of large groups of near copies with few pairs; then
all remaining pairs of groups from different components are formed. Pairs of groups are expanded
to their classes, filtered by size, position and parity bitmaps, and verified on whole sets.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.llm.chunks import AT_WHITE, SPACE, hashed, packed, segments
from gridjobs.llm.common import dropped, frame, given_back, id_list, ids_and_texts, written
from gridjobs.llm.tokens import groups_of, utf8

WORDS = 5
#: Shingles to a bucket of the count sketch, least and most bits of its size (so at most 128 MB are
#: broadcast; from then on buckets hold more), its slices, how many partial slices one task adds,
#: and bits of a parity bitmap.
LOAD = 8
LEAST_BITS, MOST_BITS = 18, 27
SLICES = 64
ADDED = 32
BITMAP = 2048
#: Most ids to look up by broadcast; beyond that the lookup is a shuffled join.
FEW = 200_000
#: Groups of one open list that one task compares with the others.
LISTED = 1000
#: Characters of texts that are cut at once.
CHARS = 1 << 20

_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct hashes (sorted) of the runs of so many words; fewer give their whole sequence.

    A-Z are lower-cased; words are what spaces and \\t to \\r part.
    """
    buf, at = packed([utf8(x).lower() if isinstance(x, str) else b"" for x in texts])
    starts, ends, kind = segments(buf, AT_WHITE)
    word = kind != SPACE
    starts, ends = starts[word], ends[word]
    (h,) = hashed(buf, starts, ends - starts, many=1)
    bounds = np.append(np.searchsorted(starts, at), len(h)).tolist()

    def runs(h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        s = h[:n].copy()
        for k in range(1, width):
            s = (s ^ (s >> np.uint64(29))) * _K + h[k : n + k]
        return (s ^ (s >> np.uint64(31))) * _K + np.uint64(width if width < words else 0)

    whole = runs(h, words) if len(h) >= words else None
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            out.append(runs(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_length(n, percent: int):
    """Shingles of a set of n among which a similar set must have one."""
    return n - -(-percent * n // 100) + 1


def digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


SKETCHED = "doc_id long, key long, n long, sig binary, slice int, part int, width int, counts binary"


def sketch_bits(docs: DataFrame) -> int:
    """Size of the sketch for the bytes of all texts, six to a word."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    return min(MOST_BITS, max(LEAST_BITS, round(float(np.log2(max(size / 6 / LOAD, 1))))))


def sketched(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, key, n, sig) per row, and at a task's end its counts of shingle buckets in slices.

    A task counts to 255; that is far above rare.
    """

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for a, b in groups_of(batch["text"], CHARS):
                rows = []
                for doc_id, key, s in zip(id_list(batch, a, b), batch["key"][a:b], shingle_sets(batch["text"][a:b], words)):
                    rows.append((doc_id, key, len(s), digest(s.tobytes(), 16) if len(s) else None, -1, 0, 1, None))
                    at = (s >> np.uint64(64 - bits)).astype(np.int64)
                    if len(at):
                        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                        more = np.diff(np.append(edge, len(at)))
                        counts[at[edge]] = np.minimum(counts[at[edge]] + more, 255)
                yield frame(rows, SKETCHED)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pd.DataFrame({"doc_id": pd.array([None] * SLICES, "Int64"), "key": 0, "n": 0, "sig": None, "slice": range(SLICES), "part": TaskContext.get().partitionId(), "width": 1, "counts": parts})
        given_back()

    return ids_and_texts(docs, "key").mapInPandas(run, SKETCHED)


def commonness(sketch: DataFrame, bits: int, mean: float) -> np.ndarray:
    """For every bucket its class: 0 up to twice the mean count, then one more for each doubling.

    Slices of tasks are added ADDED at a time, level by level, so no task holds those of all tasks.
    """

    def total(batch) -> np.ndarray:
        out = np.zeros((1 << bits) // SLICES, np.uint32)
        for x, width in zip(batch["counts"], batch["width"]):
            out += np.frombuffer(zlib.decompress(x), f"<u{width}")
        return out

    def add(batch):
        import pandas as pd

        return pd.DataFrame({"slice": [int(batch["slice"].iloc[0])], "part": [int(batch["part"].iloc[0]) // ADDED], "width": [4], "counts": [zlib.compress(total(batch).tobytes(), 1)]})

    def classed(batch):
        import pandas as pd

        kinds = np.floor(np.log2(np.maximum(total(batch) / max(2 * mean, 2), 1))).astype(np.uint8)
        return pd.DataFrame({"slice": [int(batch["slice"].iloc[0])], "counts": [zlib.compress(kinds.tobytes(), 1)]})

    sketch = sketch.select("slice", "part", "width", "counts")
    most = sketch.agg(F.max("part")).first()[0] or 0
    while most >= ADDED:
        sketch = sketch.groupBy("slice", F.floor(F.col("part") / ADDED).alias("_p")).applyInPandas(add, "slice int, part int, width int, counts binary")
        most //= ADDED
    got = sketch.groupBy("slice").applyInPandas(classed, "slice int, counts binary").collect()  # SLICES rows
    kinds = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for r in got:
        kinds[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return kinds.reshape(-1)


def parity(s: np.ndarray) -> bytes:
    """A bit for each slot that an odd number of shingles hash to: bits that differ are no more than
    shingles that differ."""
    slots = np.bincount(((s >> np.uint64(8)) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(slots.astype(np.uint8)).tobytes()


def profiled(docs: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """(sig, g, n, bitmap, prefix) of every set a task meets for the first time.

    prefix: the first prefix_length shingles from rare to common, only with the first of a group g
    (equal prefix and size).
    """
    shared, bits = docs.sparkSession.sparkContext.broadcast(classes), len(classes).bit_length() - 1

    def run(batches):
        import pandas as pd

        of, seen, groups = shared.value, set(), set()
        for texts in (batch["text"][a:b] for batch in batches for a, b in groups_of(batch["text"], CHARS)):
            rows = []
            for s in shingle_sets(texts, words):
                if not len(s) or (sig := digest(s.tobytes(), 16)) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                    groups.clear()
                seen.add(sig)
                order = (of[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                first = np.sort(order)[: prefix_length(len(s), percent)].astype(np.int64)
                g = int.from_bytes(digest(first.tobytes() + len(s).to_bytes(8, "little"), 8), "little", signed=True)
                rows.append((sig, g, len(s), parity(s), None if g in groups else first))
                groups.add(g)
            yield pd.DataFrame(rows, columns=["sig", "g", "n", "bitmap", "prefix"])
        seen, groups, rows = set(), set(), []
        given_back()

    return docs.select("text").mapInPandas(run, "sig binary, g long, n long, bitmap binary, prefix array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b), root being the least node, by alternating large and small stars."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "jaccard-edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        tied = large.join(least, F.col("u") == F.col("w"))
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        e, last = written(small, "jaccard-stars"), e
        dropped(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, s) of the wanted (sig, doc_id), made again from the texts."""
    count = wanted.count()
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if count <= FEW else ids
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches):
        import pandas as pd

        for texts in (batch["text"][a:b] for batch in batches for a, b in groups_of(batch["text"], CHARS)):
            sets = shingle_sets(texts, words)
            yield pd.DataFrame({"sig": [digest(s.tobytes(), 16) for s in sets], "s": [s.view(np.int64) for s in sets]})

    found = some.mapInPandas(run, "sig binary, s array<long>")
    needed = wanted.select("sig").distinct()
    return found.join(F.broadcast(needed) if count <= FEW else needed, "sig", "left_semi").dropDuplicates(["sig"])


def near(n, m, percent: int):
    """The least intersection of similar sets of n and m, as an SQL condition's left side."""
    return F.ceil(F.lit(float(percent)) * (n + m) / F.lit(float(100 + percent)) - F.lit(1e-9))


def shared_needed(n, m, percent: int):
    """The least number of shingles that the prefixes of similar sets of n and m share.

    All of the prefix that ends first lies in the other's range, so what it may lack there is no more
    than what its set may lack.
    """
    kept = lambda x: F.ceil(F.lit(float(percent)) * x / F.lit(100.0) - F.lit(1e-9))
    return near(n, m, percent) - F.greatest(kept(n), kept(m)) + 1


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar. classes: sig, n, bitmap, doc_id."""
    one = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"), F.col("doc_id").alias("da"))
    two = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"), F.col("doc_id").alias("db"))
    sized = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(one, "a").join(two, "b")
    sized = sized.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    @F.pandas_udf("long")
    def differing(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="int64")
        a, b = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (x, y))
        return pd.Series(np.bitwise_count(a ^ b).sum(1).astype("int64"))

    needs = near(F.col("na"), F.col("nb"), percent)
    likely = sized.filter(differing("ma", "mb") <= F.col("na") + F.col("nb") - 2 * needs).select("a", "b", "na", "nb", "da", "db")
    likely = written(likely, "jaccard-likely")
    wanted = likely.select(F.col("a").alias("sig"), F.col("da").alias("doc_id")).union(likely.select("b", "db")).distinct()
    sets = written(whole_sets(docs, wanted, words), "jaccard-sets")
    left = likely.select("a", "b", "na", "nb").join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    links = written(both.filter(100 * same >= percent * (F.col("na") + F.col("nb") - same)).select("a", "b"), "jaccard-links")
    dropped(likely, sets)
    return links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text); see keyed_duplicates."""
    return keyed_duplicates(docs.withColumn("key", F.lit(0)), words, percent).select("doc_id", "n_shingles", "component_id")


def keyed_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, component) for every row of docs (doc_id, key, text).

    component tells components apart that have the same component_id (as rows of one doc_id, null
    being one too, can be in several); it is null for texts without words. key is passed through.

    component_id is the smallest doc_id that links reach. Two texts link when their sets' intersection
    is at least percent of their union; texts without words have an empty set and link with none. Null
    text counts as empty. A null doc_id takes part and never is the smallest; repeated rows each get
    their row; an empty table gives none. Equal sets meet as one class, so copies cost no pairs. Columns
    of other names, whatever they are, are not read. A task holds one Arrow batch of texts and the words
    of about a million characters, or of one longer text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    bits = sketch_bits(docs)
    first = written(sketched(docs, words, bits), "jaccard-first")
    ids = first.filter("slice < 0").select("doc_id", "key", "n", "sig")
    common = commonness(first.filter("slice >= 0"), bits, (ids.agg(F.sum("n")).first()[0] or 0) / (1 << bits))
    profile = written(profiled(docs, common, words, percent), "jaccard-profiles")
    reps = ids.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    members = profile.select("sig", "g", "n", "bitmap").dropDuplicates(["sig"])
    members = written(members.join(reps, "sig"), "jaccard-classes")
    heads = members.groupBy("g").agg(F.min("sig").alias("head"), F.count("*").alias("size"), F.first("n").alias("n"))

    # lists of at least two groups that share a prefix shingle
    tokens = profile.filter("prefix is not null").select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    # a token of class 0 has few rows by its bucket's count, so they may meet in a window; the others,
    # which can be in very many groups, are taken as shared and only join by partial aggregates
    of_token, common_one = Window.partitionBy("token"), F.shiftrightunsigned("token", 58) > 0
    rare = tokens.filter(~common_one).withColumn("lo", F.min("g").over(of_token)).withColumn("hi", F.max("g").over(of_token)).filter("lo <> hi")
    lists = rare.select("token", "g", "n", "pos").union(tokens.filter(common_one).select("token", "g", "n", "pos"))
    lists = written(lists, "jaccard-lists")

    # each group to the most central group of its lists
    listed = F.countDistinct("token")
    central = lists.groupBy("g").agg((listed / (F.first("n") * (100 - percent) / 100 + 1)).alias("central"), listed.alias("k"))
    ranked = lists.join(central, "g")
    hubs = ranked.groupBy("token").agg(F.max_by(F.struct("g", "n", "k"), F.struct("central", "g")).alias("h")).select("token", F.col("h.g").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.k").alias("hub_k"))
    sizes_fit = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    enough = F.least("k", "hub_k") >= shared_needed(F.col("n"), F.col("hub_n"), percent)
    spokes = ranked.join(hubs, "token").filter((F.col("g") != F.col("hub")) & sizes_fit & enough).select("hub", "g").distinct()
    ends = heads.select(F.col("g").alias("hub"), F.col("head").alias("a"))
    outer = spokes.join(ends, "hub").join(members.select("g", F.col("sig").alias("b")), "g").select("a", "b")
    inner = members.join(heads.filter("size > 1").select("g", F.col("head").alias("a")), "g").select("a", F.col("sig").alias("b"))
    links = verified(outer.union(inner), members, docs, words, percent)
    roots = written(components(links), "jaccard-roots")

    # what is left: pairs of groups not all of whose members are in one component already
    placed = members.join(roots, F.col("sig") == F.col("node"), "left").select("g", "sig", F.coalesce("root", "sig").alias("root"))
    placed = written(placed, "jaccard-placed")
    state = placed.groupBy("g").agg(F.min("root").alias("c"), F.max("root").alias("c2")).select("g", "c", (F.col("c") != F.col("c2")).alias("mixed"))
    rows = lists.join(state, "g")
    open_lists = rows.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max("mixed").alias("m"), F.min("n").alias("least"), F.ceil(F.count("*") / LISTED).cast("int").alias("parts")).filter("c1 <> c2 or m").select("token", "least", "parts")
    opened = rows = written(rows.join(open_lists, "token"), "jaccard-open")
    dropped(lists, profile)
    rows = rows.join(rows.groupBy("g").agg(F.countDistinct("token").alias("k")), "g")
    # tokens before the first shared one are not shared: what follows must suffice, with some size in the list
    rest = F.col("n") - F.col("pos")
    rows = written(rows.filter(rest >= near(F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100.0)), percent)).drop("least"), "jaccard-rows")
    dropped(opened)
    # long lists are dealt to several tasks on one side and copied to each of them on the other
    part = {"1": F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"), "2": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    x, y = (rows.select("token", part[k].alias("part"), *(F.col(c).alias(c + k) for c in ("g", "n", "pos", "c", "mixed", "k"))) for k in "12")
    apart = F.col("mixed1") | F.col("mixed2") | (F.col("c1") != F.col("c2"))
    fits = (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= near(F.col("n1"), F.col("n2"), percent))
    fits = fits & (F.least("k1", "k2") >= shared_needed(F.col("n1"), F.col("n2"), percent))
    pairs = x.join(y, ["token", "part"]).filter((F.col("g1") < F.col("g2")) & apart & fits).select("g1", "g2").distinct()
    pairs = pairs.union(state.filter("mixed").select(F.col("g").alias("g1"), F.col("g").alias("g2")))
    p1 = placed.select(F.col("g").alias("g1"), F.col("sig").alias("a"), F.col("root").alias("r1"))
    p2 = placed.select(F.col("g").alias("g2"), F.col("sig").alias("b"), F.col("root").alias("r2"))
    left = pairs.join(p1, "g1").join(p2, "g2").filter("r1 <> r2").select("a", "b")
    more = verified(left, members, docs, words, percent)
    if more.isEmpty():
        final = roots
    else:
        final = written(components(links.union(more)), "jaccard-roots")

    ids_of = members.select("sig", "doc_id").join(final, F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig"))
    least = ids_of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = ids_of.select("sig", "root").join(least, "root").select("sig", "component_id", F.col("root").alias("component"))
    return ids.join(named, "sig", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
