"""Secret scans over a trigram inverted index, with DataFrame operations alone.

The index is a stored table: for every split and trigram the sorted list of the texts that hold it, a text
being named by its 64-bit hash, so copies are one entry and the lists do not depend on where rows lie. Each
rule's regex gives a Boolean query of trigrams that any match must hold; lists of a split are intersected
and united, and only the candidates are verified with the regex. Rules without mandatory trigrams scan every
text. Names of texts are shuffled, texts are not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.common import dropped, written


@dataclass(frozen=True)
class Rule:
    """A kind, its regex, and the group that must have so many characters for a match to stay."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules. Runs of one class are as long as they can be, so their least
#: length may stand in the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def _strings(items, most: int = 64) -> list[set[str]]:
    """Sets of lower-cased strings of which a match holds one each, from a parsed regex."""
    out, now = [], {""}

    def end():
        nonlocal now
        if now != {""}:
            out.append(now)
        now = {""}

    def grow(more: set[str]):
        nonlocal now
        if len(now) * len(more) > most:
            end()
        now = {a + b for a, b in ((a, b) for a in now for b in more)}

    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            grow({chr(arg).lower()})
        elif op == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
            grow({chr(c).lower() for _, c in arg})
        elif op == "SUBPATTERN":
            inner = _exact(arg[-1])
            if inner is None:
                end()
                out += _strings(arg[-1])
            else:
                grow(inner)
        elif op == "BRANCH":
            inner = [_exact(x) for x in arg[1]]
            if all(x is not None for x in inner):
                grow(set().union(*inner))
            else:
                end()
        elif op == "MAX_REPEAT" and arg[:2] == (0, 1) and (inner := _exact(arg[2])) is not None:
            grow(inner | {""})
        else:
            if op == "MAX_REPEAT" and arg[0] >= 1:
                end()
                out += _strings(arg[2])
            end()
    end()
    return out


def _exact(items) -> set[str] | None:
    """All strings that this part matches, if they are few and plain."""
    found = _strings(items)
    plain = {"LITERAL", "IN", "SUBPATTERN", "BRANCH", "MAX_REPEAT"}
    ok = all(str(op) in plain and (str(op) != "MAX_REPEAT" or a[:2] == (0, 1)) and (str(op) != "IN" or len(a) <= 4) for op, a in items)
    return (found[0] if found else {""}) if ok and len(found) <= 1 else None


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses, all needed; each a list of alternatives, one needed; each a set of trigrams, all needed."""
    clauses = []
    for strings in _strings(re._parser.parse(pattern)):
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return clauses


#: Texts to a split, about, and so entries of a posting list.
SPLIT = 1 << 15
#: Most candidates that are sent to every task, about 30 MB; beyond that they meet the texts in a shuffle.
FEW = 1 << 20


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def index(docs: DataFrame, trigrams: list[str], split: int = SPLIT) -> DataFrame:
    """(split, trigram, keys): the sorted posting list of every trigram in every split.

    keys are hashes of whole texts and tell the split. Two texts of one hash share an entry, which then
    has the trigrams of both, so no candidate is lost. Trigrams are those of the lower-cased text.
    """
    splits = max(1, -(-docs.count() // split))
    low = F.lower(text_of())
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    entries = docs.select(F.xxhash64(text_of()).alias("key"), F.explode(held).alias("trigram")).distinct()
    return entries.groupBy(F.pmod("key", F.lit(splits)).cast("int").alias("split"), "trigram").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def candidates(lists: DataFrame, queries: list[list[list[frozenset[str]]]]) -> DataFrame:
    """(key, rules): the texts that posting lists give for each trigram query, and the numbers of these.

    A split answers by itself: alternatives intersect their lists, a clause unites its alternatives, and a
    query intersects its clauses. Queries without clauses have no candidates here.
    """
    none = F.array().cast("array<bigint>")
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    both = lambda xs: reduce(F.array_intersect, xs)
    any_of = lambda xs: reduce(F.array_union, xs)
    named = lambda k: lambda key: F.struct(key.alias("key"), F.lit(k).alias("rule"))
    answers = [F.transform(both([any_of([both([of(t) for t in sorted(some)]) for some in clause]) for clause in query]), named(k)) for k, query in enumerate(queries) if query]
    by_split = lists.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    found = by_split.select(F.explode(F.flatten(F.array(*answers))).alias("x")).select("x.*")
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> of the rule's matches, in code points, leftmost first.

    The texts between matches and the matches themselves have the lengths from which places follow.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    measured = F.zip_with(F.zip_with(between, whole, lambda b, w: F.struct(F.length(b).alias("gap"), F.length(w).alias("len"))), kept, lambda m, g: F.struct(m["gap"].alias("gap"), m["len"].alias("len"), F.length(g).alias("own")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, m):
        start = acc["at"] + m["gap"]
        end = start + m["len"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["own"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(measured, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan(docs: DataFrame, rules=RULES, few: int = FEW) -> DataFrame:
    """All columns of docs and `found`: array<struct<start, kind, end>>, by start, then rule, then end.

    One pass makes the index, a second verifies its candidates; rows are told by their texts, so null and
    repeated ids are rows like others, and no text is shuffled while there are at most `few` different
    candidate texts. Null text counts as empty; a text without secrets has an empty array. A task holds one
    text and its spans at a time, however long it is. Columns of docs named found, _key, _name or _rules
    are replaced or dropped; others, whatever their names, are kept.
    """
    docs = docs.drop("found", "_key", "_name", "_rules")
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for clauses in queries for c in clauses for some in c for t in some})
    if trigrams:
        lists = written(index(docs, trigrams), "secrets-index")
        named = written(candidates(lists, queries), "secrets-candidates")
        dropped(lists)
        named = named.select(F.col("key").alias("_name"), F.col("rules").alias("_rules"))
        named = F.broadcast(named) if named.limit(few + 1).count() <= few else named
        docs = docs.withColumn("_key", F.xxhash64(text_of())).join(named, F.col("_key") == F.col("_name"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for k, rule in enumerate(rules):
        own = spans_of(text_of(), rule, k)
        asked = F.coalesce(F.array_contains("_rules", k), F.lit(False)) if queries[k] else F.lit(True)
        each.append(F.when(asked, own).otherwise(none))
    return docs.withColumn("found", F.array_sort(F.concat(*each))).drop("_key", "_name", "_rules")


def told(found: Column, rules=RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", rules=RULES) -> DataFrame:
    """docs, without the columns that scan replaces, and every found span of the text replaced by the mask;
    overlapping spans get one."""
    cols, text = [c for c in docs.columns if c not in ("found", "_key", "_name", "_rules")], F.col("text")

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = scan(docs, rules).withColumn("text", F.when(F.size("found") > 0, clean).otherwise(text))
    return masked.select(*cols)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs).select("doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    spans = told(F.col("found"))
    return found.select("doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES)), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _spans_sql(rule: Rule, order: int) -> str:
    p = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: struct_pack(
      start := CAST(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0) AS BIGINT),
      kind := {order}, len := CAST(length(regexp_extract_all(t, {p})[i]) AS BIGINT), own := length(regexp_extract_all(t, {p}, {rule.group})[i]))), lambda s: s.own >= {rule.least})"""


OP8_SQL = f"""
WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
each AS (SELECT doc_id, {", ".join(f"{_spans_sql(r, k)} AS {r.kind}" for k, r in enumerate(RULES))} FROM docs),
told AS (SELECT doc_id, {", ".join(f"CAST(len({r.kind}) AS BIGINT) AS n_{r.kind}" for r in RULES)},
  array_to_string(list_transform(list_sort({" || ".join(f"list_transform({r.kind}, lambda s: struct_pack(start := s.start, kind := s.kind, stop := s.start + s.len))" for r in RULES)}),
    lambda s: {[r.kind for r in RULES]!r}[s.kind + 1] || ':' || s.start || ':' || s.stop), ',') AS spans FROM each)
SELECT doc_id, {", ".join(f"n_{r.kind}" for r in RULES)}, sha256(spans) AS base_sha256, spans FROM told
"""
