"""Token counts of every prefix by dynamic programming.

For each code point i of a text the operator knows how many tokens text[:i] has, so truncation
and budget questions need no further encoding. Within a word, the last token of a prefix's
encoding is the longest vocabulary entry that ends there and stays apart from the last token of
the prefix before it; the count is that prefix's count plus one.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.chunks import Clash, Growing, Numbers, packed
from gridjobs.llm.common import frame, id_list, ids_and_texts
from gridjobs.llm.tokens import WHITE, byte_alphabet, cut_after_blanks, groups_of, path_of, utf8, wide_space

#: Fixed value: the word pattern that a byte-level pre-tokenizer with its own regex uses.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker keeps, and bytes up to which words are counted side by side.
KEEP = 800_000
SHORT = 48
CONTRACTIONS = {"'ll", "'ve", "'re"}
#: Chunks of one word: letters, or ASCII marks.
_single = re.compile(r" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[!-/:-@\[-`{-~]+)").fullmatch
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Values of 64-bit keys, by probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.most = 1
        for key, slot, value in zip(keys.tolist(), ((keys * _MIX) >> self.shift).tolist(), values.tolist()):
            probe = 0
            while self.values[(slot + probe) & self.mask] >= 0:
                probe += 1
            self.keys[(slot + probe) & self.mask], self.values[(slot + probe) & self.mask] = key, value
            self.most = max(self.most, probe + 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values, -1 for unknown keys."""
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        for probe in range(1, self.most):
            if not len(open_):
                break
            at = (slot[open_] + probe) & self.mask
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] >= 0)]
        return out


class SideBySide:
    """The dynamic programme for many words at once, a byte position of all of them at a time."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        rng = np.random.default_rng(7)
        self.letters = rng.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0xD1342543DE82EF95
        powers, back = [1], [1]
        inverse = pow(base, -1, 1 << 64)
        for _ in range(SHORT):
            powers.append(powers[-1] * base % (1 << 64))
            back.append(back[-1] * inverse % (1 << 64))
        self.powers, self.back = np.array(powers, np.uint64), np.array(back, np.uint64)
        short = {t: i for t, i in vocab.items() if len(t) <= SHORT}
        keys = np.array([int((self.letters[list(t)] * self.powers[: len(t)]).sum(dtype=np.uint64)) for t in short], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        self.ids = Table(keys, np.array(list(short.values())))
        #: The longest entry that ends with these three bytes.
        self.tails = np.full(1 << 24, 2, np.uint8)
        for t in short:
            if len(t) > 2:
                k = t[-3] << 16 | t[-2] << 8 | t[-1]
                self.tails[k] = max(len(t), self.tails[k])
        # how each entry was made, when (-1: a byte), and from which two
        n = max(vocab.values()) + 1
        self.made, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        for rank, (a, b, ab) in enumerate(pairs):
            if self.made[ab] < 0:
                self.made[ab], self.left[ab], self.right[ab] = rank, a, b
        first = {(a, b): rank for rank, (a, b, _) in reversed(list(enumerate(pairs)))}
        self.ranks = Table(np.array([(a << 32 | b) + 1 for a, b in first], np.uint64), np.array(list(first.values())))
        self.forget()

    def forget(self) -> None:
        #: Pairs met last in each slot and whether they stay apart.
        self.met, self.apart = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)

    def walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether entries a and b side by side stay as they are.

        The merges that made both are undone from the latest on; if ever the two symbols that then
        touch have an earlier merge than the one undone last, they would have merged instead.
        """
        x, y, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 40, np.int64)
        out, todo = np.ones(len(a), bool), np.arange(len(a))
        while len(todo):
            rank = self.ranks.get((x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)) + np.uint64(1))
            bad = (rank >= 0) & (rank < limit)
            out[todo[bad]] = False
            mx, my = self.made[x], self.made[y]
            go = ~bad & ((mx >= 0) | (my >= 0))
            first = mx > my  # of equal merges the left one comes first
            limit = np.where(first, mx, my + 1)[go]
            x, y = np.where(first, self.right[x], x)[go], np.where(first, y, self.left[y])[go]
            todo = todo[go]
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)
        slot = ((keys * _MIX) >> np.uint64(44)).astype(np.int64)
        out = self.apart[slot]
        new = np.flatnonzero(self.met[slot] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            told = self.walk((fresh - np.uint64(1)) >> np.uint64(32), (fresh - np.uint64(1)) & np.uint64(0xFFFFFFFF))
            out[new] = told[back]
            slot = ((fresh * _MIX) >> np.uint64(44)).astype(np.int64)
            self.met[slot], self.apart[slot] = fresh, told
            # of several keys of a slot one stays, with its own answer
            kept = np.flatnonzero(self.met[slot] == fresh)
            self.apart[slot[kept]] = told[kept]
        return out

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each code point of words of up to SHORT bytes, end to end, and their numbers."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        longest, n = int(lens.max(initial=0)), len(words)
        rows = np.zeros((n, longest + 1), np.uint8)
        rows[np.repeat(np.arange(n), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = np.frombuffer(b"".join(words), np.uint8)
        text = np.ascontiguousarray(rows[order].T)
        many = np.searchsorted(-lens[order], -np.arange(1, longest + 1), side="right")
        sums = np.zeros((longest + 1, n), np.uint64)
        for d in range(longest):
            sums[d + 1] = sums[d] + self.letters[text[d]] * self.powers[d]
        last, count = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        for d in range(1, longest + 1):
            todo = np.arange(many[d - 1])
            if d > 2:
                t = text[d - 3 : d, : len(todo)].astype(np.int64)
                bound = np.minimum(self.tails[t[0] << 16 | t[1] << 8 | t[2]], d)
            else:
                bound = np.full(len(todo), d)
            for size in range(int(bound.max(initial=0)), 0, -1):
                some = todo[bound[todo] >= size]
                token = self.ids.get((sums[d][some] - sums[d - size][some]) * self.back[d - size])
                known = token >= 0
                some, token = some[known], token[known]
                if size < d and len(some):
                    fits = self.stay_apart(last[d - size][some], token)
                    some, token = some[fits], token[fits]
                last[d][some], count[d][some] = token, count[d - size][some] + 1
                todo = todo[count[d][todo] == 0]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        ends = (np.arange(1, longest + 1) <= lens[:, None]) & ((rows[:, 1:] & 0xC0) != 0x80)
        return count[1:].T[back][ends], ends.sum(1)


class PrefixCounter:
    """Counts for all prefixes of texts under one byte-level BPE file."""

    def __init__(self, path: str, keep: int = KEEP):
        self.keep = keep
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told["pre_tokenizer"] or {}
        if told["normalizer"] is not None or told["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE with its own word pattern")
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        added = {t["content"] for t in told["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        self.vocab = {raw(s): i for s, i in told["model"]["vocab"].items() if s not in added}
        merges = [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])]
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.tails: dict[bytes, int] = {}  # the longest entry that ends with these three bytes
        for token in self.vocab:
            self.tails[token[-3:]] = max(len(token), self.tails.get(token[-3:], 2))
        self.words = regex.compile(WORDS).findall
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.lead = re.compile(f"[{WHITE}]*").match
        self.table = SideBySide(self.vocab, merges)
        self.forget()

    def forget(self, turn: int = 0) -> None:
        self.seen, self.steps, self.pieces = Numbers(turn), Growing(np.int32), {}
        self.table.forget()

    def long_word(self, data: bytes) -> list[int]:
        """Counts after each byte of a long word, position by position."""
        last, count, known = [0], [0], {}
        for i in range(1, len(data) + 1):
            for at in range(max(0, i - self.tails.get(data[max(0, i - 3) : i], 2)) if i > 2 else 0, i):
                token = self.vocab.get(data[at:i])
                if token is None:
                    continue
                pair = (last[at], token)
                if at and pair not in known:
                    known[pair] = bool(self.table.walk(np.array([last[at]]), np.array([token]))[0])
                if not at or known[pair]:
                    break
            last.append(token)
            count.append(count[at] + 1)
        return count

    def learn_words(self, words: list[str]) -> None:
        """Counts after each code point of every word."""
        short = [w for w in words if len(utf8(w)) <= SHORT]
        flat, lens = self.table.counts([utf8(w) for w in short])
        ends = np.cumsum(lens)
        self.pieces.update((w, flat[b - n : b].tolist()) for w, b, n in zip(short, ends, lens))
        for word in set(words) - set(short):
            count = self.long_word(utf8(word))
            self.pieces[word] = [count[e] for e in accumulate(len(utf8(c)) for c in word)]

    def parts(self, chunk: str) -> tuple[int, list[str]]:
        """Length of the leading white space, and the words of the whole chunk."""
        lead = self.lead(chunk).end()
        return lead, self.words(chunk) if lead < len(chunk) else []

    def of_chunk(self, chunk: str, lead: int, words: list[str]) -> list[int]:
        """Counts after each code point of white space and the run of other characters after it."""
        out = self.pieces[chunk[:lead]][:] if lead else []
        base = at = 0
        for word in words:
            own = self.pieces[word]
            if word in CONTRACTIONS:
                own = [1, 2, own[-1]]
            out += [base + x for x in own[max(0, lead - at) :]] if base else own[max(0, lead - at) :]
            base, at = base + own[-1], at + len(word)
        return out

    def learn(self, todo: list[bytes]) -> None:
        """Steps from each code point's count to the next of new chunks."""
        texts = [x.decode("utf-8", "surrogatepass") for x in todo]
        single = np.fromiter((len(x) <= SHORT and _single(t) is not None for x, t in zip(todo, texts)), bool, len(todo))
        flat, lens = self.table.counts([x for x, one in zip(todo, single) if one])
        ends, own = np.cumsum(lens), [None] * len(todo)
        for i, b, n in zip(np.flatnonzero(single).tolist(), ends.tolist(), lens.tolist()):
            own[i] = flat[b - n : b]
        rest = np.flatnonzero(~single).tolist()
        parts = [self.parts(texts[i]) for i in rest]
        words = {w for _, ws in parts for w in ws} | {texts[i][:lead] for i, (lead, _) in zip(rest, parts) if lead}
        if len(self.pieces) > self.keep:
            self.pieces = {}
        self.learn_words(sorted(words - self.pieces.keys()))
        for i, (lead, ws) in zip(rest, parts):
            own[i] = np.array(self.of_chunk(texts[i], lead, ws), np.int32)
        if own:
            counts, lens = np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
            steps = np.diff(counts, prepend=0)
            starts = (np.cumsum(lens) - lens)[lens > 0]
            steps[starts] = counts[starts]
            self.steps.append(steps, lens)

    def segments(self, text: str) -> list[tuple[int, int, int | None]]:
        """(start, end, end of its special string or None) of the parts between special strings."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out.append((at, m.start(), m.end()))
            at = m.end()
        return [*out, (at, len(text), None)]

    def plain_steps(self, raw: list[bytes], cuts=None) -> list[np.ndarray]:
        """Steps of texts, special strings taken as plain text; chunks as lengths of bytes or found here."""
        buf, at = packed(raw)
        if cuts is None:
            starts, ends = cut_after_blanks(buf)
        else:
            starts = np.concatenate([a + np.cumsum(c) - c for a, c in zip(at, cuts)])
            ends = starts + np.concatenate(cuts)
        idx, new = self.seen.numbers(buf, starts, ends - starts)
        self.learn([buf[a:b].tobytes() for a, b in zip(starts[new], ends[new])])
        upto = np.concatenate([[0], np.cumsum(self.steps.lengths(idx))])
        bounds = upto[np.append(np.searchsorted(starts, at), len(idx))]
        flat = self.steps.gather(idx)
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def steps_of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the steps from each code point's count to the next, as the library would count."""
        if len(self.seen) > self.keep:
            self.forget()
        pieces, told = [], []
        for text in texts:
            # up to the last character of a special string its beginning is plain text
            parts = [(b - a, c, text[a : b if c is None else c - 1]) for a, b, c in self.segments(text)]
            told.append((len(pieces), parts))
            pieces += [p[2] for p in parts]
        raw = [utf8(p) for p in pieces]
        wide = [wide_space(p, x) for p, x in zip(pieces, raw)]
        made: list = [None] * len(pieces)
        turn = self.seen.turn
        while True:
            try:
                for kind in (False, True):
                    at = [i for i, w in enumerate(wide) if w == kind]
                    cuts = [np.array([len(utf8(c)) for c in self.chunks(pieces[i])], np.int64) for i in at] if kind else None
                    for i, steps in zip(at, self.plain_steps([raw[i] for i in at], cuts) if at else ()):
                        made[i] = steps
                break
            except Clash:  # chunks of one hash: another hash tells them apart
                turn += 2
                self.forget(turn)
        out = []
        for at, parts in told:
            if len(parts) == 1:
                out.append(made[at])
                continue
            own = []
            for steps, (size, end, _) in zip(made[at:], parts):
                own += [steps] if end is None else [steps, np.array([1 - steps[size:].sum()], np.int32)]
            out.append(np.concatenate(own))
        return out

    def counts_of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the counts after each code point, as the library would give them."""
        return [np.cumsum(x) for x in self.steps_of(texts)]


def pack_steps(steps: np.ndarray) -> tuple[int, bytes]:
    """Steps between neighbouring counts: a byte each where they fit, else four."""
    width = 1 if not len(steps) or np.abs(steps).max() < 128 else 4
    return width, steps.astype(f"<i{width}").tobytes()


def unpack_counts(width: int, steps: bytes) -> np.ndarray:
    """Token count after each code point, from what the operator stored."""
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def tokens_before(width: int, steps: bytes, chars: int) -> int:
    """Tokens of the first chars code points, or of the whole text if it has fewer."""
    counts = unpack_counts(width, steps)
    return int(counts[min(chars, len(counts)) - 1]) if chars > 0 and len(counts) else 0


def longest_prefix(width: int, steps: bytes, budget: int) -> int:
    """Most code points whose tokens stay within the budget."""
    fits = np.flatnonzero(unpack_counts(width, steps) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}

SCHEMA = "doc_id long, n_bytes long, n_tokens long, fits_chars long, step_width int, steps binary"


def prefix_counts(docs: DataFrame, path: str, budget: int = 1024) -> DataFrame:
    """Per document: bytes, tokens, the longest prefix within the budget, and the counts of all prefixes.

    step_width and steps hold the counts (unpack_counts). No shuffle; a worker keeps at most KEEP
    chunks and four million characters of texts. Null or empty text: no bytes, no tokens, empty steps. A null doc_id stays null; rows are
    treated one by one, so repeated rows give repeated results and an empty table gives none. Columns
    of other names, whatever they are, are not read.
    """

    def run(batches):
        if path not in _counters:
            _counters[path] = PrefixCounter(path)
        counter = _counters[path]
        for batch in batches:
            for a, b in groups_of(batch["text"], 1 << 22):
                rows = []
                texts = [x if isinstance(x, str) else "" for x in batch["text"][a:b]]
                for doc_id, text, steps in zip(id_list(batch, a, b), texts, counter.steps_of(texts)):
                    counts = np.cumsum(steps)
                    fits = np.flatnonzero(counts <= budget)
                    rows.append((doc_id, len(utf8(text)), int(counts[-1]) if len(counts) else 0, int(fits[-1]) + 1 if len(fits) else 0, *pack_steps(steps)))
                yield frame(rows, SCHEMA)

    return ids_and_texts(docs).mapInPandas(run, SCHEMA)


def op10_prefix_counts(spark, sf_dir: str) -> DataFrame:
    counted = prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_of("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_chars", "step_width", "steps")
