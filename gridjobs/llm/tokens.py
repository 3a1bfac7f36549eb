"""Encoding of whole texts with a tokenizer file, by chunks that are encoded once.

A text is cut only where the tokenizer always starts a new word, so the ids of a text are the
ids of its chunks in order. Each Python worker keeps the ids of the chunks it has met, up to a
fixed number; texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from gridjobs.llm.chunks import SPACE, Clash, Growing, Numbers, packed, segments

#: Unicode white space beyond ASCII.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "\t-\r " + WIDE_SPACE
#: White space of both kinds side by side, where a run cannot be told from its ASCII part.
_mixed = re.compile(f"[\t-\r ][{WIDE_SPACE}]|[{WIDE_SPACE}][\t-\r ]").search
_wide = re.compile(f"[{WIDE_SPACE}]").search
#: Lead bytes of such characters.
_WIDE_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
#: Chunks of a text with such runs: the last blank of a run goes with the next word.
_byte_chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
#: Bytes of characters below U+0180.
_LOW = bytes(range(0xC6))
#: Kinds of tokenizer: one keeps white space, the other lower-cases and drops it.
BYTES, WORDS = "bytes", "words"
KEEP = 400_000


def path_of(name: str) -> str:
    """Where the public tokenizer file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def lowered(text: str) -> bytes:
    """Bytes of the text, its Latin letters lower-cased if it has no other letters.

    A tokenizer that lower-cases gives the same ids for both, and there are fewer different chunks.
    """
    if text.isascii():
        return text.lower().encode()
    data = utf8(text)
    return data if data.translate(None, _LOW) or "\u0130" in text else text.lower().encode()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_SHOWN = {b: c for c, b in byte_alphabet().items()}


def shown(chunk: str) -> str:
    """A chunk in the stand-ins of its bytes."""
    return chunk.replace(" ", "\u0120") if chunk.isascii() else utf8(chunk).decode("latin-1").translate(_SHOWN)


def wide_space(text: str, data: bytes) -> bool:
    return any(x in data for x in _WIDE_LEADS) and _wide(text) is not None


def mixed_space(text: str, data: bytes) -> bool:
    """Whether ASCII and other white space stand side by side."""
    return any(x in data for x in _WIDE_LEADS) and _mixed(text) is not None


def cut_with_blanks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks that keep white space: the last blank of a run goes with the next word."""
    starts, ends, kind = segments(buf)
    white = kind == SPACE
    joins = np.append(white[:-1] & ~white[1:] & (ends[:-1] == starts[1:]), False)[: len(white)]
    blank = joins & (buf[ends - 1] == 32)
    starts = starts - np.concatenate([[False], blank[:-1]])[: len(starts)]
    # a run before a word gives what precedes its last character, and that character unless a blank
    one, two = np.where(joins, ends - 1, ends), ends - blank
    at = np.stack([starts, one], 1).ravel()
    to = np.stack([one, two], 1).ravel()
    kept = at < to
    return at[kept], to[kept]


def cut_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks without white space."""
    starts, ends, kind = segments(buf)
    kept = kind != SPACE
    return starts[kept], ends[kept]


def cut_after_blanks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks that keep all white space with what follows it."""
    starts, ends, kind = segments(buf)
    white = kind == SPACE
    joins = np.append(white[:-1] & ~white[1:] & (ends[:-1] == starts[1:]), False)[: len(white)]
    starts[1:][joins[:-1]] = starts[:-1][joins[:-1]]
    return starts[~joins], ends[~joins]


class Encoder:
    """Ids of texts as the library gives them, without added special tokens."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = list(special)
        self.break_text, self.break_id = next(iter(special.items()), (None, None))
        # plain words go to the model without the rest of the library's work
        self.is_plain = re.compile(" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+" if kind == BYTES else "[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
        self.cut, self.bytes_of = (cut_with_blanks, utf8) if kind == BYTES else (cut_words, lowered)
        self.forget()

    def forget(self, turn: int = 0) -> None:
        self.seen, self.ids = Numbers(turn), Growing(np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def marks(self, text: str) -> bool:
        return any(x in text for x in self.special) or (self.kind == WORDS and any(x in text.lower() for x in self.special if "<" in text))

    def of_rest(self, todo: list[str]) -> list[np.ndarray]:
        """Ids of chunks that are no plain words, 200 in one text, parted by a special token."""
        if self.break_text:
            out: list[np.ndarray] = []
            for encoded in self.library.encode_batch_fast([self.break_text.join(todo[i : i + 200]) for i in range(0, len(todo), 200)], add_special_tokens=False):
                got = np.array(encoded.ids, np.int32)
                at = np.flatnonzero(got == self.break_id)
                out += [got[a:b] for a, b in zip([0, *(at + 1)], [*at, len(got)])]
            if len(out) == len(todo):
                return out
        return [self.whole(x) for x in todo]

    def learn(self, todo: list[str]) -> None:
        tokenize, plain = self.model.tokenize, self.is_plain
        made: list = [[t.id for t in tokenize(shown(x))] if plain(x) else None for x in todo]
        rest = [i for i, ids in enumerate(made) if ids is None]
        for i, ids in zip(rest, self.of_rest([todo[i] for i in rest])):
            made[i] = ids
        lens = np.fromiter(map(len, made), np.int64, len(made))
        self.ids.append(np.fromiter(chain.from_iterable(made), np.int32, lens.sum()), lens)

    def ids_of(self, raw: list[bytes], cuts=None) -> list[np.ndarray]:
        """Ids of each text from those of its chunks, given as lengths of their bytes or found here."""
        buf, at = packed(raw)
        if cuts is None:
            starts, ends = self.cut(buf)
        else:
            starts = np.concatenate([a + np.cumsum(c) - c for a, c in zip(at, cuts)])
            ends = starts + np.concatenate(cuts)
        idx, new = self.seen.numbers(buf, starts, ends - starts)
        self.learn([buf[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts[new], ends[new])])
        upto = np.concatenate([[0], np.cumsum(self.ids.lengths(idx))])
        bounds = upto[np.append(np.searchsorted(starts, at), len(idx))]
        flat = self.ids.gather(idx)
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.seen) > KEEP:
            self.forget()
        out: list = [None] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            text = text or ""
            if self.marks(text):
                out[i] = self.whole(text)
                continue
            data = self.bytes_of(text)
            if self.kind == BYTES and mixed_space(text, data):
                odd.append((i, text))
            else:
                plain.append((i, data))
        turn = self.seen.turn
        while True:
            try:
                for some, cuts in ((plain, None), ([(i, utf8(t)) for i, t in odd], [np.array([len(utf8(c)) for c in _byte_chunks(t)], np.int64) for _, t in odd])):
                    if some:
                        for (i, _), ids in zip(some, self.ids_of([b for _, b in some], cuts)):
                            out[i] = ids
                return out
            except Clash:  # chunks of one hash: another hash tells them apart
                turn += 2
                self.forget(turn)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def groups_of(values, chars: int = 1 << 21):
    """Slices of a batch holding about so many characters, so intermediate lists stay small."""
    start = held = 0
    for i, x in enumerate(values):
        held += len(x) if isinstance(x, str) else 0
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)
