"""Token ids of whole texts by the tokenizers library, each different piece of text encoded once.

A byte-level BPE model never merges across the borders that its pre-tokeniser draws, and a space between two characters
that are not white space is always such a border. Beside other white space it is not: the whole run belongs together. A
batch's texts are cut at the spaces in Arrow, different pieces are found there, the library encodes a piece the first time
it is met, and ids are gathered by index. Texts with a space beside white space, or with a special token in them, take the
slower way: cut at sure borders only, or encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The splitting rule of byte-level BPE, a fixed value of the format.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space by that rule, other than the space, as an RE2 class.
OTHER_WHITE = r"[\t\n\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE_WHITE = f"  | {OTHER_WHITE}|{OTHER_WHITE} "
#: A space that is a border wherever it stands.
BORDER = regex.compile(r"(?<!\s) (?!\s)")
#: Characters whose classes no version of the rule's tables tells apart are below this one.
SETTLED = "\u0250"
#: Pieces and words that a process remembers (it starts anew beyond that), and bytes of text that it works on at once.
PIECES, WORDS, SLICE = 800_000, 100_000, 8 << 20

_ENCODERS: dict = {}


def byte_letters() -> dict[int, str]:
    """The format's letter for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, equal to the library's. Memory is bounded by the remembered pieces and the longest text."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.model, self.letters = self.library.model, byte_letters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.slow = "|".join([BESIDE_WHITE, *map(regex.escape, self.special)])
        self.words: dict[str, tuple] = {}
        self.marks = {mark: self._token(mark) for mark in ".,"}
        self._clear()

    def _clear(self) -> None:
        """Forget all pieces. Number 0 is the empty piece; 1 is kept for the end of a text."""
        self.after_space: dict[str, int] = {}
        self.pool, self.ends, self.lasting = array("I", [0]), array("i", [0, 0, 1]), 3

    def _forget(self) -> None:
        """Let go of what was added for one slice alone."""
        del self.ends[self.lasting :]
        del self.pool[self.ends[-1] :]
        if len(self.ends) > PIECES:
            self._clear()

    def _add(self, ids) -> int:
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        return len(self.ends) - 2

    def _token(self, token: str) -> list[int]:
        """The ids of one pre-token."""
        letters = token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _word(self, token: str) -> tuple[int, ...]:
        ids = self.words.get(token)
        if ids is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            ids = self.words[token] = tuple(self._token(token))
        return ids

    def _encoded(self, piece: str):
        """The ids of a piece that begins at a sure border."""
        if not piece.isascii() and max(piece) >= SETTLED:
            return self.library.encode(piece, add_special_tokens=False).ids
        return [i for token in PRE_TOKEN.findall(piece) for i in (self._word(token) if len(token) < 48 else self._token(token))]

    def _ids(self, number: int) -> list[int]:
        return self.pool[self.ends[number] : self.ends[number + 1]].tolist()

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Encode pieces that follow a space (it belongs to them). Words, with a full stop or comma or without, are kept.

        Returns the numbers of the other pieces, good for one slice.
        """
        known, tokenize, space, others = self.after_space, self.model.tokenize, self.letters[32], []
        for piece in pieces:
            if piece in known:
                continue
            body = piece[:-1] if piece[-1:] in self.marks else piece
            if not body.isalpha() or len(body) > 64 or not body.isascii() and max(body) >= SETTLED:
                others.append(piece)
                continue
            if body in known:  # letters are one pre-token
                ids = self._ids(known[body])
            else:
                ids = [t.id for t in tokenize(space + body)] if body.isascii() else self._token(" " + body)
            known[piece] = self._add(ids if body is piece else ids + self.marks[piece[-1]])
        self.lasting = len(self.ends)
        passing = {}
        for piece in others:
            head, line, rest = piece.partition("\n")
            if line and head in known and rest and not rest[0].isspace():  # a line's end between two words is a pre-token
                passing[piece] = self._add([*self._ids(known[head]), *self._word(line), *self._encoded(rest)])
            else:
                passing[piece] = self._add(self._encoded(" " + piece))
        return passing

    def _whole(self, text: str):
        """Ids of a text that isn't cut at all its spaces."""
        if any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        head, *rest = BORDER.split(text)
        out = array("I", self._encoded(head) if head else [])
        for piece in rest:
            out.extend(self._ids(self.after_space[piece]) if piece in self.after_space else self._encoded(" " + piece))
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        slow = np.flatnonzero(pc.match_substring_regex(texts, self.slow).to_numpy(zero_copy_only=False))
        uncut = {int(i): texts[int(i)].as_py() for i in slow}
        if uncut:
            mask = np.zeros(len(texts), bool)
            mask[slow] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        parts = pc.split_pattern(texts, " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        pieces, known = coded.dictionary.to_pylist(), self.after_space
        found = list(map(known.get, pieces))
        new = [i for i, number in enumerate(found) if number is None]
        passing = self._learn([pieces[i] for i in new])
        for i in new:
            p = pieces[i]
            found[i] = known[p] if p in known else passing[p]
        numbers = np.array(found, np.int32)
        numbers = numbers[coded.indices.to_numpy()]
        heads = coded.dictionary.take(coded.indices.take(pa.array(ends[:-1]))).to_pylist()
        heads = [self._whole(uncut[i]) if i in uncut else self._encoded(h) if h else () for i, h in enumerate(heads)]
        numbers[ends[:-1]] = [self._add(ids) if len(ids) else 0 for ids in heads]
        numbers = np.insert(numbers, ends[1:], 1)
        pool = pa.ListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int32)), pa.array(np.frombuffer(self.pool, np.uint32)))
        found = pool.take(pa.array(numbers))
        upto = found.offsets.to_numpy()[ends[1:] + np.arange(1, len(texts) + 1)].astype(np.int64)
        return found.flatten().to_numpy(), np.diff(upto, prepend=0)

    def batch(self, column: pa.Array, end_id: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, lengths) of some texts at a time, in order: all ids one after another, each text's followed by ``end_id``.

        A null is an empty text. Ids are unsigned 32-bit integers.
        """
        texts = pc.fill_null(column, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        which = np.cumsum(sizes, dtype=np.int64) // SLICE
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(which)) + 1):
            if len(part):
                self._forget()
                self.pool[0] = end_id
                yield self._slice(texts.slice(int(part[0]), len(part)))

    def encode(self, text: str | None) -> bytes:
        """One text's ids without an end id, as little-endian unsigned 32-bit integers."""
        ((ids, _),) = self.batch(pa.array([text], pa.string()))
        return ids[:-1].astype("<u4").tobytes()


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder; Python workers live longer than a task, and so does what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
