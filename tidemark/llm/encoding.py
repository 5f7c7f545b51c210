"""Exact token ids of whole texts, with a memo of the words between blanks.

A byte-level BPE with the usual pattern never joins characters across a space or line
break that stands alone between two other characters: every alternative of the pattern
that holds one begins with it. Cut before it, each piece gets the same ids alone as
inside the text. Nor does it join a letter or digit with punctuation that follows, so a
word's closing marks are looked up apart from it. Arrow cuts the texts and numbers the
distinct pieces; the library encodes a word once while the memo holds it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Every kind of white space, for a regular expression.
_BLANK = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space or line break beside other white space, white space at an end of the text, or the mark of a first piece.
_ODD = rf"[ \n]{_BLANK}|{_BLANK}[ \n]|\A{_BLANK}|{_BLANK}\z|\x01"
#: Marks a piece that no space leads.
HEAD = "\x01"
#: Closing marks that are cut off a word, and the first code point whose letters are left to the library's own pattern.
MARKS = ".,;:!?&*$%#)]"
_SURE = "ɐ"
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def plain(column: pa.Array) -> pa.Array:
    """Whether every space and line break of a text stands alone between other characters; false if empty."""
    return pc.and_(pc.invert(pc.match_substring_regex(column, _ODD)), pc.greater(pc.binary_length(column), 0))


def numbered(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut before spaces and line breaks: the distinct pieces, each piece's number, and where each text's pieces begin."""
    led = pc.binary_join_element_wise(pa.scalar(HEAD, column.type), pc.replace_substring(column, "\n", " \n"), pa.scalar("", column.type))
    cut = pc.split_pattern(led, " ")
    encoded = cut.values.dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False), cut.offsets.to_numpy()


def groups(texts: pa.Array | list[str | None], characters: int) -> Iterator[pa.Array]:
    """Runs of texts (null: empty) of about so many bytes in all."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    run = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // characters
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield column.slice(a, b - a)


class ByteEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    The memo holds words of up to ``longest`` characters in two generations of up to
    ``entries`` each: a full one becomes the elder, and the elder is let go, which bounds
    the memory and keeps what is often seen. Longer words are encoded each time.
    """

    def __init__(self, path: str, entries: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.entries, self.longest = tokenizer(path), entries, longest
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = special
        self.marks = "".join(c for c in MARKS if not any(c in t for t in special))
        # ids whose token begins with a space or a line break, which byte-level vocabularies write as U+0120 and U+010A
        self.opens = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.opens[[i for x, i in self.library.get_vocab().items() if x.startswith("Ġ")]] = True
        self.line = self._ids(["\n"])[0].tobytes()
        # the same model without the pattern, for words of letters, which the pattern never cuts; they come in the vocabulary's byte letters
        self.letters = {c: self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, ord(_SURE)) if chr(c).isalpha()}
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words.model._resize_cache(0)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, ids: np.ndarray, new: list[str]) -> dict[str, bytes] | None:
        """The ids of words that each begin with a space, or None if their beginnings don't tell them apart."""
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(new) or (len(new) and starts[0]):
            return None
        raw, at = ids.tobytes(), (starts * 4).tolist()
        return {x: raw[a:b] for x, a, b in zip(new, at, [*at[1:], len(raw)], strict=True)}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encodes words: those of letters in one call without the pattern, other ones that follow a space in one call, the rest one by one."""
        spaced, simple, other = [], [], []
        for x in new:
            if x.isalpha() and (x.isascii() or max(x) < _SURE):
                spaced.append(x)
            elif x[0] == HEAD:
                other.append(x)
            else:
                simple.append(x)
        fresh: dict[str, bytes] = {}
        if spaced:
            line = " ".join(["Ġ" + (x if x.isascii() else x.translate(self.letters)) for x in spaced])
            found = self._cut(np.array(self.words.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4"), spaced)
            simple += spaced if found is None else []
            fresh.update(found or {})
        if simple:
            found = self._cut(self._ids(["".join([" " + x for x in simple])])[0], simple)
            if found is None:
                found = {x: i.tobytes() for x, i in zip(simple, self._ids([" " + x for x in simple]), strict=True)}
            fresh.update(found)
        if other:
            fresh.update((x, i.tobytes()) for x, i in zip(other, self._ids([x[1:] for x in other]), strict=True))
        return fresh

    def _parts(self, x: str) -> tuple[bytes, str, str]:
        """A piece as the ids of a leading line break, a word, and closing marks as a word that no space leads."""
        lead = b""
        if x[0] == "\n":
            lead, x = self.line, HEAD + x[1:]
        word = x.rstrip(self.marks)
        if len(word) < len(x):
            end = word[-1:]
            if end.isalnum() and (end < "\x80" or end.isalpha() and end < _SURE) and not any(t in x for t in self.special):
                return lead, word, HEAD + x[len(word) :]
        return lead, x, ""

    def _lookup(self, distinct: list[str]) -> list[bytes]:
        found = list(map(self.memo.get, distinct))
        missing = [i for i, y in enumerate(found) if y is None]
        pieces = [distinct[i] for i in missing]
        fresh: dict[str, bytes] = {}
        new: dict[str, int] = {}
        parts: list[tuple] = []
        ends = set(self.marks)
        for i, x, y in zip(missing, pieces, map(self.elder.get, pieces), strict=True):
            if y is not None:
                found[i] = fresh[x] = y
            elif x[-1] in ends or x[0] == "\n":
                parts.append((i, *self._parts(x)))
            else:
                new[x] = i
        wanted = dict.fromkeys([x for _, _, word, marks in parts for x in (word, marks) if x not in new])
        known = {"": b""}
        for x in wanted:
            y = self.memo.get(x) or self.elder.get(x)
            if y is not None:
                known[x] = y
        known.update(self._learn([*new, *(x for x in wanted if x not in known)]))
        for x, i in new.items():
            found[i] = known[x]
        for i, lead, word, marks in parts:
            found[i] = fresh[distinct[i]] = lead + known[word] + known[marks]
        del known[""]
        fresh.update(known)
        if len(self.memo) + len(fresh) > self.entries:
            self.memo, self.elder = {}, self.memo
        self.memo.update(fresh if max(map(len, fresh), default=0) <= self.longest else {x: y for x, y in fresh.items() if len(x) <= self.longest})
        return found

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text; the texts of one call are in memory together."""
        out: list[bytes] = [b""] * len(column)
        fit = plain(column)
        rest = np.flatnonzero(~fit.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(rest, self._ids([column[i].as_py() for i in rest]), strict=True):
            out[i] = ids.tobytes()
        if len(rest) < len(column):
            cut = np.flatnonzero(fit.to_numpy(zero_copy_only=False)).tolist()
            distinct, number, bounds = numbered(column.filter(fit))
            known = self._lookup(distinct)
            flat = np.frombuffer(b"".join(known), "<u4")
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            start = np.cumsum(size) - size
            own = size[number]
            ends = np.concatenate([[0], np.cumsum(own)])
            ids = flat[np.repeat(start[number] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
            edges = (ends[bounds] * 4).tolist()
            for i, a, b in zip(cut, edges, edges[1:], strict=False):
                out[i] = ids[a:b]
        return out

    def stream(self, texts: pa.Array | list[str | None], characters: int = 8_000_000) -> Iterator[bytes]:
        """The ids of each text in turn; null counts as empty."""
        for group in groups(texts, characters):
            yield from self.encode(group)


_ENCODERS: dict[tuple[str, int], ByteEncoder] = {}


def byte_encoder(path: str, entries: int = 400_000) -> ByteEncoder:
    """The encoder of a file, kept by the worker process for the tasks that follow."""
    if (path, entries) not in _ENCODERS:
        _ENCODERS[path, entries] = ByteEncoder(path, entries)
    return _ENCODERS[path, entries]


def forget() -> None:
    """Lets encoders and tokenizers go: Spark gives a worker process tasks of other operators, too, whose memory would come on top of the memos."""
    _ENCODERS.clear()
    _LOADED.clear()
