"""Exact token ids of whole texts by a public word tokenizer, with ids remembered per chunk of text.

The tokenizer drops white space, and neither its normaliser nor its splitting reaches across ASCII
white space, so a text's ids are those of its white-space-separated chunks put together. A chunk that
was seen before isn't encoded again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered by one Python worker; beyond it those seen once are forgotten. Results don't depend on it.
REMEMBERED = 250_000
_SEPARATOR = "\x01"
#: Punctuation between an ASCII letter and white space is a token group of its own; a space before it changes no id.
_TAIL = r"([a-z])([!-&(-/:-@\[-`{-~]+)([ \t\n\r])"
#: Lower-case letters only (ASCII, or two bytes from C3): one token group, which normalising keeps.
_SIMPLE = r"^(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+$"
_encoders: dict[str, ChunkIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> ChunkIds:
    """One encoder for all tasks of a Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkIds(path)
    return _encoders[path]


def chunk_lists(texts: pa.Array) -> pa.ListArray:
    """For each text (binary) chunks that have the same ids: lower-cased in A-Z, with trailing punctuation apart.

    A special token's name keeps its case; so does a text with combining marks (two bytes from CC or CD),
    which may compose with a capital but not with its small letter, or the other way round. Null texts have
    no chunk; an empty chunk has no ids.
    """
    texts = pc.fill_null(texts, b"")
    odd = pc.or_(pc.match_substring(texts, b"<|"), pc.or_(pc.match_substring(texts, b"\xcc"), pc.match_substring(texts, b"\xcd")))
    plain = pc.ascii_lower(texts.view(pa.string())).view(pa.binary())
    plain = pc.replace_substring_regex(plain, _TAIL, r"\1 \2\3")
    if pc.any(odd).as_py():
        plain = pc.if_else(odd, texts, plain)
    return pc.ascii_split_whitespace(plain.view(pa.string()))


class ChunkIds:
    """ids(texts) gives one array of ids per text, like encoding each text whole without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model, shared, for chunks that neither the normaliser nor the splitting changes.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.separator,) = self._encode(self.tokenizer, _SEPARATOR).tolist()
        self.simple = self._agrees()
        self.known = pa.array([], pa.binary())
        self.flat = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int32)  # ends[i+1] is where the i-th chunk's ids end
        self.seen = np.zeros(0, np.int32)

    @staticmethod
    def _encode(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _agrees(self) -> bool:
        """Whether the bare model may be used: the tokenizer must split just so and lower-case what it splits."""
        probe = "the quick \x01 stra\u00dfe \x01 d\u00e9j\u00e0 vu\u00ff \x01 zzyzx"
        return np.array_equal(self._encode(self.tokenizer, probe), self._encode(self.bare, probe))

    def _forget(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        length = self.ends[keep + 1] - self.ends[keep]
        ends = np.concatenate([[0], np.cumsum(length)])
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.ends[keep] - ends[:-1], length)]
        self.known = self.known.take(pa.array(keep))
        self.ends, self.seen = ends.astype(np.int32), np.ones(len(keep), np.int32)

    def _add(self, chunks: pa.Array, tokenizer, each: bool) -> None:
        """Encode new chunks, many at once with a separator between them unless each goes alone."""
        flats, lengths = [self.flat], [np.empty(0, np.int64)]
        names = chunks.to_pylist()
        step = 1 if each else 1000
        for i in range(0, len(names), step):
            some = names[i : i + step]
            ids = self._encode(tokenizer, b" \x01 ".join(some).decode("utf-8", "replace"))
            cuts = np.flatnonzero(ids == self.separator) if step > 1 else np.empty(0, np.int64)
            if len(cuts) == len(some) - 1:
                flats.append(np.delete(ids, cuts))
                lengths.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
            else:
                alone = [self._encode(tokenizer, c.decode("utf-8", "replace")) for c in some]
                flats += alone
                lengths.append(np.array(list(map(len, alone))))
        self.known = pa.concat_arrays([self.known, chunks])
        self.flat = np.concatenate(flats)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        self.seen = np.concatenate([self.seen, np.zeros(len(chunks), np.int32)])

    def _learn(self, chunks: pa.Array) -> None:
        odd = pc.match_substring(chunks, b"\x01")
        simple = pc.match_substring_regex(chunks, _SIMPLE) if self.simple else pc.xor(odd, odd)
        for which, tokenizer, each in ((simple, self.bare, False), (odd, self.tokenizer, True), (pc.invert(pc.or_(simple, odd)), self.tokenizer, False)):
            if len(some := chunks.filter(which)):
                self._add(some, tokenizer, each)

    def ids(self, texts: pa.Array | list[bytes | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        lists = chunk_lists(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        del lists
        # Each distinct chunk is looked up once a slice; all else is arithmetic on arrays.
        own = coded.dictionary.view(pa.binary())
        at = pc.index_in(own, value_set=self.known)
        if at.null_count:
            self._learn(own.filter(at.is_null()))
            at = pc.index_in(own, value_set=self.known)
        at = at.to_numpy()
        self.seen[at] += 1  # once for a slice, however often it has the chunk
        which = coded.indices.to_numpy()
        length = (self.ends[at + 1] - self.ends[at])[which]
        total = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        place = np.repeat(self.ends[at][which] - total[:-1], length)
        place += np.arange(total[-1], dtype=np.int32)
        flat = self.flat[place]
        cut = total[cut]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def slices(column: pa.Array, limit: int = 1 << 20, most: int = 4096) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of texts, with their first row: about limit bytes and at most so many texts; one text at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (size + n > limit or i - start >= most):
            yield start, column.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, column.slice(start)


def in_slices(column: pa.Array, limit: int = 1 << 20, most: int = 4096) -> Iterator[tuple[int, list[bytes | None]]]:
    """The same as Python objects; only a slice at a time becomes those, so a worker holds a batch once, whatever its texts' lengths."""
    for start, part in slices(column, limit, most):
        yield start, part.to_pylist()
