"""Token ids of whole texts through a cache of space-separated chunks.

A single space or line feed between two characters that aren't white space always ends a match of the byte-level
pattern: the space starts the next match, the line feed is a match by itself. So a text may be cut there and each
chunk encoded by itself: the ids are those of the whole text. Stops and commas between a letter and a space are chunks
of their own. Texts with other white space go through the encoder whole.

Arrow splits a batch and finds its distinct chunks; those that the cache (chunkcache.py) doesn't know are encoded together.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunkcache import ChunkCache, gather

LINES = 2000
_WORD = r"\A ?[A-Za-zÀ-ÖØ-öø-ɏ]+\z"
HEAD = "\x02"  # marks a chunk without a leading space
_STOPS = r"(\pL)([.,;:!?]+) "  # a letter, then only these up to a space: the marks are a match by themselves
# white space other than single spaces and line feeds between other characters, or the mark
_ODD = r"[\t\x02\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


class ChunkEncoder:
    """A call takes an array of texts (null counts as empty) and returns the uint32 ids of all, one after another, and where each ends.

    ``encode`` takes an array of distinct texts, none empty or with a line feed, and returns the ids of all and how many each has;
    ``encode_whole`` takes any text.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], encode_whole: Callable[[str], np.ndarray]):
        self.encode, self.encode_whole = encode, encode_whole
        self.cache = ChunkCache(np.uint32, self._encoded_chunks)
        line_feed = encode_whole("\n")
        self.cache.pin(["\n", HEAD], line_feed, np.array([len(line_feed), 0]))

    def _encoded_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        head = pc.starts_with(chunks, HEAD)
        return self.encode(pc.if_else(head, pc.replace_substring(chunks, HEAD, "", max_replacements=1), pc.binary_join_element_wise(" ", chunks, "")))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        doubtful = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)).tolist()
        odd = {i: self.encode_whole(texts[i].as_py()) for i in doubtful}
        if odd:
            texts = pc.if_else(pa.array([i in odd for i in range(len(texts))]), "", texts)
        marked = pc.binary_join_element_wise(HEAD, pc.replace_substring(texts, "\n", f" \n {HEAD}"), "")
        marked = pc.replace_substring_regex(marked, _STOPS, rf"\1 {HEAD}\2 ")
        cut = pc.split_pattern(marked, " ")
        codes = cut.flatten().dictionary_encode()
        flat, each = self.cache.take(codes.dictionary, codes.indices.to_numpy())
        ends = np.r_[0, np.cumsum(each)][cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]
        if odd:
            rows = np.split(flat, ends[:-1])
            rows = [odd.get(i, x) for i, x in enumerate(rows)]
            flat, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
        return flat.astype("<u4", copy=False), ends


def rows_of(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each row."""
    return np.insert(flat, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


def _byte_letters() -> np.ndarray:
    """How a byte-level vocabulary writes bytes as letters: visible ones as themselves, the others from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, hidden = np.arange(256, dtype="<u2"), [b for b in range(256) if b not in shown]
    out[hidden] = 256 + np.arange(len(hidden))
    return out


def _joined(texts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Rows up to each end in lines of one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), texts), "\n")


@functools.cache
def library_encoder(path: str) -> ChunkEncoder:
    """Ids by the tokenizers library without special tokens; their strings in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def whole(text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    line_feed, pieces, letters = int(whole("\n")[0]), tok.model.tokenize, _byte_letters()

    def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A word of letters, spaced or not, is one match, so the library's model takes it as it is."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = np.frombuffer(_joined(texts, np.array([len(texts)]))[0].as_buffer(), np.uint8)
        flat: list[int] = []
        size = []
        for word in letters[raw].tobytes().decode("utf-16-le").split(chr(letters[10])):
            made = pieces(word)
            size.append(len(made))
            flat += [x.id for x in made]
        return np.array(flat, np.uint32), np.array(size)

    def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One line for each text: a line feed beside other characters is always one id, and no text holds one."""
        pages = _joined(texts, np.r_[np.arange(LINES, len(texts), LINES), len(texts)])
        flat = np.concatenate([np.r_[whole(page.as_py()), np.uint32(line_feed)] for page in pages])
        ends = np.flatnonzero(flat == line_feed)[: len(texts)]
        return flat[flat != line_feed], np.diff(ends, prepend=-1) - 1

    def together(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(texts, _WORD).to_numpy(zero_copy_only=False)
        some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        made = [words(texts.take(pa.array(some))), lines(texts.take(pa.array(rest)))]
        flat, size = (np.concatenate(x) for x in zip(*made, strict=True))
        at = np.argsort(np.r_[some, rest])
        return gather(flat, (np.cumsum(size) - size)[at], size[at]), size[at]

    return ChunkEncoder(together, whole)
