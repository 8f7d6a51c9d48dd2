"""Library tokenizers over whole texts by way of distinct stretches.

The libraries' own encoders take microseconds a word, so a batch of texts is cut where their pre-tokenizers always
cut, the distinct stretches of the batch are numbered, and each is encoded once. Texts are then put together from the
numbers of their stretches. A bounded memo holds what the library gave for a stretch. Texts that hold a special
token's string go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from margrid.llm.common import CHUNK_BYTES, SPACE

# Stretches that one worker remembers, at most about 40 MB; the memo starts anew beyond it.
MEMO = 150_000
# Bytes of text whose stretches are numbered at a time.
SLICE = 2 * CHUNK_BYTES

# Letters that stay one pre-token, and one letter each, under any of the libraries' normalizers, and marks after them.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]*"
_PLAIN = f"^(?P<letters>{_LETTERS})(?P<marks>[!-&(-/:-@\\[-`{{-~]*)$"
_ONLY_LETTERS = re.compile(_LETTERS)
_WORD_END = "</w>"
# First bytes of characters that are no white space, by UTF-8: ASCII graphic ones and leads that begin no space.
_WORD_START = np.zeros(256, bool)
_WORD_START[0x21:0x7F] = True
_WORD_START[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True

_ids: dict[str, dict[str, bytes]] = {}
_numbers: dict[str, dict[bytes, int]] = {}


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


def _encode(path: str, texts: list[str]) -> list:
    return load(path).encode_batch_fast(texts, add_special_tokens=False) if texts else []


def _split(path: str, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts with nulls and texts that hold special strings empty, and the places of the latter."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    odd = np.zeros(len(column), bool)
    for s in special_strings(path):
        odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(odd), "", column) if odd.any() else column, np.flatnonzero(odd)


def _stretches(column: pa.Array, cut: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct stretches, the number of each stretch of all texts, and each text's first stretch (one more at the end).

    ``cut`` gives from bytes the places where stretches begin beside the beginnings of texts; stretches cover all bytes.
    """
    texts = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, texts + 1, column.offset * 8)
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[cut(data)] = True
    begins[offsets] = True
    begins[len(data)] = False
    starts = np.flatnonzero(begins)
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]
    ).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets)


def _before_words(data: np.ndarray) -> np.ndarray:
    """Places of words after ASCII white space."""
    space = SPACE[data]
    return np.flatnonzero(space[:-1] & ~space[1:]) + 1


def _at_spaces(data: np.ndarray) -> np.ndarray:
    """Places of spaces that a character other than white space follows."""
    return np.flatnonzero((data[:-1] == 0x20) & _WORD_START[data[1:]])


def word_ids(path: str, column: pa.Array) -> list[np.ndarray]:
    """Ids of each text as unsigned 32-bit numbers.

    For tokenizers whose pre-tokens never hold white space, as those that drop it, and whose letters are one
    pre-token apart from marks: ASCII white space then parts the text into stretches that are encoded on their own.
    """
    plain, odd = _split(path, column)
    names, code, first = _stretches(plain, _before_words)
    ids, ends = _gather(*_words(path, names), code)
    bounds = ends[first].tolist()
    out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i, e in zip(odd.tolist(), _encode(path, [column[i].as_py() for i in odd.tolist()]), strict=True):
        out[i] = np.asarray(e.ids, "<u4")
    return out


def token_counts(path: str, column: pa.Array) -> np.ndarray:
    """Number of pieces of each text: distinct pre-tokens are counted once and joined to each text's frequencies.

    For byte-level tokenizers whose pre-tokens take one space before a word: a text is cut before each
    space that a word follows, where such a pre-tokenizer always begins a new pre-token.
    """
    plain, odd = _split(path, column)
    names, code, first = _stretches(plain, _at_spaces)
    pieces = _remembered(
        _numbers.setdefault(path, {}), names.to_pylist(), lambda new: [len(e) for e in _encode(path, [w.decode() for w in new])]
    )
    # frequencies: rows (text, pre-token, number), joined to the pre-tokens' pieces by number
    text = np.repeat(np.arange(len(plain)), np.diff(first))
    row, frequency = np.unique(text * max(len(names), 1) + code, return_counts=True)
    joined = frequency * np.array(pieces, np.int64)[row % max(len(names), 1)]
    out = np.bincount(row // max(len(names), 1), joined, len(plain)).astype(np.int64)
    for i, e in zip(odd.tolist(), _encode(path, [column[i].as_py() for i in odd.tolist()]), strict=True):
        out[i] = len(e)
    return out


def _remembered(memo: dict, names: list, encode: Callable[[list], list]) -> list:
    """The values of ``names`` (distinct), encoding those that the memo does not hold."""
    new = [n for n in names if n not in memo]
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = names
    for i in range(0, len(new), 1 << 16):
        some = new[i:i + (1 << 16)]
        memo.update(zip(some, encode(some), strict=True))
    return [memo[n] for n in names]


def _gather(flat: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (one after the other, of these sizes) in the order of ``code``, and their bounds."""
    starts, each = np.cumsum(sizes) - sizes, sizes[code]
    ends = np.concatenate([[0], np.cumsum(each)])
    return flat[np.repeat(starts[code] - ends[:-1], each) + np.arange(ends[-1])], ends


def _words(path: str, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of stretches around one word, one after the other, and their numbers; plain words are two units each."""
    if not len(names):
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    words = pc.ascii_trim(names.cast(pa.large_string()), " \t\n\r\x0b\x0c")
    found = pc.extract_regex(words, _PLAIN)
    letters, marks = (pc.struct_field(found, i).cast(pa.large_string()) for i in (0, 1))
    units = pa.concat_arrays([
        pc.coalesce(pc.if_else(pc.is_valid(found), pc.utf8_lower(letters), None), words),
        pc.coalesce(pc.if_else(pc.is_valid(found), marks, None), ""),
    ]).dictionary_encode()
    packed = _remembered(_ids.setdefault(path, {}), units.dictionary.to_pylist(), lambda new: _units(path, new))
    sizes = np.array([len(p) // 4 for p in packed], np.int64)
    code = units.indices.to_numpy().astype(np.int64).reshape(2, -1).T.ravel()
    flat, ends = _gather(np.frombuffer(b"".join(packed), "<u4"), sizes, code)
    return flat, ends[2::2] - ends[:-2:2]


def _units(path: str, words: list[str]) -> list[bytes]:
    """Ids of distinct stretches; those of letters alone are encoded in one text, parted where words end."""
    out: list[bytes | None] = [None if w else b"" for w in words]
    plain = [i for i, w in enumerate(words) if w and _ONLY_LETTERS.fullmatch(w)]
    if plain:
        ids = np.asarray(_encode(path, [" ".join([words[i] for i in plain])])[0].ids, "<u4")
        ends = (4 * np.flatnonzero(_word_ends(path)[ids]) + 4).tolist()
        if len(ends) == len(plain) and ends[-1] == 4 * len(ids):
            data = ids.tobytes()
            for i, start, end in zip(plain, [0, *ends], ends, strict=False):
                out[i] = data[start:end]
    rest = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(rest, _encode(path, [words[i] for i in rest]), strict=True):
        out[i] = np.asarray(e.ids, "<u4").tobytes()
    return out


@lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray:
    vocabulary = load(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for piece, i in vocabulary.items() if piece.endswith(_WORD_END)]] = True
    return out
