"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library.

A slice of texts is cut into units with numpy at places where the tokenizer's own splitting rule always
cuts. Arrow numbers the distinct units of the slice, each of them is encoded by the library once per
worker, and one gather gives the ids of all texts, exactly as if the library had encoded
each text in one piece. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from faretide.llm.words import column_bytes

# Texts of about this many bytes are encoded at a time.
SLICE_BYTES = 8 << 20
# Units a worker remembers, and bytes of them; beyond that only those of the slice at hand are kept.
UNITS = 1 << 20
UNIT_BYTES = 64 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Marks that never join the run of letters before them.
_MARK = np.zeros(256, bool)
_MARK[list(b".,:;!?*&%$#|")] = True
# White space of two and three bytes.
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_CODES = np.array(sorted(int.from_bytes(c.encode(), "big") for c in _WIDE))
_WIDE_LEADS = np.zeros(256, bool)
_WIDE_LEADS[[c.encode()[0] for c in _WIDE]] = True
# Lead bytes from here on may compose with the letter before them.
_COMPOSING = 0xCC
# Letters below this are composed already, and each has one lower-case form of its own.
_COMPOSED = chr(0x250)
_DOTTED = chr(0x130)
_NO_LETTERS = [int.from_bytes(c.encode(), "big") for c in (chr(0xD7), chr(0xF7), _DOTTED)]
# Units that are encoded in one call.
_JOINED = 4096


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show a byte as its own character if that is visible, others from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


_BYTE_LETTERS = _byte_letters()


def _begins(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places, and places after the last, of the runs of ``inside``; a run ends with its text."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def _after_letters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a mark follows the letters that a run starts with."""
    letter = _LETTER[data]
    # Composed letters of two bytes, but for what is no letter or does not stay one in lower case.
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _NO_LETTERS)]
    letter[lead] = letter[lead + 1] = True
    other = np.append(np.flatnonzero(~letter), len(data))
    at = other[np.searchsorted(other, begin)]
    at = at[(at > begin) & (at < end)]
    return at[_MARK[data[at]]]


def _byte_level(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A single blank goes with the word after it; white space before that is a unit, its last character another."""
    space = _SPACE[data]
    lead = np.flatnonzero(_WIDE_LEADS[data])
    padded = np.append(data, np.zeros(2, np.uint8)).astype(np.int64)
    two = padded[lead] << 8 | padded[lead + 1]
    three = two << 8 | padded[lead + 2]
    for codes, width in ((two, 2), (three, 3)):
        found = lead[np.isin(codes, _WIDE_CODES)]
        for k in range(width):
            space[found + k] = True
    begin, end = _begins(~space, offsets)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[end] = True
    cut[_after_letters(data, begin, end)] = True
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    led = begin[~first[begin]]
    blank = data[led - 1] == 0x20
    cut[led[blank] - 1] = True
    led = led[~blank]
    cut[led] = True
    low = data[led - 1]
    cut[led - np.where(low < 0x80, 1, np.where(data[led - 2] == 0xC2, 2, 3))] = True
    return data, np.flatnonzero(cut), offsets


def _spaceless(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, without the white space between them; ASCII letters in lower case unless they may be composed."""
    inside = ~_SPACE[data]
    begin, end = _begins(inside, offsets)
    at = np.concatenate([offsets, begin, _after_letters(data, begin, end)])
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=place[1:])
    upper = np.flatnonzero((data >= 65) & (data <= 90))
    following = np.append(data, np.uint8(0))[upper + 1]
    data = data.copy()
    data[upper[following < _COMPOSING]] += 32
    cut = np.zeros(place[-1] + 1, bool)
    cut[place[at]] = True
    return data[inside], np.flatnonzero(cut), place[offsets]


def _rule(spec: dict):
    """How texts are cut; None: not at all."""
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return None if normal else _byte_level
    if before.get("type") == "Sequence":
        lowers = any(p.get("type") == "Lowercase" for p in (normal or {}).get("normalizers", []))
        parts = before.get("pretokenizers", [])
        drops = [p for p in parts if p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")]
        splits = [p for p in drops if r"[^\s\p{L}\p{N}]+" in p.get("pattern", {}).get("Regex", "")]
        return _spaceless if splits and lowers else None
    return None


class Encoder:
    """Arrow texts -> their ids in one array of unsigned 32-bit integers, and the bounds of each text's ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self._cut = _rule(json.load(f))
        # The model alone: all that is left to do for a unit of letters.
        self._bare = Tokenizer(self._tokenizer.model)
        # Units are told apart by a line feed, which is an id of its own.
        self._bare.pre_tokenizer = Split(_BYTE_LETTERS[0x0A], "isolated")
        self._forget()

    @property
    def size(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def _forget(self) -> None:
        # Units known, as bytes in one Arrow array: a Python object for each would take some hundred bytes.
        self._known = pa.array([], pa.binary())
        self._ids, self._starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, unit: str) -> str | None:
        """A unit of nothing but letters, ready for the model; None for any other."""
        if not unit.removeprefix(" ").isalpha():
            return None
        if not unit.isascii() and (max(unit) >= _COMPOSED or _DOTTED in unit):
            return None
        if self._cut is _spaceless:
            unit = unit.lower()
        if unit.isascii():
            return unit.replace(" ", _BYTE_LETTERS[0x20])
        return unit.encode().decode("latin-1").translate(_BYTE_LETTERS)

    def _by_model(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and how many each has."""
        ids, sizes, line_feed = [], [], _BYTE_LETTERS[0x0A]
        for a in range(0, len(units), _JOINED):
            part = units[a : a + _JOINED]
            found = self._encode(self._bare, [line_feed + line_feed.join(part)])[0]
            found = np.array(found, np.uint32)
            between = found == found[0]
            ids.append(found[~between])
            sizes.append(np.diff(np.append(np.flatnonzero(between), len(found))) - 1)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _learn(self, units: pa.Array) -> None:
        """Add units that are not known yet. They become Python objects a block at a time."""
        all_ids, all_sizes = [self._ids], []
        for a in range(0, len(units), _JOINED):
            texts = [u.decode() for u in units.slice(a, _JOINED).to_pylist()]
            letters = [self._letters(t) for t in texts]
            plain = np.array([x is not None for x in letters], bool)
            quick, n = self._by_model([x for x in letters if x is not None])
            lists = self._encode(self._tokenizer, [t for t, x in zip(texts, letters) if x is None])
            sizes = np.zeros(len(texts), np.int64)
            sizes[plain] = n
            sizes[~plain] = np.fromiter(map(len, lists), np.int64, len(lists))
            of_model = np.repeat(plain, sizes)
            ids = np.zeros(len(of_model), np.uint32)
            ids[of_model] = quick
            ids[~of_model] = np.fromiter(chain.from_iterable(lists), np.uint32, len(ids) - len(quick))
            all_ids.append(ids)
            all_sizes.append(sizes)
        self._known = pa.concat_arrays([self._known, units])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(np.concatenate(all_sizes))])
        self._ids = np.concatenate(all_ids)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The number of each of these distinct units; those not known are learnt."""
        found = pc.fill_null(pc.index_in(units, value_set=self._known), -1).to_numpy().astype(np.int64)
        fresh = units.filter(pa.array(found < 0))
        size = sum(int(pc.sum(pc.binary_length(x)).as_py() or 0) for x in (self._known, fresh))
        if len(self._known) + len(fresh) > UNITS or size > UNIT_BYTES:
            self._forget()
            fresh, found = units, np.full(len(units), -1)
        if len(fresh):
            found[found < 0] = len(self._known) + np.arange(len(fresh))
            self._learn(fresh)
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._cut is None:
            lists = self._encode(self._tokenizer, [t or "" for t in texts.to_pylist()])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(bounds[-1])), bounds
        data, cuts, offsets = self._cut(*column_bytes(texts))
        places, held = pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))
        units = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, places, held]).dictionary_encode()
        number = self._numbers(units.dictionary)[units.indices.to_numpy()]
        sizes = self._starts[number + 1] - self._starts[number]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(self._starts[number] - ends + sizes, sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        return ids, bounds[np.searchsorted(cuts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids and bounds with ``end_id`` after each text."""
    bounds = bounds + np.arange(len(bounds))
    out = np.full(bounds[-1], end_id, np.uint32)
    kept = np.ones(len(out), bool)
    kept[bounds[1:] - 1] = False
    out[kept] = ids
    return out, bounds


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for consecutive runs of rows of about ``most`` bytes; null is empty."""
    if not len(texts):
        return
    _, offsets = column_bytes(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, texts.slice(a, b - a)
        a = b
