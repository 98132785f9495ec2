"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per Python worker."""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings, tokenizers_library

#: White space of which several characters could form one token, at an end or in a row, or that isn't a blank or a line end.
IRREGULAR = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The splitting pattern of a public tokenizer file under which no token spans a blank.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A Latin word, of letters that no normaliser takes apart, and the sign that ends it.
SIGNED = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[.,]$"

FENCE = " |"  # a word of its own that parts words which are encoded together
FENCED = 256
LIBRARY_CHARS = 1 << 18
FIRST = "\n\n"  # before the units at a text's start; no other unit has two line ends


def ends_at_blanks(settings: dict) -> bool:
    """Do these settings of a tokenizer file split texts at blanks and line ends before anything is merged?

    Two forms are known to: byte-level splitting without normaliser, where a blank goes with the word after
    it, and a pattern that leaves white space out, with normalisers that don't look past a blank.
    """

    def steps(name: str, inner: str) -> list[dict]:
        step = settings.get(name)
        return [] if not step else step[inner] if step["type"] == "Sequence" else [step]

    splits, normal = steps("pre_tokenizer", "pretokenizers"), steps("normalizer", "normalizers")
    model = settings.get("model", {})
    if not splits or model.get("type") != "BPE" or model.get("dropout"):
        return False
    first, later = splits[0], splits[1:]
    if first["type"] == "ByteLevel":
        return first.get("use_regex", True) and not first.get("add_prefix_space", True) and not normal and not later
    known = {"NFC", "Lowercase"}
    plain = all(x["type"] in known or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in normal)
    return plain and first["type"] == "Split" and first["pattern"] == {"Regex": WORD_PATTERN} and first["invert"] and all(x["type"] == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space", True) for x in later)


class UnitEncoder:
    """Token ids of whole texts: the ids of a text are those of its units, and units recur.

    A unit is a word with the blank or line end before it. Where the tokenizer file splits texts there
    before it merges (``ends_at_blanks``), the ids of the units are those of the whole text. Units seen
    before are looked up; the others go to the library together. A word of letters and its closing ``.`` or
    ``,`` are encoded apart. Texts with other or repeated white space go to the library whole, and so do
    all texts if the file splits in another way. At ``limit`` units the store is emptied, so memory stays bounded.

    An added token that a text holds literally gets its own id, as the library does unless told otherwise,
    and such a text goes there whole; without ``markers`` it is encoded as plain characters.
    """

    def __init__(self, path: str, limit: int = 800_000, markers: bool = True):
        self.tokenizer = tokenizers_library().Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not markers
        settings = json.loads(self.tokenizer.to_str())
        self.by_units = ends_at_blanks(settings)
        self.lower = self.by_units and "Lowercase" in json.dumps(settings.get("normalizer"))
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if markers else []
        fence = self.tokenizer.encode(FENCE, add_special_tokens=False).ids
        self.fence = fence[0] if len(fence) == 1 else None
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.lists = pa.array([], pa.list_(pa.uint32()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts one after another, and for each text the end of its ids; a null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        lowered = pc.ascii_lower(texts) if self.lower else texts  # fewer units; the file does it anyway
        whole = pc.match_substring_regex(texts, IRREGULAR) if self.by_units else pa.array([True] * len(texts), pa.bool_())
        for marker in self.markers:
            whole = pc.or_(whole, pc.or_(pc.match_substring(texts, marker), pc.match_substring(lowered, marker)))
        lists = self._by_units(lowered.filter(pc.invert(whole)))
        if pc.any(whole).as_py():
            lists = pa.concat_arrays([lists, self._library(texts.filter(whole).to_pylist())])
            place = np.argsort(whole.to_numpy(zero_copy_only=False), kind="stable")
            back = np.empty(len(place), np.int64)
            back[place] = np.arange(len(place))
            lists = lists.take(pa.array(back))
        return lists.values.to_numpy(), lists.offsets.to_numpy()[1:].astype(np.int64)

    def _by_units(self, texts: pa.Array) -> pa.ListArray:
        """Ids of regular texts."""
        if not len(texts):
            return pa.array([], pa.list_(pa.uint32()))
        if len(self.codes) > self.limit:
            self._clear()
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets, flat = words.offsets.to_numpy(), words.flatten()
        counted = flat.dictionary_encode()
        codes = self._codes_of(counted.dictionary)[counted.indices.to_numpy()]
        first = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        codes[offsets[:-1]] = self._codes_of(pc.binary_join_element_wise(FIRST, first.dictionary, ""))[first.indices.to_numpy()]
        return _joined(self.lists.take(pa.array(codes)), offsets)

    def _codes_of(self, units: pa.StringArray) -> np.ndarray:
        """The place in the store of each of some different units."""
        names = strings(units)
        out = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = units.take(pa.array(new))
            self._learn(fresh)
            out[new] = np.fromiter(map(self.codes.__getitem__, strings(fresh)), np.int32, len(new))
        return out

    def _learn(self, new: pa.StringArray) -> None:
        """Encodes units that are new; signed words from the ids of their word and those of the sign."""
        signed = pc.match_substring_regex(new, SIGNED)
        cut = new.filter(signed)
        words = strings(pc.utf8_slice_codeunits(cut, 0, -1))
        signs = strings(pc.binary_join_element_wise(FIRST, pc.utf8_slice_codeunits(cut, -1), ""))
        parts = dict.fromkeys(chain(strings(new.filter(pc.invert(signed))), words, signs))
        for known in [u for u in chain(words, signs) if u in self.codes]:
            parts.pop(known, None)
        self._keep(parts := list(parts), self._together(parts))
        if len(cut):
            both = np.stack([np.fromiter(map(self.codes.__getitem__, x), np.int32, len(x)) for x in (words, signs)], axis=1)
            self._keep(strings(cut), _joined(self.lists.take(pa.array(both.ravel())), np.arange(0, 2 * len(cut) + 1, 2)))

    def _keep(self, units: list[str], lists: pa.ListArray) -> None:
        self.codes.update(zip(units, range(len(self.codes), len(self.codes) + len(units)), strict=True))
        self.lists = pa.concat_arrays([self.lists, lists])

    def _library(self, texts: list[str]) -> pa.ListArray:
        """Ids of texts by the library, which takes some hundred bytes for each id meanwhile, so a few texts at a time."""
        ends = np.cumsum([len(t) for t in texts]) // LIBRARY_CHARS
        edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        parts = [_lists([x.ids for x in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    def _together(self, units: list[str]) -> pa.ListArray:
        """Ids of each unit. Those that begin with a blank or line end are encoded in groups, with a fence after each.

        The fence is a word of one id that no unit without its sign has, so the ids of a group fall apart
        again. Units with the sign, and those at a text's start, are encoded alone.
        """
        alone = np.array([self.fence is None or FENCE[1] in u or u.startswith(FIRST) for u in units], bool)
        texts = np.array([u if u[:1] == "\n" else " " + u for u in units], object)
        fenced = texts[~alone]
        groups = ["".join(t + FENCE for t in fenced[k : k + FENCED]) for k in range(0, len(fenced), FENCED)]
        ids = self._library(groups).values.to_numpy()
        ends = np.flatnonzero(ids == self.fence) if groups else np.zeros(0, np.int64)
        if len(ends) != len(fenced):  # not known to happen
            alone[:], ids, ends = True, ids[:0], ends[:0]
        lengths = np.diff(ends, prepend=-1) - 1
        own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids[ids != self.fence] if len(ends) else ids[:0]))
        rest = self._library([t.removeprefix(FIRST) for t in texts[alone]])
        order = np.empty(len(texts), np.int64)
        order[np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])] = np.arange(len(texts))
        return pa.concat_arrays([own, rest]).take(pa.array(order))


def _lists(lists: list[list[int]]) -> pa.ListArray:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))


def _joined(lists: pa.ListArray, cuts: np.ndarray) -> pa.ListArray:
    """One list for each run of lists between two cuts."""
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[cuts]), lists.values)


@lru_cache(maxsize=2)
def unit_encoder(path: str, markers: bool = True) -> UnitEncoder:
    """One for each Python worker, which Spark uses for many tasks."""
    return UnitEncoder(path, markers=markers)
