"""SentencePiece models run by the tokenizers library: read the model file, rebuild it, encode, decode, verify."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import THREADS, sized_slices, slices, strings, tokenizers_library

MARK = "▁"  # stands for a blank
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
GROUP = 512  # words that go to the library as one text


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"not a model file: field of kind {kind}")


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_blanks: bool = True
    escape_blanks: bool = True


def parse_model(data: bytes) -> PieceModel:
    """Pieces with scores and types, and what the trainer and normaliser messages say."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.drop_extra_blanks = bool(v)
                elif n == 5:
                    model.escape_blanks = bool(v)
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """The pairs that make each piece, best-scored piece first."""
    ids = {piece: k for k, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    out = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            out += [(-score, ids[a], ids[b], a, b) for a, b in pairs]
    return [(a, b) for _, _, _, a, b in sorted(out)]


def words_end_pieces(model: PieceModel) -> bool:
    """Does no piece go on past a word's end? Then words can be encoded one by one."""
    return not any(MARK in piece.lstrip(MARK) for piece, _, kind in model.pieces if kind in (NORMAL, USER))


def build(model: PieceModel):
    """A tokenizers.Tokenizer that gives the model's ids."""
    library = tokenizers_library()
    Regex, Tokenizer, decoders, models = library.Regex, library.Tokenizer, library.decoders, library.models
    normalizers, pre_tokenizers = library.normalizers, library.pre_tokenizers
    names = [piece for piece, _, _ in model.pieces]
    unknown = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        inner = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        inner = models.BPE(dict(zip(names, range(len(names)), strict=True)), _merges(model), unk_token=None if unknown is None else names[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(inner)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.drop_extra_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_end_pieces(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


class PieceEncoder:
    """Ids of whole texts; where the model takes a text word by word, each distinct word is encoded once.

    Words are what single blanks part. Texts that begin or end with a blank, have several in a row or
    hold the mark itself go to the library whole, as do all texts of models that change white space. New words go
    there many together, parted by blanks, and their ids fall apart where a piece begins with the mark.
    At ``limit`` words the store is emptied, so memory stays bounded.
    """

    def __init__(self, data: bytes, limit: int = 800_000):
        self.model = parse_model(data)
        self.tokenizer = build(self.model)
        model = self.model
        self.by_word = words_end_pieces(model) and model.dummy_prefix and model.escape_blanks and not (model.charsmap or model.drop_extra_blanks)
        self.begins = np.array([piece.startswith(MARK) for piece, _, _ in model.pieces], bool)
        self.surfaces = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces], pa.binary())
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.lists = pa.array([], pa.list_(pa.int32()))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each of a column of texts; a null text is empty and has none."""
        texts = texts.cast(pa.string()).fill_null("")
        if len(self.codes) > self.limit:
            self._clear()
        whole = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}") if self.by_word else pa.array([True] * len(texts), pa.bool_())
        plain = texts.filter(pc.invert(whole))
        found = pa.array([], pa.list_(pa.int32()))
        if len(plain):
            words = pc.split_pattern(plain, " ")
            counted = words.flatten().dictionary_encode()
            codes = self._codes_of(counted.dictionary)[counted.indices.to_numpy()]
            lists = self.lists.take(pa.array(codes))
            found = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[words.offsets.to_numpy()]), lists.values)
        if not pc.any(whole).as_py():
            return found
        place = np.argsort(whole.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        rest = pa.array(self._library(texts.filter(whole).to_pylist()), pa.list_(pa.int32()))
        return pa.concat_arrays([found, rest]).take(pa.array(back))

    def _codes_of(self, words: pa.StringArray) -> np.ndarray:
        """The place in the store of each of some different words."""
        names = strings(words)
        out = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = np.arange(len(self.codes), len(self.codes) + len(new))
            fresh = [names[k] for k in new.tolist()]
            self.codes.update(zip(fresh, out[new].tolist(), strict=True))
            self.lists = pa.concat_arrays([self.lists, self._learn(fresh)])
        return out

    def _learn(self, words: list[str]) -> pa.ListArray:
        groups = self._library([" ".join(words[k : k + GROUP]) for k in range(0, len(words), GROUP)])
        ids = np.fromiter(chain.from_iterable(groups), np.int32)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):  # not known to happen
            return pa.array(self._library(words), pa.list_(pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids))

    def gives_back(self, texts: pa.Array, ids: pa.ListArray) -> np.ndarray:
        """Is each text what its ids stand for? The bytes of all their pieces are set beside the text's, with the blank before it."""
        want = texts.cast(pa.string()).fill_null("")
        if self.model.dummy_prefix:
            want = pc.if_else(pc.equal(want, ""), "", pc.binary_join_element_wise(" ", want, ""))
        pieces = self.surfaces.take(ids.values)
        ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)
        at = ids.offsets.to_numpy()
        got = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.array(ends[at]).buffers()[1], pieces.buffers()[2]])
        return pc.equal(got, want.cast(pa.binary())).to_numpy(zero_copy_only=False)


def same_ids(ids: pa.ListArray, wanted: list[list[int]]) -> np.ndarray:
    """Are the ids of each text those wanted?"""
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    lengths = np.fromiter(map(len, wanted), np.int64, len(wanted))
    same = np.diff(at) == lengths
    if same.all():
        wrong = np.flatnonzero(flat[at[0] : at[-1]] != np.fromiter(chain.from_iterable(wanted), np.int32, int(lengths.sum())))
        same[np.searchsorted(at[1:] - at[0], wrong, "right")] = False
    else:
        same = np.array([flat[a:b].tolist() == x for a, b, x in zip(at[:-1], at[1:], wanted, strict=True)], bool)
    return same


@lru_cache(maxsize=2)
def piece_encoder(data: bytes) -> PieceEncoder:
    """One for each Python worker."""
    return PieceEncoder(data)


def piece_tokenizer(data: bytes):
    return piece_encoder(data).tokenizer


@lru_cache(maxsize=2)
def reference_processor(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and ids, array<int>; a null text counts as empty and has none.

    The driver reads the model file, and tasks get its bytes.
    """
    with open(model_file, "rb") as f:
        data = f.read()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(data)
        for batch in sized_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(batch.column(1))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id and text; null ids count as none."""
    with open(model_file, "rb") as f:
        data = f.read()

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(data)
        for batch in slices(batches, 256):
            texts = tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decode, "doc_id long, text string")


def verified_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_pieces, ids_crc32, parity, round_trip.

    parity says whether the model's own library gives the same ids for the whole text; round_trip says
    whether the pieces of all the text's ids give it back. Both are worked out for every row, repeated ones too. ids_crc32 is
    of the ids as little-endian unsigned 32-bit numbers. A null text counts as empty, has no pieces and
    agrees with itself; rows of null doc_id are kept. An empty table gives no rows.
    """
    with open(model_file, "rb") as f:
        data = f.read()

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, reference = piece_encoder(data), reference_processor(data)
        for batch in sized_slices(batches, 1, 2 << 20):
            texts = batch.column(1)
            ids = encoder.encode(texts)
            parity = same_ids(ids, reference.encode(texts.fill_null("").to_pylist(), num_threads=THREADS))
            at, flat = ids.offsets.to_numpy().tolist(), ids.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64()), pa.array(parity), pa.array(encoder.gives_back(texts, ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "ids_crc32", "parity", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(check, "doc_id long, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean")
