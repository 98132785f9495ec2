"""Token files, packing and piece codec: exact round trips and plain re-computations."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from retrieval_jobs.llm import curve_packing, pfor, piece_codec
from retrieval_jobs.llm.unit_encoder import UnitEncoder

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "one", "a  b", "x\n\ny", "End. Next, word", "tab\there", "é̀ ½ 😀", "don't stop. I'll", "word " * 30_000, "same", "same", "\n", "İstanbul ǅ ß. Σ ΑΣ.", "<|endoftext|> x"]


def documents(spark, extra=True):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "no id", 1), (5, TEXTS[5], 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(4)


@pytest.fixture(scope="module")
def encoders():
    return {p: (UnitEncoder(p, limit=50), Tokenizer.from_file(p)) for p in (BYTES, WORDS)}


ODD = st.text(alphabet=st.sampled_from([*"abX .,\n\t'1é İß́ \x1c😀", "|", "▁"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_unit_encoder_is_the_library(encoders, texts):
    for ours, library in encoders.values():
        ids, ends = ours.encode(pa.array(texts, pa.string()))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for w in want for x in w]
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


MARKED = ["end <|endoftext|> next", "<|startoftext|>one. two", "a<|endoftext|>b c", "no <|marker|> here"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_markers_are_the_library_as_it_comes(path):
    library = Tokenizer.from_file(path)
    ids, ends = UnitEncoder(path).encode(pa.array(MARKED))
    want = [library.encode(t, add_special_tokens=False).ids for t in MARKED]
    assert ids.tolist() == [x for w in want for x in w]
    assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_other_tokenizer_files_get_whole_texts(tmp_path):
    """A file that joins words across blanks: its texts aren't cut, though the words alone give other ids."""
    from tokenizers import models, pre_tokenizers

    letters = {x: k for k, x in enumerate(["a", "b", "Ġ", "aĠ", "aĠb"])}
    joining = Tokenizer(models.BPE(letters, [("a", "Ġ"), ("aĠ", "b")]))
    joining.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    joining.save(str(tmp_path / "joining.json"))
    ours = UnitEncoder(str(tmp_path / "joining.json"))
    assert not ours.by_units
    texts = ["a b", "a", "", "b a b a"]
    ids, ends = ours.encode(pa.array([*texts, None]))
    assert ids.tolist() == [4, 0, 1, 2, 4, 2, 0]
    assert ends.tolist() == [1, 2, 2, 7, 7]
    assert all(UnitEncoder(p).by_units for p in (BYTES, WORDS))


def test_queries_give_markers_their_ids(spark, tmp_path):
    import corpus_pipeline
    from retrieval_jobs.llm import queries

    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bytes_library, words_library = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op1_packed_token_ids(spark, str(tmp_path)).collect()}
    full = {k: np.array([*bytes_library.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in enumerate(MARKED)}
    assert got == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in full.items()}
    want = {k: len(words_library.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(MARKED)}
    assert {r.doc_id: r.doc_tokens for r in queries.op3_curve_packing(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=900), st.sampled_from([0.1, 0.5, 0.9, 1.0]))
def test_packed_ids_round_trip(ids, percentile):
    data = pfor.pack(np.array(ids, np.uint32), percentile)
    assert pfor.unpack(data).tolist() == ids
    if len(ids) > pfor.BLOCK:
        assert pfor.unpack(data, np.array([1])).tolist() == ids[pfor.BLOCK : 2 * pfor.BLOCK]


def test_token_files(spark):
    docs = documents(spark)
    got = pfor.read_ids(pfor.write_ids(docs, BYTES, end_id=0, segment_ids=100)).orderBy("start").collect()
    library = Tokenizer.from_file(BYTES)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = docs.where("doc_id < 0")
    assert pfor.read_ids(pfor.write_ids(empty, BYTES, 0)).count() == 0


def test_many_rows_of_one_id(spark):
    docs = spark.createDataFrame([(k, f"text {n} " * (n + 1)) for k in (None, 7) for n in range(40)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    segments = pfor.write_ids(docs, BYTES, end_id=0, segment_ids=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in segments.select("part").collect()}) > 2  # not all in one task
    got = pfor.read_ids(segments).orderBy("start").collect()
    library = Tokenizer.from_file(BYTES)
    sums = sorted(zlib.crc32(np.array([*library.encode(r.text).ids, 0], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r.ids_crc32 for r in got) == sums
    assert [r.doc_id for r in got] == [None] * 40 + [7] * 40
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_packed_rows_of_one_id(spark):
    """Rows of equal id and text are packed one by one: every id of each lies in exactly one piece."""
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in [(5, "one two three"), (5, "one two three"), (5, "other"), (None, "no id"), (None, "no id"), (6, None)]], "doc_id long, text string, curve_key string, start int").repartition(3)
    rows = curve_packing.pack_along_curve(docs, WORDS, end_id=2, sequence_tokens=4).collect()
    library = Tokenizer.from_file(WORDS)
    lengths = {}
    for r in docs.collect():
        own = lengths.setdefault(r.doc_id, [])
        own.append(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1)
    for doc_id, own in lengths.items():
        mine = [r for r in rows if r.doc_id == doc_id]
        assert sum(r.length for r in mine) == sum(own)
        assert sum(r.start == 0 for r in mine) == len(own)
        assert {r.doc_tokens for r in mine} == set(own)


def test_curve_packing(spark):
    docs = documents(spark).where("doc_id is null or doc_id <> 5").unionByName(documents(spark).where("doc_id = 5").limit(1))
    rows = curve_packing.pack_along_curve(docs, WORDS, end_id=2, sequence_tokens=64).collect()
    library = Tokenizer.from_file(WORDS)
    full = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(pieces) == set(full)
    for doc_id, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(full[doc_id]) == own[0].doc_tokens
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_length
        assert at == 64 or at & (at - 1) == 0
    assert curve_packing.pack_along_curve(docs.where("doc_id < 0"), WORDS, 2).count() == 0


def test_pieces_lie_in_the_order_of_the_curve(spark):
    random.seed(4)
    words = ["red", "blue", "tea", "sky", "oak", "uno", "dos", "tres", "sol", "mar"]
    texts = [" ".join(random.choices(random.sample(words, 3), k=random.randrange(5, 60))) for _ in range(200)]
    texts += texts[:20] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = curve_packing.pack_along_curve(docs, WORDS, end_id=2, sequence_tokens=64).collect()
    keys = curve_packing.hilbert_keys(curve_packing.document_points([x or "" for x in texts])).tolist()
    order = [(keys[r.doc_id], r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    assert [x[1] for x in order] != sorted(x[1] for x in order)


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_goes_step_by_step(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = curve_packing.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_neighbours():
    random.seed(1)
    base = [" ".join(random.choices(["red", "blue", "tea", "sky", "oak"], k=200)), " ".join(random.choices(["uno", "dos", "tres", "sol", "mar"], k=200))]
    keys = curve_packing.hilbert_keys(curve_packing.document_points([base[0], base[1], base[0] + " x", base[1] + " x"]))
    assert abs(keys[0] - keys[2]) < abs(keys[0] - keys[1])
    assert abs(keys[1] - keys[3]) < abs(keys[0] - keys[1])


def test_piece_codec(spark):
    docs = documents(spark)
    rows = piece_codec.verified_pieces(docs, PIECES).collect()
    assert len(rows) == docs.count()
    assert all(r.parity and r.round_trip for r in rows)
    assert piece_codec.verified_pieces(docs.where("doc_id < 0"), PIECES).count() == 0
    encoded = piece_codec.encode_pieces(docs, PIECES)
    with open(PIECES, "rb") as f:
        reference = piece_codec.reference_processor(f.read())
    want = sorted(((r.doc_id, reference.encode(r.text or "")) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    sums = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want), key=str)
    assert sorted(((r.doc_id, r.n_pieces, r.ids_crc32) for r in rows), key=str) == sums
    back = sorted(((r.doc_id, r.text) for r in piece_codec.decode_pieces(encoded, PIECES).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def test_piece_parity_is_of_whole_texts(spark, monkeypatch):
    """A model with a piece that spans a blank, taken word by word all the same: parity says so, for those texts only."""
    data = unigram_model([("▁a▁b", -0.1, 1)], drop_extra_blanks=False)
    reference = piece_codec.reference_processor(data)
    texts = ["a b", "ab ba", "b a b", "a", "", "b a"]
    right = piece_codec.PieceEncoder(data)
    assert piece_codec.same_ids(right.encode(pa.array(texts)), reference.encode(texts)).all()
    monkeypatch.setattr(piece_codec, "words_end_pieces", lambda model: True)
    wrong = piece_codec.PieceEncoder(data)
    assert wrong.by_word
    same = piece_codec.same_ids(wrong.encode(pa.array(texts)), reference.encode(texts))
    assert same.tolist() == [False, True, False, True, True, True]


def test_same_ids():
    ours = pa.array([[1, 2], [], [3], [4, 5, 6]], pa.list_(pa.int32()))
    assert piece_codec.same_ids(ours, [[1, 2], [], [3], [4, 5, 6]]).tolist() == [True] * 4
    assert piece_codec.same_ids(ours, [[1, 2], [], [9], [4, 7, 8]]).tolist() == [True, True, False, False]
    assert piece_codec.same_ids(ours, [[1], [2], [3], [4, 5, 6]]).tolist() == [False, False, True, True]


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_round_trip_is_what_the_library_decodes(texts):
    with open(PIECES, "rb") as f:
        encoder = piece_codec.piece_encoder(f.read())
    ids = encoder.encode(pa.array(texts))
    back = encoder.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False)
    assert encoder.gives_back(pa.array(texts), ids).tolist() == [a == b for a, b in zip(back, texts, strict=True)]
    other = pa.array([t + "x" for t in texts])
    assert not encoder.gives_back(other, ids).any()


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_piece_parity(text):
    with open(PIECES, "rb") as f:
        data = f.read()
    want = piece_codec.reference_processor(data).encode(text)
    assert piece_codec.piece_tokenizer(data).encode(text, add_special_tokens=False).ids == want
    first, second = piece_codec.piece_encoder(data).encode(pa.array([text, "x " + text])).to_pylist()
    assert first == want
    assert second == piece_codec.reference_processor(data).encode("x " + text)


def unigram_model(more=(), drop_extra_blanks=True, byte_fallback=False) -> bytes:
    """A small unigram model in the file format, written out by hand."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("▁a", -2.5, 1), ("ab", -2.9, 1), ("▁ab", -4.0, 1), ("ba", -2.2, 1), *more]
    trainer = bytes([3 << 3, 1]) + (bytes([35 << 3 & 127 | 128, 35 >> 4, 1]) if byte_fallback else b"")
    normalizer = bytes([3 << 3, 1, 4 << 3, int(drop_extra_blanks), 5 << 3, 1])
    if byte_fallback:
        names += [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    return b"".join(piece(*x) for x in names) + field(2, trainer) + field(3, normalizer)


@pytest.mark.parametrize("text", ["", "a", "ab ba", "  abab  b a ", "aab bba", "abz"])
def test_unigram_parity(text):
    data = unigram_model()
    assert piece_codec.parse_model(data).kind == piece_codec.UNIGRAM
    want = piece_codec.reference_processor(data).encode(text)
    assert piece_codec.build(piece_codec.parse_model(data)).encode(text, add_special_tokens=False).ids == want
    assert piece_codec.PieceEncoder(data, limit=2).encode(pa.array(["", text, "a"]))[1].as_py() == want


@pytest.mark.parametrize("text", ["", "ab ba", "abz é", "  中 ab", "a▁b", "😀a b😀"])
@pytest.mark.parametrize("drop", [True, False])
def test_unigram_with_byte_fallback(text, drop):
    data = unigram_model(drop_extra_blanks=drop, byte_fallback=True)
    assert piece_codec.parse_model(data).byte_fallback
    want = piece_codec.reference_processor(data).encode(text)
    encoder = piece_codec.PieceEncoder(data)
    assert encoder.encode(pa.array([text, "b " + text])).to_pylist() == [want, piece_codec.reference_processor(data).encode("b " + text)]
