"""Cutting texts into chunks at the strongest separators, with overlap."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BASE_SEPARATORS, build_separators, chunk_config, detect_titles, strip

MIN_CHARS = 50
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
FIXED_SIZE, FIXED_OVERLAP = 1000, 500


def cut_at_titles(text: str, titles: Sequence[str], size: int) -> list[str]:
    """What cut_pieces gives for separators that are whole lines between two line ends.

    Each line is looked up once. Places are then kept in order, with the least level of any stretch of them at hand, so that a piece's
    strongest title is found without reading the piece again.
    """
    level_of = {t: n for n, t in reversed(list(enumerate(titles)))}
    places, levels, at = [], [], text.find("\n")
    while at >= 0:
        end = text.find("\n", at + 1)
        if end >= 0 and (level := level_of.get(text[at : end + 1])) is not None:
            places.append(at)
            levels.append(level)
        at = end
    if not places:
        return [text]
    least = [np.array(levels)]  # of 1, 2, 4 ... places from each on
    while 2 << (len(least) - 1) <= len(places):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    own: dict[int, list[int]] = {}
    for n, level in enumerate(levels):
        own.setdefault(level, []).append(n)
    done, waiting = [], [(0, len(text), 0, len(places))]
    while waiting:
        start, stop, low, high = waiting.pop()
        if high > low and places[high - 1] + len(titles[levels[high - 1]]) > stop:
            high -= 1  # the last one may reach beyond the piece, since neighbours share a line end
        if stop - start <= size or low >= high:
            done.append(text[start:stop])
            continue
        step = (high - low).bit_length() - 1
        level = int(min(least[step][low], least[step][high - (1 << step)]))
        cuts, free = [], start
        for n in own[level][bisect_left(own[level], low) : bisect_left(own[level], high)]:
            if places[n] >= free:
                cuts.append(n)
                free = places[n] + len(titles[level])
        # the same title on the next line shares a line end with one that is cut at, and isn't cut at again
        again = [n + 1 < len(places) and levels[n + 1] == level and places[n + 1] < places[n] + len(titles[level]) for n in cuts]
        starts = [(start, low), *[(places[n], n + 1 + skip) for n, skip in zip(cuts, again, strict=True)]]
        ends = [*[(places[n], n) for n in cuts], (stop, high)]
        waiting += [(a, b, m, n) for (a, m), (b, n) in reversed(list(zip(starts, ends, strict=True))) if b > a]
    return done


def is_line(separator: str) -> bool:
    return len(separator) > 2 and separator[0] == separator[-1] == "\n" and "\n" not in separator[1:-1]


def cut_pieces(text: str, separators: Sequence[str], size: int) -> list[str]:
    """text cut at the first separator that occurs, pieces that are too long at the later ones.

    A separator stays with the piece after it. The empty separator cuts between all characters. A piece
    without any separator stays whole, however long. Titles before the other separators may be many, and take time in proportion to the text.
    """
    lines = next((n for n, x in enumerate(separators) if not is_line(x)), len(separators))
    pieces = cut_at_titles(text, separators[:lines], size) if lines and len(text) > size else [text]
    done: list[str] = []
    waiting = [(piece, lines) for piece in reversed(pieces)]
    while waiting:
        piece, level = waiting.pop()
        if len(piece) <= size:
            done.append(piece)
            continue
        while level < len(separators) and separators[level] not in piece:
            level += 1
        if level == len(separators):
            done.append(piece)
        elif not separators[level]:
            done += piece
        else:
            first, *rest = piece.split(separators[level])
            cut = [first, *[separators[level] + x for x in rest]]
            waiting += [(x, level + 1) for x in reversed(cut) if x]
    return done


def pack_pieces(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Chunks of whole pieces; each begins with the last pieces of the one before, up to overlap characters."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held)


def split_text(text: str, separators: Sequence[str], size: int, overlap: int) -> list[str]:
    return list(pack_pieces(cut_pieces(text, separators, size), size, overlap))


def chunk_documents(docs: DataFrame, preset: str = "adaptive", min_chars: int | None = None) -> DataFrame:
    """Chunks (document_id, chunk_index, chunk_text) of docs (document_id, num_pages, text).

    adaptive: size and overlap by number of pages, titles before the fixed separators, chunks stripped
    and dropped below 50 characters. fixed: 1000 and 500, default separators, stripped, empty ones
    dropped. Null and blank texts have no chunks. chunk_index counts the chunks that stay, from 0.
    """
    if preset == "adaptive":
        shape = chunk_config(F.col("num_pages"))
        ready = docs.select("document_id", "text", shape["chunk_size"].alias("size"), shape["chunk_overlap"].alias("overlap"), build_separators(detect_titles(F.col("text"))).alias("separators"))
        least = MIN_CHARS
    elif preset == "fixed":
        ready = docs.select("document_id", "text", F.lit(FIXED_SIZE).alias("size"), F.lit(FIXED_OVERLAP).alias("overlap"), F.array(*map(F.lit, DEFAULT_SEPARATORS)).alias("separators"))
        least = 1
    else:
        raise ValueError("preset is adaptive or fixed")
    least = least if min_chars is None else min_chars
    kind = ready.schema["document_id"].dataType

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, index, texts = [], [], []
                for doc_id, text, size, overlap, separators in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    kept = [x for x in (c.strip() for c in split_text(text, separators, size, overlap)) if len(x) >= max(1, least)] if text else []
                    ids += [doc_id] * len(kept)
                    index += range(len(kept))
                    texts += kept
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(index, pa.int32()), pa.array(texts, pa.string())], names=["document_id", "chunk_index", "chunk_text"])

    return ready.mapInArrow(cut, f"document_id {kind.simpleString()}, chunk_index int, chunk_text string")


def clean_chunks(chunks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """chunks with chunk_text stripped; those that are then too short go."""
    return chunks.withColumn("chunk_text", strip(F.col("chunk_text"))).where(F.length("chunk_text") >= min_chars)


__all__ = ["BASE_SEPARATORS", "chunk_documents", "clean_chunks", "cut_pieces", "pack_pieces", "split_text"]
