"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the model holds a white-space marker after another character, so no piece crosses into the next marked
word. A text is therefore cut before each marker that follows another character; each distinct chunk of a task is
segmented once, and ids come back to their places by position. Nothing is shuffled: the table lives in the task.

Cases: a null text gives null ids, null count; an empty text gives no ids; several spaces in a row stay with the word
after them; a marker character inside the text counts as a space, as in the model itself, so such a text and only such
a text does not come back byte for byte (round_trip is then false). Repeated rows give equal rows; an empty table
gives an empty result; other columns are not read. Very long texts are processed whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Chunks that a task's table holds before it starts anew; it bounds memory and never changes a result.
TABLE_CHUNKS = 400_000
SLICE_ROWS = 512


def crossing(model) -> list[str]:
    """Pieces with a marker after another character. With none, chunks are independent."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in pieces if MARK in p.lstrip(MARK)]


def shipped(df: DataFrame, path: str):
    """A broadcast of the model's bytes: the path need exist on the driver only."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def load(model: str | bytes):
    """A model from its path or its bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
    if bad := crossing(model):
        raise ValueError(f"pieces cross white space, so chunks are not independent: {bad[:3]}")
    return model


class Table:
    """Distinct chunk -> ids, each segmented once."""

    def __init__(self, model):
        self.model, self.lone = model, model.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.at = array("i"), array("q", [0])

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that begin with a space. The model puts a marker before what it is given, so one space is left off."""
        return [[self.lone] if c == " " else ids for c, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1))]

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk its number of ids, and all ids in a row."""
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.place) + len(words) > TABLE_CHUNKS:
            self.clear()
        new = [w for w in words if w not in self.place]
        for w, ids in zip(new, self.segment(new)):
            self.place[w] = len(self.place)
            self.ids.extend(ids)
            self.at.append(len(self.ids))
        mine = np.fromiter((self.place[w] for w in words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        at, flat = np.array(self.at), np.array(self.ids, np.int32)
        n = at[mine + 1] - at[mine]
        to = np.concatenate([[0], np.cumsum(n)])
        return n, flat[np.repeat(at[mine] - to[:-1], n) + np.arange(to[-1])]


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts in a row, each with its leading spaces, and how many each text has. The model puts one space before a text."""
    texts = pc.replace_substring(texts, MARK, " ")
    marked = pc.binary_join_element_wise(" ", texts, "")
    if pc.any(pc.match_substring_regex(marked, "  | $")).as_py():
        lists = [re.findall(" +[^ ]*", t) for t in marked.to_pylist()]
        return pa.array([c for x in lists for c in x], pa.string()), np.array([len(x) for x in lists], np.int64)
    cut = pc.split_pattern(texts, " ")
    return pc.binary_join_element_wise(" ", cut.flatten(), ""), np.diff(cut.offsets.to_numpy())


def encode_column(texts: pa.Array, table: Table) -> pa.ListArray:
    """Ids of each text; null for null, none for an empty text."""
    full = texts.fill_null("")
    chunks, many = chunks_of(full)
    n, ids = table.of(chunks)
    at = np.concatenate([[0], np.cumsum(n)])
    sizes = np.diff(at[np.concatenate([[0], np.cumsum(many)])])
    empty = pc.equal(pc.binary_length(full), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        ids = ids[np.repeat(~empty, sizes)]
        sizes = np.where(empty, 0, sizes)
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)


class Decoder:
    """Ids -> text from a table of each piece's bytes; the marker before the text goes."""

    def __init__(self, model):
        size = model.get_piece_size()
        self.piece = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " \u2047 ".encode() if model.is_unknown(i) else p.replace(MARK, " ").encode() for i in range(size) for p in (model.id_to_piece(i),)]
        self.take = pa.array(self.piece, pa.binary())

    def column(self, ids: pa.ListArray) -> list[bytes | None]:
        flat = self.take.take(pa.array(ids.flatten()))
        body = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
        place = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1)
        off = np.concatenate([[0], np.cumsum(np.where(ids.is_null(), 0, pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)))]).astype(np.int64)
        raw = body.tobytes()
        out = []
        for i, null in enumerate(ids.is_null().to_pylist()):
            b = raw[place[off[i]] : place[off[i + 1]]]
            out.append(None if null else b[1:] if b[:1] == b" " else b)
        return out


SCHEMA = "doc_id long, ids array<int>, n_tokens int, round_trip boolean"


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        table, decoder = Table(model), Decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(1).cast(pa.string())
                ids = encode_column(texts, table)
                back = pa.array(decoder.column(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pc.list_value_length(ids).cast(pa.int32()), pc.equal(back, texts.cast(pa.binary()))], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return lean(run)


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row. round_trip says that decoding the ids gives the text again."""
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(shipped(docs, model_path)), SCHEMA)


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [None if b is None else b.decode("utf-8", "replace") for b in decoder.column(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return lean(run)


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become the replacement character."""
    return frugal(encoded).select("doc_id", "ids").mapInArrow(_decode(shipped(encoded, model_path)), "doc_id long, text string")
