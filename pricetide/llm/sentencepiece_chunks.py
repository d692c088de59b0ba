"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pricetide.llm.common import SLICE_BYTES, slices, with_result

MARK = "▁"
#: A marked word: a run of markers and what follows up to the next marker.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct chunks that a task's table holds before it starts anew.
TABLE_ROWS = 200_000

RESULT = T.StructType(
    [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
)


class CrossingPieces(ValueError):
    """The model has pieces that cross a marker, so words can't be segmented one by one."""


_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, read and examined once in each Python worker."""
    if path not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise CrossingPieces(path)
        # The library puts one marker before every text, so a chunk is given without its first.
        if not model.encode("a", out_type=str)[0].startswith(MARK):
            raise CrossingPieces(f"{path} adds no marker before a text")
        _models[path] = model
    return _models[path]


class ChunkTable:
    """Ids and decoded bytes of distinct chunks, each segmented once by the library."""

    def __init__(self, model: str) -> None:
        self.model = _model(model)
        self.mark_id = self.model.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.decoded: list[bytes] = []

    def add(self, chunks: list[str]) -> None:
        """Segment chunks that the table lacks; they take the next numbers."""
        segmented = self.model.encode([c[1:] for c in chunks], num_threads=1)
        for at, chunk in enumerate(chunks):
            if chunk == MARK:
                segmented[at] = [self.mark_id]
        decoded = self.model.decode(segmented)
        lengths = np.fromiter(map(len, segmented), np.int64, len(segmented))
        flat = np.fromiter((i for ids in segmented for i in ids), np.int32, int(lengths.sum()))
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        # Decoding drops the first marker, which here is the blank before the word.
        self.decoded += [b" " + text.encode() for text in decoded]

    def segment(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in a row, len + 1 offsets by text, and the decoded texts."""
        if len(self.numbers) > TABLE_ROWS:
            self.clear()
        numbers, known = self.numbers, len(self.numbers)
        order: list[int] = []
        ends = []
        for text in texts:
            if text:
                marked = MARK + text.replace(" ", MARK)
                order += [numbers.setdefault(c, len(numbers)) for c in CHUNK.findall(marked)]
            ends.append(len(order))
        if len(numbers) > known:
            self.add(list(numbers)[known:] if known else list(numbers))
        at = np.array(order, np.int64)
        lengths = self.lengths[at]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        # The position of each id in the table: its chunk's start and its place in the chunk.
        ids = self.ids[np.repeat(self.starts[at] - (after - lengths), lengths) + np.arange(total)]
        offsets = np.concatenate([[0], np.concatenate([[0], after])[ends]]).astype(np.int64)
        table = self.decoded
        decoded, first = [], 0
        for end in ends:
            decoded.append(b"".join([table[i] for i in order[first:end]])[1:].decode())
            first = end
        return ids, offsets, decoded


def encode_and_decode(
    docs: DataFrame, model: str, text: str = "text", result: str = "pieces"
) -> DataFrame:
    """`docs` with a struct column of ids and the text decoded from them.

    Ids are those of the library's encode() of the whole text with the model at the path
    `model` (no begin or end ids, no sampling), the decoded text is its decode() of them. Since
    no piece of the model crosses from a word to the next marker (a model where one does is
    refused), a text's ids are those of its marked words one after another. Each task keeps a
    table of distinct marked words, segments each once and joins ids back by position; the
    table starts anew at `TABLE_ROWS` words, which bounds memory and changes no result.

    Null and empty texts have no ids and decode to the empty text. A text of one endless word
    is one chunk. Other columns pass through, except that one called `result` is replaced.
    """

    def make():  # noqa: ANN202
        chunks = ChunkTable(model)

        def parts(batch: pa.RecordBatch) -> Iterator[pa.Array]:
            for part in slices(batch, text, SLICE_BYTES):
                ids, offsets, decoded = chunks.segment(part.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])

        def compute(batch: pa.RecordBatch) -> pa.Array:
            done = list(parts(batch))
            return pa.concat_arrays(done) if done else pa.array([], ARROW_RESULT)

        return compute

    return with_result(docs, result, RESULT, make)


ARROW_RESULT = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
