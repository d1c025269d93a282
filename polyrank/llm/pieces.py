"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker. No piece of a suitable model
has a marker after another character, so no merge crosses a chunk's start, and segmenting chunks apart gives
the pieces of the whole text. Each task segments a distinct chunk once and joins the ids back by position.

Merges don't cross two neighbouring characters either that no piece has next to one another, so a long chunk (base64,
writing without spaces) is cut there and its parts are segmented apart. Long parts are not kept, and the table is
bounded in bytes: a task's memory grows with the longest text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_chunks, documents

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Chunks kept in a task's table, and bytes that they may take; it starts anew when full, which changes no result.
TABLE, TABLE_BYTES = 200_000, 96 << 20
#: Characters from which a chunk is cut into parts, and from which it is segmented anew each time.
LONG = 256
#: Bytes of a kept chunk beside its texts.
ROW = 350
_CHUNK = re.compile(" +[^ ]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """ids (as decimal text and as a list) and decoded text of each distinct chunk."""

    def __init__(self, path: str, size: int = TABLE, most_bytes: int = TABLE_BYTES) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.sp, self.size, self.most_bytes = sentencepiece.SentencePieceProcessor(model_file=path), size, most_bytes
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        self.neighbours = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # the same model without a marker put before each text, for what follows in a chunk
        model = proto.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        model.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.rows: dict[str, tuple[str, int, str]] = {}
        self.bytes = 0

    def chunks(self, text: str) -> list[str]:
        """The marked text in chunks, with spaces for markers; none for an empty text."""
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def parts(self, chunk: str) -> list[str]:
        """A long chunk cut between neighbours that no piece has."""
        out, start = [], 0
        for i in range(LONG, len(chunk)):
            if i - start >= LONG and chunk[i - 1 : i + 1] not in self.neighbours and chunk[i - 1] != " ":
                out.append(chunk[start:i])
                start = i
        return [*out, chunk[start:]]

    def segmented(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)  # the library puts the first marker back, but on nothing
        ids = [i if c != " " else [self.sp.piece_to_id(MARK)] for c, i in zip(chunks, ids, strict=True)]
        return [(",".join(map(str, i)), len(i), " " + d) for i, d in zip(ids, self.sp.decode(ids) if ids else [], strict=True)]

    def segmented_long(self, chunk: str) -> tuple[str, int, str]:
        first, *more = self.parts(chunk)
        out = self.segmented([first])
        for p in more:
            i = self.inner.encode(p)
            out.append((",".join(map(str, i)), len(i), self.inner.decode(i)))
        return ",".join([r[0] for r in out]), sum([r[1] for r in out]), "".join([r[2] for r in out])

    def learn(self, chunks: Iterable[str]) -> None:
        new = [c for c in set(chunks) if c not in self.rows]
        if len(self.rows) + len(new) > self.size or self.bytes > self.most_bytes:
            self.rows.clear()
            self.bytes = 0
            new = list(set(chunks))
        for c, row in zip(new, self.segmented(new), strict=True):
            self.rows[c] = row
            self.bytes += ROW + len(row[0]) + 4 * len(c)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text: its ids joined by commas, their number, the decoded text."""
        cut = [self.chunks(t) for t in texts]
        self.learn([c for x in cut for c in x if len(c) < LONG])
        for x in cut:
            rows = [self.rows[c] if len(c) < LONG else self.segmented_long(c) for c in x]
            yield ",".join([r[0] for r in rows]), sum([r[1] for r in rows]), "".join([r[2] for r in rows])[1:]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array<int>) and decoded.

    A null text counts as empty: no ids. Other columns of docs are not read. path is a file that the executors have;
    the model's file is one of the machine's, not of the data's.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for b in byte_chunks(batches, 1, limit=1 << 20):
            texts = [x or "" for x in b.column(1).to_pylist()]
            out = list(table.encode(texts))
            columns = {"doc_id": b.column(0), "n_tokens": pa.array([n for _, n, _ in out], pa.int64()), "ids_sha256": [sha(i) for i, _, _ in out], "decoded_sha256": [sha(d) for _, _, d in out]}
            if with_ids:
                columns |= {"ids": pa.array([np.array(i.split(",") if i else [], np.int32) for i, _, _ in out], pa.list_(pa.int32())), "decoded": [d for _, _, d in out]}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir, "doc_id", "text"), model_path())
