"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so a text can be cut before each run of
markers and its chunks segmented one by one. Each task keeps a table of the chunks it has met, has the library
segment each of them once, and joins ids, their decimal form and the decoded text back by position. The table is
emptied when it holds `table_size` chunks, which bounds memory and changes no result. There is no shuffle, so no hot
word or source; texts are taken whole.

Cases: null text counts as empty; an empty text has no ids, an empty id list and decodes to the empty text; repeated
rows each get their row; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
TABLE_SIZE = 300_000
DOCS_AT_ONCE = 64


def model_file(model: str) -> str:
    """A path, or the name of a public tokenizer's file, which is looked up where the task runs."""
    if os.path.sep in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class ChunkTable:
    """chunk -> (number of ids, ids joined by commas, decoded text with its leading space)."""

    def __init__(self, model: str, table_size: int = TABLE_SIZE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file(model))
        for i in range(self.sp.vocab_size()):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a white-space marker: its texts can't be cut into chunks")
        if len(self.sp.encode("a  b ")) < 3:
            raise ValueError("the model drops extra white space: its texts can't be cut into chunks")
        self.mark_id = self.sp.piece_to_id(MARK)
        self.table_size, self.table = table_size, {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.table]
        if len(self.table) + len(new) > self.table_size:
            self.table.clear()
            new = list(chunks)
        ids = self.sp.encode([c[1:] for c in new], num_threads=1)  # the library puts the first marker back
        ids = [[self.mark_id] if c == " " else x for c, x in zip(new, ids, strict=True)]
        texts = self.sp.decode(ids, num_threads=1) if ids else []
        for c, x, t in zip(new, ids, texts, strict=True):
            self.table[c] = (len(x), ",".join(map(str, x)), " " + t)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        for at in range(0, len(texts), DOCS_AT_ONCE):
            cut = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts[at : at + DOCS_AT_ONCE]]
            self.learn(set().union(*cut))
            get = self.table.__getitem__
            for chunks in cut:
                if chunks:
                    n, ids, decoded = zip(*map(get, chunks), strict=True)
                    yield sum(n), ",".join(ids), "".join(decoded)[1:]
                else:
                    yield 0, "", ""


def _batches(model: str, table_size: int, digest: bool):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            table = table or ChunkTable(model, table_size)
            texts = [t or "" for t in b.column(1).to_pylist()]
            if digest:
                rows = [(n, sha(ids), sha(t)) for n, ids, t in table.encode(texts)]
                yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                for k in range(0, len(texts), DOCS_AT_ONCE):
                    rows = list(table.encode(texts[k : k + DOCS_AT_ONCE]))
                    ids = [[int(x) for x in r[1].split(",")] if r[1] else [] for r in rows]
                    yield pa.record_batch([b.column(0).slice(k, len(rows)), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, model: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, ids (array of int) and decoded (their decoded text)."""
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_batches(model, table_size, False), "doc_id long, ids array<int>, decoded string")


def op6(docs: DataFrame, model: str, table_size: int = TABLE_SIZE) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_batches(model, table_size, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
