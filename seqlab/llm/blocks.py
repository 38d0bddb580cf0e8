"""Documents packed into block files of the shared folder, for operators that pass over all text several times.

A block is written once and read by its place, so later passes shuffle only what they found, never the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, open_fs

BLOCK_BYTES = 8 << 20


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def write_blocks(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, extra: str | None = None) -> DataFrame:
    """Write (doc_id, text) rows; return (block, file, n_docs, n_bytes), one row per block.

    ``extra`` names a string column that goes with its row; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", (F.col(extra) if extra else F.lit("")).alias("extra"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, no = TaskContext.get().partitionId(), 0
        ids, texts, more, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal ids, texts, more, size, no
            name = f"{uuid.uuid4().hex}.block"
            known = np.array([not pd.isna(i) for i in ids], np.uint8)
            head = np.array([len(ids)], np.int64).tobytes() + known.tobytes()
            head += np.array([0 if pd.isna(i) else int(i) for i in ids], np.int64).tobytes()
            head += np.array([len(t) for t in texts], np.int64).tobytes() + np.array([len(t) for t in more], np.int64).tobytes()
            data = zstandard.ZstdCompressor(level=1).compress(head + b"".join(texts) + b"".join(more))
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            row = pd.DataFrame({"block": [(part << 24) + no], "file": [name], "n_docs": [len(ids)], "n_bytes": [size]})
            ids, texts, more, size, no = [], [], [], 0, no + 1
            return row

        for f in frames:
            for i, t, e in zip(f["doc_id"].astype("Int64"), f["text"], f["extra"]):
                ids.append(i)
                texts.append(text_bytes(t))
                more.append(text_bytes(e))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text", "extra").mapInPandas(run, "block long, file string, n_docs long, n_bytes long")
    return checkpointed(rows)


class Block:
    """ids (int64), known (an id was given), and the texts' bytes in one buffer with their starts."""

    def __init__(self, folder: str, file: str):
        import zstandard

        fs, base = open_fs(folder)
        with fs.open_input_file(f"{base}/{file}") as f:
            data = zstandard.ZstdDecompressor().decompress(f.read())
        n = int(np.frombuffer(data, np.int64, 1)[0])
        self.known = np.frombuffer(data, np.uint8, n, 8).astype(bool)
        self.ids = np.frombuffer(data, np.int64, n, 8 + n)
        lengths = np.frombuffer(data, np.int64, n, 8 + 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        at, end = 8 + 25 * n, 8 + 25 * n + int(self.starts[-1])
        self.buffer = data[at:end]
        cuts = end + np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int64, n, 8 + 17 * n))])
        self.extra = [data[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]

    def texts(self) -> list[bytes]:
        return [self.buffer[a:b] for a, b in zip(self.starts[:-1], self.starts[1:])]
