"""SentencePiece encoding and decoding of whole texts through a table of distinct marked words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.chunks import pieces
from siftline.llm.tables import whole

#: Texts whose new words are segmented together.
BLOCK = 256


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded text of every row.

    Null and empty texts have no ids and decode to nothing.  Rows are mapped
    one by one, so repeated rows repeat their result, and there is no shuffle.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pieces(model_path)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                table.learn(part["text"].tolist())
                counts, ids, decoded = zip(*map(table.encode, part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": counts, "ids": ids, "decoded": decoded})

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInPandas(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string")


def piece_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with SHA-256 digests of ids and decoded text, taken beside the encoder so that the ids need not leave the worker."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pieces(model_path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            out = []
            for at in range(0, len(batch), BLOCK):
                texts = batch["text"].iloc[at : at + BLOCK].tolist()
                table.learn(texts)
                for n, ids, decoded in map(table.encode, texts):
                    out.append((n, sha(ids), sha(decoded)))
            n, ids, decoded = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInPandas(
        digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
