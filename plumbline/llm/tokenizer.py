"""Encoding of a corpus with a public byte-level BPE vocabulary.

Pieces come from ``pretokenize``; each distinct piece is merged once and then found in a cache. Merging
takes the pair of lowest rank first; long pieces use a heap over a linked list, so that a text without
any boundary stays near-linear.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.pretokenize import split, texts_of
from plumbline.session import ship

#: Pieces kept per worker; the cache starts afresh beyond that, which costs time and never changes ids.
CACHE_PIECES = 1_000_000
#: Characters that are split at once.
CHUNK_CHARS = 2_000_000
_LOADED: dict[str, Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of byte pieces by ranks: the rank of a merged pair is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = {i: w for w, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge adjacent parts, lowest rank first and leftmost among equals, until none can be."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_long(piece) if len(piece) > 48 else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        cuts = list(range(len(piece) + 1))
        while len(cuts) > 2:
            best, where = None, 0
            for i in range(len(cuts) - 2):
                rank = ranks.get(piece[cuts[i] : cuts[i + 2]])
                if rank is not None and (best is None or rank < best):
                    best, where = rank, i
            if best is None:
                break
            del cuts[where + 1]
        return tuple(ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        ends = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(piece[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue
            alive[j] = 0
            ends[i] = end
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            got = self.merge(piece.encode("utf-8", "replace"))
            if len(piece) <= 256:
                self.cache[piece] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts on end, ids per text, and the character offset of each id's piece."""
        pieces, offsets, per_text = split(texts)
        found = list(map(self.cache.get, pieces))
        for i, got in enumerate(found):
            if got is None:
                found[i] = self.piece_ids(pieces[i])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for got in found for i in got), np.int32, int(sizes.sum()))
        edges = np.append(0, np.cumsum(sizes))
        bounds = np.append(0, np.cumsum(per_text))
        return ids, np.diff(edges[bounds]), np.repeat(offsets, sizes)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; exact for ids of a whole text."""
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once per process."""
    got = _LOADED.get(path)
    if got is None:
        got = _LOADED[path] = Encoder(path)
    return got


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters in all; a longer text is a run of its own."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > most:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def encode_batch(batch: pa.RecordBatch, path: str, keep: int, offsets: bool, count_only: bool) -> Iterator[pa.RecordBatch]:
    """One output batch per chunk of texts; the first ``keep`` columns are passed through."""
    coder, at = encoder(path), 0
    for run in chunks(texts_of(batch.column(keep))):
        ids, sizes, where = coder.encode(run)
        columns = [batch.column(i).slice(at, len(run)) for i in range(keep)]
        at += len(run)
        names = [batch.schema.names[i] for i in range(keep)]
        if count_only:
            columns.append(pa.array(sizes))
            names.append("n_tokens")
        else:
            edges = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(edges, pa.array(ids)))
            names.append("ids")
            if offsets:
                columns.append(pa.ListArray.from_arrays(edges, pa.array(where.astype(np.int32))))
                names.append("offsets")
        yield pa.RecordBatch.from_arrays(columns, names)


def _encoding(path: str, keep: int, offsets: bool, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encode_batch(batch, path, keep, offsets, count_only)

    return run


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, offsets: bool = False, count_only: bool = False) -> DataFrame:
    """``keep`` columns with the ``ids`` of each text, without special tokens.

    Null and empty texts have the empty list. With ``offsets``, each id also has the character at which
    its piece starts. With ``count_only``, only ``n_tokens``. One pass without a shuffle; the text of a
    special token is ordinary text. Damaged characters (lone surrogates) encode as a question mark.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    out = [f"`{c}` {kinds[c]}" for c in keep]
    out += ["n_tokens bigint"] if count_only else ["ids array<int>", *(["offsets array<int>"] if offsets else [])]
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(_encoding(path or vocabulary_path(), len(keep), offsets, count_only), ", ".join(out))


def _decoding(path: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode_batch(batch, path, keep)

    return run


def decode_batch(batch: pa.RecordBatch, path: str, keep: int) -> pa.RecordBatch:
    """The texts of one batch of ids."""
    coder = encoder(path)
    texts = [coder.decode(ids or []) for ids in batch.column(keep).to_pylist()]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(keep)], pa.array(texts, pa.string())], [*batch.schema.names[:keep], "text"])


def decode_ids(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keep`` columns with the ``text`` of each list of ids; a null list reads as an empty one."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    return df.select(*keep, F.col(ids).alias("_ids")).mapInArrow(_decoding(path or vocabulary_path(), len(keep)), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "text string"]))


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id, word`` (bytes) of a vocabulary file, for joins against ids."""
    coder = encoder(path or vocabulary_path())
    return spark.createDataFrame(sorted(coder.words.items()), "id int, word binary")
