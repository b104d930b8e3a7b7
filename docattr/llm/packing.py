"""Packing documents into sequences by first-fit decreasing over randomised groups.

A document's ids are cut every ``size`` tokens; whole cuts fill a sequence each, the rest of a
document is packed with the rests of the other documents of its group, longest first, each
into the first sequence with room. A tournament tree over the free room of the group's
sequences finds that sequence in logarithmic time. Texts never move: they are tokenised where
they are read, and only lengths and checksums are shuffled into the groups.

Groups hold ``group_docs`` documents on average, whatever the size of the corpus; they are
drawn by a seeded hash of id and content, so equal input gives equal sequences.

Defined cases: a null text is empty; every document ends with ``end_id``, so an empty text
gives one token; a null id is kept; rows are documents, repeated rows are packed as often as
they occur; equal lengths are packed in the order of the seeded hash; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.session import cut

SIZE = 1024
GROUP_DOCS = 1024
END_ID = 0
SEED = 23
#: Pieces of this many letters, digits or blanks in a row go to the slower encoder, whose time stays near linear.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


@lru_cache(maxsize=2)
def _encoders(folder: str | None, name: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def path(file):
        return f"{folder}/{file}" if folder else public_tokenizers.path(file)

    with open(path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
    slow = Tokenizer.from_file(path(f"{name}.json"))
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return fast, slow


def encode(text: str | None, folder: str | None = None, name: str = "byte_bpe_50k", end_id: int = END_ID) -> np.ndarray:
    """Token ids as little-endian unsigned 32-bit numbers, with ``end_id`` behind them.

    The ids are those of the ``tokenizers`` file without special tokens added; its rank file
    gives the same ids several times faster.
    """
    fast, slow = _encoders(folder, name)
    if not text:
        ids = np.zeros(0, "<u4")
    elif LONG_RUN.search(text):
        ids = np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    else:
        ids = fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    return np.append(ids, np.array([end_id], "<u4"))


_TOKENISED = "doc_id long, doc_tokens long, crcs binary, copy long"


def tokenised(docs: DataFrame, size: int = SIZE, folder: str | None = None, name: str = "byte_bpe_50k",
              end_id: int = END_ID) -> DataFrame:
    """Per document: number of tokens and one checksum for every cut of ``size`` tokens.

    ``copy`` tells repeated rows of a batch apart, else it is 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.binary()), ("copy", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            keys, tokens, crcs, copies, seen = [], [], [], [], {}
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py(), folder, name, end_id)
                keys.append(key.as_py())
                tokens.append(len(ids))
                cuts = [zlib.crc32(ids[i:i + size].tobytes()) for i in range(0, len(ids), size)]
                crcs.append(np.array(cuts, "<u4").tobytes())
                n = seen[keys[-1]] = seen.get(keys[-1], -1) + 1
                copies.append(n and (task * 1_000_003 + number) * 1_000_003 + n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.binary()),
                 pa.array(copies, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENISED)


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of every item; ``lengths`` come longest first.

    Leaves of the tournament tree hold the free room of the bins, inner nodes the larger room
    of their two children; going down to the left wherever the room suffices finds the first fit.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [size] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(size - room[node])
        room[node] -= n
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]


def pack(docs: DataFrame, size: int = SIZE, group_docs: int = GROUP_DOCS, seed: int = SEED, folder: str | None = None,
         name: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``sequence_tokens`` is the filled length of the piece's sequence; the rest of ``size`` is
    padding. ``sequence_id`` holds the group in its upper and the sequence in its lower half.
    """
    rows = cut(tokenised(docs, size, folder, name, end_id))
    groups = F.greatest(F.lit(1), F.ceil(rows.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(group_docs)))
    draw = F.xxhash64(F.lit(seed), "doc_id", "crcs", "copy")
    grouped = rows.select("doc_id", "doc_tokens", "crcs", draw.alias("draw"), F.pmod(draw, groups).cast("long").alias("group"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tokens, draws = table["doc_tokens"].to_numpy(), table["draw"].to_numpy()
        order = np.lexsort((draws, -(tokens % size)))
        ids, checks = table["doc_id"].to_pylist(), table["crcs"].to_pylist()
        rests = (tokens % size)[order].tolist()
        bins, offsets = first_fit_decreasing([n for n in rests if n], size)
        filled = [0] * (max(bins, default=-1) + 1)
        for b, n in zip(bins, rests, strict=False):
            filled[b] += n
        base, whole, out = key[0].as_py() << 32, len(filled), []
        for i, row in enumerate(order.tolist()):
            doc, total, crcs = ids[row], int(tokens[row]), np.frombuffer(checks[row], "<u4").tolist()
            for k in range(total // size):
                out.append((doc, k * size, size, crcs[k], total, base + whole, 0, size))
                whole += 1
            if rests[i]:
                b = bins[i]
                out.append((doc, total - rests[i], rests[i], crcs[-1], total, base + b, offsets[i], filled[b]))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_COLUMNS)

    return grouped.groupBy("group").applyInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))
