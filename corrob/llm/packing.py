"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths.

The plan looks at counts only. Lengths are placed from the longest down, each into the open sequences with the least
room that still suffices; equal sequences are held as one class with a count, so the plan has a few entries per length
however many documents there are. Pieces then take the planned places by joining on length and rank within length.

Ids are those of the tokenizer's file as it is: a special token that a text spells out (``<|endoftext|>``) is that
token's id. Null texts count as empty: one token, the end mark. Very long texts are encoded whole and cut into pieces.
Repeated rows are separate documents. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm import tokens
from corrob.llm.common import cells_for, ranked, slices, stash, utf8

ROOM = 1024
END_ID = 2
#: Blanks in a row from which on the quick encoder isn't used: its time and its stack grow with them.
LONG_BLANKS = 300


@functools.lru_cache(maxsize=2)
def encoder(file: str, ranks: str | None = None) -> Callable[[str], bytes]:
    """A function from a text to the bytes of its ids by the tokenizer at ``file``; made once in each worker.

    ``ranks`` is the same byte-level vocabulary as a .tiktoken file, by which texts are encoded faster and with less
    memory. Texts with very many blanks in a row go through ``file`` all the same, which is only loaded for the first of them.
    """
    if ranks is None or not tokens.cuts_plainly(file):
        return tokens.encoder(file)
    import numpy as np
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(file, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)
    blanks = re.compile(rf"\s{{{LONG_BLANKS}}}")

    def encode(text: str) -> bytes:
        if len(text) >= LONG_BLANKS and blanks.search(text):
            return tokens.encoder(file)(text)
        return np.array(quick.encode(text, allowed_special="all"), "<u4").tobytes()

    return encode


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but that the first may be shorter."""
    first = n % room or room
    return [(0, first)] + [(s, room) for s in range(first, n, room)] if n > room else [(0, n)]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, room: int = ROOM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, ranks), END_ID.to_bytes(4, "little")
        for b in slices(batches, 1):
            at, rows = [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                ids = np.frombuffer(encode(raw.decode("utf-8", "replace") if raw else "") + end, "<u4")
                for k, (s, n) in enumerate(cut(len(ids), room)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *cols], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, utf8(text).alias("text")).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], room: int = ROOM) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit over counts: (length, first rank, ranks, first sequence, pieces a sequence, offset), and sequences used.

    Piece ``r`` of a length, ``j = r − first rank``, goes to sequence ``first sequence + j // per`` at ``offset + (j % per) · length``.
    """
    out, opened = [], 0
    rooms: list[int] = []  # sorted keys of free
    free: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)

    def leave(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            if r not in free:
                bisect.insort(rooms, r)
                free[r] = []
            free[r].append((first, n))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = free[r].pop()
                if not free[r]:
                    del free[r], rooms[at]
            else:
                r, first, n = room, opened, -(-left // (room // length))
                opened += n
            per = r // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, first, per, room - r))
                leave(r - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and 0 < left < per:
                out.append((length, rank, left, first + full, left, room - r))
                leave(r - left * length, first + full, 1)
                leave(r, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                leave(r, first + full, n - full)
    return out, opened


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, room: int = ROOM) -> DataFrame:
    """The pieces with sequence_id and offset. The driver sees one count per length: ``room`` numbers at most."""
    spark = docs.sparkSession
    cut_up = stash(pieces(docs, tokenizer, ranks, room), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps, _ = plan(counts, room)
    by_length: dict[int, list] = {}
    for s in steps:
        by_length.setdefault(s[0], []).append(s[1:])
    step = "struct<first:long,n:long,seq:long,per:long,at:long>"
    slots = spark.createDataFrame([(k, v) for k, v in by_length.items()], f"__length long, __steps array<{step}>")
    placed = ranked(cut_up, ["length"], ["doc_id", "piece", "start", "ids_crc32"], cells_for(max(counts.values(), default=0)), "__rank")
    # At most ``room`` rows with a few steps each: small however large the input.
    placed = placed.join(F.broadcast(slots), F.col("length") == F.col("__length"))
    mine = F.filter("__steps", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") < s["first"] + s["n"]))[0]
    placed = placed.withColumn("__s", mine).withColumn("__j", F.col("__rank") - F.col("__s.first"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("__s.seq") + F.expr("__j div __s.per")).alias("sequence_id"),
        (F.col("__s.at") + F.pmod("__j", F.col("__s.per")) * F.col("length")).alias("offset"),
    )
