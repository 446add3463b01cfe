"""Best-fit packing of tokenised documents into fixed-length sequences.

``token_pieces`` turns documents into pieces of at most ``capacity`` tokens, ``best_fit`` places pieces in
sequences, ``packed_sequences`` joins both into finished sequences.

Placement is bulk-synchronous best-fit. Pieces are taken in bands of falling length. A sweep sorts the waiting pieces of
a band and the gaps of all sequences by size, distributed, and matches every piece with its successor: the smallest free
slot that holds it. Conflicts are resolved by rank, gaps are updated, and sweeps repeat until no piece of the band waits.
New sequences are opened for pieces longer than every gap and for what exceeds all gaps together, and never more than
these are sure to need; the gaps of new ones take part in the same sweep.

All state lies in tables: pieces, gaps and placements are rows, stored after each sweep. The driver sees only the numbers
of pieces by length and of sequences by gap. Ranks inside one size are taken in blocks, whose number follows from the
number of rows, so a length that a third of all pieces share is no task of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
#: Lengths of a band differ by this factor at most.
BAND = 4
#: Pieces of a band that still wait go on to the next one when they are no more than this share of all shorter pieces.
LEFT_SHARE = 0.1
#: Slots that one gap offers in a sweep at most; the next sweep offers more.
MAX_SLOTS = 64
#: Rows of one size are ranked in blocks of about this many, in at most MAX_SALTS of them.
ROWS_PER_SALT, MAX_SALTS = 1000, 256
END_ID = 0
SPECIAL = "<|endoftext|>"
#: The rank encoder's pattern needs stack for every character of a white-space run; longer runs go to the other library.
LONG_SPACE = re.compile(r"\s{1000}")


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str, pattern: str):
    """Encode by the rank file, several times as fast as the tokenizers library and with the same ids; texts that hold a
    special token's string or a very long run of white space go to that library itself."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        if SPECIAL in text or LONG_SPACE.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit).

    A null text counts as empty, so it gives one piece that holds only the end id. Rows that repeat a doc_id are
    tokenised each for itself. Other columns of ``docs`` are not read."""
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    types = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, out = [], ([], [], [], [], [])
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                    for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        row.append(i)
                        for column, value in zip(out, (k, start, length, zlib.crc32(raw), raw), strict=True):
                            column.append(value)
                arrays = [part.column(0).take(pa.array(row, pa.int64()))] + [pa.array(v, t) for v, t in zip(out, types.types, strict=True)]
                names = ["doc_id", *types.names]
                keep = len(names) - (not with_ids)
                yield pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tokenise, schema)


def fewest_sequences(counts: dict[int, int], capacity: int) -> int:
    """No fewer sequences can hold these pieces (number by length): by their sum, by the pieces over half a sequence, and
    by how many of the shortest one sequence takes."""
    if not counts:
        return 0
    total, n = sum(k * c for k, c in counts.items()), sum(counts.values())
    return max(-(-total // capacity), sum(c for k, c in counts.items() if 2 * k > capacity), -(-n // (capacity // min(counts))))


Sizes = dict[int, list[int]]  # number of rows by size and block; one block for most sizes


def _salts(n: int) -> int:
    return min(MAX_SALTS, 1 + n // ROWS_PER_SALT)


def _tally(rows: DataFrame, size: str, key: str, counts: dict[int, int]) -> Sizes:
    """``counts`` (rows by size), by block where a size has many rows."""
    out: Sizes = {k: [n] for k, n in counts.items()}
    if large := {k: _salts(n) for k, n in counts.items() if _salts(n) > 1}:
        of = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col(size)]
        for k, salt, n in rows.filter(F.col(size).isin(*large)).groupBy(size, F.pmod(F.xxhash64(key), of).cast("int").alias("salt")).count().collect():
            if len(out[k]) != large[k]:
                out[k] = [0] * large[k]
            out[k][salt] = n
    return out


def _levels(offered: list[tuple[int, int, int, int]], asking: Sizes) -> list[tuple[int, bool, int, int, int, int]]:
    """(size, is_piece, of, turn, salt, base): the height of the stack of free slots before each block of slots or pieces.

    ``offered`` holds (size, gap, turn, blocks...) of slots. Sizes fall; slots of a size come before pieces of it, turn by
    turn, so that long and short pieces mix in a sequence. A slot goes on the stack, a piece takes the top one, which is
    the smallest slot that holds it; so a piece and its slot meet at one level of the stack."""
    out, height = [], 0
    slots: dict[int, list] = {}
    for size, gap, turn, blocks in offered:
        slots.setdefault(size, []).append((turn, gap, blocks))
    for size in sorted({*slots, *asking}, reverse=True):
        for turn, gap, blocks in sorted(slots.get(size, ())):
            for salt, n in enumerate(blocks):
                out.append((gap, False, turn, salt, len(blocks), height))
                height += n
        at = height
        for salt, n in enumerate(asking.get(size, ())):
            out.append((size, True, 0, salt, len(asking[size]), at))
            at -= n
        height = max(0, at)
    return out


def _sweep(waiting: DataFrame, gaps: DataFrame, wanted: Sizes, free: Sizes, capacity: int) -> DataFrame:
    """One sweep: kind ("placed", "waiting" or "gap"), item_id, length, sequence_id, place.

    ``waiting`` (item_id, length) and ``gaps`` (sequence_id, gap) with their numbers by length and gap. Every gap offers
    as many slots as average pieces it takes. Slots and pieces are ranked by size and meet by levels; where the pieces
    that a sequence meets do not all fit, the longest stay and the others wait for the next sweep."""
    count = sum(map(sum, wanted.values()))
    shortest, longest, mean = min(wanted), max(wanted), -(-sum(k * sum(n) for k, n in wanted.items()) // count)
    slots = []
    for gap, blocks in free.items():
        if gap >= shortest:
            n = min(MAX_SLOTS, max(1, gap // mean))
            size = gap if n == 1 else max(gap // n, min(gap, longest))
            slots += [(size, gap, turn, blocks) for turn in range(n)]
    size_of = {gap: size for size, gap, _, _ in slots}
    rows = [(key, is_piece, turn, salt, salts, key if is_piece else size_of[key], base) for key, is_piece, turn, salt, salts, base in _levels(slots, wanted)]
    # at most capacity x (MAX_SLOTS + 1) x salts rows; only sizes with many rows have more than one salt
    bases = F.broadcast(waiting.sparkSession.createDataFrame(rows, "key int, is_piece boolean, turn int, salt int, salts int, size int, base long"))
    salts = F.broadcast(bases.select("key", "is_piece", "salts").distinct())

    gap = F.col("gap")
    turns = F.least(F.lit(MAX_SLOTS), F.greatest(F.lit(1), F.floor(gap / mean))).cast("int")
    offered = gaps.filter(gap >= shortest).select(F.col("sequence_id").alias("id"), gap.alias("key"), F.lit(False).alias("is_piece"), F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    asking = waiting.select(F.col("item_id").alias("id"), F.col("length").alias("key"), F.lit(True).alias("is_piece"), F.lit(0).alias("turn"))
    block = ["key", "is_piece", "turn", "salt"]
    events = offered.unionByName(asking).join(salts, ["key", "is_piece"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    # the rank of a row is its rank in its block after the rows of the blocks before
    ranked = events.withColumn("inside", F.row_number().over(Window.partitionBy(*block).orderBy("id"))).join(bases.drop("salts"), block)
    level = F.when(F.col("is_piece"), F.col("base") + 1 - F.col("inside")).otherwise(F.col("base") + F.col("inside"))
    # a level holds slots and pieces in turn, at most one of each a size; pieces at or below zero met no slot
    ranked = ranked.select("id", "key", "size", "is_piece", F.when(level > 0, level).otherwise(-F.col("id") - 1).alias("level"))
    above = F.lag(F.when(~F.col("is_piece"), F.col("id"))).over(Window.partitionBy("level").orderBy(F.desc("size"), "is_piece"))
    met = ranked.withColumn("slot", above).filter("is_piece").select(F.col("id").alias("item_id"), F.col("key").alias("length"), F.col("slot").alias("sequence_id"), F.lit(None).cast("int").alias("gap"))

    # a sequence's row comes first, then its pieces, longest first
    mine = Window.partitionBy(F.coalesce("sequence_id", -F.col("item_id") - 1))
    both = met.unionByName(gaps.select(F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("length"), "sequence_id", "gap"))
    ordered = mine.orderBy(F.col("gap").isNull(), F.desc("length"), "item_id")
    both = both.withColumn("room", F.max("gap").over(mine)).withColumn("end", F.sum("length").over(ordered)).withColumn("fits", F.col("end") <= F.col("room"))
    both = both.withColumn("used", F.max(F.when(F.col("fits"), F.col("end"))).over(mine))
    kind = F.when(F.col("gap").isNotNull(), "gap").when(F.col("fits"), "placed").otherwise("waiting")
    place = F.when(kind == "gap", F.col("gap") - F.col("used")).when(kind == "placed", capacity - F.col("room") + F.col("end") - F.col("length"))
    return both.select("item_id", "length", "sequence_id", place.cast("int").alias("place"), kind.alias("kind"))


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place ``items`` (item_id: distinct long from 0, length: 1 to capacity) in sequences: item_id, sequence_id, offset.

    Each sequence is gapless from offset 0; no item is ever left out. No items give no rows. ``items`` is read once for
    each band of lengths and must give the same rows every time."""
    spark = items.sparkSession
    rows = items.select("item_id", F.col("length").cast("int").alias("length"))
    lengths = dict(map(tuple, rows.groupBy("length").count().collect()))  # at most capacity rows
    nothing = spark.createDataFrame([], "sequence_id long, gap int")
    waiting, gaps, wanted, free, opened, folders = rows.limit(0), nothing, {}, {}, 0, []
    high = capacity
    while high:
        low = high // BAND
        band = {k: n for k, n in lengths.items() if low < k <= high}
        ahead = sum(n for k, n in lengths.items() if k <= low)
        waiting = waiting.unionByName(rows.filter((F.col("length") > low) & (F.col("length") <= high)))
        wanted |= band
        # few that wait go on with the next band, as its longest pieces; the last band ends when none waits
        while sum(wanted.values()) > (LEFT_SHARE * ahead if not band else 0):
            band = {}
            over = sum(k * n for k, n in wanted.items()) - sum(k * n for k, n in free.items())  # tokens beyond all gaps together
            new = max(fewest_sequences({k: n for k, n in wanted.items() if k > max(free, default=0)}, capacity), -(-over // capacity))
            if new:
                gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("gap")))
                free[capacity] = free.get(capacity, 0) + new
                opened += new
            swept = stored(_sweep(waiting, gaps, _tally(waiting, "length", "item_id", wanted), _tally(gaps, "gap", "sequence_id", free), capacity), "sweep", by="kind")
            folders += swept.inputFiles()[:1]
            waiting = swept.filter("kind = 'waiting'").select("item_id", "length")
            gaps = swept.filter("kind = 'gap' and place > 0").select("sequence_id", F.col("place").alias("gap"))
            key = F.when(F.col("kind") == "gap", F.col("place")).otherwise(F.col("length"))
            left = swept.filter("kind = 'waiting' or kind = 'gap' and place > 0").groupBy("kind", key.alias("key")).count().collect()  # at most 2 x capacity rows
            wanted = {r["key"]: r["count"] for r in left if r["kind"] == "waiting"}
            free = {r["key"]: r["count"] for r in left if r["kind"] == "gap"}
        high = low
    if not folders:
        return spark.createDataFrame([], "item_id long, sequence_id long, offset long")
    placed = [f.rsplit("/kind=", 1)[0] + "/kind=placed" for f in folders]
    return spark.read.schema("item_id long, length int, sequence_id long, place int").parquet(*placed).select("item_id", "sequence_id", F.col("place").cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """The pieces of ``docs`` (see ``token_pieces``) with sequence_id and offset.

    Every row of ``docs`` is packed: null and empty texts as their end id, repeated rows each for itself. An empty
    table gives no rows; columns besides doc_id and text are ignored, whatever their names."""
    pieces = token_pieces(docs, capacity, vocabulary, with_ids)
    pieces = stored(pieces.withColumn("item_id", F.monotonically_increasing_id()), "pieces")
    return pieces.join(best_fit(pieces, capacity), "item_id").drop("item_id")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the finished sequences of ``pack(..., with_ids=True)``; each holds at most its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
