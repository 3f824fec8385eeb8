"""Best-fit packing of tokenised documents into sequences of fixed capacity.

The packing is bulk-synchronous.  Pieces and gaps (the free ends of sequences)
are tables.  Pieces are range-sorted by length, and taken class by class, the
long ones first.  In each round the pieces of the class and the gaps that may
hold them are range-sorted together by size, and every partition sweeps its
range from large to small: a piece takes the successor of its length, the
smallest gap before it that is still free.  So conflicts are settled by rank,
the longer piece first.  What a partition leaves over is carried to the ranges
below by counts, of which the driver holds two for each partition, and matched
there by rank.  Then gaps are updated and the next round follows, until no gap
holds a piece of the class.  Pieces that are left open new sequences, as many
to one as fit, by rank, or where they are short by the sum of lengths before.

A gap that holds several pieces of the class enters a round as that many slots,
so that wide gaps don't take a round for each piece; all slots of a round are
fewer than twice its pieces and its gaps.

Defined results: a null text is an empty one and its document is the end token
alone; documents with repeated ids are packed each; ties in length are ranked
by a hash of the row, and rows that are alike may change places; a very long
text is encoded in parts, and its pieces are rows like others; the end token is
never cut from its document but by the capacity; only the two named columns are
read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.pieces import TokenIds, by_size, shared
from tracewell.llm.workspace import Workspace, read_documents

CAPACITY = 2048
END = b"\x00\x00\x00\x00"
#: Classes end where one more piece fits in a sequence, up to this many; shorter
#: ones at a ratio, which is wider for short pieces: those under a sixteenth of
#: the capacity.
FITTING, NARROW, WIDE, SHORT = 8, 1.5, 3.0, 16
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
GAP, PIECE = 0, 1
MET, LEFT, FREE = 0, 1, 2


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared(TokenIds, tokenizer)
        for batch in batches:
            docs_of, done = batch.column(0).to_pylist(), 0
            for group in by_size(t.as_py() or "" for t in batch.column(1)):
                rows, mine = [], docs_of[done : done + len(group)]
                done += len(group)
                ids, ends = tokens.flat(group)
                data = memoryview(ids.tobytes())
                for doc, a, b in zip(mine, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    for k, at in enumerate(range(0, b - a + 1, capacity)):
                        length = min(capacity, b - a + 1 - at)
                        sum_of = zlib.crc32(data[4 * (a + at) : 4 * min(a + at + length, b)])
                        rows.append((doc, k, at, length, zlib.crc32(END, sum_of) if a + at + length > b else sum_of))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def classes(capacity: int) -> list[int]:
    """The greatest length of each class, in descending order."""
    found = {capacity - 1, int(capacity / NARROW), *(capacity // k for k in range(2, FITTING + 1))}
    high = int(capacity // FITTING / NARROW)
    while high > 0:
        found.add(high)
        high = int(high / (WIDE if high * SHORT <= capacity else NARROW))
    return sorted((x for x in found if 0 < x < capacity), reverse=True)


def meet(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of gaps and of the pieces that take them, in a row sorted from
    large to small where ``gap`` says which are gaps.

    Gaps open and pieces close like brackets: those of one depth alternate, and
    a piece takes the gap before it at its depth.
    """
    depth = np.cumsum(np.where(gap, 1, -1))
    level = np.where(gap, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    first, second = order[:-1], order[1:]
    met = gap[first] & ~gap[second] & (level[first] == level[second])
    return first[met], second[met]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sweep of one range; only its free gaps are held.

    The gap of a piece that is left is the sum of the lengths left before it.
    """
    names = ["what", "part", "rank", "sequence", "slot", "gap", "length", "row"]
    part, left, past, row_type = TaskContext.get().partitionId(), 0, 0, None
    free = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]

    def rows(what: int, rank: np.ndarray, gaps: list[np.ndarray | None], batch: pa.RecordBatch | None, at: np.ndarray) -> pa.RecordBatch:
        n, types = len(rank), (pa.int64(), pa.int32(), pa.int64())
        found = [pa.nulls(n, t) if g is None else pa.array(g, t) for g, t in zip(gaps, types, strict=True)]
        own = [batch.column(c).take(pa.array(at)) for c in ("length", "row")] if batch is not None else [pa.nulls(n, pa.int64()), pa.nulls(n, row_type)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, what, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(rank), *found, *own], names)

    for batch in batches:
        row_type, held = batch.column("row").type, len(free[0])
        of = [np.concatenate([f, batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)]) for f, c in zip(free, ("sequence", "slot", "gap"), strict=True)]
        gap = np.concatenate([np.ones(held, bool), batch.column("kind").to_numpy() == GAP])
        gaps, taken = meet(gap)
        yield rows(MET, np.zeros(len(taken), np.int64), [c[gaps] for c in of], batch, taken - held)
        over = ~gap
        over[taken] = False
        places = np.flatnonzero(over)
        lengths = batch.column("length").fill_null(0).to_numpy(zero_copy_only=False)[places - held]
        sums = past + np.cumsum(lengths)
        yield rows(LEFT, left + np.arange(len(places)), [None, None, sums - lengths], batch, places - held)
        left, past = left + len(places), int(sums[-1]) if len(sums) else past
        gap[gaps] = False
        free = [c[gap] for c in of]
    for at in range(0, len(free[0]), 100_000):
        yield rows(FREE, at + np.arange(len(free[0][at : at + 100_000])), [c[at : at + 100_000] for c in free], None, np.empty(0, np.int64))


def carried(left: dict[int, int], free: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of left pieces take which ranks of free gaps: the pieces'
    partition, their first rank, the gaps' partition, the gap that the first
    piece takes, how many, and how many before.

    Partitions go from large to small, and what a partition leaves are pieces
    without a gap before them, then free gaps, the last of which is smallest.
    """
    open_gaps: list[list[int]] = []
    found, before = [], 0
    for part in sorted({*left, *free}):
        rank, many = 0, left.get(part, 0)
        while rank < many and open_gaps:
            of, top = open_gaps[-1]
            n = min(many - rank, top)
            found.append((part, rank, of, top - 1, n, before))
            rank, before = rank + n, before + n
            open_gaps[-1][1] -= n
            if not open_gaps[-1][1]:
                open_gaps.pop()
        if free.get(part):
            open_gaps.append([part, free[part]])
    return found


class Packing:
    """Rounds over tables of pieces (length, row) and gaps (sequence, gap)."""

    def __init__(self, work: Workspace, capacity: int):
        self.work, self.spark, self.capacity = work, work.spark, capacity
        self.gaps: DataFrame | None = None
        self.widest, self.sequences, self.rounds = 0, 0, 0
        self.placed: list[DataFrame] = []

    def _small(self, rows: list[tuple], schema: str) -> DataFrame:
        """A row for each partition or two: small whatever the data."""
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def _sweep(self, rest: DataFrame, many: int, shortest: int, longest: int) -> DataFrame:
        tie = F.xxhash64("sequence", "slot", "row")
        piece = rest.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("gap"), "length", "row")
        both = piece
        if self.gaps is not None and self.widest >= shortest:
            fit = self.gaps.filter(F.col("gap") >= shortest)
            wanted = -(-2 * many // fit.count())
            slots = F.greatest(F.lit(1), F.least(F.lit(wanted), F.floor(F.col("gap") / longest))).cast("int")
            cut = fit.select("sequence", "gap", slots.alias("slots")).select("sequence", "gap", "slots", F.explode(F.sequence(F.lit(1), "slots")).alias("slot"))
            both = piece.unionByName(cut.select(F.lit(GAP).alias("kind"), F.floor(F.col("gap") / F.col("slots")).alias("size"), "sequence", "slot", "gap"), allowMissingColumns=True)
        order = [F.desc("size"), F.col("kind"), F.col("tie")]
        row = rest.schema["row"].dataType.simpleString()
        ranged = both.withColumn("tie", tie).repartitionByRange(*order).sortWithinPartitions(*order)
        schema = f"what int, part int, rank long, sequence long, slot int, gap long, length long, row {row}"
        return self.work.save(ranged.drop("size", "tie").mapInArrow(_swept, schema), f"swept-{self.rounds}")

    def _update(self, placed: DataFrame, opened: bool) -> None:
        """Gaps after a round; ``opened`` sequences are new ones."""
        used = placed.groupBy("sequence").agg(F.sum("length").alias("used"))
        if opened:
            new = used.select("sequence", (F.lit(self.capacity) - F.col("used")).alias("gap")).filter("gap > 0")
            gaps = new if self.gaps is None else self.gaps.unionAll(new)
        else:
            change = placed.select("sequence", (-F.col("length")).alias("gap"))
            gaps = self.gaps.unionAll(change).groupBy("sequence").agg(F.sum("gap").alias("gap")).filter("gap > 0")
        self.gaps = self.work.save(gaps, f"gaps-{len(self.placed)}")
        self.work.drop(f"gaps-{len(self.placed) - 1}")
        self.widest = self.gaps.agg(F.max("gap")).first()[0] or 0

    def _place(self, rows: DataFrame, order: str, opened: bool) -> None:
        """``rows`` (sequence, gap, length, row) one after the other in their gaps."""
        before = Window.partitionBy("sequence").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        offset = F.lit(self.capacity) - F.col("gap") + F.coalesce(F.sum("length").over(before), F.lit(0))
        self.placed.append(self.work.save(rows.select("row", "length", "sequence", offset.cast("long").alias("offset")), f"placed-{len(self.placed)}"))
        self._update(self.placed[-1], opened)

    def fit(self, rest: DataFrame, many: int, longest: int, shortest: int) -> None:
        """All rounds of one class: ``many`` rows (length, row)."""
        while many:
            swept = self._sweep(rest, many, shortest, longest)
            counts = swept.groupBy("part", "what").agg(F.count("*").alias("n"), F.max("length").alias("high"), F.min("length").alias("low")).collect()
            of = {what: {r["part"]: r["n"] for r in counts if r["what"] == what} for what in (MET, LEFT, FREE)}
            links = carried(of[LEFT], of[FREE])
            met = swept.filter(F.col("what") == MET).select("sequence", "slot", "gap", "length", "row")
            if links:
                met = met.unionAll(self._carried(swept, links))
            taken: dict[int, int] = {}
            for part, _, _, _, n, _ in links:
                taken[part] = taken.get(part, 0) + n
            if links or of[MET]:
                self._place(met, "slot", False)
            over = [(p, taken.get(p, 0), n) for p, n in sorted(of[LEFT].items()) if n > taken.get(p, 0)]
            ranks, past = [], 0
            for part, first, n in over:
                ranks.append((part, first, past - first))
                past += n - first
            many = past
            if many:
                bounds = [(r["high"], r["low"]) for r in counts if r["what"] == LEFT and any(r["part"] == p for p, _, _ in over)]
                longest, shortest = max(b[0] for b in bounds), min(b[1] for b in bounds)
                ranked = swept.filter(F.col("what") == LEFT).drop("sequence", "slot").join(self._small(ranks, "part int, first long, shift long"), "part").filter("rank >= first")
                if (links or of[MET]) and self.widest >= shortest:
                    if self.rounds:
                        self.work.drop(f"rest-{self.rounds - 1}")
                    rest = self.work.save(ranked.select("length", "row"), f"rest-{self.rounds}")
                else:
                    self._open(ranked, many, longest)
                    many = 0
            self.work.drop(f"swept-{self.rounds}")
            self.rounds += 1

    def _open(self, ranked: DataFrame, many: int, longest: int) -> None:
        """New sequences for pieces with their ranks."""
        rank = F.col("rank") + F.col("shift")
        if longest * SHORT > self.capacity:
            each = self.capacity // longest
            number, new = rank / each, -(-many // each)
        else:  # those that begin in one stretch of the sum fit together, whatever their lengths
            stretch, before, shifts = self.capacity - longest + 1, 0, []
            sums = ranked.groupBy("part").agg(F.min("gap").alias("low"), F.max(F.col("gap") + F.col("length")).alias("high")).collect()
            for part, low, high in sorted(map(tuple, sums)):
                shifts.append((part, before - low))
                before += high - low
            ranked = ranked.join(self._small(shifts, "part int, sum_shift long"), "part")
            number, new = (F.col("gap") + F.col("sum_shift")) / stretch, before // stretch + 1
        sequence = (F.lit(self.sequences) + F.floor(number)).cast("long").alias("sequence")
        self._place(ranked.select(sequence, rank.alias("slot"), F.lit(self.capacity).cast("long").alias("gap"), "length", "row"), "slot", True)
        self.sequences += new

    def _carried(self, swept: DataFrame, links: list[tuple]) -> DataFrame:
        """Pieces of one range in gaps of the ranges above, met by rank."""
        pieces_of = self._small([(p, first, first + n, before - first) for p, first, _, _, n, before in links], "part int, first long, past long, shift long")
        gaps_of = self._small([(g, top - n + 1, top + 1, before + top) for _, _, g, top, n, before in links], "part int, first long, past long, shift long")
        within = "rank >= first AND rank < past"
        left = swept.filter(F.col("what") == LEFT).join(pieces_of, "part").filter(within).select((F.col("rank") + F.col("shift")).alias("link"), "length", "row")
        free = swept.filter(F.col("what") == FREE).join(gaps_of, "part").filter(within).select((F.col("shift") - F.col("rank")).alias("link"), "sequence", "slot", "gap")
        return left.join(free, "link").select("sequence", "slot", "gap", "length", "row")


def pack(sizes: DataFrame, work: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """``sizes`` (a saved table with a column length, from 1 to ``capacity``)
    with sequence_id and offset; columns by these names are replaced."""
    plain = sizes.drop("sequence_id", "offset")
    order = [F.desc("length"), F.col("tie")]
    rows = plain.select("length", F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row")).withColumn("tie", F.xxhash64("row"))
    ordered = work.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie"), "ordered")
    of = F.lit(0)
    for high in classes(capacity):
        of = F.when(F.col("length") <= high, F.lit(high)).otherwise(of)
    found = ordered.groupBy(of.alias("class")).agg(F.count("*").alias("n"), F.max("length").alias("high"), F.min("length").alias("low")).collect()
    rounds = Packing(work, capacity)
    for _, many, high, low in sorted((tuple(r) for r in found if r["class"]), reverse=True):
        rounds.fit(ordered.filter((F.col("length") >= low) & (F.col("length") <= high)), many, high, low)
    # a piece as long as the capacity is a sequence of its own
    whole = ordered.filter(F.col("length") == capacity).select("row", (-1 - F.monotonically_increasing_id()).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    for placed in rounds.placed:
        whole = whole.unionAll(placed.select("row", "sequence", "offset"))
    return whole.select("row.*", F.col("sequence").alias("sequence_id"), "offset")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    work = Workspace(docs.sparkSession, "packing")
    return pack(work.save(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), work, capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = read_documents(spark, sf_dir)
    return stage(spark, docs, sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents as packed pieces."""
    return best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))
