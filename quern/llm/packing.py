"""Best-fit packing of documents into sequences by bin completion.

Documents are tokenized where they lie; only (doc_id, piece, length, ...) rows
go on. What a packing needs to know is how many pieces there are of each
length: at most `capacity` numbers, however large the corpus. Bin completion
with branch and bound runs over that histogram on the driver. Its first
incumbent is best-fit decreasing. Large counts are divided by a scale first:
what divides them all, then what leaves SMALL pieces; the fillings found are
applied so many times, and what the division left is planned the same way. A
search for fewer bins takes the largest length left, enumerates the undominated fillings around it by their waste,
applies each as often as the counts allow and then once, gives up where the
waste made so far or a lower bound of what is left is too much, and asks
best-fit to finish what little is left. It runs over all pieces, and then again
and again over the pieces of a few bins alone, the most wasteful ones and some
others, which it tries to put into one bin less. Its result is a short list of
(filling, times). The pieces find their places by rank within their length,
which Spark counts out by salted windows, so that a length shared by a third
of all pieces is spread over many tasks.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents
from .tokens import encoder

CAPACITY, END_ID = 1024, 2
#: Fillings that the search looks at in all, and in one try over a few bins; best-fit finishes what holds so many pieces or fewer.
NODES, TRY_NODES, FEW = 6000, 600, 48
#: Histograms of more pieces are planned in a smaller scale, beside as they are.
SMALL = 20_000
Plan = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each row of `docs`: its ids, then `end_id`, cut only where longer than `capacity`.

    The first piece holds the remainder, all others are full. A null or empty
    text is one piece of the end id. Columns: doc_id, piece, start, length,
    ids_crc32, and ids (array) if `with_ids`. Repeated rows give repeated pieces.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder().ids_bytes, end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + tail
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    end = start + capacity if piece else (n - 1) % capacity + 1
                    part = data[4 * start : 4 * end]
                    row = [doc_id, piece, start, end - start, zlib.crc32(part)]
                    if with_ids:
                        row.append(memoryview(part).cast("I").tolist())
                    for column, value in zip(out, row):
                        column.append(value)
                    start, piece = end, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, schema)


def best_fit(counts: Counter[int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: equal open bins are moved together."""
    open_bins: list[Counter[tuple[int, ...]]] = [Counter() for _ in range(capacity + 1)]  # by room left
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in range(size, capacity + 1):
            while left and open_bins[room]:
                filling, times = next(iter(open_bins[room].items()))
                fits = room // size
                full = min(times, left // fits)  # these take as many as they hold
                k, n = (fits, full) if full else (left, 1)
                open_bins[room][filling] -= n
                if not open_bins[room][filling]:
                    del open_bins[room][filling]
                open_bins[room - k * size][filling + (size,) * k] += n
                left -= k * n
        if left:
            fits = capacity // size
            if left // fits:
                open_bins[capacity - fits * size][(size,) * fits] += left // fits
            if left % fits:
                open_bins[capacity - left % fits * size][(size,) * (left % fits)] += 1
    return [(filling, n) for bins in open_bins for filling, n in bins.items()]


def sums_of(sizes: list[int], counts: Counter[int], room: int) -> list[int]:
    """For each place in `sizes` (descending) the sums up to `room` that the sizes from there on can make, as bits."""
    whole = (1 << (room + 1)) - 1
    out = [1]
    for s in reversed(sizes):
        bits, many, step = out[-1], min(counts[s], room // s), 1
        while many:
            take = min(step, many)
            bits |= bits << (take * s) & whole
            many -= take
            step *= 2
        out.append(bits)
    return out[::-1]


def fillings(counts: Counter[int], room: int, waste: int) -> Iterator[tuple[int, ...] | None]:
    """The undominated fillings of `room` from the lengths left that waste at most `waste`, least waste first.

    None stands for each dominated one that was looked at, so that a caller can count them.

    Of equal waste those with longer pieces come first. A filling is dominated
    if some of its pieces (two or more, or one that is shorter) could be
    swapped for one piece that is left and no smaller than they are together,
    within the room.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    reach = sums_of(sizes, counts, room)
    free = sum(1 << s for s, n in counts.items() if n)

    def grow(at: int, left: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        while left:
            # The next length from which on `left` can still be made; each is tried as often as it goes, then less often.
            while sizes[at] > left:
                at += 1
            s = sizes[at]
            for k in range(min(counts[s], left // s), 0, -1):
                if reach[at + 1] >> (left - k * s) & 1:
                    yield from grow(at + 1, left - k * s, taken + (s,) * k)
            at += 1
            if not reach[at] >> left & 1:
                return
        yield taken

    for lost in range(min(waste, room) + 1):
        if reach[0] >> (room - lost) & 1:
            for filling in grow(0, room - lost, ()):
                yield None if dominated(filling, counts, free, lost) else filling


def dominated(filling: tuple[int, ...], counts: Counter[int], free: int, lost: int) -> bool:
    """Whether a piece left besides `filling`, which leaves `lost` of its room, could stand for some of its pieces (see fillings).

    `free` has a bit for each length in `counts`.
    """
    one, many = 0, 0  # sums of one piece, and of several, as bits
    for s in filling:
        many |= (many | one) << s
        one |= 1 << s
    for s, k in Counter(filling).items():
        if counts[s] <= k:
            free &= ~(1 << s)
    spread = 0
    for k in range(lost + 1):
        spread |= many << k | (one << k if k else 0)
    return bool(spread & free)


def bins_of(plan: Plan) -> int:
    return sum(n for _, n in plan)


def least_bins(counts: Counter[int], capacity: int) -> int:
    """A lower bound: the larger of the total over capacity and, for each
    threshold k, bins that pieces over capacity - k, over half, and from k up
    to half need (Martello and Toth's L2)."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    many, weight = [0] * (capacity + 2), [0] * (capacity + 2)
    for s in range(1, capacity + 1):
        many[s] = many[s - 1] + counts.get(s, 0)
        weight[s] = weight[s - 1] + s * counts.get(s, 0)
    for k in range(1, capacity // 2 + 1):
        alone = many[capacity] - many[capacity - k]
        half = many[capacity - k] - many[capacity // 2]
        room = half * capacity - (weight[capacity - k] - weight[capacity // 2])
        small = weight[capacity // 2] - weight[k - 1]
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return best


def search(counts: Counter[int], capacity: int, target: int, nodes: int) -> tuple[Plan | None, int]:
    """A plan of at most `target` bins, if one is met within `nodes` fillings looked at, and how many that were.

    Depth first, always around the largest length left. Without a limit the
    search would meet a plan whenever there is one.
    """
    left, plan, used, total, spent = Counter(counts), [], 0, sum(s * n for s, n in counts.items()), 0

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        nonlocal spent
        top = max(s for s, n in left.items() if n)
        slack = (target - used) * capacity - total  # what may still be wasted
        rest = Counter({s: n - (s == top) for s, n in left.items() if n - (s == top)})
        for f in fillings(rest, capacity - top, slack):
            spent += 1
            if f is None:
                if spent >= nodes:
                    return
                continue
            filling = (top, *f)
            waste = capacity - sum(filling)
            times = min(left[s] // k for s, k in Counter(filling).items())
            times = min(times, slack // waste) if waste else times
            yield filling, times
            if times > 1:
                yield filling, 1

    def put(filling: tuple[int, ...], times: int) -> None:
        nonlocal total, used
        for s, k in Counter(filling).items():
            left[s] -= k * times
        total -= sum(filling) * times
        used += times

    stack = [options()] if total else []
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan:
                filling, times = plan.pop()
                put(filling, -times)
            continue
        put(*step)
        plan.append(step)
        if not total:
            return plan, spent
        if sum(left.values()) <= FEW and used + bins_of(end := best_fit(Counter({s: n for s, n in left.items() if n}), capacity)) <= target:
            return plan + end, spent
        if spent >= nodes:
            break
        if used + least_bins(left, capacity) > target:
            plan.pop()
            put(step[0], -step[1])
            continue
        stack.append(options())
    return None, spent


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, seed: int = 5, small: int = SMALL) -> Plan:
    """(filling, times) pairs that pack `counts` pieces of each length, in as few bins as were found.

    Stops at a proven optimum (the lower bound) or after `nodes` nodes; the
    incumbent then is the result. All pieces are packed in any case, and equal
    counts give equal plans. A common divisor of all counts is taken out, so
    that k times the counts take at most k times the bins. More than `small`
    pieces are also planned in a smaller scale, each filling as often as the
    scale says, and then what is left; the plan of fewer bins is the result.
    """
    counts = Counter({s: n for s, n in counts.items() if n})
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    scale = math.gcd(*counts.values())
    counts = Counter({s: n // scale for s, n in counts.items()})
    best, bound = best_fit(counts, capacity), least_bins(counts, capacity)
    part = -(-counts.total() // small)
    if part > 1 and (few := Counter({s: n // part for s, n in counts.items() if n >= part})):
        left = counts - Counter({s: n * part for s, n in few.items()})
        scaled = merged([(f, n * part) for f, n in complete_bins(few, capacity, nodes, seed, small)] + complete_bins(left, capacity, nodes, seed, small))
        best = min(scaled, best, key=bins_of)
    if bins_of(best) > bound:
        found, spent = search(counts, capacity, bound, nodes // 3)
        best = found or fewer_by_few(best, capacity, bound, nodes - spent, seed)
    return [(f, n * scale) for f, n in best]


def merged(plan: Plan) -> Plan:
    """Equal fillings as one."""
    times: Counter[tuple[int, ...]] = Counter()
    for f, n in plan:
        times[tuple(sorted(f, reverse=True))] += n
    return list(times.items())


def fewer_by_few(plan: Plan, capacity: int, bound: int, nodes: int, seed: int) -> Plan:
    """`plan` after tries to put the pieces of a few of its bins into one bin less, until it has `bound` bins.

    Half of the few are the most wasteful ones, the others are drawn from `seed`.
    """
    rng = random.Random(seed)
    best: Counter[tuple[int, ...]] = Counter(dict(merged(plan)))
    size, tries, spent = 16, 0, 0
    while best.total() > bound and spent < nodes:
        chosen: Counter[tuple[int, ...]] = Counter()
        for f, n in sorted(best.items(), key=lambda x: (sum(x[0]), x)):  # the most wasteful
            chosen[f] += min(n, max(1, size // 8), size // 2 - chosen.total())
            if chosen.total() >= size // 2:
                break
        others = sorted((best - chosen).items())
        while chosen.total() < size and others:
            k = rng.randrange(len(others))
            f, n = others[k]
            chosen[f] += 1
            others[k : k + 1] = [(f, n - 1)] if n > 1 else []
        pieces_ = Counter()
        for f, n in chosen.items():
            for s, k in Counter(f).items():
                pieces_[s] += k * n
        found, took = None, 1
        if least_bins(pieces_, capacity) < chosen.total():
            found, took = search(pieces_, capacity, chosen.total() - 1, min(TRY_NODES, nodes - spent))
        spent, tries = spent + took, tries + 1
        if found:
            times = min(best[f] // n for f, n in chosen.items())  # as often as the same bins are there
            for f, n in chosen.items():
                best[f] -= n * times
            for f, n in found:
                best[tuple(sorted(f, reverse=True))] += n * times
            best = +best
            size, tries = 16, 0
        elif tries % 4 == 0:  # more bins, and from the beginning when all have been tried
            size = 16 if size >= best.total() or size >= 1024 else size * 2
    return list(best.items())


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`items`, which have a column `length` (1 to `capacity`), with sequence_id and offset.

    Each row gets a number of its own, with which it is written once; rows of
    one length are counted out by these numbers, so that rows without id, of
    one id, or alike in all columns are as spread as any others. Equally long
    rows are interchangeable. An empty table gives an empty one.
    """
    spark = items.sparkSession
    items, own = cut(items.withColumn("__at", F.monotonically_increasing_id())), items.columns
    by_length = items.groupBy("length").count().collect()  # at most `capacity` rows
    counts = {r["length"]: r["count"] for r in by_length}
    slots: dict[int, list] = {}
    rank, sequence = Counter(), 0
    for filling, times in complete_bins(counts, capacity):
        offset = 0
        for size in filling:
            slots.setdefault(size, []).append((rank[size], sequence, offset))
            rank[size] += times
            offset += size
        sequence += times
    salts = max(16, sum(counts.values()) // 100_000)
    salted = items.withColumn("__salt", F.pmod(F.xxhash64("__at"), F.lit(salts)))
    of_salt = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    begin = of_salt.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    within = Window.partitionBy("length", "__salt").orderBy("__at")
    ranked = (
        salted.withColumn("__rank", F.row_number().over(within) - 1)
        .join(begin, ["length", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__begin"))
    )
    # A row for each length, with the runs of ranks that fill one place of a filling: bounded by the search, not by the corpus.
    table = spark.createDataFrame(list(slots.items()), "length long, __runs array<struct<first:long,sequence:long,offset:long>>")
    run = F.element_at("__runs", F.size(F.filter("__runs", lambda r: r["first"] <= F.col("__rank"))))  # they come by rank
    return (
        ranked.join(F.broadcast(table), "length")
        .withColumn("__run", run)
        .select(*own, (F.col("__run.sequence") + F.col("__rank") - F.col("__run.first")).alias("sequence_id"), F.col("__run.offset").alias("offset"))
    )


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Whole documents cut, packed and placed: the pieces with sequence_id and offset."""
    return pack(pieces(docs, capacity), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
