"""Repeated passages by a hash-compared suffix sort (operator 4).

A byte goes if a string of LENGTH bytes that covers it also starts anywhere
else in the corpus. Every window of LENGTH bytes is led by the lowest-ranked of
its GRAM-byte substrings, which its content alone decides, so equal windows
have equal leaders at equal offsets. Consecutive windows under one leader form
a run; a text of n bytes has about 2 n / (LENGTH - GRAM) of them, and only they
are shuffled. The same pass measures shorter passages that documents share,
which removes nothing (below).

Runs meet by their leader's hash. A leader seen once repeats nothing; runs that
are equal as a whole (64 bits of hash of the leader and 64 of a cryptographic
digest of the run) repeat whole; what is left are runs at the edges of repeated
passages, one of each content. Their texts are fetched and cut into slices of a
few dozen windows by the distance to their leader. All windows of a slice share
its core, so slices are dealt by leader, distance and core: a leader that many
texts have in common, such as a licence line, spreads over as many tasks as it
has surroundings. In each deal the windows are sorted as suffixes: prefix
polynomial hashes and binary search give two suffixes' common extension in
logarithmic time, and a bottom-up mergesort of all groups at once compares by
it. The order is checked by a second hash and, should the hashes disagree, made
again by the bytes; neighbours that agree over the length are verified byte by
byte.

``n_shared`` needs no bytes: of runs of SHORT-byte windows, a slice's core is
shared if its hash comes from another document too. So every string of SHORT
bytes that two documents share is noticed, and nothing under SHORT less
SHORT_STEP - 1 bytes is.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing;
of equal texts (repeated rows included) every one loses all that LENGTH covers;
rows with one doc_id (or without one) are one document where SHORT asks for
another; texts of any length are treated whole; an empty table gives no rows;
other columns are ignored by :func:`removals` and kept by :func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops, storage

LENGTH = 400
GRAM = 128
#: The passages that ``n_shared`` notices: some fifty words.
SHORT = 300
SHORT_GRAM = 64
SHORT_STEP = 32
#: Distances to the leader in a slice; of leaders with more than MANY contents, fewer, for longer cores.
STEP = 64
FINE_STEP = 16
MANY = 1024
#: Places in a stretch of text that is ranked at once.
PLACE_BITS = 24
U64 = np.uint64
_NO_ID = -(2**63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return np.zeros(0, x.dtype)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(part: np.ndarray, offs: np.ndarray, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, leader, leader's hash) of each run; places are in ``part``, whose
    prefix hashes are ``prefix``.

    Grams are ranked by the upper bits of their hashes, always as many, and then from the left,
    so a window's content alone decides. Longer parts are ranked in overlapping stretches.
    """
    n, most = len(part), 1 << PLACE_BITS
    if n > most:
        step = most - length
        pieces = []
        for a in range(0, n - length + 1, step):
            z = min(n, a + most - 1)
            row, begin, count, lead, key = runs_of(part[a:z], np.clip(offs - a, 0, z - a), bytesops.prefix_hash(part[a:z]), length, gram)
            # The next stretch begins with the windows that start there.
            count = np.minimum(count, step - begin) if z < n else count
            good = count > 0
            pieces.append((row[good], begin[good] + a, count[good], lead[good] + a, key[good]))
        return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    if n < length:
        return none
    at = np.arange(n - gram + 1)
    hashed = bytesops.mix(bytesops.span_hash(prefix, at, at + gram))
    bits = U64(PLACE_BITS)
    ranked = (hashed >> bits << bits) | at.astype(U64)
    lead = (_sliding_min(ranked, length - gram + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    sizes = np.diff(offs)
    long = sizes >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: n - length + 1] > 0)
    if not len(starts):
        return none
    lead = lead[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(lead) != 0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    row = np.searchsorted(offs, starts[first], "right") - 1
    return row, starts[first], count, lead[first], hashed[lead[first]]


def _text_name(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


#: place: 2 * n_bytes, plus 1 for runs of the second kind; span: begin, windows and the leader's distance.
_RUN = "key long, content long, doc_id long, name long, place long, span long"


def _runs(docs: DataFrame, kinds: dict[int, int]) -> DataFrame:
    names = [x.split()[0] for x in _RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesops.text_bytes(batch.column(1))
            ids = batch.column(0)
            for first, last in bytesops.row_blocks(offs):
                part, rel = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
                prefix, raw = bytesops.prefix_hash(part), part.tobytes()
                name, named = np.zeros(last - first, np.int64), np.zeros(last - first, bool)
                for kind, (length, gram) in enumerate(kinds.items()):
                    row, begin, count, lead, key = runs_of(part, rel, prefix, length, gram)
                    if not len(row):
                        continue
                    digest = b"".join([hashlib.blake2b(raw[a:z], digest_size=8).digest() for a, z in zip(begin.tolist(), (begin + count + (length - 1)).tolist(), strict=True)])
                    for r in np.unique(row[~named[row]]).tolist():
                        name[r], named[r] = _text_name(raw[rel[r] : rel[r + 1]]), True
                    span = (begin - rel[row]) << 24 | count << 12 | (lead - begin)
                    columns = [bytesops.mix(key, length).view(np.int64), np.frombuffer(digest, "<i8"), ids.take(pa.array(row + first)), name[row], np.diff(rel)[row] << 1 | kind, span]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    storage.small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, _RUN)


def _unpacked(runs: DataFrame, kinds: dict[int, int]) -> DataFrame:
    lengths = F.array(*[F.lit(n) for n in kinds])
    span = F.col("span")
    begin, windows, ahead = F.shiftright(span, 24), F.shiftright(span, 12).bitwiseAND(F.lit(4095)), span.bitwiseAND(F.lit(4095))
    return runs.select(
        *[c for c in runs.columns if c not in ("place", "span")], F.get(lengths, F.col("place").bitwiseAND(F.lit(1)).cast("int")).alias("length"), F.shiftright("place", 1).alias("n_bytes"),
        begin.cast("int").alias("begin"), windows.cast("int").alias("windows"), (begin + ahead).cast("int").alias("lead"),
    )


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How far the strings at a and b agree, up to ``most``, by binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    inverse = bytesops.powers(bytesops._INVERSE, len(prefix))
    base_a, base_b, scale_a, scale_b = prefix[a], prefix[b], inverse[a], inverse[b]
    while True:
        if not (low < high).any():
            return low
        mid = (low + high + 1) // 2
        same = (prefix[a + mid] - base_a) * scale_a == (prefix[b + mid] - base_b) * scale_b
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)


def suffix_sort(text: np.ndarray, prefix: np.ndarray, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The items in order of group and, within it, of their first ``most`` bytes.

    A bottom-up mergesort of all groups at once: at each width every item finds
    its place in the neighbouring run by binary search, comparing by common
    extension and the byte after it.
    """
    order = np.argsort(group, kind="stable")
    grouped = group[order]
    head = np.searchsorted(grouped, grouped, "left")
    size = np.searchsorted(grouped, grouped, "right") - head
    place = np.arange(len(order)) - head
    width, widest = 1, int(size.max(initial=0))

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        same = common_extension(prefix, a, b, most)
        whole = same >= most
        x, y = text[np.where(whole, 0, a + same)], text[np.where(whole, 0, b + same)]
        return np.where(whole, ties, x < y)

    while width < widest:
        live = np.flatnonzero(size > width)
        p, h, n = place[live], head[live], size[live]
        run = p // width
        sibling = (run ^ 1) * width
        lo = np.minimum(sibling, n)
        low, high = lo.copy(), np.minimum(sibling + width, n)
        is_right = (run & 1).astype(bool)
        mine = starts[order[live]]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) // 2
            first = before(starts[order[h[todo] + mid]], mine[todo], is_right[todo])
            low[todo], high[todo] = np.where(first, mid + 1, low[todo]), np.where(first, high[todo], mid)
        to = (run & ~1) * width + (p - run * width) + (low - lo)
        moved = order[live]
        order[h + to] = moved
        width *= 2
    return order


def _in_order(text: np.ndarray, starts: np.ndarray, group: np.ndarray, order: np.ndarray, same: np.ndarray, length: int) -> bool:
    """Whether neighbours in the order agree as far as the hashes say, by a second hash, and then rise."""
    a, b = order[:-1], order[1:]
    live = group[a] == group[b]
    a, b, same = starts[a[live]], starts[b[live]], same[live]
    second = bytesops.prefix_hash(text, bytesops.OTHER_BASE)
    agree = bytesops.span_hash(second, a, a + same, bytesops.OTHER_BASE) == bytesops.span_hash(second, b, b + same, bytesops.OTHER_BASE)
    open_ = same < length
    return bool(agree.all() and (text[(a + same)[open_]] < text[(b + same)[open_]]).all())


def repeated_windows(slices: list[bytes], aheads: list[int], windows: list[int], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each slice, which of its windows also occurs in another slice of its group.

    ``aheads``: from the first window's start to the leader.
    """
    text = np.frombuffer(b"".join(slices), np.uint8)
    prefix = bytesops.prefix_hash(text)
    count = np.array(windows, np.int64)
    base = np.concatenate([[0], np.cumsum([len(s) for s in slices])])[:-1]
    owner = np.repeat(np.arange(len(slices)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = base[owner] + offset
    ahead = np.array(aheads, np.int64)[owner] - offset
    group = groups[owner] * (length + 1) + ahead
    order = suffix_sort(text, prefix, starts, group, length)
    same = common_extension(prefix, starts[order[:-1]], starts[order[1:]], length)
    if not _in_order(text, starts, group, order, same, length):
        raw = text.tobytes()
        order = np.array(sorted(range(len(owner)), key=lambda i: (group[i], raw[starts[i] : starts[i] + length])), np.int64)
        same = common_extension(prefix, starts[order[:-1]], starts[order[1:]], length)
    equal = (same >= length) & (group[order[:-1]] == group[order[1:]])
    near = np.flatnonzero(equal)
    span = np.arange(length)
    for k in range(0, len(near), 4096):  # equal hashes are verified byte by byte
        x, y = order[near[k : k + 4096]], order[near[k : k + 4096] + 1]
        equal[near[k : k + 4096]] = (text[starts[x][:, None] + span] == text[starts[y][:, None] + span]).all(axis=1)
    found = np.zeros(len(owner), bool)
    found[order[:-1][equal]] = True
    found[order[1:][equal]] = True
    return np.split(found, np.cumsum(count)[:-1])


_SLICE = "deal long, length int, key long, content long, low long, high long, alone boolean, ahead int, off int, windows int, bytes binary"
_FOUND = "key long, content long, first int, last int"


def _edges(docs: DataFrame, mixed: DataFrame, elsewhere: int | None, hold: int = 200_000) -> DataFrame:
    """(key, content, first, last): what repeated windows cover in runs at passages' edges, from the run's begin."""
    at = F.struct("length", "key", "content", "low", "high", "alone", "step", "begin", "windows", "lead")
    wanted = mixed.groupBy("doc_id", "name", "n_bytes").agg(F.collect_list(at).alias("runs"))

    def slices_of(raw: bytes, r: dict) -> Iterator[tuple]:
        length, farthest = r["length"], r["lead"] - r["begin"]
        step = min(SHORT_STEP if length == elsewhere else r["step"], length // 4)
        nearest = farthest - r["windows"] + 1
        for q in range(nearest // step, farthest // step + 1):
            a, z = min(farthest, q * step + step - 1), max(nearest, q * step)
            core = r["lead"] - q * step
            name = hashlib.blake2b(raw[core : core - step + 1 + length] + f"{r['key']},{q}".encode(), digest_size=8).digest()
            same = (int.from_bytes(name, "little", signed=True), length, *(r[k] for k in ("key", "content", "low", "high", "alone")))
            if length == elsewhere:
                yield (*same, 0, core - r["begin"], length - step + 1, b"")
            else:
                begin = r["lead"] - a
                yield (*same, a, begin - r["begin"], a - z + 1, raw[begin : begin + a - z + length])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SLICE.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.bool_(), *[pa.int32()] * 3, pa.binary()]
        for batch in batches:
            rows: list[tuple] = []

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)  # noqa: B023

            for text, name, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                if _text_name(raw) == name:
                    for r in runs:
                        rows += slices_of(raw, r)
                        if len(rows) >= 4096:
                            yield done()
                            rows = []
            yield done()

    def found_in(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "content", "first", "last"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, group, seen, now = [], 0, -1, set(), None
        shared: list[tuple] = []  # of the deal at hand, until a second document is met
        low = high = None

        def done() -> pa.RecordBatch:
            out = []
            for length in {h[1] for h in held}:
                some = [h for h in held if h[1] == length]
                flags = repeated_windows([h[10] for h in some], [h[7] for h in some], [h[9] for h in some], np.array([h[11] for h in some]), length)
                for h, f in zip(some, flags, strict=True):
                    if h[6] and f.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
                        out += [(h[2], h[3], h[8] + a, h[8] + b - 1 + length) for a, b in edge.reshape(-1, 2).tolist()]
            return found_in(out)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if row[0] != now:
                    if held and held[-1][11] == group and len(seen) == 1:
                        n -= held.pop()[9]  # alone in its deal, so it repeats nothing
                    if n >= hold:
                        yield done()
                        held, n = [], 0
                    now, seen, group = row[0], set(), group + 1
                    shared, low, high = [], row[4], row[5]
                if row[1] == elsewhere:
                    low, high = min(low, row[4]), max(high, row[5])
                    if row[6]:
                        shared.append((row[2], row[3], row[8], row[8] + row[9]))
                    if low < high and shared:
                        yield found_in(shared)
                        shared = []
                elif row[2:4] not in seen:
                    seen.add(row[2:4])
                    held.append((*row, group))
                    n += row[9]
        if held:
            yield done()

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_n"))
    joined = texts.join(wanted, texts["_id"].eqNullSafe(wanted["doc_id"]) & (texts["_n"] == wanted["n_bytes"]))
    slices = joined.select("text", "name", "runs").mapInArrow(cut, _SLICE)
    return slices.repartition("deal").sortWithinPartitions("deal").mapInArrow(sort, _FOUND)


def repeated_spans(docs: DataFrame, kinds: dict[int, int], elsewhere: int | None = None) -> DataFrame:
    """(name, n_bytes, spans) of texts with repeats: a text's name is a digest of it; spans (length, first, last)
    are in bytes, unmerged. ``kinds``: lengths and the grams that lead them; ``elsewhere``: the length
    whose strings must repeat in another document."""
    runs = storage.materialize(_runs(docs, kinds), "runs")
    id_ = F.coalesce("doc_id", F.lit(_NO_ID))
    across = F.lit(False) if elsewhere is None else F.col("length") == elsewhere
    # As a table of its own, so that Spark can split a leader that many runs share when it joins them.
    twice = storage.materialize(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    packed = storage.materialize(runs.join(twice, "key"), "met")
    storage.release(runs, twice)
    met = _unpacked(packed, kinds)
    # Contents first: equal runs fold in tasks, and no leader's runs meet in one.
    one = F.min(F.struct("doc_id", "name", "n_bytes", "begin", "windows", "lead", "length")).alias("r")
    contents = met.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(id_).alias("low"), F.max(id_).alias("high"), one)
    contents = storage.materialize(contents.select("key", "content", "n", "low", "high", "r.*"), "contents")
    keys = contents.groupBy("key").agg(F.count("*").alias("contents"), F.first("length").alias("length"), F.min("low").alias("low"), F.max("high").alias("high"))
    keys = storage.materialize(keys.where(~across | (F.col("low") < F.col("high"))).select("key", "contents"), "keys")
    covered = [F.col("begin").alias("first"), (F.col("begin") + F.col("windows") - 1 + F.col("length")).alias("last")]
    whole = met.join(keys.where("contents = 1").select("key"), "key").select("name", "n_bytes", "length", *covered)
    mixed = contents.join(keys.where("contents > 1"), "key").withColumn("alone", F.when(across, F.col("low") == F.col("high")).otherwise(F.col("n") == 1))
    mixed = storage.materialize(mixed.withColumn("step", F.when(F.col("contents") > MANY, FINE_STEP).otherwise(STEP)), "mixed")
    part = F.struct(F.lit(0).alias("first"), (F.col("windows") - 1 + F.col("length")).alias("last"))
    edges = _edges(docs, mixed, elsewhere).groupBy("key", "content").agg(F.collect_set(F.struct("first", "last")).alias("parts"))
    parts = storage.materialize(mixed.where("NOT alone").select("key", "content", F.array(part).alias("parts")).unionAll(edges), "parts")
    inner = met.join(parts, ["key", "content"]).select("name", "n_bytes", "length", "begin", F.explode("parts").alias("p"))
    inner = inner.select("name", "n_bytes", "length", (F.col("begin") + F.col("p.first")).alias("first"), (F.col("begin") + F.col("p.last")).alias("last"))
    spans = whole.unionAll(inner)
    spans = storage.materialize(spans.groupBy("name", "n_bytes").agg(F.collect_set(F.struct("length", "first", "last")).alias("spans")), "spans")
    storage.release(packed, contents, keys, mixed, parts)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, kinds: dict[int, int], elsewhere: int | None = None) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with their ``spans``; null where nothing repeats."""
    spans = repeated_spans(docs.select("doc_id", "text"), kinds, elsewhere)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    names = [F.col("row"), F.col("text")]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_text_name(r) for r in raw], pa.int64()), pa.array([len(r) for r in raw], pa.int64())], ["row", "name", "n_bytes"])

    kind = named.schema["row"].dataType.simpleString()
    return named.select(*names).mapInArrow(name, f"row {kind}, name long, n_bytes long").join(spans, ["name", "n_bytes"], "left").select("row", "spans")


def removals(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, short: int = SHORT, short_gram: int = SHORT_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; and n_shared: its bytes in
    passages of about ``short`` bytes or more which another document holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"]
        for batch in batches:
            row = batch.column(0)
            out: list[list] = [[] for _ in names[1:]]
            for text, spans in zip(row.field("text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                cuts, shared = (merged([(s["first"], s["last"]) for s in spans or () if s["length"] == n]) for n in (length, short))
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                for o, v in zip(out, (len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in shared)), strict=True):
                    o.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([row.field("doc_id"), *(pa.array(o, k) for o, k in zip(out, types, strict=True))], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(slim, {length: gram, short: short_gram}, short).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")


def drop_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows and columns of ``docs`` with repeated bytes taken out of ``text``;
    a character that loses a byte goes whole."""

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column(0), []
            for text, spans in zip(row.field("text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                if spans:
                    raw, at, kept = text.encode(), 0, []
                    for a, b in merged([(s["first"], s["last"]) for s in spans]):
                        kept.append(raw[at:a].decode("utf-8", "ignore"))
                        at = b
                    text = "".join([*kept, raw[at:].decode("utf-8", "ignore")])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_spans(docs, {length: gram}).mapInArrow(run, docs.schema)
