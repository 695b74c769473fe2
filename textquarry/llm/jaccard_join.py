"""Jaccard similarity join on word shingles: candidates share prefix tokens under several global token orders, then are verified exactly.

The first order puts shingles that many documents share last (their class, from counts over the whole corpus). Two sets that reach the
threshold share a token of their prefixes under any one order; the first order finds candidates by an equi-join on that token, with the bounds
that sizes, positions and a 1024-bit parity sketch of each set give. What is left is intersected with two more orders (hashes up and down):
both prefixes have to share a token there too. Only then are whole sets compared.

Only connectivity is asked for, so tokens of more than SMALL documents are taken in steps: their documents against a few leaders of each token
(each document against the likeliest of them), which joins most copies. Then come all pairs of any token that still lie in different components,
for the larger tokens each pair at its first shared token. A pair is skipped only when its ends are already connected by verified links, so
components are those of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.llm.components import components
from textquarry.llm.scratch import by_key, discard, stored
from textquarry.llm.words import LOWER, mixed, slices, span_hashes, spans

SHINGLE = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 75, 100
#: log2 of the counters that tell shared shingles from rare ones. More counters tell them apart in larger corpora; any number gives the same links.
SKETCH_BITS = 24
_BLOCK_BITS = 16
#: log2 of the bits of a filter of ids: eight for each id, within these bounds. A filter only spares work.
_ID_BITS = (16, 26)
#: Leaders of each token in each step.
LEADERS = (4, 8)
#: Tokens of at most so many documents have no leaders.
SMALL = 4
#: A pair is taken at its first shared large token if that is among so many first ones of both ends.
FIRSTS = 8
#: 64-bit words of a set's parity sketch: bit i tells whether an odd number of its tokens hash to i.
PARITY_WORDS = 16
#: Sets of so many tokens have a second sketch of so many words, since small ones say little about large sets. A larger one folds to a smaller.
WIDE = ((512, 64), (2048, 256))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the k-word shingles of each text, repeats included; a text of fewer words is one shingle, one without words has none."""
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    begins = np.cumsum(n) - n
    first = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :]) if len(rows) >= k else np.zeros(0, np.int64)
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[first + j]
    few = np.flatnonzero((n > 0) & (n < k))
    g = np.zeros(len(few), np.uint64)
    for j in range(k - 1):
        more = n[few] > j
        g = np.where(more, g * np.uint64(0x9FB21C651E98DF25) + words[np.minimum(begins[few] + j, max(len(words) - 1, 0))], g) if len(words) else g
    g = g + n[few].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    row, h = np.concatenate([rows[first], few]), mixed(np.concatenate([h, g]))
    return row, h


def _ordered(row: np.ndarray, h: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then `before`, then hash."""
    order = np.lexsort((h, *before, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _positions(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(row, minlength=n)
    return size, np.arange(len(row)) - (np.cumsum(size) - size)[row]


def _prefix(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return size - (num * size + den - 1) // den + 1


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


class _Ids:
    """A filter of ids as a bit for each hash: never misses one of them, and its size is bounded however many there are."""

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = min(max(int(8 * n).bit_length(), _ID_BITS[0]), _ID_BITS[1])
        slot = F.pmod("slot", F.lit(1 << self.bits))
        words = ids.select(F.xxhash64(column).alias("slot")).select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def has(self, rows: pa.RecordBatch) -> np.ndarray:
        """For each row whether its slot (xxhash64 of its id) is that of one of the ids."""
        s = np.asarray(rows.column("slot")) & ((1 << self.bits) - 1)
        return (self.words[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) > 0


def _parities(row: np.ndarray, h: np.ndarray, n: int, words: int) -> np.ndarray:
    """n x words; sets differ in at least as many tokens as their parities differ in bits."""
    at = row * (words * 64) + (mixed(h ^ np.uint64(0x94D049BB133111EB)) % np.uint64(words * 64)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, words)


def _wide(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """The second sketch of each set, empty for small sets."""
    level = np.searchsorted([least for least, _ in WIDE], size, "right")
    n = np.array([0, *(words for _, words in WIDE)])[level]
    ends = np.cumsum(n)
    out = np.zeros(int(n.sum()), np.int64)
    for i, (_, words) in enumerate(WIDE, 1):
        for one in np.flatnonzero(level == i):
            mine = slice(*np.searchsorted(row, [one, one + 1]))
            out[ends[one] - words : ends[one]] = _parities(np.zeros(mine.stop - mine.start, np.int64), h[mine], 1, words)[0]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))


_SURVEY = ["kind", "key", "n", "s1", "s2", "counts", "wide", *(f"p{i}" for i in range(PARITY_WORDS))]


def _survey(docs: DataFrame, sketch_bits: int) -> DataFrame:
    """One pass: a row (kind 0) with size, signature and parities of each document's set, and (kind 1) blocks of counters of each partition: how
    many of its documents have a shingle of that hash, 255 standing for more."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << sketch_bits, np.uint8)
        for rows, data, offsets in slices(batches, "text"):
            row, h = _ordered(*shingles(data, offsets))
            at, c = np.unique((h >> np.uint64(64 - sketch_bits)).astype(np.uint32), return_counts=True)
            seen[at] = np.minimum(seen[at] + c, 255)
            m = rows.num_rows
            size = np.bincount(row, minlength=m)
            ends = np.cumsum(size)
            sums = []
            for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A35)):
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mixed(h ^ salt), out=total[1:])
                sums.append(_signed(total[ends] - total[ends - size]))
            parities = [pa.array(np.ascontiguousarray(c)) for c in _parities(row, h, m, PARITY_WORDS).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), rows.column("doc_id"), pa.array(size.astype(np.int32)), *sums, pa.nulls(m, pa.binary()), _wide(row, h, size), *parities], _SURVEY)
        for k in range(0, 1 << sketch_bits, 1 << _BLOCK_BITS):
            block = seen[k : k + (1 << _BLOCK_BITS)]
            if block.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k >> _BLOCK_BITS]), pa.nulls(1, pa.int32()), none, none, pa.array([zlib.compress(block.tobytes(), 1)], pa.binary()), pa.nulls(1, pa.list_(pa.int64())), *([none] * PARITY_WORDS)], _SURVEY)

    return docs.mapInArrow(part, "kind int, key long, n int, s1 long, s2 long, counts binary, wide array<long>, " + ", ".join(f"p{i} long" for i in range(PARITY_WORDS)))


def _adder(kind: type):
    def added(batches: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), kind).astype(np.int64) for x in batches.column("counts").to_pylist())
        return pa.table({"key": batches.column("key")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    return added


def _classes(survey: DataFrame, sketch_bits: int) -> tuple[np.ndarray, int]:
    """For each counter the class of its shingles, 8 times the log2 of the count, and the class from which shingles are surely shared. Blocks are
    added up in two steps, a few dozen partitions' at a time first, and one byte for each counter comes back."""
    blocks = survey.where("kind = 1").select("key", "counts")
    most = blocks.groupBy("key").agg(F.count("*").alias("m")).agg(F.coalesce(F.max("m"), F.lit(1))).first()[0]
    first = blocks.groupBy("key", F.pmod(F.xxhash64("counts"), F.lit(-(-most // 32))).alias("some")).applyInArrow(_adder(np.uint8), "key long, counts binary")
    summed = stored(first.groupBy("key").applyInArrow(_adder(np.int64), "key long, counts binary"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(zlib.decompress(x), np.int64).sum()) for x in batch.column("counts").to_pylist()], pa.int64())], ["c"])

    total = summed.select("counts").mapInArrow(totals, "c long").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    shared = int(8 * np.log2(16 + 4 * total / (1 << sketch_bits)))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("counts").to_pylist():
                c = np.frombuffer(zlib.decompress(x), np.int64)
                found.append(np.minimum(8 * np.log2(np.maximum(c, 1)), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "kinds"])

    out = np.zeros(1 << sketch_bits, np.uint8)
    for key, kinds in summed.mapInArrow(classed, "key long, kinds binary").collect():
        out[key << _BLOCK_BITS : (key << _BLOCK_BITS) + len(kinds)] = np.frombuffer(kinds, np.uint8)
    return out, shared


def _prefixes(docs: DataFrame, classes, wanted, sketch_bits: int, num: int, den: int) -> DataFrame:
    """(token, doc, packed) for the prefix of each wanted document under the first order. packed holds, from the top, a salt (0 for rare
    shingles), the set's size and the token's position."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            row, h = shingles(data, offsets)
            some = wanted.value.has(rows)[row]
            row, h = row[some], h[some]
            kinds, least = classes.value
            kind = kinds[(h >> np.uint64(64 - sketch_bits)).astype(np.int64)]
            row, h = _ordered(row, h, kind)
            size, pos = _positions(row, rows.num_rows)
            head = pos < _prefix(size, num, den)[row]
            row, h, pos = row[head], h[head], pos[head]
            shared = kinds[(h >> np.uint64(64 - sketch_bits)).astype(np.int64)] > least
            doc = rows.column("doc_id").take(pa.array(row))
            salt = np.where(shared, 1 + np.asarray(rows.column("slot"))[row] % 63, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_signed(h), doc, pa.array((salt << 56) | (size[row] << 28) | pos)], ["token", "doc", "packed"])

    return docs.mapInArrow(part, "token long, doc long, packed long")


def _sets(docs: DataFrame, wanted, num: int, den: int) -> DataFrame:
    """(doc, low, high, tokens): the whole set of each wanted document, ascending, and its prefixes under the orders of hashes up and down (the
    upper 32 bits of their tokens, so that the filter is small)."""

    def lists(n: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            mine = np.flatnonzero(wanted.value.has(rows))
            row, h = shingles(data, offsets)
            some = np.isin(row, mine)
            order = np.lexsort((h[some].view(np.int64), row[some]))
            row, h = row[some][order], h[some][order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new].view(np.int64)
            size, pos = _positions(row, rows.num_rows)
            upper, prefix = (h >> 32).astype(np.int32), np.where(size > 0, _prefix(size, num, den), 0)
            low, high = pos < prefix[row], pos >= (size - prefix)[row]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(mine)), lists(prefix[mine], pa.array(upper[low])), lists(prefix[mine], pa.array(upper[high])), lists(size[mine], pa.array(h))], ["doc", "low", "high", "tokens"]
            )

    return docs.mapInArrow(part, "doc long, low array<int>, high array<int>, tokens array<long>")


def _possible(num: int, den: int, a: str, b: str) -> Column:
    """Sizes are near enough and this shared token leaves room for the needed overlap; the pair's first shared token always does."""
    return F.expr(
        f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) and {num + den} * (least({a}.n - {a}.pos, {b}.n - {b}.pos)) >= {num} * ({a}.n + {b}.n)"
    )


def _near(pairs: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose parities leave room for the needed overlap, with the bits in which they differ (apart)."""
    side = lambda c: profiles.select(F.col("doc").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in profiles.columns if x != "doc"])
    apart = " + ".join(f"bit_count(a_p{i} ^ b_p{i})" for i in range(PARITY_WORDS))
    few, many = (words for _, words in WIDE)
    fold = lambda x: f"transform(sequence(0, {few - 1}), i -> {' ^ '.join(f'{x}[i + {k}]' for k in range(0, many, few))})"
    differ = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    wide = (
        f"case when size(a_wide) = 0 or size(b_wide) = 0 then 0 when size(a_wide) = size(b_wide) then {differ('a_wide', 'b_wide')} "
        f"when size(a_wide) > size(b_wide) then {differ(fold('a_wide'), 'b_wide')} else {differ('a_wide', fold('b_wide'))} end"
    )
    room = f"(a_n + b_n - 2 * (({num} * (a_n + b_n) + {num + den} - 1) div {num + den}))"
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("apart", F.expr(apart)).where(F.expr(f"apart <= {room}"))
    return both.withColumn("apart", F.expr(f"greatest(apart, {wide})")).where(F.expr(f"apart <= {room}")).select("a", "b", "apart")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the pairs: those that the two other orders leave, then those whose whole sets reach the threshold."""
    side = lambda c, *columns: sets.select(F.col("doc").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns])
    left = pairs.join(side("a", "low", "high"), "a").join(side("b", "low", "high"), "b")
    left = stored(left.where(F.arrays_overlap("a_low", "b_low") & F.arrays_overlap("a_high", "b_high")).select("a", "b"))
    both = left.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    sizes = both.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("o"), (F.size("a_tokens") + F.size("b_tokens")).alias("s"))
    links = stored(sizes.where(F.expr(f"{den} * o >= {num} * (s - o)")).select("a", "b"))
    discard(left)
    return links


def _checked(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the (stored) pairs. Sets are made for their documents only."""
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(_Ids(ends, "doc"))
    with by_key(_sets(docs, wanted, num, den), "doc") as sets:
        return _verified(pairs, sets, num, den)


def _rooted(prefixes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return prefixes
    return prefixes.drop("root").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def _open(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """The prefix rows, with their documents' roots, of tokens whose documents lie in several components. A token that is closed stays so."""
    x = _rooted(prefixes, roots)
    spread = x.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    return stored(x.join(spread, "token", "left_semi"))


def _led_pairs(rest: DataFrame, step: int, many: int, num: int, den: int) -> DataFrame:
    """(document, leader) of one token and different components; a token's leaders are the `many` first by a hash of their ids."""
    fields = ["doc", "n_pos"] if step == 0 else ["doc", "n_pos", "root"]  # at first each document is its own root
    packed = rest.withColumn("n_pos", F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos"))
    best = [F.min_by(F.struct(*fields), F.xxhash64("doc", F.lit(f"{step}.{k}"))) for k in range(many)]
    led = packed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array_distinct(F.array(*best)).alias("l")).where("low < high").select("token", "l")
    led = led.select("token", F.explode("l").alias("l")).select("token", "l.doc", F.shiftright("l.n_pos", 32).alias("n"), F.expr("cast(l.n_pos & 2147483647 as int)").alias("pos"), F.col(f"l.{fields[-1]}" if step else "l.doc").alias("root"))
    found = rest.alias("x").join(led.alias("l"), "token").where("x.root <> l.root").where(_possible(num, den, "x", "l"))
    return found.select(F.col("x.doc").alias("a"), F.col("l.doc").alias("b")).distinct()


def _pairs_of_tokens(rest: DataFrame, num: int, den: int, at_first: bool) -> DataFrame:
    """All pairs of one token and different components. Tokens are in one order for all documents, so `at_first`: where both ends have the pair's
    first shared token among their FIRSTS first ones, the pair is taken there only."""
    if at_first:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
        rest = rest.join(rest.groupBy("doc").agg(F.slice(ordered, 1, FIRSTS).alias("firsts")), "doc")
    found = rest.alias("x").join(rest.alias("y"), "token").where("x.doc < y.doc and x.root <> y.root").where(_possible(num, den, "x", "y"))
    if at_first:
        found = found.where("coalesce(try_element_at(array_intersect(x.firsts, y.firsts), 1) = token, true)")
    return found.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def links_for_components(docs: DataFrame, survey: DataFrame, sketch_bits: int = SKETCH_BITS, num: int = NUM, den: int = DEN, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """(node, root) over representatives of equal sets."""
    sc = docs.sparkSession.sparkContext
    sets = survey.where("kind = 0 and n > 0 and key is not null")
    unique = sets.groupBy("n", "s1", "s2").agg(F.min("key").alias("doc"), F.first("wide").alias("wide"), *[F.first(f"p{i}").alias(f"p{i}") for i in range(PARITY_WORDS)]).drop("s1", "s2")
    with by_key(unique, "doc") as profiles:
        classes = sc.broadcast(_classes(survey, sketch_bits))
        docs = docs.where("doc_id is not null").withColumn("slot", F.xxhash64("doc_id"))
        first = sc.broadcast(_Ids(profiles, "doc"))
        every = _prefixes(docs, classes, first, sketch_bits, num, den).withColumn("salt", F.shiftright("packed", 56))
        # rare shingles have few documents by their class; shared ones are not counted, only dealt out
        shared = every.withColumn("m", F.count("*").over(Window.partitionBy("token", "salt"))).where("m > 1 or salt > 0")
        low28 = F.lit((1 << 28) - 1)
        shared = shared.select("token", "doc", F.shiftright("packed", 28).bitwiseAND(low28).cast("int").alias("n"), F.col("packed").bitwiseAND(low28).cast("int").alias("pos"), F.expr(f"m > {SMALL} or salt > 0").alias("large"))
        every = stored(shared.join(profiles.select("doc"), "doc", "left_semi").withColumn("root", F.col("doc")))
        large, small = every.where("large"), every.where("not large")
        links = roots = None
        for step, many in enumerate(leaders):
            near = _near(_led_pairs(large, step, many, num, den), profiles, num, den)
            found = stored(near.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")))
            if found.isEmpty():
                break
            got = _checked(found, docs, num, den)
            discard(found)
            links = got if links is None else links.union(got)
            roots = components(links, rounds=2)
            before, large = large, _open(large, roots)
            discard(before)
        pairs = _pairs_of_tokens(large, num, den, True).union(_pairs_of_tokens(_rooted(small, roots), num, den, False)).distinct()
        found = stored(_near(pairs, profiles, num, den).select("a", "b"))
        if not found.isEmpty():
            got = _checked(found, docs, num, den)
            links = got if links is None else links.union(got)
        discard(found, every, large)
        return components(found.limit(0) if links is None else links)


def link(docs: DataFrame, sketch_bits: int = SKETCH_BITS, num: int = NUM, den: int = DEN, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links lead to, itself included. Documents with equal sets are one representative throughout. A
    document without words or text, or with a null id, links with nothing (component_id is its own id); rows that repeat an id with other
    texts link through any of them. Other columns of `docs` are ignored, whatever their names. `doc_id` has to be an integer.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = stored(_survey(docs, sketch_bits))
    roots = links_for_components(docs, survey, sketch_bits, num, den, leaders)
    mine = survey.where("kind = 0").select(F.col("key").alias("doc_id"), "n", "s1", "s2")
    reps = mine.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    rows = mine.join(reps, ["n", "s1", "s2"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    rows = rows.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("rep", F.coalesce("root", "rep"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("component_id"))


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs`, all columns, whose document is its component's smallest id; rows that repeat an id stay or go together."""
    stay = link(docs, **options).where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi")


