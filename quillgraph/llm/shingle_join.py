"""Exact n-gram Jaccard join over a token-group matrix.

A document's tokens are the hashes of its distinct word 5-grams.  Documents with the
same set form one class.  The join then runs on classes:

* a fixed total order puts rare tokens first, by a count sketch of all words of the
  corpus; only the prefix of that order that any partner must meet is posted;
* similar documents are partitioned into groups: postings of a token point to one
  pivot, the pairs (document, pivot) are verified, and what they connect is a group;
* the matrix stores, for every token, the groups whose token union holds it; for a
  query document of another group the number of shared tokens bounds its overlap
  with every member, and only groups that the bound lets through are opened:
  their members' whole sets are indexed in blocks and counted exactly.

Pairs inside a group need no opening, since its members are already connected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, freeing, materialize, small_batches

#: Words in a shingle, similarity as a ratio of whole numbers, cells of the word
#: sketch (one byte each: the size of its broadcast), bits of the id filter, and the
#: power of two of the bits of each of the two token filters (16 MB).
WORDS, NUM, DEN = 5, 3, 4
CELLS, FILTER_BITS, TOKEN_BITS = 1 << 24, 1 << 24, 27
CHUNKS, STEP = 256, 256
#: Tokens of a block of members, or of documents, when a group is opened; and the parts
#: that rows of one group are dealt into where they meet what is known of the group.
LOAD, SALTS = 1 << 19, 16
MAX_WORDS_KEPT = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASHES: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased; bytes.split knows exactly ASCII white space."""
    return (text or "").encode().lower().split()


def _forget() -> None:
    _HASHES.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, through a bounded table of the words that a task has seen."""
    if len(_HASHES) > MAX_WORDS_KEPT:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hash of every window of n words (of the whole sequence if shorter), in text order."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):  # words' hashes are well mixed already; one polynomial over them is enough
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return _finish(out)


def token_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(word_hashes(words_of(text))))


def set_key(tokens: np.ndarray) -> int:
    """One signed 64-bit key of a set; its size is kept beside it."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_len(n: Column | np.ndarray | int):
    """Leading tokens of which a partner at the threshold must share one: n - ceil(3n/4) + 1."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _step(batches, column: int):
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            p = b.slice(at, STEP)
            yield p, p.column(column).to_pylist()


def cells_of(h: np.ndarray) -> np.ndarray:
    return (_finish(h) >> np.uint64(40)).astype(np.int64)  # 24 bits


def describe(df: DataFrame) -> DataFrame:
    """One pass over the texts, two kinds of rows.

    (id, n, key): set size and set key of every document, with cell null; and
    (cell, c): occurrences of words by hash cell, summed within the task as far as a
    bound on memory allows, with id null.
    """
    names = ["id", "n", "key", "cell", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0

        def flush():
            cell, count = np.unique(np.concatenate(pending), return_counts=True)
            none = pa.nulls(len(cell), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(cell.astype(np.int32)), pa.array(count.astype(np.int64))], names=names)

        for p, texts in _step(batches, 1):
            hashes = [word_hashes(words_of(t)) for t in texts]
            sets = [np.unique(shingles(h)) for h in hashes]
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), none.cast(pa.int32()), none], names=names)
            pending += [cells_of(h) for h in hashes]
            held += sum(map(len, hashes))
            if held > 4_000_000:
                yield flush()
                pending, held = [], 0
        if held:
            yield flush()

    return df.select("id", "text").mapInArrow(freeing(run, _forget), "id long, n long, key long, cell int, c long")


def _packed(rows: DataFrame, cell: str, cells: int, level) -> np.ndarray:
    """A table of ``cells`` bytes from (cell, c): level(c) at each cell.

    Chunks are packed on executors; what reaches the driver is the table, of fixed size.
    """
    width = cells // CHUNKS

    def pack(group: pa.Table) -> pa.Table:
        at, c = group.column(cell).to_numpy(), group.column("c").to_numpy()
        part = np.zeros(width, np.uint8)
        part[at % width] = level(c)
        return pa.table({"chunk": pa.array([int(at[0]) // width], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    packed = rows.select(cell, "c", (F.col(cell) / width).cast("int").alias("chunk")).groupBy("chunk").applyInArrow(pack, "chunk int, data binary")
    out = np.zeros(cells, np.uint8)
    for row in packed.toLocalIterator():
        out[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(bytes(row.data), np.uint8)
    return out


def _level(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 127, c, 128 + np.minimum(127, np.floor(4 * np.log2(np.maximum(c, 128) / 128)).astype(np.int64)))


def word_sketch(counts: DataFrame) -> np.ndarray:
    """Occurrences of all words of all documents by hash cell, one byte each.

    A cell's count is never below that of a word in it.  Counts up to 127 are exact,
    larger ones are kept on a logarithmic scale.
    """
    return _packed(counts.groupBy("cell").agg(F.sum("c").alias("c")), "cell", CELLS, _level)


def ordered_prefix(text: str | None, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Prefix tokens that another document could hold, their places, the set's size and its key.

    Order: rarest word's count, then the token.  A token with a word that occurs once
    in the whole corpus is in no other document, so it takes its place in the prefix
    but is not posted.
    """
    h = word_hashes(words_of(text))
    s = shingles(h)
    if not len(s):
        return s, s, 0, 0
    level = sketch[cells_of(h)]
    width = min(WORDS, len(h))
    rare = level[: len(s)].copy()
    for k in range(1, width):
        np.minimum(rare, level[k : k + len(s)], out=rare)
    tokens, first = np.unique(s, return_index=True)
    rare = rare[first]
    order = np.argsort(rare, kind="stable")[: prefix_len(len(tokens))]  # tokens are sorted already
    places = np.flatnonzero(rare[order] > 1)
    return tokens[order[places]], places, len(tokens), set_key(tokens)


def postings(df: DataFrame, shared) -> DataFrame:
    """(id, key, n, tokens, places) of every document's prefix; shared: the broadcast word sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for p, texts in _step(batches, 1):
            rows = []
            for i, t in zip(p.column(0).to_pylist(), texts, strict=True):
                prefix, places, n, key = ordered_prefix(t, table)
                if len(prefix):
                    rows.append((key, n, prefix.view(np.int64), i, places.astype(np.int32)))
            if rows:
                ends = np.cumsum([0, *[len(r[2]) for r in rows]]).astype(np.int32)
                tokens, places = (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]))) for k in (2, 4))
                yield pa.RecordBatch.from_arrays([pa.array([r[3] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), tokens, places], names=["id", "key", "n", "tokens", "places"])

    return df.select("id", "text").mapInArrow(freeing(run, _forget), "id long, key long, n long, tokens array<long>, places array<int>")


def _set_bits(bits: np.ndarray, cell: np.ndarray) -> None:
    """Set the bits of sorted distinct cells in a packed table."""
    if len(cell):
        byte = cell >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        bits[byte[first]] |= np.bitwise_or.reduceat((128 >> (cell & 7)).astype(np.uint8), first)


def _has_bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def token_cell(token: np.ndarray, level: int) -> np.ndarray:
    """Cell of a token in the table of a level: its top bits first, then its low bits."""
    word = token.view(np.uint64)
    return (word >> np.uint64(64 - TOKEN_BITS) if level == 0 else word & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)


def _passing(token: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    hit = np.ones(len(token), bool)
    for level, bits in enumerate(tables):
        hit &= _has_bit(bits, token_cell(token, level))
    return hit


def twice_table(raw: DataFrame, tables: list) -> np.ndarray:
    """Cells of the next level that hold two postings or more, of the tokens that ``tables`` let through.

    Each task keeps two bit tables of fixed size, cells met and cells met twice, and
    sends them compressed by chunk; a chunk's tables are joined as a stream, so neither
    side holds more than a fixed size however many tasks there are.
    """
    width, level = (1 << TOKEN_BITS) // 8 // CHUNKS, len(tables)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        once, twice = np.zeros((CHUNKS, width), np.uint8), np.zeros((CHUNKS, width), np.uint8)
        for b in batches:
            token = b.column(0).flatten().to_numpy()
            cell, count = np.unique(token_cell(token[_passing(token, known)], level), return_counts=True)
            _set_bits(twice.reshape(-1), cell[(count > 1) | _has_bit(once.reshape(-1), cell)])
            _set_bits(once.reshape(-1), cell)
        for k in np.flatnonzero(once.any(axis=1)):
            sent = [[zlib.compress(bits[k].tobytes(), 1)] for bits in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), *(pa.array(x, pa.binary()) for x in sent)], names=["chunk", "once", "twice"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, chunk = np.zeros(width, np.uint8), np.zeros(width, np.uint8), 0
        for b in batches:
            for chunk, *sent in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in sent)
                twice |= t | (once & o)
                once |= o
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["chunk", "data"])

    sent = raw.select("tokens").mapInArrow(freeing(tally), "chunk int, once binary, twice binary")
    out = np.zeros((CHUNKS, width), np.uint8)
    for row in sent.groupBy("chunk").applyInArrow(join, "chunk int, data binary").toLocalIterator():
        out[row.chunk] = np.frombuffer(bytes(row.data), np.uint8)
    return out.reshape(-1)


def met_twice(raw: DataFrame) -> tuple[DataFrame, list]:
    """(id, key, n, tokens, places): only tokens whose hash cells hold two postings or more, at both levels.

    All postings are counted by cell, in a table of fixed size; what passes is counted
    again by other bits of its hash, which removes most of those that met by chance.
    A token of two documents is never lost; some of one document pass, and the exact
    test that follows removes them.  The fuller the tables, the less they save.  With the
    broadcasts that the rows are read through.
    """
    context, tables = raw.sparkSession.sparkContext, []
    for _ in range(2):
        tables.append(context.broadcast(twice_table(raw, tables)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        for b in batches:
            lists = b.column(3)
            lens = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            hit = _passing(token, known)
            left = np.bincount(np.repeat(np.arange(b.num_rows), lens)[hit], minlength=b.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            kept = [pa.ListArray.from_arrays(ends, pa.array(x[hit])) for x in (token, b.column(4).flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *kept], names=["id", "key", "n", "tokens", "places"]).filter(pa.array(left > 0))

    return raw.select("id", "key", "n", "tokens", "places").mapInArrow(freeing(run), "id long, key long, n long, tokens array<long>, places array<int>"), tables


def texts_of(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, object]:
    """(id, text) of the wanted ids, and of a few others that a bit filter of fixed size lets through; and the filter's broadcast.

    The filter keeps unwanted texts out of every shuffle.  It only lets too much
    through when it is full, never too little; the joins that follow are exact.
    """
    wanted = ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("b"))
    width = FILTER_BITS // CHUNKS

    def pack(group: pa.Table) -> pa.Table:
        b = group.column("b").to_numpy()
        part = np.zeros(width, np.uint8)
        part[b % width] = 1
        return pa.table({"chunk": pa.array([int(b[0]) // width], pa.int32()), "data": pa.array([np.packbits(part).tobytes()], pa.binary())})

    packed = wanted.distinct().withColumn("chunk", (F.col("b") / width).cast("int")).groupBy("chunk").applyInArrow(pack, "chunk int, data binary")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in packed.toLocalIterator():
        bits[row.chunk * width // 8 : (row.chunk + 1) * width // 8] = np.frombuffer(bytes(row.data), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            at = b.column(2).to_numpy()
            hit = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            if hit.any():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "text"]).filter(pa.array(hit.astype(bool)))

    src = df.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("b"))
    return src.mapInArrow(freeing(run), "id long, text string"), shared


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold exactly."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def tokens(i: int, text: str) -> np.ndarray:
            if i not in kept:
                if len(kept) > 2000:
                    kept.clear()
                kept[i] = token_set(text)
            return kept[i]

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                p = batch.slice(at, 64)
                rows = zip(*(c.to_pylist() for c in p.columns), strict=True)
                ok = []
                for a, b, ta, tb in rows:
                    x, y = tokens(a, ta), tokens(b, tb)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return with_b.select("a", "b", "ta", "tb").mapInArrow(freeing(run, _forget), "a long, b long")


def _linked(index: tuple[np.ndarray, ...], tokens: np.ndarray) -> np.ndarray:
    """Places of the indexed members whose sets reach the threshold with this one."""
    known, owner, sizes = index
    lo = np.searchsorted(known, tokens, "left")
    met = np.searchsorted(known, tokens, "right") - lo
    at = np.repeat(lo - np.cumsum(met) + met, met) + np.arange(met.sum())
    both = np.bincount(owner[at], minlength=len(sizes))
    return np.flatnonzero(DEN * both >= NUM * (len(tokens) + sizes - both))


def _of_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows (g, id or token, ...) joined with groups (g, ...): a large group's rows go to SALTS parts."""
    by = "id" if "id" in rows.columns else "token"
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # never broadcast: copies compress so well that their size in a shuffle tells little of that in memory
    return salted.join(copies.hint("merge"), ["g", "salt"], how).drop("salt")


def open_groups(docs: DataFrame, opened: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): for each opened (document a, group g) and block of members, the first member b that links.

    Whole sets are counted exactly through an index of the block's tokens, and pairs
    that do not link are never rows.  Members and documents of a group are dealt into
    blocks of about ``LOAD`` tokens, so that neither memory nor a task grows with a
    group; one link to a group is enough to connect the document with all of it.
    """
    wanted = members.select("id").unionByName(opened.select(F.col("a").alias("id")))
    texts, shared = texts_of(docs, wanted)
    sets = materialize(_token_sets(texts.dropDuplicates(["id"])), "tokens", shared)
    asking = opened.groupBy("g").agg(F.ceil(F.sum("na") / LOAD).cast("int").alias("askers"))
    holding = members.groupBy("g").agg(F.ceil(F.sum("n") / LOAD).cast("int").alias("holders"))
    blocks = materialize(asking.join(holding, "g"), "blocks")

    def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        block = {own: F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        return _of_group(rows, blocks).select("g", block["holders"].alias("holder"), block["askers"].alias("asker"), F.lit(side).alias("side"), "id")

    rows = dealt(members.select("g", "id"), 0, "holders", "askers").unionByName(dealt(opened.select("g", F.col("a").alias("id")), 1, "askers", "holders"))
    run_of = ["g", "holder", "asker"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index = None, [], None
        for batch in batches:
            found = []
            for *key, side, i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    current, held, index = key, [], None
                tokens = np.frombuffer(data, np.uint64)
                if side == 0:
                    held.append((i, tokens))
                    continue
                if not held:  # hashing dealt this block no member
                    continue
                if index is None:
                    sizes, known = np.array([len(t) for _, t in held]), np.concatenate([t for _, t in held])
                    order = np.argsort(known, kind="stable")
                    index = known[order], np.repeat(np.arange(len(held)), sizes)[order], sizes
                found += [(i, held[k][0]) for k in _linked(index, tokens)[:1]]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    loaded = rows.join(sets, "id").select(*run_of, "side", "id", "tokens")
    found = loaded.repartition(*run_of).sortWithinPartitions(*run_of, "side", "id").mapInArrow(freeing(run), "a long, b long")
    links = materialize(found, "links")
    discard(sets, blocks)
    return links


def _token_sets(texts: DataFrame) -> DataFrame:
    """(id, tokens): every text's set, as the bytes of its sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, texts in _step(batches, 1):
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array([token_set(t).tobytes() for t in texts], pa.binary())], names=["id", "tokens"])

    return texts.select("id", "text").mapInArrow(freeing(run, _forget), "id long, tokens binary")


def components(links: DataFrame) -> DataFrame:
    """(v, c): every linked vertex and the smallest vertex that it reaches.

    Each round takes the smallest label among neighbours and jumps to that label's
    own label; rounds end when nothing changes.  Labels are written each round.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("c")), "labels")
    written = labels
    while True:
        near = edges.join(labels, "v").groupBy("u").agg(F.min("c").alias("m"))
        low = labels.join(near, labels.v == near.u, "left").select("v", "c", F.least("c", "m").alias("d"))
        jump = low.select(F.col("v").alias("w"), F.col("d").alias("e"))
        new = low.join(jump, low.d == jump.w, "left").select("v", F.least("d", "e").alias("c"), (F.least("d", "e") < F.col("c")).alias("moved"))
        new = materialize(new, "labels")
        done = new.where("moved").isEmpty()
        discard(written)
        labels, written = new.select("v", "c"), new
        if done:
            discard(edges)
            return labels


def needed(na: Column, nb: Column) -> Column:
    """Fewest shared prefix tokens of a pair at the threshold.

    The intersection holds at least 3/7 of both sizes.  Tokens past the end of the
    prefix that ends first are at most its document's rest, ceil(3n/4) - 1.
    """
    both = F.ceil((na + nb) * NUM / (NUM + DEN))
    rest = F.ceil(F.greatest(na, nb) * NUM / DEN) - 1
    return F.greatest(F.lit(1), both - rest)


def fewest(n: Column, lo: Column, hi: Column) -> Column:
    """The least of ``needed`` over all sizes from lo to hi, exactly.

    Up to n it grows with the other size.  Beyond, it falls by 9/28 a token but for the
    two ceilings, so an inner size can need fewer than hi only if it is within 3 of it.
    """
    return F.least(needed(n, lo), *[needed(n, F.greatest(lo, hi - k)) for k in range(4)])


def in_reach(na: Column, nb: Column) -> Column:
    return (NUM * na <= DEN * nb) & (NUM * nb <= DEN * na)


def early(place_a: str, na: str, place_b: str, nb: str, x: Column) -> Column:
    """Whether a shared token stands where it can be one of the first x shared tokens.

    With an intersection of o tokens, at least x of them lie within the first n - o + x
    places of both documents, for any x from 1 to ``needed``.
    """
    out = F.ceil((F.col(na) + F.col(nb)) * NUM / (NUM + DEN)) - x
    return (F.col(place_a) < F.col(na) - out) & (F.col(place_b) < F.col(nb) - out)


def _by_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """jaccard_components where one id stands on different texts: by ids of (id, text), named by ids again."""
    rows = docs.select("id", F.xxhash64("id", "text").alias("row"), "text")
    found = jaccard_components(rows.select("row", "text"), "row")
    found = materialize(found.select(F.col("row").alias("r"), "n_shingles", F.col("component_id").alias("c")).dropDuplicates(["r"]), "rows")
    met = materialize(rows.select("id", "row").join(found, F.col("row") == F.col("r")).select("id", "n_shingles", "c"), "named")
    first = met.groupBy("c").agg(F.min("id").alias("component_id"))
    return met.join(first, "c").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Documents link when 100 * |intersection| >= 75 * |union| of their shingle sets;
    component_id is the smallest id reachable by links.

    Edge cases: null and empty texts have an empty set and link with nothing; shorter
    texts than five words have one shingle; equal sets (exact copies among them) are one
    class and never expanded into pairs; repeated rows share a component; one id on
    different texts is a document for each text; an empty table gives an empty result;
    other columns are ignored.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = materialize(describe(docs), "sets")
    facts = materialize(described.where("cell IS NULL").select("id", "n", "key"), "facts")
    one_set = F.struct("key", "n")
    if not facts.where("n > 0").groupBy("id").agg(F.min(one_set).alias("p"), F.max(one_set).alias("q")).where("p <> q").isEmpty():
        discard(described, facts)
        return _by_rows(docs, id_col)
    classes = materialize(facts.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("id")), "classes")
    sketch = docs.sparkSession.sparkContext.broadcast(word_sketch(described.where("cell IS NOT NULL").select("cell", "c")))
    discard(described)

    written = materialize(postings(docs, sketch), "postings", sketch)
    raw, tables = met_twice(written)
    # one document stands for its class; its whole posting list travels as one row
    ids = classes.select(F.xxhash64("key", "n").alias("k"), F.col("id").alias("first"))
    own = raw.withColumn("k", F.xxhash64("key", "n")).join(ids, "k").where(F.col("id") == F.col("first")).dropDuplicates(["id"])
    posted = materialize(own.select("id", "n", F.explode(F.arrays_zip("tokens", "places")).alias("at")).select("id", "n", F.col("at.tokens").alias("token"), F.col("at.places").alias("place")), "posted", *tables)
    discard(written)
    del raw, own, sketch, tables
    # pivots of a token: the documents of the first id, the last one, and the first by hash.
    # Aggregated by the token and joined by its complement: the join then has a shuffle of
    # its own, in which a frequent token can be split
    one, flip = F.struct("id", "n"), F.bitwise_not("token").alias("flip")
    ends = posted.groupBy("token").agg(F.min(one).alias("p"), F.max(one).alias("q"), F.min(F.struct(F.xxhash64("id"), "id", "n")).alias("r")).where("p.id < q.id")
    ends = ends.select(flip, "p", "q", F.struct("r.id", "r.n").alias("r"))
    met = posted.select(flip, "place", "id", "n").join(ends, "flip").select(F.bitwise_not("flip").alias("token"), "place", "id", "n", "p", "q", "r")
    met = materialize(met, "met")
    discard(posted)

    # groups: documents verified against their tokens' pivots
    stars = (
        met.select("id", "n", F.explode(F.array_distinct(F.array("p", "q", "r"))).alias("p"))
        .select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("p.id").alias("b"), F.col("p.n").alias("nb"))
        .where((F.col("a") != F.col("b")) & in_reach(F.col("na"), F.col("nb")))
        .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"))
        .where(F.col("m") >= needed(F.col("na"), F.col("nb")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    stars = materialize(stars, "stars")
    texts, shared = texts_of(docs, stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))))
    texts = materialize(texts, "texts", shared)
    links = materialize(verify(stars, texts.dropDuplicates(["id"])), "links")
    discard(stars, texts)
    groups = components(links)

    # the matrix: tokens by groups that hold them, with the sizes of their members
    known = groups.select(F.col("v").alias("gv"), F.col("c").alias("gc"))
    member = met.join(known, met.id == known.gv, "left").select("token", "place", "id", "n", F.coalesce("gc", "id").alias("g"), F.col("gc").isNotNull().alias("linked"))
    mixed = member.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select(flip)
    member = member.select(flip, "place", "id", "n", "g", "linked").join(mixed, "flip", "left_semi").select(F.bitwise_not("flip").alias("token"), "place", "id", "n", "g", "linked")
    member = materialize(member, "member")
    discard(met)
    # a document without a link is a group by itself, of which all is known; the others look theirs up
    linked, alone = member.where("linked"), member.where("NOT linked")
    one = [F.lit(1).cast("long").alias("size"), F.col("n").alias("lo"), F.col("n").alias("hi")]
    size = linked.groupBy("g", "id").agg(F.max("n").alias("n")).groupBy("g").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    size = materialize(size, "sizes")
    unions = linked.groupBy("token", "g").agg(F.min("place").alias("gplace"))
    matrix = _of_group(unions, size).select("token", "g", "gplace", "size", "lo", "hi").unionByName(alone.select("token", "g", F.col("place").alias("gplace"), *one))
    asks = ["token", "place", "id", "n", F.col("g").alias("own"), F.col("size").alias("own_size")]
    query = _of_group(linked, size.select("g", "size")).select(*asks).unionByName(alone.withColumn("size", F.lit(1).cast("long")).select(*asks))
    lo, hi = F.greatest(F.col("lo"), F.ceil(F.col("n") * NUM / DEN)), F.least(F.col("hi"), F.floor(F.col("n") * DEN / NUM))
    # a group of one document: both sizes are known, so half of the needed tokens are looked
    # for in shorter prefixes, which leaves out the most frequent tokens of both
    single, half = F.col("size") == 1, F.ceil(needed(F.col("n"), F.col("lo")) / 2)
    near = ~single | early("place", "n", "gplace", "lo", half)
    opened = (
        query.join(matrix, "token")
        .where((F.col("own") != F.col("g")) & (F.struct("own_size", "own") < F.struct(F.col("size"), F.col("g"))) & (lo <= hi) & near)
        .groupBy("id", "n", "g", "size", "lo", "hi").agg(F.count("*").alias("m"))
        .where(F.col("m") >= F.when(single, half).otherwise(fewest(F.col("n"), lo, hi)))
        .select(F.col("id").alias("a"), F.col("n").alias("na"), "g")
    )
    opened = materialize(opened, "opened")
    members = materialize(_of_group(member.select("g", "id", "n").distinct(), opened.select("g").distinct(), "left_semi"), "members")
    discard(member, size)
    if not opened.isEmpty():
        more = open_groups(docs, opened, members)
        if not more.isEmpty():
            groups = components(links.unionByName(more))
    discard(opened, members)

    named = classes.join(groups, classes.id == groups.v, "left").select(F.xxhash64("key", "n").alias("k"), F.coalesce("c", "id").alias("component"))
    out = facts.withColumn("k", F.xxhash64("key", "n")).join(named, "k", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
