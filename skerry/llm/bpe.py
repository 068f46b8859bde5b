"""Byte-level BPE with Spark's higher-order functions, and its way back.

A text's pieces are cut by the vocabulary's pattern. Every distinct piece of a block of
documents is encoded once: its bytes become single-byte ids, and a fold joins the
neighbouring pair of least rank, the leftmost of equals, until no pair has a rank, as the
vocabulary's own library does. In such a vocabulary an id is its rank, so the fold keeps
one array of longs between two edges: rank of a token with its right neighbour, place of
its first byte, id. The least element tells the next pair; only the ranks of the joined
token with its two neighbours are looked up anew.

The rank map is a literal in the expression: the pairs of a first id are a row, rows are laid
over each other so that no two pairs share a slot, and a lookup reads a row's offset and one
slot (Spark's own map lookup scans all entries). Decoding looks each id's bytes up in a
literal array and joins them.

A block is what one task has read, up to BLOCK_PIECES pieces (or one batch of rows); numbering
its distinct pieces and laying their ids out by document are Arrow calls, so nothing is shuffled.
Between these two calls a block goes through Spark in short rows, its distinct pieces first and then its
documents, so that Spark holds the ids of some thousand pieces at once and not those of a block.
Pieces that many blocks have are folded once and not in each of them: the CACHE most frequent pieces of about
CACHE_ROWS documents are folded first and sent to the tasks with their ids. The cache saves work and
changes no result: every piece of every document is looked up in it, and what it lacks is folded in its block.
How rows fall into blocks and what is cached changes no result. A piece of n bytes takes time with n squared.

Rows: null text counts as empty and has no ids (and an empty decoded text); null and
repeated doc_ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import copy
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = -1  # no token; a small number, as Java has one object for all that are equal
NO_RANK = 1 << 16  # no pair
EDGE = (1 << 16) - 1  # stands before and after a piece's ids; in no pair
PLACE, RANK = 16, 46  # first bits of an element's place and rank
BLOCK_PIECES = 4_000_000  # pieces held at once by a task, some 100 MB
ROW_PIECES, WORD_ROWS = 250_000, 16_384  # pieces of documents, and distinct pieces, in a row between Python and Spark: a megabyte or less
CACHE, CACHE_ROWS = 400_000, 16_000  # pieces sent with their ids, some 12 MB, and the documents that they are from
CACHE_PART = 20_000  # of them folded by a task

#: Fixed value: the pattern of the public byte-level vocabularies, with Unicode white space as they have it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def default_ranks() -> str:
    """Path of the 50k rank file; another is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each pair of tokens that make a token, by first * 65536 + second."""
    return {ranks[t[:i]] << 16 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def overlaid(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each first id's row, and slots: the pair (a, b) has offset[a] + b to itself, with a * 131072 + rank.

    Long rows come first; a row takes the first offset where all its slots are free.
    """
    keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
    firsts, starts = np.unique(keys >> 16, return_index=True)
    rows = sorted(zip(firsts.tolist(), np.split(keys & 0xFFFF, starts[1:]), strict=True), key=lambda x: -len(x[1]))
    free, offsets, lowest = np.ones(len(pairs) + (2 << 16), bool), np.zeros(1 << 16, np.int64), 0
    for first, seconds in rows:
        at, found = max(lowest - int(seconds[0]), 0), -1
        while found < 0:
            tried = np.arange(at, at + 4096)
            if (most := at + 4096 + (1 << 16)) > len(free):
                free = np.concatenate([free, np.ones(most, bool)])
            fits = tried[free[tried + seconds[0]]]
            for second in seconds[1:]:
                if not len(fits):
                    break
                fits = fits[free[fits + second]]
            found, at = int(fits[0]) if len(fits) else -1, at + 4096
        offsets[first] = found
        free[found + seconds] = False
        while not free[lowest]:
            lowest += 1
    slots = np.full(int(offsets.max()) + (1 << 16), -1, np.int64)
    for first, seconds in rows:
        slots[offsets[first] + seconds] = [first << 17 | pairs[first << 16 | second] for second in seconds.tolist()]
    return offsets, slots


def _hash(value: int, seed: int = 42) -> int:
    """Spark's xxhash64 of one long."""
    h = xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed)
    return h - (1 << 64) if h >> 63 else h


def _word_hash(word: bytes) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def _is_text(token: bytes) -> bool:
    """Whether the bytes are whole characters, so that a piece can equal them."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def displaced(keys: list[int]) -> tuple[list[int], list[int | None]]:
    """Displacements and slots without collisions: a key's slot hangs on its hash and its group's displacement.

    A slot holds its key, or None.
    """
    groups = 1 << max(4, (len(keys) // 4).bit_length())
    size = 1 << max(6, (len(keys) * 2 - 1).bit_length())
    members: list[list[int]] = [[] for _ in range(groups)]
    for k in keys:
        members[_hash(k) % groups].append(k)
    shift, slots = [0] * groups, [None] * size
    for g in sorted(range(groups), key=lambda g: -len(members[g])):
        for d in range(1 << 20):
            at = [_hash(d, _hash(k) & (2**64 - 1)) % size for k in members[g]]
            if len(set(at)) == len(at) and all(slots[i] is None for i in at):
                break
        else:
            raise ValueError("no displacement found")
        shift[g] = d
        for k, i in zip(members[g], at, strict=True):
            slots[i] = k
    return shift, slots


def _array(values: list, kind: str) -> Column:
    """A literal array; the optimizer folds it into one constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Vocabulary:
    """Literal tables of a rank file, as column expressions."""

    def __init__(self, path: str | None = None, pattern: str = PATTERN) -> None:
        ranks = read_ranks(path or default_ranks())
        if max(ranks.values()) >= EDGE:
            raise ValueError("ids of more than 16 bits")
        self.pattern = pattern
        offsets, slots = overlaid(pair_ranks(ranks))
        self.offsets, self.slots = _array(offsets.tolist(), "bigint"), _array(slots.tolist(), "bigint")
        self.single = _array([ranks[bytes([b])] for b in range(256)], "bigint")
        hexes = [""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            hexes[r] = t.hex().upper()
        self.hexes = _array(hexes, "string")
        whole = {_word_hash(t): r for t, r in ranks.items() if _is_text(t)}
        shift, slots = displaced(list(whole))
        self.word_shift, self.word_groups, self.word_size = _array(shift, "bigint"), len(shift), len(slots)
        self.word_ids = _array([whole.get(k, NONE) for k in slots], "int")

    def rank(self, a: Column, b: Column) -> Column:
        """Rank of a pair of ids; NO_RANK without one, or without ``b``.

        A slot less its own row's number is a rank; with the sign bit off, other rows' slots give more than any.
        """
        slot = F.get(self.slots, F.get(self.offsets, a) + b)
        return F.least((slot - F.shiftleft(a, 17)).bitwiseAND(F.lit(2**63 - 1)), F.lit(NO_RANK).cast("bigint"))

    def whole(self, word: Column) -> Column:
        """Id of a piece that is itself a token, else null: its slot's bytes are compared."""

        def of(h: Column) -> Column:
            slot = F.pmod(F.xxhash64(h, F.get(self.word_shift, F.pmod(F.xxhash64(h), F.lit(self.word_groups)).cast("int"))), F.lit(self.word_size)).cast("int")
            return _let(F.get(self.word_ids, slot), lambda i: F.when((i != NONE) & (F.get(self.hexes, i) == F.hex(word)), i))

        return _let(F.xxhash64(word), of)

    def encode_word(self, word: Column) -> Column:
        """Ids of one piece that is not empty: one token, or the fold."""
        return _let(self.whole(word), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(self.fold(word)))

    def encode_words(self, words: Column) -> Column:
        """Ids of each of an array's pieces; each table stands once in the expression, however often it is looked into.

        A literal that stands there again is another copy of its boxed numbers in every task.
        """

        def bound(own: Vocabulary, names: tuple[str, ...]) -> Column:
            if not names:
                return F.transform(words, own.encode_word)

            def within(table: Column) -> Column:
                inner = copy.copy(own)
                setattr(inner, names[0], table)
                return bound(inner, names[1:])

            return _let(getattr(own, names[0]), within)

        return bound(self, ("offsets", "slots", "single", "hexes", "word_shift", "word_ids"))

    def fold(self, word: Column) -> Column:
        """Ids of one piece by its merges."""
        edge = lambda place: F.array(F.lit((NO_RANK << RANK) + (place << PLACE) + EDGE))
        places = (1 << RANK) - (1 << PLACE)
        token = lambda x: x.bitwiseAND(F.lit(EDGE))

        def start(ids: Column) -> Column:
            ranked = lambda a, i: F.shiftleft(self.rank(a, F.get(ids, i + 1)), RANK) + F.shiftleft(i.cast("bigint") + 1, PLACE) + a
            return F.concat(edge(0), F.transform(ids, ranked), edge(places >> PLACE))

        def step(s: Column, _: Column) -> Column:
            def joined(least: Column) -> Column:
                new = F.shiftright(least, RANK)

                def at(i: Column) -> Column:  # elements i and i + 1, counted from 1, become one
                    before = F.get(s, i - 2)
                    pair = F.array(
                        F.shiftleft(self.rank(token(before), new), RANK) + before.bitwiseAND(F.lit((1 << RANK) - 1)),
                        F.shiftleft(self.rank(new, token(F.get(s, i + 1))), RANK) + least.bitwiseAND(F.lit(places)) + new,
                    )
                    return F.concat(F.slice(s, F.lit(1), i - 2), pair, F.slice(s, i + 2, F.size(s)))

                # array_position ends its search by an exception, which costs more than all the rest
                before = lambda p: F.size(F.filter(s, lambda x: x.bitwiseAND(F.lit(places)) < p))
                return F.when(least >= F.lit(NO_RANK << RANK), s).otherwise(_let(_let(least.bitwiseAND(F.lit(places)), before) + 1, at))

            return _let(F.array_min(s), joined)

        def folded(ids: Column) -> Column:
            ended = F.aggregate(F.sequence(F.lit(2), F.size(ids) + 1), start(ids), step)  # the last step finds nothing
            return _let(ended, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: token(x).cast("int")))

        each = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")  # a character for each byte
        return _let(F.transform(each, lambda c: F.get(self.single, F.ascii(c))), folded)

    def pieces(self, text: Column) -> Column:
        """A text's pieces by the pattern, in order."""
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.hexes, i)), ""))


def _one(kind: pa.DataType, values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row: the distinct pieces of some documents, and each document's pieces as numbers of those."""
    lists = [b.column("pieces") for b in held]
    pieces = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
    counts = pa.concat_arrays([x.value_lengths() for x in lists])
    ids = pa.concat_arrays([b.column("doc_id") for b in held])
    return pa.RecordBatch.from_arrays([_one(pa.int64(), ids), _one(pa.int32(), counts), _one(pa.int32(), pieces.indices), _one(pa.string(), pieces.dictionary)], ["doc_ids", "counts", "places", "words"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and their pieces, in blocks of about BLOCK_PIECES."""
    held, pieces = [], 0
    for b in batches:
        held.append(b)
        pieces += len(b.column("pieces").flatten())
        if pieces >= BLOCK_PIECES:
            block, held, pieces = _joined(held), [], 0  # texts go before the block is worked on
            yield block
    if held:
        yield _joined(held)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of documents, from rows in order: the ids of a block's distinct pieces, then its documents."""
    held, encoded, lengths = [], None, None
    for b in batches:
        for i in range(b.num_rows):
            doc_ids, counts, places, more = (b.column(c)[i].values for c in ("doc_ids", "counts", "places", "encoded"))
            if len(more):
                if encoded is not None:  # the first of the next block
                    held, encoded, lengths = [], None, None
                held.append(more)
            if not len(doc_ids):
                continue
            if encoded is None:
                encoded = pa.concat_arrays(held) if held else more
                held, lengths = [], encoded.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(counts.to_numpy())])
            for at, to in _runs(ends):
                part = places.slice(ends[at], ends[to] - ends[at])
                starts = np.concatenate([[0], np.cumsum(lengths[part.to_numpy()])])[ends[at : to + 1] - ends[at]]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, to - at), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), encoded.take(part).flatten())], ["doc_id", "ids"])


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents from and to, some ROW_PIECES pieces at a time (or one document), from where their pieces end."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ROW_PIECES, "right")) - 1)
        yield at, to
        at = to


_ROW = pa.schema([("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("counts", "places", "known")), ("words", pa.list_(pa.string()))])


def _rows(block: pa.RecordBatch, known: pa.Array) -> Iterator[pa.RecordBatch]:
    """A block in short rows: its distinct pieces, WORD_ROWS at a time and only those as text that the cache lacks; then its documents."""
    doc_ids, counts, places, words = (block.column(c)[0].values for c in ("doc_ids", "counts", "places", "words"))
    none, no_ids, no_words = pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.string())

    def row(doc_ids, counts, places, known, words) -> pa.RecordBatch:
        columns = [_one(pa.int64(), doc_ids), _one(pa.int32(), counts), _one(pa.int32(), places), _one(pa.int32(), known), _one(pa.string(), words)]
        return pa.RecordBatch.from_arrays(columns, schema=_ROW)

    for at in range(0, len(words), WORD_ROWS):
        part = known.slice(at, WORD_ROWS)
        yield row(no_ids, none, none, part, words.slice(at, WORD_ROWS).filter(pc.less(part, 0)))
    ends = np.concatenate([[0], np.cumsum(counts.to_numpy())])
    for at, to in _runs(ends):
        yield row(doc_ids.slice(at, to - at), counts.slice(at, to - at), places.slice(ends[at], ends[to] - ends[at]), none, no_words)


def _opened(sent):
    """Blocks in short rows whose words are only those that the cache lacks; ``known`` has each distinct piece's place in the cache, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = sent.value["word"].combine_chunks()
        for b in _blocks(batches):
            known = pc.fill_null(pc.index_in(b.column("words")[0].values, value_set=cached), -1)
            yield from pa.Table.from_batches(_rows(b, known), schema=_ROW).combine_chunks().to_batches()

    return run


def _closed(sent):
    """doc_id and ids from blocks whose other pieces are encoded."""
    kind = pa.list_(pa.int32())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = sent.value["ids"].combine_chunks().cast(kind)
        for b in batches:
            for i in range(b.num_rows):
                known, folded = b.column("known")[i].values.to_numpy(), b.column("encoded")[i].values.cast(kind)
                at = np.where(known < 0, len(cached) + np.cumsum(known < 0) - 1, known)
                encoded = pa.concat_arrays([cached, folded]).take(pa.array(at)) if len(at) else folded
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("doc_ids", "counts", "places")), _one(kind, encoded)], ["doc_ids", "counts", "places", "encoded"])

    return lambda batches: _laid_out(whole(batches))


def frequent_pieces(docs: DataFrame, own: Vocabulary, most: int = CACHE, rows: int = CACHE_ROWS) -> pa.Table:
    """(word, ids): at most ``most`` pieces, the most frequent of about ``rows`` documents."""
    n = docs.count()
    words = docs.sample(min(1.0, rows / max(1, n)), seed=7).select(F.explode(own.pieces(F.coalesce("text", F.lit("")))).alias("word"))
    words = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).select("word")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-most // CACHE_PART))  # each task gets the tables anew
    return words.repartition(parts).select("word", F.get(own.encode_words(F.array("word")), F.lit(0)).alias("ids")).toArrow()


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str = PATTERN, cache: int = CACHE) -> DataFrame:
    """doc_id, ids and the bytes that the ids decode to, for every document."""
    own = Vocabulary(ranks, pattern)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, own, cache))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.pieces(F.coalesce("text", F.lit(""))).alias("pieces"))
    blocks = rows.mapInArrow(_opened(sent), "doc_ids array<bigint>, counts array<int>, places array<int>, known array<int>, words array<string>")
    encoded = blocks.select("doc_ids", "counts", "places", "known", own.encode_words(F.col("words")).alias("encoded"))
    return encoded.mapInArrow(_closed(sent), "doc_id long, ids array<int>").withColumn("decoded", own.decode(F.col("ids")))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from ``encode_documents``."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
