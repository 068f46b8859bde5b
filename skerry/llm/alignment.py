"""Alignment of two tokenizers' ids over the same bytes, with counts of id pairs over the corpus.

Side A is a byte-level BPE over a space and the text, side B a sentencepiece BPE of the text
(which adds the space itself). Tokens of both sides that share bytes are linked; where tokens of both end, a group ends.

1. Texts are cut before each space that follows no white space. No token of either side
   crosses such a cut, and the sides' merges don't look across it, so a text's ids, groups and links are those of its
   stretches one after another; each distinct stretch that a worker meets is encoded and aligned once.
2. Each block of documents gives its postings: for every id of side B the linked ids of side A, the
   documents and the multiplicities, sorted and packed, a row for each of ``SHARES`` parts of B's ids.
   They are written once, beside the documents' own figures.
3. Pair counts are added up (first in each task) and grouped by B's id, whose largest one is marked.
4. Postings and counts are shuffled by B's part together and sorted, the counts first: a task
   streams them, holds one part's counts, and gives its documents' contributions. Blocks of
   documents are dealt over several tasks for each part, each with the part's counts, so that no id,
   however frequent, is the work of one task. A part holds at most as many pairs as the vocabularies
   allow, whatever the number of documents.
5. Contributions are summed by document and joined to its figures.

Rows: null and empty texts, and texts whose bytes one side does not give back, have no tokens: zeros and
an empty digest; null and repeated doc_ids keep their rows; long texts are read whole; equal texts get equal
values; among a B id's pairs of the same largest count all are best; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from .tokens import default_tokenizer, encoder, read_tokenizer, slices

SHARES, PER_TASK = 32, 8_000_000  # parts of B's ids; pairs of one part that a task is given
ID_BITS, DOC_BITS = 20, 24  # a link is B's place, A's id and the document's place in its block, in 64 bits
HELD = 256 << 20  # bytes of aligned stretches that a worker remembers at most; bounds its memory, not the result
_AFTER_WHITE, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def default_pieces() -> str:
    """Path of the 32k sentencepiece model; the operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: Latin-1's own where there is one, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def bytes_of_a(content: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; added special tokens stand for themselves."""
    alphabet, file = byte_alphabet(), json.loads(content)
    vocabulary = file["model"]["vocab"]
    out = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in file["added_tokens"])]))
    for token, i in vocabulary.items():
        out[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
    return out


def bytes_of_b(model) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model, U+2581 as a space and <0xHH> as a byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
    return out


def align(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in a, places in b) of two sides of the same bytes, and the ends that they share.

    ``end_a`` and ``end_b`` are the tokens' ends in bytes; no token is empty.
    """
    before = np.searchsorted(end_a, np.append(0, end_b[:-1]), side="right")  # the first of A that ends behind B's start
    last = np.searchsorted(end_a, end_b, side="left")  # the first of A that reaches B's end
    n = last - before + 1
    at_b = np.repeat(np.arange(len(b)), n)
    at_a = np.arange(len(at_b)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before, n)
    return at_a, at_b, np.intersect1d(end_a, end_b, assume_unique=True)


def stretches(text: str) -> list[str]:
    """A space and the text, cut before each space that follows no white space; each without its first space."""
    if _AFTER_WHITE.search(text) or text.startswith(" "):
        return [s[1:] for s in _CUT.split(" " + text)]
    return text.split(" ")


class Aligner:
    """Ids, groups and links of texts; stretches that were met before are looked up."""

    def __init__(self, content: str, model: bytes, shares: int = SHARES) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = encoder(content), SentencePieceProcessor(model_proto=model)
        self.raw_a, self.raw_b = bytes_of_a(content), bytes_of_b(self.b)
        if max(len(self.raw_a), len(self.raw_b)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of at most {1 << ID_BITS} ids")
        if any(" " in raw.lstrip(b" ").decode("latin-1") for raw in self.raw_b):
            raise ValueError("side B has pieces with a space behind other characters")
        self.size_a, self.size_b = (np.array([len(r) for r in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.place = places_of_b(len(self.raw_b), shares)
        self.written = [b"%d%b" % (i, mark) for side, ends in ((self.raw_a, (b",", b"|")), (self.raw_b, (b",", b";"))) for i in range(len(side)) for mark in ends]
        self.blank = self.b.encode("x ")[len(self.b.encode("x")) :]  # a last space: an empty text would get no id
        self.memo: dict[str, tuple[bytes, bytes, int] | None] = {}
        self.old: dict[str, tuple[bytes, bytes, int] | None] = {}
        self.held = 0

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of side A for all stretches, one after another, and how many each has."""
        ids = [e.ids for e in self.a.library.encode_batch([" " + s for s in new], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(new))

    def _fitting(self, new: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which stretches both sides give back byte by byte."""
        want = [(" " + s).encode() for s in new]
        whole, ends = b"".join(want), np.cumsum([len(w) for w in want])
        fits = np.ones(len(new), bool)
        for ids, n, raw, size in ((a, n_a, self.raw_a, self.size_a), (b, n_b, self.raw_b, self.size_b)):
            lengths = np.append(0, np.cumsum(size[ids]))[np.append(0, np.cumsum(n))]
            if (lengths[1:] == ends).all() and b"".join(map(raw.__getitem__, ids.tolist())) == whole:
                continue
            at = np.append(0, np.cumsum(n)).tolist()
            fits &= [b"".join(map(raw.__getitem__, ids[x:y].tolist())) == w for w, x, y in zip(want, at, at[1:])]
        return fits

    def _learn(self, new: list[str]) -> None:
        """(groups, links, ids of A) of each new stretch; None where a side does not give its bytes back."""
        a, n_a = self._ids(new)
        ids_b = [ids if s else self.blank for s, ids in zip(new, self.b.encode(new), strict=True)]
        b, n_b = np.fromiter(chain.from_iterable(ids_b), np.int64), np.fromiter(map(len, ids_b), np.int64, len(new))
        fits = self._fitting(new, a, n_a, b, n_b)
        if not fits.all():
            self.memo.update((s, None) for s, f in zip(new, fits.tolist(), strict=True) if not f)
            new = [s for s, f in zip(new, fits.tolist(), strict=True) if f]
            a, b, n_a, n_b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)], n_a[fits], n_b[fits]
        if not new:
            return
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_a, at_b, common = align(a, b, end_a, end_b)
        links = (self.place[b[at_b]] << (ID_BITS + DOC_BITS) | a[at_a] << DOC_BITS).astype("<u8").tobytes()
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        of_a, of_b = (np.cumsum(np.bincount(g, minlength=len(common))) for g in (group_a, group_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, of_b)[group_a]] = 2 * a + (common[group_a] == end_a)
        order[np.arange(len(b)) + of_a[group_b]] = 2 * (len(self.raw_a) + b) + (common[group_b] == end_b)
        token_ends = np.cumsum(n_a + n_b)
        groups = np.diff(np.searchsorted(common, end_a[np.cumsum(n_a) - 1], side="right"), prepend=0)
        link_ends = np.cumsum(n_a + n_b - groups) * 8
        codes, t, at = list(map(self.written.__getitem__, order.tolist())), 0, 0
        for s, own, t_end, l_end in zip(new, n_a.tolist(), token_ends.tolist(), link_ends.tolist(), strict=True):
            self.memo[s] = (b"".join(codes[t:t_end])[:-1], links[at:l_end], own)
            t, at = t_end, l_end
        self.held += sum(map(len, codes)) + len(links) + 300 * len(new)

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes, int] | None]:
        """(groups, links, ids of A) of each text; None where there are no tokens."""
        cut = [stretches(t) if t else [] for t in texts]
        if self.held > HELD // 2:  # two generations: stretches that are met again move to the new one
            self.old, self.memo, self.held = self.memo, {}, 0
        memo, old = self.memo, self.old
        todo = []
        for s in set(chain.from_iterable(cut)).difference(memo):
            if s in old:
                memo[s] = entry = old[s]
                self.held += 300 + (len(entry[0]) + len(entry[1]) if entry else 0)
            else:
                todo.append(s)
        for i in range(0, len(todo), 20_000):
            self._learn(todo[i : i + 20_000])
        out = []
        for parts in cut:
            got = list(map(memo.__getitem__, parts))
            if not got or None in got:
                out.append(None)
            else:
                groups, links, own = zip(*got)
                out.append((b";".join(groups), b"".join(links), sum(own)))
        return out


def places_of_b(ids: int, shares: int = SHARES) -> np.ndarray:
    """A place for each id of B; the places of a share follow one another."""
    each = -(-ids // shares)
    i = np.arange(ids)
    return i % shares * each + i // shares


def share_of(place: np.ndarray, ids: int, shares: int = SHARES) -> np.ndarray:
    return place // -(-ids // shares)


class Postings:
    """A block's linked documents for each pair of ids, packed: sorted pairs, and for each its documents with their multiplicities."""

    def __init__(self, pairs: np.ndarray, docs_of: np.ndarray, docs: np.ndarray, times: np.ndarray) -> None:
        self.pairs, self.docs_of, self.docs, self.times = pairs, docs_of, docs, times

    @classmethod
    def of(cls, keys: np.ndarray) -> Postings:
        """From the sorted links (place of B, A, document), one for each occurrence."""
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        times = np.diff(first, append=len(keys))
        distinct = keys[first]
        code = distinct >> np.uint64(DOC_BITS)
        pair = np.flatnonzero(np.diff(code, prepend=~code[:1]))
        return cls(code[pair].astype(np.int64), np.diff(pair, append=len(code)), (distinct & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64), times)

    def pack(self) -> bytes:
        head = np.array([len(self.pairs), len(self.docs)], "<i8").tobytes()
        body = np.diff(self.pairs, prepend=0).astype("<i8").tobytes() + b"".join(x.astype("<u4").tobytes() for x in (self.docs_of, self.docs, self.times))
        return head + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def unpack(cls, packed: bytes) -> Postings:
        n, m = np.frombuffer(packed, "<i8", 2).tolist()
        body = pa.decompress(packed[16:], decompressed_size=12 * n + 8 * m, codec="zstd", asbytes=True)
        docs_of, docs, times = (np.frombuffer(body, "<u4", k, at).astype(np.int64) for k, at in ((n, 8 * n), (m, 12 * n), (m, 12 * n + 4 * m)))
        return cls(np.cumsum(np.frombuffer(body, "<i8", n)), docs_of, docs, times)

    def counts(self) -> np.ndarray:
        """The links of each pair."""
        return np.add.reduceat(self.times, np.cumsum(self.docs_of) - self.docs_of)


OWN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
WRITTEN = f"block long, share int, pairs long, payload binary, place int, {OWN}"


def _postings(content: str, model: bytes, shares: int):
    """Two kinds of rows: documents with their own figures (no share), and a block's postings of a share."""
    kinds = [("block", pa.int64()), ("share", pa.int32()), ("pairs", pa.int64()), ("payload", pa.binary()), ("place", pa.int32())]
    own = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
    schema = pa.schema(kinds + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(content, model, shares)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                got = aligner(part.column("text").to_pylist())
                links = [np.frombuffer(g[1] if g else b"", "<u8") for g in got]
                n = [len(x) for x in links]
                rows = [(g[2], k - g[2] + g[0].count(b";") + 1, g[0].count(b";") + 1, k, hashlib.sha256(g[0]).hexdigest()) if g else (0, 0, 0, 0, "") for g, k in zip(got, n, strict=True)]
                figures = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), own[1:], strict=True)]
                none = [pa.nulls(len(n), t) for _, t in kinds[1:4]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), *none, pa.array(range(len(n)), pa.int32()), part.column("doc_id"), *figures], schema=schema)
                keys = np.sort(np.concatenate(links) | np.repeat(np.arange(len(n), dtype=np.uint64), n))
                first = share_of((keys >> np.uint64(ID_BITS + DOC_BITS)).astype(np.int64), len(aligner.raw_b), shares)
                cuts = np.searchsorted(first, np.arange(shares + 1)).tolist()
                found = [(s, Postings.of(keys[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                if found:
                    packed = [pa.array([block] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([len(p.docs) for _, p in found], pa.int64()), pa.array([p.pack() for _, p in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*packed, pa.nulls(len(found), pa.int32()), *(pa.nulls(len(found), t) for _, t in own)], schema=schema)
                block += 1

    return run


def _added(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Links of each pair (place of B, A), added up over a task's postings."""
    schema = pa.schema([("b", pa.int64()), ("a", pa.int64()), ("n", pa.int64())])
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], n[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        return pairs[first], np.add.reduceat(n, first)

    def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pairs), 100_000):
            p = pairs[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p >> ID_BITS), pa.array(p & ((1 << ID_BITS) - 1)), pa.array(n[i : i + 100_000])], schema=schema)

    for batch in batches:
        for packed in batch.column("payload").to_pylist():
            p = Postings.unpack(packed)
            held.append((p.pairs, p.counts()))
            size += len(p.pairs)
            if size > most:
                held = [merged()]
                size = len(held[0][0])
                if size > most // 2:
                    yield from rows(*held[0])
                    held, size = [], 0
    if held:
        yield from rows(*merged())


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each document gets from a part's pairs; a part's counts come before its postings."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    tile, counts, known = None, [], None
    for batch in batches:
        for r in batch.to_pylist():
            if r["tile"] != tile:
                tile, counts, known = r["tile"], [], None
            if r["payload"] is None:
                a, n = np.asarray(r["a"], np.int64), np.asarray(r["n"], np.int64)
                counts.append((r["b"] << ID_BITS | a, n, n == r["best"]))
                continue
            if known is None:  # sorted, as B's places and A's ids came in order
                known = [np.concatenate([c[i] for c in counts]) for i in range(3)]
                counts = []
            p = Postings.unpack(r["payload"])
            at = np.searchsorted(known[0], p.pairs)
            n_best, count_sum = (np.zeros(int(p.docs.max()) + 1, np.int64) for _ in range(2))
            np.add.at(n_best, p.docs, p.times * np.repeat(known[2][at], p.docs_of))
            np.add.at(count_sum, p.docs, p.times * np.repeat(known[1][at], p.docs_of))
            there = np.flatnonzero(count_sum)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(there), pa.int64()), pa.array(there.astype(np.int32)), pa.array(n_best[there]), pa.array(count_sum[there])], schema=schema)


def align_documents(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, shares: int = SHARES, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    with open(pieces or default_pieces(), "rb") as f:
        model = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(rows.mapInArrow(_postings(read_tokenizer(tokenizer or default_tokenizer()), model, shares), WRITTEN), "postings")
    own = found.where("share IS NULL").select("block", "place", *(c.split()[0] for c in OWN.split(", ")))
    postings = found.where("share IS NOT NULL").select("share", "block", "pairs", "payload")

    counts = postings.select("payload").mapInArrow(_added, "b long, a long, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
    by_b = counts.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("pairs"), F.max("n").alias("best"))  # at most A's vocabulary
    by_b = materialize(by_b.select("b", F.col("pairs.a").alias("a"), F.col("pairs.n").alias("n"), "best"), "counts")

    widest = postings.groupBy("share").agg(F.sum("pairs").alias("n")).agg(F.max("n")).first()[0] or 0
    deals = max(1, -(-widest // per_task))  # tasks for each share
    each = -(-_size_of(model) // shares)
    counts_side = by_b.select((F.expr(f"CAST(b DIV {each} AS INT)") * deals).alias("tile"), F.lit(None).cast("long").alias("block"), "b", "a", "n", "best", F.lit(None).cast("binary").alias("payload"))
    counts_side = counts_side.withColumn("tile", F.explode(F.sequence("tile", F.col("tile") + (deals - 1))))
    postings_side = postings.select((F.col("share") * deals + F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int")).alias("tile"), "block", F.lit(None).cast("long").alias("b"), *(F.lit(None).cast("array<bigint>").alias(c) for c in ("a", "n")), F.lit(None).cast("long").alias("best"), "payload")
    both = counts_side.unionByName(postings_side).repartitionById(shares * deals, "tile").sortWithinPartitions("tile", F.col("b").asc_nulls_last(), "block")
    got = both.mapInArrow(_contributions, "block long, place int, n_best long, count_sum long").groupBy("block", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return own.join(got, ["block", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


def _size_of(model: bytes) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model).get_piece_size()
