"""Language, Merkle manifest and tokenizer alignment: brute force, held-out accuracy and edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import alignment, catalogue, langid, merkle
from skerry.llm._shared import dealt

SF = "/root/testdata/sf0.001"
ODD = ["a  b", "  x", "x ", "\tq\n", "a▁b", "ﬁ Å", "", " ", "a\xa0b", "a　 b", "\x00x", "é", "​x", "<s>x</s>", "<unk> <|endoftext|> <0x41>", "\r\n", "x\n  y \n\n z", "\x1c x\x85 y", "𝔘 中文 テスト  \n ", None, "x   y\n", "12 34 !?", "word " * 30_000 + "ünïcödé end", "q" * 50_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, null fields, repeated rows, a hot source, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", len(t or "") or None) for i, t in enumerate(ODD)]
    rows += [(7, "same", "de", "hot", 4)] * 40 + [(None, "no id", None, "hot", None)] * 3 + [(None, None, None, None, None)] * 2 + [(5, "other text of this id", "fr", "", 3)]
    extra = {c: F.lit("x") for c in ("rank", "tree", "h", "block", "share", "n", "gram", "own", "score", "place", "payload", "tie", "size", "n_a")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


# -- Merkle manifest --


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(found, i):
        out = []
        for nodes in found[:-1]:
            out.append((nodes[i // 3 * 3 : i], nodes[i + 1 : i // 3 * 3 + 3]))
            i //= 3
        return out

    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, sha(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text))), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top, out = levels([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps, text = path(trees[s], i) + path(top, k), r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = sha(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
            for before, after in steps:
                h = sha(*before, h, *after)
            out.append((r.doc_id, leaf, trees[s][-1][0], top[-1][0], sha(*(x for step in steps for side in step for x in side)), h, h == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_odd_rows(docs):
    rows = docs.collect()
    want = plain_manifest(rows)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}
    assert merkle.manifest(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("top", "height"), [(1, 1), (30, 1), (3, 2)])
def test_manifest_by_rounds(spark, docs, top, height):
    """Beyond the bound of the broadcast tree, rounds of blocks give the same."""
    found = docs.withColumn("source", F.coalesce("source", F.col("doc_id").cast("string")))
    assert sorted(map(tuple, merkle.manifest(found, top, height).collect()), key=str) == plain_manifest(found.collect())


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalogue.op12_merkle(spark, SF)
    want = con.sql(catalogue.oracle_sql()["op12_merkle"])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows == plain_manifest(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_hot_rows_are_dealt(spark):
    """One row 20,000 times: no partition of the order holds all of it."""
    same = spark.range(20_000).select(F.lit("s").alias("tree"), F.lit(1).alias("doc_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.numbered(same, "tree", ["doc_id"])
        files = [spark.read.parquet(f).count() for f in got.inputFiles()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["rank"] for r in got.collect()) == list(range(20_000))
    assert len(files) > 1 and max(files) < 12_000


# -- language --


def test_languages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(rows).collect()}
    want = rows.collect()
    assert len(got) == len(want) and all(0 <= r.score <= 1 for r in got.values())
    apart = [r for r in want if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out} == {r.doc_id for r in apart}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in apart) >= 0.98 * len(apart)


def plain_ngrams(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            marked = f"^{word}$"
            out += [marked[i - 1 : i + 2] for i in range(1, len(marked) - 1)] + [marked[i - 1 : i + 3] for i in range(1, len(marked) - 2)]
            word = ""
    return Counter(out)


def plain_ngram_counts(texts):
    found, owner = langid.ngrams(texts)
    return [Counter(found[owner == i].tolist()) for i in range(len(texts))]


def test_ngrams_are_windows():
    texts = ["Ab c", None, "", "ÉCOLE l'été 12x", "\n\nz\n", "日本 ßa", "aaaa aaaa"]
    for text, own in zip(texts, plain_ngram_counts(texts), strict=True):
        assert sorted(own.values()) == sorted(plain_ngrams(text).values())


def test_filters_return_all_languages(spark):
    """Every n-gram that a language holds is found in its filter; others at the rate that the correction takes."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the thing and that", "en"), ("der und das ding", "de"), ("that und", "xx")] * 10)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    filters = langid.fit_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    totals, counts = Counter(), defaultdict(Counter)
    for _, text, lang in train:
        for h, n in plain_ngram_counts([text])[0].items():
            counts[h][lang] += n
            totals[lang] += n
    everything = sum(totals.values())
    assert filters.names == sorted(totals, key=lambda k: (-totals[k], k))
    for h, by in counts.items():
        mask = filters.masks(np.array([h], np.uint64))[0]
        for i, lang in enumerate(filters.names):
            if by[lang] and by[lang] / totals[lang] >= langid.RATIO * sum(by.values()) / everything:
                assert mask[i // 8] >> i % 8 & 1
    other = langid.stir(np.arange(1, 200_001, dtype=np.uint64))
    seen = filters.popcounts(other, np.zeros(len(other), np.int64), 1)[0] / len(other)
    assert np.abs(seen - filters.chance).max() < 0.001


def test_filled_filters_are_corrected(spark):
    """With slices far too small, most answers are chance, and the corrected shares still tell the languages apart."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small = langid.fit_filters(rows, slices_bytes=1 << 13)
    assert len(small.rows) == 1 << 13 and small.chance.max() > 0.02
    want = rows.where("n_chars > 500").limit(300).collect()
    _, shares = small.shares([r.text for r in want])
    right = [small.names[b] == r.lang for b, r in zip(shares.argmax(axis=1), want, strict=True)]
    assert sum(right) >= 0.97 * len(right)


def test_many_languages(spark):
    """More than eight languages take several bytes of a row."""
    words = [chr(97 + i) * 2 + chr(98 + i) * 3 for i in range(20)]
    rows = [(i, f"{words[i % 20]} " * 3, f"l{i % 20:02}") for i in range(400)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 20:02}" for r in got)


def test_language_odd_rows(spark, docs):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i, text in enumerate(ODD):
        if i not in (5, 7):
            letters = any(c.isalpha() for c in text or "")
            assert (by[i].lang_pred == "und" and by[i].score == 0) != letters
    assert all(r.held_out for r in got if r.doc_id is None)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_reading_is_dealt_only_if_told(spark):
    rows = spark.range(10).coalesce(1)
    assert dealt(rows).rdd.getNumPartitions() == 1
    spark.conf.set("spark.skerry.readPartitions", "3")
    try:
        assert dealt(rows).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.skerry.readPartitions")


# -- alignment --


def plain_alignment(rows):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    side_a, side_b = Tokenizer.from_file(path), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    side_a.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        raw_a = alignment.bytes_of_a(f.read())
    raw_b = alignment.bytes_of_b(side_b)
    found, counts = [], Counter()
    for r in rows:
        text = r.text or ""
        a, b = (side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)) if text else ([], [])
        whole = (" " + text).encode()
        if not text or b"".join(raw_a[i] for i in a) != whole or b"".join(raw_b[i] for i in b) != whole:
            found.append((r.doc_id, 0, 0, [], []))
            continue
        ends = [np.cumsum([len(raw[i]) for i in ids]) for raw, ids in ((raw_a, a), (raw_b, b))]
        links, groups, i, j, first = [], [], 0, 0, (0, 0)
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
                first = (i, j)
        counts.update(links)
        found.append((r.doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((k, a, b, len(g), len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, a, b, g, l in found), key=str)


def test_alignment_odd_rows(docs):
    want = plain_alignment(docs.collect())
    got = alignment.align_documents(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert alignment.align_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("per_task", [alignment.PER_TASK, 500])
def test_alignment(spark, per_task):
    """With few pairs for a task, blocks of one share are dealt over several tasks."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    assert sorted(map(tuple, alignment.align_documents(rows, per_task=per_task).collect()), key=str) == plain_alignment(rows.collect())


def test_aligner_forgets_and_stays_right(monkeypatch):
    from skerry.llm.tokens import default_tokenizer, read_tokenizer

    with open(alignment.default_pieces(), "rb") as f:
        model = f.read()
    texts = ["one two  three", "four five six\n seven", None, "a▁b"]
    content = read_tokenizer(default_tokenizer())
    want = alignment.Aligner(content, model)(texts)
    monkeypatch.setattr(alignment, "HELD", 0)
    own = alignment.Aligner(content, model)
    assert own(texts) == want == own(texts)
    assert want[2] is None and want[3] is None


def test_postings_pack():
    keys = np.sort(np.random.default_rng(1).integers(0, 50, 4000).astype(np.uint64) << np.uint64(alignment.DOC_BITS) | np.random.default_rng(2).integers(0, 30, 4000).astype(np.uint64))
    p = alignment.Postings.unpack(alignment.Postings.of(keys).pack())
    back = np.repeat(np.repeat(p.pairs, p.docs_of) << alignment.DOC_BITS | p.docs, p.times)
    assert back.tolist() == keys.tolist() and p.counts().sum() == 4000
