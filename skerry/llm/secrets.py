"""Secrets: base rules, and a character convolutional network over wider candidates.

Base rules find assignments of passwords and tokens, access keys and long hexadecimal
strings; all their findings stay. The network judges every other candidate: each run of 12
or more key characters, whole, with ``CONTEXT`` characters on either side. A window of ``WIDTH`` characters
slides over it in half steps, and the highest probability of its windows counts. The network is
one convolution over characters, a maximum over positions and a logistic unit, all in numpy.

It is trained on labelled findings that the base rules do not decide: candidates of the documents
themselves that no rule marks (others), and secrets planted in such a candidate's place and
surroundings (see ``planted``): random keys of several alphabets, lengths and prefixes, some after
words that announce a credential. Hard negatives, made likewise, are no secrets though they look alike: serial
numbers, dates, identifiers of words, paths, repeated letters. Its probabilities are calibrated by a logistic
curve on findings kept aside, and the threshold is the highest that keeps ``recall`` of the secrets among them.

Rows: null text counts as empty and has no spans; null and repeated doc_ids are scanned like
others, equal texts alike; long texts are scanned whole; other columns are ignored; documents without any
candidate are replaced by empty surroundings in training; an empty table gives no rows. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .labelled import logistic
from .tokens import slices

# Fixed values of the base rules, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "learned")

_ASSIGNED = ("passw", "secret", "token", "apikey", "api_key")  # every match of ASSIGN holds one of these, in lower case
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_KEYED = re.sub(rb"[^A-Za-z0-9+/_=-]", b" ", re.sub(rb"[A-Za-z0-9+/_=-]", b"x", bytes(range(256))))  # x for each key character
_STRETCH = re.compile(r".{1,65536}\S*", re.DOTALL)
CONTEXT, WIDTH, FILTERS, TAPS, CODES = 24, 48, 32, 5, 40
SAMPLE_FINDINGS = 6000


def _may_assign(text: str) -> bool:
    """False only where no match of ASSIGN can be: it needs one of its words, which hold no space, and a sign after it."""
    return (":" in text or "=" in text) and any(word in low for m in _STRETCH.finditer(text) for low in (m[0].lower(),) for word in _ASSIGNED)


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules' matches, leftmost and not overlapping within a kind; ``runs``: its candidates, if known."""
    out = []
    if _may_assign(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for a, b in candidates(text) if runs is None else runs:  # hexadecimal digits are key characters
        if b - a >= 32:
            out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, a, b)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that could be keys: 12 or more key characters.

    A plain search for 12 marks, a byte for each character, does what ``_CANDIDATE`` does in a fifth of its time.
    """
    marks, out = text.encode("latin-1", "replace").translate(_KEYED), []
    at = marks.find(b"x" * 12)
    while at >= 0:
        end = marks.find(b" ", at)
        end = len(marks) if end < 0 else end
        out.append((at, end))
        at = marks.find(b"x" * 12, end)
    return out


def parts_beside(span: tuple[int, int], marked: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans leave of a candidate: its parts of 12 or more characters outside them."""
    at, out = span[0], []
    for a, b, _ in marked:
        if b > at and a < span[1]:
            if a - at >= 12:
                out.append((at, a))
            at = max(at, b)
    if span[1] - at >= 12:
        out.append((at, span[1]))
    return out


def beside(text: str, marked: list[tuple[int, int, str]], runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """All candidates of a text outside its base spans; both lists are in order of place. ``runs``: the candidates, if known."""
    out, first, reach = [], 0, []
    for span in candidates(text) if runs is None else runs:
        while first < len(marked) and marked[first][0] < span[1]:
            reach.append(marked[first])
            first += 1
        reach = [m for m in reach if m[1] > span[0]]
        out += parts_beside(span, reach) if reach else [span]
    return out


_CLASS = np.full(256, 1, np.int64)
for _i, _c in enumerate("etaoinsrhldcumfpgwybvkxjqz"):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 2 + _i
for _c in "0123456789":
    _CLASS[ord(_c)] = 28 + int(_c) // 5
for _i, _c in enumerate(" \n\"'=:;,.-/"):
    _CLASS[ord(_c)] = 29 + _i
_CLASS[0] = 0


def _window(text: str, start: int, end: int) -> tuple[str, str, str]:
    """(left, middle, right): at most WIDTH characters and their surroundings."""
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def _coded(windows: Collection[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (0: nothing there) and inside and case marks of windows."""
    filled = "".join(left.rjust(CONTEXT, "\0") + middle.ljust(WIDTH, "\0") + right.ljust(CONTEXT, "\0") for left, middle, right in windows)
    raw = np.frombuffer(filled.encode("latin-1", "replace"), np.uint8).reshape(len(windows), -1)
    inside = np.arange(raw.shape[1]) - CONTEXT
    marks = np.zeros((*raw.shape, 3), np.float32)
    marks[:, :, 0] = (inside >= 0) & (inside < np.array([len(m) for _, m, _ in windows])[:, None])
    marks[:, :, 1] = (raw >= 65) & (raw <= 90)
    marks[:, :, 2] = (raw >= 48) & (raw <= 57)
    return _CLASS[raw], marks


def places(start: int, end: int) -> list[tuple[int, int]]:
    """Windows over a whole candidate: WIDTH characters each, half a window apart, the last one at its end."""
    if end - start <= WIDTH:
        return [(start, end)]
    return [(a, a + WIDTH) for a in range(start, end - WIDTH, WIDTH // 2)] + [(end - WIDTH, end)]


class Network:
    """Embedding, one convolution, maximum over positions, one logistic unit."""

    def __init__(self, seed: int = 11, size: int = 8) -> None:
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (CODES, size)).astype(np.float32)
        self.kernel = r.normal(0, 0.15, (TAPS * (size + 3), FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.last, self.bias = r.normal(0, 0.2, FILTERS).astype(np.float32), np.float32(0)
        self.slope, self.offset, self.threshold = 1.0, 0.0, np.inf

    def _forward(self, codes: np.ndarray, marks: np.ndarray):
        x = np.concatenate([self.table[codes], marks], axis=2)
        n, length, depth = x.shape
        windows = np.lib.stride_tricks.sliding_window_view(x, TAPS, axis=1).transpose(0, 1, 3, 2).reshape(n, length - TAPS + 1, TAPS * depth)
        h = windows @ self.kernel
        top = np.maximum(h.max(axis=1) + self.shift, 0)  # rounding keeps order, so the shift may come after the maximum
        return windows, h, top, top @ self.last + self.bias

    def _logits(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512], marks[i : i + 512])[3] for i in range(0, len(codes), 512)])

    def probability(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Calibrated probability that each candidate is a secret."""
        z = self._logits(codes, marks)
        return 1 / (1 + np.exp(-np.clip(self.slope * z.astype(np.float64) + self.offset, -500, 500)))

    def fit(self, codes: np.ndarray, marks: np.ndarray, y: np.ndarray, recall: float, epochs: int = 12, rate: float = 0.05, seed: int = 5) -> Network:
        """Train on four fifths; calibrate and set the threshold on the rest."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        aside, own = order[::5], np.setdiff1d(order, order[::5])
        if not 0 < y[aside].sum() < len(aside) or not 0 < y[own].sum() < len(own):
            return self
        weight = np.where(y > 0, 0.5 / y[own].mean(), 0.5 / (1 - y[own].mean()))
        names = ("table", "kernel", "shift", "last", "bias")
        seen = {k: np.full_like(getattr(self, k), 1e-6) for k in names}
        for _ in range(epochs):
            for part in np.array_split(r.permutation(own), max(1, len(own) // 64)):
                c, m = codes[part], marks[part]
                windows, h, top, z = self._forward(c, m)
                at, each = (h + self.shift).argmax(axis=1), np.arange(len(part))[:, None]
                err = ((1 / (1 + np.exp(-z.clip(-30, 30))) - y[part]) * weight[part] / len(part)).astype(np.float32)
                back = err[:, None] * self.last * (top > 0)
                picked = windows[each, at]  # (n, filters, taps * depth)
                into = (back[:, :, None] * self.kernel.T[None]).reshape(len(part), FILTERS, TAPS, -1)[..., : self.table.shape[1]]
                place = c[each[:, :, None], at[:, :, None] + np.arange(TAPS)]
                grads = {"last": top.T @ err, "bias": err.sum(), "shift": back.sum(0), "kernel": np.einsum("nf,nfd->df", back, picked), "table": np.zeros_like(self.table)}
                size = self.table.shape[1]  # places in the flat table, as numpy adds much faster at those
                np.add.at(grads["table"].reshape(-1), (place[..., None] * size + np.arange(size)).reshape(-1), into.reshape(-1))
                for k in names:
                    seen[k] = seen[k] + grads[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * grads[k] / np.sqrt(seen[k])).astype(np.float32))
        z = self._logits(codes[aside], marks[aside]).astype(np.float64)
        self.slope, self.offset = logistic(z, y[aside].astype(float), np.ones(len(aside)))
        p = np.sort(self.probability(codes[aside], marks[aside])[y[aside] > 0])
        self.threshold = float(p[int(np.floor((1 - recall) * len(p)))])
        return self


#: Words that announce a credential, prefixes of issued keys, and words of identifiers that are none.
ANNOUNCE = ["secret", "auth", "credential", "bearer", "access key", "private key", "signature", "client_secret", "pwd", "passphrase", "authorization", "sas"]
PREFIXES = ["sk_live_", "ghp_", "xoxb-", "pk_", "key-", "rk_", "glpat-", "tok_", "AIza", "SG_"]
ORDINARY = ["order", "serial", "page", "document", "chapter", "release", "invoice", "table", "build", "section", "user", "config", "module", "index", "version", "figure", "item", "record", "internal", "standard"]
ALPHABETS = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"]


def planted(r: np.random.Generator) -> tuple[str, str]:
    """(announcement, key) of a secret that no base rule finds: a random string, some with an issuer's prefix."""
    letters = list(ALPHABETS[r.integers(len(ALPHABETS))])
    n = int(r.integers(16, 32 if letters[:10] == list("0123456789") else 72))
    key = "".join(r.choice(letters, n))
    if r.random() < 0.3:
        key = PREFIXES[r.integers(len(PREFIXES))] + key
    before = f"{ANNOUNCE[r.integers(len(ANNOUNCE))]}{(' ', ': ', '=', ' = ', chr(34))[r.integers(5)]}" if r.random() < 0.5 else ""
    return before, key


def harmless(r: np.random.Generator) -> tuple[str, str]:
    """(announcement, run) of what looks like a key and is none."""
    word = lambda: ORDINARY[r.integers(len(ORDINARY))]
    digits = lambda n: "".join(r.choice(list("0123456789"), n))
    kind = int(r.integers(7))
    if kind == 0:
        run = digits(int(r.integers(12, 20)))
    elif kind == 1:
        run = f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(4)}"
    elif kind == 2:
        run = ("_", "-", "/")[r.integers(3)].join(word() for _ in range(int(r.integers(3, 7))))
    elif kind == 3:
        run = f"{word()}-{word()}-{digits(int(r.integers(1, 6)))}"
    elif kind == 4:
        run = str(r.choice(list("=-_+/xX0")) * int(r.integers(12, 60)))
    elif kind == 5:
        run = "".join(word().title() for _ in range(int(r.integers(2, 5)))) + digits(int(r.integers(0, 3)))
    else:
        run = f"/{word()}/{word()}/{word()}{digits(2)}/{word()}"
    before = f"{(word(), ANNOUNCE[r.integers(len(ANNOUNCE))])[int(r.random() < 0.2)]}{(' ', ': ', '=', ' = ')[r.integers(4)]}" if r.random() < 0.5 else ""
    return before, run.ljust(12, "0")


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates that no base rule marks, window by window, with their surroundings."""
    schema = pa.schema([("left", pa.string()), ("middle", pa.string()), ("right", pa.string())])
    for batch in batches:
        for part in slices(batch):
            rows = {}
            for text in part.column("text").to_pylist():
                text = text or ""
                runs = candidates(text)
                for span in beside(text, base_spans(text, runs), runs):
                    rows |= {_window(text, a, b): None for a, b in places(*span)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def labelled_findings(found: list[tuple[str, str, str]], least: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, marks and labels for training: the given unmarked findings, planted secrets and hard negatives in their surroundings.

    As many of either kind, ``least`` at least.
    """
    r = np.random.default_rng(seed)
    found = sorted(found)
    around = [(a, c) for a, _, c in found] or [("", "")]
    half = max(least, len(found))
    rows = [(a, m, c, 0) for a, m, c in found]
    while len(rows) < half + half // 4 or len(rows) < 2 * half + half // 4:
        y = int(len(rows) >= half + half // 4)
        (before, run), (a, c) = (planted if y else harmless)(r), around[r.integers(len(around))]
        end = c[:1] if not c[:1] or not _CANDIDATE.match(c[:1] * 12) else " "
        left, text = (a.rstrip("=:'\"")[: CONTEXT - len(before) - 1] if before else a), ""
        text = f"{left}{' ' if left[-1:].isalnum() else ''}{before}"
        at, text = len(text), f"{text}{run}{end}{c[1:]}"
        p, q = (places(at, at + len(run)))[0 if len(run) <= WIDTH else int(r.integers(len(places(at, at + len(run)))))]
        rows.append((text[max(0, p - CONTEXT) : p], text[p:q], text[q : q + CONTEXT], y))
    return *_coded([r[:3] for r in rows]), np.array([y for *_, y in rows], np.float32)


def fit_network(docs: DataFrame, recall: float = 0.98, sample_findings: int = SAMPLE_FINDINGS) -> Network:
    """A network trained on at most ``sample_findings`` unmarked findings of all documents and as many planted secrets.

    Of the distinct findings those with the least hashes are kept, so the sample doesn't hang on the order of rows.
    Their number, which may be off by a few percent, tells which hashes can be among them; only these, a few times the
    sample, are made distinct and sorted, so findings are not shuffled.
    """
    found = docs.select("text").mapInArrow(_findings, "left string, middle string, right string")
    found = materialize(found.withColumn("hash", F.xxhash64("middle", "left", "right")), "findings")
    share = min(1.0, 4 * sample_findings / max(1, found.agg(F.approx_count_distinct("hash")).first()[0]))
    low = found.where(F.col("hash") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)).distinct()
    kept = low.orderBy("hash", "left", "middle", "right").drop("hash").limit(sample_findings).toPandas()
    return Network().fit(*labelled_findings(list(kept.itertuples(index=False, name=None)), sample_findings // 4), recall)


def spans_of(texts: list[str], network: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: base ones, and candidates beside them that the network finds."""
    base, learned = [], [[] for _ in texts]
    held: dict[tuple[str, str, str], int] = {}  # equal windows are judged once
    where = []

    def judge() -> None:
        if where:
            secret = (network.probability(*_coded(held)) >= network.threshold).tolist()
            for (i, a, b), k in where:
                if secret[k] and learned[i][-1:] != [(a, b, "learned")]:  # windows come in order of place
                    learned[i].append((a, b, "learned"))
            held.clear()
            where.clear()

    for i, t in enumerate(texts):
        runs = candidates(t)
        base.append(base_spans(t, runs))
        if network.threshold <= 1:
            for a, b in beside(t, base[i], runs):
                for p, q in places(a, b):
                    where.append(((i, a, b), held.setdefault(_window(t, p, q), len(held))))
                    if len(where) >= 4096:  # a very long candidate is judged in parts; any of them is enough
                        judge()
    judge()
    return [sorted(s + x, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if x else s for s, x in zip(base, learned, strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end of the spans, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(network):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = spans_of([t or "" for t in part.column("text").to_pylist()], network.value)
                base = [[s for s in x if s[2] != "learned"] for x in found]
                columns = [part.column("doc_id"), *([sum(s[2] == k for s in x) for x in found] for k in KINDS), [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], [joined(x) for x in found]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def scan_secrets(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_learned, base_sha256 and all spans of every document."""
    network = network or fit_network(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(network)), "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by a note of its kind; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; n_chars, if it is there, follows. Null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(network or fit_network(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = spans_of([t or "" for t in texts], sent.value)
                clean = [t if t is None else redact(t, s) for t, s in zip(texts, found, strict=True)]
                columns = [*part.columns]
                columns[at] = pa.array(clean, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
