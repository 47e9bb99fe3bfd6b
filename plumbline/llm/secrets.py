"""Secret scans by a linear-chain conditional random field.

Tokens are tagged begin, inside or outside.  Each has a class from its shape (kinds of characters, length);
no word is known beforehand as one that announces a secret; emissions are sums of weights for its own class, those of its
neighbours, the words before it (by a hash of the lower-cased word, learned from the data) and features of the
file (length, share of punctuation).  The model is fitted here, by gradient
ascent on the likelihood, to windows around the matches of fixed patterns in a bounded sample; Viterbi
decoding is exact.  Tokens whose "outside" score exceeds the others by more than all transitions can make
good are outside in every best path, so only the stretches between them need the recursion.

Matches of the fixed patterns always stay; the field adds spans of its own (kind "crf").
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slabs, small_batches, word_hashes

#: The patterns, in the order of kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
#: Documents with and without a match that the model is fitted on, at most.
SAMPLE = 1500
B, I, O = range(3)  # noqa: E741

_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 one of +/_-, 4 other, 5 space, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[list(b"+/_-")] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 5
_KIND[128:] = 6
_HEXY = np.zeros(256, bool)
_HEXY[list(b"0123456789abcdef")] = True
N_CLASS, N_FILE, N_WORD = 192, 8, 4096
#: A match of the patterns that counts, for choosing the sample.
MATCH = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the matches of the fixed patterns, in code points, by start and then kind."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), class, word (0: none), file class of each token of a slab, and the first token of each document.

    A token is a run of ASCII letters, digits and +/_-, a run of bytes beyond ASCII, or one other character."""
    kind = _KIND[raw]
    group = np.where(kind <= 3, 0, kind)
    new = np.ones(len(raw), bool)
    if len(raw):
        new[1:] = (group[1:] != group[:-1]) | (group[1:] == 4)
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        new[edges] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(raw))
    keep = group[s] != 5 if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    first = np.searchsorted(s, offsets)
    total = lambda flag: (c := np.concatenate([[0], np.cumsum(flag, dtype=np.int64)]))[e] - c[s]
    lower, upper, digit, mark, hexy = (total(x) for x in (kind == 0, kind == 1, kind == 2, kind == 3, _HEXY[raw]))
    length = e - s
    size = np.searchsorted([4, 8, 12, 16, 20, 28, 40], length, "right")
    shape = (lower > 0) * 1 + (upper > 0) * 2 + (digit > 0) * 4 + (mark > 0) * 8
    cls = 16 + size * 16 + shape
    cls[(hexy == length) & (digit > 0) & (lower > 0)] = 144 + size[(hexy == length) & (digit > 0) & (lower > 0)]
    one = group[s] == 4 if len(s) else keep
    char = raw[s[one]] if len(s) else raw[:0]
    code = np.full(len(char), 1)
    for k, group_of in enumerate((b"=", b":", b"\"'`", b".,;!?", b"()[]{}<>", b"#*$%&|~^@")):
        code[np.isin(char, list(group_of))] = 2 + k
    cls[one] = code
    cls[group[s] == 6 if len(s) else keep] = 9
    word = np.zeros(len(s), np.int64)
    plain = np.flatnonzero((shape & 3 > 0) & (shape & 4 == 0) & (length >= 2) & (length <= 16))
    if len(plain):
        h = word_hashes(raw, s[plain], e[plain], lower=True)
        word[plain] = 1 + (h % np.uint64(N_WORD - 1)).astype(np.int64)
    n = np.diff(first)
    punct = np.concatenate([[0], np.cumsum(one, dtype=np.int64)])
    share = (punct[first[1:]] - punct[first[:-1]]) / np.maximum(n, 1)
    file = np.searchsorted([50, 500, 5000], n, "right") * 2 + (share > 0.25)
    return s, e, cls, word, np.repeat(file, n), first


class Field:
    """Weights: emissions by class at offsets -3..1, by word at offsets -3..-1, by file class, transitions, start."""

    OFFSETS, WORDS = (-3, -2, -1, 0, 1), (-3, -2, -1)

    def __init__(self) -> None:
        self.emit = np.zeros((len(self.OFFSETS), N_CLASS, 3))
        self.word = np.zeros((len(self.WORDS), N_WORD, 3))
        self.file = np.zeros((N_FILE, 3))
        self.step = np.zeros((3, 3))
        self.step[O, I] = -30.0  # inside follows begin or inside only

    def around(self, cls: np.ndarray, word: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """The class at each offset and then the word at each of its offsets, 0 beyond the document."""
        out = np.zeros((len(self.OFFSETS) + len(self.WORDS), len(cls)), np.int64)
        for k, d in enumerate(self.OFFSETS + self.WORDS):
            what = cls if k < len(self.OFFSETS) else word
            a, b = max(0, -d), len(cls) - max(0, d)
            if a < b:
                same = doc_of[a:b] == doc_of[a + d : b + d]
                out[k, a:b] = np.where(same, what[a + d : b + d], 0)
        return out

    def _table(self, k: int) -> np.ndarray:
        return self.emit[k] if k < len(self.OFFSETS) else self.word[k - len(self.OFFSETS)]

    def scores(self, near: np.ndarray, file: np.ndarray) -> np.ndarray:
        return sum(self._table(k)[near[k]] for k in range(len(near))) + self.file[file]

    def fit(self, near: np.ndarray, file: np.ndarray, tag: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Adam on the mean log-likelihood of sequences of one length: near (offset, sequence, time), file and tag (sequence, time)."""
        n, length = tag.shape
        names = ("emit", "word", "file", "step")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        truth = np.eye(3)[tag]
        for r in range(1, rounds + 1):
            e = self.scores(near.reshape(len(near), -1), file.ravel()).reshape(n, length, 3)
            fwd, bwd = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            fwd[:, 0] = e[:, 0]
            lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
            for i in range(1, length):
                fwd[:, i] = e[:, i] + lse(fwd[:, i - 1, :, None] + self.step, 1)
            for i in range(length - 2, -1, -1):
                bwd[:, i] = lse(self.step[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            z = lse(fwd[:, -1], 1)
            diff = (truth - np.exp(fwd + bwd - z[:, None, None])).reshape(-1, 3) / n
            grad = {k: np.zeros_like(getattr(self, k)) for k in names}
            for k in range(len(near)):
                table = grad["emit"][k] if k < len(self.OFFSETS) else grad["word"][k - len(self.OFFSETS)]
                for t in range(3):
                    table[:, t] += np.bincount(near[k].ravel(), diff[:, t], len(table))
            np.add.at(grad["file"], file.ravel(), diff)
            pairs = np.exp(fwd[:, :-1, :, None] + self.step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
            grad["step"] = (np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pairs) / n
            for k in names:
                g = grad[k] - decay * getattr(self, k) * (k != "step")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                getattr(self, k)[...] += rate * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)
            self.step[O, I] = -30.0

    def decode(self, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best tags of each document; starts flags its first token."""
        tags = np.full(len(e), O)
        free = self.step.copy()
        free[O, I] = free[O, O]
        swing = 2 * (free.max() - free.min())
        open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= swing)
        if not len(open_):
            return tags
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) != 1) | starts[open_[1:]]
        begin = np.flatnonzero(new)
        for a, b in zip(open_[begin].tolist(), open_[np.append(begin[1:], len(open_)) - 1].tolist()):
            best = e[a] + (self.step[O] if not starts[a] else np.array([0.0, -30.0, 0.0]))
            back = []
            for i in range(a + 1, b + 1):
                ways = best[:, None] + self.step
                back.append(ways.argmax(0))
                best = ways.max(0) + e[i]
            if b + 1 < len(e) and not starts[b + 1]:
                best = best + self.step[:, O]
            t = int(best.argmax())
            tags[b] = t
            for i in range(b - 1, a - 1, -1):
                t = int(back[i - a][t])
                tags[i] = t
        return tags


def _tags(text: str, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The tags that the base matches give to tokens (byte positions), a secret being an assignment's value or a whole match."""
    tag = np.full(len(s), O)
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [(a, b) for a, b, k in base(text) if k]
    for a, b in values:
        x, y = len(text[:a].encode()), len(text[:b].encode())
        hit = np.flatnonzero((s < y) & (e > x))
        tag[hit] = I
        if len(hit):
            tag[hit[0]] = B
    return tag


def _sample(docs: DataFrame, text_col: str, sample: int) -> list[str]:
    """At most `sample` texts with a match of the patterns and as many without, those of least hash.  The numbers of both
    kinds are counted first, and only texts below a hash bound, about twice as many as wanted, are looked at again: what
    comes to the driver does not grow with the table or its tasks."""
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("o")).where("text is not null and length(text) <= 20000")
    match = F.col("text").rlike(MATCH)
    many = rows.agg(F.count_if(match).alias("true"), F.count_if(~match).alias("false")).first()
    out = []
    for which, n in ((match, many["true"]), (~match, many["false"])):
        if n:
            bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * (sample + 10) // n)
            out += [r.text for r in rows.where(F.col("o") <= bound).where(which).distinct().orderBy("o").limit(sample).select("text").collect()]
    return out


def fitted(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, width: int = 16) -> Field:
    """The field fitted to windows of a sample of docs: at most `sample` documents with a match and as many without."""
    some = _sample(docs, text_col, sample)
    field, windows = Field(), ([], [], [])
    rng = np.random.default_rng(11)
    for text in some:
        raw = np.frombuffer(text.encode(), np.uint8)
        s, e, cls, word, file, first = tokens(raw, np.array([0, len(raw)]))
        if len(s) < width:
            continue
        tag = _tags(text, s, e)
        near = field.around(cls, word, np.zeros(len(cls), np.int64))
        at = [max(0, min(int(x) - rng.integers(2, width - 2), len(s) - width)) for x in np.flatnonzero(tag == B)[:4]]
        at += [int(rng.integers(0, len(s) - width + 1)) for _ in range(3)]
        odd = np.flatnonzero((tag == O) & (cls >= 20) & (((cls - 16) & 15) >= 4))[:3]  # tokens with digits that are no secret
        at += [max(0, min(int(x) - width // 2, len(s) - width)) for x in odd]
        blind = near.copy()
        blind[len(field.OFFSETS) :] = 0
        for x in at:  # half of the windows hide their words, for those that announce a secret elsewhere may be others
            near_or_blind = near if rng.random() < 0.5 else blind
            for k, v in zip(windows, (near_or_blind[:, x : x + width], file[x : x + width], tag[x : x + width])):
                k.append(v)
    if windows[0]:
        field.fit(np.stack(windows[0], axis=1), np.stack(windows[1]), np.stack(windows[2]))
    else:
        field.file[:, O] = 100.0  # nothing to learn from: all outside
    return field


def _spans(field: Field, raw: np.ndarray, offsets: np.ndarray, texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """All spans of each document of a slab, base and added, by start and then kind."""
    s, e, cls, word, file, first = tokens(raw, offsets)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
    starts = np.zeros(len(s), bool)
    starts[first[:-1][first[:-1] < len(s)]] = True
    tag = field.decode(field.scores(field.around(cls, word, doc_of), file), starts) if len(s) else np.zeros(0, np.int64)
    points = None
    added: dict[int, list[tuple[int, int]]] = {}
    begin = np.flatnonzero(tag == B)
    if len(begin):
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
        for i in begin.tolist():
            j = i + 1
            while j < len(tag) and tag[j] == I and doc_of[j] == doc_of[i]:
                j += 1
            d = int(doc_of[i])
            zero = points[offsets[d]]
            added.setdefault(d, []).append((int(points[s[i]] - zero), int(points[e[j - 1]] - zero)))
    for d, text in enumerate(texts):
        found = base(text)
        more = uncovered(added.get(d, []), found)
        yield sorted(found + more, key=lambda x: (x[0], x[2])) if more else found


def uncovered(added: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The added spans (by start) that lie in none of those found (by start): a span lies in one of them if, of those that do not
    start after it, the one that reaches farthest ends no earlier."""
    out, reach, k = [], -1, 0
    for a, b in added:
        while k < len(found) and found[k][0] <= a:
            reach = max(reach, found[k][1])
            k += 1
        if reach < b:
            out.append((a, b, 3))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans) of each row; null and empty texts have no spans.

    Rows stand for themselves, repeated ones give repeated results; spans that start together are ordered by kind.  A very
    long text is tagged whole, in one task; texts over 20,000 characters are not fitted on.  Further columns play no part."""
    field = field or fitted(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for spans in _spans(field, raw, offsets, texts):
                    sure = [x for x in spans if x[2] < 3]
                    row = (*(sum(x[2] == k for x in spans) for k in range(4)), hashlib.sha256(_joined(sure).encode()).hexdigest(), _joined(spans))
                    for k, v in zip(out, row):
                        k.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(v, t) for v, t in zip(out, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with every span, base or added, of its text replaced by <secret>; overlapping spans become one.

    Null and empty texts, all rows and all other columns stay as they are, whatever their names."""
    field = field or fitted(docs, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            column, new = batch.column(k), []
            for a, b, raw, offsets in slabs(column, column):
                was = column.slice(a, b - a).to_pylist()
                for text, spans in zip(was, _spans(field, raw, offsets, [t or "" for t in was])):
                    if not spans:
                        new.append(text)
                        continue
                    parts, at = [], 0
                    for x, y, _ in spans:
                        if x >= at:
                            parts += [text[at:x], "<secret>"]
                        at = max(at, y)
                    new.append("".join(parts) + text[at:])
            columns = list(batch.columns)
            columns[k] = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(work, docs.schema)
