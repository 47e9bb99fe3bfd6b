"""Fill-in-middle transformation by overlapping chunks.

A text is cut into tokens, `[A-Za-z]+|[^A-Za-z]`, and two token ranks drawn from its id split it into prefix, middle
and suffix.  No token is ever built.  A token starts at every code point, but for letters that follow a letter; so
whether one starts is a predicate of a character and the one before it.  Texts are cut into chunks, each seen with
the byte before it, and all chunks of a slab are counted together (starts of tokens, starts of code points).  Running
sums over the chunks of a document give its number of tokens, and send each of the two cut ranks to the chunk that
owns it; only these chunks are looked at again, for the byte of the cut.

A task holds the bytes of about a megabyte of texts, or of one longer text, and beside them two counts for each
chunk; flags live for `PIECE` bytes at a time.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slabs, small_batches

#: Bytes of a chunk, and of the chunks counted at once.
CHUNK, PIECE = 512, 1 << 20
#: What the parts begin with, and the shares (of 100) of texts that are left plain and, of the others, that put the suffix first.
PREFIX, SUFFIX, MIDDLE, PLAIN, SUFFIX_FIRST = b"<P>", b"<S>", b"<M>", 10, 20

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def draws(seed: str, name: str) -> list[int]:
    """Four numbers below 2 ** 32 for a document."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def starts(raw: np.ndarray, a: int, b: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """For bytes a to b whether a token starts there and whether a code point does; the byte before a counts unless `first`."""
    alpha = _ALPHA[raw[max(a - 1, 0) : b]]
    point = (raw[a:b] & 0xC0) != 0x80
    before = alpha[:-1] if a else np.concatenate([[False], alpha[:-1]])
    letter = alpha[1:] if a else alpha
    if first and b > a:
        before = before.copy()
        before[0] = False
    return point & ~(letter & before), point


class Chunks:
    """The chunks of the texts of a slab, counted, with running sums."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw = raw
        many = -(-np.diff(offsets) // CHUNK)
        #: The first chunk of each text, with the end; the bytes where chunks begin, with the end.
        self.of = np.concatenate([[0], np.cumsum(many)])
        inner = np.arange(self.of[-1]) - np.repeat(self.of[:-1], many)
        self.begin = np.concatenate([np.repeat(offsets[:-1], many) + inner * CHUNK, offsets[-1:]])
        self.first = inner == 0
        counts = np.zeros((2, len(inner) + 1), np.int64)
        k = 0
        while k < len(inner):
            m = max(k + 1, int(np.searchsorted(self.begin, self.begin[k] + PIECE, "right")) - 1)
            a, b = int(self.begin[k]), int(self.begin[m])
            token, point = starts(raw, a, b, False)
            opens = self.begin[k:m][self.first[k:m]] - a
            token[opens] = point[opens]  # the first of a text starts a token, whatever ends the text before
            at = self.begin[k:m] - a
            counts[0, k + 1 : m + 1] = np.add.reduceat(token.astype(np.int64), at)
            counts[1, k + 1 : m + 1] = np.add.reduceat(point.astype(np.int64), at)
            k = m
        self.tokens, self.points = np.cumsum(counts, 1)

    def total(self, i: int) -> int:
        """The tokens of text i."""
        return int(self.tokens[self.of[i + 1]] - self.tokens[self.of[i]])

    def cut(self, i: int, rank: int) -> tuple[int, int]:
        """The byte (of the slab) at which the token of that rank of text i starts, and the code points of the text before it."""
        lo, hi = int(self.of[i]), int(self.of[i + 1])
        if rank >= self.total(i):
            return int(self.begin[hi]), int(self.points[hi] - self.points[lo])
        goal = int(self.tokens[lo]) + rank
        c = int(np.searchsorted(self.tokens[lo : hi + 1], goal, "right")) - 1 + lo  # the chunk that owns the rank
        token, point = starts(self.raw, int(self.begin[c]), int(self.begin[c + 1]), bool(self.first[c]))
        at = int(np.flatnonzero(token)[goal - self.tokens[c]])
        return int(self.begin[c]) + at, int(self.points[c] - self.points[lo]) + int(np.count_nonzero(point[:at]))


def _forms(seed: str, plain: int, suffix_first: int):
    marked = re.compile(b"|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            names = ids.cast(pa.string()).to_pylist()
            for a, b, raw, offsets in slabs(ids, batch.column(1)):
                chunks, ends, rows = Chunks(raw, offsets), offsets.tolist(), []
                for i in range(b - a):
                    lo, hi, n = ends[i], ends[i + 1], chunks.total(i)
                    text = raw[lo:hi].tobytes()
                    h1, h2, h3, h4 = draws(seed, names[a + i] or "")
                    if not text or h3 % 100 >= 100 - plain or marked.search(text):
                        rows.append((n, "plain", None, None, text))
                        continue
                    (x, px), (y, py) = (chunks.cut(i, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    head, mid, tail = text[: x - lo], text[x - lo : y - lo], text[y - lo :]
                    if h4 % 100 < suffix_first:
                        rows.append((n, "spm", px, py - px, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, mid))))
                    else:
                        rows.append((n, "psm", px, py - px, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, mid))))
                n, form, px, mx, out = zip(*rows)
                columns = [ids[a:b], pa.array(n, pa.int64()), pa.array(form), pa.array(px, pa.int64()), pa.array(mx, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return work


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs: n tokens; form plain, psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle); the lengths in code points are null in plain ones.

    A null text counts as an empty one and is plain, as is a text that holds one of the markers; a null id draws as an
    empty name would.  Rows alike in id and text give equal rows.  A cut may fall on the same place twice, or on either
    end; parts are empty then.  Very long texts are read in pieces, whole; further columns play no part, whatever
    their names.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_forms(seed, plain, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(forms: DataFrame) -> DataFrame:
    """forms with the column `restored`: the text itself, from `form` and `output` alone."""
    part = F.split("output", "<[PSM]>")  # no text that is not plain holds a marker, and none arises where parts meet
    text = F.when(F.col("form") == "psm", F.concat(part[1], part[3], part[2])).when(F.col("form") == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col("output"))
    return forms.withColumn("restored", text)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256); cases as in `transformed`."""
    rows = restored(transformed(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
ORACLE = f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents),
drawn AS (SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n, {_H} FROM cut),
ranked AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
