"""Byte-level BPE with the tiktoken library: ids of whole texts, and their bytes back.

The rank file is read once by the driver, checked for size and sent to the tasks,
so executors need no file of their own.  The library matches its pattern with a
backtracking engine that fails on very long runs of white space; long texts are
therefore cut first, and only at places where no match can reach across:

* between a character that is not white space and one that is,
* between an ASCII letter and an ASCII character that is no letter, and between
  an ASCII digit and an ASCII character that is no digit,
* around a long run of white space: all of it but its last character is one match
  (all of it, at the end of the text), and is encoded as one piece without the
  pattern.

No match of the pattern looks back, and none looks ahead but at white space, so
the cut text has exactly the matches of the whole one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import with_fields

#: a rank file beyond this is refused: what is sent to every executor is bounded by it
MAX_RANK_BYTES = 64 << 20
#: texts of more characters are cut before they are matched
LONG_CHARS = 1 << 16
#: runs of white space of this length are taken out before matching
LONG_SPACE = 1 << 10

_SPACES = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=[A-Za-z])(?=[\x21-\x40\x5B-\x60\x7B-\x7E])|(?<=[0-9])(?=[\x21-\x2F\x3A-\x7E])")


class Codec:
    """Ids and bytes by the ranks of one file."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = np.zeros(self.encoding.max_token_value + 1, bool)
        self.known[list(ranks.values())] = True

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_CHARS:
            if len(text) < LONG_SPACE or not _SPACES.search(text):
                return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for part, alone in cut(text):
            out += self.encoding._core_bpe.encode_single_piece(part.encode()) if alone else self.encoding.encode_ordinary(part)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the rank file")
        return self.encoding.decode_bytes(ids.tolist())


def cut(text: str, size: int = LONG_CHARS) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of the text, and whether a part is one match by itself."""
    at = 0
    for run in [*(m.span() for m in _SPACES.finditer(text)), None]:
        a, z = run or (len(text), len(text))
        while a - at > size and (m := _SAFE.search(text, at + size, a)):
            yield text[at : m.start()], False
            at = m.start()
        if at < a:
            yield text[at:a], False
        at = z - (z < len(text))
        if a < at:
            yield text[a:at], True


@tk.kept(2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def codec(sent: Broadcast) -> Codec:
    """One codec for each worker and rank file."""
    return _codec(*sent.value)


def rank_file(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The file's bytes and the pattern, for all tasks; a file over ``MAX_RANK_BYTES`` is an error."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast((raw, pattern))


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES`` of text, one row at least."""
    offsets, a = tk.text_buffers(column)[1], 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + tk.SLICE_BYTES, "right")) - 1)
        yield a, z
        a = z


ENCODED = "token_ids array<int>, n_tokens long, ids_sha256 string"


def encode_texts(docs: DataFrame, ranks: Broadcast, text: str = "text") -> DataFrame:
    """All columns plus ``token_ids``, ``n_tokens`` and ``ids_sha256`` (which replace clashing names).

    Every match of the pattern is encoded by itself, without special tokens: a
    text that spells a special token is ordinary text.  A null or empty text has
    no ids.  ``ids_sha256`` is the digest of the ids as little-endian unsigned
    32-bit integers, in lower-case hex.  Repeated rows stay.  One pass, no
    shuffle; memory is bounded by 1 MB of texts, or by the longest one.
    """
    names = [f.split()[0] for f in ENCODED.split(", ")]
    keep = [c for c in docs.columns if c not in names or c == text]
    docs = docs.select(*keep)
    at_text = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks).encode
        for whole in batches:
            for a, z in _slices(whole.column(at_text)):
                b = whole.slice(a, z - a)
                ids = [np.array(encode(t) if t else [], "<u4") for t in b.column(at_text).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sizes), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())], [*keep, *names])

    return docs.mapInArrow(tk.tidy(run), with_fields(docs.schema, ENCODED))


def decode_ids(rows: DataFrame, ranks: Broadcast, ids: str = "token_ids", with_bytes: bool = True) -> DataFrame:
    """All columns plus ``decoded`` (binary) and ``decoded_sha256`` (which replace clashing names).

    The raw bytes of the ids are joined and never decoded to characters, so a cut
    sequence that ends inside a character comes back as it was.  Null ids give
    null bytes and the digest of none; null entries of the list are skipped; an
    id that the rank file lacks is an error.  ``with_bytes`` false leaves
    ``decoded`` null where only the digest is wanted.
    """
    keep = [c for c in rows.columns if c not in ("decoded", "decoded_sha256")]
    rows = rows.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(ranks).decode
        for b in batches:
            column = b.column(len(keep))
            raw = [decode(column[i].values.drop_null().to_numpy()) if column[i].is_valid else None for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw if with_bytes else [None] * len(raw), pa.binary()), pa.array([hashlib.sha256(x or b"").hexdigest() for x in raw], pa.string())], [*keep, "decoded", "decoded_sha256"])

    return rows.mapInArrow(tk.tidy(run), with_fields(rows.drop("_ids").schema, "decoded binary, decoded_sha256 string"))
