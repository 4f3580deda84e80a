"""Token counts of whole texts, as the tokenizer's own library gives them.

Texts are read in Arrow batches and cut at safe borders: places where the pre-tokenizer ends a match whatever follows, and
starts the next one whatever came before.  The lengths of the pieces then add up to the length of the whole text, so long
texts are never encoded (or held as tokens) whole, and a piece that stands in many texts of a task is encoded once.
Pieces go to the library in batches of about the same number of bytes, and only lengths come back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of pieces handed to the library at once; texts whose pieces are gathered before that; pieces remembered by a task.
BATCH, TEXTS, MEMO = 500_000, 4_000_000, 500_000
#: A piece above this many characters is cut where letters and digits end, too.
LONG = 20_000

# The characters that no version of the pre-tokenizer's classes takes for a blank.
_SOLID = "!-~¡-ɏͰ-ԯぁ-ヿ一-龥가-힣"
_BLANK = " \t\n\r"
_LETTER = "A-Za-zÀ-ÖØ-öø-ƺΑ-ΡΣ-ώА-я"
_MARK = ",.;:!?"
_PIECES = re.compile(f"[{_BLANK}]*(?:[{_LETTER}]+(?=[{_MARK}{_BLANK}]|$)|[^{_BLANK}]+)|[{_BLANK}]+")
_ODD = re.compile(f"[^{_SOLID}{_BLANK}][{_BLANK}]")
_BORDER = re.compile(f"(?<=[{_SOLID}])(?=[{_BLANK}])")
_ENDS = re.compile("(?<=[A-Za-zぁ-ゖァ-ヺ一-龥가-힣])(?=[0-9,.;:()、。！？])|(?<=[0-9])(?=[,.;:()、。！？])")


def pieces(text: str) -> list[str]:
    """A text cut at borders between a solid character and a blank, and between a word's last letter and a mark.

    Every alternative of the pre-tokenizer takes blanks only at its start, letters only without marks, and none looks back,
    so a match never crosses such a border; its only look-ahead stands behind blanks, and no piece ends in one unless the
    text does.  No special string holds a blank or one of these marks.
    """
    found = _BORDER.split(text) if _ODD.search(text) else _PIECES.findall(text)
    if not any(len(p) > LONG for p in found):
        return found
    return [q for p in found for q in (joined(_ENDS.split(p)) if len(p) > LONG else [p])]


def joined(parts: list[str]) -> list[str]:
    """Neighbouring parts put together up to ``LONG`` characters."""
    out, held, size = [], [], 0
    for p in parts:
        if held and size + len(p) > LONG:
            out.append("".join(held))
            held, size = [], 0
        held.append(p)
        size += len(p)
    return [*out, "".join(held)]


class Lengths:
    """Tokens of pieces, remembered within bounds."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def learn(self, wanted: set[str]) -> None:
        batch, size = [], 0
        for p in wanted:
            batch.append(p)
            size += len(p)
            if size >= BATCH:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
            self.known[p] = len(e)

    def of(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = set().union(*cut)
        self.learn(new)
        known = self.known
        return [sum([known[p] for p in c]) for c in cut]


def _path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every row.

    ``tokenizer`` names a byte-level file of the public tokenizers, or gives a path.  No begin, end or added special
    tokens, no truncation or padding; special strings in a text are handled as the library does by default.  Null and empty
    texts have no bytes and no tokens; null ids and repeated rows are counted like any other; an empty table gives no
    rows; other columns are ignored, whatever their names.  A text of any length is cut into pieces; an unbroken run of one
    kind of letters is one piece.  The work is one pass over the scan, without a shuffle.
    """
    file = tokenizer if os.path.sep in tokenizer else _path(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(file)
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
            # rows of about the same number of bytes: each group of texts, however many or long, costs alike
            group = (np.cumsum(size) - size) // TEXTS
            starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            counts: list[int] = []
            for a, b in zip(starts, starts[1:]):
                counts += lengths.of(batch.column(1).slice(a, b - a).to_pylist())
            tokens = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
