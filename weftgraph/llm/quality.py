"""Quality rules: counts over whole texts and compression bands.

A text is rejected when its zstandard ratio (compressed bytes by bytes) lies
outside the band of its length, or when too many of its chunks lie outside their
band: repetitive text compresses too well, random text not at all. Chunks have
two sizes, the smaller one under the whole-text band of its length; the last
chunk of each size ends at the end of the text, so every byte is in one.
A text shorter than the smaller size is judged as a whole only.
Texts shorter than the first band have no ratio that means anything and pass.

Defined cases: null and empty texts have no words, so the base rule fails them, as
it does all texts too short for a band. Very long texts are compressed whole.
Repeated rows are judged one by one; a ratio on a limit is inside. Empty tables give
no rows; other columns, also ones named like results, are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from weftgraph.llm.common import byte_texts, map_arrow, pick

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, zstd_ratio double, bad_chunks double"
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits by length: (bytes from, least ratio, greatest ratio), ascending."""

    whole: tuple[tuple[int, float, float], ...] = ((64, 0.25, 1.30), (256, 0.25, 0.90), (1024, 0.22, 0.72), (8192, 0.20, 0.70))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.72)
    fine_bytes: int = 1024
    max_bad_chunks: float = 0.34
    level: int = field(default=3)

    def outside(self, n_bytes: int, ratio: float) -> bool:
        for start, low, high in reversed(self.whole):
            if n_bytes >= start:
                return not low <= ratio <= high
        return False

    def bad_share(self, text: bytes, ratio_of) -> float:
        """The greater share of bad chunks of the two sizes."""
        shares = [0.0]
        for size in (self.chunk_bytes, self.fine_bytes):
            ratios = [ratio_of(c) for c in chunks(text, size)]
            if ratios:
                low, high = self.chunk
                bad = [not low <= r <= high if size == self.chunk_bytes else self.outside(size, r) for r in ratios]
                shares.append(sum(bad) / len(bad))
        return max(shares)


def chunks(text: bytes, size: int) -> list[bytes]:
    """Chunks of one size that cover the text; the last one ends with it. None if it is shorter."""
    starts = list(range(0, len(text) - size + 1, size))
    if starts and len(text) % size:
        starts.append(len(text) - size)
    return [text[i : i + size] for i in starts]


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text.

    bytes.split() without arguments splits on exactly \\x20 and \\x09-\\x0D.
    """
    ws = text.split()
    n_chars = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    word_chars = len(text.translate(None, SPACES)) - n_chars
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    grams = list(zip(ws, ws[1:], ws[2:]))
    n_repeat = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        last = 0  # words before this position are counted
        for i, g in enumerate(grams):
            if counts[g] > 1:
                n_repeat += i + 3 - max(i, last)
                last = i + 3
    return len(ws), word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat


def judge(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios and verdicts of every whole text; see the module."""
    bands = bands or Bands()
    holder: dict[str, zstandard.ZstdCompressor] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = holder.get("z") or holder.setdefault("z", zstandard.ZstdCompressor(level=bands.level, write_content_size=False))
        columns: list[list] = [[] for _ in range(9)]
        for text in byte_texts(batch.column(1)):
            text = text or b""
            counts = base_counts(text)
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            ratio = len(packer.compress(text)) / len(text) if text else 1.0
            bad = bands.bad_share(text, lambda c: len(packer.compress(c)) / len(c))
            kept = not failed and not bands.outside(len(text), ratio) and bad <= bands.max_bad_chunks
            for column, value in zip(columns, (*counts, failed, kept, ratio, bad), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_arrow(pick(docs, id_col, text_col), one, SCHEMA)
