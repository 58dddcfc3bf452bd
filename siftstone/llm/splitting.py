"""Problem 4: oversized code cut into pieces at natural boundaries, with an overlap.

Boundaries are line starts, ranked by what they part: functions (nothing open, no indentation), blocks (a blank line
before, a closing line before, or less indentation than before) or just lines. Within long lines any 16th token is a
boundary of last resort. Dynamic programming over the boundaries minimises penalties plus the squared room left in
each piece, under the limit of tokens. Costs are whole numbers, so equal ones are equal; of several best programs that with the
longest last piece is taken, then the longest before it, and so on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.sources.tables import table

#: A run of word characters or one other character that is not White_Space (Python's \s also holds 1C to 1F).
TOKEN = re.compile(r"\w+|[^\w\s]|[\x1c-\x1f]")
LIMIT = 510
OVERLAP = 64
#: Penalties of a cut between functions, blocks, lines, and within a line, in tenths of the cost of a piece.
PENALTIES = (0, 3, 10, 10_000)
_STRIDE = 16


def boundaries(code: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers at which ``code`` may be cut, and the penalty of each; ``starts`` are the tokens' offsets."""
    n = len(starts)
    chars = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = (chars == 10) | (chars == 13)
    line_of = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(ends, out=line_of[1:])
    depth = np.zeros(len(chars) + 1, np.int64)
    np.cumsum((chars == 123).astype(np.int8) - (chars == 125), out=depth[1:])
    lines = line_of[starts]
    first = np.flatnonzero(np.concatenate([[False], lines[1:] != lines[:-1]]))  # tokens that begin a line
    line_start = np.concatenate([[0], np.flatnonzero(ends) + 1])
    indent = starts - line_start[lines]
    heads = np.concatenate([[0], first])
    before = np.concatenate([[0], indent[heads][:-1]])[1:] if len(heads) > 1 else np.zeros(0, np.int64)
    if len(first):
        line_ends = np.cumsum((chars == 10) | ((chars == 13) & (np.append(chars[1:], 0) != 10)))  # CRLF counts once
        blank = line_ends[starts[first] - 1] - line_ends[starts[first - 1]] > 1
        closing = chars[starts[first - 1]] == 125
    else:
        blank = closing = np.zeros(0, bool)
    penalty = np.full(len(first), PENALTIES[2], np.int64)
    penalty[blank | closing | (indent[first] < before)] = PENALTIES[1]
    penalty[(indent[first] == 0) & (depth[starts[first]] == 0) & (chars[starts[first]] != 125)] = PENALTIES[0]
    edges = np.concatenate([[0], first, [n]])
    long = np.flatnonzero(np.diff(edges) > OVERLAP)
    if len(long):
        inner = np.concatenate([np.arange(edges[k] + _STRIDE, edges[k + 1], _STRIDE) for k in long])
        first = np.concatenate([first, inner])
        penalty = np.concatenate([penalty, np.full(len(inner), PENALTIES[3], np.int64)])
        order = np.argsort(first, kind="stable")
        first, penalty = first[order], penalty[order]
    return first, penalty


def cuts(n: int, at: np.ndarray, penalty: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The best cuts of ``n`` tokens at some of ``at``: every piece, with its overlap, within ``limit``."""
    if n <= limit:
        return []
    usable = at >= overlap  # the first piece must supply a whole overlap
    points = np.concatenate([[0], at[usable], [n]])
    cost = np.concatenate([[0], penalty[usable], [0]]).astype(np.int64) * limit**2
    m = len(points)
    best, source = np.zeros(m, np.int64), np.zeros(m, np.int64)
    begin = np.maximum(points - overlap, 0)
    begin[0] = 0  # where a piece that follows a cut begins
    lows = np.searchsorted(begin, points - limit)  # the first cut from which a piece still reaches each point
    for j in range(1, m):
        low = lows[j]
        total = best[low:j] + 10 * (limit - points[j] + begin[low:j]) ** 2
        k = int(total.argmin())  # the first of equal ones
        best[j], source[j] = total[k] + 10 * limit**2 + cost[j], low + k
    out, j = [], int(source[m - 1])
    while j:
        out.append(int(points[j]))
        j = int(source[j])
    return out[::-1]


def pieces_of(code: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first character, last character + 1, tokens) of each piece.

    A piece ends where the next one's own tokens begin, so the pieces without their overlaps join to ``code``.
    """
    if len(code) <= limit:
        return [(0, len(code), len(TOKEN.findall(code)))]
    starts = np.array([m.start() for m in TOKEN.finditer(code)], np.int64)
    n = len(starts)
    if n <= limit:
        return [(0, len(code), n)]
    found = cuts(n, *boundaries(code, starts), limit, overlap)
    begin, end = [0, *[c - overlap for c in found]], [*found, n]
    return [(0 if b == 0 else int(starts[b]), len(code) if e == n else int(starts[e]), e - b) for b, e in zip(begin, end)]


def split_oversized(df: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(item_id, piece_no, n_pieces, start_char, end_char, n_tokens[, piece]) for every row with text.

    Null text has no piece; empty and blank text, and any within ``limit``, has one. Texts of any length are taken whole, also a
    single line of millions of tokens. Repeated rows come out repeatedly; other columns of ``df`` are not read.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                part = whole.slice(start, 1000)
                rows, numbers = [], []
                for k, code in enumerate(part.column(1).to_pylist()):
                    got = pieces_of(code, limit, overlap)
                    rows += [(i + 1, len(got), a, b, t, *([code[a:b]] if with_text else [])) for i, (a, b, t) in enumerate(got)]
                    numbers += [k] * len(got)
                types = [pa.int32()] * 5 + [pa.string()] * with_text
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(numbers, pa.int64())), *columns], names)

    names = ["item_id", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", *["piece"] * with_text]
    schema = f"item_id {kind}, piece_no int, n_pieces int, start_char int, end_char int, n_tokens int" + ", piece string" * with_text
    return df.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).where("text is not null").mapInArrow(run, schema)


def _pieces(spark, sf_dir: str, with_text: bool) -> DataFrame:
    both = [("dataset_ml_ready", "sample_id"), ("code_payload", "payload_id")]
    parts = [
        split_oversized(table(spark, sf_dir, name, key, "code"), key, "code", with_text=with_text).withColumn("table_name", F.lit(name)) for name, key in both
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Each item that comes out in more than one piece."""
    return _pieces(spark, sf_dir, False).where("piece_no = 2").select("table_name", "item_id")


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of the items above the limit, with their text."""
    return _pieces(spark, sf_dir, True).where("n_pieces > 1")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
