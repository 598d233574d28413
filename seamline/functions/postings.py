"""Posting lists of the trigrams of whole lines, cut from Arrow batches in windows of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES, WINDOW = 2 << 20, 2 << 20
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END, _NONE = 10, 8


def posting_lists(batches, piece_bytes: int = PIECE_BYTES, window: int = WINDOW):
    """Batches of (trigram, keys, masks) from batches of (key, text): a row for each trigram of a window of the text.

    A window may begin within a text, so a key can be in several lists of a trigram; its mask is all of theirs together.
    """
    for b in batches:
        step = max(1, b.num_rows * piece_bytes // max(piece_bytes, b.nbytes))
        for at in range(0, b.num_rows, step):
            piece = b.slice(at, step)
            text = pc.fill_null(piece.column(1).cast(pa.large_string()), pa.scalar("", pa.large_string()))
            n_lines = np.asarray(pc.count_substring(text, "\n")) + 1
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(text)], text), pa.scalar("\n", text.type))[0].as_buffer()
            chars = joined.to_pybytes().translate(_FOLD).decode("utf-8", "replace") + "\n\n\n"
            chars = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
            row_of_line = np.repeat(np.arange(len(text), dtype=np.int32), n_lines)
            line = 0
            for start in range(0, len(chars) - 3, window):
                part = chars[start : start + window + 3]
                ends = np.cumsum(part[:-3] == _END, dtype=np.int32)
                rows = row_of_line[line + ends]
                line += int(ends[-1])
                out = _lists(part, rows, piece.column(0))
                if out is not None:
                    yield out


def _lists(chars: np.ndarray, rows: np.ndarray, keys: pa.Array) -> pa.RecordBatch | None:
    """The lists of the trigrams that lie within a line; ``rows`` has the row of each character but the last three,
    which only follow others."""
    n, end = len(rows), chars == _END
    ok = ~(end[:n] | end[1 : n + 1] | end[2 : n + 2])
    if not ok.any():
        return None
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(len(seen), np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    w, row_bits = len(alphabet).bit_length(), len(keys).bit_length()
    ranks = rank[chars]
    found = ranks[:n] << 2 * w
    found |= ranks[1 : n + 1] << w
    found |= ranks[2 : n + 2]
    found = found[ok]
    del ranks
    names = None
    if 3 * w + row_bits + 4 > 63:
        names, found = np.unique(found, return_inverse=True)
    # In one number, so that one sort does: trigram, row and the bit of the next character.
    found <<= row_bits
    found |= rows[ok]
    found <<= 4
    found |= np.where(end[3:], _NONE, chars[3:] * 31 & 7).astype(np.uint8)[ok]
    found.sort()
    found = found[_first(found)]
    pair = found >> 4
    head = np.flatnonzero(_first(pair))
    masks = np.bitwise_or.reduceat((1 << (found & 15) & 255).astype(np.int32), head)
    pair = pair[head]
    gram = pair >> row_bits
    head = np.flatnonzero(_first(gram))
    offsets = pa.array(np.append(head, len(pair)), pa.int32())
    code = gram[head] if names is None else names[gram[head]]
    low = (1 << w) - 1
    letters = alphabet[np.stack([code >> 2 * w, code >> w & low, code & low], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
    listed = keys.take(pa.array(pair & (1 << row_bits) - 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)], pa.string()),
            pa.ListArray.from_arrays(offsets, listed),
            pa.ListArray.from_arrays(offsets, pa.array(masks)),
        ],
        ["trigram", "keys", "masks"],
    )


def _first(of: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([[True], of[1:] != of[:-1]])
