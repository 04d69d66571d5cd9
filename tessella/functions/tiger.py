"""Tiger hash, its tree hash and bitprints, from the published algorithm.

The substitution tables are not stored: they are generated by the rule published
with the algorithm, which runs its own compression function. Leaves of the tree
hash are compressed side by side in arrays.
"""

from __future__ import annotations

from base64 import b32encode
from functools import lru_cache
from hashlib import sha1

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_U = np.uint64
#: Initial state, and the text and number of passes that the tables are generated with (fixed values).
_START = (0x0123456789ABCDEF, 0xFEDCBA9876543210, 0xF096A5B4C3B2E187)
_SEED = b"Tiger - A Fast New Hash Function, by Ross Anderson and Eli Biham"
_PASSES = 5
LEAF = 1024


def _compress(tables, state, x):
    """One block for each column: state is three arrays, x eight arrays of words."""
    a, b, c = state
    x = list(x)

    def turns(a, b, c, factor):
        v = [a, b, c]
        for i, word in enumerate(x):
            p, q, r = i % 3, (i + 1) % 3, (i + 2) % 3
            v[r] = v[r] ^ word
            byte = [((v[r] >> _U(8 * k)) & _U(255)).astype(np.intp) for k in range(8)]
            v[p] = v[p] - (tables[0][byte[0]] ^ tables[1][byte[2]] ^ tables[2][byte[4]] ^ tables[3][byte[6]])
            v[q] = (v[q] + (tables[3][byte[1]] ^ tables[2][byte[3]] ^ tables[1][byte[5]] ^ tables[0][byte[7]])) * _U(factor)
        return v

    def schedule():
        x[0] = x[0] - (x[7] ^ _U(0xA5A5A5A5A5A5A5A5))
        x[1] = x[1] ^ x[0]
        x[2] = x[2] + x[1]
        x[3] = x[3] - (x[2] ^ (~x[1] << _U(19)))
        x[4] = x[4] ^ x[3]
        x[5] = x[5] + x[4]
        x[6] = x[6] - (x[5] ^ (~x[4] >> _U(23)))
        x[7] = x[7] ^ x[6]
        x[0] = x[0] + x[7]
        x[1] = x[1] - (x[0] ^ (~x[7] << _U(19)))
        x[2] = x[2] ^ x[1]
        x[3] = x[3] + x[2]
        x[4] = x[4] - (x[3] ^ (~x[2] >> _U(23)))
        x[5] = x[5] ^ x[4]
        x[6] = x[6] + x[5]
        x[7] = x[7] - (x[6] ^ _U(0x0123456789ABCDEF))

    p, q, r = turns(a, b, c, 5)
    schedule()
    r, p, q = turns(r, p, q, 7)
    schedule()
    q, r, p = turns(q, r, p, 9)
    return p ^ a, q - b, r + c


@lru_cache(1)
def _tables() -> np.ndarray:
    cells = np.tile(np.arange(256, dtype=np.uint8)[None, :, None], (4, 1, 8))  # table, row, byte
    words = lambda: cells.copy().view("<u8")[:, :, 0]
    block = np.frombuffer(_SEED, "<u8").astype(_U)
    state = tuple(np.array([v], _U) for v in _START)
    turn = 2
    for _ in range(_PASSES):
        for row in range(256):
            for table in range(4):
                turn += 1
                if turn == 3:
                    turn = 0
                    state = _compress(words(), state, [block[i : i + 1] for i in range(8)])
                other = state[turn].view(np.uint8)  # little-endian bytes of one word
                for byte in range(8):
                    o = int(other[byte])
                    cells[table, row, byte], cells[table, o, byte] = cells[table, o, byte], cells[table, row, byte]
    return words()


def tiger_many(messages: list[bytes]) -> list[bytes]:
    """Tiger of messages that all have the same length."""
    n, size = len(messages), len(messages[0])
    tail = b"\x01" + b"\x00" * ((55 - size) % 64) + (8 * size).to_bytes(8, "little")
    data = np.frombuffer(b"".join(m + tail for m in messages), "<u8").astype(_U).reshape(n, -1)
    state = tuple(np.full(n, v, _U) for v in _START)
    tables = _tables()
    for at in range(0, data.shape[1], 8):
        state = _compress(tables, state, [data[:, at + i] for i in range(8)])
    packed = np.stack(state, axis=1).astype("<u8").tobytes()
    return [packed[24 * i : 24 * i + 24] for i in range(n)]


def tiger_trees(contents: list[bytes]) -> list[bytes]:
    """Tree hash of each content: 1024-byte leaves after a zero byte, pairs of nodes after a one byte."""
    leaves = [(k, content[i : i + LEAF]) for k, content in enumerate(contents) for i in range(0, max(1, len(content)), LEAF)]
    rows: list[list] = [[] for _ in contents]
    by_size: dict[int, list[int]] = {}
    for j, (_, leaf) in enumerate(leaves):
        by_size.setdefault(len(leaf), []).append(j)
    hashes: list = [b""] * len(leaves)
    for places in by_size.values():
        for j, h in zip(places, tiger_many([b"\x00" + leaves[j][1] for j in places]), strict=True):
            hashes[j] = h
    for (k, _), h in zip(leaves, hashes, strict=True):
        rows[k].append(h)
    while any(len(r) > 1 for r in rows):
        pairs = [(k, i) for k, r in enumerate(rows) for i in range(0, len(r) - 1, 2)]
        merged = iter(tiger_many([b"\x01" + rows[k][i] + rows[k][i + 1] for k, i in pairs]))
        rows = [[next(merged) if i + 1 < len(r) else r[i] for i in range(0, len(r), 2)] for r in rows]
    return [r[0] for r in rows]


def bitprint_names(contents: list[bytes]) -> list[str]:
    name = lambda b: b32encode(b).decode().rstrip("=")
    return [f"urn:bitprint:{name(sha1(c).digest())}.{name(t)}" for c, t in zip(contents, tiger_trees(contents), strict=True)]


def _bitprints(content: pd.Series) -> pd.Series:
    there = content.notna()
    out = pd.Series([None] * len(content), index=content.index, dtype=object)
    if there.any():
        out[there] = bitprint_names([bytes(c) for c in content[there]])
    return out


def bitprint(content: Column) -> Column:
    """urn:bitprint name of a binary column."""
    return F.pandas_udf(_bitprints, StringType())(content)
