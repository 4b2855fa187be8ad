"""Substitution scores: BLOSUM62, and any NCBI-format matrix by its path."""

from __future__ import annotations

from pathlib import Path

import numpy as np

#: Letter order and lower triangle of BLOSUM62 (public NCBI matrix).
LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: Fixed value: the score of X with any letter.
UNKNOWN = -1


class Scores:
    """Letter-pair scores as a 256 x 256 table; letters that the matrix lacks score as X."""

    def __init__(self, letters: str, rows: np.ndarray) -> None:
        self.letters, self.rows = letters, rows
        at = np.full(256, len(letters), dtype=np.int64)
        for i, c in enumerate(letters):
            at[ord(c)] = at[ord(c.lower())] = i
        full = np.full((len(letters) + 1, len(letters) + 1), UNKNOWN, dtype=np.int64)
        full[: len(letters), : len(letters)] = rows
        self.table = full[at][:, at]

    def score(self, a: str, b: str) -> int:
        return int(self.table[ord(a), ord(b)])

    def matrix(self, query: bytes, template: bytes) -> np.ndarray:
        return self.table[np.frombuffer(query, np.uint8)][:, np.frombuffer(template, np.uint8)]

    def long_rows(self) -> list[tuple[str, str, int]]:
        """(aa1, aa2, score) of every pair, for joins."""
        return [(a, b, int(self.rows[i, j])) for i, a in enumerate(self.letters) for j, b in enumerate(self.letters)]


def blosum62() -> Scores:
    rows = np.zeros((20, 20), dtype=np.int64)
    for i, line in enumerate(BLOSUM62.split("\n")[1:21]):
        for j, x in enumerate(map(int, line.split())):
            rows[i, j] = rows[j, i] = x
    return Scores(LETTERS, rows)


def read_ncbi_matrix(path: str, spark=None) -> Scores:
    """A matrix file with # comments, a line of letters, then a letter and its scores on each line.

    With a session Spark reads the file, from any file system that it knows.
    """
    text = Path(path).read_text() if spark is None else "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    letters = lines[0]
    keep = [i for i, c in enumerate(letters) if c in LETTERS]
    values = {row[0]: list(map(int, row[1:])) for row in lines[1:]}
    rows = np.array([[values[letters[i]][j] for j in keep] for i in keep], dtype=np.int64)
    return Scores("".join(letters[i] for i in keep), rows)
