"""Model terms as products of columns, and their cross-product matrices.

A term is a tuple of column names: ``()`` is the intercept, ``("lat", "cos1")``
an interaction, ``("x", "x")`` a square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = tuple[str, ...]
# Columns whose products are summed in generated code, and matrices that a task holds.
NARROW, HELD = 15, 64


def term_name(term: Term) -> str:
    return ":".join(term) if term else "(Intercept)"


def term_column(term: Term) -> Column:
    return reduce(Column.__mul__, [F.col(c).cast("double") for c in term]) if term else F.lit(1.0)


def term_columns(terms: Iterable[Term]) -> set[str]:
    return {c for term in terms for c in term}


def times(term: Term | str, others: Iterable[str]) -> list[Term]:
    """The term multiplied with each of the other columns."""
    base = (term,) if isinstance(term, str) else tuple(term)
    return [(*base, o) for o in others]


def terms_product(a: str, others: Sequence[str]) -> list[Term]:
    """Intercept, main effects and interactions of ``a`` with the others."""
    return [(), (a,), *[(o,) for o in others], *times(a, others)]


def design_frame(df: DataFrame, terms: Sequence[Term], responses: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns t0, t1, ... and y0, y1, ... for the terms and responses; rows with a null are dropped."""
    used = sorted(term_columns(terms) | set(responses) | set(keep))
    complete = df.select(*used).dropna()
    return complete.select(
        *keep,
        *[term_column(t).alias(f"t{i}") for i, t in enumerate(terms)],
        *[F.col(r).cast("double").alias(f"y{i}") for i, r in enumerate(responses)],
    )


@dataclass
class Gram:
    """Cross products of the design columns followed by the responses."""

    terms: list[Term]
    responses: list[str]
    matrix: np.ndarray
    n: int

    @property
    def p(self) -> int:
        return len(self.terms)


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sum of products of every two columns, and the row count.

    Few columns: one aggregation inside generated code. Many columns: every
    task folds its Arrow batches into one block, and the blocks are summed.
    """
    q = len(columns)
    if q <= NARROW:
        pairs = [(i, j) for i in range(q) for j in range(i, q)]
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs],
        ).first()
        matrix = np.zeros((q, q))
        for i, j in pairs:
            matrix[i, j] = matrix[j, i] = row[f"g{i}_{j}"] or 0.0
        return matrix, row["n"]
    rows = gram_rows(df, columns).collect()
    matrix = np.zeros((q + 1, q + 1))
    for r in rows:
        matrix[r["i"]] = [r[f"g{j}"] for j in range(q + 1)]
    return matrix[:q, :q], int(round(matrix[q, q]))


def gram_rows(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Gram matrix of the columns plus a column of ones, one row per matrix row; one matrix per text in ``by``, if given."""
    import pyarrow as pa

    q = len(columns) + 1
    names = ["i", *[f"g{j}" for j in range(q)]]

    def rows_of(label: str, total: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.arange(q, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(q)]]
        return pa.RecordBatch.from_arrays(arrays if by is None else [pa.array([label] * q), *arrays], names if by is None else [by, *names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {} if by else {"": np.zeros((q, q))}
        for batch in batches:
            block = np.ones((batch.num_rows, q))
            for j in range(q - 1):
                block[:, j] = batch.column(j).to_numpy(zero_copy_only=False)
            if by is None:
                totals[""] += block.T @ block
                continue
            found = batch.column(q - 1).dictionary_encode()
            codes = found.indices.to_numpy(zero_copy_only=False)
            for code, label in enumerate(found.dictionary.to_pylist()):
                part = block[codes == code] if len(found.dictionary) > 1 else block
                totals[label] = totals.get(label, 0.0) + part.T @ part
            if len(totals) > HELD:  # never more than some matrices in a task
                yield from (rows_of(label, total) for label, total in totals.items())
                totals = {}
        yield from (rows_of(label, total) for label, total in totals.items())

    keys = ["i"] if by is None else [by, "i"]
    schema = ("" if by is None else f"{by} string, ") + "i int, " + ", ".join(f"{n} double" for n in names[1:])
    partial = df.select(*columns, *([by] if by else [])).mapInArrow(fold, schema)
    return partial.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names[1:]])


def gram(df: DataFrame, terms: Sequence[Term], responses: Sequence[str]) -> Gram:
    frame = design_frame(df, terms, responses)
    matrix, n = cross_products(frame, frame.columns)
    return Gram(list(terms), list(responses), matrix, n)


def gram_cells(df: DataFrame, terms: Sequence[Term], responses: Sequence[str]) -> DataFrame:
    """The Gram matrix as a long table (row, col, value), upper triangle."""
    frame = design_frame(df, terms, responses)
    labels = [*map(term_name, terms), *responses]
    columns = frame.columns
    cells = [
        F.struct(F.lit(labels[i]).alias("row"), F.lit(labels[j]).alias("col"), F.sum(F.col(columns[i]) * F.col(columns[j])).alias("value"))
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
