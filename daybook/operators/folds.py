"""Texts and SHA-256 of runs of any size, folded over sorted rows in constant memory.

A window deals rows by run and sorts them (spilling where needed); each task then reads its rows once, in Arrow
batches, and carries a running SHA-256 and the text since the last part over batch boundaries.  A run is never
one array or one row.  The hash is sequential by nature, so one run is one task; its time grows with the run, its
memory does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions import commits as fc
from daybook.operators.commits import totals, usable_hash
from daybook.operators.joins import apart, same_keys

#: Characters after which a text is cut into a further part, at the next piece's end.
PART_CHARS = 1 << 20


def fingerprint_any_size(df: DataFrame, run: Sequence[str], hash_column: str = "hash") -> DataFrame:
    """``operators.commits.fingerprint`` without the condition that runs are capped first."""
    rows = df.select(*run, usable_hash(hash_column).alias("_piece"))
    return _folded(rows, run, [F.col("_piece")], None).select(*run, F.col("_sha256").alias("fingerprint"))


def digest_parts(df: DataFrame, run: Sequence[str], seq: str = "seq", part_chars: int = PART_CHARS) -> DataFrame:
    """The digest text of runs of any size in parts: (run, part, text, n_chars, sha256).

    The texts of a run's parts, joined in the order of ``part``, are the ``digest`` of ``operators.commits``;
    ``n_chars`` and ``sha256`` are of the text up to the part's end, so the last part has those of the whole.  Input
    as for ``digest``, not capped.  Parts have at least ``part_chars`` characters, the last one of a run apart.
    """
    no_text = F.lit(None).cast("string")
    place = df.schema[seq].dataType
    starts = df.groupBy(*run, "repo", apart([*run, "repo"])).agg(F.min(seq).alias("_first")).drop("_apart")
    rows = df.select(*run, "repo", F.col(seq).alias("_seq"), "line")
    renamed, same = same_keys(rows, starts, [*run, "repo"])
    title = F.concat(F.lit("REPO: "), F.coalesce("repo", F.lit("")))

    def pieces(source: DataFrame, stage: int, block: int, text: Column, at: Column) -> DataFrame:
        return source.select(
            *[source[c] for c in run],
            F.lit(stage).alias("_stage"),
            F.col("_first"),
            title.alias("_title") if stage == 0 else no_text.alias("_title"),
            F.col("repo") if stage == 0 else no_text.alias("repo"),
            F.lit(block).alias("_block"),
            at.cast(place).alias("_seq"),
            text.alias("_piece"),
        )

    lines = rows.join(renamed, same).select(*[rows[c] for c in rows.columns], "_first")
    sums = totals(df, run)
    summary = fc.summary_line(F.col("commits"), F.col("insertions"), F.col("deletions"), F.col("modules"))
    never = F.lit(None)
    every = (
        pieces(starts, 0, 0, title, never)
        .unionByName(pieces(lines, 0, 1, F.col("line"), F.col("_seq")))
        .unionByName(pieces(starts, 0, 2, F.lit(""), never))
        .unionByName(pieces(sums.withColumn("_first", never.cast(place)), 1, 3, summary, never))
    )
    order = ["_stage", "_first", "_title", "repo", "_block", "_seq", "_piece"]
    return _folded(every, run, [F.col(c) for c in order], part_chars).select(
        *run, F.col("_part").alias("part"), F.col("_text").alias("text"), F.col("_chars").alias("n_chars"), F.col("_sha256").alias("sha256")
    )


def _folded(rows: DataFrame, run: Sequence[str], order: Sequence[Column], part_chars: int | None) -> DataFrame:
    """A run's pieces joined by line feeds; null pieces are none, a run of none gives an empty text."""
    within = Window.partitionBy(*run).orderBy(*order)
    marked = rows.select(*run, "_piece", (F.row_number().over(within) == 1).alias("_opens"))
    keys = [T.StructField(c, rows.schema[c].dataType) for c in run]
    out = T.StructType(
        [
            *keys,
            T.StructField("_part", T.LongType()),
            T.StructField("_text", T.StringType()),
            T.StructField("_chars", T.LongType()),
            T.StructField("_sha256", T.StringType()),
        ]
    )
    return marked.mapInArrow(_folder(len(keys), part_chars), out)


class _Text:
    """One run's text as it grows: what is not yet given out, and counts and hash of all."""

    def __init__(self, key: list[pa.Array]):
        self.key, self.sha, self.chars, self.parts, self.empty = key, hashlib.sha256(), 0, 0, True
        self.waiting: list[str] = []
        self.waiting_chars = 0

    def add(self, pieces: list[str], keep: bool) -> None:
        joined = "\n".join(pieces) if self.empty else "\n" + "\n".join(pieces)
        self.empty = False
        self.sha.update(joined.encode())
        self.chars += len(joined)
        if keep:
            self.waiting.append(joined)
            self.waiting_chars += len(joined)

    def left(self) -> bool:
        return bool(self.waiting) or not self.parts

    def take(self) -> tuple:
        row = (self.key, self.parts, "".join(self.waiting), self.chars, self.sha.copy().hexdigest())
        self.parts += 1
        self.waiting, self.waiting_chars = [], 0
        return row


def _folder(n_keys: int, part_chars: int | None) -> Callable:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: _Text | None = None
        names = types = None
        for batch in batches:
            names, types = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            done: list[tuple] = []
            opens = pc.indices_nonzero(batch.column(n_keys + 1)).to_pylist()
            bounds = sorted({0, *opens, batch.num_rows}) if batch.num_rows else []
            starts = set(opens)
            for begin, end in zip(bounds, bounds[1:], strict=False):
                if begin in starts:
                    if text is not None and text.left():
                        done.append(text.take())
                    text = _Text([batch.column(k).slice(begin, 1) for k in range(n_keys)])
                pieces = batch.column(n_keys).slice(begin, end - begin).drop_null().to_pylist()
                for group in [pieces] if part_chars is None else _cut(pieces, part_chars):
                    if group:
                        text.add(group, part_chars is not None)
                    if part_chars is not None and text.waiting_chars >= part_chars:
                        yield from _rows([*done, text.take()], names, types)
                        done = []
            yield from _rows(done, names, types)
        if text is not None and text.left():
            yield from _rows([text.take()], names, types)

    return fold


def _cut(pieces: list[str], chars: int) -> Iterator[list[str]]:
    """Groups of pieces that end once they hold ``chars`` characters."""
    group, size = [], 0
    for piece in pieces:
        group.append(piece)
        size += len(piece) + 1
        if size >= chars:
            yield group
            group, size = [], 0
    yield group


def _rows(done: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if done:
        keys = [pa.concat_arrays([row[0][k] for row in done]).cast(types[k]) for k in range(len(names))]
        columns = [pa.array([row[i] for row in done], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.string()))]
        yield pa.RecordBatch.from_arrays([*keys, *columns], names=[*names, "_part", "_text", "_chars", "_sha256"])
