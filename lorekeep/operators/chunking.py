"""Recursive character chunking: the largest units that fit, with an overlap carried from chunk to chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Separators from coarse to fine (fixed values); the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")

#: Bytes of an Arrow batch of texts on its way to Python, and characters of chunks in a batch on its way back.
BATCH_BYTES, CHARS = 4 << 20, 2 << 20


class Splitter:
    """Cuts a text at the coarsest separator it holds, keeps pieces shorter than `size`, and cuts longer ones at finer
    separators. Neighbouring pieces then fill chunks of at most `size` characters; each chunk starts with the last pieces
    of the one before, as many as fit into `overlap`. A separator stands at the start of the piece that follows it."""

    def __init__(self, size: int = 800, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS):
        if not 0 <= overlap <= size or size < 1:
            raise ValueError("overlap must lie between 0 and size")
        self.size, self.overlap, self.separators = size, overlap, separators

    def split(self, text: str | None) -> list[str]:
        return list(self._cut(text, 0)) if text else []

    def _cut(self, text: str, level: int) -> Iterator[str]:
        while level < len(self.separators) - 1 and self.separators[level] not in text:
            level += 1
        sep = self.separators[level]
        if sep:
            first, *others = text.split(sep)
            pieces = ([first] if first else []) + [sep + p for p in others]
        else:
            pieces = list(text)
        run: list[str] = []
        for piece in pieces:
            if len(piece) < self.size:
                run.append(piece)
                continue
            yield from self._filled(run)
            run = []
            if level + 1 < len(self.separators):
                yield from self._cut(piece, level + 1)
            elif s := piece.strip():
                yield s
        yield from self._filled(run)

    def _filled(self, pieces: list[str]) -> Iterator[str]:
        start, total = 0, 0
        for i, piece in enumerate(pieces):
            if total + len(piece) > self.size and i > start:
                if s := "".join(pieces[start:i]).strip():
                    yield s
                while start < i and (total > self.overlap or total + len(piece) > self.size):
                    total -= len(pieces[start])
                    start += 1
            total += len(piece)
        if s := "".join(pieces[start:]).strip():
            yield s


def chunk_lists(text, size: int = 800, overlap: int = 150):
    """array<string> of the chunks of a text, by Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Splitter(size, overlap)
        for texts in batches:
            yield texts.map(lambda t: s.split(t) if isinstance(t, str) else [])

    return run(text)


def split_documents(pages: DataFrame, document: str = "source", size: int = 800, overlap: int = 150, paged: bool = True) -> DataFrame:
    """Chunks of pages (page_content, page, the document's column and any others), each page split on its own.

    chunk_index counts from 0 over all chunks of a document, in order of pages. A document's chunks are numbered in one
    task per document; documents are spread by their key. paged=False: every row is a document by itself, and its chunks
    are numbered where they are made.
    """
    rest = [c for c in pages.columns if c != "page_content"]
    cut = _cut_rows(pages.select(*rest, "page_content"), size, overlap)
    if not paged:
        return cut.withColumnRenamed("pos_", "chunk_index")
    order = Window.partitionBy(document).orderBy("page", "pos_")
    return cut.withColumn("chunk_index", F.row_number().over(order) - 1).drop("pos_")


def _cut_rows(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row for each chunk of the last column, with its place pos_ in the row's text and the other columns. A task holds a batch of
    texts and a batch of chunks, both bounded by their bytes, not the chunks of 10,000 texts."""

    def run(batches):
        import pyarrow as pa

        s = Splitter(size, overlap)
        for b in batches:
            held: list[tuple[int, int, str]] = []
            chars = 0

            def rows(held, b=b):
                at, places, chunks = zip(*held, strict=True)
                of = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(b.num_columns - 1)), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], names=[*b.schema.names[:-1], "pos_", "page_content"])

            for i in range(b.num_rows):
                for n, c in enumerate(s.split(b.column(b.num_columns - 1)[i].as_py())):
                    held.append((i, n, c))
                    chars += len(c)
                    if chars >= CHARS:
                        yield rows(held)
                        held, chars = [], 0
            if held:
                yield rows(held)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return pages.mapInArrow(run, T.StructType([*pages.schema.fields[:-1], T.StructField("pos_", T.IntegerType(), False), T.StructField("page_content", T.StringType(), True)]))


def fixed_stride(docs: DataFrame, document: str = "doc_id", text: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """document, chunk_index, chunk: windows of `size` characters, each `size - overlap` after the last; the last one ends the text.
    JVM functions only; an empty text is one empty chunk, a null one none."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return docs.where(F.col(text).isNotNull()).select(document, F.posexplode(cut).alias("chunk_index", "chunk"))


def with_metadata(pages: DataFrame, metadata: dict[str, str] | None, column: str = "metadata") -> DataFrame:
    """Merges caller-supplied keys over those of the loader; an empty or missing dict changes nothing."""
    if not metadata:
        return pages
    given = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv])
    own = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    return pages.withColumn(column, F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*metadata)), given))


@udtf(returnType="chunk_index: int, page_content: string")
class ChunkTable:
    """SELECT ... FROM t, LATERAL chunk_text(t.text): a row for each chunk of one text."""

    def eval(self, text: str):
        for i, c in enumerate(Splitter().split(text)):
            yield i, c


def register(spark) -> None:
    """Makes chunk_text() known to SQL."""
    spark.udtf.register("chunk_text", ChunkTable)
