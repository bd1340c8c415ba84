"""BM25 over blocks of postings: of the best k documents, only blocks are read that can hold one.

Documents of a batch stand in ranges of RANGE; a block has a term's postings of one range, and its largest count and smallest
length, which bound what it adds to any score, whatever the corpus grows to. A question first scores the ranges with the
highest bounds; the k-th best score then rules out all ranges whose bound is lower.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..session import work_path, written
from .bm25 import K1, B

#: Documents of a range.
RANGE = 256
#: Ranges that a question scores before it knows a threshold.
FIRST = 4
#: Bytes of an Arrow batch, and tokens from which a task cuts its postings into a run of its own.
BATCH_BYTES, RUN = 16 << 20, 2_000_000
#: Terms and ranges up to which they are sent to a scan as a filter.
FILTER = 1_000
BLOCKS = "range string, term string, n int, max_tf int, min_dl int, places array<int>, tfs array<int>, dls array<int>, ids array<string>"


def blocks(chunks: DataFrame, id: str = "chunk_id", text: str = "page_content", pattern: str = TOKEN) -> DataFrame:
    """BLOCKS of chunks whose ids end in # and a number that runs through their partition: a row for each term of a range, and one
    with an empty term that holds the ids and lengths of the range's documents (those without tokens too). Texts are cut into
    tokens once, and nothing is shuffled or sorted by Spark: about RUN tokens at a time are put in order of terms and ranges. A range
    that two tasks or two runs share has two rows for a term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def runs(batches):
        held, n = [], 0
        for b in batches:
            # texts of one batch of chunks alone
            held, n = [*held, b], n + len(b.column(2).flatten())
            if n >= RUN:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches):
        for b in (b for several in runs(batches) for b in several):
            ids, sizes = b.column(0), b.column(2).fill_null([]).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            number = b.column(1).to_numpy(zero_copy_only=False)
            coded = b.column(2).fill_null([]).flatten().dictionary_encode()
            width = len(coded.dictionary) + 1
            keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(zero_copy_only=False) + 1, return_counts=True)
            # code 0 is the empty term, and the others follow in order of terms
            place = np.zeros(width, np.int64)
            place[pc.sort_indices(coded.dictionary).to_numpy() + 1] = np.arange(1, width)
            rows, codes = np.concatenate([np.arange(len(sizes)), keys // width]), np.concatenate([np.zeros(len(sizes), np.int64), keys % width])
            tf = np.concatenate([np.zeros(len(sizes), np.int64), tf])
            ranges, of = np.unique(number // RANGE, return_inverse=True)
            group = place[codes] * len(ranges) + of[rows]
            order = np.argsort(group, kind="stable")
            rows, codes, tf, group = rows[order], codes[order], tf[order], group[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            dl, ends = sizes[rows], np.append(starts[1:], len(rows))
            batch = ids[0].as_py().split("/", 1)[0]
            names = pa.array([f"{batch}/{r:014d}" for r in ranges.tolist()])
            words = pa.concat_arrays([pa.array([""]), coded.dictionary.cast(pa.string())])
            most, least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)
            empty = codes[starts] == 0
            for lo in range(0, len(starts), 20_000):
                hi = min(len(starts), lo + 20_000)
                a, z = starts[lo], ends[hi - 1]
                offsets = pa.array(np.append(starts[lo:hi], z) - a, pa.int32())
                listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[a:z].astype(np.int32)))  # noqa: B023, E731
                own = [ids.take(pa.array(rows[s:e])).to_pylist() if x else None for s, e, x in zip(starts[lo:hi], ends[lo:hi], empty[lo:hi], strict=True)]
                columns = [names.take(pa.array(of[rows[starts[lo:hi]]])), words.take(pa.array(codes[starts[lo:hi]])), *(pa.array(x[lo:hi].astype(np.int32)) for x in (ends - starts, most, least)), listed(number[rows] % RANGE), listed(tf), listed(dl), pa.array(own, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])

    chunks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    number = F.substring_index(F.col(id), "#", -1).cast("long")
    cut = chunks.select(F.col(id).alias("id"), number.alias("number"), tokens(F.coalesce(F.col(text), F.lit("")), pattern).alias("t"))
    return cut.mapInArrow(run, BLOCKS)


def postings(found: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """id, dl, term, tf of blocks, and their documents' ids from the rows with an empty term."""
    each = found.where("term != ''").select("range", "term", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p")).select("range", "term", F.col("p.places").alias("place"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))
    return each.join(documents(found), ["range", "place"]).select("id", "dl", "term", "tf")


def documents(found: DataFrame) -> DataFrame:
    """range, place, id of the rows with an empty term."""
    return found.where("term = ''").select("range", F.explode(F.arrays_zip("places", "ids")).alias("p")).select("range", F.col("p.places").alias("place"), F.col("p.ids").alias("id"))


def _added(tf, dl):
    return F.col("qn") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _filtered(found: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows with a value of a small table, as a filter of the scan if they are few."""
    got = [r[0] for r in values.select(column).distinct().limit(FILTER + 1).collect()]
    return found.where(F.col(column).isin(got)) if len(got) <= FILTER else found


class Search:
    """One batch of questions over stored blocks. terms: term, idf; corpus: avgdl, a single row; queries: qid, term for each token."""

    def __init__(self, stored: DataFrame, terms: DataFrame, corpus: DataFrame, queries: DataFrame):
        spark = self.spark = stored.sparkSession
        asked = queries.groupBy("qid", "term").agg(F.count("*").alias("qn"))
        # a row for each question and term
        self.weights = written(asked.join(terms.select("term", "idf"), "term").crossJoin(F.broadcast(corpus.select("avgdl"))), work_path(spark, "weights"))
        self.all = stored
        self.blocks = _filtered(stored, "term", self.weights)
        heads = self.blocks.select("range", "term", "n", "max_tf", "min_dl").join(self.weights, "term")
        bound = F.greatest(_added(F.col("max_tf"), F.col("min_dl")), F.lit(0.0))
        bounds = heads.groupBy("qid", "range").agg(F.sum(bound).alias("bound"), F.count("*").alias("blocks"))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "range")
        self.bounds = written(bounds.withColumn("rk", F.row_number().over(order)), work_path(spark, "bounds"))

    def scores(self, chosen: DataFrame, k: int) -> DataFrame:
        """qid, range, place, s of the documents of some ranges (qid, range, least) that score `least` or more (null: any) and are no
        worse than the k-th of their range, but for rounding. Blocks go to their range once, whatever number of questions asks for
        it, and are scored there."""
        asked: dict = {}
        # a row for each question and term of a bounded batch of questions
        for r in self.weights.collect():
            asked.setdefault(r.qid, []).append((r.term, r.qn * r.idf, r.avgdl))
        shared = self.spark.sparkContext.broadcast(asked)
        schema = f"qid {chosen.schema['qid'].dataType.simpleString()}, range string, place int, s double"

        words = sorted({t for own in asked.values() for t, _, _ in own} | {""})

        def packed(batches):
            """Blocks of the questions' terms, numbers as bytes; lengths travel once, with the empty term."""
            import pyarrow as pa
            import pyarrow.compute as pc

            known = pa.array(words, pa.string())
            for b in batches:
                b = b.filter(pc.is_in(b.column(1), value_set=known))
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                empty = np.repeat(pc.equal(b.column(1), "").to_numpy(zero_copy_only=False), sizes)
                place, tf, dl = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                ends = np.concatenate([[0], sizes.cumsum()])
                listed = [pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (place.astype(np.uint16), np.where(empty, dl, tf).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *listed], names=["range", "term", "places", "counts"])

        def score(found, wanted):
            import pyarrow as pa

            qids, places, sums = [], [], []
            if found.num_rows and wanted.num_rows:
                terms: dict = {"": 0}
                places_, counts = (found.column(c).to_pylist() for c in ("places", "counts"))
                rows = np.repeat([terms.setdefault(t, len(terms)) for t in found.column("term").to_pylist()], [len(x) // 2 for x in places_])
                place, tf = np.frombuffer(b"".join(places_), np.uint16), np.frombuffer(b"".join(counts), np.int32)
                lengths = np.zeros(RANGE)
                lengths[place[rows == 0]] = tf[rows == 0]
                dl = lengths[place]
                avgdl = next(iter(shared.value.values()))[0][2]
                part, there = np.zeros((len(terms), RANGE)), np.zeros((len(terms), RANGE), bool)
                part[rows, place] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                there[rows, place] = True
                for qid, least in zip(wanted.column("qid").to_pylist(), wanted.column("least").to_pylist(), strict=True):
                    own = [(terms[t], w) for t, w, _ in shared.value.get(qid, ()) if t in terms]
                    at = np.flatnonzero(there[[i for i, _ in own]].any(axis=0))
                    s = (part[[i for i, _ in own]][:, at] * np.array([w for _, w in own])[:, None]).sum(axis=0)
                    cut = max([x for x in (least, -np.partition(-s, k - 1)[k - 1] if len(s) > k else None) if x is not None], default=-np.inf)
                    good = s >= cut - 1e-8
                    qids += [qid] * int(good.sum())
                    places.append(at[good])
                    sums.append(s[good])
            n, name = len(qids), found.column("range")[0].as_py() if found.num_rows else None
            columns = [pa.array(qids, wanted.schema.field("qid").type), pa.array([name] * n, pa.string()), pa.array(np.concatenate([np.zeros(0), *places]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *sums]))]
            return pa.table(dict(zip(("qid", "range", "place", "s"), columns, strict=True)))

        met = _filtered(self.all.where(F.col("term").isin(words)) if len(words) <= FILTER else self.all, "range", chosen)
        met = met.select("range", "term", "places", "tfs", "dls").mapInArrow(packed, "range string, term string, places binary, counts binary")
        return met.groupBy("range").cogroup(chosen.select("qid", "range", "least").groupBy("range")).applyInArrow(score, schema)

    def top(self, k: int) -> DataFrame:
        """qid, id, s of every document that no k others of its question beat by more than rounding."""
        by = Window.partitionBy("qid").orderBy(F.desc("s"))

        def kth(found: DataFrame) -> DataFrame:
            return found.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("qid", F.col("s").alias("least"))

        start = self.bounds.where(F.col("rk") <= FIRST).withColumn("least", F.lit(None).cast("double"))
        first = written(self.scores(start, k), work_path(self.spark, "first"))
        least = F.coalesce("least", F.lit(float("-inf")))
        more = self.bounds.where((F.col("rk") > FIRST) & (F.col("bound") > 0)).join(kth(first), "qid", "left").where(F.col("bound") >= least - 1e-8 - 1e-9 * F.abs(least))
        self.more = written(more.select("qid", "range", "blocks", "least"), work_path(self.spark, "more"))
        every = written(first.unionByName(self.scores(self.more, k)), work_path(self.spark, "scores"))
        best = every.join(kth(every), "qid", "left").where(F.col("s") >= least - 1e-8).select("qid", "range", "place", "s")
        named = documents(_filtered(self.all, "range", best)).join(best, ["range", "place"])
        return named.select("qid", "id", "s")

    def read(self) -> tuple[int, int]:
        """After top(): blocks whose postings were read, and those with a term of the question."""
        total, first = self.bounds.agg(F.sum("blocks"), F.sum(F.when(F.col("rk") <= FIRST, F.col("blocks")))).first()
        return (first or 0) + (self.more.agg(F.sum("blocks")).first()[0] or 0), total or 0
