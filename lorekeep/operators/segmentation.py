"""Learning to segment: words of a corpus by their counts, cohesion and free borders, and tag counts for the hidden Markov model."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segment import HAN, Hmm, Lexicon
from ..session import work_path, written


@dataclass(frozen=True)
class Learning:
    """longest: characters of a word; least: occurrences of a word of two or more; cohesion: least natural logarithm of how much more
    often it occurs than its parts would meet by chance; freedom: least entropy of its neighbours, on either side; words:
    the most frequent ones that are kept, at most."""

    longest: int = 4
    least: int = 5
    cohesion: float = 2.0
    freedom: float = 0.7
    words: int = 100_000


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """Rows from that count on from which they are no more than `most`, to a sixteenth of a power of two: a histogram of
    bounded size comes to the driver, and nothing is sorted."""
    power = F.floor(F.log2(F.col(n)) * 16).cast("int")
    total, least = 0, None
    for p, c in sorted(((r.p, r.c) for r in counts.where(F.col(n) > 0).groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()), reverse=True):
        total += c
        if total > most:
            break
        least = p
    return counts.where(F.lit(False) if least is None else (F.col(n) > 0) & (power >= least))


def grams(docs: DataFrame, longest: int, text: str = "text", pattern: str = HAN) -> DataFrame:
    """gram, before, after, n: character n-grams of the runs, with their neighbours in the run (null at its ends)."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("run"))
    size = F.length("run")
    places = runs.select("run", F.posexplode(F.sequence(F.lit(1), F.least(size, F.lit(longest)))).alias("x", "k")).select("run", "k", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("k") + 1)).alias("i"))
    i, k = F.col("i"), F.col("k")
    around = places.select(F.substring("run", i, k).alias("gram"), F.when(i > 1, F.substring("run", i - 1, F.lit(1))).alias("before"), F.when(i + k <= F.length("run"), F.substring("run", i + k, F.lit(1))).alias("after"))
    return around.groupBy("gram", "before", "after").agg(F.count("*").alias("n"))


def word_table(found: DataFrame, learning: Learning) -> DataFrame:
    """gram, n, cohesion, freedom of the n-grams of two characters or more that are frequent enough, and single ones (null).

    cohesion: of all ways to cut it in two, the least log(n total / (n of the left, n of the right)). freedom: the smaller entropy
    of both sides; every occurrence at the end of a run counts as a neighbour of its own. found: a stored table grams().
    """
    counts = found.groupBy("gram").agg(F.sum("n").alias("n"))
    total = counts.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    frequent = counts.where((F.col("n") >= learning.least) & (F.length("gram") > 1))

    def entropy(side: str) -> DataFrame:
        c = found.groupBy("gram", side).agg(F.sum("n").alias("c"))
        part = F.col("c") * (F.log("n") - F.when(F.col(side).isNull(), 0.0).otherwise(F.log("c"))) / F.col("n")
        return c.join(frequent, "gram").groupBy("gram").agg(F.sum(part).alias(side))

    cuts = frequent.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("k")).alias("a"), F.substring("gram", F.col("k") + 1, F.length("gram")).alias("b"))
    sides = cuts.join(counts.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b")
    meets = F.log("n") + F.log("total") - F.log("na") - F.log("nb")
    held = sides.crossJoin(F.broadcast(total)).groupBy("gram", "n").agg(F.min(meets).alias("cohesion"))  # one row
    both = held.join(entropy("before"), "gram").join(entropy("after"), "gram").select("gram", "n", "cohesion", F.least("before", "after").alias("freedom"))
    return both.unionByName(counts.where(F.length("gram") == 1).select("gram", "n", F.lit(None).cast("double").alias("cohesion"), F.lit(None).cast("double").alias("freedom")))


def tag_counts(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """kind (e: tag and character, m: tag and next tag, s: first tag of a run), a, b, n of all runs, cut by the lexicon alone. A
    task hands on sums: at most four for each character of the script."""
    import re

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str, str], int] = {}
        for b in batches:
            for t in b["text"]:
                for run in re.findall(lexicon.pattern, t) if isinstance(t, str) else ():
                    tags = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in lexicon.path(run))
                    for k in (("s", tags[0], ""), *(("e", x, c) for x, c in zip(tags, run, strict=True)), *(("m", x, y) for x, y in zip(tags, tags[1:], strict=False))):
                        sums[k] = sums.get(k, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["kind", "a", "b", "n"])

    found = docs.select(F.col(text).alias("text")).mapInPandas(count, "kind string, a string, b string, n long")
    return found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", learning: Learning | None = None, pattern: str = HAN, hmm: bool = True) -> Lexicon:
    """A lexicon of a corpus: single characters, and n-grams that hold together and stand among changing neighbours; then, from
    the corpus cut by them, the hidden Markov model. Null texts have no runs; without runs the lexicon is empty, and every
    character is a word of its own. What comes to the driver is bounded by learning.words and the characters of the script."""
    s, spark = learning or Learning(), docs.sparkSession
    found = written(grams(docs, s.longest, text, pattern), work_path(spark, "grams"))
    table = written(word_table(found, s), work_path(spark, "words"))
    good = table.where(F.col("cohesion").isNull() | ((F.col("cohesion") >= s.cohesion) & (F.col("freedom") >= s.freedom)))
    counts = {r.gram: r.n for r in most_frequent(good, s.words).collect()}
    lexicon = Lexicon.of(counts, None, pattern)
    if not hmm or not counts:
        return lexicon
    rows = tag_counts(docs, lexicon, text).collect()
    by = lambda kind: {(r.a, r.b): r.n for r in rows if r.kind == kind}
    return Lexicon.of(counts, Hmm.of(by("e"), by("m"), {a: n for (a, _), n in by("s").items()}), pattern)


def save(spark: SparkSession, lexicon: Lexicon, path: str) -> None:
    """As one JSON row."""
    h = lexicon.hmm
    row = json.dumps({"costs": lexicon.costs, "floor": lexicon.floor, "pattern": lexicon.pattern, "hmm": h and {"start": h.start, "moves": h.moves, "emissions": h.emissions}}, ensure_ascii=False)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Lexicon | None:
    """What save() wrote; None if there is nothing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    got = json.loads(spark.read.text(path).first().value)
    return Lexicon(got["costs"], got["floor"], Hmm(**got["hmm"]) if got["hmm"] else None, got["pattern"])


