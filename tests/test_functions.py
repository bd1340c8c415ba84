import hashlib

import pytest
from pyspark.sql import functions as F

from lorekeep.config import Settings
from lorekeep.functions import text as T


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_paper_id(spark):
    raw = ["arXiv:2401.01234v2", "ARXIV:hep-th/9901001v1", " arXiv:1v2", "2401.01234\t", None, ""]
    assert column(spark, T.normalize_paper_id, raw) == ["2401.01234", "hep-th9901001", "arXiv:1", "2401.01234", None, ""]


def test_modern_ids(spark):
    ids = ["2401.01234", "2401.0123", "2401.012", "2401.012345", "hep-th/9901001", "２４０１.01234"]
    assert column(spark, T.is_modern_id, ids) == [True, True, False, False, False, False]


def test_safe_filename(spark):
    titles = ["a/b: c?", "...", "x" * 81, "Über"]
    got = column(spark, lambda c: T.safe_filename(c, F.lit("1")), titles)
    h = [hashlib.md5(t.encode()).hexdigest()[:6] for t in titles]
    assert got == [f"1_ab c_{h[0]}.pdf", f"1_1_{h[1]}.pdf", f"1_{'x' * 80}_{h[2]}.pdf", f"1_Über_{h[3]}.pdf"]


def test_views(spark):
    assert column(spark, T.authors_display, [["a", "b", "c"], ["a", "b", "c", "d"], []], "array<string>") == ["a, b, c", "a, b, c et al.", ""]
    assert column(spark, T.published, [2020, 0, None], "int") == ["2020", "未知", "未知"]
    assert column(spark, T.short_title, ["x" * 80, "x" * 81, "é" * 90]) == ["x" * 80, "x" * 77 + "...", "é" * 77 + "..."]
    assert column(spark, lambda c: T.paper_label(c, F.lit("2020")), ["y" * 61]) == ["y" * 60 + "... (2020)"]
    assert column(spark, T.statements, ["a; b ;;\n ; c", ";", ""]) == [["a", "b", "c"], [], []]
    assert column(spark, T.tokens, ["The cat, the 2nd é.", ""]) == [["The", "cat", "the", "2nd"], []]
    assert column(spark, lambda c: T.tokens(c, T.TOKEN_ANY), ["Übung 2nd, naïve", "我爱 cats猫。", "カタa"]) == [["Übung", "2nd", "naïve"], ["我", "爱", "cats", "猫"], ["カ", "タ", "a"]]


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# comment\nCHUNK_SIZE=100\nnothing=1\n", encoding="utf-8")
    s = Settings.load(str(env), {"LOREKEEP_BM25_WEIGHT": "0.5"})
    assert (s.chunk_size, s.bm25_weight, s.vector_weight) == (100, 0.5, 0.7)


@pytest.mark.parametrize(("attempt", "limited", "delay"), [(0, True, 5), (1, True, 10), (0, False, 1), (2, False, 4)])
def test_retry_delay(spark, attempt, limited, delay):
    assert spark.range(1).select(T.retry_delay(F.lit(attempt), F.lit(limited)).alias("d")).first().d == delay


def test_statements_end_where_nothing_is_open():
    import random

    from lorekeep.operators.migrations import split_statements

    def slow(sql):
        """One character after the other."""
        out, own, i, real = [], "", 0, False
        while i < len(sql):
            rest = sql[i:]
            if rest.startswith("--"):
                end = rest.find("\n")
                n, solid = (end if end >= 0 else len(rest)), False
            elif rest.startswith("/*"):
                end = rest.find("*/", 2)
                n, solid = (end + 2 if end >= 0 else len(rest)), False
            elif rest[0] in "'\"`":
                n, solid = 1, True
                while n < len(rest):
                    if rest[n] == "\\" and rest[0] != "`":
                        n += 2
                    elif rest[n] == rest[0] and rest[n + 1 : n + 2] == rest[0]:
                        n += 2
                    elif rest[n] == rest[0]:
                        n += 1
                        break
                    else:
                        n += 1
            elif rest.startswith("$$"):
                end = rest.find("$$", 2)
                n, solid = (end + 2 if end >= 0 else len(rest)), True
            elif rest[0] == ";":
                if real:
                    out.append(own.strip())
                own, real, i = "", False, i + 1
                continue
            else:
                n, solid = 1, not rest[0].isspace()
            own, real, i = own + rest[:n], real or solid, i + n
        return [*out, own.strip()] if real else out

    r = random.Random(6)
    for _ in range(4000):
        sql = "".join(r.choice(["a", ";", ";", " ", "'", '"', "`", "--", "\n", "/*", "*/", "$$", "-", "/", "x = 1", "''"]) for _ in range(r.randint(0, 14)))
        assert split_statements(sql) == slow(sql), sql
    assert split_statements("INSERT INTO t VALUES ('a;b'); -- c; d\n/* ; */ SELECT $f$ x; $f$;;") == ["INSERT INTO t VALUES ('a;b')", "-- c; d\n/* ; */ SELECT $f$ x; $f$"]


def test_fixed_stride(spark):
    from lorekeep.operators.chunking import fixed_stride

    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "abcd")], "doc_id long, text string")
    assert sorted(map(tuple, fixed_stride(docs, size=4, overlap=1).collect())) == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (2, 0, ""), (4, 0, "abcd")]
