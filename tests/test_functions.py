import random
import unicodedata
import re
import statistics

import pytest
from pyspark.sql import functions as F

from benchsieve.functions import distribution, durable, numbers, text
from benchsieve.functions.numbering import number_rows


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.withColumn("out", expression).orderBy("i").collect()]


def test_strip_and_normalise_follow_unicode_white_space(spark):
    values = ["  a b ", "\t\n x\r", " größe ", "", "\x1c\x85", "a  \tB", None]
    expected = [None if v is None else v.strip() for v in values]
    assert column(spark, values, "string", text.strip(F.col("v"))) == expected
    normal = [None if v is None else re.sub(r"\s+", " ", v.strip().lower()) for v in values]
    assert column(spark, values, "string", text.normalise_prompt(F.col("v"))) == normal


def test_word_count_takes_letters_digits_and_underscore(spark):
    values = ["größe über_x 12", "a-b.c", "", "é ñ ß", "don't"]
    expected = [len(re.findall(r"\w+", v)) for v in values]
    assert column(spark, values, "string", text.word_count(F.col("v"))) == expected


def test_contains_any_also_matches_inside_words(spark):
    found = column(spark, ["fetch it", "hello"], "string", text.contains_any(F.col("v"), ("etc",)))
    assert found == [True, False]


def test_fold_accents(spark):
    values = ["Éçole ñandú", "éte", "größe"]
    assert column(spark, values, "string", text.fold_accents(F.col("v"))) == [
        "Ecole nandu", "ete", "große",
    ]


def test_parse_number_accepts_decimal_text_only(spark):
    values = ["1", " 2.5 ", "1e3", "-.5", "5.", "1_000", "1__0", "_1", "nan", "inf", "1.5d",
              "0x10", "1e999", "", "n/a", None, " 7"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    parsed = rows.withColumn("out", numbers.parse_number(rows, "v")).orderBy("i").collect()
    assert [r.out for r in parsed] == [
        1.0, 2.5, 1000.0, -0.5, 5.0, 1000.0, None, None, None, None, None,
        None, None, None, None, None, 7.0,
    ]
    doubles = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),)], "v double")
    parsed = doubles.select(numbers.parse_number(doubles, "v").alias("out")).collect()
    assert [r.out for r in parsed] == [1.5, None, None]


def test_number_expressions(spark):
    value = F.col("v")
    assert column(spark, [81.725, 2.5, -0.125], "double", numbers.round_to(value, 2)) == [
        81.72, 2.5, -0.13,
    ]
    assert column(spark, [0.0, 4.0], "double", numbers.percent_change(F.lit(5.0), value)) == [
        None, 25.0,
    ]
    scaled = numbers.lower_is_better(value, F.lit(1.0), F.lit(3.0))
    assert column(spark, [1.0, 2.0, 3.0], "double", scaled) == [1.0, 0.5, 0.0]
    flat = numbers.lower_is_better(value, F.lit(3.0), F.lit(3.0 + 1e-10))
    assert column(spark, [3.0], "double", flat) == [1.0]


def sample_groups():
    rng = random.Random(5)
    groups = {
        ("hot", None): [rng.lognormvariate(0, 4) for _ in range(3001)],
        ("even", "p"): [float(rng.randrange(50)) for _ in range(800)],
        ("one", "p"): [7.0],
        ("same", "q"): [2.0] * 900,
    }
    return groups, [(m, p, v) for (m, p), values in groups.items() for v in values]


def test_group_stats_are_exact(spark):
    groups, rows = sample_groups()
    df = spark.createDataFrame(rows, "m string, p string, v double").repartition(7)
    columns = {"n": ("v", "count"), "mean": ("v", "mean"), "median": ("v", "median")}
    stats = distribution.group_stats(df, ["m", "p"], columns, {"top": F.max("v")}).collect()
    assert len(stats) == len(groups)
    for row in stats:
        values = groups[(row.m, row.p)]
        assert row.n == len(values)
        assert row.median == statistics.median(values)
        assert row.mean == pytest.approx(statistics.fmean(values))
        assert row.top == max(values)


def test_a_hot_group_has_an_exact_median_over_many_partitions(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(40_001)]
    rows = [("hot", v, None) for v in values] + [("b", 1.0, 2.0), ("b", None, 4.0), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(6)
    columns = {"n": ("v", "count"), "v": ("v", "median"), "w": ("w", "median"), "wn": ("w", "count")}
    got = {r.g: r for r in distribution.group_stats(df, ["g"], columns).collect()}
    assert (got["hot"].n, got["hot"].v) == (40_001, statistics.median(values))
    assert (got["hot"].w, got["hot"].wn) == (None, 0)
    assert (got["b"].n, got["b"].v, got["b"].w) == (1, 1.0, 3.0)
    assert (got[None].n, got[None].v) == (1, 3.0)
    assert distribution.group_stats(df.limit(0), ["g"], columns).collect() == []


def test_number_rows_is_exact_for_hot_groups_and_globally(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", i) for i in range(2000)]
    rows += [(None, i) for i in range(2000, 2050)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int").repartition(9)
    expected, seen = {}, {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    got = {r.i: r.position for r in number_rows(df, ["i"], ["g"]).collect()}
    assert got == expected
    numbered = number_rows(df, ["i"]).collect()
    assert sorted((r.i, r.position) for r in numbered) == [
        (i, n + 1) for n, i in enumerate(sorted(i for _, i in rows))
    ]


def test_join_null_safe_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, r int")
    joined = durable.join_null_safe(left, right, ["k"], "left")
    assert sorted((r.l, r.r) for r in joined.collect() if r.l == 1) == [(1, 10)]
    assert [(r.l, r.r) for r in joined.collect() if r.l == 2] == [(2, None)]


def test_levels_merge_into_exact_statistics(spark):
    rng = random.Random(9)
    rows = []
    for i in range(9000):
        a = "hot" if i % 3 else f"a{i % 5}"
        value = None if i % 41 == 0 else rng.lognormvariate(0, 3) if i % 2 else float(rng.randrange(9))
        rows.append((a, [None, "x", "y"][i % 7 % 3], value, float(i % 4) if a == "a0" else None))
    df = spark.createDataFrame(rows, "a string, b string, v double, w double").repartition(6)
    levels = [
        F.struct(F.lit(0).alias("level"), F.col("a").alias("a"), F.col("b").alias("part")),
        F.struct(F.lit(1).alias("level"), F.col("a").alias("a"), F.lit("any").alias("part")),
        F.struct(F.lit(2).alias("level"), F.lit("any").alias("a"), F.lit("any").alias("part")),
    ]
    columns = {"n": ("v", "count"), "mean": ("v", "mean"), "v": ("v", "median"), "w": ("w", "median")}
    found = distribution.level_stats(df, ["a", "b"], levels, ["level", "a", "part"], columns)
    wanted = {}
    for a, b, v, w in rows:
        for key in ((0, a, b), (1, a, "any"), (2, "any", "any")):
            vs, ws = wanted.setdefault(key, ([], []))
            if v is not None:
                vs.append(v)
            if w is not None:
                ws.append(w)
    got = {(r.level, r.a, r.part): r for r in found.collect()}
    assert got.keys() == wanted.keys()
    for key, (vs, ws) in wanted.items():
        assert (got[key].n, got[key].v) == (len(vs), statistics.median(vs) if vs else None)
        assert got[key].mean == pytest.approx(statistics.fmean(vs))
        assert got[key].w == (statistics.median(ws) if ws else None)
    assert distribution.level_stats(df.limit(0), ["a", "b"], levels, ["level", "a", "part"], columns).collect() == []


def test_levels_group_the_rows_once(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, v double")
    levels = [F.struct(F.col("a").alias("k")), F.struct(F.lit("any").alias("k"))]
    plan = distribution.level_stats(df, ["a", "b"], levels, ["k"], {"n": ("v", "count")})
    assert {(r.k, r.n) for r in plan.collect()} == {("a", 1), ("any", 1)}
    text = plan._jdf.queryExecution().toString()
    assert "Expand" not in text and "kll" not in text.lower()


def test_folding_is_that_of_all_characters(spark):
    rng = random.Random(3)
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    odd = [chr(c) for c in codes if unicodedata.normalize("NFKD", chr(c)) != chr(c) or unicodedata.combining(chr(c))]
    assert len(odd) > 15_000
    values = ["".join(odd[i : i + 50]) + "éx" for i in range(0, len(odd), 50)]
    values += ["".join(map(chr, rng.choices(codes, k=300))) for _ in range(200)]
    values += ["plain", "", "ﬁ Ａ é", "한국어 é", "…", "1½"]
    found = column(spark, values, "string", text.fold_accents(F.col("v")))
    for value, got in zip(values, found):
        assert got == "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)), value
