"""Rank windows carry a wide row as one value, and give the columns, ranks and notes that they give with its cells."""

from pyspark.sql import functions as F

from slatewise.functions import groups as G


def _ranks():
    return [G.Rank("r", "a", True), G.Rank("s", "a", method="average", pct=True), G.Rank("t", F.round("b", 1), method="average", pct=True),
            G.Rank("u", F.col("b") + 1, True, "first", tie="i"), G.Rank("v", "c4")]


def _wide(spark):
    df = spark.range(300).selectExpr("if(id % 13 = 0, null, id % 20) as g", "id as i", "if(id % 7 = 0, null, id % 5) as a", "if(id % 6 = 0, null, round(rand(3), 1)) as b",
                                     *[f"id * {k} as c{k}" for k in range(60)])
    return G.noted(df, "g", 40)


def test_packed_rows_give_the_same_table(spark, monkeypatch):
    df, stats = _wide(spark), [G.Stat("m", F.max("a")), G.Stat("h", median="b")]
    packed = G.within(df, ["g"], _ranks(), stats)
    monkeypatch.setattr(G, "WIDE_ROW", 1000)
    plain = G.within(df, ["g"], _ranks(), stats)
    assert packed.columns == plain.columns and packed.dtypes == plain.dtypes
    assert sorted(map(str, packed.collect())) == sorted(map(str, plain.collect()))
    assert packed.schema["g"].metadata == plain.schema["g"].metadata != {}


def test_windows_do_not_copy_the_cells_of_wide_rows(spark):
    node, widths = G.within(_wide(spark), ["g"], _ranks())._jdf.queryExecution().optimizedPlan(), []
    while not node.children().isEmpty():
        if node.nodeName() == "Window":
            widths.append(node.output().size())
        node = node.children().head()
    assert len(widths) >= 4 and max(widths) < 30  # not the 64 columns and the ranks
