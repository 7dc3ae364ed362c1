"""Field rules run once, and only where they can change something."""

from pyspark.sql import functions as F

from mixframe.functions import clean
from mixframe.functions.text import replace_all, squeeze
from mixframe.operators import fields

TITLES = ["Song (A)[B]", "Song - FEAT. Who (x)", "Song (2016 - Remaster)", "Song [Live - 2011 Remastered 2012]", "Song (2009 DIGITAL  Remaster)",
          "Song (Re-Mastered '09)", "Song - Night Remix", "(Song)", "Song-12345", "Song - Part", "Song (2011 Remaster)", "Song (Stereo re-mastered Mix)",
          "Song (MIXED)", "Song [A] [Mixed]", "Song (A;mixed)", "Song (ORIGINAL Mix)", "Song", "", None, "  a \t b\n", "x\u0085Song - A Mix y - B Mix"]
LABELS = ["A\n B", "X Records (Distribution)", "[X]", "X 12", "X s.R.L.", "Small, x gmbh", "X, llc", "X uk", "X Re-Issues", "A, B Catalogue", "X", "", None]


def test_hints_hold_wherever_a_rule_changes_a_text(spark):
    for texts, steps, plain in ((TITLES, clean._rule_steps("title", None), clean.rules_of("title")), (LABELS, clean._rule_steps("label", None), clean.rules_of("label"))):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        hit = set()
        for i, (step, rule) in enumerate(zip(steps, plain, strict=True)):
            for r in df.select("t", step(F.col("t")).alias("got"), F.regexp_replace("t", *rule).alias("want")).collect():
                assert r.got == r.want, (rule, r)
                hit |= {i} if r.got != r.t else set()
        assert len(hit) == len(plain)  # each rule has a text that it changes


def test_titles_are_those_of_the_rules_in_a_row(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    got = df.select(clean.clean_title("t").alias("got"), clean.without_duplicate_brackets(
        F.regexp_replace(replace_all(squeeze("t"), clean.rules_of("title")), clean.POINTLESS_VERSION, "")).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rules_stand_once(spark, tmp_path):
    spark.createDataFrame([("A", "T", "Small 12, BIG Co")], "artist string, title string, label string").write.parquet(str(tmp_path / "t"))
    out = fields.track_fields(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([("big co",)], "label string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("GmbH") == 1
    assert [(r.text, r.label) for r in out.collect()] == [("A - T", "Small 12")]


def test_ends_lose_blanks_and_no_digits(spark):
    row = fields.track_fields(spark.createDataFrame([("00 Act 0 ", "0 Song 0", " 0 Label ")], "artist string, title string, label string")).head()
    assert (row.text, row.label) == ("00 Act 0 - 0 Song 0", "0 Label")
