from pyspark.sql import functions as F

from quern.functions import analysis
from quern.schema import Field, Schema, default_schema

WORDS = ["running", "ring", "nation", "motion", "darkness", "ness", "moment", "payments", "users", "hers", "boxes", "yes", "red", "bed", "used", "fly", "really", "her", "over", "cats", "bus", "gas", "a", "python"]


def test_stem_twins_agree(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    assert [r.s for r in df.select(analysis.stem(F.col("w")).alias("s")).collect()] == [analysis.stem_word(w) for w in WORDS]


def test_stems():
    assert analysis.analyse_text("Python programming for beginners") == ["python", "programm", "beginn"]
    assert analysis.analyse_text("Python Tutorial AND Java") == ["python", "tutorial", "java"]


def test_analyse_nulls_and_other_scripts(spark):
    texts = [None, "", "  ", "été Ünder42score the", "The engines, the ENGINE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.a for r in df.select(analysis.analyse(F.col("t")).alias("a")).collect()]
    assert got == [analysis.analyse_text(t or "") for t in texts]


def test_highlight_changes_nothing_else(spark):
    text = "The engines: engine-room, Engine!\n(engineer)"
    df = spark.createDataFrame([(text,)], "t string").select(analysis.highlight(F.col("t"), ["engin", "engine"]).alias("h"))
    assert df.first().h == "The [engines]: [engine]-room, [Engine]!\n([engineer])"


def test_token_offsets_and_display(spark):
    df = spark.createDataFrame([("alpha bc d", "x\x1fy")], "t string, m string")
    got = df.select(analysis.token_offsets(F.split("t", " ")).alias("o"), analysis.display_values(F.col("m")).alias("m")).first()
    assert (list(got.o), got.m) == ([0, 6, 9], "x | y")


def test_schema_round_trip(tmp_path):
    schema = Schema((Field("all", "combined", "freqs_only", sources=("a", "b")), Field("tags", "keyword", "docs_only", True, False, True)))
    schema.save(tmp_path / "s.json")
    assert Schema.load(tmp_path / "s.json") == schema
    assert Schema.load(tmp_path / "none.json") == default_schema()
    assert Field.from_dict({"name": "x", "type": "blob", "index": "huge"}) == Field("x", "text", "none")
    assert [f.name for f in default_schema().indexed()] == ["title", "body"]
