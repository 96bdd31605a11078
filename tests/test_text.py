import pytest
from pyspark.sql import functions as F

from stihora.functions import text as T

POEM = "сонце грее над гора\nптица пее\n\nреката тече\nкон морето сина"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).head().y


def test_lines_and_stanzas(spark):
    assert one(spark, POEM, F.size(T.lines(F.col("x")))) == 4
    assert one(spark, POEM, F.size(T.stanzas(F.col("x")))) == 2
    assert one(spark, " \n \r\n　", F.size(T.lines(F.col("x")))) == 0


@pytest.mark.parametrize("line,want", [("сонце грее над гора", "ра"), ("птица пее", "е"), ("1947 -", None), ("крв", None), ("", None), ("тихо, снег!", "ег")])
def test_rhyme_endings(spark, line, want):
    assert one(spark, line, T.rhyme_ending(F.col("x"))) == want


def test_repetition(spark):
    assert one(spark, "а б а", T.distinctness(T.words(F.col("x")), 1)) == pytest.approx(2 / 3)
    assert one(spark, "а", T.distinctness(T.words(F.col("x")), 2)) == 0
    assert one(spark, ["а", "б", "а", "а"], T.most_repeats(F.col("x")), "array<string>") == 3
    assert one(spark, [], T.most_repeats(F.col("x")), "array<string>") == 0


@pytest.mark.parametrize("text,markup,chat", [("сонце -\n- ако дожд\n1. песна", True, False), ("**Песна**\nсонце", True, True), ("### Песна", True, True), ("```\nx", True, True), ("песна - дожд", False, False)])
def test_markup(spark, text, markup, chat):
    assert one(spark, text, T.has_markup(F.col("x"))) is markup
    assert one(spark, text, T.has_markup(F.col("x"), chat_only=True)) is chat


def test_splice_in_any_order(spark):
    edit = lambda a, b, p: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("put"))
    for edits in ([edit(0, 6, "вене"), edit(12, 20, "самотна")], [edit(12, 20, "самотна"), edit(0, 6, "вене")]):
        assert one(spark, "чемрее врба проклета", T.splice(F.col("x"), F.array(*edits))) == "вене врба самотна"


def test_reasoning_display_slug_and_ids(spark):
    assert one(spark, "<think>а\nб</think>\nпесна", T.strip_reasoning(F.col("x"))) == "песна"
    assert one(spark, "<think>а", T.strip_reasoning(F.col("x"))) == ""
    assert one(spark, " а\r\n\r\n\r\n\r\nб ", T.clean_display(F.col("x"))) == "а\n\nб"
    assert one(spark, "Јован: Песна!", T.slug(F.col("x"))) == "Јован_Песна"
    assert one(spark, "<a>& ", T.script_safe(F.col("x"))) == "\\u003ca\\u003e\\u0026\\u2028"
    assert len(one(spark, "a", T.item_id(F.col("x"), F.lit("b")))) == 10


def test_masks(spark):
    assert one(spark, "река тече река", T.mask_first(F.col("x"), F.lit("река"))) == "[MASK] тече река"
    assert one(spark, "река", T.mask_first(F.col("x"), F.lit("мост"), brackets=True)) == "река"


@pytest.mark.parametrize("feats,pos,want", [
    ("Degree=Pos", "ADV", []), ("", "NOUN", []), ("Case=Nom|Gender=Fem|Number=Sing", "ADJ", ["Gender=Fem|Number=Sing"]),
    ("Case=Nom|Gender=Fem|Number=Sing", "NOUN", ["Gender=Fem|Number=Sing", "Number=Sing"]), ("Definite=Def|Number=Sing", "NOUN", []),
])
def test_relaxation_is_cumulative_and_never_empty(spark, feats, pos, want):
    steps = T.relaxed_features(T.parse_features(F.col("x")), F.lit(pos))
    assert one(spark, feats, F.transform(steps, T.render_features)) == want


def test_nulls_stay_null(spark):
    for f in (T.trimmed, T.words, T.lines, T.stanzas, T.rhyme_ending, T.strip_reasoning, T.slug, T.collapsed_line):
        assert one(spark, None, f(F.col("x"))) is None
