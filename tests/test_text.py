import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textward.functions import constants as C
from textward.functions import text as T


def slow_key(text):
    """The rules one after the other, on whole strings."""
    if not text or not any(c.isalpha() for c in text):
        return ""

    def fold(s):
        out = ""
        for c in s:
            for table in (C.FOLDED, C.LOOK_ALIKES, C.STAND_INS):
                if c in table:
                    out += table[c]
                    break
            else:
                out += c
        return out

    s = text.translate({ord(c): None for c in C.INVISIBLE})
    s = fold(fold(s).lower()).lower()
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"(.)\1+", r"\1", re.sub("[^a-z0-9]+", "", s))


def keys(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(T.normalise(F.col("t"))).collect()]


def test_variants_share_a_key(spark):
    variants = ["kitab", "k1t4b", "K!tab", "k i t a b", "k.i.t.a.b", "kiittaab", "кitаb", "ki​tab"]
    assert set(keys(spark, variants)) == {"kitab"}


def test_empty_keys(spark):
    assert keys(spark, ["", None, "!!!", "123", "  "]) == [""] * 5


def test_two_stays_and_io_disappears(spark):
    assert keys(spark, ["a2b", "ёa", "Şən", "İI"]) == ["a2b", "a", "sen", "i"]


def test_tokens(spark):
    df = spark.createDataFrame([("a.b,c  d-e_f#g h i",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["a", "b", "c", "d-e_f#g", "h", "i"], [], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbsŞşəİıкёé1!$*&2-. ​àßǅ́ﬁ"), max_size=12), min_size=1, max_size=60))
def test_keys_against_the_rules(spark, texts):
    assert keys(spark, texts) == [slow_key(t) for t in texts]


def test_stem_takes_the_first_listed_suffix(spark):
    words = ["kitablar", "kitablarin", "lar", "ablar", "xxxlerimiz", "dirdir", "evsizdir"]

    def slow(key):
        for s in C.FALLBACK_SUFFIXES:
            if key.endswith(s) and len(key) - len(s) >= C.MIN_STEM:
                return key[: -len(s)]
        return None

    df = spark.createDataFrame([(w,) for w in words], "k string")
    assert [r[0] for r in df.select(T.stem(F.col("k"))).collect()] == [slow(w) for w in words]


def test_near_key_quote_overlap(spark):
    df = spark.createDataFrame([("  Salam, DÜNYA!!  it's\n ok ",)], "t string")
    near, quoted, shared = df.select(T.near_key(F.col("t")), T.quote(F.lit("a'b\\c")), T.overlap(F.lit("A b c"), F.lit("b  C d"))).first()
    assert (near, quoted, shared) == ("salam dünya its ok", "'a''b\\\\c'", 2)


def test_sql_functions(spark):
    T.register(spark)
    assert spark.sql("SELECT textward_key('K1t4b'), size(textward_tokens('a, b'))").first()[:] == ("kitab", 2)


def test_keys_of_texts_are_those_of_their_tokens(spark):
    texts = ["", "a", "K1t4b kitab!KITAB  123 (x) şŞ ||", "кitab Straße Ⓐb 1a", "aa.bb\u00a0cc\u200bdd ee-ee \u2028x", "İıI Ωα \U0001F600q $$$ b1b", "zz ' '' zz\tz\nz"]
    texts += ["".join(map(chr, range(a, a + 64))) + " " + "x".join(map(chr, range(a, a + 64))) for a in range(1, 0x3000, 64)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for r in df.select(T.keys(F.col("text")).alias("a"), F.transform(T.tokens(F.col("text")), T.normalise).alias("b"), T.tokens(F.col("text")).alias("t"), F.array_remove(F.split(F.coalesce("text", F.lit("")), T.TOKEN_SPLIT), "").alias("s")).collect():
        assert r["a"] == r["b"] and r["t"] == r["s"]
