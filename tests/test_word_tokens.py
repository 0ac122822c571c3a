"""Word tokens by language: golden lines, and what holds for any line."""

import random

from pyspark.sql import functions as F

from parallax.functions.word_tokens import _by_line, _by_word, tokenize_words

GOLDEN = [
    ("en", "Mr. Smith doesn't pay $5,300.50, does he?", "Mr. Smith doesn 't pay $ 5,300.50 , does he ?"),
    ("en", "It's 5 p.m. in St. Louis. Wait... what?", "It 's 5 p.m. in St. Louis . Wait ... what ?"),
    ("en", "See No. 5 or the No. of it.", "See No. 5 or the No. of it ."),
    ("en", "See No. Five.", "See No . Five ."),
    ("en", "(cf. J. R. Jones, e.g. there.)", "( cf . J. R. Jones , e.g. there . )"),
    ("en", "the dogs' 1990's 'quoted' words", "the dogs ' 1990 's ' quoted ' words"),
    ("fr", "L'homme n'est pas là, M. Dupont.", "L' homme n' est pas là , M. Dupont ."),
    ("fr", "Mme. Curie, 3,5 p. 100", "Mme. Curie , 3,5 p . 100"),
    ("es", "El Sr. Pérez vive en EE.UU. desde 1990. ¿Verdad?", "El Sr. Pérez vive en EE.UU. desde 1990 . ¿ Verdad ?"),
    ("es", "La Dra. Gil (pág. 5) dijo: «no».", "La Dra. Gil ( pág. 5 ) dijo : « no » ."),
    ("de", "Dr. Müller kam z.B. um 10 Uhr, bzw. Später. Ende.", "Dr. Müller kam z.B. um 10 Uhr , bzw. Später . Ende ."),
    ("de", "Das geht's nicht.", "Das geht ' s nicht ."),
    ("xx", "Dr. Who's a-b c_d 100% sure", "Dr . Who ' s a-b c _ d 100 % sure"),
    ("en", "Mail a.b@c.org or see https://x.org/a,b?c=1 and docs/read.me now.", "Mail a.b@c.org or see https://x.org/a,b?c=1 and docs/read.me now ."),
    ("en", "  \t ", ""),
    ("en", "", ""),
    ("en", "...", "..."),
    ("en", ".", "."),
    ("en", "a , b ,c, 1,2 ,3", "a , b , c , 1,2 , 3"),
]


def test_golden_lines(spark):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(GOLDEN)], "i int, lang string, text string")
    got = {r["i"]: r["t"] for r in df.select("i", tokenize_words("text", F.col("lang")).alias("t")).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, _, want) in enumerate(GOLDEN)}


def test_nothing_but_blanks_changes(spark):
    df = spark.createDataFrame([(lang, text) for lang, text, _ in GOLDEN] + [(None, "x. Y's"), ("en", None), ("en", "w " * 50_000 + "end.")], "lang string, text string")
    rows = df.select("text", tokenize_words("text", F.col("lang")).alias("t")).collect()
    for r in rows:
        assert (r["t"] is None) == (r["text"] is None)
        if r["text"] is not None:
            assert r["t"].replace(" ", "") == "".join(r["text"].split()) and "  " not in r["t"]


def test_one_language_for_all_lines(spark):
    df = spark.createDataFrame([("Dr. Who's",)], "text string")
    assert df.select(tokenize_words("text", "en")).first()[0] == "Dr. Who 's"
    assert df.select(tokenize_words("text", "fr")).first()[0] == "Dr. Who' s"


def test_rules_over_a_line_give_the_tokens_of_its_words(spark):
    rng = random.Random(7)
    parts = [*"aBÉß12..,,''  -`s$(_²́’№\t　\x85", "𝐀", "𝐚", "Mr", "No", "Dr", "S", "Nr", "e.g", "z.B", "art", "..."]
    rows = [(rng.choice(["en", "de", "es", "fr", "it", "xx", ""]), "".join(rng.choices(parts, k=rng.randint(0, 25)))) for _ in range(4000)]
    rows += [("en", "1.2." * 2000), ("fr", "a." * 2000 + "x"), ("es", "." * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    both = df.select("text", _by_line(F.col("text"), F.col("lang")).alias("line"), _by_word(F.col("text"), F.col("lang")).alias("word"))
    assert [r for r in both.collect() if r["line"] != r["word"]] == []
