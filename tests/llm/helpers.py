"""Small documents with the awkward cases that every operator must take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(40_000))

AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1, "x"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a", 1, "x"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a", 1, "x"),
    (3, " the quick\tbrown fox jumps over\nthe lazy dog ", "en", "b", 1, "x"),
    (4, None, "en", "a", None, None),
    (5, "", None, None, 0, "x"),
    (6, " \n\t", "en", "b", 0, "x"),
    (None, "the quick brown fox jumps over the lazy dog", "en", None, 1, "x"),
    (None, "a text of its own", None, None, 1, "x"),
    (7, "Ünï cödé ❤ 漢字 and <|im_end|> marks <|| here", "fr", "c", 1, "x"),
    (8, LONG, "en", "a", 1, "x"),
    (9, LONG + " end", "en", "c", 1, "x"),
    (10, "it's 42 can't ÀÉ² <|endoftext|> 'S", "en", "a", 1, "x"),
]


def documents(spark, rows=AWKWARD, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows, schema)


#: Columns whose names the operators use themselves.
CLASHING = ["keep_id", "hash", "kept", "group_size", "norm", "size", "target", "length", "offset", "nth", "s", "l", "_salt", "source_size", "rate", "sig", "class_id", "score", "quality"]


def with_clashes(df):
    for name in CLASHING:
        df = df.selectExpr("*", f"cast('clash' as string) as `{name}`")
    return df
