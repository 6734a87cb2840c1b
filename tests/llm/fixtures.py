"""Rows with nulls, empty and long texts, ties, repeats and an extra column whose name clashes with the operators' own."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string"


def rows():
    words = "the quick brown fox jumps over the lazy dog while Ähren ñandú 中文 😀 sleep in 1984 winters".split()
    out = []
    for i in range(40):
        text = " ".join(words[(i * j + j // 3) % len(words)] + ("." if j % 9 == 8 else "") for j in range(5 + 7 * i))
        out.append((i, text, ["en", "fr", "de", None][i % 4], "s", len(text), "x"))
    long = " ".join(words[(k * k + k // 5) % len(words)] for k in range(9000))
    out += [(100, long, "en", "s", 0, "x"), (101, long.replace(" ", "  "), "en", "s", 0, "x"), (102, None, None, None, None, None), (103, "", "en", "s", 0, "x"), (104, " \n\t ", "en", "s", 0, "x")]
    out += [(105, out[5][1], "en", "s", 0, "x"), (106, out[5][1] + " ", "en", "s", 0, "x"), (106, out[5][1] + " ", "en", "s", 0, "x"), (107, "a  b\n\nc ▁ d\x1c\x00</s><|endoftext|> a", "en", "s", 0, "x"), (None, "no id", "en", "s", 0, "x")]
    return out


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
