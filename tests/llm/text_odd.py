"""Rows with nulls, ties, empty, long and odd texts."""

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "two words"), (6, "the MIT License here"),
    (7, LONG), (8, LONG), (8, LONG), (None, LONG), (None, None), (9, "äß   \U0001f600 a\u0085b"),
    (10, "a  b\n\n c \n"), (11, "x" * 5000), (12, LONG[:900] + " changed " + LONG[907:]),
    (13, "<|endoftext|> \n <|endoftext|>"), (14, "\x1c \x1c"), (15, "a \n b"),
]
