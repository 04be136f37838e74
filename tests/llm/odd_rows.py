"""Rows that every operator has to take."""

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Null, empty, blank and very long texts, ties, repeated rows, null ids and columns.
ODD = [
    (1, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "src1"), (4, "one", "en", "src1"), (4, "one", "en", "src1"),
    (5, "word " * 30_000, "fr", "src2"), (None, "a b c d e f g", "en", "src0"), (6, "a b c d e f g", "en", "src0"), (7, "one", "de", "src9"),
    (8, "é ß ñ 漢字 　 x", "de", "src9"),
]
