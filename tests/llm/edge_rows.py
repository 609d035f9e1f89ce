"""Rows that every operator has to cope with."""

#: Nulls, empty and blank texts, repeated rows, ties, a long text, odd characters.
EDGE = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"), (7, "One TWO three"), (None, "one two three"), (None, None),
    (8, "x" * 5000), (9, "word " * 30_000), (10, "ÄÖ ß 中文 😀 \x1c  é"), (11, "a b c d e f g h i j"), (11, "a b c d e f g h i j"), (12, "a  b   c\n\nd"), (13, "<|endoftext|> hi"),
]
