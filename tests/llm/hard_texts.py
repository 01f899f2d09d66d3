"""Texts every operator must take."""

# null, empty, blank, one word, code points of several bytes, a very long text, and repeats
HARD_TEXTS = [None, "", " \t\n\x0b\x0c\r ", "word", "naïve 漢字 😀 text", "w " * 40_000 + "end", "twice told tale", "twice told tale"]
