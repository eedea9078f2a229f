"""Slow, obvious versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HARD = [
    None, "", " \t\n", "a", "A b", "one two three four", "one two three four five", "ONE two  three\nfour\tfive six",
    "é ü x y 漢字 \U0001f600 b\x1cc", "x " * 3000, "w" * 5000, "a b c d e " * 40, "a b c d e f",
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0
