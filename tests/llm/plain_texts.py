"""Texts for the tests, and words, shingles and digests in plain Python."""

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORDS.findall((text or "").translate(LOW) if lower else text or "")


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_texts():
    """Nulls, empty and blank texts, copies, near copies, a shared passage, a very long text, rare characters."""
    pick = random.Random(5)
    pool = [f"w{n}" for n in range(300)] + ["Été", "straße", "日本", "😀", "A b"]
    some = lambda n: " ".join(pick.choice(pool) for _ in range(n))
    base, passage = some(120), some(30)
    near = [" ".join([*base.split()[:k], "changed", *base.split()[k + 1 :]]) for k in (5, 60, 110)]
    texts = [None, "", " \n\t", "one", "one", "One  two\nthree", "a b c d e", base, base, base.replace(" ", "\n", 3), base.upper(), *near]
    texts += [f"{some(40)} {passage} {some(40)}" for _ in range(8)] + [some(6000), "of " * 200, passage]
    return texts + [some(pick.randint(1, 60)) for _ in range(10)] + [None]
