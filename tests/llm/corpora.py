"""Texts for the tests of the corpus operators."""

import random

#: Words of several byte lengths, with signs that the operators treat specially.
VOCABULARY = ["the", "of", "and", "Éa", "über", "x", "thble", "on-er", "a,", "12", "ñandú", "$$", "q.", "lo", "mi", "zu"]


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(VOCABULARY) + rnd.choice(["", "", "s", "er", "ing"]) for _ in range(n))


def edge_texts() -> list[str | None]:
    """Null, empty, blank, one word, ties and a very long word."""
    return [None, "", " \n\t ", "x", "x", "a b c d", "a b c d", "ab " * 7, "z" * 5000, "\n\n", "é" * 60]


def corpus(seed: int, n: int) -> list[str | None]:
    """Fresh texts, exact copies, near copies, shared passages, inner repeats and the edge cases."""
    rnd = random.Random(seed)
    shared = [sentence(rnd, 60) for _ in range(3)]
    texts: list[str | None] = edge_texts()
    for _ in range(n):
        kind = rnd.random()
        full = [t for t in texts if t and len(t) > 150]
        if kind < 0.4 or not full:
            texts.append(sentence(rnd, rnd.randint(3, 150)))
        elif kind < 0.5:
            texts.append(rnd.choice(full))
        elif kind < 0.75:
            words = rnd.choice(full).split(" ")
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
            texts.append(" ".join(words))
        elif kind < 0.9:
            texts.append(sentence(rnd, 20) + "\n" + rnd.choice(shared) + " " + sentence(rnd, 30))
        else:
            part = sentence(rnd, 40)
            texts.append(part + " " + sentence(rnd, 9) + " " + part)
    return texts
