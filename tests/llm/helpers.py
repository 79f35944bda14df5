"""Small tables with the awkward cases every operator has to take."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def documents(n: int = 120, seed: int = 1) -> list[tuple[int | None, str | None, str]]:
    """Rows (doc_id, text, lang): random prose, copies, repeats, null, empty, blank, very long and odd texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [sentence(rng, rng.randint(1, 80)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " more", None, None, "", "   \n\t ", "a", "é ü 漢字 \U0001f642", "x\n\nx\n y \nx", "\r\x0b\x0c mixed\tblank s"]
    texts += [" ".join(texts[2].split() * 3), sentence(rng, 30_000), "word " * 5000, "q" * 50_000]
    return [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, "no id at all", "en")]


SCHEMA = "doc_id bigint, text string, lang string"
