"""Small corpora with awkward rows, and brute-force versions of what the operators promise."""

from __future__ import annotations

import random
import re

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, node long, part int, label int, "
    "score double, place long, length long, rank long, spans string, tokens string, hash long"
)


def sentences(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "ou", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """Exact copies, near copies, shared passages, white space of all kinds, one long text, null and empty texts."""
    rng = random.Random(5)
    base = [sentences(rng, n) for n in (40, 80, 120, 300)]
    passage = sentences(rng, 60)
    texts: list[str | None] = list(base)
    texts += [base[1], base[1], base[1].upper()]
    for k in range(14):
        words = base[2].split()
        words[5 + 7 * k % 100] = f"x{k}"
        texts.append(" ".join(words))
    texts += [f"{sentences(rng, 30)} {passage}\n{sentences(rng, 30)}", f"{passage}\t{sentences(rng, 20)}", passage]
    texts += [None, "", " \n\t ", "one", "One two", "one  two", "a b c d", "héé ñandú ß Straße", "x" * 5000]
    texts += [" ".join(["again"] * 50), sentences(rng, 6000), "don't <|endoftext|> stop\x1cnow  \n\n\n end "]
    return [(i * 3 % 101, t) for i, t in enumerate(texts)]


def frame(spark, rows: list[tuple]):
    """Rows of (doc_id, text) with further columns whose names clash with inner ones."""
    full = [(i, t, "en", "s", len(t or ""), 1, 2, 3, 0.5, 4, 5, 6, "x", "y", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def shingle_set(text: str | None, n: int) -> set:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def component_ids(rows: list[tuple], n: int, percent: int) -> dict[int, int]:
    sets = {i: shingle_set(t, n) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return label


def without_repeats(rows: list[tuple], length: int) -> dict[int, tuple[str, int, int]]:
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            key = tuple(words[p : p + length])
            if key in seen:
                gone[p : p + length] = [True] * length
            seen.add(key)
        out[i] = (b" ".join(w for w, g in zip(words, gone) if not g).decode(), len(words), sum(gone))
    return out
