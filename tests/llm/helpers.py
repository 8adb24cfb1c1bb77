"""Small documents with the awkward cases: nulls, empty and long texts, copies, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use themselves.
EXTRA = ", uid string, id string, fp string, h string, name string, found string, kept string, score string, `a.b` string"


def prose(rng: random.Random, words: int, kind: str = "en") -> str:
    parts = {"en": ["the", "an", "ther", "ing", "ed", "sh", "wh", "ou"], "fr": ["é", "eau", "eux", "ç", "oi", "qu", "è", "ai"]}[kind]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list = [None, "", " ", "\n\n", "one", "two words", "x" * 5000, "é中\U0001f600 mixed ß"]
    base = [prose(rng, rng.randint(5, 120), rng.choice(["en", "fr"])) for _ in range(max(n, 6))]
    texts += base
    texts += [base[0], base[0].replace(" ", "\t\n", 3), base[1] + " tail", base[1] + " tail", base[2].upper(), base[3] + " " + base[4]]
    rows = [(k, t, rng.choice(["en", "fr"]), rng.choice(["src0", "src1", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, base[5], None, None, 3), (None, base[5], None, None, 3)]
    rng.shuffle(rows)
    return rows


def with_extra(rows: list[tuple]) -> list[tuple]:
    return [(*r, "u", None, "f", "h", "n", "d", "k", "s", "ab") for r in rows]
